"""Retrieval and accuracy measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ndcg(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg) of each judged query: gain 2^rel - 1, discount log2(rank + 1), 0 if nothing is relevant.

    ranked has query_id, record_id and rank; judged has query_id, record_id and rel.
    """
    gain = lambda rel, rank: (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1)
    order = Window.partitionBy("query_id").orderBy(F.desc("rel"), "record_id")
    best = judged.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k)
    ideal = best.groupBy("query_id").agg(F.sum(gain(F.col("rel"), F.col("i"))).alias("ideal"))
    got = ranked.where(F.col("rank") <= k).join(judged, ["query_id", "record_id"])
    got = got.groupBy("query_id").agg(F.sum(gain(F.col("rel"), F.col("rank"))).alias("dcg"))
    value = F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0)
    return ideal.join(got, "query_id", "left").select("query_id", value.alias("ndcg"))


def success_at(ranked: DataFrame, judged: DataFrame, k: int = 3, rel: int = 2) -> DataFrame:
    """(query_id, success): whether a record of that relevance is among the first k."""
    hit = ranked.where(F.col("rank") <= k).join(judged.where(F.col("rel") >= rel), ["query_id", "record_id"], "left_semi").select("query_id").distinct()
    return judged.select("query_id").distinct().join(hit.withColumn("hit", F.lit(True)), "query_id", "left").select("query_id", F.col("hit").isNotNull().alias("success"))


def label_measures(ranked: DataFrame, labels: DataFrame, queries: DataFrame, k: int = 10, first: int = 3, rel: int = 2) -> DataFrame:
    """(query_id, ndcg, success) by ``ndcg`` and ``success_at`` where a query's relevant records are all others of its label.

    labels has record_id and label, queries query_id and label; a query is a record too. How many are relevant
    follows from the size of the label, so no row is made for a pair but the ranked ones.
    """
    places = F.least(F.col("n") - 1, F.lit(k)).cast("int")
    gain = lambda rank: (F.pow(F.lit(2.0), F.lit(rel)) - 1) / F.log2(rank + 1)
    ideal = F.aggregate(F.sequence(F.lit(1), places), F.lit(0.0), lambda acc, i: acc + gain(i))
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("label", ideal.alias("ideal"))
    wanted = queries.join(sizes, "label")
    near = ranked.where(F.col("rank") <= max(k, first)).select("query_id", "record_id", "rank")
    hits = near.join(labels, "record_id").join(queries, ["query_id", "label"])
    got = hits.groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= k, gain(F.col("rank")))).alias("dcg"), F.max(F.col("rank") <= first).alias("hit"))
    return wanted.join(got, "query_id", "left").select("query_id", (F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"), F.coalesce("hit", F.lit(False)).alias("success"))


def lift(new: Column, old: Column) -> Column:
    return F.when(old == 0, 0.0).otherwise((new - old) / old)


#: Relative error of the approximate ranks that bracket an exact one.
ACCURACY = 10_000


def floor_percentile(df: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """(group, value): the sorted value at min(n - 1, floor(p * n)); nulls don't count.

    Approximate percentiles bracket the wanted rank. Values below the bracket are counted and
    only those within it, about one in 1,500 and copies of its ends, are ranked by value, each with its count:
    no group is sorted or collected whole.
    """
    rows = df.select(F.col(group).alias("__g"), F.col(value).alias("__v")).where("__v IS NOT NULL")
    counts = rows.groupBy("__g", "__v").agg(F.count(F.lit(1)).alias("__c"))
    ends = F.percentile_approx("__v", F.array(F.lit(max(0.0, p - 3 / ACCURACY)), F.lit(min(1.0, p + 3 / ACCURACY))), F.lit(ACCURACY))
    bounds = rows.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"), ends.alias("__e"))
    near = counts.withColumnRenamed("__g", "__h").join(bounds, F.expr("__h <=> __g")).drop("__h")
    below = near.where("__v < __e[0]").groupBy("__g").agg(F.sum("__c").alias("__below"))
    inside = near.where("__v BETWEEN __e[0] AND __e[1]").withColumnRenamed("__g", "__h")
    placed = inside.join(below, F.expr("__h <=> __g"), "left").drop("__g").withColumn("__to", F.coalesce("__below", F.lit(0)) + F.sum("__c").over(Window.partitionBy("__h").orderBy("__v")))
    at = F.least(F.col("__n") - 1, F.floor(F.lit(p) * F.col("__n")))
    return placed.where((at < F.col("__to")) & (at >= F.col("__to") - F.col("__c"))).select(F.col("__h").alias(group), F.col("__v").alias(value))


def upper_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """The sorted value at n div 2."""
    return floor_percentile(df, group, value, 0.5)


def normal(s: Column) -> Column:
    """Letters and digits in lower case, anything else as one blank."""
    return F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " "))


def same_name(a: Column, b: Column) -> Column:
    """Whether two names have the same words, in any order."""
    parts = [F.sort_array(F.array_distinct(F.split(normal(x), " "))) for x in (a, b)]
    return parts[0] == parts[1]


def same_date(a: Column, b: Column) -> Column:
    return (F.length(a) >= 4) & (F.length(b) >= 4) & (F.left(a, F.lit(4)) == F.left(b, F.lit(4)))


GOLD = ("title", "creator", "date", "identifier", "language")


def field_checks(drafts: DataFrame, gold: DataFrame) -> DataFrame:
    """(record_id, one boolean per field, edits): whether a draft has the known value; null where none is known.

    gold has record_id and a column for each of GOLD. A DOI is written ``doi:...``, an ISBN as its 13 digits.
    """
    from stackroom.functions.identifiers import to_isbn13
    from stackroom.operators import library as lib

    known = gold.select("record_id", *[F.col(c).alias(f"gold_{c}") for c in GOLD])
    rows = drafts.join(known, "record_id")
    want = lambda c: F.col(f"gold_{c}")

    def same_id(i: Column) -> Column:
        doi = want("identifier").startswith("doi:") & (F.lower(i) == F.lower(want("identifier")))
        return doi | F.coalesce(i.startswith("ISBN ") & (to_isbn13(F.substring(i, 6, 1 << 20)) == want("identifier")), F.lit(False))

    right = {
        "title": normal(lib.title()) == normal(want("title")),
        "creator": (F.size("dc.creator") > 0) & same_name(lib.first("creator"), want("creator")),
        "date": same_date(lib.first("date"), want("date")),
        "identifier": F.exists(lib.texts("identifier"), same_id),
        "language": lib.first("language") == want("language"),
    }
    checks = {c: F.when(want(c).isNotNull(), F.coalesce(right[c], F.lit(False))) for c in GOLD}
    edits = sum((F.when(~checks[c], 1).otherwise(0) for c in GOLD[1:]), F.when(~checks["title"], 1).otherwise(0))
    return rows.select("record_id", *[checks[c].alias(c) for c in GOLD], edits.alias("edits"))


def field_accuracy(checks: DataFrame) -> DataFrame:
    """One row: the share of right values of each field, of the four core fields, and of drafts with one edit at most."""
    share = lambda c: F.coalesce(F.avg(F.col(c).cast("int")), F.lit(0.0))
    core = GOLD[:4]
    right, known = (F.array_compact(F.array(*[x(F.col(c)) for c in core])) for x in (lambda c: F.when(c, 1), lambda c: F.when(c.isNotNull(), 1)))
    return checks.agg(
        F.count(F.lit(1)).alias("items"), *[share(c).alias(c) for c in GOLD], (F.sum(F.size(right)) / F.nullif(F.sum(F.size(known)), F.lit(0))).alias("core"), F.avg((F.col("edits") <= 1).cast("int")).alias("accepted")
    )


def class_accuracy(drafts: DataFrame, gold: DataFrame) -> DataFrame:
    """One row over records with a known class: main class or division among the suggestions, main class first."""
    rows = drafts.join(gold.where("class_number IS NOT NULL").select("record_id", F.col("class_number").alias("__gold")), "record_id")
    starts = lambda n: F.exists("class_suggestions", lambda c: F.left(c["number"], F.lit(n)) == F.left(F.col("__gold"), F.lit(n)))
    first = F.left(F.get("class_suggestions", F.lit(0))["number"], F.lit(1)) == F.left(F.col("__gold"), F.lit(1))
    mean = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    return rows.agg(F.count(F.lit(1)).alias("items"), mean(starts(1)).alias("main_class"), mean(starts(2)).alias("division"), mean(first).alias("first_class"))


def by_kind(metrics: DataFrame, *measures: str) -> DataFrame:
    """Means of measures by kind of query and over all (kind null), and the number of queries."""
    return metrics.rollup("kind").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in measures])


def least_cosine(made: DataFrame, wanted: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """One row: the smallest dot product of unit vectors that should agree."""
    from stackroom.functions.vectors import dot

    pairs = made.select(key, F.col(vector).alias("__a")).join(wanted.select(key, F.col(vector).alias("__b")), key)
    return pairs.agg(F.min(dot(F.col("__a"), F.col("__b"))).alias("least"))
