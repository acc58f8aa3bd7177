"""Queries over text, identifiers, dates and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.functions import dates as dt
from stackroom.functions import identifiers as ids
from stackroom.functions import lexicon as lx
from stackroom.functions import text as tx
from stackroom.functions import vectors as vec
from stackroom.operators import evaluate as ev
from stackroom.streaming import maintain as st

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of them."""
    # a stream takes a pattern for either, a plain path for folders only
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


# SQL of the text functions, for DuckDB

def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def sql_words(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '([\p{{L}}\p{{N}}]+)(?:[''’]\p{{L}}+)?', 1)"


def sql_undouble(w: str) -> str:
    return f"(CASE WHEN length({w}) > 2 AND right({w}, 1) = substr({w}, length({w}) - 1, 1) AND right({w}, 1) NOT IN ('l', 's', 'z') THEN left({w}, length({w}) - 1) ELSE {w} END)"


def sql_stem(w: str) -> str:
    cut = lambda n: f"left({w}, length({w}) - {n})"
    return f"""(CASE WHEN length({w}) <= 3 OR regexp_matches({w}, '^[0-9]+$') THEN {w}
      WHEN ends_with({w}, 'ies') AND length({w}) > 4 THEN {cut(3)} || 'y'
      WHEN ends_with({w}, 'sses') THEN {cut(2)}
      WHEN ends_with({w}, 'ing') AND length({w}) > 5 THEN {sql_undouble(cut(3))}
      WHEN ends_with({w}, 'ed') AND length({w}) > 4 THEN {sql_undouble(cut(2))}
      WHEN length({w}) > 4 AND regexp_matches({w}, '(ch|sh|x|z)es$') THEN {cut(2)}
      WHEN ends_with({w}, 's') AND NOT regexp_matches({w}, '(ss|us|is)$') THEN {cut(1)}
      ELSE {w} END)"""


def sql_terms(text: str) -> str:
    return f"list_transform(list_filter({sql_words(text)}, lambda w: length(w) > 1 AND w NOT IN {_in(lx.STOP_WORDS)}), lambda w: {sql_stem('w')})"


def sql_trim(text: str) -> str:
    return f"regexp_replace({text}, '^{lx.SPACE}+|{lx.SPACE}+$', '', 'g')"


def sql_sentences(text: str) -> str:
    marked = f"""regexp_replace(regexp_replace({text}, '{lx.SPACE}+', ' ', 'g'), '([.!?]) +([A-Z0-9“"(])', '\\1' || chr(1) || '\\2', 'g')"""
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {sql_trim('s')}), lambda s: length(s) > 2)"


@query(f"""SELECT doc_id, len({sql_words('text')}) AS n_words, len(terms) AS n_terms, len(list_distinct(terms)) AS n_distinct, md5(array_to_string(terms, ' ')) AS terms_md5
FROM (SELECT doc_id, text, {sql_terms('text')} AS terms FROM documents)""")
def content_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(tx.words(F.col("text"))).alias("n_words"), tx.terms(F.col("text")).alias("terms"))
    return docs.select(
        "doc_id", F.col("n_words").cast("long"), F.size("terms").cast("long").alias("n_terms"), F.size(F.array_distinct("terms")).cast("long").alias("n_distinct"), F.md5(F.array_join("terms", " ")).alias("terms_md5")
    )


@query(f"SELECT word, {sql_stem('word')} AS stem, count(*) AS n FROM (SELECT unnest({sql_words('text')}) AS word FROM documents) GROUP BY word")
def stem_lookup(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select(F.explode(tx.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return found.select("word", tx.stem(F.col("word")).alias("stem"), "n")


@query(f"SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS sentences_md5 FROM (SELECT doc_id, {sql_sentences('text')} AS s FROM documents)")
def sentence_split(spark, sf_dir):
    cut = table(spark, sf_dir, "documents").select("doc_id", tx.sentences(F.col("text")).alias("s"))
    return cut.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


_MARKS = "(VALUES " + ", ".join(f"({i}, '{c}', [{', '.join(repr(w) for w in ws)}])" for i, (c, ws) in enumerate(lx.LANGUAGE_MARKERS.items())) + ") AS m(place, code, marks)"
_LANGUAGE_SQL = f"""
WITH found AS (SELECT doc_id, lang, {sql_words('substr(text, 1, 20000)')} AS ws FROM documents),
votes AS (SELECT doc_id, lang, len(ws) AS n, code, place, len(list_filter(ws, lambda w: list_contains(marks, w))) AS v,
  list_position(list_transform(ws, lambda w: list_contains(marks, w)), true) AS first FROM found CROSS JOIN {_MARKS}),
best AS (SELECT *, sum(v) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, first, place) AS r FROM votes),
guess AS (SELECT doc_id, lang, CASE WHEN n >= 20 AND v >= 5 THEN code END AS code, CASE WHEN n >= 20 AND v >= 5 THEN v / total END AS confidence FROM best WHERE r = 1)
"""


@query(_LANGUAGE_SQL + "SELECT doc_id, code, round(confidence, 6) AS confidence FROM guess")
def language_guess(spark, sf_dir):
    g = table(spark, sf_dir, "documents").select("doc_id", tx.guess_language(F.col("text")).alias("g"))
    return g.select("doc_id", F.col("g.code").alias("code"), F.round("g.confidence", 6).alias("confidence"))


@query(_LANGUAGE_SQL + "SELECT lang, code, count(*) AS n FROM guess GROUP BY lang, code")
def language_confusion(spark, sf_dir):
    g = table(spark, sf_dir, "documents").select("lang", tx.guess_language(F.col("text")).alias("g"))
    return g.groupBy("lang", F.col("g.code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


_ISBN_SQL = """
WITH core AS (SELECT p_partkey, lpad(p_partkey::VARCHAR, 9, '0') AS c FROM part),
sums AS (SELECT *, list_sum(list_transform(range(9), lambda i: substr(c, (i + 1)::BIGINT, 1)::INT * (10 - i))) AS s10,
  list_sum(list_transform(range(12), lambda i: substr('978' || c, (i + 1)::BIGINT, 1)::INT * (CASE WHEN i % 2 = 0 THEN 1 ELSE 3 END))) AS s13 FROM core),
digits AS (SELECT *, (11 - s10 % 11) % 11 AS d10, (10 - s13 % 10) % 10 AS d13 FROM sums),
raws AS (SELECT p_partkey, c, CASE WHEN d10 = 10 THEN 'X' ELSE d10::VARCHAR END AS k10, d13::BIGINT::VARCHAR AS k13, d13 FROM
  (SELECT p_partkey, c, d10::BIGINT AS d10, d13 FROM digits))
"""


def _isbns(spark, sf_dir):
    core = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    s10 = sum((F.substring(core, i + 1, 1).cast("int") * (10 - i) for i in range(1, 9)), F.substring(core, 1, 1).cast("int") * 10)
    d10 = (11 - s10 % 11) % 11
    check = ids.isbn13_check(F.concat(F.lit("978"), core))
    rows = table(spark, sf_dir, "part").select("p_partkey", core.alias("c"), F.when(d10 == 10, "X").otherwise(d10.cast("string")).alias("k10"), check.alias("k13"))
    odd = F.col("p_partkey") % 3 == 0
    return rows.select(
        "p_partkey",
        F.concat(F.lit("ISBN-10: "), F.substring("c", 1, 1), F.lit("-"), F.substring("c", 2, 8), F.lit("-"), "k10").alias("raw10"),
        F.concat(F.lit("978-"), "c", F.lit(" "), F.when(odd, ((F.col("k13").cast("int") + 1) % 10).cast("string")).otherwise(F.col("k13"))).alias("raw13"),
    )


@query(_ISBN_SQL + """SELECT p_partkey, 'ISBN-10: ' || substr(c, 1, 1) || '-' || substr(c, 2, 8) || '-' || k10 AS raw10,
 '978-' || c || ' ' || CASE WHEN p_partkey % 3 = 0 THEN ((d13 + 1) % 10)::BIGINT::VARCHAR ELSE k13 END AS raw13,
 true AS valid10, p_partkey % 3 <> 0 AS valid13, '978' || c || k13 AS from10, CASE WHEN p_partkey % 3 <> 0 THEN '978' || c || k13 END AS from13 FROM raws""")
def isbn_check(spark, sf_dir):
    raw10, raw13 = F.col("raw10"), F.col("raw13")
    return _isbns(spark, sf_dir).select(
        "p_partkey", "raw10", "raw13", ids.valid_isbn(raw10).alias("valid10"), ids.valid_isbn(raw13).alias("valid13"), ids.to_isbn13(raw10).alias("from10"), ids.to_isbn13(raw13).alias("from13")
    )


@query(_ISBN_SQL + """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '978' || c || k13 ELSE '978' || c || k13 END AS found, 1::BIGINT AS n FROM raws""")
def isbn_find(spark, sf_dir):
    prose = F.concat(F.lit("First printing. "), "raw10", F.lit(". Also "), "raw13", F.lit(" and 1234567890."))
    got = _isbns(spark, sf_dir).select("p_partkey", ids.find_isbns(prose).alias("f"))
    return got.select("p_partkey", F.array_join("f", ",").alias("found"), F.size("f").cast("long").alias("n"))


@query("""SELECT o_orderkey, '10.5555/ord.' || o_orderkey AS doi, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS written,
 strftime(o_orderdate, '%Y') AS copyright, strftime(o_orderdate, '%Y-%m') AS normal, strftime(o_orderdate, '%Y') AS year_only FROM orders""")
def dates_and_dois(spark, sf_dir):
    d = F.col("o_orderdate")
    o = table(spark, sf_dir, "orders")
    say = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    return o.select(
        "o_orderkey",
        ids.find_doi(say("See (10.5555/ord.", F.col("o_orderkey").cast("string"), "). More.")).alias("doi"),
        dt.date_in_text(say("Signed on ", F.date_format(d, "yyyy-MM-dd"), ", copyright 1999.")).alias("iso"),
        dt.date_in_text(say("On the ", F.date_format(d, "d"), "th ", F.date_format(d, "MMMM"), ", ", F.date_format(d, "yyyy"), ".")).alias("written"),
        dt.date_in_text(say("(c) ", F.date_format(d, "yyyy"), " all rights")).alias("copyright"),
        dt.normalise_date(say(" ", F.date_format(d, "yyyy-MM"), " or so")).alias("normal"),
        dt.normalise_date(say("about ", F.date_format(d, "yyyy"), ".")).alias("year_only"),
    )


def sql_fnv(s: str) -> str:
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({s}, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(f"SELECT p_partkey, {sql_fnv('p_name')}::BIGINT AS hash FROM part")
def fnv1a_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", ids.fnv1a(F.col("p_name")).alias("hash"))


@query(f"SELECT doc_id, lower(to_hex({sql_fnv('source || chr(0) || substr(text, 1, 6000)')})) AS signature FROM documents")
def document_signature(spark, sf_dir):
    """Signatures of what a model sees: the title, and as much of the body as its input has."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", ids.document_signature(F.col("source"), F.substring("text", 1, 6000)).alias("signature"))


@query("""WITH stored AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE '' END || text AS text FROM documents WHERE doc_id % 10 <> 5)
SELECT d.doc_id FROM documents d LEFT JOIN stored s USING (doc_id) WHERE s.doc_id IS NULL OR substr(s.text, 1, 6000) <> substr(d.text, 1, 6000)""")
def stale_signatures(spark, sf_dir):
    """Records whose stored signature is gone or differs."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "record_id")
    signature = ids.document_signature(F.col("source"), F.substring("text", 1, 6000))
    before = docs.where("record_id % 10 <> 5").withColumn("text", F.concat(F.when(F.col("record_id") % 10 == 0, "x").otherwise(""), F.col("text")))
    return st.stale(docs, before.select("record_id", signature.alias("sig")), signature).select(F.col("record_id").alias("doc_id"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, sha256(text) AS sha256 FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1")
def exact_duplicates(spark, sf_dir):
    """Later copies and the first of them, by content hash: a minimum is aggregated before it is shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    first = docs.groupBy("sha256").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return docs.join(first, "sha256").where("doc_id <> first_id").select("doc_id", "first_id", "sha256")


def _entity_sql(s: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("amp", "&")):
        s = f"replace({s}, '&{name};', '{char}')"
    return s


def sql_strip(html: str) -> str:
    s = f"regexp_replace({html}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head[^>]*>.*?</head>', ' ', 'g')"
    s = f"regexp_replace({s}, '(?i)<br\\s*/?>|</p>|</h[1-6]>|</div>|</li>', chr(10), 'g')"
    s = _entity_sql(f"regexp_replace({s}, '<[^>]+>', ' ', 'g')")
    return sql_trim(f"regexp_replace(regexp_replace({s}, '[ \\t]+', ' ', 'g'), '\\n{lx.SPACE}*\\n+', chr(10), 'g')")


@query(f"""SELECT page_id, length(s) AS n, md5(s) AS text_md5, {sql_trim("regexp_replace(" + _entity_sql("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)") + ", '[ \\t]+', ' ', 'g')")} AS title
FROM (SELECT page_id, html, {sql_strip('html')} AS s FROM pages)""")
def strip_markup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", tx.strip_markup(F.col("html")).alias("s"), tx.html_title(F.col("html")).alias("title"))
    return pages.select("page_id", F.length("s").cast("long").alias("n"), F.md5("s").alias("text_md5"), "title")


@query(f"""SELECT event_type, max(value) FILTER (WHERE i = least(n - 1, floor(0.95 * n))) AS p95, max(value) FILTER (WHERE i = n // 2) AS median FROM
(SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type""")
def percentiles(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    high = ev.floor_percentile(events, "event_type", "value", 0.95).withColumnRenamed("value", "p95")
    return high.join(ev.upper_median(events, "event_type", "value").withColumnRenamed("value", "median"), "event_type")


_VECTORS_SQL = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
pairs AS (SELECT q.vec_id AS query_id, d.vec_id AS record_id, round(list_dot_product(q.e, d.e), 9) AS score, d.label = q.label AS same FROM u q, u d WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM pairs)
"""


def _similar(spark, sf_dir, dims: int | None = None, top: int | None = None, min_score: float | None = None):
    from stackroom.operators import embed as em

    rows = table(spark, sf_dir, "embeddings")
    unit = vec.truncated(F.col("embedding"), dims) if dims else vec.normalize(F.col("embedding"))
    vectors = rows.select(F.col("vec_id").alias("record_id"), "label", unit.alias("vector"))
    queries = vectors.where("record_id % 20 = 0").select(F.col("record_id").alias("query_id"), "vector")
    # scores count as they are at nine decimals
    loose = min_score - 1e-9 if min_score is not None else None
    got = em.similar(queries, vectors, loose, top + 1 if top else None).where("query_id <> record_id").withColumn("score", F.round("score", 9))
    return got if min_score is None else got.where(F.col("score") >= min_score), vectors


@query(_VECTORS_SQL + "SELECT query_id, rank, record_id, round(score, 6) AS score FROM ranked WHERE rank <= 20")
def vector_topk(spark, sf_dir):
    from stackroom.operators import search as se

    got, _ = _similar(spark, sf_dir, top=20)
    return se.ranked(got, 20).select("query_id", F.col("rank").cast("long"), "record_id", F.round("score", 6).alias("score"))


@query(_VECTORS_SQL + "SELECT query_id, count(*) AS n, round(sum(score), 4) AS total FROM ranked WHERE score >= 0.12 GROUP BY query_id")
def vector_threshold(spark, sf_dir):
    got, _ = _similar(spark, sf_dir, min_score=0.12)
    return got.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query(_VECTORS_SQL.replace("list_transform(embedding, lambda x: x::DOUBLE)", "list_transform(embedding[1:32], lambda x: x::DOUBLE)") + "SELECT query_id, rank, record_id, round(score, 6) AS score FROM ranked WHERE rank <= 20")
def vector_truncated(spark, sf_dir):
    from stackroom.operators import search as se

    got, _ = _similar(spark, sf_dir, dims=32, top=20)
    return se.ranked(got, 20).select("query_id", F.col("rank").cast("long"), "record_id", F.round("score", 6).alias("score"))


_NDCG_SQL = _VECTORS_SQL + """, judged AS (SELECT query_id, record_id, same::INT * 2 AS rel FROM pairs),
ideal AS (SELECT query_id, sum((2 ** rel - 1) / log2(i + 1)) AS ideal FROM (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, record_id) AS i FROM judged) WHERE i <= 10 GROUP BY query_id),
got AS (SELECT query_id, sum((2 ** (same::INT * 2) - 1) / log2(rank + 1)) AS dcg, max(CASE WHEN rank <= 3 AND same THEN 1 ELSE 0 END) AS hit FROM ranked WHERE rank <= 10 GROUP BY query_id)
"""


def _measures(spark, sf_dir, dims=None):
    from stackroom.operators import search as se

    got, vectors = _similar(spark, sf_dir, dims=dims, top=20)
    labels = vectors.select("record_id", "label")
    return ev.label_measures(se.ranked(got, 20), labels, labels.where("record_id % 20 = 0").select(F.col("record_id").alias("query_id"), "label"))


@query(_NDCG_SQL + "SELECT query_id, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg, hit = 1 AS success FROM ideal JOIN got USING (query_id) WHERE ideal > 0")
def ndcg_at_10(spark, sf_dir):
    return _measures(spark, sf_dir).select("query_id", F.round("ndcg", 6).alias("ndcg"), "success")
