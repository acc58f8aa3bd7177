"""SimHash near-duplicate groups through deletion-variant signatures.

A text's fingerprint has 64 bits: bit k is 1 if it is set in more than half of the
XXH64 hashes of its word shingles. Fingerprints link at ``max_bits`` or fewer
differing bits. They are cut into ``max_bits // 2 + 1`` segments, so that of a linked
pair one segment differs by at most one bit; each distinct fingerprint is indexed
under the variants of each segment with one bit taken out (a wildcard), and an
equality join of variants finds every pair. The join verifies the distance, and only
one variant of a segment may report a pair.

Equal fingerprints are one vertex, so copies cost nothing. A variant that more than
``dense`` distinct fingerprints share is not joined pair by pair: those fingerprints
are grouped by all sets of ``max_bits`` wildcards over the whole 64 bits, whose
members are within max_bits of each other, and are linked to the least of each
group. That keeps every component whole at a linear number of edges.

Cases: A-Z are lower-cased, words are runs of anything but blank and U+0009-000D;
fewer words than a shingle: the whole sequence is one; a null or wordless text has
the fingerprint 0 and links like any other; rows with a null id take part, but an id
that a component is named by is never null if it has any; repeated rows are members
like others; other columns are ignored. ``dense`` chooses between two plans with the same
result: what pairs cost grows with the square of a key's fingerprints, what grouping costs
is 2,016 rows for each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.llm.components import connected_components
from stackroom.shared import fresh, materialize, named, old_names, plain_names, wide_rows

SEED = 42
#: Shingles that are hashed at a time.
BLOCK = 1 << 15


def fingerprint(data: bytes, shingle_words: int = 3) -> int:
    """The fingerprint of UTF-8 text as a signed 64-bit number."""
    import numpy as np
    from xxhash import xxh64_digest

    words = data.lower().split()
    if not words:
        return 0
    k = min(shingle_words, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[k - 1 :].tolist()
    ones, n = np.zeros(64, np.int64), len(stops)
    for lo in range(0, n, BLOCK):
        some = [xxh64_digest(joined[a:b], SEED) for a, b in zip(starts[lo : lo + BLOCK], stops[lo : lo + BLOCK], strict=False)]
        bits = np.unpackbits(np.frombuffer(b"".join(some), np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.uint16) if len(some) < 65_536 else bits.sum(0)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def add_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fp", shingle_words: int = 3) -> DataFrame:
    """docs with the fingerprint of each row's text; by row, without a shuffle."""
    wide_rows(docs.sparkSession)
    source = docs.withColumn(fresh(docs.columns, "__data"), F.coalesce(named(text_col), F.lit("")).cast("binary"))
    schema = T.StructType([*docs.schema, T.StructField(out, T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            made = [fingerprint(x, shingle_words) for x in batch.column(batch.num_columns - 1).to_pylist()]
            arrays = [*batch.columns[:-1], pa.array(made, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], out])

    return source.mapInArrow(run, schema)


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    count = max_bits // 2 + 1
    cuts = [64 * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _shared(variants: DataFrame) -> DataFrame:
    """Those of variants (slot, key, fp) whose key others share, with the number n and the least of all that do.

    Counts are aggregated and joined back: a window would need all rows of a key in one task, where a
    join to a written table can be split.
    """
    counts = variants.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("least")).where("n > 1")
    # the table of keys grows with the input, so it is never broadcast
    return variants.join(materialize(counts, "shared-keys").hint("merge"), ["slot", "key"])


def link_fingerprints(fps: DataFrame, fp_col: str = "fp", max_bits: int = 2, dense: int = 256) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints within max_bits, 0 to 3, into their components."""
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits is 0 to 3")
    # a fingerprint becomes 64 rows, so few large partitions of fingerprints would be too few
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = fps.select(F.col(fp_col).alias("fp")).distinct().repartition(parts)
    if not max_bits:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    slots = [(s, w, bit) for s, w in _segments(max_bits) for bit in range(w)]
    # a slot takes out one bit of a segment: kept bits, the bit, and the segment's bits
    keep = [((1 << w) - 1 - (1 << bit)) << s for s, w, bit in slots]
    table = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(keep)])
    variants = nodes.select("fp", F.explode(table).alias("v")).select(
        F.col("v.slot").alias("slot"), F.col("fp").bitwiseAND(F.col("v.mask")).alias("key"), "fp"
    )
    shared = materialize(_shared(variants), "variants")

    bits = F.array(*[F.lit(_signed(1 << (s + bit))) for s, w, bit in slots])
    whole = F.array(*[F.lit(_signed(((1 << w) - 1) << s)) for s, w, bit in slots])
    first = F.array(*[F.lit(bit == 0) for s, w, bit in slots])
    a, b = shared.where(F.col("n") <= dense).alias("a"), shared.where(F.col("n") <= dense).alias("b")
    here = F.col("a.fp").bitwiseXOR(F.col("b.fp")).bitwiseAND(F.get(whole, F.col("a.slot")))
    reports = (here == F.get(bits, F.col("a.slot"))) | ((here == 0) & F.get(first, F.col("a.slot")))
    pairs = a.join(
        b,
        (F.col("a.slot") == F.col("b.slot"))
        & (F.col("a.key") == F.col("b.key"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (_distance(F.col("a.fp"), F.col("b.fp")) <= max_bits)
        & reports,
    ).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    crowd = shared.where(F.col("n") > dense).select("fp").distinct()
    if crowd.limit(1).count():
        sets = [_signed(~sum(1 << i for i in c) & (1 << 64) - 1) for c in combinations(range(64), max_bits)]
        text = json.dumps(sets)
        held = crowd.select("fp", F.posexplode(F.from_json(F.lit(text), "array<bigint>")).alias("slot", "mask"))
        held = held.select("fp", "slot", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        pairs = pairs.union(_shared(held).select(F.col("least").alias("a"), F.col("fp").alias("b")).where("a < b"))
    return pairs.distinct()


def group_fingerprints(rows: DataFrame, id_col: str = "doc_id", fp_col: str = "fp", max_bits: int = 2, dense: int = 256) -> DataFrame:
    """What group_linked gives for fingerprints within max_bits."""
    return group_linked(rows, link_fingerprints(rows, fp_col, max_bits, dense), id_col, fp_col)


def group_linked(rows: DataFrame, edges: DataFrame, id_col: str = "doc_id", fp_col: str = "fp") -> DataFrame:
    """(fp, label, component_id, winners, size) of each distinct fingerprint of rows, linked by edges (a, b).

    label is the least fingerprint of the component, component_id the least id in it
    (null if it has none), winners the number of rows with that id, size that of all
    rows. What a component's many fingerprints are joined to is written first, so that
    the join can be split or broadcast.
    """
    labels = materialize(connected_components(edges), "labels")
    heads = rows.groupBy(F.col(fp_col).alias("fp"), F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    # an id that is there goes before nulls
    key = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    least = heads.groupBy("fp").agg(F.min(F.struct(key.alias("key"), "n")).alias("h"), F.sum("n").alias("size"))
    least = least.select("fp", F.col("h.key").alias("key"), F.col("h.n").alias("n"), "size")
    placed = least.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("label", "fp").alias("label"), "key", "n", "size"
    )
    placed = materialize(placed, "placed")
    by_key = placed.groupBy("label", "key").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    best = materialize(by_key.groupBy("label").agg(F.min(F.struct("key", "n")).alias("best"), F.sum("size").alias("total")), "best")
    named = placed.join(best, "label")
    return materialize(
        named.select("fp", "label", F.col("best.key.id").alias("component_id"), F.col("best.n").alias("winners"), F.col("total").alias("size")), "groups"
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 2, dense: int = 256
) -> DataFrame:
    """(id, fp, component_id) of each row of docs; the id column keeps its name, which is not one of the other two."""
    if id_col.lower() in ("fp", "component_id"):
        raise ValueError(f"the id column has a result column's name: {id_col}")
    rows = materialize(_fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    groups = group_fingerprints(rows, "id", "fp", max_bits, dense)
    return rows.join(groups.select("fp", "component_id"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    return add_fingerprint(docs.select(named(id_col).alias("id"), named(text_col).alias("text")), "text", "fp", shingle_words).select("id", "fp")


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 2, dense: int = 256
) -> DataFrame:
    """The rows of docs without near copies: of each component the row with the least id stays (see keep_least)."""
    rows = materialize(_fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    groups = group_fingerprints(rows, "id", "fp", max_bits, dense)
    return keep_least(docs, groups, lambda df, text, out: add_fingerprint(df, text, out, shingle_words), id_col, text_col)


def keep_least(docs: DataFrame, groups: DataFrame, add, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of groups (as group_linked gives them) the row of docs with the least id.

    Where several rows have that id (repeated rows), one of them stays, by the hash of
    its text. Fingerprints are computed again next to the texts, by add(docs, text column, column), which
    is cheaper than to keep a second copy of them. Rows without copies stay where they are if
    the table of groups is small enough for Spark to broadcast.
    """
    docs, now = plain_names(docs)
    id_col, text_col = now[id_col], now[text_col]
    marked = add(docs, text_col, "fp")
    groups = groups.where("size > 1").select("fp", "label", "component_id", "winners")
    many = materialize(groups, "copies")
    kept = marked.join(many, "fp", "left").where(F.col("label").isNull() | F.col(id_col).eqNullSafe(F.col("component_id")))
    if not many.where("winners > 1").limit(1).count():
        return old_names(kept, now)
    tied = F.coalesce(F.col("winners") > 1, F.lit(False))
    order = Window.partitionBy("label").orderBy(F.xxhash64(text_col), "fp")
    some = kept.where(tied).withColumn("rank", F.row_number().over(order)).where("rank = 1")
    return old_names(kept.where(~tied), now).union(old_names(some, now))
