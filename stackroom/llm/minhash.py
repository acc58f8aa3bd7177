"""Near-duplicate groups by the Jaccard similarity of word shingles: SimHash groups, then MinHash keys.

Two texts link if their sets of ``shingle_words``-word shingles have a Jaccard similarity
of ``similarity`` or more. SimHash groups come first: texts whose fingerprints over these shingles
are joined by links of ``max_bits`` or fewer bits (see ``simhash``) are each compared with one lead of
their group. Pairs that differ by more bits, as most at the edge of the similarity do, and those
that a lead leaves apart come from MinHash: ``bands`` keys of ``rows`` least hashes each; keys whose
texts SimHash has joined already are done. Texts are compared by their whole sets of 64-bit shingle
hashes, so a link is never a guess. A pair of similarity s shares no key with probability
``(1 - s**rows) ** bands``: 3 in a million at 0.8, less above.

Texts that are equal but for the case of A-Z and white space are one vertex, named by a
64-bit hash, so copies cost nothing. A text of whose shingles too few occur in any other
candidate can't link and is left out. Of the texts that share a key, too, each is first compared
with one lead, the text that has the least of its own. That joins a group of near copies in a
linear number of comparisons, and shows how each text differs from the lead. What those links
leave apart is compared pair by pair, but only pairs that can reach the similarity: an upper
bound on what two texts share follows from what each lacks of the lead, kept as a bitmap, and
from what it has besides. The bound is exact, so no link is lost, and no group is cut.

Cases: words as in ``simhash``; fewer words than a shingle: the whole sequence is one; null
and wordless texts are copies of each other; null ids and repeated rows as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.llm import wordblocks as wb
from stackroom.llm.components import connected_components
from stackroom.llm.simhash import BLOCK, fingerprint, group_linked, keep_least, link_fingerprints
from stackroom.shared import fresh, materialize, named, wide_rows

SEED, NAME_SEED = 42, 7


@dataclass(frozen=True)
class NearCopies:
    """What links texts, and how candidates are found. max_bits: of SimHash; block: shingles hashed at a time; words: 64-bit
    words of a bitmap of what a text lacks."""

    shingle_words: int = 5
    similarity: float = 0.8
    max_bits: int = 2
    bands: int = 32
    rows: int = 5
    block: int = 1024
    words: int = 8


def folded(data: bytes) -> list[bytes]:
    return data.lower().split()


def text_name(data: bytes) -> int:
    """A signed 64-bit hash of the text without case and white space: the name of its vertex."""
    from xxhash import xxh64_digest

    return int.from_bytes(xxh64_digest(b" ".join(folded(data)), NAME_SEED), "big", signed=True)


def shingle_hashes(data: bytes, shingle_words: int = 5):
    """The distinct 64-bit hashes of a text's shingles, ascending."""
    import numpy as np
    from xxhash import xxh64_digest

    words = folded(data)
    if not words:
        return np.zeros(0, np.uint64)
    k = min(shingle_words, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts, stops = np.concatenate(([0], ends[:-1] + 1)), ends[k - 1 :]
    del words
    some = []
    for lo in range(0, len(stops), BLOCK):
        pairs = zip(starts[lo : lo + BLOCK].tolist(), stops[lo : lo + BLOCK].tolist(), strict=False)
        some.append(np.frombuffer(b"".join([xxh64_digest(joined[a:b], SEED) for a, b in pairs]), "<u8"))
    return np.unique(np.concatenate(some))


def _constants(cfg: NearCopies) -> tuple:
    import numpy as np

    rng = np.random.default_rng(SEED)
    n = cfg.bands * cfg.rows
    masks, odd = (rng.integers(0, 1 << 64, n, np.uint64, endpoint=False) for _ in range(2))
    return masks, odd | np.uint64(1)


def band_keys(hashes, cfg: NearCopies, constants: tuple):
    """A signed key for each band; a band's number is part of its key."""
    import numpy as np

    masks, odd = constants
    least = np.full(len(masks), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), cfg.block):
        some = hashes[lo : lo + cfg.block, None] ^ masks
        some *= odd
        np.minimum(least, some.min(0), out=least)
    rows = least.reshape(cfg.bands, cfg.rows)
    key = np.arange(1, cfg.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(cfg.rows):
        key = (key ^ rows[:, j]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _by_text(docs: DataFrame, text_col: str, fields: list, make, keep: list[str] | None = None) -> DataFrame:
    """docs (or those columns of it) with the fields that make(text's bytes) gives; by row, without a shuffle."""
    wide_rows(docs.sparkSession)
    data = F.coalesce(named(text_col), F.lit("")).cast("binary").alias(fresh(docs.columns, "__data"))
    docs, data = docs.select(*[named(c) for c in (docs.columns if keep is None else keep)]), docs.select("*", data)
    source = data.select(*[named(c) for c in (*docs.columns, data.columns[-1])])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"long": pa.int64(), "longs": pa.list_(pa.int64()), "binary": pa.binary()}
        for batch in batches:
            made = list(zip(*map(make, batch.column(batch.num_columns - 1).to_pylist()), strict=True)) or [()] * len(fields)
            arrays = [*batch.columns[:-1], *[pa.array(x, kinds[kind]) for x, (_, kind) in zip(made, fields, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], *[name for name, _ in fields]])

    types = {"long": T.LongType(), "longs": T.ArrayType(T.LongType()), "binary": T.BinaryType()}
    return source.mapInArrow(run, T.StructType([*docs.schema, *[T.StructField(name, types[kind]) for name, kind in fields]]))


def add_name(docs: DataFrame, text_col: str = "text", out: str = "fp") -> DataFrame:
    return _by_text(docs, text_col, [(out, "long")], lambda data: (text_name(data),))


def _named_keys(docs: DataFrame, id_col: str, text_col: str, cfg: NearCopies) -> DataFrame:
    """The written table (id, fp, simhash, keys) of each row."""
    held: list = []

    def make(data: bytes) -> tuple:
        if not held:
            held.append(_constants(cfg))
        return text_name(data), fingerprint(data, cfg.shingle_words), band_keys(shingle_hashes(data, cfg.shingle_words), cfg, held[0])

    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    return materialize(_by_text(rows, "text", [("fp", "long"), ("simhash", "long"), ("keys", "longs")], make, ["id"]), "minhash")


def lacks(lead, text, words: int):
    """(shared shingles, bitmap of the lead's shingles that the text lacks) of two arrays of distinct hashes."""
    import numpy as np

    gone = np.setdiff1d(lead, text, assume_unique=True)
    bits = np.zeros(64 * words, np.uint8)
    bits[gone.view(np.uint64) % np.uint64(64 * words)] = 1
    return len(lead) - len(gone), np.packbits(bits, bitorder="little").view("<i8")


def _compare(pairs: DataFrame, bodies: DataFrame, cfg: NearCopies) -> DataFrame:
    """pairs (a, b) with both (the shingles that they share), near, and bits (what a lacks of b), written."""
    left, right = (bodies.select(F.col("fp").alias(c), F.col("body").alias(x)) for c, x in (("a", "x"), ("b", "y")))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x, y = ([c.as_py() for c in batch.column(i)] for i in (2, 3))
            both, near, bits = [], [], [np.zeros(0, np.int64)]
            for text, lead in zip(x, y, strict=True):
                text, lead = np.frombuffer(text, "<i8"), np.frombuffer(lead, "<i8")
                n, lost = lacks(lead, text, cfg.words)
                both.append(n)
                near.append(n >= cfg.similarity * (len(text) + len(lead) - n))
                bits.append(lost)
            offsets = pa.array(np.arange(len(both) + 1) * cfg.words, pa.int32())
            arrays = [batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(near, pa.bool_()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(bits), pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "both", "near", "bits"])

    return materialize(joined.mapInArrow(run, "a long, b long, both long, near boolean, bits array<long>"), "compared")


def _own(bodies: DataFrame) -> DataFrame:
    """(fp, own): how many of a text's shingles no other text has, where there are any.

    Shingles are dealt to buckets by their hash in packed arrays, each with its text's name: a row
    for every shingle would take several times the memory.
    """
    buckets = wb.bucket_count(bodies.sparkSession, bodies)

    def deal(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            some = [np.frombuffer(x, "<u8") for x in batch.column(1).to_pylist()]
            names = np.repeat(batch.column(0).to_numpy(), [len(x) for x in some])
            hashes = np.concatenate([np.zeros(0, "<u8"), *some])
            bucket = (hashes % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, names, hashes = bucket[order], names[order], hashes[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            lows, highs = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(bucket)]))
            rows = [(bucket[a], hashes[a:b].tobytes() + names[a:b].tobytes()) for a, b in zip(lows, highs, strict=True) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "payload"])

    def count(table):
        import numpy as np
        import pyarrow as pa

        both = [np.frombuffer(x, "<i8") for x in table.column("payload").to_pylist()]
        hashes, names = (np.concatenate([x[: len(x) // 2] if first else x[len(x) // 2 :] for x in both]) for first in (True, False))
        order = np.argsort(hashes, kind="stable")
        other = hashes[order][1:] != hashes[order][:-1]
        alone = np.concatenate(([True], other)) & np.concatenate((other, [True]))
        fps, n = np.unique(names[order[alone]], return_counts=True)
        return pa.table({"fp": pa.array(fps, pa.int64()), "own": pa.array(n, pa.int64())})

    packets = bodies.select("fp", "body").mapInArrow(deal, "bucket int, payload binary")
    return packets.groupBy("bucket").applyInArrow(count, "fp long, own long").groupBy("fp").agg(F.sum("own").alias("own"))


def _with_leads(members: DataFrame, bodies: DataFrame, cfg: NearCopies) -> tuple[DataFrame, DataFrame]:
    """members (key, fp, size, common) of keys that several texts share, with each key's lead, and what comparing texts with their leads gives."""
    order = F.struct(((F.col("size") - F.col("common")) / F.greatest("size", F.lit(1))).alias("share"), "fp", "size")
    lead = materialize(members.groupBy("key").agg(F.min(order).alias("h"), F.count(F.lit(1)).alias("n")).where("n > 1"), "leads")
    placed = materialize(members.join(lead.select("key", F.col("h.fp").alias("lead"), F.col("h.size").alias("lead_size")), "key"), "placed")
    pairs = materialize(placed.where("fp <> lead").select(F.col("fp").alias("a"), F.col("lead").alias("b")).distinct(), "pairs")
    return placed, _compare(pairs, bodies, cfg)


def link_texts(docs: DataFrame, rows: DataFrame, text_col: str, cfg: NearCopies) -> DataFrame:
    """Edges (a, b) that join all texts that link into their components; rows has the fp, simhash and keys of docs."""
    nodes = materialize(rows.groupBy("fp").agg(F.first("simhash").alias("simhash"), F.first("keys").alias("keys")), "texts")
    groups = materialize(connected_components(link_fingerprints(nodes, "simhash", cfg.max_bits)), "labels").withColumnRenamed("node", "simhash")
    placed = nodes.select("fp", "simhash").join(groups, "simhash", "left").select("fp", F.coalesce("label", "simhash").alias("key"))
    shared = materialize(placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "keys")
    alike = materialize(placed.join(shared, "key").select("key", "fp"), "alike")
    every = nodes.select("fp", F.explode("keys").alias("key"))
    many = materialize(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "keys")
    members = materialize(every.join(many, "key").select("key", "fp"), "members")
    candidates = members.select("fp").union(alike.select("fp"))
    if not candidates.limit(1).count():
        return candidates.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    wanted = materialize(candidates.distinct(), "wanted")
    texts = add_name(docs.select(named(text_col).alias("text")), "text", "fp").join(wanted, "fp", "left_semi")
    texts = texts.groupBy("fp").agg(F.first("text").alias("text"))

    def body(data: bytes) -> tuple:
        hashes = shingle_hashes(data, cfg.shingle_words)
        return hashes.tobytes(), len(hashes)

    bodies = materialize(_by_text(texts, "text", [("body", "binary"), ("size", "long")], body, ["fp"]), "bodies")
    # of a text's shingles those that some other text has
    facts = bodies.select("fp", "size").join(_own(bodies), "fp", "left").select("fp", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("common"))
    facts = materialize(facts.where(F.col("common") >= F.lit(cfg.similarity) * F.col("size") - 1e-6), "facts")
    bodies = bodies.drop("size")

    _, first = _with_leads(materialize(alike.join(facts, "fp"), "alike"), bodies, cfg)
    joined = first.where("near").select("a", "b")

    # a text has one SimHash group, so these links are stars; keys whose texts they join are done
    stars = joined.select(F.col("a").alias("fp"), F.col("b").alias("star"))
    known = materialize(members.join(facts, "fp").join(stars, "fp", "left").withColumn("star", F.coalesce("star", "fp")), "members")
    open_keys = known.groupBy("key").agg(F.min("star").alias("x"), F.max("star").alias("y")).where("x <> y").select("key")
    placed, first = _with_leads(known.drop("star").join(materialize(open_keys, "keys"), "key"), bodies, cfg)
    edges = joined.union(first.where("near").select("a", "b"))

    labels = materialize(connected_components(edges), "labels").withColumnRenamed("node", "fp")
    seen = first.select(F.col("a").alias("fp"), F.col("b").alias("lead"), "both", "bits")
    labelled = placed.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    counts = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    # so are keys whose texts are one component now
    apart = counts.groupBy("key").agg(F.max(F.struct("n", "label")).alias("m"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    left = labelled.join(materialize(apart.select("key", F.col("m.label").alias("main")), "apart"), "key").join(seen, ["fp", "lead"], "left")
    nothing = F.array(*[F.lit(0).cast("long")] * cfg.words)
    left = left.withColumns({"besides": F.greatest(F.col("common") - F.coalesce("both", "size"), F.lit(0)), "bits": F.coalesce("bits", nothing)})
    left = materialize(left.select("key", "fp", "size", "common", "lead_size", "besides", "bits", "label", "main"), "apart")
    x, y = left.where("label <> main").alias("x"), left.alias("y")
    need = (F.col("x.size") + F.col("y.size")) * (cfg.similarity / (1 + cfg.similarity)) - 1e-6
    lost = sum((F.bit_count(F.get("x.bits", F.lit(i)).bitwiseOR(F.get("y.bits", F.lit(i)))) for i in range(cfg.words)), F.lit(0))
    most = F.col("x.lead_size") - lost + F.least("x.besides", "y.besides")
    once = (F.col("y.label") == F.col("y.main")) | (F.col("x.fp") < F.col("y.fp"))
    can = (F.least("x.common", "y.common") >= need) & (most >= need)
    found = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & once & can)
    rest = materialize(found.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct(), "pairs")
    return edges.union(_compare(rest, bodies, cfg).where("near").select("a", "b"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: NearCopies | None = None) -> DataFrame:
    """(id, fp, component_id) of each row of docs; the id column keeps its name."""
    if id_col.lower() in ("fp", "component_id"):
        raise ValueError(f"the id column has a result column's name: {id_col}")
    cfg = cfg or NearCopies()
    rows = _named_keys(docs, id_col, text_col, cfg)
    groups = group_linked(rows, link_texts(docs, rows, text_col, cfg), "id", "fp")
    return rows.select("id", "fp").join(groups.select("fp", "component_id"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: NearCopies | None = None) -> DataFrame:
    """The rows of docs without near copies: of each component the row with the least id stays (see ``simhash.keep_least``)."""
    cfg = cfg or NearCopies()
    rows = _named_keys(docs, id_col, text_col, cfg)
    groups = group_linked(rows, link_texts(docs, rows, text_col, cfg), "id", "fp")
    return keep_least(docs, groups, add_name, id_col, text_col)
