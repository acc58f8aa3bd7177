"""LM scoring: a causal self-attention model in numpy, on subword ids.

The model. Words (runs of anything but blank and U+0009-000D, A-Z lower-cased) are cut
into subword ids of a public vocabulary; a document ends with an end id. The
probability of an id is that of its class given the ids before it, times its share of
the class. Classes and shares come from the subword counts of the whole training part:
the most frequent ids are classes of their own, the rest are put into classes of about
equal mass. One layer of causal self-attention over a window of ids gives the
distribution of the next class. Windows overlap: each scores its last ``stride`` ids
once and has at least ``window - stride`` ids before them as context.

The data. A document trains if ``crc32(id as text) mod 10`` is not 0. Blocks of documents
keep word numbers; their distinct words, with counts, meet in buckets (see
``wordblocks``), where each distinct word is counted over the whole corpus and cut into
subwords once; counts and subwords go back to the blocks, whose ids are written. Weights
are trained in one pass over windows that cover every id of every training document, its
end too; no window holds ids of two documents. Each round takes every ``rounds``-th
document of a block; blocks train from the same start, and weights are averaged between
rounds, so that the fit doesn't depend on how blocks are dealt to tasks (but for the
rounding of sums). Then documents are scored.

Besides the model's score each document gets a unigram base score over words:
``sum(log10((c + 0.1) / (N + 0.1 * (V + 1))))``.

Cases: null text is empty and has the end alone; a null id counts as the text '' (which
is held out); repeated rows are scored and counted as often as they come; without
training documents the counts are 0 and classes are equally likely; other columns are
ignored.
"""

from __future__ import annotations

import itertools
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from stackroom.llm import wordblocks as wb
from stackroom.llm.bpe import _encoder
from stackroom.shared import materialize, scratch, wide_rows

#: The end of a document as a word: no word is empty.
END_WORD = b""
SMOOTH = 0.1


@dataclass(frozen=True)
class LmConfig:
    """Sizes of the model and of its training. own: ids with an embedding of their own."""

    dims: int = 16
    window: int = 24
    stride: int = 18
    classes: int = 64
    single: int = 32
    own: int = 512
    batch: int = 96
    train_batch: int = 128
    rounds: int = 4
    step: float = 0.02
    seed: int = 11


@dataclass(frozen=True)
class Vocabulary:
    """What the subword counts give: an id's class, its log share of it, and its embedding's row."""

    cls: object
    share: object
    row: object
    prior: object
    end: int


def build_vocabulary(counts, end: int, cfg: LmConfig) -> Vocabulary:
    """counts: how often each id, the end id too, occurs in the training part."""
    import numpy as np

    n = len(counts)
    order = np.lexsort((np.arange(n), -counts))
    weight = counts.astype(np.float64) + SMOOTH
    cls = np.empty(n, np.int64)
    cls[order[: cfg.single]] = np.arange(cfg.single)
    rest = order[cfg.single :]
    mass = np.cumsum(weight[rest])
    more = cfg.classes - cfg.single
    cls[rest] = cfg.single + np.minimum(more - 1, (mass - weight[rest] / 2) / mass[-1] * more).astype(np.int64)
    total = np.bincount(cls, weight, cfg.classes)
    row = np.empty(n, np.int64)
    row[order] = np.arange(n)
    row = np.where(row < cfg.own, row, cfg.own + cls)
    with np.errstate(divide="ignore"):
        prior = np.log(total / total.sum())
    prior = np.maximum(prior, -30.0)
    return Vocabulary(cls, (np.log(weight) - np.log(total[cls])).astype(np.float32), row.astype(np.int32), prior.astype(np.float32), end)


def shapes(cfg: LmConfig) -> dict[str, tuple[int, ...]]:
    d = cfg.dims
    return {
        "e": (cfg.own + cfg.classes, d), "p": (cfg.window, d), "q": (d, d), "k": (d, d), "v": (d, d), "o": (d, d), "u": (d, cfg.classes), "c": (cfg.classes,),
    }


def initial(prior, cfg: LmConfig):
    """The weights before training, as one vector."""
    import numpy as np

    rng = np.random.default_rng(cfg.seed)
    parts = []
    for name, shape in shapes(cfg).items():
        if name == "c":
            parts.append(prior)
        else:
            scale = 0.1 if name in "epu" else cfg.dims**-0.5
            parts.append(rng.normal(0.0, scale, shape).astype(np.float32).reshape(-1))
    return np.concatenate(parts).astype(np.float32)


def unflatten(vector, cfg: LmConfig) -> dict:
    out, at = {}, 0
    for name, shape in shapes(cfg).items():
        size = 1
        for x in shape:
            size *= x
        out[name] = vector[at : at + size].reshape(shape)
        at += size
    return out


def causal_mask(window: int, scored: int):
    """1 where a scored position (the last ones of the window) may look, else 0."""
    import numpy as np

    return (np.arange(window)[None, :] <= np.arange(window - scored, window)[:, None]).astype(np.float32)


def _exp(make, most: float, ones, mask=None):
    """(e to the power of make(), times mask; its products with ones): powers are clipped at most, either way, only if some could matter."""
    import numpy as np

    for clip in (False, True):
        x = make()
        if clip:
            np.clip(x, -most, most, out=x)
        with np.errstate(over="ignore", invalid="ignore"):
            np.exp(x, out=x)
            if mask is not None:
                x *= mask
            total = x.reshape(-1, x.shape[-1]) @ ones
        # not a number is not within the bounds either
        if clip or (total.max(initial=1.0) < np.exp(most) and total.min(initial=1.0) > np.exp(-most / 2)):
            return x, total


def paired(w: dict, cfg: LmConfig):
    """Queries times keys (scaled) and values times outputs, side by side: with one head as wide as the embedding, an
    input meets inputs through the first and adds to outputs through the second, so that four products become two."""
    import numpy as np

    return np.concatenate(((w["q"] * np.float32(cfg.dims**-0.5)) @ w["k"].T, w["v"] @ w["o"]), 1)


def score_tables(w: dict, cfg: LmConfig):
    """Embeddings of ids and of places, and what `paired` makes of them: a sum of two rows has all that attention reads."""
    import numpy as np

    both = paired(w, cfg)
    return tuple(np.concatenate((w[name], w[name] @ both), 1) for name in "ep")


def class_log_probs(w: dict, rows, targets, cfg: LmConfig, mask, tables=None):
    """Log probability of each target class: rows are (windows, window) embedding rows,
    targets (windows, scored) classes that follow the last `scored` of them; tables are the score_tables of w."""
    import numpy as np

    n, scored = targets.shape
    d = cfg.dims
    ids, places = tables or score_tables(w, cfg)
    wide = ids.take(rows, 0)
    wide += places
    x, v = wide[..., :d], wide[..., 2 * d :]
    last, q = wide[:, cfg.window - scored :, :d], wide[:, cfg.window - scored :, d : 2 * d]
    s, total = _exp(lambda: q @ x.transpose(0, 2, 1), 60.0, np.ones(cfg.window, wide.dtype), mask)
    h = s @ v
    h /= total.reshape(n, scored, 1)
    h += last
    h = h.reshape(-1, d)
    t = targets.reshape(-1)
    hit = np.zeros(0, wide.dtype)

    def powers():
        nonlocal hit
        z = h @ w["u"]
        hit = z.reshape(-1).take(np.arange(0, z.size, cfg.classes) + t)
        return z

    # the constants are factors of what is summed
    _, total = _exp(powers, 80.0, np.exp(w["c"]))
    return (np.minimum(hit, 80.0) + w["c"].take(t) - np.log(total)).reshape(n, scored)


def _over_rows(x, y, parts: int):
    """x.T @ y for many more rows than columns, by equal parts of the rows; y has more columns, and comes first in the product."""
    import numpy as np

    x, y = x.reshape(parts, -1, x.shape[1]), y.reshape(parts, -1, y.shape[1])
    return np.matmul(y.transpose(0, 2, 1), x).sum(0).T


def gradient(w: dict, rows, targets, cfg: LmConfig, mask, real=None):
    """(mean loss, gradient vector) over windows; real: 1 where a position is scored, all if left out."""
    import numpy as np

    n, size = targets.shape
    d = cfg.dims
    which, t = rows.reshape(-1), targets.reshape(-1)
    x = w["e"].take(which, 0).reshape(n, size, d)
    x += w["p"]
    flat = x.reshape(-1, d)
    kind = flat.dtype
    both = paired(w, cfg)
    wide = (flat @ both).reshape(n, size, 2 * d)
    q, v = wide[..., :d], wide[..., d:]
    # sums over a row are products with ones, and what is not needed again is written over
    a, sums = _exp(lambda: q @ x.transpose(0, 2, 1), 60.0, np.ones(size, kind), mask)
    a /= sums.reshape(n, size, 1)
    o = (a @ v).reshape(-1, d)
    h = o + flat
    # the constants are factors of columns, and shares over sums those of rows: both are applied where arrays are small
    factor = np.exp(w["c"])
    p, total = _exp(lambda: h @ w["u"], 80.0, factor)
    share = np.full(len(t), 1 / len(t), kind) if real is None else real.reshape(-1) * kind.type(1 / max(1, np.count_nonzero(real)))
    at, mine = np.arange(0, p.size, cfg.classes) + t, factor.take(t)
    hit = p.reshape(-1).take(at)
    loss = -float(np.log(hit * mine / total + 1e-30) @ share)
    p.reshape(-1)[at] = hit - total / mine
    share = share / total
    g = {"c": (share @ p) * factor}
    h *= share[:, None]
    g["u"] = _over_rows(h, p, 1) * factor
    dh = p @ (w["u"] * factor).T
    dh *= share[:, None]
    ds = dh.reshape(n, size, d) @ v.transpose(0, 2, 1)
    o *= dh
    ds -= (o @ np.ones(d, kind)).reshape(n, size, 1)
    ds *= a
    back = np.empty((n, size, 2 * d), kind)
    np.matmul(ds, x, out=back[..., :d])
    np.matmul(a.transpose(0, 2, 1), dh.reshape(n, size, d), out=back[..., d:])
    back = back.reshape(-1, 2 * d)
    # what the pairs' gradients say of the weights that make them
    meet = _over_rows(flat, back, 1)
    meet, add = meet[:, :d] * np.float32(d**-0.5), meet[:, d:]
    g["q"], g["k"], g["v"], g["o"] = meet @ w["k"], meet.T @ w["q"], add @ w["o"].T, w["v"].T @ add
    dx = dh
    dx += back @ both.T
    dx += (ds.transpose(0, 2, 1) @ q).reshape(-1, d)
    g["p"] = dx.reshape(n, size, d).sum(0)
    # rows of one id are brought together and summed
    order = np.argsort(which.astype(np.uint16) if len(w["e"]) <= 1 << 16 else which, kind="stable")
    many = np.bincount(which, minlength=len(w["e"]))
    some = np.flatnonzero(many)
    g["e"] = np.zeros((len(w["e"]), d), kind)
    g["e"][some] = np.add.reduceat(dx.take(order, 0), (np.cumsum(many) - many)[some])
    return loss, np.concatenate([g[name].reshape(-1) for name in shapes(cfg)]).astype(np.float32)


def lay_out(vocabulary: Vocabulary, flat, sizes, lead: int, room):
    """(rows, ids, slots, starts): documents' ids in slots, room of them for each, of which the first lead stay empty.

    rows has the embedding row of what stands before a slot (before and in empty ones: the end id's),
    ids what is in it, slots where each of flat is, starts each document's first slot.
    """
    import numpy as np

    starts = np.cumsum(room) - room
    slots = np.arange(len(flat)) + np.repeat(starts + lead - (np.cumsum(sizes) - sizes), sizes)
    total = int(room.sum())
    rows = np.full(total + 1, vocabulary.row[vocabulary.end], np.int32)
    # a document's last id is the end id, so that what follows is as it is before any document
    rows[slots + 1] = vocabulary.row.take(flat)
    ids = np.full(total, vocabulary.end, np.int32)
    ids[slots] = flat
    return rows[:-1], ids, slots, starts


def training_windows(vocabulary: Vocabulary, flat, sizes, cfg: LmConfig):
    """(rows, targets, real) of windows: flat holds documents' ids, each with its end id.

    Each id is a target once. As in scoring, end ids stand before a document.
    """
    import numpy as np

    lead = cfg.window - cfg.stride
    rows, ids, slots, _ = lay_out(vocabulary, flat, sizes, lead, -(-(sizes + lead) // cfg.window) * cfg.window)
    real = np.zeros(len(ids), bool)
    real[slots] = True
    return tuple(x.reshape(-1, cfg.window) for x in (rows, vocabulary.cls.take(ids), real))


def train(vector, parts, cfg: LmConfig):
    """(weights, windows): one pass of Adam over parts of windows (rows, targets, real)."""
    import numpy as np

    vector, step, count = vector.copy(), 0, 0
    mask = causal_mask(cfg.window, cfg.window)
    m, v2 = np.zeros_like(vector), np.zeros_like(vector)
    for rows, targets, real in parts:
        count += len(rows)
        for lo in range(0, len(rows), cfg.train_batch):
            some, step = slice(lo, lo + cfg.train_batch), step + 1
            _, g = gradient(unflatten(vector, cfg), rows[some], targets[some], cfg, mask, real[some])
            m *= 0.9
            m += 0.1 * g
            v2 *= 0.99
            g *= g
            g *= 0.01
            v2 += g
            rate = cfg.step * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
            np.sqrt(v2, out=g)
            g += 1e-6
            np.divide(m, g, out=g)
            g *= rate
            vector -= g
    return vector, count


def score_documents(w: dict, vocabulary: Vocabulary, flat, sizes, cfg: LmConfig):
    """Natural log probability of each document: flat holds all documents' ids, each with its end id."""
    import numpy as np

    lead, per_doc = cfg.window - cfg.stride, -(-sizes // cfg.stride)
    rows, ids, slots, starts = lay_out(vocabulary, flat, sizes, lead, lead + per_doc * cfg.stride)
    if not len(flat):
        return np.zeros(len(sizes))
    real = np.zeros(len(ids), np.float32)
    real[slots] = 1.0
    # what ids add besides their classes; no document is without its end
    out = np.add.reduceat(vocabulary.share.take(flat), np.cumsum(sizes) - sizes, dtype=np.float64)
    mask, tables = causal_mask(cfg.window, cfg.stride), score_tables(w, cfg)
    doc_of = np.repeat(np.arange(len(sizes)), per_doc)
    first = starts[doc_of] + (np.arange(len(doc_of)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)) * cfg.stride
    rows = np.lib.stride_tricks.sliding_window_view(rows, cfg.window)
    classes, real = (np.lib.stride_tricks.sliding_window_view(x[lead:], cfg.stride) for x in (vocabulary.cls.take(ids), real))
    for lo in range(0, len(doc_of), cfg.batch):
        docs, some = doc_of[lo : lo + cfg.batch], first[lo : lo + cfg.batch]
        got = class_log_probs(w, rows[some], classes[some], cfg, mask, tables)
        got *= real[some]
        part = np.bincount(docs - docs[0], got.sum(1, dtype=np.float64))
        out[docs[0] : docs[0] + len(part)] += part
    return out


def train_part(id_column):
    """Whether a document trains: crc32 of its id as text, mod 10, is not 0."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % 10 != 0


def _first_pass(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, T.DataType]:
    """The written table of blocks ('D'), and packets of words with counts ('W')."""
    spark = docs.sparkSession
    wide_rows(spark)
    buckets = wb.bucket_count(spark, docs)
    source = docs.select(
        F.col(id_col).alias("id"), train_part(F.col(id_col)).alias("trains"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data")
    )
    id_type = source.schema["id"].dataType
    arrow_id = to_arrow_type(id_type)
    schema = T.StructType(
        [
            T.StructField("block", T.StringType()),
            T.StructField("bucket", T.IntegerType()),
            T.StructField("payload", T.BinaryType()),
            T.StructField("docs", T.ArrayType(id_type)),
            T.StructField("trains", T.ArrayType(T.BooleanType())),
            T.StructField("kind", T.StringType()),
        ]
    )

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def columns():
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    ids, trains, data = batch.slice(lo, 512).columns
                    docs = list(zip(ids.to_pylist(), trains.to_pylist(), strict=True))
                    yield docs, *wb.split_column(data, END_WORD), np.asarray(pc.binary_length(data)).astype(np.int64)

        def batch_of(kind, block, cells, docs=None, trains=None):
            n = len(cells)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * n, pa.string()),
                    pa.array([c[0] for c in cells], pa.int32()),
                    pa.array([c[1] for c in cells], pa.binary()),
                    pa.array([docs] * n, pa.list_(arrow_id)),
                    pa.array([trains] * n, pa.list_(pa.bool_())),
                    pa.array([kind] * n, pa.string()),
                ],
                names=schema.names,
            )

        for block in wb.column_blocks(columns(), buckets):
            held = block.block
            trains = np.array([d[1] for d in held.docs], bool)
            numbers = np.frombuffer(held.numbers, np.uint32)
            counts = np.bincount(numbers[np.repeat(trains, held.sizes)], minlength=len(block.words))
            counts, cells = counts[block.order], []
            for bucket, words, some in block.word_packets():
                cells.append((bucket, len(words).to_bytes(4, "little") + words + wb.pack_numbers(counts[some])))
            yield batch_of("W", block.name, cells)
            yield batch_of("D", block.name, [(-1, block.payload())], [d[0] for d in held.docs], trains.tolist())

    path = scratch(spark, "lm-blocks")
    source.mapInArrow(run, schema).write.partitionBy("kind").parquet(path)
    return spark.read.schema(schema).parquet(path), id_type


def _pack(parts) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unpack(data: bytes) -> list[bytes]:
    at, out = 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _pack_ids(subwords, flat) -> bytes:
    return _pack([wb.pack_numbers(subwords), wb.pack_numbers(flat)])


def _read_ids(payload: bytes):
    """(subwords, ids) of a part of a block: documents' numbers of subwords and their ids one after the other."""
    import numpy as np

    subwords, flat = map(wb.unpack_numbers, _unpack(payload))
    return subwords.astype(np.int64), flat.astype(np.int32)


def _subwords(ranks, pattern):
    one = _encoder(ranks, pattern).encode_ordinary
    return lambda word: one(" " + word.decode())


def _count_words(blocks: DataFrame, vocabulary, pattern: str, end: int) -> DataFrame:
    """Packets with each word's count in the whole training part and its subwords; packet -3 has sums of a bucket."""
    packet = "block string, bucket int, payload binary"

    def run(table):
        import numpy as np
        import pyarrow as pa

        number: defaultdict = defaultdict(itertools.count().__next__)
        packets, seen = [], []
        for block, payload in zip(table.column(0).to_pylist(), table.column(2).to_pylist(), strict=True):
            n = int.from_bytes(payload[:4], "little")
            words = wb.unpack_words(payload[4 : 4 + n])
            packets.append((block, np.fromiter(map(number.__getitem__, words), np.int64, len(words))))
            seen.append(wb.unpack_numbers(payload[4 + n :]))
        # counts can pass 32 bits in a large corpus: whole numbers here, two halves in packets
        total = np.zeros(len(number), np.int64)
        for (_, mine), counts in zip(packets, seen, strict=True):
            total[mine] += counts
        cut = _subwords(vocabulary.value, pattern)
        lengths, ids = np.empty(len(number), np.int64), array("I")
        for i, word in enumerate(number):
            some = [end] if word == END_WORD else cut(word)
            lengths[i] = len(some)
            ids.extend(some)
        flat = np.frombuffer(ids, np.uint32)
        bucket = table.column(1)[0].as_py()
        out = []
        for block, mine in packets:
            counts, (some, sizes) = total[mine], wb.gather_lists(lengths, flat, mine)
            out.append((block, bucket, _pack(map(wb.pack_numbers, (counts & 0xFFFFFFFF, counts >> 32, sizes, some)))))
        used = np.bincount(flat, np.repeat(total, lengths).astype(np.float64)) if len(flat) else np.zeros(0)
        there = np.flatnonzero(used)
        pairs = np.stack([there, used[there].astype(np.int64)], 1)
        sums = np.concatenate((np.array([[-1, total.sum()], [-2, np.count_nonzero(total)]]), pairs)).astype(np.int64)
        out.append(("", -3, sums.tobytes()))
        return pa.table({"block": [r[0] for r in out], "bucket": pa.array([r[1] for r in out], pa.int32()), "payload": [r[2] for r in out]})

    words = blocks.where("kind = 'W'").select("block", "bucket", "payload")
    return materialize(words.groupBy("bucket").applyInArrow(run, packet), "lm-words")


def _sums(words: DataFrame) -> dict[int, int]:
    """Sums over all buckets: -1: training tokens, -2: distinct ones, and each subword id's count. Bounded by the vocabulary."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for payload in batch.column(0).to_pylist():
                pairs = np.frombuffer(payload, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["id", "n"])

    rows = words.where("bucket = -3").select("payload").mapInArrow(run, "id long, n long")
    return {r["id"]: r["n"] for r in rows.groupBy("id").agg(F.sum("n").alias("n")).collect()}


def fit_lm(held: DataFrame, vocabulary: Vocabulary, cfg: LmConfig):
    """The model's weights after the rounds of training; held has blocks' columns trains and ids0, ids1 and so on.

    A round trains on one of the latter: of a block's documents those whose number has its remainder.
    """
    import numpy as np

    spark = held.sparkSession
    vector = initial(vocabulary.prior, cfg)
    shared = spark.sparkContext.broadcast(vocabulary)
    for turn in range(cfg.rounds):
        now = spark.sparkContext.broadcast(vector)

        def run(batches: Iterator, now=now, turn=turn) -> Iterator:
            import pyarrow as pa

            total, count = np.zeros(len(now.value)), 0
            for batch in batches:
                for trains, payload in zip(batch.column(0), batch.column(1), strict=True):
                    trains = np.array(trains.as_py(), bool)[turn :: cfg.rounds]
                    if trains.any():
                        subwords, flat = _read_ids(payload.as_py())
                        some = training_windows(shared.value, flat[np.repeat(trains, subwords)], subwords[trains], cfg)
                        after, windows = train(now.value, [some], cfg)
                        total += after.astype(np.float64) * windows
                        count += windows
            if count:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), count))], names=["i", "x", "n"])

        # weights are averaged where they are: the driver gets one number for each of them
        mean = held.select("trains", f"ids{turn}").mapInArrow(run, "i long, x double, n long").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).collect()
        if mean:
            vector = vector.copy()
            vector[[r["i"] for r in mean]] = [r["x"] for r in mean]
    return vector


def score_texts(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", cfg: LmConfig | None = None
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords) of each row."""
    import math

    import numpy as np

    cfg = cfg or LmConfig()
    spark = docs.sparkSession
    vocabulary_ranks = spark.sparkContext.broadcast(ranks)
    end = max(ranks.values()) + 1
    blocks, id_type = _first_pass(docs, id_col, text_col)
    words = _count_words(blocks, vocabulary_ranks, pattern, end)
    sums = _sums(words)
    tokens, kinds = sums.pop(-1, 0), sums.pop(-2, 0)
    counts = np.zeros(end + 1, np.int64)
    counts[list(sums)] = list(sums.values())
    vocabulary = build_vocabulary(counts, end, cfg)
    floor = math.log10(tokens + SMOOTH * (kinds + 1))
    arrow_id = to_arrow_type(id_type)
    out = T.StructType(
        [
            T.StructField(id_col, id_type),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()),
            T.StructField("train_tokens", T.LongType()),
            T.StructField("base_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("n_subwords", T.LongType()),
        ]
    )

    def run(table):
        import pyarrow as pa

        rows = sorted(zip(table.column("bucket").to_pylist(), table.column("payload").to_pylist(), strict=True), key=lambda r: r[0])
        if not rows or rows[0][0] != -1:
            raise ValueError("packets without their block")
        sizes, numbers, dealt = wb.read_payload(rows[0][1])
        got: list[list] = [[np.zeros(0, "<u4")] for _ in range(4)]
        for _, payload in rows[1:]:
            for part, data in zip(got, _unpack(payload), strict=True):
                part.append(wb.unpack_numbers(data))
        low, high, lengths, flat = (np.concatenate(x) for x in got)
        if len(low) != len(dealt):
            raise ValueError("a block's words and their packets differ")
        place = np.empty(len(dealt), np.int64)
        place[wb.packet_order(dealt)] = np.arange(len(dealt))
        count = low.astype(np.int64) + (high.astype(np.int64) << 32)
        logs, known = np.log10(count + SMOOTH), (count > 0).astype(np.int64)
        sizes = sizes.astype(np.int64)
        ends = np.cumsum(sizes)
        base, n_known, subwords = (np.zeros(len(sizes), k) for k in (float, np.int64, np.int64))
        lo, at, held = 0, 0, [np.zeros(0, "<u4")]
        while lo < len(sizes):  # about 200,000 words at a time
            hi = max(lo + 1, int(np.searchsorted(ends, at + 200_000, "right")))
            where = place[numbers[at : ends[hi - 1]]]
            cuts = ends[lo:hi] - sizes[lo:hi] - at  # no document is without its end
            base[lo:hi] = np.add.reduceat(logs[where], cuts)
            n_known[lo:hi] = np.add.reduceat(known[where], cuts)
            ids, some = wb.gather_lists(lengths, flat, where)
            subwords[lo:hi] = np.add.reduceat(some, cuts)
            held.append(ids)
            lo, at = hi, int(ends[hi - 1])
        docs_of = next(x for x in table.column("docs").to_pylist() if x is not None)
        trains = next(x for x in table.column("trains").to_pylist() if x is not None)
        facts = _pack([wb.pack_numbers(sizes), wb.pack_numbers(n_known), base.astype("<f8").tobytes()])
        whole, turn_of = np.concatenate(held), np.arange(len(sizes)) % cfg.rounds
        turn_of_id = np.repeat(turn_of, subwords)
        ids = [_pack_ids(subwords[turn_of == r], whole[turn_of_id == r]) for r in range(cfg.rounds)]
        cells = [pa.array([x], pa.binary()) for x in (facts, *ids)]
        return pa.table([pa.array([docs_of], pa.list_(arrow_id)), pa.array([trains], pa.list_(pa.bool_())), *cells], names=packed.names)

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        weights, vocabulary = unflatten(model.value[0], cfg), model.value[1]
        for batch in batches:
            for docs_of, trains, facts, *ids in zip(*batch.columns, strict=True):
                sizes, n_known, base = _unpack(facts.as_py())
                sizes, n_known, base = wb.unpack_numbers(sizes).astype(np.int64), wb.unpack_numbers(n_known).astype(np.int64), np.frombuffer(base, "<f8")
                scores, subwords = np.zeros(len(sizes)), np.zeros(len(sizes), np.int64)
                for r, payload in enumerate(ids):
                    lengths, flat = _read_ids(payload.as_py())
                    subwords[r :: cfg.rounds] = lengths
                    scores[r :: cfg.rounds] = score_documents(weights, vocabulary, flat, lengths, cfg)
                yield pa.RecordBatch.from_arrays(
                    [
                        docs_of.values.cast(arrow_id),
                        pa.array([not x for x in trains.as_py()]),
                        pa.array(sizes),
                        pa.array(n_known),
                        pa.array(np.full(len(sizes), tokens)),
                        pa.array(base - sizes * floor),
                        pa.array(scores / math.log(10.0)),
                        pa.array(subwords),
                    ],
                    names=out.names,
                )

    cells = [T.StructField(name, T.BinaryType()) for name in ("facts", *[f"ids{r}" for r in range(cfg.rounds)])]
    packed = T.StructType([T.StructField("docs", T.ArrayType(id_type)), T.StructField("trains", T.ArrayType(T.BooleanType())), *cells])
    back = words.where("bucket >= 0").withColumns({"docs": F.lit(None).cast(T.ArrayType(id_type)), "trains": F.lit(None).cast("array<boolean>")})
    whole = blocks.where("kind = 'D'").drop("kind").union(back)
    held = materialize(whole.groupBy("block").applyInArrow(run, packed), "lm-ids")
    vector = fit_lm(held, vocabulary, cfg)
    model = spark.sparkContext.broadcast((vector, vocabulary))
    return held.mapInArrow(score, out)
