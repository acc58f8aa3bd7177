"""Quality rules judged by an isolation forest.

``rule_statistics`` counts what heuristic quality rules look at; an isolation forest
over how far a document is beyond each rule's limit gives it an anomaly score from the
mean length of its paths through random splits, and a threshold calibrated on labelled
rows turns scores into verdicts. Documents that fail the base rules (fewer than 50 words, or more
than half of the words in repeated 3-word windows) are rejected without the forest.

What is fitted: ``trees`` trees of ``sample`` rows each, drawn from the labelled rows
with the smallest hashes (at most ``max_train`` of them; a documented bound). The
threshold comes from a histogram of the scores of *all* labelled rows: the lowest one
at which at most ``lost`` of the rows labelled good are rejected (or two of few rows). Without labels the
forest is grown on documents of all kinds, with the threshold ``default_threshold``.

Cases: null text has no words; a document without words has ratios of 0 and fails the
base rules; repeated and null ids are judged by row, as the verdict depends on the text
alone; other columns are ignored, or kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.shared import materialize, old_names, plain_names, wide_rows

#: The characters that count as symbols, and the base rules' limits.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines")
FEATURES = ("symbols", "dup_lines", "repeats", "upper", "marks", "word_length")
#: Usual limits of heuristic rules: symbols and marks by word, repeated lines and words, capitals by
#: character, and characters by word.
LIMITS = {"symbols": 0.1, "dup_lines": 0.3, "repeats": 0.3, "upper": 0.3, "marks": 0.1, "long_words": 10.0, "short_words": 3.0}
#: Bins of the histogram of scores.
BINS = 1000
_SPACES = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_MARKS = b"!?"


def count_text(data: bytes) -> tuple[int, ...]:
    """COUNTS of a text in UTF-8."""
    import numpy as np

    words = data.split()
    n = len(words)
    spaces = len(data) - len(data.translate(None, _SPACES))
    chars = len(data.decode()) - spaces
    symbols = len(data) - len(data.translate(None, SYMBOLS.encode()))
    upper = len(data) - len(data.translate(None, _UPPER))
    marks = len(data) - len(data.translate(None, _MARKS))
    lines = [line for line in data.split(b"\n") if line.strip(_SPACES)]
    dup = len(lines) - len(set(lines))
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeat = repeat_words(codes, len(number))
    return n, chars, symbols, dup, repeat, upper, marks, len(lines)


def repeat_words(codes, kinds: int) -> int:
    """Words that lie in a 3-word window found twice or more."""
    import numpy as np

    n = len(codes)
    if n < 4:
        return 0
    # a number for each pair, then for each pair and its next word: within 64 bits for any length
    pair = codes[:-1] * kinds + codes[1:]
    if kinds < 2_000_000:
        window = pair[:-1] * kinds + codes[2:]
    else:
        _, pair = np.unique(pair, return_inverse=True)
        window = pair[:-1] * kinds + codes[2:]
    order = np.argsort(window, kind="stable")
    ranked = window[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] = hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


def features_of(counts):
    """FEATURES of an array of COUNTS (a row for each document): how far each share is beyond its rule's limit.

    A feature is the logarithm of share / limit, and 0 within the limit, so that documents
    that keep all rules are alike and a few splits set others apart.
    """
    import numpy as np

    c = {name: counts[:, i].astype(np.float64) for i, name in enumerate(COUNTS)}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    length = chars / words
    beyond = lambda share, limit: np.log(np.maximum(1.0, share / limit))
    return np.stack(
        [
            beyond(c["n_symbols"] / words, LIMITS["symbols"]),
            beyond(c["n_dup_lines"] / lines, LIMITS["dup_lines"]),
            beyond(c["n_repeat_words"] / words, LIMITS["repeats"]),
            beyond(c["n_upper"] / chars, LIMITS["upper"]),
            beyond(c["n_marks"] / words, LIMITS["marks"]),
            beyond(length, LIMITS["long_words"]) + beyond(LIMITS["short_words"], length),
        ],
        axis=1,
    )


@dataclass(frozen=True)
class Forest:
    """Trees as arrays (feature -1: a leaf; value: its path length), and the normaliser of path lengths."""

    feature: object
    split: object
    left: object
    right: object
    value: object
    expected: float

    def scores(self, x):
        """Anomaly scores between 0 and 1: 2 to the minus mean path length by expected length."""
        import numpy as np

        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(self.feature.shape[0]):
            feature, split, left, right = self.feature[t], self.split[t], self.left[t], self.right[t]
            at = np.zeros(len(x), np.int32)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go_left = x[rows, np.maximum(f, 0)] < split[at]
                at = np.where(inner, np.where(go_left, left[at], right[at]), at)
            total += self.value[t][at]
        return np.exp2(-total / self.feature.shape[0] / self.expected)


def average_path(n: int) -> float:
    """The mean path length of an unsuccessful search in a binary tree of n rows."""
    import math

    if n < 2:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grow_forest(x, trees: int = 100, sample: int = 256, seed: int = 7) -> Forest:
    """An isolation forest on the rows of x: splits at random between the ends of a random feature."""
    import math

    import numpy as np

    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    limit = max(1, math.ceil(math.log2(max(2, size))))
    room = 2 ** (limit + 1)
    shape = (trees, room)
    feature, split = np.full(shape, -1, np.int32), np.zeros(shape)
    left, right, value = np.zeros(shape, np.int32), np.zeros(shape, np.int32), np.zeros(shape)
    for t in range(trees):
        first = rng.choice(len(x), size, replace=False) if len(x) else np.zeros(0, int)
        todo, used = [(0, first, 0)], 1
        while todo:
            at, rows, depth = todo.pop()
            part = x[rows]
            low, high = (part.min(0), part.max(0)) if len(rows) else (np.zeros(0), np.zeros(0))
            open_features = np.flatnonzero(high > low)
            if depth == limit or len(rows) < 2 or not len(open_features):
                value[t, at] = depth + average_path(len(rows))
                continue
            f = int(rng.choice(open_features))
            s = rng.uniform(low[f], high[f])
            if not low[f] < s:
                s = high[f]
            mask = part[:, f] < s
            feature[t, at], split[t, at], left[t, at], right[t, at] = f, s, used, used + 1
            todo += [(used, rows[mask], depth + 1), (used + 1, rows[~mask], depth + 1)]
            used += 2
    return Forest(feature, split, left, right, value, max(average_path(size), 1e-9))


@dataclass(frozen=True)
class QualityModel:
    forest: Forest
    threshold: float


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS) of each row; by row, without a shuffle."""
    wide_rows(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    schema = T.StructType([T.StructField(id_col, source.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            made = np.array([count_text(x) for x in batch.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, made.T)], names=schema.names)

    return source.mapInArrow(run, schema)


def base_failed():
    """The base rules as a column."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _score(stats: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """stats' columns of keep and the anomaly score."""
    shared = stats.sparkSession.sparkContext.broadcast(model.forest)
    source = stats.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *COUNTS)
    schema = T.StructType([*(T.StructField(c, stats.schema[c].dataType) for c in keep), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            counts = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[len(keep) :]], axis=1)
            score = shared.value.scores(features_of(counts))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score)], names=schema.names)

    return source.mapInArrow(run, schema)


def _sample(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most that many rows, by the hash of their id: about as many are left before they are sorted, so
    tasks don't each send as many to the driver."""
    share = min(1.0, 1.1 * most / max(1, rows.count()))
    mark = F.xxhash64(id_col)
    return rows.where(F.pmod(mark, F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).orderBy(mark, *COUNTS).limit(most)


def fit_quality(
    stats: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    trees: int = 100,
    sample: int = 256,
    max_train: int = 25_600,
    contamination: float = 0.02,
    lost: float = 0.002,
    default_threshold: float = 0.6,
    seed: int = 7,
) -> QualityModel:
    """Grows the forest and calibrates the threshold.

    stats should be a written table: it is read twice. Rows that fail the base rules
    take no part. Of the training rows a share of contamination is labelled bad, so that
    splits reach beyond what good documents show.
    """
    import numpy as np

    known = labels.select(F.col(id_col), F.col(label_col).alias("__label")).where(F.col("__label").isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(id_col).agg(F.max("__label").alias("__label"))
    passed = stats.where(~base_failed())
    rows = passed.join(known, id_col).select(id_col, "__label", *COUNTS)
    rows = materialize(rows, "labelled")
    good = _sample(rows.where("__label = 1"), id_col, max_train)
    bad = _sample(rows.where("__label <> 1"), id_col, max(1, int(max_train * contamination)))
    take = lambda df: np.array([[r[c] for c in COUNTS] for r in df.select(*COUNTS).collect()], np.int64).reshape(-1, len(COUNTS))
    a, b = take(good), take(bad)
    b = b[: max(1, int(len(a) * contamination))] if len(a) else b
    train = np.concatenate([a, b])
    if not len(train):
        train = take(_sample(passed, id_col, max_train))
        return QualityModel(grow_forest(features_of(train), trees, sample, seed), default_threshold)
    model = QualityModel(grow_forest(features_of(train), trees, sample, seed), default_threshold)
    histogram = (
        _score(rows, model, ["__label"])
        .where("__label = 1")
        .groupBy(F.least(F.lit(BINS - 1), F.floor(F.col("score") * BINS)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    total = sum(r["n"] for r in histogram)
    if not total:
        return model
    # a handful of labels can't show a share of a few thousandths: two rows, or 1 %, may go there
    allowed, above = max(lost * total, min(2, 0.01 * total)), 0
    for r in sorted(histogram, key=lambda r: -r["bin"]):
        if above + r["n"] > allowed:
            break
        above += r["n"]
    else:
        r = None
    # rejected are scores of at least the end of the bin that would have gone too far
    threshold = (r["bin"] + 1) / BINS if r is not None else 0.0
    return QualityModel(model.forest, threshold)


def judge(stats: DataFrame, model: QualityModel, id_col: str = "doc_id") -> DataFrame:
    """stats' id and counts, base_failed, score and kept."""
    scored = _score(stats, model, [id_col, *COUNTS]).withColumn("base_failed", base_failed())
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") < model.threshold))


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of docs that the base rules and the forest keep, with all their columns; by row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    wide_rows(docs.sparkSession)
    docs, now = plain_names(docs)
    columns = docs.columns
    source = docs.withColumn("data", F.coalesce(F.col(now[text_col]), F.lit("")).cast("binary"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            counts = np.array([count_text(x) for x in batch.column(len(columns)).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            model = shared.value
            good = model.forest.scores(features_of(counts)) < model.threshold
            words, repeat = counts[:, 0], counts[:, COUNTS.index("n_repeat_words")]
            good &= (words >= MIN_WORDS) & (100 * repeat <= MAX_REPEAT_PERCENT * words)
            rows = pa.RecordBatch.from_arrays(batch.columns[: len(columns)], names=columns)
            yield rows.filter(pa.array(good))

    return old_names(source.mapInArrow(run, docs.schema), now)
