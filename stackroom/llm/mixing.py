"""Mixing to target weights with soft domain membership, in DataFrame functions only.

A classifier fitted on a labelled table gives each document posteriors over domains;
projected-gradient least squares then fits a nonnegative rate for each document such
that the expected tokens of each domain, ``sum(rate * tokens * posterior)``, match the
targets. Rates start at 1 and a step for a document is minus its posteriors' product with
the residuals, in the metric of the domains' damped Gram matrix ``sum(tokens * p * p')``:
without projection to 0 and above, and damping, one step would meet the targets; with
them steps fall short rather than overshoot. What the driver sees of the documents is one total for each
domain and round, and that matrix.

The classifier is naive Bayes over a lexicon and three document statistics. The lexicon
has, for each domain, all words that its documents hold at least ``min_ratio`` times as
often as labelled documents do on the whole (with ``shrink`` pseudo-documents, so words
of few documents don't count; by default one to ten, with the sample's size); that a text holds none of them counts too.
It is fitted on at most about ``max_train`` labelled rows, picked by the hash of their
id: a documented bound.

The posteriors are expressions over the text itself, so nothing but documents of the
sample is joined or shuffled by key, and hot sources or ids don't matter.

Cases: null text is empty text: it has no tokens and the prior posteriors; rows with a
null id count, but can't be labelled; repeated rows are documents of their own; without
labels every domain is equally likely; a domain with a target but no tokens can't be
met and is left out of the fit; extra columns are kept.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.shared import fresh, materialize

DOMAINS = ("good", "poor", "toxic")
#: The share of expected tokens that each domain is to have.
TARGETS = {"good": 0.95, "poor": 0.05, "toxic": 0.0}
#: Levels of a statistic, and statistics.
LEVELS = 8
STATISTICS = 3
_BREAKS = r"[ \n\t\r.,;:!?\"()]+"


@dataclass(frozen=True)
class DomainModel:
    """Log-odds: prior by domain, by word and domain, and by domain for each statistic's levels."""

    prior: tuple[float, ...]
    words: dict[str, tuple[float, ...]]
    levels: tuple[tuple[float, ...], ...]


def words_of(text: Column) -> Column:
    """The words of a text in lower case, with an empty one where it starts or ends with a break."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), _BREAKS)


def _with(value: Column, then) -> Column:
    """then(value) with value computed once, however often then names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _level(share: Column, steps: tuple[float, ...]) -> Column:
    """How many of the steps a share reaches."""
    limits = F.array(*[F.lit(x) for x in steps])
    return _with(share, lambda s: F.size(F.filter(limits, lambda x: s >= x)))


def statistics(text: Column) -> Column:
    """An array of STATISTICS levels below LEVELS: shares of symbols, capitals and exclamation marks."""
    text = F.coalesce(text, F.lit(""))
    # one pass of a regular expression or of a plain search: translate() takes many times as long
    share = lambda rest: 1 - F.length(rest) / F.greatest(F.length(text), F.lit(1))
    return F.array(
        _level(share(F.regexp_replace(text, "[#*$%&|<>]", "")), (0.005, 0.02, 0.04, 0.08, 0.16, 0.24, 0.32)),
        _level(share(F.regexp_replace(text, "[A-Z]", "")), (0.005, 0.01, 0.02, 0.04, 0.1, 0.3, 0.5)),
        _level(share(F.replace(text, F.lit("!"), F.lit(""))), (0.0005, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1)),
    )


def domain_of(labels: DataFrame) -> Column:
    """The domain of a row of labels (quality, toxic)."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality").isNotNull(), "poor")


def labelled_sample(docs: DataFrame, labels: DataFrame, domain: Column, id_col: str, text_col: str, max_train: int) -> DataFrame:
    """(text, domain) of labelled documents: about max_train of them, by the hash of their ids.

    Copies would make all of their words look typical: of the sample's equal texts of a domain
    one counts. Texts that differ anywhere all count.
    """
    known = labels.select(F.col(id_col).alias("id"), domain.alias("domain")).where("id IS NOT NULL AND domain IS NOT NULL")
    known = known.groupBy("id").agg(F.max("domain").alias("domain"))
    share = min(1.0, max_train / max(1, labels.count()))
    picked = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # the sample's ids are bounded by max_train
    rows = rows.join(F.broadcast(picked), "id").withColumn("text", F.coalesce("text", F.lit("")))
    whole = F.sha2(F.col("text").cast("binary"), 256).alias("whole")
    return rows.groupBy("domain", whole).agg(F.first("text").alias("text")).select("text", "domain")


def fit_domains(
    docs: DataFrame,
    labels: DataFrame,
    domain: Column | None = None,
    domains: tuple[str, ...] = DOMAINS,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_train: int = 20_000,
    min_ratio: float = 3.0,
    shrink: float | None = None,
) -> DomainModel:
    """Fits the classifier. What is collected is bounded by the sample's typical words and the numbers of domains and levels."""
    import math

    rows = labelled_sample(docs, labels, domain if domain is not None else domain_of(labels), id_col, text_col, max_train)
    rows = materialize(rows.where(F.col("domain").isin(*domains)), "labelled-texts")
    k = len(domains)
    n_docs = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n_docs.values())
    if shrink is None:
        shrink = min(10.0, max(1.0, total / 400))

    share = [n_docs.get(d, 0) / max(1, total) for d in domains]
    held = [F.count_if(F.col("domain") == d).cast("double").alias(f"h{i}") for i, d in enumerate(domains)]
    ratio = [(F.col(f"h{i}") + shrink) / (F.col("n") * F.lit(s) + shrink) for i, s in enumerate(share)]
    words = (
        rows.select("domain", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
        .where("word <> ''")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"), *held)
        .withColumns({f"r{i}": r for i, r in enumerate(ratio)})
    )
    prior = [math.log((n_docs.get(d, 0) + 1) / (total + k)) for d in domains]
    lexicon: dict[str, list[float]] = {}
    for i, d in enumerate(domains):
        inside, outside = n_docs.get(d, 0) + 1.0, total - n_docs.get(d, 0) + 1.0
        for r in words.where(F.col(f"r{i}") >= min_ratio).orderBy(F.desc(f"r{i}"), "word").collect():
            here, there = (r[f"h{i}"] + 0.5) / inside, (r["n"] - r[f"h{i}"] + 0.5) / outside
            absent = math.log((1 - min(here, 0.999)) / (1 - min(there, 0.999)))
            prior[i] += absent
            lexicon.setdefault(r["word"], [0.0] * k)[i] = math.log(here / there) - absent

    found = rows.select("domain", F.posexplode(statistics(F.col("text"))).alias("statistic", "level"))
    found = found.groupBy("domain", "statistic", "level").agg(F.count(F.lit(1)).alias("n")).collect()
    tally = {d: [1.0] * (STATISTICS * LEVELS) for d in domains}
    for r in found:
        tally[r["domain"]][r["statistic"] * LEVELS + r["level"]] += r["n"]
    levels = tuple(tuple(math.log(x / (n_docs.get(d, 0) + LEVELS)) for x in tally[d]) for d in domains)
    return DomainModel(tuple(prior), {w: tuple(x) for w, x in lexicon.items()}, levels)


def _literal(kind: str, values) -> Column:
    """Constants as one foldable expression, however many they are."""
    return F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), kind)


def log_odds(words: Column, text: Column, model: DomainModel) -> Column:
    """The array of a text's unnormalised log posteriors, from its words; a word counts once."""
    parts = F.transform(
        statistics(text), lambda level, i: F.get(_literal("array<array<double>>", [list(x) for x in zip(*model.levels, strict=True)]), i * LEVELS + level)
    )
    if model.words:
        # of the lexicon's array a text's words pick a few, and only those are looked up in the map
        hits = F.array_intersect(words, _literal("array<string>", list(model.words)))
        weights = _literal("map<string,array<double>>", model.words)
        parts = F.concat(parts, F.transform(hits, lambda w: F.try_element_at(weights, w)))
    return F.aggregate(parts, _literal("array<double>", model.prior), lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b))


def posteriors_of(logs: Column) -> Column:
    raised = _with(logs, lambda v: F.transform(v, lambda x: F.exp(x - F.array_max(v))))
    return _with(raised, lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda acc, y: acc + y)))


def add_posteriors(docs: DataFrame, model: DomainModel, text_col: str = "text", tokens: str = "n_tokens", out: str = "posteriors") -> DataFrame:
    """docs with its words (tokens) and the array of its domain posteriors; by row, without a shuffle."""
    words = fresh([*docs.columns, tokens, out], "__words")
    df = docs.withColumn(words, words_of(F.col(text_col)))
    found = posteriors_of(log_odds(F.col(words), F.col(text_col), model))
    return df.withColumns({tokens: F.size(F.array_remove(words, "")).cast("long"), out: found}).drop(words)


def _dot(posteriors: Column, weights: tuple[float, ...]) -> Column:
    terms = [F.get(posteriors, F.lit(i)) * F.lit(w) for i, w in enumerate(weights)]
    return sum(terms[1:], terms[0])


def rate(posteriors: Column, steps: list[tuple[float, ...]]) -> Column:
    """A document's rate after the given gradient steps, projected to 0 and above at each."""

    def walk(p: Column) -> Column:
        r = F.lit(1.0)
        for step in steps:
            r = F.greatest(F.lit(0.0), r - _dot(p, step))
        return r

    return _with(posteriors, walk)


def fit_rates(
    table: DataFrame,
    targets: Mapping[str, float] = TARGETS,
    domains: tuple[str, ...] = DOMAINS,
    tokens: str = "n_tokens",
    posteriors: str = "posteriors",
    slack: float = 1.05,
    budget: float | None = None,
    max_epochs: float = 4.0,
    damping: float = 0.02,
    rounds: int = 12,
    tolerance: float = 1e-4,
) -> tuple[list[tuple[float, ...]], float]:
    """The gradient steps that lead from rates of 1 to the targets, and the gap that they leave.

    The gap is the largest distance of a domain's expected tokens from its target, as a share of the
    budget. It isn't 0 where no rates of 0 and above meet the targets: each document whose posteriors
    are not sure brings some tokens to a domain whose target is 0.

    table should be a written table of tokens and posteriors: each round sums it once.
    budget is the number of expected tokens in all; left out, it is what the domain of the
    largest target needs to keep all of its tokens, times slack. A target of more than
    max_epochs times a domain's tokens is lowered to that. damping, as a share of all tokens,
    is added to the metric's diagonal: a domain with next to no tokens changes rates slowly, and
    documents that hold a little of it keep theirs.
    Stops when each domain is within tolerance of the budget, or after that many rounds.
    """
    k = len(domains)
    p = [F.get(posteriors, F.lit(i)) for i in range(k)]

    def mass(r: Column) -> list[Column]:
        return [F.sum(F.col(tokens) * r * x).alias(f"s{i}") for i, x in enumerate(p)]

    gram = [F.sum(F.col(tokens) * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]
    first = [x or 0.0 for x in table.agg(*mass(F.lit(1.0)), *gram).first()]
    start, metric = first[:k], [first[k + i * k : k + i * k + k] for i in range(k)]
    for i in range(k):
        metric[i][i] += damping * sum(start)
    weight = [max(0.0, targets.get(d, 0.0)) for d in domains]
    met = [w if s > 0 else 0.0 for w, s in zip(weight, start, strict=True)]
    whole = sum(met)
    if not whole:
        return [], 0.0
    if budget is None:
        main = max(range(k), key=lambda i: met[i])
        budget = slack * start[main] * whole / met[main]
    goal = [min(budget * w / whole, max_epochs * s) for w, s in zip(met, start, strict=True)]
    far = lambda now: max(abs(a - g) for a, g in zip(now, goal, strict=True)) / budget
    steps: list[tuple[float, ...]] = []
    now, best, gap = start, 0, far(start)
    while len(steps) < rounds and gap > tolerance:
        steps.append(_solve(metric, [a - g for a, g in zip(now, goal, strict=True)]))
        r = F.col("r")
        now = [x or 0.0 for x in table.select(tokens, posteriors, rate(F.col(posteriors), steps).alias("r")).agg(*mass(r)).first()]
        if far(now) < gap:
            best, gap = len(steps), far(now)
    # with the last steps, where they went too far, the rates would be further away
    return steps[:best], gap


def _solve(matrix: list[list[float]], right: list[float]) -> tuple[float, ...]:
    """matrix^-1 right of a small positive definite matrix, by elimination."""
    k = len(right)
    rows = [[*map(float, matrix[i]), float(right[i])] for i in range(k)]
    for i in range(k):
        top = max(range(i, k), key=lambda j: abs(rows[j][i]))
        rows[i], rows[top] = rows[top], rows[i]
        for j in range(k):
            if j != i:
                f = rows[j][i] / rows[i][i]
                rows[j] = [a - f * b for a, b in zip(rows[j], rows[i], strict=True)]
    return tuple(rows[i][k] / rows[i][i] for i in range(k))


def copies_of(rates: Column, *key: str) -> Column:
    """Whole copies of a row: the rate's whole part, and one more with its fraction's probability, by the key's hash."""
    u = F.pmod(F.xxhash64(F.lit("mixing"), *key), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return F.floor(rates + u).cast("int")


def mix(
    docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", **fit
) -> DataFrame:
    """docs with n_tokens, posteriors, rate and copies. Columns of these names are replaced."""
    docs = docs.drop("n_tokens", "posteriors", "rate", "copies")
    model = fit_domains(docs, labels, id_col=id_col, text_col=text_col)
    scored = add_posteriors(docs, model, text_col)
    steps, _ = fit_rates(materialize(scored.select("n_tokens", "posteriors"), "posteriors"), targets, **fit)
    return with_rates(scored, steps, id_col)


def with_rates(scored: DataFrame, steps: list[tuple[float, ...]], id_col: str = "doc_id") -> DataFrame:
    out = scored.withColumn("rate", rate(F.col("posteriors"), steps))
    return out.withColumn("copies", copies_of(F.col("rate"), id_col))


def mix_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """The rows of docs, each as often as mixing to the targets asks: rows of rate 0 go, others may repeat."""
    columns = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    key, text = f"c{columns.index(id_col)}", f"c{columns.index(text_col)}"
    mixed = mix(inner, labels.withColumnRenamed(id_col, key), id_col=key, text_col=text, **fit)
    # an outer explode: from an inner one, or a filter on copies, the optimizer would derive a condition
    # on the text itself and compute the rates twice
    out = mixed.withColumn("copy", F.explode_outer(F.array_repeat(F.lit(1), F.col("copies")))).where("copy IS NOT NULL")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
