"""Near copies, mixing, LM scores, quality verdicts and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from stackroom.llm import bpe, lm, mixing, quality, simhash

SF = "/root/testdata/sf0.01"


def brute_fingerprint(text, k=3):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=2):
    """Least id of each row's component; fps: (id, fingerprint)."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= bits:
                root[find(i)] = find(j)
    best = {}
    for i, (doc, _) in enumerate(fps):
        best[find(i)] = min([x for x in (best.get(find(i)), doc) if x is not None], default=None)
    return Counter((doc, fp, best[find(i)]) for i, (doc, fp) in enumerate(fps))


def test_fingerprints_and_components_of_texts(spark):
    texts = [None, "", "one", "One", "a b c d e f g h", "a b c d e f g h", "A b c d e f g i", "x " * 4000, "  \n"]
    df = spark.createDataFrame([(i if i != 2 else None, t, 1, "c") for i, t in enumerate(texts)] + [(0, None, 1, "c")], "doc_id long, text string, fp int, component_id string")
    got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df).collect())
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in df.collect()]
    assert got == brute_components(rows)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns and kept.count() == len({frozenset([v]) for v in {(r["component_id"],) for r in simhash.near_duplicates(df).collect()}})
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_links_of_dense_and_sparse_fingerprints(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for base in list(fps)[:6]:
        for _ in range(12):
            x = base
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    rows = [(i, x) for i, x in enumerate(sorted(fps))]
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in rows]
    df = spark.createDataFrame(signed, "id long, fp long")
    want = {(doc, best) for doc, _, best in brute_components(rows)}
    for dense in (256, 2):
        groups = simhash.group_fingerprints(df, "id", "fp", 2, dense)
        assert {(r["id"], r["component_id"]) for r in df.join(groups, "fp").collect()} == want


def test_mixing_meets_targets_without_python(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    clash = docs.withColumn("rate", F.lit("x")).withColumn("id", F.lit(1))
    mixed = mixing.mix(clash, train)
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    rows = mixed.join(test, "doc_id").select("quality", "toxic", "posteriors", "rate").collect()
    good = [r for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(r["posteriors"][0] > 0.5 for r in good) > 0.95 * len(good) and min(r["rate"] for r in good) > 0.9
    table = mixed.select("n_tokens", "posteriors", "rate").toPandas()
    totals = sum(n * r * np.array(p) for n, r, p in zip(table.n_tokens, table.rate, table.posteriors, strict=True))
    assert totals[2] < 0.03 * totals.sum() and abs(table.posteriors.map(sum) - 1).max() < 1e-9


def test_projected_steps_are_those_of_numpy(spark):
    rng = np.random.default_rng(2)
    n = rng.integers(1, 100, 300)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, posteriors array<double>")
    targets = {"good": 0.7, "poor": 0.3, "toxic": 0.0}
    steps, gap = mixing.fit_rates(df, targets, rounds=30)
    r = np.ones(300)
    for step in steps:
        r = np.maximum(0, r - p @ np.array(step))
    got = [x["r"] for x in df.select(mixing.rate(F.col("posteriors"), steps).alias("r")).collect()]
    assert np.allclose(got, r)
    total = (n * r) @ p
    assert total[2] / total.sum() < 0.12 and 0.55 < total[0] / total.sum() < 0.8


def test_mixing_edge_cases(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "a b. c!", 3)], "doc_id long, text string, copies int")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r["n_tokens"] for r in mixing.mix(df, labels).orderBy("n_tokens").collect()] == [0, 0, 0, 3]
    assert mixing.mix(df.limit(0), labels).count() == 0 and mixing.mix(df, labels.limit(0)).count() == 4
    assert mixing.mix_rows(df, labels).columns == df.columns


def test_attention_gradient_and_single_scores():
    cfg = lm.LmConfig(dims=4, window=6, stride=4, classes=5, single=2, own=6, batch=3)
    counts = np.random.default_rng(0).integers(0, 9, 20)
    vocabulary = lm.build_vocabulary(counts, 19, cfg)
    assert np.allclose(np.bincount(vocabulary.cls, np.exp(vocabulary.share.astype(float)), cfg.classes)[np.unique(vocabulary.cls)], 1, atol=1e-5)
    vector = lm.initial(vocabulary.prior, cfg).astype(np.float64)
    rng = np.random.default_rng(1)
    rows, targets = rng.integers(0, 11, (2, 6)), rng.integers(0, 5, (2, 6))
    mask = lm.causal_mask(6, 6).astype(float)
    _, g = lm.gradient(lm.unflatten(vector, cfg), rows, targets, cfg, mask)
    for i in rng.choice(len(vector), 25, replace=False):
        e = np.zeros(len(vector))
        e[i] = 1e-5
        up, down = (lm.gradient(lm.unflatten(vector + s * e, cfg), rows, targets, cfg, mask)[0] for s in (1, -1))
        assert abs((up - down) / 2e-5 - g[i]) < 1e-4
    # each id once: blocks of documents give what windows one by one give
    w = lm.unflatten(vector.astype(np.float32), cfg)
    sizes = np.array([1, 9, 4])
    flat = rng.integers(0, 20, sizes.sum())
    got = lm.score_documents(w, vocabulary, flat, sizes, cfg)
    at = 0
    for size, score in zip(sizes, got, strict=True):
        doc, total = flat[at : at + size], 0.0
        for start in range(0, size, cfg.stride):
            for j in range(start, min(size, start + cfg.stride)):
                ctx = [start - 3 + i for i in range(cfg.window)]
                r = np.array([[vocabulary.row[doc[c]] if 0 <= c < size else vocabulary.row[19] if c < 0 else vocabulary.row[doc[-1]] for c in ctx]])
                tgt = np.zeros((1, 4), int)
                tgt[0, j - start] = vocabulary.cls[doc[j]]
                total += lm.class_log_probs(w, r, tgt, cfg, lm.causal_mask(6, 4))[0, j - start] + vocabulary.share[doc[j]]
        assert abs(total - score) < 1e-3
        at += size


def test_lm_scores_against_brute_force(spark):
    texts = [None, "", "A b a", "b  c\n", "zz only here", "A b a"] + [f"w{i} a b common words" for i in range(30)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "null id", 1)], "doc_id long, text string, score int")
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    rows = lm.score_texts(df, ranks, P.PATTERN).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    words = {r["doc_id"]: (r["text"] or "").lower().split() + [""] for r in df.collect()}
    c = Counter(w for i, ws in words.items() if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(words)
    for r in rows:
        ws = words[r["doc_id"]]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(ws), sum(w in c for w in ws), n)
        assert abs(r["base_score"] - base) < 1e-9 and r["score"] < 0
    assert lm.score_texts(df.limit(0), ranks, P.PATTERN).count() == 0


def brute_counts(text):
    t = text or ""
    spaces = " \t\n\x0b\x0c\r"
    words, now = [], ""
    for ch in t + " ":
        if ch in spaces:
            words += [now] if now else []
            now = ""
        else:
            now += ch
    lines = [x for x in t.split("\n") if x.strip(spaces)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    hit = {j for i, w in enumerate(windows) if many[w] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in t), dup, len(hit)


def test_quality_counts_and_verdicts(spark):
    texts = [None, "", "a a a a", "a b c\na b c\n\n \na b c x", "é\xa0ü # |", "x y z " * 3, "\x1c \x0b w"]
    for t in texts:
        assert quality.count_text((t or "").encode())[:5] == brute_counts(t)
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    stats = quality.rule_statistics(docs)
    got = quality.judge(stats, quality.fit_quality(stats, labels.where("doc_id % 3 <> 0"))).join(labels.where("doc_id % 3 = 0"), "doc_id").where("NOT base_failed").collect()
    good, bad = [r["kept"] for r in got if r["quality"] == 1], [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)
    extra = docs.withColumn("score", F.when(F.col("doc_id") >= 0, "clash"))
    extra = extra.unionByName(spark.createDataFrame([(None,) * 6], extra.schema))
    model = quality.fit_quality(stats.limit(0), labels)
    assert quality.keep_good(extra, model).columns == extra.columns and quality.keep_good(extra.limit(0), model).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choices(vocab, k=n)) + "."
    clean = [prose(rng.randint(60, 200)) for _ in range(120)]
    texts = clean + clean[:10] + ["short text"] + ["bad bad bad " * 40] + [" | ".join(rng.choices(vocab, k=90)) for _ in range(6)] + [None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    label = lambda i: (i, 0 if "|" in (texts[i] or "") or i > 129 else 1, 0)
    spark.createDataFrame([label(i) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = {i for i, best in ((d, b) for d, _, b in brute_components([(i, brute_fingerprint(t)) for i, t in enumerate(clean)])) if i == best}
    assert {r["doc_id"] for r in got} == want
    import hashlib

    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in got)
