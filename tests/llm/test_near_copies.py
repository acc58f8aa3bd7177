"""Near copies of the pipeline's dedup stage, held against all pairs of distinct texts."""

import random
from collections import Counter, defaultdict

import corpus_pipeline

from stackroom.llm import minhash, simhash

SF = "/root/testdata/sf0.1"


def folded_words(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()


def brute_pairs(texts, similarity=0.8, k=5):
    """{(a, b): similarity} of the distinct texts' numbers, by counting shared shingles."""
    sets = []
    for words in texts:
        sets.append({b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = Counter()
    for some in holders.values():
        shared.update((a, b) for i, a in enumerate(some) for b in some[i + 1 :])
    near = {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in shared.items()}
    return {p: s for p, s in near.items() if s >= similarity}


def brute_survivors(rows):
    """(ids that stay, similarities of near pairs of distinct texts) of (id, text)."""
    ids = defaultdict(list)
    for doc, text in rows:
        ids[tuple(folded_words(text))].append(doc)
    texts = list(ids)
    pairs = brute_pairs(texts)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        root[find(a)] = find(b)
    least = {}
    for i, words in enumerate(texts):
        least[find(i)] = min([*ids[words], *([least[find(i)]] if find(i) in least else [])])
    return set(least.values()), pairs


def test_stage_removes_all_near_copies_of_distinct_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, pairs = brute_survivors([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert len(pairs) >= 40
    got = [r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, SF).select("doc_id").collect()]
    assert len(got) == len(want) and set(got) == want


def test_large_groups_chains_and_cases(spark):
    rng = random.Random(3)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = [None, "", " \n", "one", "One", "a b c d", "A  b\nc d", "a b c d e", "x " * 900]
    base = prose(200)
    for _ in range(150):  # one group, of which no text is near to all others
        copy = list(base)
        for at in rng.sample(range(200), rng.randint(1, 4)):
            copy[at] = prose(1)[0]
        texts.append(" ".join(copy))
    chain = prose(150)
    for step in range(12):
        texts.append(" ".join(chain[5 * step :] + prose(5 * step)))
        chain = chain[: 5 * step] + texts[-1].split()
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one")]
    rng.shuffle(rows)
    want, _ = brute_survivors(rows)
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, fp int, keys string")
    for words in (1, 8):
        kept = minhash.deduplicate(df, cfg=minhash.NearCopies(words=words))
        got = [r["doc_id"] for r in kept.collect()]
        assert kept.columns == df.columns and len(got) == len(want) and set(got) == want
    dotted = df.withColumnRenamed("keys", "a.b")
    assert minhash.deduplicate(dotted).columns == dotted.columns and simhash.deduplicate(dotted).columns == dotted.columns
    assert minhash.deduplicate(df.limit(0)).count() == 0 and minhash.near_copies(df).count() == len(rows)


def test_groups_at_the_edge_of_the_similarity(spark):
    """Copies of texts that aren't there themselves, some too far from all others, some joined by edits that they share."""
    rng = random.Random(8)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 250))]
        edits = [(rng.randrange(len(base)), f"e{rng.randrange(10**6)}") for _ in range(12)]
        for _ in range(80):
            copy = list(base)
            for at, word in [*rng.sample(edits, rng.randint(0, 3)), *[(rng.randrange(len(base)), f"n{rng.randrange(10**6)}") for _ in range(rng.randint(1, 5))]]:
                copy[at] = word
            texts.append(" ".join(copy[: len(copy) - rng.choice((0, 0, 0, 9))]))
    rows = list(enumerate(texts))
    want, pairs = brute_survivors(rows)
    assert 150 < len(want) < len(rows) - 50 and pairs
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for words in (1, 8):
        assert {r["doc_id"] for r in minhash.deduplicate(df, cfg=minhash.NearCopies(words=words)).collect()} == want


def test_simhash_groups_link_near_copies_without_any_minhash_key(spark):
    """Without bands only SimHash gives candidates, and whole sets still decide: equal fingerprints alone are no link."""
    rng = random.Random(6)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(10):
        base = prose(1500)
        texts += [" ".join(base), " ".join([*base, *prose(1)]), " ".join([*prose(1), *base[1:]])]
    texts += ["x " * 3000 + " ".join(prose(40)) for _ in range(6)]  # one shingle outweighs all others, few are shared
    rows = list(enumerate(texts))
    prints = [simhash.fingerprint(t.encode(), 5) for t in texts]
    assert len(set(prints[30:])) == 1
    want, _ = brute_survivors(rows)
    near = [(3 * i, 3 * i + k) for i in range(10) for k in (1, 2)]
    linked = {b for a, b in near if ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= 2}
    assert len(linked) >= 10 and want == {*range(0, 30, 3), *range(30, 36)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in minhash.deduplicate(df, cfg=minhash.NearCopies(bands=0)).collect()}
    assert want <= got and not got & linked
    assert {r["doc_id"] for r in minhash.deduplicate(df).collect()} == want
