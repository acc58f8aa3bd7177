"""What op8's weights learn from: every id of every training document, once."""

import functools
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken

from stackroom.llm import bpe, lm
from stackroom.llm import wordblocks as wb


def test_each_id_is_a_target_once_and_windows_hold_one_document():
    cfg = lm.LmConfig(window=6, stride=4, classes=40, single=40, own=40)
    sizes = np.array([1, 9, 4, 30, 2])
    flat = np.arange(sizes.sum()) % 38  # ids by place; 39 is the end
    same = np.arange(40)
    vocabulary = lm.Vocabulary(same, np.zeros(40, np.float32), same.astype(np.int32), np.zeros(40, np.float32), 39)
    want, at = [], 0
    for n in sizes.tolist():
        doc = flat[at : at + n].tolist()
        want += list(zip([39, *doc[:-1]], doc, strict=True))
        at += n
    rows, targets, real = lm.training_windows(vocabulary, flat, sizes, cfg)
    got = list(zip(rows[real].tolist(), targets[real].tolist(), strict=True))
    follows = rows[:, 1:] == targets[:, :-1]
    assert follows[real[:, 1:] & real[:, :-1]].all()
    assert sorted(got) == sorted(want)


def test_the_model_beats_a_unigram_of_its_subwords_and_ignores_partition_counts(spark):
    ranks, end = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), None
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    cut = functools.cache(lambda word: one(" " + word.decode()))
    ids = {r["doc_id"]: [*itertools.chain.from_iterable(map(cut, r["text"].encode().lower().split())), end] for r in docs.collect()}
    held = {i for i in ids if zlib.crc32(str(i).encode()) % 10 == 0}
    counts = Counter(x for i, some in ids.items() if i not in held for x in some)
    total, kinds = sum(counts.values()), max(ranks.values()) + 2
    unigram = sum(math.log10((counts[x] + lm.SMOOTH) / (total + lm.SMOOTH * kinds)) for i in held for x in ids[i])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in (before, "3"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append({r["doc_id"]: r for r in lm.score_texts(docs, ranks, P.PATTERN).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    first, again = got
    assert all(len(ids[i]) == r["n_subwords"] for i, r in first.items())
    assert all(abs(r["score"] - again[i]["score"]) < 1e-3 * abs(r["score"]) + 1e-3 for i, r in first.items())
    gain = (sum(first[i]["score"] for i in held) - unigram) / sum(len(ids[i]) for i in held)
    assert gain > 0.2, gain


def test_shortcuts_of_the_kernels_give_what_the_plain_forms_give():
    rng = np.random.default_rng(2)
    z, c = rng.normal(0, 1, (60, 7)).astype(np.float32), rng.random(7).astype(np.float32)
    mask = np.tril(np.ones((60, 7), np.float32))
    for scale in (1, 20, 200, -200):  # of these the last two overflow or vanish unless they are clipped
        for some in (None, mask):
            powers, total = lm._exp(lambda scale=scale: z * np.float32(scale), 60.0, c, some)
            want = np.exp(np.clip(z * np.float32(scale), -60, 60)) * (1 if some is None else some)
            assert np.isfinite(powers).all() and np.isfinite(total).all()
            assert (np.abs(powers - want) <= 1e-5 * want.max(1, keepdims=True)).all() and np.allclose(total, want @ c, 1e-4)
    x, y = rng.normal(0, 1, (72, 5)).astype(np.float32), rng.normal(0, 1, (72, 6)).astype(np.float32)
    assert np.allclose(lm._over_rows(x, y, 24), x.T @ y, atol=1e-4)


def test_fewer_products_give_the_weights_gradients_and_scores_of_one_for_each_matrix():
    cfg = lm.LmConfig(dims=4, window=6, stride=4, classes=7, single=3, own=8)
    rng = np.random.default_rng(5)
    size = sum(math.prod(shape) for shape in lm.shapes(cfg).values())
    w = lm.unflatten(rng.normal(0, 0.7, size), cfg)
    rows, targets = rng.integers(0, 15, (9, 6)), rng.integers(0, 7, (9, 6))

    def log_probs(w):
        x = w["e"][rows] + w["p"]
        q, k, v = (x @ w[name] for name in "qkv")
        a = np.exp(q @ k.transpose(0, 2, 1) * cfg.dims**-0.5) * np.tril(np.ones((6, 6)))
        z = (x + a / a.sum(2, keepdims=True) @ v @ w["o"]) @ w["u"] + w["c"]
        z -= np.log(np.exp(z).sum(2, keepdims=True))
        return np.take_along_axis(z, targets[..., None], 2)[..., 0]

    for scored in (4, 6):
        mask = lm.causal_mask(6, scored).astype(float)
        got = lm.class_log_probs(w, rows, targets[:, 6 - scored :], cfg, mask, lm.score_tables(w, cfg))
        assert np.allclose(got, log_probs(w)[:, 6 - scored :], atol=1e-5)
    real = rng.random((9, 6)) < 0.7
    loss, g = lm.gradient(w, rows, targets, cfg, lm.causal_mask(6, 6).astype(float), real)
    assert abs(loss + log_probs(w)[real].mean()) < 1e-6
    for name, some in lm.unflatten(g, cfg).items():
        for at in list(np.ndindex(some.shape))[::5]:
            up, down = ({**w, name: w[name].copy()} for _ in range(2))
            up[name][at] += 1e-4
            down[name][at] -= 1e-4
            slope = -(log_probs(up)[real].mean() - log_probs(down)[real].mean()) / 2e-4
            assert abs(slope - some[at]) < 1e-4, (name, at)


def test_words_numbered_in_columns_are_those_numbered_one_by_one(monkeypatch):
    from unittest import mock

    rng = random.Random(7)
    texts = [bytes(rng.choices(b" \t\n\x0b\x0c\r\x1c\x85\x00\xa0\xc2AZaz\xff", k=k % 17)) for k in range(400)]
    monkeypatch.setattr(wb, "BLOCK_CHARS", 300)
    monkeypatch.setattr("pyspark.TaskContext", mock.Mock(get=lambda: mock.Mock(partitionId=lambda: 3)))
    want = list(wb.blocks_of(((i, [*x.lower().split(), b""], len(x)) for i, x in enumerate(texts)), 8))
    for kind in (pa.binary(), pa.large_binary()):
        column = pa.array(texts, kind)
        parts = [(lo, column.slice(lo, 90)) for lo in range(0, len(texts), 90)]
        columns = ((list(range(lo, lo + len(x))), *wb.split_column(x, b""), np.array([len(v) for v in x.to_pylist()])) for lo, x in parts)
        got = list(wb.column_blocks(columns, 8))
        assert len(got) > 5 and [(b.name, b.words, b.block.docs, b.payload()) for b in got] == [(b.name, b.words, b.block.docs, b.payload()) for b in want]
        for b in got:
            packets = [(n, wb.pack_lists([b.words[i] for i in some])) for n, some in b.packets()]
            assert [(n, words) for n, words, _ in b.word_packets()] == packets
            assert [b.order[some].tolist() for _, _, some in b.word_packets()] == [some for _, some in b.packets()]
