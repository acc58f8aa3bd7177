"""The registered queries on a whole test table, against values made row by row without Spark."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import xxhash

from stackroom.llm import bpe, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF).collect()}


def test_op1_payloads(spark, texts):
    got = rows(spark, "op1_audio_features")
    assert got.keys() == texts.keys()
    by_text = {}
    for i, t in texts.items():
        data = t.encode()
        whole = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(whole), hashlib.sha256(whole).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(whole[-16:])
        assert by_text.setdefault(t, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_op3_fingerprints(spark, texts):
    got = rows(spark, "op3_simhash_groups")
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        words = t.encode().lower().split()
        some = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = np.array([xxhash.xxh64_intdigest(x, 42) for x in some], np.uint64)
        bits = [(hashes >> np.uint64(b) & np.uint64(1)).sum() * 2 > len(some) for b in range(64)]
        assert got[i]["fingerprint"] == f"{sum(1 << b for b in range(64) if bits[b]):016x}"
    fps = {i: int(r["fingerprint"], 16) for i, r in got.items()}
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(fps):
        for j in sorted(fps):
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert all(r["component_id"] == find(i) for i, r in got.items())


def test_op5_ids(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path(queries.WORD_BPE))
    got, start = rows(spark, "op5_token_files"), 0
    assert got.keys() == texts.keys()
    for i in sorted(texts):
        ids = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op6_ids(spark, texts):
    import tiktoken

    ranks = bpe.load_ranks(P.path(queries.BYTE_BPE))
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(spark, "op6_byte_bpe")
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = np.array(enc.encode_ordinary(t), "<u4")
        r = got[i]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_op9_counts(spark, texts):
    got = rows(spark, "op9_quality_verdicts")
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        words = t.encode().split()
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        many = Counter(windows)
        again = {j for k, w in enumerate(windows) if many[w] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.encode().split(b"\n") if x.split()]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(again))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(again) > 50 * len(words)) and not (r["base_failed"] and r["kept"])


def test_op7_meets_its_targets(spark, texts):
    got = rows(spark, "op7_mixing_rates").values()
    assert len(got) == len(texts)
    total = {d: sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in got) for d in ("good", "poor", "toxic")}
    whole = sum(total.values())
    shares = [total[d] / whole for d in ("good", "poor", "toxic")]
    # some documents are toxic to a degree, so the target of 0 is missed by what the query says
    gap = {r["target_gap"] for r in got}.pop()
    assert gap < 0.006 and np.allclose(shares, [0.95, 0.05, 0.0], atol=1.5 * gap), (gap, shares)
    assert all(r["rate"] >= 0 and abs(r["p_good"] + r["p_poor"] + r["p_toxic"] - 1) < 1e-9 for r in got)
