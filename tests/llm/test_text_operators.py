"""Audio, URL, chat, token file, BPE and WARC operators against brute force and exact round trips."""

import base64
import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from stackroom.llm import audio, bpe, chat, queries, tokenfile, urls, warc

TRICKY = [
    None, "", " ", "a", "plain words here.", "</s>[INST] x [/INST]\\ <\\/s>", "Ünïcode — ßéñ 😀 ́ \x1c\x85\xa0 don't  you'll\n\n 12 ab\t", "x" * 3000, "same", "same",
]


def docs(spark, texts=TRICKY):
    """Ids with a null, a repeated row, and columns with names that operators use themselves."""
    rows = [(i if i != 3 else None, t, "c", 1) for i, t in enumerate(texts)] + [(0, texts[0], "c", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, media int")


def test_audio_round_trip_and_equal_texts(spark):
    df = docs(spark).select("doc_id", "text", audio.wav_column(audio.padded_payload(F.col("text"))).alias("media"))
    rows = audio.audio_features(df, "media", ["doc_id", "text"]).collect()
    for r in rows:
        data = (r["text"] or "").encode()
        padded = data.ljust(max(192, -(-len(data) // 192) * 192))
        assert r["pcm_bytes"] == len(padded) and r["pcm_sha256"] == hashlib.sha256(padded).hexdigest()
        assert r["pcm_tail_crc32"] == zlib.crc32(padded[-16:])
        table = audio.read_patches(r["tensors"])
        assert table.schema.field("tensor").type.shape == [32, 20] and sum(table["frames"].to_pylist()) == r["frames"]
    same = {bytes(r["tensors"]) for r in rows if r["text"] == "same"}
    assert len(same) == 1


def test_resampler_is_the_direct_sum_and_blocks_agree():
    cfg = audio.AudioConfig()
    x = np.random.default_rng(1).integers(0, 256, 3000).astype(np.uint8)
    c, signal = cfg.half_taps * 4, (x.astype(float) - 128) / 128
    k = np.arange(-c, c + 1)
    h = np.sinc(k / 4) / 4 * np.kaiser(2 * c + 1, 8.0)
    h *= cfg.up / h.sum()
    want = [sum(signal[i] * h[n * 4 - i * 3 + c] for i in range(len(x)) if 0 <= n * 4 - i * 3 + c <= 2 * c) for n in range(50, 80)]
    assert np.allclose(audio.resample(x, 50, 30, cfg), want, atol=1e-5)
    small = audio.AudioConfig(block_frames=3)
    assert np.allclose(audio.log_mel(x, cfg)[0], audio.log_mel(x, small)[0], atol=1e-4)


def test_hysteresis():
    cfg = audio.AudioConfig()
    spans = audio.segments(np.array([0, 0, 7, 4, 7, 1, 4, 0.0]), cfg)
    assert [round(a / 0.01) for a, _ in spans] == [2] and len(spans) == 1


URLS = [None, "", "no scheme", "https://Shop.EXAMPLE.com/en/7/x?q", "http://x.com/en/", "http://com/en/a", "http://xcom/en/", "http://a.example.net/de/81", "http://b.net/de/", "http://b.org/es/", "http://b.org?/es/", "http://www.cheap-pills.a/x", "http://not-cheap-pills.a/x", "http://h/wp-login.php", "http://h/wp-login.php?x", "ftp://h\nx/y"]


def brute_verdict(url, prefixes):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), v, h + p) for v, h, p in prefixes if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[2], max(fits)[1]
    labels = ["." + host][0]
    bad = ".cheap-pills." in labels or (host + path).endswith("/wp-login.php")
    return host, path, None, "block" if bad else "allow"


def test_url_verdicts_against_brute_force(spark):
    prefixes = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    rules = [*[urls.prefix_rule(*p) for p in prefixes], urls.Rule("||cheap-pills.", "block"), urls.Rule("/wp-login.php|", "block")]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(0, None, "x")], "page_id long, url string, verdict string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df, rules).collect()}
    assert got == {(i, *brute_verdict(u, prefixes)) for i, u in enumerate(URLS)}
    assert urls.judge_urls(df.limit(0), rules).count() == 0


def test_the_query_has_the_rules_of_its_contract():
    """Verdict, host and path of each rule, as the contract lists them."""
    from stackroom.llm import queries

    contract = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    assert queries.HOST_RULES == [urls.prefix_rule(*x) for x in contract]


def test_rule_tokens_are_whole():
    assert urls.rule_keys("||example.com/en/7") == ["=com", "=en", "=example"]
    assert urls.rule_keys("pills") == [""] and urls.rule_keys("/a*b/") == ["$b", "^a"] and urls.rule_keys("/ab/*") == ["=ab"]
    assert urls.rule_keys("||casino*.") == ["^casino"]


def test_the_index_loses_no_rule(spark):
    """Random rules and URLs: what the index fetches decides as all rules do."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abA1", k=rng.randint(1, 3)))
    glue = ("/", ".", "-", "*", "^", "", "_")
    rules = [urls.Rule(rng.choice(("", "|", "||")) + "".join(word() + rng.choice(glue) for _ in range(rng.randint(1, 3))) + rng.choice(("", "|")), rng.choice(("allow", "block")), rng.randint(0, 2)) for _ in range(60)]
    links = [f"http://{word()}.{word()}/{word()}{rng.choice('/.-_')}{word()}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(links)), "page_id long, url string")
    plain = [(r, re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), urls.rule_regex(r.pattern)).replace(r"\z", r"\Z"))) for r in rules]
    for row in urls.judge_urls(df, rules).collect():
        target = row["host"] + row["path"]
        fits = [(r.tier, -len(r.pattern), r.verdict, r.pattern) for r, p in plain if p.search(target)]
        assert (row["pattern"], row["verdict"]) == ((min(fits)[3], min(fits)[2]) if fits else (None, "allow"))
    assert {r["verdict"] for r in urls.judge_urls(df, []).collect()} == {"allow"}
    with pytest.raises(ValueError):
        urls.judge_urls(df.withColumnRenamed("page_id", "host"), rules, "host")


def test_chat_reads_back_everything(spark):
    rows = [(1, 0, "user", TRICKY[5]), (1, 1, "assistant", "</s>"), (1, 2, "assistant", None), (1, 3, "user", "end"), (2, 0, "we\nird<s>", "x"), (None, 1, None, "q"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, rows int")
    examples = chat.format_examples(df)
    got = {r["conv_id"]: r for r in chat.read_conversations(examples).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", TRICKY[5]), ("assistant", "</s>"), ("assistant", ""), ("user", "end")]
    assert got[1]["replies"] == ["</s>", ""] and got[2]["replies"] == [] and got[3]["replies"] == ["a", "a"]
    assert got[2]["turns"][0]["role"] == "we\nird<s>" and got[None]["turns"][0]["text"] == "q"
    one = [r for r in examples.collect() if r["conv_id"] == 1]
    assert len(one) == 3 and all(r["formatted"].count("</s>") == r["target"] + (r["target"] < 4) for r in one)
    assert chat.read_conversations(chat.format_examples(df.limit(0))).count() == 0


def test_elias_fano_select():
    rng = random.Random(3)
    for n, top in ((0, 0), (1, 0), (1, 10**9), (5, 5), (2000, 3_000_000), (3000, 40)):
        v = sorted(rng.randint(0, top) for _ in range(n))
        ef = tokenfile.EliasFano.from_bytes(tokenfile.EliasFano.encode(v).to_bytes())
        assert ef.run(0, n).tolist() == v and [ef.select(i) for i in range(n)] == v
        for _ in range(20):
            lo = rng.randint(0, n)
            hi = rng.randint(lo, n)
            assert ef.run(lo, hi).tolist() == v[lo:hi]
    assert tokenfile.EliasFano.encode(range(0, 4_000_000, 400)).nbytes < 10_000 * 2
    with pytest.raises(IndexError):
        ef.select(3000)


def test_token_files_round_trip(spark):
    spec = open(P.path("word_bpe_49k.json"), "rb").read()
    tokenizer = tokenfile._encoder(spec).tokenizer
    df = docs(spark)
    manifest = tokenfile.write_token_files(df, spec, 1)
    got = sorted(tokenfile.read_token_files(manifest).collect(), key=lambda r: (r["start"]))
    assert [r["doc_id"] for r in got] == sorted([r["doc_id"] for r in df.collect()], key=lambda x: (x is not None, x or 0))
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    at = 0
    for r in got:
        want = [*tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1]
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and (r["start"], r["n_tokens"]) == (at, len(want))
        at += len(want)
    empty = tokenfile.read_token_files(tokenfile.write_token_files(df.limit(0), spec, 1))
    assert empty.count() == 0


def test_byte_bpe_is_tiktoken(spark):
    import tiktoken

    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = docs(spark)
    tokens = bpe.token_table(spark, ranks)
    rows = bpe.decode_bpe(bpe.encode_bpe(df, ranks, P.PATTERN), tokens).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    assert len(rows) == len(TRICKY) + 1
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == enc.encode_ordinary(texts[r["doc_id"]])
        assert bytes(r["decoded"]).decode() == texts[r["doc_id"]]
    assert bpe.encode_bpe(df.limit(0), ranks, P.PATTERN).count() == 0
    # ids that the table lacks, no ids, and a table with gaps
    odd = spark.createDataFrame([(bytearray(b"\xff\xff\xff\x00"),), (None,), (bytearray(b""),), (bytearray(b"\x07\0\0\0\x02\0\0\0"),)], "ids binary").coalesce(1)
    few = spark.createDataFrame([(7, bytearray(b"seven")), (2, bytearray(b"")), (9, bytearray(b"x"))], "id long, token binary")
    assert [r["decoded"] for r in bpe.decode_bpe(odd, few).collect()] == [None, None, b"", b"seven"]
    assert [r["decoded"] for r in bpe.decode_bpe(odd, few.limit(0)).collect()] == [None, None, b"", None]


def test_byte_bpe_takes_one_python_worker_for_a_task(spark):
    """An encoder that is given the tokens decodes in its own last step, and the tokens are no rows of Python workers."""
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    tokens = bpe.token_table(spark, ranks)
    assert "ExistingRDD" not in tokens._jdf.queryExecution().toString()
    assert {(r["id"], bytes(r["token"])) for r in tokens.collect()} == {(i, token) for token, i in ranks.items()}
    df = docs(spark)
    plan = queries.bpe_digests(df)._jdf.queryExecution().executedPlan().toString()
    steps = re.findall(r"\w*Exchange|\w+InArrow", plan.partition("Initial Plan")[0])
    assert "FlatMapGroupsInArrow" in steps
    assert not any("InArrow" in a and "InArrow" in b for a, b in zip(steps, steps[1:]))
    key = lambda r: (str(r["doc_id"]), bytes(r["ids"]), None if r["decoded"] is None else bytes(r["decoded"]))
    for table in (tokens, tokens.where("id <> 97"), tokens.limit(0)):
        got, want = bpe.encode_bpe(df, ranks, P.PATTERN, tokens=table), bpe.decode_bpe(bpe.encode_bpe(df, ranks, P.PATTERN), table)
        assert got.columns == want.columns == ["doc_id", "ids", "decoded"]
        assert sorted(map(key, got.collect()), key=str) == sorted(map(key, want.collect()), key=str)


def test_byte_bpe_of_rows_in_no_fixed_order(spark):
    """Rows that come from a shuffle are cut once, so a scan in another order can't part words from their blocks."""
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    df = spark.createDataFrame([(i, f"word{i % 97} and text {i}" * (i % 5)) for i in range(3000)], "doc_id long, text string")
    df = df.orderBy(F.rand()).repartition(7).withColumn("ids", F.lit("clash"))
    rows = bpe.decode_bpe(bpe.encode_bpe(df, ranks, P.PATTERN), bpe.token_table(spark, ranks)).collect()
    assert {(r["doc_id"], bytes(r["decoded"]).decode()) for r in rows} == {(i, f"word{i % 97} and text {i}" * (i % 5)) for i in range(3000)}


def test_warc_round_trip(spark):
    pages = [(i, f"http://h/{i}\r\n é", t) for i, t in enumerate(TRICKY)] + [(None, None, "same"), (None, "u", "only"), (9, "again", "same")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(df).collect()]
    best = {}
    for i, _, t in pages:
        best[t or ""] = max([x for x in (best.get(t or ""), i) if x is not None], default=None)
    want = []
    for i, _, t in pages:
        data, top = (t or "").encode(), best[t or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        own = i == top or top is None
        want.append((i, len(data), digest, "response" if own else "revisit", None if own else top))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_inflate_pieces_members_and_cuts():
    data = bytes(random.Random(1).choices(b"abc\n", k=3_000_000))
    one = zlib.compressobj(1, zlib.DEFLATED, 31)
    packed = one.compress(data) + one.flush()
    assert b"".join(warc.inflate(io.BytesIO(packed + packed))) == data * 2
    with pytest.raises(ValueError):
        list(warc.inflate(io.BytesIO(packed[:-20])))
