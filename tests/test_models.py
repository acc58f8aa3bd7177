"""Tokenizers, embedding models, accuracy measures and labels on fixed cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackroom.functions import labels as lb
from stackroom.operators import evaluate as ev
from stackroom.operators import model as mo
from stackroom.operators import search as se
from stackroom.operators import tokenize as tk
from stackroom.plans import model_queries as mq


def test_unigram_takes_the_best_path():
    vocab = [x[0] for x in json.loads(mq.small_unigram())["model"]["vocab"]]
    pieces = lambda text, n=None: [vocab[i] for i in tk.Encoder(mq.small_unigram(), n)([text])[0]]
    assert pieces("The king") == ["<s>", "▁the", "▁", "k", "ing", "</s>"]
    # adjacent unknown characters are one unknown piece
    assert pieces("a 数学") == ["<s>", "▁", "a", "▁", "<unk>", "</s>"]
    assert pieces("the the the", 4) == ["<s>", "▁the", "▁the", "</s>"]
    assert pieces("the", 2) == pieces("the", 1) == ["<s>", "</s>"]


def test_bpe_falls_back_to_bytes():
    ids = json.loads(mq.small_bpe())["model"]["vocab"]
    names = {i: t for t, i in ids.items()}
    got = [names[i] for i in tk.Encoder(mq.small_bpe(), None)(["ba cé"])[0]]
    assert got == ["<s>", "ba", "▁", "c", "<0xC3>", "<0xA9>", "</s>"]
    # the string of a special token is ordinary text
    assert [names[i] for i in tk.Encoder(mq.small_bpe(), None)(["<s>"])[0]] == ["<s>", "<0x3C>", "s", "<0x3E>", "</s>"]


def test_tokenize_keeps_rows_and_columns(spark):
    rows = [(1, "the", "x"), (2, None, "y"), (3, "", "z"), (4, " ".join(["the"] * 50_000), "w")]
    df = spark.createDataFrame(rows, "a long, text string, IDS string")
    got = {r["a"]: r["ids"] for r in tk.tokenize(df, "text", mq.small_unigram(), None).collect()}
    assert got[2] == got[3] == [0, 2] and len(got[4]) == 50_002 and len(got[1]) == 3
    assert tk.tokenize(df.limit(0), "text", mq.small_bpe()).collect() == []
    with pytest.raises(ValueError):
        tk.tokenize(df, "text", json.dumps({"model": {"type": "WordPiece"}}))


def _field(number: int, value) -> bytes:
    """One field of a protobuf message."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    data = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(data)) + data


def lookup_model(table: np.ndarray) -> bytes:
    """An ONNX model that looks up token vectors."""
    value = lambda name, kind, dims: _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, b"".join(_field(1, _field(2, d)) for d in dims))))
    weights = b"".join(_field(1, n) for n in table.shape) + _field(2, 1) + _field(8, "table") + _field(9, table.astype("<f4").tobytes())
    node = _field(1, "table") + _field(1, "input_ids") + _field(2, "last_hidden_state") + _field(4, "Gather")
    graph = _field(1, node) + _field(2, "g") + _field(5, weights) + _field(11, value("input_ids", 7, "bn")) + _field(12, value("last_hidden_state", 1, "bnd"))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13))


def test_onnx_vectors(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    table = np.random.default_rng(1).normal(size=(400, 5)).astype(np.float32)
    (tmp_path / "m.onnx").write_bytes(lookup_model(table))
    (tmp_path / "t.json").write_text(mq.small_unigram())
    texts = ["the king", "a", None, "abc def ghi", "the king"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    spec = mo.ModelSpec("toy", max_tokens=5)
    got = {r["id"]: r["vector"] for r in mo.embed_texts(df, "text", spec, str(tmp_path / "m.onnx"), str(tmp_path / "t.json")).collect()}
    encode = tk.Encoder(mq.small_unigram(), 5)
    for i, text in enumerate(texts):
        mean = table[encode([text])[0]].mean(axis=0)
        assert np.allclose(got[i], mean / np.linalg.norm(mean), atol=1e-6)
    same = spark.createDataFrame(list(got.items()), "id int, vector array<float>")
    assert abs(ev.least_cosine(same, same, "id").first()["least"] - 1) < 1e-6


def test_prompts(spark):
    body = mo.body_fields(F.array(F.lit("A"), F.lit("B")), F.array().cast("array<string>"), F.lit(" "), F.lit("text {title}"))
    row = spark.range(1).select(mo.query_prompt(mo.SPECS["embeddinggemma"], F.lit("q")).alias("q"), body.alias("b"), mo.document_prompt(mo.SPECS["e5-small"], F.lit("T"), body).alias("d")).first()
    assert row["q"] == "task: search result | query: q" and row["b"] == "A, B\ntext {title}" and row["d"] == "passage: T. A, B\ntext {title}"


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=40_000).round(2), "b": np.repeat([1.0, 2.0], [30_000, 10]), "c": np.array([5.0]), "d": rng.integers(0, 7, 1001).astype(float)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8).cache()
    for p in (0.0, 0.01, 0.5, 0.95, 1.0):
        got = {r["g"]: r["v"] for r in ev.floor_percentile(df, "g", "v", p).collect()}
        assert got == {k: np.sort(vs)[min(len(vs) - 1, int(p * len(vs)))] for k, vs in values.items()} | {None: 3.0}
    assert ev.upper_median(df.limit(0), "g", "v").collect() == []


def test_names_and_labels(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(ev.same_name(F.lit("Smith, John"), F.lit("JOHN smith"))) and not one(ev.same_name(F.lit("Smith"), F.lit("John Smith")))
    assert one(ev.same_date(F.lit("1999-01"), F.lit("1999"))) and not one(ev.same_date(F.lit("99"), F.lit("99")))
    assert one(lb.size_label(F.lit(2_621_440))) == "2.5 MB" and one(lb.element_label(F.lit("title"))) == "Title" and one(lb.import_summary(F.lit(0), F.lit(0))) == ""


def test_another_ranker_replaces_vectors(spark):
    parsed = se.parse_queries(spark.createDataFrame([(1, "soup kitchen"), (2, "type:video soup")], "query_id int, raw string"))
    rows = spark.createDataFrame([(i, "soup" if i == 1 else "lease", "book" if i < 3 else "video", "2001") for i in range(1, 5)], "record_id int, title string, media_type string, date string")
    rows = rows.withColumns({"creator": F.lit(""), "text": F.lit(""), "added_at": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")})
    from stackroom.operators import index as ix

    near = spark.createDataFrame([(1, 2, 0.9), (1, 1, 0.1), (2, 2, 0.9), (2, 4, 0.8)], "query_id int, record_id int, score double")
    hits = se.hybrid(parsed, rows, ix.postings(rows), ix.docstats(rows), near=mo.semantic_ranking(near)).collect()
    assert {(r["query_id"], r["rank"], r["record_id"]) for r in hits} == {(1, 1, 1), (1, 2, 2), (2, 1, 4)}
