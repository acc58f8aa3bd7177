"""Embedding models in ONNX files: the text a model sees, its vectors, and stale ones.

Files of a model go to the executors with ``addFile``; each Python worker opens a model once.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.functions import text as tx
from stackroom.functions.identifiers import document_signature
from stackroom.operators.tokenize import encoder, read_settings
from stackroom.shared import fresh

BODY_CHARS = 6_000


@dataclass(frozen=True)
class ModelSpec:
    """What is fixed about a model: prompts, length of the input and how token vectors are pooled."""

    name: str
    query_template: str = "{q}"
    document_template: str = "{title} {text}"
    #: "mean" of the token vectors, or "sentence" for a model with an output of that kind.
    pooling: str = "mean"
    max_tokens: int = 512


# The prompts of two public models.
SPECS = {
    "e5-small": ModelSpec("multilingual-E5-small", "query: {q}", "passage: {title}. {text}", "mean"),
    "embeddinggemma": ModelSpec("EmbeddingGemma 300M", "task: search result | query: {q}", "title: {title} | text: {text}", "sentence"),
}


def query_prompt(spec: ModelSpec, query: Column) -> Column:
    return F.replace(F.lit(spec.query_template), F.lit("{q}"), query)


def body_fields(creators: Column, subjects: Column, description: Column, text: Column) -> Column:
    """Creators, subjects, description and the start of the body, a line each; blank ones are left out."""
    parts = F.array(F.array_join(creators, ", "), F.array_join(subjects, "; "), description, F.substring(text, 1, BODY_CHARS))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (tx.trim(p) != "")), "\n")


def document_prompt(spec: ModelSpec, title: Column, body: Column) -> Column:
    # taken apart first: a title may hold the other's mark
    parts = {"{title}": F.coalesce(title, F.lit("")), "{text}": F.coalesce(body, F.lit(""))}
    return F.concat(*[parts.get(x, F.lit(x)) for x in re.split(r"(\{title\}|\{text\})", spec.document_template)])


def signature(title: Column, body: Column) -> Column:
    """What a stored vector is compared by: it is stale when this changes."""
    return document_signature(F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))


class OnnxModel:
    """Unit vectors of texts. Texts with equally many ids run together, so nothing is padded."""

    def __init__(self, spec: ModelSpec, model_path: str, settings: str) -> None:
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.intra_op_num_threads = 1
        self.spec, self._encode = spec, encoder(settings, spec.max_tokens)
        self._session = ort.InferenceSession(model_path, options, providers=["CPUExecutionProvider"])
        self._inputs = {x.name for x in self._session.get_inputs()}
        self._outputs = [x.name for x in self._session.get_outputs()]

    def _run(self, ids):
        import numpy as np

        feeds = {"input_ids": ids, "attention_mask": np.ones_like(ids), "token_type_ids": np.zeros_like(ids)}
        whole = self.spec.pooling == "sentence" and "sentence_embedding" in self._outputs
        wanted = "sentence_embedding" if whole else "last_hidden_state" if "last_hidden_state" in self._outputs else self._outputs[0]
        (got,) = self._session.run([wanted], {k: v for k, v in feeds.items() if k in self._inputs})
        v = (got if whole else got.mean(axis=1)).astype(np.float64)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, size, out=np.zeros_like(v), where=size > 0).astype(np.float32)

    def __call__(self, texts: list[str | None], block: int = 32) -> list:
        import numpy as np

        all_ids, out = self._encode(texts), [None] * len(texts)
        lengths: dict[int, list[int]] = {}
        for i, ids in enumerate(all_ids):
            lengths.setdefault(len(ids), []).append(i)
        for n, places in lengths.items():
            for at in range(0, len(places), block):
                part = places[at : at + block]
                # a text without any id has no token vectors: null
                vectors = self._run(np.array([all_ids[i] for i in part], np.int64)) if n else [None] * len(part)
                for i, v in zip(part, vectors, strict=True):
                    out[i] = v
        return out


@functools.lru_cache(2)
def _opened(spec: ModelSpec, model_path: str, settings_path: str) -> OnnxModel:
    return OnnxModel(spec, model_path, read_settings(settings_path))


def embed_texts(df: DataFrame, text_col: str, spec: ModelSpec, model_path: str, settings_path: str, extra_files: tuple[str, ...] = (), out: str = "vector") -> DataFrame:
    """df with the model's vector (floats) of a text column, which holds prompts; null for texts without ids."""
    context = df.sparkSession.sparkContext
    for path in (model_path, settings_path, *extra_files):
        context.addFile(path)
    names = [os.path.basename(model_path), os.path.basename(settings_path)]
    kept = [c for c in df.columns if c.lower() != out.lower()]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias(fresh(kept, "text_")))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        embed = _opened(spec, *[SparkFiles.get(n) for n in names])
        for batch in batches:
            vectors = pa.array(embed(batch.column(batch.num_columns - 1).to_pylist()), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], names=schema.names)

    return source.mapInArrow(run, schema)


def semantic_ranking(similar: DataFrame, top: int = 20) -> DataFrame:
    """The first records of each query as scores that fuse like any list: top for the first, down to 1."""
    from stackroom.operators.search import ranked

    return ranked(similar, top).select("query_id", "record_id", (F.lit(float(top + 1)) - F.col("rank")).alias("score"))
