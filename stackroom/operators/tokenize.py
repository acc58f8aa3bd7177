"""Sub-word ids of texts by a model's settings file (JSON), for models of the kinds Unigram and BPE.

The tokenizers library reads the settings: normaliser, pre-tokenizer, byte fallback and the
template of special tokens are those of the file. Texts run in Arrow batches.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.shared import fresh, wide_rows

KINDS = ("Unigram", "BPE")
#: Settings are broadcast; larger ones are refused.
MAX_SETTINGS = 128 << 20


class Encoder:
    """Encodes texts to at most max_length ids, special tokens included; strings of special tokens are ordinary text."""

    def __init__(self, settings: str, max_length: int | None = 512) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(settings)
        self._tokenizer.no_padding()
        self._tokenizer.no_truncation()
        self._tokenizer.encode_special_tokens = True
        if max_length is not None:
            room = max(max_length, self._tokenizer.num_special_tokens_to_add(False))
            self._tokenizer.enable_truncation(room)

    def __call__(self, texts: list[str | None]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch([x or "" for x in texts])]


@functools.lru_cache(4)
def encoder(settings: str, max_length: int | None = 512) -> Encoder:
    return Encoder(settings, max_length)


def checked(settings: str) -> str:
    """settings, if they are of a known kind and small enough to broadcast."""
    if len(settings) > MAX_SETTINGS:
        raise ValueError(f"settings of {len(settings)} characters are over the limit of {MAX_SETTINGS}")
    kind = json.loads(settings)["model"].get("type")
    if kind not in KINDS:
        raise ValueError(f"tokenizer model {kind!r} is not supported")
    return settings


def read_settings(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return checked(f.read())


def tokenize(df: DataFrame, text_col: str, settings: str, max_length: int | None = 512, out: str = "ids") -> DataFrame:
    """df with the ids of a text column. A null text counts as empty; a column named out is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(checked(settings))
    wide_rows(df.sparkSession)
    kept = [c for c in df.columns if c.lower() != out.lower()]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias(fresh(kept, "text_")))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = encoder(shared.value, max_length)
        for batch in batches:
            ids = pa.array(encode(batch.column(batch.num_columns - 1).to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=schema.names)

    return source.mapInArrow(run, schema)
