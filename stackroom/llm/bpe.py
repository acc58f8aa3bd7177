"""Byte-level BPE: a global shuffle of distinct words, and decoding by the token-byte table.

Texts are cut into pre-tokens by the ranks' pattern. Blocks of documents keep their
pre-tokens as numbers in order of position (see ``wordblocks``); each block's distinct
pre-tokens are dealt by checksum to buckets, where each distinct word of the whole
corpus is encoded once. The ids return to their blocks in packets, and documents are
put together again by position. A frequent word is one entry of each block, so no key
is hot, and texts themselves are not shuffled.

Decoding joins ids to the table of token bytes: a vocabulary file, whose size bounds
what is broadcast. The join is by whole Arrow columns, next to the ids: a row for each
id and a shuffle to bring a document's rows together again would move many times the text.
An encoder that is given the table joins the ids where it has read them back: a decoder behind
it would take a second Python worker for each running task.

Cases: a text of more than LONG_TEXT characters is cut by an iterator, with the same result; null text counts as empty and has no ids; repeated rows are encoded as often as
they come; an id that the table lacks makes the decoded value null; other columns are
ignored by the encoder and kept by the decoder.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from stackroom.llm import wordblocks as wb
from stackroom.shared import materialize, open_store, scratch, wide_rows

#: A text that is longer is cut by an iterator, so its pre-tokens are never all in memory.
LONG_TEXT = 4_000_000
#: Pre-tokens of a block that are put in place at a time.
PART = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(2)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def pre_tokens(text: str, pattern: str) -> Iterator[str]:
    split = _splitter(pattern)
    return iter(split.findall(text)) if len(text) <= LONG_TEXT else (m.group() for m in split.finditer(text))


_ENCODERS: dict = {}


def _encoder(ranks: dict[bytes, int], pattern: str):
    """tiktoken's encoder of these ranks, one for each worker process and rank table."""
    import tiktoken

    key = (pattern, hash(frozenset(ranks.items())))
    if key not in _ENCODERS:
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def encode_bpe(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", tokens: DataFrame | None = None
) -> DataFrame:
    """(id, ids) of each row: ids are little-endian unsigned 32-bit numbers in one binary value. With a token-byte table
    (id, token) there is decoded too, as decode_bpe gives it.

    Texts are cut once. The tasks that cut them write their blocks' positions into a file each, and a
    table of packets; as that table names the files, and holds only what tasks that succeeded have said,
    it makes no difference should a task run twice or see its rows in another order.
    """
    spark = docs.sparkSession
    wide_rows(spark)
    vocabulary = spark.sparkContext.broadcast(ranks)
    buckets = wb.bucket_count(spark, docs)
    folder = scratch(spark, "positions")
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = source.schema["id"].dataType
    batch_type = to_arrow_type(id_type)
    packet = "block string, bucket int, payload binary"
    head = [T.StructField("docs", T.ArrayType(id_type)), T.StructField("path", T.StringType()), T.StructField("start", T.LongType()), T.StructField("size", T.LongType())]
    schema = T.StructType([T.StructField("block", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("payload", T.BinaryType()), *head])

    def rows_of(batches: Iterator) -> Iterator:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    yield doc, pre_tokens(text, pattern), len(text)

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        name, start, out = f"{uuid.uuid4().hex}.blocks", 0, None
        try:
            for block in wb.blocks_of(rows_of(batches), buckets):
                if out is None:
                    fs, root = open_store(folder)
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                payload = block.payload()
                out.write(payload)
                cells = [(-1, None), *[(b, wb.pack_lists([block.words[i] for i in some])) for b, some in block.packets()]]
                rest = [None] * (len(cells) - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block.name] * len(cells), pa.string()),
                        pa.array([c[0] for c in cells], pa.int32()),
                        pa.array([c[1] for c in cells], pa.binary()),
                        pa.array([block.block.docs, *rest], pa.list_(batch_type)),
                        pa.array([f"{folder}/{name}", *rest], pa.string()),
                        pa.array([start, *rest], pa.int64()),
                        pa.array([len(payload), *rest], pa.int64()),
                    ],
                    names=schema.names,
                )
                start += len(payload)
        finally:
            if out is not None:
                out.close()

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        one = _encoder(vocabulary.value, pattern).encode_ordinary
        known, now = {}, None
        for batch in batches:
            out = []
            for bucket, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bucket != now:
                    known, now = {}, bucket
                ids = []
                for word in wb.unpack_words(payload):
                    if (got := known.get(word)) is None:
                        got = known[word] = np.array(one(word.decode()), "<u4").tobytes()
                    ids.append(got)
                flat = np.frombuffer(b"".join(ids), "<u4")
                sizes = wb.pack_numbers(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
                out.append(len(sizes).to_bytes(4, "little") + sizes + wb.pack_numbers(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["block", "bucket", "payload"])

    join = None if tokens is None else _token_join(tokens)
    results = ["ids"] if join is None else ["ids", "decoded"]
    out_schema = T.StructType([T.StructField(id_col, id_type), *[T.StructField(c, T.BinaryType()) for c in results]])

    def assemble(table):
        import numpy as np
        import pyarrow as pa

        table = table.take(np.argsort(table.column("bucket").to_numpy(), kind="stable"))
        packets = table.column("payload").slice(1).to_pylist()
        docs_of, path, start, size = (table.column(f.name)[0].as_py() for f in head)
        fs, where = open_store(path)
        with fs.open_input_file(where) as file:
            sizes, numbers, dealt = wb.read_payload(file.read_at(size, start))
        got_sizes, got_ids = [np.zeros(0, "<u4")], [np.zeros(0, "<u4")]
        for payload in packets:
            n = int.from_bytes(payload[:4], "little")
            got_sizes.append(wb.unpack_numbers(payload[4 : 4 + n]))
            got_ids.append(wb.unpack_numbers(payload[4 + n :]))
        packed, flat = np.concatenate(got_sizes), np.concatenate(got_ids)
        if len(packed) != len(dealt):
            raise ValueError("a block's words and their packets differ")
        place = np.empty(len(dealt), np.int64)
        place[wb.packet_order(dealt)] = np.arange(len(dealt))
        ends = np.cumsum(sizes, dtype=np.int64)
        cells, lo, at = [], 0, 0
        while lo < len(ends):  # about PART words at a time: not all of a block's ids at once
            hi = max(lo + 1, int(np.searchsorted(ends, at + PART, "right")))
            ids, some = wb.gather_lists(packed, flat, place[numbers[at : ends[hi - 1]]])
            upto = np.concatenate(([0], np.cumsum(some)))[np.concatenate(([at], ends[lo:hi])) - at] * 4
            data = pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
            cells.append(pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(upto.astype(np.int32)), data]))
            lo, at = hi, int(ends[hi - 1])
        made = [cells] if join is None else [cells, [join(c) for c in cells]]
        arrays = [pa.array(docs_of, batch_type), *[pa.chunked_array(x, pa.binary()) for x in made]]
        return pa.table(arrays, names=out_schema.names)

    blocks = materialize(source.mapInArrow(cut, schema), "packets")
    dealt = blocks.where("bucket >= 0").select("block", "bucket", "payload").repartition("bucket").sortWithinPartitions("bucket")
    back = dealt.mapInArrow(encode, packet).withColumns({f.name: F.lit(None).cast(f.dataType) for f in head})
    return blocks.where("bucket < 0").union(back).groupBy("block").applyInArrow(assemble, out_schema)


def token_table(spark, ranks: dict[bytes, int]) -> DataFrame:
    """The token-byte table (id, token); it is as large as a vocabulary file. Made from Arrow columns: rows would go
    through Python workers of another kind, which stay beside the others on executors."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table({"id": pa.array(ranks.values(), pa.int64()), "token": pa.array(ranks.keys(), pa.binary())}))


def _token_join(tokens: DataFrame, most: int = 1 << 22) -> Callable:
    """A function that joins an Arrow column of ids to the token-byte table, which every task has: the bytes of each value's ids."""
    import numpy as np
    import pyarrow as pa

    held = tokens.select(F.col("id").cast("long"), F.col("token").cast("binary")).limit(most + 1).toArrow()
    known = held.column(0).to_numpy()
    if len(known) > most or len(known) and not 0 <= known.min() <= known.max() < 16 * most:
        raise ValueError("the token-byte table is no vocabulary")
    place = np.full(int(known.max(initial=0)) + 2, -1, np.int32)
    place[known] = np.arange(len(known))
    table = tokens.sparkSession.sparkContext.broadcast((place, held.column(1).cast(pa.binary()).combine_chunks()))

    def join(column):
        place, token = table.value
        cells = column.to_pylist()
        sizes = np.fromiter((len(x or b"") // 4 for x in cells), np.int64, len(cells))
        ids = np.frombuffer(b"".join(x or b"" for x in cells), "<u4")
        row = place.take(np.minimum(ids, len(place) - 1))
        lost = row < 0
        upto = np.concatenate(([0], np.cumsum(sizes)))
        bad = np.diff(np.concatenate(([0], np.cumsum(lost)))[upto]) > 0
        bad |= np.fromiter((x is None for x in cells), bool, len(cells))
        # the ids that picked a row, in order: their tokens' bytes are one buffer, cut where documents end
        joined = token.take(pa.array(row[~lost] if lost.any() else row))
        there = np.concatenate(([0], np.cumsum(~lost)))[upto]
        ends = np.frombuffer(joined.buffers()[1], np.int32)[: len(joined) + 1] if len(joined) else np.zeros(1, np.int32)
        data = joined.buffers()[2] if len(joined) else pa.py_buffer(b"")
        valid = pa.py_buffer(np.packbits(~bad, bitorder="little"))
        return pa.Array.from_buffers(pa.binary(), len(cells), [valid, pa.py_buffer(np.ascontiguousarray(ends[there])), data])

    return join


def decode_bpe(encoded: DataFrame, tokens: DataFrame, ids_col: str = "ids", out: str = "decoded", most: int = 1 << 22) -> DataFrame:
    """encoded joined to the token-byte table (id, token) by each of its ids: the ids' bytes, one after the other.

    The join takes whole Arrow columns: every id of a batch picks its row of the table, which every
    task has. A table of more than `most` rows is refused, so what is broadcast is bounded. A column
    named out is replaced.
    """
    join = _token_join(tokens, most)
    source = encoded.drop(out)
    at = source.columns.index(ids_col)
    schema = T.StructType([*source.schema, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, join(batch.column(at))], names=[*batch.schema.names, out])

    return source.mapInArrow(run, schema)
