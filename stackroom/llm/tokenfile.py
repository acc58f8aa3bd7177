"""Token-id files: one concatenated id array, document boundaries in Elias-Fano code.

A shard file is

    the magic ``STKIDS01``; the ids; the boundary section; the documents' own ids as
    an Arrow stream; a footer of little-endian u64 (bytes of an id, ids, documents, bytes
    of the boundary section, bytes of the Arrow stream) and the magic again.

The boundary section codes the sequence of documents' ends. Elias-Fano splits each of
n values up to u into ``l = floor(log2(u / n))`` low bits, kept verbatim, and a high
part, kept as n ones and at most ``u >> l`` zeros in a bit vector: about 2 + l bits a
document, where a table of offsets takes 64. A select structure holds the position of
every 256th one as a 32-bit number; ``select`` starts there and counts bits within a
few words. Reading goes through it: a batch of documents takes the bits between two
selects, so that offsets of 64 bits exist for the batch at hand alone.

``write_token_files`` range-partitions documents by id, tokenises within the sorted
partitions and writes a shard for each; ``read_token_files`` reads the shards back.

Cases: null text counts as empty and gives the end id alone; documents with equal ids
are ordered by the hash of their text, null ids come first; an empty table writes no
shard, or shards without documents; other columns are ignored; a text of more than TEXT_BLOCK
characters is cut at blanks, and a worker forgets words beyond CACHE_WORDS, both with the same ids. A task that is run again
writes a file of another name, and only files of the written manifest count.
"""

from __future__ import annotations

import itertools
import json
import math
import os
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.shared import deal_files, materialize, open_store, scratch, wide_rows

MAGIC = b"STKIDS01"
FOOT = struct.Struct("<5Q8s")
#: Every so many ones have their position kept.
SAMPLE = 256
#: Documents and ids that are read at a time.
BATCH_DOCS, BATCH_IDS = 512, 1 << 21
#: Words whose ids a Python worker remembers.
CACHE_WORDS = 400_000
#: Characters of a text that are split into words at a time.
TEXT_BLOCK = 1 << 22


class EliasFano:
    """A non-decreasing sequence of numbers with random access."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        import numpy as np

        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def encode(cls, values) -> EliasFano:
        import numpy as np

        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, b"", b"", b"")
        if (np.diff(v.astype(np.int64)) < 0).any():
            raise ValueError("the values decrease")
        low_bits = max(0, int(math.floor(math.log2(max(1, int(v[-1])) / n)))) if int(v[-1]) >= n else 0
        low = b""
        if low_bits:
            shifts = np.arange(low_bits, dtype=np.uint64)
            low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little").tobytes()
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        if ones[-1] >> 32:
            raise ValueError("more documents than one shard's select structure can address")
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def to_bytes(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]
        return struct.pack("<5Q", self.n, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data) -> EliasFano:
        n, low_bits, a, b, c = struct.unpack_from("<5Q", data)
        at = 40
        return cls(n, low_bits, bytes(data[at : at + a]), bytes(data[at + a : at + a + b]), bytes(data[at + a + b : at + a + b + c]))

    def __len__(self) -> int:
        return self.n

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        lo, hi = first >> 3, (first + self.low_bits + 7) >> 3
        value = int.from_bytes(self.low[lo:hi].tobytes(), "little") >> (first & 7)
        return value & ((1 << self.low_bits) - 1)

    def _one(self, i: int) -> int:
        """Where the high bits have the one of value i: from a kept position on, word by word."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return (byte << 3) + (word & -word).bit_length() - 1

    def select(self, i: int) -> int:
        """Value i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return (self._one(i) - i) << self.low_bits | (self._low(i) if self.low_bits else 0)

    def run(self, lo: int, hi: int):
        """Values lo to hi - 1 as an int64 array: only their own bits are read, between two selects."""
        import numpy as np

        if not 0 <= lo <= hi <= self.n:
            raise IndexError((lo, hi))
        if lo == hi:
            return np.zeros(0, np.int64)
        a, b = self._one(lo), self._one(hi - 1)
        bits = np.unpackbits(self.high[a >> 3 : (b >> 3) + 1], bitorder="little")
        ones = np.flatnonzero(bits[a & 7 : b - (a >> 3 << 3) + 1]) + a
        value = (ones - np.arange(lo, hi)) << self.low_bits
        if self.low_bits:
            first, last = lo * self.low_bits, hi * self.low_bits
            bits = np.unpackbits(self.low[first >> 3 : (last + 7) >> 3], bitorder="little")[first & 7 :][: last - first]
            value += bits.reshape(-1, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return value

    @property
    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.samples.nbytes


@dataclass
class TokenShard:
    """An open shard file: documents by number, without a table of offsets. Ids are read when they are asked for."""

    file: object
    width: int
    ends: EliasFano
    names: object

    @classmethod
    def open(cls, file) -> TokenShard:
        """file has size() and read_at(bytes, offset), as pyarrow's files have."""
        import pyarrow as pa

        size = file.size()
        width, n, docs, a, b, magic = FOOT.unpack(file.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC or file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a token-id shard")
        at = len(MAGIC) + n * width
        ends = EliasFano.from_bytes(file.read_at(a, at))
        with pa.ipc.open_stream(pa.py_buffer(file.read_at(b, at + a))) as stream:
            names = stream.read_all().column(0)
        if len(ends) != docs:
            raise ValueError("the boundaries don't match the footer")
        return cls(file, width, ends, names)

    def ids(self, a: int, b: int):
        """Ids a to b - 1 of the concatenated array."""
        import numpy as np

        return np.frombuffer(self.file.read_at((b - a) * self.width, len(MAGIC) + a * self.width), f"<u{self.width}")

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def doc(self, i: int):
        return self.ids(*self.span(i))

    def batches(self, docs: int, ids: int) -> Iterator[tuple]:
        """(first document, starts, ends, ids) of the shard's documents, some at a time: as many as hold
        about that many ids, found by selects, and not more than docs."""
        import numpy as np

        lo, start = 0, 0
        while lo < len(self.ends):
            hi = min(len(self.ends), lo + docs)
            while hi - lo > 1 and self.ends.select(hi - 1) - start > ids:
                hi = lo + (hi - lo) // 2
            ends = self.ends.run(lo, hi)
            yield lo, np.concatenate(([start], ends[:-1])), ends, self.ids(start, int(ends[-1]))
            lo, start = hi, int(ends[-1])


def write_shard(out, docs: Iterable[tuple[list, list[bytes]]], width: int, name_type) -> tuple[int, int, int]:
    """Writes (names, their ids as bytes) to a stream as they come; returns (documents, ids, bytes).

    Only lengths and names stay in memory until the end.
    """
    import numpy as np
    import pyarrow as pa

    lengths, names = [np.zeros(0, np.int64)], []
    out.write(MAGIC)
    for some, ids in docs:
        names.append(pa.array(some, name_type))
        lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)) // width)
        out.write(b"".join(ids))
    ends = np.cumsum(np.concatenate(lengths))
    total = int(ends[-1]) if len(ends) else 0
    boundary = EliasFano.encode(ends).to_bytes()
    table = pa.table({"id": pa.chunked_array(names, name_type)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    tail = sink.getvalue()
    out.write(boundary)
    out.write(tail)
    out.write(FOOT.pack(width, total, len(ends), len(boundary), tail.size, MAGIC))
    return len(ends), total, len(MAGIC) + total * width + len(boundary) + tail.size + FOOT.size


class _Memo(dict):
    """Ids of words seen before; ``extra`` has those of the texts at hand."""

    extra: dict = {}

    def __missing__(self, word: str) -> bytes:
        return self.extra[word]


#: A word of letters that normalisation only puts in lower case, and perhaps a mark after it.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,]?)").fullmatch


class WordEncoder:
    """A tokenizer with what it has said of words.

    by_word: it drops white space after normalising and splitting, so a text's ids are those of its
    words. plain: it also only lower-cases plain words and keeps letters together, so that their
    ids come from the BPE model alone, on the byte-level form of the word.
    """

    def __init__(self, spec: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        form = json.loads(spec)
        steps = (form.get("normalizer") or {}).get("normalizers") or []
        cuts = (form.get("pre_tokenizer") or {}).get("pretokenizers") or []
        split = next((c for c in cuts if c["type"] == "Split"), {})
        pattern = split.get("pattern", {}).get("Regex", "")
        self.by_word = (
            [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
            and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": "\\s+"}, " ")
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            and (split["behavior"], split["invert"]) == ("Removed", True)
            and not cuts[1]["add_prefix_space"]
            and not cuts[1]["use_regex"]
        )
        self.plain = self.by_word and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and form["model"]["type"] == "BPE"
        self.known, self.cores, self.marks = _Memo(), {}, {}
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in kept]
        # the byte-level alphabet: printable bytes stand for themselves, others for characters from 256 on
        self.alphabet = {**{b: chr(b) for b in kept}, **{b: chr(256 + i) for i, b in enumerate(rest)}}

    def full(self, texts: list[str], kind: str) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str], kind: str) -> dict[str, bytes]:
        """The ids of each word."""
        if not self.plain:
            return dict(zip(words, self.full(words, kind), strict=True))
        if not self.marks:
            self.marks = dict(zip(("", ".", ","), self.full(["", ".", ","], kind), strict=True))
        width, model, cores = int(kind[2:]), self.tokenizer.model, self.cores
        out, other = {}, []
        for word in words:
            if (m := _PLAIN(word)) is None:
                other.append(word)
                continue
            core = m[1].lower()
            if (ids := cores.get(core)) is None:
                made = model.tokenize(core.encode().decode("latin-1").translate(self.alphabet))
                ids = b"".join([t.id.to_bytes(width, "little") for t in made])
                if len(cores) < CACHE_WORDS:
                    cores[core] = ids
            out[word] = ids + self.marks[m[2]]
        out.update(zip(other, self.full(other, kind), strict=True))
        return out


@lru_cache(2)
def _encoder(spec: bytes) -> WordEncoder:
    return WordEncoder(spec)


def id_width(spec: bytes, end_id: int) -> int:
    """Bytes that hold any id of the tokenizer and end_id: 2 or 4."""
    return 2 if max(_encoder(spec).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def _pieces(text: str) -> Iterator[str]:
    """text cut at blanks into pieces of TEXT_BLOCK characters or little more."""
    at = 0
    while len(text) - at > TEXT_BLOCK and (cut := text.find(" ", at + TEXT_BLOCK)) >= 0:
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode_texts(spec: bytes, texts: list[str], end_id: int, width: int) -> list[bytes]:
    """The ids of whole texts, without special tokens, and the end id, as little-endian numbers of width bytes.

    Where the tokenizer never looks across white space and drops it, words between blanks and
    line ends are encoded once and remembered, which gives the ids of the whole text.
    """
    encoder, kind, end = _encoder(spec), f"<u{width}", end_id.to_bytes(width, "little")
    if not encoder.by_word:
        return [ids + end for ids in encoder.full(texts, kind)]
    known, out = encoder.known, []
    for text in texts:
        ids = []
        for piece in _pieces(text):
            words = piece.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            known.extra = encoder.words([w for w in set(words) if w not in known], kind)
            if len(known) < CACHE_WORDS:
                known.update(known.extra)
            ids.append(b"".join(map(known.__getitem__, words)))
        out.append(b"".join([*ids, end]))
    return out


def write_token_files(
    docs: DataFrame, spec: bytes, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None
) -> DataFrame:
    """Writes docs in ascending order of their ids as shard files; returns the written manifest.

    spec is a tokenizer file's content, broadcast to the tasks (it is bounded: a vocabulary).
    The manifest has (part, path, docs, tokens, bytes); parts are in the order of the ids.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    wide_rows(spark)
    shared = spark.sparkContext.broadcast(spec)
    width = id_width(spec, end_id)
    # the hash and the row's number deal out rows of one id over several shards
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = ["id", "hash", "row"]
    source = source.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = source.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name_type = first.schema.field(0).type

        def encoded():
            for batch in itertools.chain([first], batches):
                for lo in range(0, batch.num_rows, 512):
                    some = batch.slice(lo, 512)
                    yield some.column(0).to_pylist(), encode_texts(shared.value, some.column(1).to_pylist(), end_id, width)

        name = f"shard-{part:06d}-{uuid.uuid4().hex}.ids"
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            n, total, size = write_shard(out, encoded(), width, name_type)
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/{name}"], "docs": [n], "tokens": [total], "bytes": [size]})

    manifest = ordered.mapInArrow(run, "part long, path string, docs long, tokens long, bytes long")
    return materialize(manifest, "token-manifest")


def read_token_files(manifest: DataFrame, id_col: str = "doc_id", id_type: T.DataType | None = None) -> DataFrame:
    """(id, start, n_tokens, ids) of each document of the shards; ids are little-endian 32-bit numbers.

    start is the number of ids in all documents before it.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    schema = T.StructType(
        [
            T.StructField(id_col, id_type or T.LongType()),
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, where = open_store(path)
                with fs.open_input_file(where) as file:
                    shard = TokenShard.open(file)
                    for first, a, b, ids in shard.batches(BATCH_DOCS, BATCH_IDS):
                        offsets = np.append(a - a[0], b[-1] - a[0]).astype(np.int32) * 4
                        cells = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])
                        names = shard.names.slice(first, len(a)).combine_chunks()
                        yield pa.RecordBatch.from_arrays([names, pa.array(base + a), pa.array(b - a), cells], names=schema.names)

    return deal_files(placed, manifest).mapInArrow(run, schema)
