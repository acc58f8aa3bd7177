"""Blocks of documents as word numbers, and packets of their distinct words.

Exploding every word of a corpus with its document and position makes a row of dozens
of bytes from each word. The same is said in far less when a task numbers the distinct
words of a *block* of documents: the documents become arrays of word numbers (their
positions), and only the block's distinct words travel. Words are dealt into buckets
by a checksum, so that all packets of a bucket meet each distinct word of the whole
corpus once; what is found out about a word goes back in a packet of the same order,
and the block puts it in place by position.

A block holds whole documents of about ``BLOCK_CHARS`` characters. Packets are
compressed, so what is shuffled is a fraction of the text. Blocks are named by
partition, number and a checksum of their words: should a scan be planned otherwise
when it is read a second time, packets find no block and the reader raises an error.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import count

BLOCK_CHARS = 6_000_000


def bucket_count(spark, docs=None, each: int = 64 << 20) -> int:
    """Some buckets for each of the session's shuffle partitions, and one at least for `each` bytes that Spark
    thinks docs has: with their number, not their size, grows what all words of the corpus take."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) if docs is not None else 0
    return min(1 << 20, max(64, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // each))


@cache
def _zstd() -> tuple:
    """A compressor and a decompressor: packets are so many and small that making them anew costs more than their work."""
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _squeeze(data: bytes) -> bytes:
    return _zstd()[0].compress(data) if data else b""


def _expand(data: bytes) -> bytes:
    return _zstd()[1].decompress(data) if data else b""


def pack_numbers(values) -> bytes:
    """Unsigned numbers below 2^32, by byte planes and compressed."""
    import numpy as np

    v = np.ascontiguousarray(values, dtype="<u4")
    if not len(v):
        return struct.pack("<IB", 0, 1)
    planes = v.view(np.uint8).reshape(-1, 4).T
    used = 4
    while used > 1 and not planes[used - 1].any():
        used -= 1
    return struct.pack("<IB", len(v), used) + _squeeze(np.ascontiguousarray(planes[:used]).tobytes())


def unpack_numbers(data: bytes):
    import numpy as np

    n, used = struct.unpack_from("<IB", data)
    if not n:
        return np.zeros(0, "<u4")
    out = np.zeros((n, 4), np.uint8)
    out[:, :used] = np.frombuffer(_expand(data[5:]), np.uint8).reshape(used, n).T
    return out.reshape(-1).view("<u4")


def pack_lists(lists: Iterable[bytes], width: int = 1) -> bytes:
    """Byte strings whose lengths are multiples of width."""
    import numpy as np

    lists = list(lists)
    return pack_joined(np.fromiter(map(len, lists), np.int64, len(lists)) // width, b"".join(lists), width)


def pack_joined(lengths, joined: bytes, width: int = 1) -> bytes:
    """pack_lists() of byte strings that are joined already."""
    sizes = pack_numbers(lengths)
    return struct.pack("<IB", len(sizes), width) + sizes + _squeeze(joined)


def unpack_lists(data: bytes):
    """(lengths in units of width, all bytes, width)."""
    n, width = struct.unpack_from("<IB", data)
    return unpack_numbers(data[5 : 5 + n]), _expand(data[5 + n :]), width


def unpack_words(data: bytes) -> list[bytes]:
    sizes, blob, _ = unpack_lists(data)
    at, out = 0, []
    for n in sizes.tolist():
        out.append(blob[at : at + n])
        at += n
    return out


class Block:
    """Documents whose words are numbered in the order in which they first come."""

    def __init__(self) -> None:
        self.words: defaultdict = defaultdict(count().__next__)
        self.numbers = array("I")
        self.sizes: list[int] = []
        self.docs: list = []
        self.chars = 0

    def add(self, doc, words: Iterable, chars: int) -> None:
        before = len(self.numbers)
        self.numbers.fromlist(list(map(self.words.__getitem__, words)))
        self.sizes.append(len(self.numbers) - before)
        self.docs.append(doc)
        self.chars += chars

    def close(self, partition: int, number: int, buckets: int) -> ClosedBlock:
        import numpy as np

        words = [w if isinstance(w, bytes) else w.encode() for w in self.words]
        dealt = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(buckets)
        check = zlib.crc32(b"\0".join(words[:1000] + words[-1000:]), len(words))
        return ClosedBlock(f"{partition}-{number}-{check:08x}", self, words, dealt)


class ColumnBlock(Block):
    """A block whose words come as Arrow columns: they are numbered at its close, in the same order, without an object for each."""

    def __init__(self) -> None:
        super().__init__()
        self.columns: list = []

    def extend(self, docs: list, words, sizes, chars: int) -> None:
        """words: those of all docs, one after the other; sizes: how many each has."""
        self.columns.append(words)
        self.sizes.extend(sizes.tolist())
        self.docs.extend(docs)
        self.chars += chars

    def close(self, partition: int, number: int, buckets: int) -> ClosedBlock:
        import numpy as np
        import pyarrow as pa

        coded = pa.concat_arrays(self.columns).dictionary_encode()
        self.columns = []
        self.numbers, self.words = coded.indices.to_numpy().astype(np.uint32), _bytes_of(coded.dictionary)
        return super().close(partition, number, buckets)


def _bytes_of(column) -> list[bytes]:
    """An Arrow column of strings or bytes without nulls as a list; whatever strings hold, they need not be UTF-8."""
    import numpy as np

    _, offsets, data = column.buffers()
    kind = np.int64 if str(column.type).startswith("large") else np.int32
    cuts = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).tolist()
    data = data.to_pybytes() if data else b""
    return [data[lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False)]


def split_column(texts, end: bytes):
    """(words, sizes): those of an Arrow column of bytes, A-Z lower-cased, each text's followed by end, one after the other.

    What separates words is blank and U+0009-000D, as for bytes.split(). end must be the empty word.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if end:
        raise ValueError("only the empty word comes after a last blank")
    kind = pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string()
    # functions over ASCII take bytes as they are, but want the type of strings
    texts = pa.Array.from_buffers(kind, len(texts), texts.buffers(), offset=texts.offset)
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    blank = pa.scalar(" ", kind)
    # a blank at its end makes the empty word come after a text's last; a text without words is that word
    texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(texts, blank, pa.scalar("", kind)))
    lists = pc.ascii_split_whitespace(texts)
    return lists.flatten(), np.asarray(pc.list_value_length(lists)).astype(np.int64)


def column_blocks(columns: Iterable[tuple], buckets: int) -> Iterator[ClosedBlock]:
    """The blocks of a partition's columns (documents, their words, numbers of words, characters): cut as blocks_of() cuts rows."""
    import numpy as np
    from pyspark import TaskContext

    partition, number, block = TaskContext.get().partitionId(), 0, ColumnBlock()
    for docs, words, sizes, chars in columns:
        ends, filled, lo = np.cumsum(sizes), np.cumsum(chars), 0
        while lo < len(docs):
            at, before = (int(ends[lo - 1]), int(filled[lo - 1])) if lo else (0, 0)
            # the document that fills a block is its last
            hi = min(len(docs), int(np.searchsorted(filled, before + BLOCK_CHARS - block.chars)) + 1)
            block.extend(docs[lo:hi], words.slice(at, int(ends[hi - 1]) - at), sizes[lo:hi], int(filled[hi - 1]) - before)
            lo = hi
            if block.chars >= BLOCK_CHARS:
                yield block.close(partition, number, buckets)
                number, block = number + 1, ColumnBlock()
    if block.docs:
        yield block.close(partition, number, buckets)


def blocks_of(rows: Iterable[tuple], buckets: int) -> Iterator[ClosedBlock]:
    """The blocks of a partition's rows (document, words, characters)."""
    from pyspark import TaskContext

    partition, number, block = TaskContext.get().partitionId(), 0, Block()
    for doc, words, chars in rows:
        block.add(doc, words, chars)
        if block.chars >= BLOCK_CHARS:
            yield block.close(partition, number, buckets)
            number, block = number + 1, Block()
    if block.docs:
        yield block.close(partition, number, buckets)


class ClosedBlock:
    def __init__(self, name: str, block: Block, words: list[bytes], dealt) -> None:
        import numpy as np

        self.name, self.block, self.words, self.dealt = name, block, words, dealt
        #: word numbers by bucket, within a bucket ascending: the order of packets
        self.order = np.argsort(dealt, kind="stable")

    def packets(self) -> Iterator[tuple[int, list[int]]]:
        """(bucket, numbers of its words)."""
        import numpy as np

        if not len(self.words):
            return
        sorted_buckets = self.dealt[self.order]
        cuts = np.flatnonzero(np.diff(sorted_buckets)) + 1
        for part in np.split(self.order, cuts):
            yield int(self.dealt[part[0]]), part.tolist()

    def word_packets(self) -> Iterator[tuple[int, bytes, slice]]:
        """(bucket, its packed words, their place in order): packets() whose words are joined once for all buckets."""
        import numpy as np

        if not len(self.words):
            return
        words = [self.words[i] for i in self.order.tolist()]
        lengths, joined = np.fromiter(map(len, words), np.int64, len(words)), b"".join(words)
        sorted_buckets, ends = self.dealt[self.order], np.cumsum(lengths).tolist()
        cuts = [0, *(np.flatnonzero(np.diff(sorted_buckets)) + 1).tolist(), len(words)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield int(sorted_buckets[lo]), pack_joined(lengths[lo:hi], joined[ends[lo - 1] if lo else 0 : ends[hi - 1]]), slice(lo, hi)

    def payload(self) -> bytes:
        """The documents' sizes and word numbers, and each word's bucket."""
        import numpy as np

        parts = [pack_numbers(np.array(self.block.sizes, np.int64)), pack_numbers(np.frombuffer(self.block.numbers, np.uint32)), pack_numbers(self.dealt)]
        return struct.pack("<3I", *map(len, parts)) + b"".join(parts)


def read_payload(data: bytes):
    """(sizes, word numbers, buckets of the words) of a payload."""
    lengths = struct.unpack_from("<3I", data)
    at, out = 12, []
    for n in lengths:
        out.append(unpack_numbers(data[at : at + n]))
        at += n
    return out


def packet_order(dealt):
    """Word numbers in the order in which sorted packets hold them."""
    import numpy as np

    return np.argsort(dealt, kind="stable")


def gather_lists(sizes, flat, chosen):
    """The lists chosen, one after the other: sizes and flat hold all lists in their order."""
    import numpy as np

    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    some = sizes[chosen].astype(np.int64)
    shift = np.repeat(starts[chosen] - (np.cumsum(some) - some), some)
    return flat[shift + np.arange(len(shift))], some
