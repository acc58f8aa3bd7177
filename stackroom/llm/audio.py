"""Audio features of 8-bit PCM media columns.

``wav_column`` stores bytes losslessly as the samples of a WAV file (built from
column expressions in the JVM). ``audio_features`` reads such files back and adds,
for each row, a polyphase resampled signal's log-mel filterbank (overlapped
frames), energy segments with hysteresis, and the filterbank cut into patches of
one fixed shape, kept as an Arrow ``fixed_shape_tensor`` column with time spans.

Cases: null text or media counts as empty; a file without a ``data`` chunk has no
samples; a signal shorter than one frame is padded with silence to one frame;
equal bytes give equal features, in whatever batch they come. Signals are worked
off in blocks of ``block_frames`` frames, so memory follows the media itself and
not its spectrogram. Only the named columns are read; others, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.shared import wide_rows

#: Bytes per padding unit of a payload.
PAD_UNIT = 192


@dataclass(frozen=True)
class AudioConfig:
    """Sizes of the analysis. up/down: the ratio of the resampler in lowest terms."""

    rate: int = 16_000
    up: int = 3
    down: int = 4
    half_taps: int = 8
    frame: int = 300
    hop: int = 120
    fft: int = 512
    mels: int = 20
    patch_frames: int = 32
    on_db: float = 6.0
    off_db: float = 3.0
    block_frames: int = 2_000

    @property
    def out_rate(self) -> float:
        return self.rate * self.up / self.down


def le32(n: Column) -> Column:
    """Four bytes of n, the lowest first."""
    n = n.cast("long")
    parts = [F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)]
    return F.unhex(F.concat(*parts))


def padded_payload(text: Column, unit: int = PAD_UNIT) -> Column:
    """The UTF-8 bytes of text with blanks up to a positive multiple of unit."""
    body = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(body)
    total = F.greatest(F.lit(unit), (F.ceil(n / F.lit(unit)) * unit).cast("int"))
    return F.concat(body, F.repeat(F.lit(" "), (total - n).cast("int")).cast("binary"))


def wav_column(payload: Column, rate: int = AudioConfig.rate) -> Column:
    """A mono WAV file whose unsigned 8-bit samples are the bytes of payload."""
    n = F.octet_length(payload)
    fmt = struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return F.concat(
        F.lit(b"RIFF"), le32(n + 36), F.lit(b"WAVEfmt "), F.lit(fmt), F.lit(b"data"), le32(n), payload
    )


def read_wav(media: bytes | None) -> tuple[int, memoryview]:
    """(sample rate, samples) of an 8-bit mono WAV file."""
    view = memoryview(media or b"")
    rate, at = 0, 12
    while at + 8 <= len(view):
        kind, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", view, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError(f"8-bit mono PCM expected, not format {code} with {channels} channels of {bits} bits")
        elif kind == b"data":
            return rate, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return rate, view[:0]


@cache
def _resampler(cfg: AudioConfig):
    """(matrix, first sample's distance): one product per `up` outputs, over windows of the input `down` apart."""
    import numpy as np

    c = cfg.half_taps * max(cfg.up, cfg.down)
    k = np.arange(-c, c + 1)
    cut = 1.0 / max(cfg.up, cfg.down)
    h = cut * np.sinc(cut * k) * np.kaiser(2 * c + 1, 8.0)
    h *= cfg.up / h.sum()
    first = [-(-(r * cfg.down - c) // cfg.up) for r in range(cfg.up)]
    last = [(r * cfg.down + c) // cfg.up for r in range(cfg.up)]
    start, width = min(first), max(last) - min(first) + 1
    m = np.zeros((width, cfg.up), np.float32)
    for r in range(cfg.up):
        for x in range(first[r], last[r] + 1):
            m[x - start, r] = h[r * cfg.down - x * cfg.up + c]
    return m, start


@cache
def _mel_bank(cfg: AudioConfig):
    import numpy as np

    def mel(f):
        return 2595.0 * np.log10(1.0 + f / 700.0)

    top = cfg.out_rate / 2
    edges = 700.0 * (10.0 ** (np.linspace(mel(0.0), mel(top), cfg.mels + 2) / 2595.0) - 1.0)
    freq = np.linspace(0.0, top, cfg.fft // 2 + 1)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.maximum(0.0, np.minimum((freq - low) / (mid - low), (high - freq) / (high - mid)))
    return np.ascontiguousarray(bank.T.astype(np.float32)), np.hanning(cfg.frame + 1)[:-1].astype(np.float32)


def resample(samples, first: int, count: int, cfg: AudioConfig):
    """Outputs first to first + count of the resampled signal; silence lies beyond its ends.

    Each of the `up` phases has its own taps: only outputs that are kept are computed.
    """
    import numpy as np

    matrix, start = _resampler(cfg)
    width = matrix.shape[0]
    q0, q1 = first // cfg.up, -(-(first + count) // cfg.up)
    a = q0 * cfg.down + start
    b = (q1 - 1) * cfg.down + start + width
    x = np.zeros(b - a, np.float32)
    lo, hi = max(a, 0), min(b, len(samples))
    if hi > lo:
        x[lo - a : hi - a] = samples[lo:hi]
        x[lo - a : hi - a] -= 128.0
        x *= np.float32(1 / 128)
    windows = np.lib.stride_tricks.as_strided(x, (q1 - q0, width), (4 * cfg.down, 4))
    y = (windows @ matrix).reshape(-1)
    return y[first - q0 * cfg.up : first - q0 * cfg.up + count]


def frame_count(n_samples: int, cfg: AudioConfig) -> int:
    n = n_samples * cfg.up // cfg.down
    return 1 + max(0, n - cfg.frame) // cfg.hop


def log_mel(samples, cfg: AudioConfig):
    """(log10 mel energies of shape frames x mels, dB energy of each frame)."""
    import numpy as np

    bank, hann = _mel_bank(cfg)
    total = frame_count(len(samples), cfg)
    mel, energy = np.empty((total, cfg.mels), np.float32), np.empty(total, np.float32)
    for f0 in range(0, total, cfg.block_frames):
        f1 = min(total, f0 + cfg.block_frames)
        y = resample(samples, f0 * cfg.hop, (f1 - f0 - 1) * cfg.hop + cfg.frame, cfg)
        frames = np.lib.stride_tricks.as_strided(y, (f1 - f0, cfg.frame), (y.strides[0] * cfg.hop, y.strides[0])) * hann
        z = np.fft.rfft(frames, cfg.fft)
        power = (z.real**2 + z.imag**2).astype(np.float32, copy=False)
        mel[f0:f1] = power @ bank
        energy[f0:f1] = power.sum(1)
    np.maximum(mel, 1e-8, out=mel)
    np.log10(mel, out=mel)
    return mel, 10.0 * np.log10(np.maximum(energy, 1e-8))


def segments(energy, cfg: AudioConfig) -> list[tuple[float, float]]:
    """Spans in seconds where energy rises above the floor by on_db and until it falls below off_db.

    The floor is the 10th percentile of the frames' energies.
    """
    import numpy as np

    n = len(energy)
    floor = float(np.sort(energy)[n // 10])
    state = np.where(energy >= floor + cfg.on_db, 1, np.where(energy < floor + cfg.off_db, 0, -1))
    known = np.where(state >= 0, np.arange(n), -1)
    np.maximum.accumulate(known, out=known)
    active = np.where(known >= 0, state[known], 0).astype(np.int8)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], active, [0]))))
    step, frame = cfg.hop / cfg.out_rate, cfg.frame / cfg.out_rate
    return [(a * step, (b - 1) * step + frame) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


@cache
def _tensor_schema(cfg: AudioConfig):
    import pyarrow as pa

    return pa.schema(
        [
            ("tensor", pa.fixed_shape_tensor(pa.float32(), (cfg.patch_frames, cfg.mels))),
            ("start_s", pa.float64()),
            ("end_s", pa.float64()),
            ("frames", pa.int32()),
        ]
    )


def pack_patches(mel, cfg: AudioConfig) -> bytes:
    """An Arrow IPC stream of patches of one shape; the last is padded with the least value, its true frames are counted."""
    import numpy as np
    import pyarrow as pa

    n = mel.shape[0]
    count = -(-n // cfg.patch_frames)
    full = np.full((count * cfg.patch_frames, cfg.mels), -8.0, np.float32)
    full[:n] = mel
    schema = _tensor_schema(cfg)
    cells = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), cfg.patch_frames * cfg.mels)
    at = np.arange(count) * cfg.patch_frames
    used = np.minimum(cfg.patch_frames, n - at)
    step = cfg.hop / cfg.out_rate
    batch = pa.record_batch(
        [
            pa.ExtensionArray.from_storage(schema.field(0).type, cells),
            pa.array(at * step),
            pa.array((at + used - 1) * step + cfg.frame / cfg.out_rate),
            pa.array(used.astype(np.int32)),
        ],
        schema=schema,
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_patches(stored: bytes):
    """The table of a stored stream; ``tensor`` is a fixed-shape tensor column."""
    import pyarrow as pa

    with pa.ipc.open_stream(stored) as stream:
        return stream.read_all()


FEATURE_FIELDS = [
    T.StructField("sample_rate", T.IntegerType()),
    T.StructField("pcm_bytes", T.LongType()),
    T.StructField("pcm_sha256", T.StringType()),
    T.StructField("pcm_tail_crc32", T.LongType()),
    T.StructField("frames", T.IntegerType()),
    T.StructField("tensors", T.BinaryType()),
    T.StructField(
        "segments",
        T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())])),
    ),
]


def audio_features(
    media: DataFrame, media_col: str = "media", keep: Sequence[str] = ("doc_id",), cfg: AudioConfig | None = None
) -> DataFrame:
    """The columns of keep, and of each file: facts read back from its samples, patches and segments.

    The work is by row, without a shuffle. pcm_sha256 and pcm_tail_crc32 (of the last
    16 samples) are of the samples as read back.
    """
    cfg = cfg or AudioConfig()
    wide_rows(media.sparkSession)
    keep = list(keep)
    if clash := {f.name for f in FEATURE_FIELDS} & set(keep):
        raise ValueError(f"keep names results: {sorted(clash)}")
    source = media.select(*keep, F.col(media_col).alias("__media"))
    schema = T.StructType([*(source.schema[c] for c in keep), *FEATURE_FIELDS])
    return source.mapInArrow(_feature_task(cfg, len(keep), schema), schema)


def _feature_task(cfg: AudioConfig, kept: int, schema: T.StructType):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                rows = []
                for cell in part.column(kept):
                    buffer = cell.as_buffer()
                    rate, pcm = read_wav(buffer)
                    mel, energy = log_mel(np.frombuffer(pcm, np.uint8), cfg)
                    rows.append(
                        (
                            rate,
                            len(pcm),
                            hashlib.sha256(pcm).hexdigest(),
                            zlib.crc32(pcm[-16:]),
                            mel.shape[0],
                            pack_patches(mel, cfg),
                            [{"start_s": a, "end_s": b} for a, b in segments(energy, cfg)],
                        )
                    )
                columns = [pa.array(c, arrow.field(kept + i).type) for i, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], *columns], schema=arrow)

    return run


def patch_digest(stored: Column, segs: Column) -> Column:
    """A short text of a row's features: patches' bytes, checksum and segments."""
    spans = F.concat_ws(
        ",", F.transform(segs, lambda s: F.concat_ws("-", F.format_number(s["start_s"], 3), F.format_number(s["end_s"], 3)))
    )
    return F.concat_ws(
        ";", F.octet_length(stored).cast("string"), F.lpad(F.lower(F.hex(F.crc32(stored))), 8, "0"), F.substring(F.sha2(spans, 256), 1, 16)
    )


def check_ratio(cfg: AudioConfig) -> None:
    if math.gcd(cfg.up, cfg.down) != 1:
        raise ValueError("up and down must have no common factor")
