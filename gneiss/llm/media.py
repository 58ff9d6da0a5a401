"""Media columns: audio features of 8-bit samples.

A text's UTF-8 bytes, padded with spaces to whole blocks, are stored as the samples of a mono 8-bit WAV file; the
samples that the features see are those read back from it. Features: polyphase resampling by 1/2 (a windowed-sinc
low-pass in two phases), overlapped Hann frames, a log-mel filterbank, and voiced spans by hysteresis: a span opens
above the high energy threshold and lasts until the energy falls below the low one. Frames cover every sample: the last
one is filled up with silence, and its energy is taken over the part of the window that has samples, so that a text's
length doesn't move the thresholds. Spans end with the recording at the latest.

Each recording's features fill a tensor of fixed shape (BINS x MELS): the frames are averaged over BINS equal parts
of the time. Tensors are stored as an Arrow column of fixed-shape tensors beside the time spans: stored() gives them as
Arrow files, one for some hundred recordings, and every result here is taken from what such a file holds when it is read
back. All arithmetic before the tensor is in doubles, so that rounded values don't depend on a machine's vector units.

Every row is computed from its own samples alone, block by block (BLOCK samples with the filter's overlap), so equal
texts give equal values. Beside a text memory holds its payload and file, and half a byte for each of its bytes for the
frames. One narrow pass, no shuffle. Null and empty texts are one block of spaces. Rows are handled one by one, repeated
ids too. An empty table gives an empty table; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .store import bounded_batches

PAD = 192
RATE = 16_000  # of the stored samples
TAPS = 32
FRAME, HOP, MELS, BINS = 256, 192, 24, 8
HIGH, LOW = 0.9, 0.6  # thresholds as parts of the way from the quietest to the loudest frame
BLOCK = 1 << 18  # samples after resampling that are framed at a time
SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, tensor array<float>, spans array<struct<start: double, end: double>>"
)


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF/WAVE file of 8-bit mono samples; an odd payload gets the format's pad byte."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + payload + b"\0" * (n % 2)


def samples(media: bytes) -> bytes:
    """The data chunk of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at = 12
    while at + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=1)
def _filters():
    """The low-pass in its two phases, the window, and the mel weights."""
    t = np.arange(TAPS) - (TAPS - 1) / 2
    h = np.sinc(t / 2) / 2 * np.hamming(TAPS)
    h = h / h.sum()
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(RATE / 4), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 2 / RATE)
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    bank = np.maximum(0, np.minimum(up, down))
    return h[::2][::-1].copy(), h[1::2][::-1].copy(), np.hanning(FRAME), bank


def _halved(x: np.ndarray) -> np.ndarray:
    """Every second output of the low-pass, each phase applied to its own half of the samples."""
    even, odd, _, _ = _filters()
    k = TAPS // 2
    n = len(x) // 2
    x = np.concatenate([np.zeros(k), x[: 2 * n], np.zeros(k)])
    a = np.convolve(x[0::2], even, "valid")[:n]
    return a + np.convolve(x[1::2], odd, "valid")[:n]


def log_mel(pcm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames of 8-bit samples and their log energies, computed block by block."""
    _, _, window, bank = _filters()
    mels, energies = [], []
    if len(pcm) % 2:
        pcm = np.append(pcm, np.uint8(128))
    n_out = len(pcm) // 2
    n_frames = 1 + max(0, -(-(n_out - FRAME) // HOP))
    covered = np.cumsum(window**2)
    per = BLOCK // HOP
    for i in range(0, n_frames, per):
        j = min(n_frames, i + per)
        a, b = i * HOP, min(n_out, (j - 1) * HOP + FRAME)
        lo, hi = max(0, 2 * a - TAPS), min(len(pcm), 2 * b + TAPS)
        y = _halved((pcm[lo:hi].astype(np.float64) - 128) / 128)[(2 * a - lo) // 2 :][: b - a]
        y = np.pad(y, (0, (j - i - 1) * HOP + FRAME - len(y)))
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[:: HOP][: j - i] * window
        z = np.fft.rfft(frames, axis=1)
        power = z.real**2 + z.imag**2
        mels.append(np.log(power @ bank + 1e-6))
        energy = (frames**2).sum(axis=1)
        here = n_out - (j - 1) * HOP  # samples of the block's last frame
        if 0 < here < FRAME and n_frames > 1:
            energy[-1] *= covered[-1] / covered[here - 1]
        energies.append(np.log(energy + 1e-6))
    return np.concatenate(mels), np.concatenate(energies)


def spans(energy: np.ndarray) -> list[tuple[int, int]]:
    """[first, last + 1) of the frames of each span, by hysteresis."""
    low, high = energy.min(), energy.max()
    up, down = low + HIGH * (high - low), low + LOW * (high - low)
    state = np.where(energy >= up, 1, np.where(energy < down, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.where(known >= 0, state[np.maximum(known, 0)], 0)
    edge = np.diff(np.concatenate([[0], on, [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def features(pcm: np.ndarray) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """The BINS x MELS tensor and the time spans in seconds."""
    mel, energy = log_mel(pcm)
    at = np.minimum(np.arange(BINS) * len(mel) // BINS, len(mel) - 1)
    ends = np.maximum(np.append(at[1:], len(mel)), at + 1)
    total = np.concatenate([np.zeros((1, MELS)), np.cumsum(mel, axis=0)])
    tensor = ((total[ends] - total[at]) / (ends - at)[:, None]).astype(np.float32)
    step = 2 * HOP / RATE
    return tensor, [(a * step, min((b - 1) * step + 2 * FRAME / RATE, len(pcm) / RATE)) for a, b in spans(energy)]


TENSOR = pa.fixed_shape_tensor(pa.float32(), (BINS, MELS))
SPANS = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))


def tensor_file(ids: list, tensors: list[np.ndarray], where: list[list[tuple[float, float]]]) -> bytes:
    """An Arrow file of recordings: doc_id, tensor (fixed shape), spans."""
    flat = pa.array(np.concatenate([x.ravel() for x in tensors]) if tensors else [], pa.float32())
    tensor = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(flat, BINS * MELS))
    spans_ = pa.array([[{"start": x, "end": y} for x, y in w] for w in where], SPANS)
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), tensor, spans_], ["doc_id", "tensor", "spans"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensor_file(file: bytes) -> pa.Table:
    return pa.ipc.open_file(pa.BufferReader(file)).read_all()


def _recordings(batches, size: int = 256):
    """Per `size` rows: digests of each, its media file, and the Arrow file of features."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for a in range(0, len(ids), size):
            rows, tensors, where = [], [], []
            for i in range(a, min(a + size, len(ids))):
                raw = (texts[i].as_py() or "").encode("utf-8")
                media = wav(raw + b" " * (PAD * max(1, -(-len(raw) // PAD)) - len(raw)))
                back = samples(media)
                tensor, found = features(np.frombuffer(back, np.uint8))
                tensors.append(tensor)
                where.append(found)
                rows.append((ids[i], len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), media))
            yield rows, tensor_file(ids[a : a + size], tensors, where)


def stored(docs: DataFrame) -> DataFrame:
    """Arrow files of the features of docs(doc_id, text), each of up to 256 recordings, and how many each holds."""

    def run(batches):
        for rows, file in _recordings(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int32()), pa.array([file], pa.binary())], ["recordings", "file"])

    bounded_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "recordings int, file binary")


def audio(docs: DataFrame, full: bool = False) -> DataFrame:
    """Digests, tensor and spans of each row of docs(doc_id, text); with full, also the media file."""

    def run(batches):
        for rows, file in _recordings(batches):
            table = read_tensor_file(file)
            tensors = table["tensor"].combine_chunks().to_numpy_ndarray()
            where, out = table["spans"].to_pylist(), []
            for row, tensor, found in zip(rows, tensors, where):
                digest = hashlib.sha256(np.round(tensor.astype(np.float64), 2).astype("<f8").tobytes()).hexdigest()[:16]
                voiced = sum(w["end"] - w["start"] for w in found)
                out.append(f"mel{BINS}x{MELS}:{digest}:mean={tensor.mean(dtype=np.float64):.2f}:spans={len(found)}:voiced={voiced:.3f}")
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            flat = pa.array(tensors.ravel(), pa.float32())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (BINS * MELS)), flat)
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tensor", "spans"]
            arrays = [*cols[:7], pa.array(out, pa.string()), lists, table["spans"].combine_chunks()]
            yield pa.RecordBatch.from_arrays(arrays + cols[7:] * full, names + ["media"] * full)

    bounded_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, SCHEMA + ", media binary" * full)


def op7_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio(spark.read.parquet(f"{sf_dir}/documents.parquet"))
