"""Op 9: telephony audio. Mu-law and A-law by lookup tables, IMA ADPCM across blocks, resampled PCM.

Stored media are RIFF/WAVE bytes: format 7 (mu-law) or 6 (A-law) with one byte a
sample, 17 (IMA ADPCM) in blocks, 1 (16-bit PCM).
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellsight.llm.common import map_arrow, settle, texts_of

PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
RATE = 8000
BLOCK = 192
#: Production rate of stored PCM.
PCM_RATE = 4000
#: Fixed values of the public IMA ADPCM format: the step sizes and the change of their index for each code.
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw_table() -> np.ndarray:
    """G.711 mu-law: the complemented code has a sign, three exponent and four mantissa bits, bias 132."""
    code = ~np.arange(256, dtype=np.uint8)
    exponent, mantissa = (code >> 4 & 7).astype(np.int32), (code & 15).astype(np.int32)
    size = (((mantissa << 3) + 132) << exponent) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    """G.711 A-law: even bits inverted; a set sign bit means positive."""
    code = np.arange(256, dtype=np.uint8) ^ np.uint8(0x55)
    exponent, mantissa = (code >> 4 & 7).astype(np.int32), (code & 15).astype(np.int32)
    size = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw_table(), _alaw_table()


def _compress(table: np.ndarray) -> np.ndarray:
    """Code of the nearest table value for every 16-bit sample, indexed by sample + 32768."""
    order = np.argsort(table, kind="stable")
    values = table[order].astype(np.int32)
    middle = (values[1:] + values[:-1]) / 2
    return order[np.searchsorted(middle, np.arange(-32768, 32768))].astype(np.uint8)


def compand(samples: np.ndarray, kind: int = MULAW) -> np.ndarray:
    """8-bit codes of 16-bit samples (nearest value)."""
    return _compress(MULAW_TABLE if kind == MULAW else ALAW_TABLE)[samples.astype(np.int32) + 32768]


def expand(codes: np.ndarray, kind: int = MULAW) -> np.ndarray:
    """16-bit samples of 8-bit codes."""
    return (MULAW_TABLE if kind == MULAW else ALAW_TABLE)[codes]


def ima_decode(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks, one row each; sample k of all blocks is decoded at once.

    A block starts with its first sample (16 bits), step index and a zero byte; then come codes of four bits, low half first.
    """
    blocks = np.ascontiguousarray(blocks, dtype=np.uint8)
    n, size = blocks.shape
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    value = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out[0] = value
    codes = blocks[:, 4:].T
    for k in range(size - 4):
        for half, code in enumerate((codes[k] & 15, codes[k] >> 4)):
            step = IMA_STEPS[index]
            move = step >> 3
            move += np.where(code & 4, step, 0)
            move += np.where(code & 2, step >> 1, 0)
            move += np.where(code & 1, step >> 2, 0)
            value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
            index = np.clip(index + IMA_INDEX[code & 7], 0, 88)
            out[1 + 2 * k + half] = value
    return out.T


def ima_encode(samples: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """IMA ADPCM blocks of 16-bit samples (the last block repeats the last sample); all blocks advance together."""
    per = 1 + 2 * (block - 4)
    n = max(1, -(-len(samples) // per))
    padded = np.full(n * per, samples[-1] if len(samples) else 0, np.int32)
    padded[: len(samples)] = samples
    rows = padded.reshape(n, per)
    out = np.zeros((n, block), np.uint8)
    value, index = rows[:, 0].copy(), np.zeros(n, np.int32)
    out[:, :2] = value.astype("<i2").view(np.uint8).reshape(n, 2)
    for k in range(1, per):
        step = IMA_STEPS[index]
        diff = rows[:, k] - value
        sign = diff < 0
        left = np.abs(diff)
        code = np.zeros(n, np.int32)
        move = step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            hit = left >= part
            code |= np.where(hit, bit, 0)
            move = move + np.where(hit, part, 0)
            left = left - np.where(hit, part, 0)
        value = np.clip(np.where(sign, value - move, value + move), -32768, 32767)
        index = np.clip(index + IMA_INDEX[code], 0, 88)
        nibble = (code | np.where(sign, 8, 0)).astype(np.uint8)
        out[:, 4 + (k - 1) // 2] |= nibble << np.uint8(4 * ((k - 1) % 2))
    return out


def resample(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    """16-bit samples at another rate: on the line between neighbours at a higher one, the mean of its interval at a lower one.

    The mean keeps most of what the lower rate can't hold out of it.
    """
    n = len(samples) * target // rate
    if rate == target or not n:
        return samples[:n].astype(np.int16)
    if target > rate:
        return np.rint(np.interp(np.arange(n) * (rate / target), np.arange(len(samples)), samples)).astype(np.int16)
    total = np.concatenate([[0], np.cumsum(samples, dtype=np.int64)])
    sums = np.diff(np.interp(np.arange(n + 1) * (rate / target), np.arange(len(total)), total))
    return np.rint(sums * (target / rate)).astype(np.int16)


def wav(payload: bytes, kind: int, rate: int = RATE, block: int = 1) -> bytes:
    """RIFF/WAVE bytes around a mono payload; ``block`` is the size of an ADPCM block."""
    bits = {PCM: 16, ALAW: 8, MULAW: 8, IMA: 4}[kind]
    align = {PCM: 2, ALAW: 1, MULAW: 1, IMA: block}[kind]
    per_block = 1 + 2 * (block - 4) if kind == IMA else 1
    extra = struct.pack("<HH", 2, per_block) if kind == IMA else b"" if kind == PCM else struct.pack("<H", 0)
    head = struct.pack("<HHIIHH", kind, 1, rate, rate * align // per_block, align, bits) + extra
    parts = b"fmt " + struct.pack("<I", len(head)) + head
    if kind != PCM:
        parts += b"fact" + struct.pack("<II", 4, len(payload) // align * per_block)
    parts += b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(parts)) + b"WAVE" + parts


def read_wav(data: bytes) -> tuple[int, int, int, bytes]:
    """Format, rate, block size and payload of mono RIFF/WAVE bytes."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not RIFF/WAVE")
    at, kind, rate, align, payload = 12, None, 0, 1, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, align = struct.unpack_from("<HHIIH", body)
            if channels != 1 or not rate or kind == IMA and align < 5:
                raise ValueError("not mono, no rate, or no room in a block")
        elif name == b"data":
            payload = body
        at += 8 + size + size % 2
    if kind is None or payload is None:
        raise ValueError("no format or no data")
    return kind, rate, align, payload


def samples_of(data: bytes) -> tuple[np.ndarray, int]:
    """16-bit samples and rate of any stored form."""
    kind, rate, align, payload = read_wav(data)
    raw = np.frombuffer(payload, np.uint8)
    if kind in (MULAW, ALAW):
        return expand(raw, kind), rate
    if kind == IMA:
        return ima_decode(raw[: len(raw) // align * align].reshape(-1, align)).ravel(), rate
    if kind == PCM:
        return np.frombuffer(payload[: len(payload) // 2 * 2], "<i2"), rate
    raise ValueError(f"format {kind}")


def to_pcm(media: DataFrame, target: int = PCM_RATE, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """``doc_id, pcm, rate, n_samples``: decoded, resampled and stored as 16-bit PCM WAVE. Null, broken and many-channel media give null ``pcm``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, counts = [], []
        for x in batch.column(1).to_pylist():
            try:
                s, rate = samples_of(x or b"")
                s = resample(s, rate, target)
                out.append(wav(s.astype("<i2").tobytes(), PCM, target))
                counts.append(len(s))
            except (ValueError, struct.error):
                out.append(None)
                counts.append(None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array([target] * len(out), pa.int32()), pa.array(counts, pa.int64())], names=["doc_id", "pcm", "rate", "n_samples"])

    frame = media.select(media[id_column].cast("long").alias("doc_id"), media[media_column].alias("media"))
    return map_arrow(frame, run, "doc_id long, pcm binary, rate int, n_samples long", "media")


def pad(raw: bytes, unit: int = BLOCK) -> bytes:
    """Bytes with 32 appended up to a positive multiple of ``unit``."""
    return raw + b" " * ((-len(raw)) % unit or (0 if raw else unit))


def store_text(docs: DataFrame, kind: int = MULAW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: every whole text's padded UTF-8 bytes as the codes of a telephony WAVE file.

    Null and empty texts are 192 bytes of 32. Repeated rows stay; a null id stays null; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [x.encode() for x in texts_of(batch.column(1))]
        media = [wav(pad(x), kind, RATE) for x in raw]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    frame = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return map_arrow(frame, run, "doc_id long, n_bytes long, media binary")


def law_features(payloads: list[bytes]) -> list[str]:
    """Figures of each payload's A-law samples and ADPCM blocks; all blocks of all payloads are decoded together."""
    if not payloads:
        return []
    blocks = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    counts = np.array([len(p) // BLOCK for p in payloads])
    begins = np.cumsum(counts) - counts
    law = np.abs(expand(blocks, ALAW).astype(np.int32)).sum(1)
    ima = ima_decode(blocks)
    ima_peak = np.maximum.reduceat(ima.max(1), begins)
    ima_sum = np.add.reduceat(np.abs(ima.astype(np.int32)).sum(1, dtype=np.int64), begins)
    law_sum = np.add.reduceat(law.astype(np.int64), begins)
    return [f"alaw={a};ima_peak={p};ima_sum={s}" for a, p, s in zip(law_sum.tolist(), ima_peak.tolist(), ima_sum.tolist())]


def pcm_features(samples: np.ndarray) -> str:
    """Figures of PCM samples."""
    s = samples.astype(np.int64)
    return f"n={len(s)};energy={int(np.square(s).sum())};crossings={int(np.count_nonzero((s[1:] < 0) != (s[:-1] < 0)))};peak={int(np.abs(s).max(initial=0))}"


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame, target: int = PCM_RATE) -> DataFrame:
    """Digests of stored mu-law media with figures of their A-law and ADPCM readings, and their resampled ``pcm``, from the stored bytes alone."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        stored = batch.column(2).to_pylist()
        payloads = [read_wav(x)[3] for x in stored]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        pcm = [wav(resample(expand(np.frombuffer(x, np.uint8)), RATE, target).astype("<i2").tobytes(), PCM, target) for x in payloads]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column(0), "n_bytes": batch.column(1), "payload_bytes": pa.array(map(len, payloads), pa.int64()), "payload_sha256": pa.array(map(sha, payloads), pa.string()),
                "tail_crc32": pa.array([zlib.crc32(x[-16:]) for x in payloads], pa.int64()), "media_bytes": pa.array(map(len, stored), pa.int64()), "media_sha256": pa.array(map(sha, stored), pa.string()),
                "feature": pa.array(law_features(payloads), pa.string()), "pcm": pa.array(pcm, pa.binary()),
            }
        )

    return map_arrow(media.select("doc_id", "n_bytes", "media"), run, DIGESTS + ", pcm binary", "media")


def store_and_read(docs: DataFrame, target: int = PCM_RATE) -> DataFrame:
    """Store the media column, read it back, store its resampled PCM, and return digests and features of what was stored."""
    stored = settle(digests(settle(store_text(docs), "media"), target), "pcm", level=9)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_columns - 1
        whole = [f"{pcm_features(samples_of(x)[0])};{f}" for x, f in zip(batch.column(n).to_pylist(), batch.column(n - 1).to_pylist())]
        return pa.RecordBatch.from_arrays([*batch.columns[: n - 1], pa.array(whole, pa.string())], names=batch.schema.names[:n])

    return map_arrow(stored, run, DIGESTS, "pcm")
