"""MPEG audio as a media column: builds, resynchronises and checks layer III streams, with exact durations and seek offsets."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, sliced

UNIT = 576
# Fixed values of the format (ISO/IEC 11172-3 and 13818-3): kbit/s of layer III by index, and sampling rates by index.
RATES_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Version 1, layer III, checksum present, 224 kbit/s, 48 kHz, one channel: 672 bytes, 1152 samples a frame.
HEADER = bytes([0xFF, 0xFA, 0xC4, 0xC0])
FRAME, SIDE, SAMPLES = 672, 17, 1152
BODY = 4 + 2 + SIDE


def crc16(data: np.ndarray) -> np.ndarray:
    """The format's checksum (polynomial 0x8005, all ones at first) of each row of bytes."""
    crc = np.full(len(data), 0xFFFF, np.uint32)
    for k in range(data.shape[1]):
        crc ^= data[:, k].astype(np.uint32) << 8
        for _ in range(8):
            crc = ((crc << 1) ^ np.where(crc & 0x8000, np.uint32(0x8005), np.uint32(0))) & 0xFFFF
    return crc


_CRC = int(crc16(np.frombuffer(HEADER[2:] + bytes(SIDE), np.uint8)[None, :])[0])


def _synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 127 for s in (21, 14, 7, 0))


def encode(payload: bytes) -> bytes:
    """A layer III stream that carries the payload (a multiple of 576 bytes), 576 bytes as each frame's ancillary data.

    Frames hold no coded samples (silence) and a checksum. Before them: an ID3v2.4 tag with the number of payload bytes, and a
    frame with the table of variable-bitrate streams (frames, bytes, 100 seek points), under the name it has where the bitrate is constant.
    """
    units = len(payload) // UNIT
    frames = np.zeros((units + 1, FRAME), np.uint8)
    frames[:, :4] = np.frombuffer(HEADER, np.uint8)
    frames[:, 4], frames[:, 5] = _CRC >> 8, _CRC & 255
    frames[1:, BODY : BODY + UNIT] = np.frombuffer(payload, np.uint8).reshape(units, UNIT)
    points = bytes(((np.arange(100) * units // 100 + 1) * 256 // (units + 1)).astype(np.uint8))
    table = b"Info" + (7).to_bytes(4, "big") + units.to_bytes(4, "big") + ((units + 1) * FRAME).to_bytes(4, "big") + points
    frames[0, BODY : BODY + len(table)] = np.frombuffer(table, np.uint8)
    text = b"\x03payload\x00" + str(len(payload)).encode()
    tag = b"TXXX" + _synchsafe(len(text)) + b"\x00\x00" + text
    return b"ID3\x04\x00\x00" + _synchsafe(len(tag)) + tag + frames.tobytes()


def tags_of(data: bytes) -> tuple[int, dict[str, str]]:
    """(bytes of the ID3v2 tag at the start, its user texts by description); no or a damaged tag gives what could be read."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0, {}
    number = lambda b: sum((x & 127) << k for x, k in zip(b, (21, 14, 7, 0)))
    end, at, found = min(len(data), 10 + number(data[6:10])), 10, {}
    while at + 10 <= end and data[at]:
        # sizes are synchsafe from version 4 on
        size = number(data[at + 4 : at + 8]) if data[3] >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : min(end, at + 10 + size)]
        if data[at : at + 4] == b"TXXX" and body[:1] in (b"\x00", b"\x03"):
            name, _, value = body[1:].decode("utf-8" if body[0] else "latin-1", "replace").partition("\x00")
            found[name] = value.rstrip("\x00")
        at += 10 + size
    return end, found


def frame_at(data: bytes, at: int) -> tuple[int, int, int, int, bool] | None:
    """(bytes, samples, hertz, side bytes, checksum?) of the layer III frame header at an offset, None if there is none."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer, b, mode = (data[at + 1] >> 3) & 3, (data[at + 1] >> 1) & 3, data[at + 2], data[at + 3] >> 6
    rate, hertz = b >> 4, (b >> 2) & 3
    if version == 1 or layer != 1 or rate in (0, 15) or hertz == 3:
        return None
    hz = HERTZ[version][hertz]
    first = version == 3
    size = (144 if first else 72) * (RATES_1 if first else RATES_2)[rate] * 1000 // hz + ((b >> 1) & 1)
    side = (17 if mode == 3 else 32) if first else (9 if mode == 3 else 17)
    return size, 1152 if first else 576, hz, side, not data[at + 1] & 1


def _run(raw: np.ndarray, at: int, end: int, size: int, head: np.ndarray) -> int:
    """How many frames of `size` bytes with the very same header stand one after the other from `at` on."""
    many = (end - at) // size
    same = (raw[at : at + many * size].reshape(many, size)[:, :4] == head).all(axis=1)
    return many if same.all() else int(same.argmin())


def parse(data: bytes) -> dict:
    """Frames of a stream, tags, table and damage.

    offsets: of the frames with a right checksum, the table's frame left out; samples and hertz: their exact duration; bitrates: how many distinct
    ones; skipped: bytes that belong to no frame; bad: frames with a wrong checksum; texts: user texts of the ID3v2 tag, tag_bytes, and
    old_tag: whether an ID3v1 tag ends the stream; table: (frames, bytes, seek points) as stated, None if there is none; table_off: how far its number
    of frames is from those found, and seek_off the most bytes by which a seek point misses the frame it stands for (-1 without points).
    A header counts if it stands where the frame before it ends, or if another one, or the stream's end, follows its own
    frame; other bytes are skipped until the stream is in step again. The last 128 bytes are a tag only where a frame ends before them.
    """
    tag, texts = tags_of(data)
    at, end, old = tag, len(data), data[-128:-125] == b"TAG" and len(data) - tag >= 128
    raw = np.frombuffer(data, np.uint8)
    starts: list[np.ndarray] = [np.zeros(0, np.int64)]
    kinds: list[tuple[int, ...]] = [(0, 0, 0, 0, 0)]  # bytes, samples, hertz, side bytes, checksum?
    skipped, reached, tail = 0, -1, False
    while at + 4 <= end:
        if old and reached == at == len(data) - 128:
            end, tail = at, True
            break
        known = frame_at(data, at)
        after = at + known[0] if known else end + 1
        stop = old and after == len(data) - 128
        if after > end or reached != at and not stop and after + 4 <= end and frame_at(data, after) is None:
            nearest = data.find(b"\xff", at + 1, end)
            nearest = end if nearest < 0 else nearest
            skipped += nearest - at
            at = nearest
            continue
        many = _run(raw, at, end, known[0], raw[at : at + 4])
        starts.append(at + known[0] * np.arange(many, dtype=np.int64))
        kinds.append(tuple(int(x) for x in known))
        at = reached = at + known[0] * many
    skipped += max(0, end - at)
    kind = np.repeat(np.arange(len(kinds)), [len(x) for x in starts])
    where, facts = np.concatenate(starts), np.array(kinds, np.int64)[kind]
    keep = np.ones(len(where), bool)
    for side in set(facts[facts[:, 4] > 0, 3].tolist()):
        mine = np.flatnonzero((facts[:, 3] == side) & (facts[:, 4] > 0) & (facts[:, 0] >= 6 + side))
        covered = np.concatenate(([2, 3], np.arange(6, 6 + side)))
        have = raw[where[mine] + 4].astype(np.uint32) << 8 | raw[where[mine] + 5]
        fields, inverse = np.unique(raw[where[mine][:, None] + covered], axis=0, return_inverse=True)
        keep[mine] = crc16(fields)[inverse.reshape(-1)] == have
    good, facts = where[keep], facts[keep]
    table, table_off, seek_off = None, 0, -1
    if len(good):
        body = int(good[0]) + 4 + 2 * int(facts[0, 4]) + int(facts[0, 3])
        if data[body : body + 4] in (b"Xing", b"Info") and data[body + 7] & 3 == 3:
            first, good, facts = int(good[0]), good[1:], facts[1:]
            points = data[body + 16 : body + 116] if data[body + 7] & 4 else b""
            table = (int.from_bytes(data[body + 8 : body + 12], "big"), int.from_bytes(data[body + 12 : body + 16], "big"), points)
            table_off = abs(table[0] - len(good) - int((~keep).sum()))
            if len(points) == 100 and len(good):
                due = good[np.arange(100) * len(good) // 100]  # the frame at each hundredth of the duration
                seek_off = int(np.abs(first + np.frombuffer(points, np.uint8).astype(np.int64) * table[1] // 256 - due).max())
    rates = len(np.unique(raw[good + 2] >> 4))
    return {
        "offsets": good, "samples": int(facts[:, 1].sum()), "hertz": int(facts[0, 2]) if len(facts) else 0, "bitrates": rates, "skipped": skipped,
        "bad": int((~keep).sum()), "table": table, "table_off": table_off, "seek_off": seek_off, "tag_bytes": tag, "texts": texts, "old_tag": tail,
    }


def decode(data: bytes, found: dict) -> bytes:
    """Payload of a stream from encode()."""
    raw = np.frombuffer(data, np.uint8)
    return raw[found["offsets"][:, None] + np.arange(BODY, BODY + UNIT)].tobytes()


def _stored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in sliced(batches):
        media = [encode(b + b"\xff" * (-len(b) % UNIT or UNIT * (not b))) for b in batch["body"]]
        yield pd.DataFrame({"id": batch["id"], "n_bytes": batch["body"].map(len), "media": media})


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in sliced(batches):
        rows = []
        for data in batch["media"]:
            found = parse(data)
            payload = decode(data, found)
            if found["texts"].get("payload", str(len(payload))) != str(len(payload)) and not found["bad"] and not found["skipped"]:
                raise ValueError("the stream holds another number of payload bytes than its tag states")
            # mean and spread of the samples, and the share of sample pairs that change
            x = np.frombuffer(payload, np.uint8)
            mean, spread = (float(x.mean()), float(x.std())) if len(x) else (0.0, 0.0)
            moves = float((x[1:] != x[:-1]).mean()) if len(x) > 1 else 0.0
            feature = (
                f"frames={len(found['offsets'])};table_off={found['table_off']};seek_off={found['seek_off']};bad={found['bad']};skipped={found['skipped']};"
                f"mean={mean:.6f};std={spread:.6f};moves={moves:.6f}"
            )
            rows.append((
                len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(),
                feature, found["samples"], found["hertz"], found["samples"] / found["hertz"] if found["hertz"] else 0.0,
                found["offsets"].tolist(), found["bad"], found["skipped"],
            ))
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "hertz", "seconds", "offsets", "bad_frames", "skipped_bytes"]
        yield pd.concat([batch[["id", "n_bytes"]], pd.DataFrame(rows, columns=names)], axis=1)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text (null: empty), padded with bytes 255 to a positive multiple of 576, as a stream.

    Repeated rows and rows without an id give streams like others. Other columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    body = F.coalesce(quoted(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(quoted(id_col).cast("string").alias("id"), body.alias("body"))  # whole numbers with nulls aren't exact in pandas
    media = rows.mapInPandas(_stored, "id string, n_bytes long, media binary")
    return media.withColumn("id", F.col("id").cast(kind))


def media_facts(media: DataFrame) -> DataFrame:
    """What reading the streams back gives, one row each: payload, checksums, exact samples / hertz, and offsets of all
    frames. Frames with a wrong checksum are counted in bad_frames and left out."""
    kind = media.schema["id"].dataType.simpleString()
    facts = media.withColumn("id", F.col("id").cast("string")).mapInPandas(
        _read,
        "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
        "samples long, hertz int, seconds double, offsets array<long>, bad_frames int, skipped_bytes long",
    )
    return facts.withColumn("id", F.col("id").cast(kind))
