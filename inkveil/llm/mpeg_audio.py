"""Media columns, MPEG audio: writing and reading Layer III streams, exact durations and seek offsets.

A stream is an ID3v2.3 tag, an information frame with a Xing variable-bitrate table, audio frames with CRC-16
checks, and an ID3v1 tag. A stored payload lies in the frames' main data behind an all-zero side
information, which decoders play as silence; the tag holds its length.

The reader knows Layers I, II and III of MPEG-1, 2 and 2.5, ID3v2.2 to 2.4 and ID3v1 tags, Xing, Info and VBRI
tables. It trusts nothing: after junk it looks for the next header that is followed by another of the same kind (or
by the end), verifies the checksums of Layers I and III (those of Layer II depend on allocation tables and are
counted as unchecked), and takes durations and the offset of every frame from frames, not from the table. An
encoder's delay and padding, where its table tells them, are given beside the exact duration of all samples.

Defined cases: null text is empty and is stored as 64 zero bytes; truncated or corrupted streams give the
frames that remain, with counts of skipped bytes and failed checks; bytes without any frame give a duration
of 0 and no offsets; free-format streams aren't read; very long texts are stored whole, in one task; equal texts give
equal streams; an empty table gives no rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from inkveil.llm.common import small_batches, table, trimmed

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by version (1, or the later ones) and layer, and sampling rates, by header fields.
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ_V1 = (44100, 48000, 32000)
CRC_POLYNOMIAL, CRC_START = 0x8005, 0xFFFF

SIDE_MONO_V1, HEAD = 17, 6  # side information; header and checksum
PAYLOAD_TAG = "inkveil.payload"
MOST_KEPT = 4096  # headers and checksums that are told apart once
VBRI_AT = 36  # from a frame's start
#: Text frames of ID3v2.2 and what later versions call them.
OLD_TAGS = {"TT2": "TIT2", "TP1": "TPE1", "TAL": "TALB", "TYE": "TYER", "TRK": "TRCK", "TCO": "TCON", "TXX": "TXXX"}


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        r = b << 8
        for _ in range(8):
            r = ((r << 1) ^ CRC_POLYNOMIAL) & 0xFFFF if r & 0x8000 else r << 1
        out.append(r)
    return out


CRC_TABLE = _crc_table()


def frame_crc(protected: bytes) -> int:
    """CRC-16 over the last two header bytes and the side information."""
    r = CRC_START
    for b in protected:
        r = ((r << 8) & 0xFFFF) ^ CRC_TABLE[(r >> 8) ^ b]
    return r


def header_fields(h: int) -> dict | None:
    """version (1, 2 or 2.5), layer, hertz, kbps, length, samples, protected, mono, side (bytes of side information), covered (bytes that a checksum covers beside the header's; None: not known) of a header; None if it isn't one."""
    if h >> 21 != 0x7FF or (h >> 19) & 3 == 1 or (h >> 17) & 3 == 0:
        return None
    bits, rate, layer = (h >> 12) & 15, (h >> 10) & 3, 4 - ((h >> 17) & 3)
    if bits in (0, 15) or rate == 3:
        return None
    version = {3: 1, 2: 2, 0: 2.5}[(h >> 19) & 3]
    hertz = HERTZ_V1[rate] // {1: 1, 2: 2, 2.5: 4}[version]
    kbps = KBPS[1 if version == 1 else 2, layer][bits]
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    padding, mode = (h >> 9) & 1, (h >> 6) & 3
    length = (12 * kbps * 1000 // hertz + padding) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hertz + padding
    mono = mode == 3
    side = 0 if layer < 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    bound = 4 * (((h >> 4) & 3) + 1) if mode == 1 else 32  # subbands that both channels of Layer I allocate by themselves
    covered = (side, None, (32 + (0 if mono else bound)) // 2)[3 - layer]
    return {"version": version, "layer": layer, "hertz": hertz, "kbps": kbps, "samples": samples, "length": length, "protected": not (h >> 16) & 1, "side": side, "covered": covered, "mono": mono}


def _header(bitrate: int) -> int:
    """MPEG-1 Layer III, protected, 44.1 kHz, mono."""
    return 0x7FF << 21 | 3 << 19 | 1 << 17 | bitrate << 12 | 3 << 6


FRAMES = {i: header_fields(_header(i))["length"] for i in range(1, 15)}
HEADERS = {i: struct.pack(">I", _header(i)) + struct.pack(">H", frame_crc(struct.pack(">I", _header(i))[2:] + bytes(SIDE_MONO_V1))) + bytes(SIDE_MONO_V1) for i in FRAMES}
ROOM = {i: n - HEAD - SIDE_MONO_V1 for i, n in FRAMES.items()}


def _synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 127 for s in (21, 14, 7, 0))


def encode(payload: bytes, title: str = "") -> bytes:
    """payload as a Layer III stream of variable bitrate: full frames at 320 kbit/s, the rest in the smallest frame that holds it."""
    full, left = divmod(len(payload), ROOM[14])
    body = np.zeros((full, FRAMES[14]), np.uint8)
    body[:, : HEAD + SIDE_MONO_V1] = np.frombuffer(HEADERS[14], np.uint8)
    body[:, HEAD + SIDE_MONO_V1 :] = np.frombuffer(payload, np.uint8, full * ROOM[14]).reshape(full, ROOM[14])
    parts = [body.tobytes()]
    if left:
        small = next(i for i, n in ROOM.items() if n >= left)
        parts.append(HEADERS[small] + payload[full * ROOM[14] :].ljust(ROOM[small], b"\0"))
    audio = b"".join(parts)
    frames = full + bool(left)
    sizes = [FRAMES[9], *[FRAMES[14]] * full, *([len(parts[1])] if left else [])]
    starts, total = np.concatenate([[0], np.cumsum(sizes)]), sum(sizes)
    toc = bytes(int(min(255, starts[1 + min(frames - 1, p * frames // 100)] * 256 // total)) if frames else 0 for p in range(100))
    xing = b"Xing" + struct.pack(">III", 7, frames, total) + toc
    info = HEADERS[9] + xing
    text = PAYLOAD_TAG.encode() + b"\0" + str(len(payload)).encode()
    tags = [(b"TIT2", title.encode("latin-1", "replace")), (b"TXXX", text)] if title else [(b"TXXX", text)]
    tags = b"".join(k + struct.pack(">IH", len(v) + 1, 0) + b"\0" + v for k, v in tags)
    id3v1 = b"TAG" + title.encode("latin-1", "replace")[:30].ljust(30, b"\0") + bytes(94) + b"\xff"
    return b"ID3\x03\0\0" + _synchsafe(len(tags)) + tags + info.ljust(FRAMES[9], b"\0") + audio + id3v1


def _tags(data: bytes) -> tuple[dict, int]:
    """Text frames of an ID3v2 tag at the start, and where it ends."""
    if len(data) < 10 or data[:3] != b"ID3" or data[3] not in (2, 3, 4):
        return {}, 0
    safe = lambda b: sum((x & 127) << s for x, s in zip(b, (21, 14, 7, 0)))
    end, at, out = min(len(data), 10 + safe(data[6:10])), 10, {}
    id_, head = (3, 6) if data[3] == 2 else (4, 10)
    while at + head <= end and data[at]:
        key = data[at : at + id_].decode("latin-1")
        size = data[at + id_ : at + 2 * id_]
        n = safe(size) if data[3] == 4 else int.from_bytes(size)
        value = data[at + head : min(end, at + head + n)]
        if key[0] == "T" and value:
            key = OLD_TAGS.get(key, key)
            text = value[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1"), "replace")
            name, _, rest = text.partition("\0")
            out[f"TXXX:{name}" if key == "TXXX" else key] = rest.rstrip("\0") if key == "TXXX" else text.rstrip("\0")
        at += head + n
    return out, min(len(data), end + 10 * bool(data[5] & 16))


def _table(frame: bytes, main: bytes) -> dict | None:
    """Frames, bytes, seek table, delay and padding of an information frame; None if it is audio."""
    out: dict = {}
    if main[:4] in (b"Xing", b"Info"):
        flags, p = int.from_bytes(main[4:8]), 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(main[p : p + 4])
                p += 4
        if flags & 4:
            out["toc"] = list(main[p : p + 100])
            p += 100
        p += 4 * bool(flags & 8)
        if main[p : p + 4] in (b"LAME", b"Lavc", b"Lavf") and len(main) >= p + 24:
            both = int.from_bytes(main[p + 21 : p + 24])
            out |= {"delay": both >> 12, "padding": both & 0xFFF}
        return out
    if frame[VBRI_AT : VBRI_AT + 4] == b"VBRI" and len(frame) >= VBRI_AT + 26:
        delay, size, frames, n, scale, width, every = struct.unpack(">H2xIIHHHH", frame[VBRI_AT + 6 : VBRI_AT + 26])
        raw = frame[VBRI_AT + 26 : VBRI_AT + 26 + n * width]
        toc = [int.from_bytes(raw[i : i + width]) * scale for i in range(0, len(raw), width)] if width else []
        return {"frames": frames, "bytes": size, "toc": toc, "every": every, "delay": delay, "padding": 0}
    return None


def parse(data: bytes) -> dict:
    """tags, frame count, exact samples and seconds, offset of every frame, checks, failed and unknown ones, skipped bytes, table, payload of a stream."""
    tags, at = _tags(data)
    end = len(data) - (128 if len(data) >= 128 and data[-128:-125] == b"TAG" else 0)
    cache: dict[bytes, tuple] = {}
    out = {"tags": tags, "frames": 0, "samples": 0, "hertz": 0, "layer": 0, "checks": 0, "bad_checks": 0, "unchecked": 0, "skipped": 0, "vbr": None, "kbps": {}, "offsets": []}
    chunks = []

    def head(i: int) -> tuple | None:
        """length, fields of a header at i that fits what is left."""
        key = data[i : i + 4]
        if len(key) < 4:
            return None
        if key not in cache:
            cache[key] = header_fields(int.from_bytes(key))
        f = cache[key]
        return f if f and i + f["length"] <= end else None

    kind = lambda f: (f["version"], f["layer"], f["hertz"])
    synced = False
    while at + 4 <= end:
        f = head(at)
        nxt = at + f["length"] if f else 0
        if f and not synced:  # a chance sync word: ask for a second header of the same kind, or for the end
            g = head(nxt)
            if nxt != end and (g is None or kind(g) != kind(f)):
                f = None
        if not f:
            synced = False
            i = data.find(b"\xff", at + 1, end)
            out["skipped"] += (end if i < 0 else i) - at
            at = end if i < 0 else i
            continue
        synced = True
        body = at + (6 if f["protected"] else 4)
        main = data[body + f["side"] : nxt]
        if f["protected"] and f["covered"] is None:
            out["unchecked"] += 1
        elif f["protected"]:
            out["checks"] += 1
            key = data[at + 2 : at + 4] + data[body : body + f["covered"]]
            if key not in cache:
                if len(cache) >= MOST_KEPT:
                    cache.clear()
                cache[key] = frame_crc(key)
            out["bad_checks"] += cache[key] != int.from_bytes(data[at + 4 : at + 6])
        if not out["frames"] and out["vbr"] is None and f["layer"] == 3:
            out["vbr"] = _table(data[at:nxt], main)
            if out["vbr"] is not None:
                at = nxt
                continue
        out["offsets"].append([out["samples"], at])
        out["frames"] += 1
        out["samples"] += f["samples"]
        out["hertz"], out["layer"] = f["hertz"], f["layer"]
        out["kbps"][f["kbps"]] = out["kbps"].get(f["kbps"], 0) + 1
        chunks.append(main)
        at = nxt
    out["skipped"] += max(0, end - at)
    out["seconds"] = out["samples"] / out["hertz"] if out["hertz"] else 0.0
    spare = sum((out["vbr"] or {}).get(k, 0) for k in ("delay", "padding"))
    out["played_seconds"] = max(0, out["samples"] - spare) / out["hertz"] if out["hertz"] else 0.0
    size = tags.get(f"TXXX:{PAYLOAD_TAG}", "")
    size = int(size) if size.isdecimal() else 0
    out["payload"] = b"".join(chunks)[:size]
    return out


def padded(text: bytes) -> bytes:
    """text with zero bytes up to a positive multiple of 64."""
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, media: every text stored as a stream."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            media = [encode(padded((t or "").encode())) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(trimmed(run), "doc_id long, media binary")


def probe(media: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """key, and of every stream: seconds of all samples and without an encoder's delay, layer, frames, hertz, failed and unknown checks, skipped bytes, tags, table, each frame's offset (sample, byte)."""
    numbers = {"seconds": "double", "played_seconds": "double", "samples": "long", "hertz": "int", "layer": "int", "frames": "long", "bad_checks": "long", "unchecked": "long", "skipped": "long"}
    schema = f"{key} long, {', '.join(f'{n} {t}' for n, t in numbers.items())}, tags map<string,string>, toc array<int>, offsets array<array<long>>"

    def run(batches):
        for b in batches:
            found = [parse(x or b"") for x in b.column(1).to_pylist()]
            cols = [[x[k] for x in found] for k in numbers]
            tail = [pa.array([list(x["tags"].items()) for x in found], pa.map_(pa.string(), pa.string())), pa.array([(x["vbr"] or {}).get("toc") for x in found], pa.list_(pa.int32())), pa.array([x["offsets"] for x in found], pa.list_(pa.list_(pa.int64())))]
            kinds = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32()}
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[pa.array(c, kinds[t]) for c, t in zip(cols, numbers.values())], *tail], [key, *numbers, "tags", "toc", "offsets"])

    return media.select(key, column).mapInArrow(trimmed(run), schema)


def digest_row(text: str | None) -> tuple:
    raw = (text or "").encode()
    media = encode(padded(raw))
    x = parse(media)
    back = x["payload"]
    feature = {k: x[k] for k in ("frames", "samples", "hertz", "checks", "bad_checks", "skipped")} | {"seconds": round(x["seconds"], 6), "kbps": {str(k): v for k, v in sorted(x["kbps"].items())}, "vbr_frames": (x["vbr"] or {}).get("frames"), "vbr_bytes": (x["vbr"] or {}).get("bytes"), "seek_points": len(x["offsets"]), "seek_crc32": zlib.crc32(np.array(x["offsets"], "<i8").tobytes()), "last_seek": x["offsets"][-1] if x["offsets"] else None}
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), json.dumps(feature, sort_keys=True, separators=(",", ":"))


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a stream, read back and described. Encoded and parsed batch by batch, so media are never shuffled or kept."""
    small_batches(spark)
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            rows = list(zip(*(digest_row(t) for t in b.column(1).to_pylist()))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[pa.array(c, k) for c, k in zip(rows, kinds)]], ["doc_id", *names])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(trimmed(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


QUERIES, ORACLES = {"op8_mpeg_audio": op8_mpeg_audio}, {}
