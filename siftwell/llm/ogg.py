"""Media columns: Ogg pages, packets, logical streams and timestamps.

``multiplexed`` stores bytes as 8-bit samples of one logical stream beside a second
stream of check packets; ``demultiplexed`` verifies every page checksum, puts packets
together from their lacing values, separates the streams by serial number and derives
times from granule positions.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import parts, released, table, text_of

# Fixed values of the format.
CAPTURE = b"OggS"
PAGE_HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1
#: Identification packet of unsigned 8-bit PCM: magic, version, format, rate, bits, channels, frames a packet, extra headers.
PCM_HEAD = struct.Struct(">8sHHIIBBHI")
PCM_MAGIC, PCM_U8 = b"PCM     ", 1
CHECK_MAGIC = b"CRC32   "

FRAME = 192
RATE = 8000
PACKET = 16 * FRAME
#: Packets of samples that one check packet covers.
CHECKED = 20
MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """The format's checksum: polynomial 0x04c11db7, most significant bit first, from 0.

    It mirrors the common CRC-32 bit for bit, so the latter is taken over mirrored bytes.
    """
    crc = zlib.crc32(page.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(MIRROR), "big")


def lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """The pages of one logical stream; packets are (bytes, granule position at its end).

    The first packet has a page of its own. Pages hold up to 255 segments, so long
    packets run over several pages.
    """
    out, number = [], 0
    runs = [packets[:1], packets[1:]] if len(packets) > 1 else [packets]
    for r, run in enumerate(runs):
        laced = b"".join(lacing(len(p)) for p, _ in run)
        body = b"".join(p for p, _ in run)
        grains = [g for _, g in run]
        ended = at = 0
        for lo in range(0, len(laced), 255):
            seg = laced[lo : lo + 255]
            flags = (FIRST if not out else 0) | (CONTINUED if lo and laced[lo - 1] == 255 else 0)
            flags |= LAST if r == len(runs) - 1 and lo + 255 >= len(laced) else 0
            done, size = len(seg) - seg.count(255), sum(seg)
            ended += done
            head = PAGE_HEAD.pack(CAPTURE, 0, flags, grains[ended - 1] if done else NO_GRANULE, serial, number, 0, len(seg)) + seg
            page = head + body[at : at + size]
            out.append(page[:22] + page_crc(page).to_bytes(4, "little") + page[26:])
            at, number = at + size, number + 1
    return out


def multiplexed(payload: bytes) -> bytes:
    """``payload`` as 8-bit samples, interleaved with a stream of checksums of the samples."""
    serial = zlib.crc32(payload)
    head = PCM_HEAD.pack(PCM_MAGIC, 0, 0, PCM_U8, RATE, 8, 1, PACKET, 0)
    cut = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    ends = [min(len(payload), (i + 1) * PACKET) for i in range(len(cut))]
    sound = pages(serial, [(head, 0), *zip(cut, ends, strict=True)])
    checks = [(b"".join(zlib.crc32(p).to_bytes(4, "little") for p in cut[i : i + CHECKED]), ends[min(i + CHECKED, len(cut)) - 1]) for i in range(0, len(cut), CHECKED)]
    check = pages(serial ^ 1, [(CHECK_MAGIC, 0), *checks])
    longer, shorter = (sound, check) if len(sound) >= len(check) else (check, sound)
    mixed = [sound[0], check[0]]
    rest, others = longer[1:], shorter[1:]
    for i, page in enumerate(rest):
        mixed.append(page)
        mixed += others[i : i + 1]
    return b"".join(mixed)


def demultiplexed(media: bytes) -> tuple[dict[int, dict], str]:
    """Logical streams by serial number, and what is wrong (empty if nothing is).

    A stream has ``packets``, their ``ends`` (granule position of the page on which the
    packet ends if it is the page's last, else -1), ``pages`` and ``closed``. Reading
    stops at the first fault, with what was sound before it.
    """
    streams: dict[int, dict] = {}
    at, size = 0, len(media)
    while at < size:
        if size - at < 27 or media[at : at + 4] != CAPTURE:
            return streams, f"no page at byte {at}"
        _, version, flags, granule, serial, number, crc, count = PAGE_HEAD.unpack_from(media, at)
        body = at + 27 + count
        laced = media[at + 27 : body]
        end = body + sum(laced)
        if version or len(laced) < count or end > size:
            return streams, f"broken page at byte {at}"
        if page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            return streams, f"wrong checksum at byte {at}"
        s = streams.get(serial)
        if s is None:
            if not flags & FIRST:
                return streams, f"stream {serial} has no first page"
            s = streams[serial] = {"packets": [], "ends": [], "pages": 0, "open": [], "closed": False}
        if number != s["pages"] or s["closed"] or bool(flags & CONTINUED) != bool(s["open"]):
            return streams, f"page out of order at byte {at}"
        s["pages"] += 1
        start = body
        run = body
        for lace in laced:
            run += lace
            if lace < 255:
                s["packets"].append(b"".join(s["open"]) + media[start:run] if s["open"] else media[start:run])
                s["ends"].append(-1)
                s["open"] = []
                start = run
        if start < run or (laced and laced[-1] == 255):
            s["open"].append(media[start:run])
        if any(x < 255 for x in laced):
            s["ends"][-1] = granule
        s["closed"] = bool(flags & LAST)
        at = end
    for serial, s in streams.items():
        if not s["closed"] or s["open"]:
            return streams, f"stream {serial} has no end"
    return streams, ""


def samples_of(media: bytes) -> dict:
    """The sample stream of ``media``: payload, page times in seconds, feature and error."""
    streams, error = demultiplexed(media)
    sound = next((s for s in streams.values() if s["packets"] and s["packets"][0][:8] == PCM_MAGIC), None)
    if sound is None:
        return {"payload": b"", "times": [], "feature": "", "error": error or "no sample stream"}
    _, _, _, kind, rate, _, _, _, _ = PCM_HEAD.unpack(sound["packets"][0])
    payload = b"".join(sound["packets"][1:])
    times = [g / rate for g in sound["ends"][1:] if g >= 0]
    check = next((s for s in streams.values() if s["packets"] and s["packets"][0] == CHECK_MAGIC), None)
    if not error and kind != PCM_U8:
        error = f"unknown sample format {kind}"
    if not error and check is not None and b"".join(check["packets"][1:]) != b"".join(zlib.crc32(p).to_bytes(4, "little") for p in sound["packets"][1:]):
        error = "samples differ from their check stream"
    x = np.frombuffer(payload, np.uint8)
    level = (x.astype(np.int64).sum(), (x.astype(np.int64) ** 2).sum()) if len(x) else (0, 0)
    n = max(1, len(x))
    feature = (
        f"streams={len(streams)};pages={sum(s['pages'] for s in streams.values())};packets={len(sound['packets']) - 1}"
        f";ms={round(1000 * (times[-1] if times else 0))};mean={level[0] / n:.4f};power={level[1] / n:.2f}"
        f";crossings={int(np.count_nonzero(np.diff(x >= 128))) if len(x) else 0};peak={int(x.max()) if len(x) else 0}"
    )
    return {"payload": payload, "times": times, "feature": feature, "error": error}


def padded(data: bytes) -> bytes:
    """``data`` and spaces up to a positive multiple of the frame size."""
    return data + b" " * (max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


#: Bytes of text or media that are worked on at a time.
SLICE = 1 << 21


@F.arrow_udf(T.BinaryType())
def store_media(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in parts(batches, SLICE):
        yield pa.array([multiplexed(padded((t or "").encode())) for t in texts.to_pylist()], pa.binary())
    released()


SAMPLES = (
    T.StructType()
    .add("payload", T.BinaryType())
    .add("times", T.ArrayType(T.DoubleType()))
    .add("feature", T.StringType())
    .add("error", T.StringType())
)


@F.arrow_udf(SAMPLES)
def read_media(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kinds = (pa.binary(), pa.list_(pa.float64()), pa.string(), pa.string())
    for media in parts(batches, SLICE):
        read = [samples_of(m or b"") for m in media.to_pylist()]
        yield pa.StructArray.from_arrays([pa.array([r[n] for r in read], k) for n, k in zip(SAMPLES.names, kinds, strict=True)], names=SAMPLES.names)
    released()


def with_media(df: DataFrame, text: str = "text", to: str = "media") -> DataFrame:
    """Add the media column ``to`` that stores the column ``text``; a null text is empty.

    A column named ``to`` is replaced. Equal texts give equal media.
    """
    return df.withColumn(to, store_media(text_of(text)))


def with_samples(df: DataFrame, media: str = "media", to: str = "samples") -> DataFrame:
    """Add the struct ``to`` (payload, times, feature, error) read from a media column.

    Bytes that are no sound file (null, empty, cut or changed ones too) never stop the
    job: ``error`` says what is wrong, and is empty otherwise.
    """
    return df.withColumn(to, read_media(F.col(f"`{media}`")))


def op7_ogg_media(spark, sf_dir: str) -> DataFrame:
    """Every document's text stored as samples in a media column and read back from it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = with_media(docs).select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), "media")
    read = with_samples(stored)
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples.payload").cast("long").alias("payload_bytes"),
        F.sha2("samples.payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples.payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("samples.feature").alias("feature"),
        F.col("samples.error").alias("error"),
    )


QUERIES = {"op7_ogg_media": op7_ogg_media}
ORACLES: dict[str, str] = {}
