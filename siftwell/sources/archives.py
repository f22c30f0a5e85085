"""Zip archives as file tables.

An archive's directory is at its end. Listing reads that alone, and gives a row for each entry with its range of bytes;
entries are then dealt out by ranges, and a task reads its own ranges and no others, one entry at a time.
"""

from __future__ import annotations

import bz2
import lzma
import struct
import zipfile
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.sources.file_sink import opened
from siftwell.sources.shared import written

LISTED = "archive string, name string, at long, stored long, size long, method int, crc long, flags int, error string"
ENTRIES = "archive string, name string, content binary, error string"
#: Stored bytes of entries that a task reads.
RANGE = 64 << 20
_ENCRYPTED, _UTF8 = 1, 0x800
# Fixed value: the head of an entry, and how it begins.
HEAD, BEGIN = struct.Struct("<4s5H3I2H"), b"PK\x03\x04"


class _Seen:
    """A file as ``zipfile`` wants it: an impossible place is an OSError."""

    def __init__(self, f):
        self.read, self.tell, self._file = f.read, f.tell, f

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            return self._file.seek(offset, whence)
        except pa.ArrowInvalid as e:
            raise OSError(str(e)) from e


def zip_listing(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, at, stored, size, method, crc, flags, error): a row for each file, from the archives' directories; a bad archive is one row with its error."""
    archives = spark.read.format("binaryFile").load(path).select("path")  # paths only: no content is read

    def run(batches):
        for pdf in batches:
            for archive in pdf.path:
                rows = []
                try:
                    system, where = opened(archive)
                    with system.open_input_file(where) as f, zipfile.ZipFile(_Seen(f)) as z:
                        rows = [(archive, e.filename, e.header_offset, e.compress_size, e.file_size, e.compress_type, e.CRC, e.flag_bits, None) for e in z.infolist() if not e.is_dir()]
                except Exception as e:  # whatever is wrong with an archive is a row, by contract
                    rows = [(archive, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in LISTED.split(", ")])

    return archives.mapInPandas(run, LISTED)


def _unpacked(data: bytes, method: int) -> bytes:
    if method == zipfile.ZIP_STORED:
        return data
    if method == zipfile.ZIP_DEFLATED:
        return zlib.decompress(data, -zlib.MAX_WBITS)
    if method == zipfile.ZIP_BZIP2:
        return bz2.decompress(data)
    if method == zipfile.ZIP_LZMA:
        size = int.from_bytes(data[2:4], "little")
        properties = lzma._decode_filter_properties(lzma.FILTER_LZMA1, data[4 : 4 + size])
        return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[properties]).decompress(data[4 + size :])
    raise NotImplementedError(f"method {method}")


def _read(f, entry) -> bytes:
    """The content of one entry; an error if it is not what the directory says."""
    if entry.flags & _ENCRYPTED:
        raise RuntimeError("encrypted")
    f.seek(entry.at)
    head = HEAD.unpack(f.read(HEAD.size))
    if head[0] != BEGIN:
        raise zipfile.BadZipFile("no entry here")
    f.seek(entry.at + HEAD.size + head[9] + head[10])
    content = _unpacked(f.read(entry.stored), entry.method)
    if len(content) != entry.size or zlib.crc32(content) != entry.crc:
        raise zipfile.BadZipFile("size or checksum differs")
    return content


def zip_entries(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """(archive, name, content, error): a row for each file in the archives at ``path``.

    A bad archive is one row with its error, and so is a bad entry. A task gets neighbouring entries of about ``range_bytes``, however large
    their archive is, and holds one entry at a time.
    """
    listed = written(zip_listing(spark, path), "listing")
    total = listed.agg(F.sum("stored").alias("n")).first().n or 0
    tasks = max(1, -(-total // range_bytes))
    dealt = listed.where("error IS NULL").repartitionByRange(tasks, "archive", "at").sortWithinPartitions("archive", "at")

    def run(batches):
        held, f = None, None
        try:
            for pdf in batches:
                for entry in pdf.itertuples(index=False):
                    if entry.archive != held:
                        if f is not None:
                            f.close()
                        system, where = opened(entry.archive)
                        held, f = entry.archive, system.open_input_file(where)
                    try:
                        row = (entry.archive, entry.name, _read(f, entry), None)
                    except Exception as e:  # the same for an entry
                        row = (entry.archive, entry.name, None, f"{type(e).__name__}: {e}")
                    yield pd.DataFrame([row], columns=["archive", "name", "content", "error"])
        finally:
            if f is not None:
                f.close()

    bad = listed.where("error IS NOT NULL").select("archive", "name", F.lit(None).cast("binary").alias("content"), "error")
    return dealt.mapInPandas(run, ENTRIES).unionByName(bad)
