"""64-bit hashes as hexadecimal text and signed integers."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64
#: Words whose digests a worker holds, and bytes of the longest of them.
HELD, LONGEST = 131_072, 64
#: Bytes of text that are split into words at once, and different words whose bits are added at once.
PIECE, ADDED = 1 << 20, 4096


def hex_to_long(h: Column) -> Column:
    """Sixteen hexadecimal digits as a signed 64-bit integer (two's complement)."""
    return F.conv(h, 16, -10).cast("long")


def valid_hash(h: Column) -> Column:
    """Exactly sixteen lower-case hexadecimal digits; null counts as invalid."""
    return F.coalesce(h.rlike(r"\A[0-9a-f]{16}\z"), F.lit(False))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two longs differ; null if one is null."""
    return F.bit_count(a.bitwiseXOR(b))


def bits_lsb_first(h: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("shiftrightunsigned", h, i).bitwiseAND(F.lit(1)).cast("int"))


def simhash(tokens: DataFrame, key: str, token: str) -> DataFrame:
    """(key, phash) of a table with a row for each token occurrence; a bit is set if it is in most occurrences.

    Sums are partial aggregates: where a key's tokens come from one row, one row of sums is
    shuffled for it and no token. A sum counts two bits, 32 places apart, so a key may have 2^31 - 1 occurrences. Null
    keys are one key, null tokens don't count, an empty table gives an empty one.
    """
    rows = tokens.where(F.col(token).isNotNull()).select(key, hex_to_long(F.substring(F.md5(token), 1, 16)).alias("__sw_v"))
    pair = lambda i: F.shiftrightunsigned("__sw_v", i).bitwiseAND(F.lit((1 << 32) + 1))
    sums = rows.groupBy(key).agg(F.count("*").alias("__sw_n"), *[F.sum(pair(i)).alias(f"s{i}") for i in range(BITS // 2)])
    h = F.lit(0).cast("long")
    for i in range(BITS):
        count = F.shiftrightunsigned(f"s{i - 32}", 32) if i >= 32 else F.col(f"s{i}").bitwiseAND(F.lit((1 << 32) - 1))
        h = h.bitwiseOR(F.when(2 * count > F.col("__sw_n"), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(key, F.lower(F.lpad(F.hex(h), 16, "0")).alias("phash"))


class _Digests(dict):
    """The first eight bytes of the MD5 of words. The first short ones are held, up to a bound; no result depends on it."""

    def __missing__(self, word: bytes) -> bytes:
        digest = hashlib.md5(word).digest()[: BITS // 8]
        if len(self) < HELD and len(word) <= LONGEST:
            self[word] = digest
        return digest


_DIGESTS = _Digests()


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text, cut at spaces."""
    lo = 0
    while lo < len(text):
        hi = text.find(b" ", lo + PIECE)
        hi = len(text) if hi < 0 else hi
        yield text[lo:hi]
        lo = hi + 1


def _measures(text: bytes) -> tuple[int, int, str]:
    """Words, different words and SimHash of a text, of which words end at spaces."""
    counts: Counter[bytes] = Counter()
    for piece in _pieces(text):
        counts.update(piece.split(b" "))
    counts.pop(b"", None)
    words, each = list(counts), np.fromiter(counts.values(), float, len(counts))
    sums = np.zeros(BITS)
    for lo in range(0, len(words), ADDED):
        bits = np.unpackbits(np.frombuffer(b"".join(map(_DIGESTS.__getitem__, words[lo : lo + ADDED])), np.uint8))
        sums += each[lo : lo + ADDED] @ bits.reshape(-1, BITS)
    n = counts.total()
    return n, len(words), np.packbits(2 * sums > n).tobytes().hex()


def word_hashes(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns beside ``text``, and n_words, n_distinct and phash (as ``simhash``) of its lower-case words, in one pass over the texts.

    Words end at spaces; a null text has none, and without words the hash is of zeros.
    """
    others = [c for c in docs.columns if c != text]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_measures(x.as_py()) for x in batch["__sw_text"]]
            n, distinct, phash = zip(*found, strict=True) if found else ((), (), ())
            made = [pa.array(n, pa.int64()), pa.array(distinct, pa.int64()), pa.array(phash, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in others), *made], names=[*others, "n_words", "n_distinct", "phash"])

    rows = docs.select(*others, F.lower(F.coalesce(text, F.lit(""))).cast("binary").alias("__sw_text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != text)
    return rows.mapInArrow(run, f"{schema}n_words long, n_distinct long, phash string")
