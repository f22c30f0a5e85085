"""Token ids of whole texts by a public tokenizer, and their Simple-8b files.

``encoder`` gives the ids that the tokenizers library gives for the whole text (with its
settings as they are: the string of a special token is that token), but
asks it for a unit, such as a word, only where a worker doesn't know it. ``pack`` and
``unpack`` are Simple-8b: a selector in the top four bits of a 64-bit word says how
many ids of how many bits the other sixty hold. Values of over sixty bits are
escaped to a list of their own.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import released, remembered, slices, table, text_of, written

#: Bytes of text that are encoded at a time.
SLICE = 1 << 19
#: A worker's table of known units: places, longest unit in bytes, most ids of one.
PLACES, LONGEST, MOST = 1 << 20, 23, 10

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_OTHER, _LETTER, _STOP, _LINE, _SPACE = range(5)


def byte_letters() -> np.ndarray:
    """Code point of the letter that byte-level tokenizers write for each byte: itself if it prints, else the next from 256 on."""
    out, spare = np.zeros(256, "<u4"), 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            out[byte] = byte
        else:
            out[byte], spare = spare, spare + 1
    return out


def byte_classes() -> np.ndarray:
    """Classes of bytes; the bytes of letters up to U+024F count as letters (``odd_letters`` has the exceptions)."""
    out = np.zeros(256, np.uint8)
    for lo, hi in ((65, 90), (97, 122), (0x80, 0xBF), (0xC3, 0xC9)):
        out[lo : hi + 1] = _LETTER
    out[[46, 44]], out[10], out[32] = _STOP, _LINE, _SPACE
    return out


def odd_letters(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Which of the two-byte characters at ``lead`` are no letter, or not lower-cased letter by letter."""
    one, two = data[lead], data[lead + 1]
    return ((one == 0xC3) & ((two == 0x97) | (two == 0xB7))) | ((one == 0xC4) & (two == 0xB0)) | ((one == 0xC9) & (two >= 0x90))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of starts[0], starts[0] + 1, ... (counts[0] of them), then those from starts[1] on, and so forth."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Ids of texts, worked out unit by unit.

    Both tokenizers used here cut a text before a single space (or at it) whatever stands
    around it. Between spaces, they cut words of letters, a stop or comma after a
    word, a line break after that, and the next word. Units are these, or all between two spaces where it
    isn't of this form. Texts with two spaces in a row, a space at an end, a zero byte or
    the mark of a special token go to the library whole.

    A worker knows units by a table of ``PLACES`` places: a unit's bytes, at most ``LONGEST``, are its
    key, compared whole, and a new unit takes the place of the one before, so memory is
    bounded. Units not in the table go to the library many at a time, words straight to its model,
    as all that normalizer and pre-tokenizer would leave to do.
    """

    def __init__(self, name: str, end_id: int, spaced: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import public_tokenizers
        from tokenizers import Tokenizer

        path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        # The library's model alone: words between spaces, already as the normalizer and the pre-tokenizer leave them.
        model |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
        self.words = Tokenizer.from_str(json.dumps(model))
        vocabulary, suffix = model["model"]["vocab"], model["model"].get("end_of_word_suffix") or ""
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        if len(self.sizes) > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        for token, i in vocabulary.items():
            self.sizes[i] = len(token) - (len(suffix) if suffix and token.endswith(suffix) else 0)
        self.spaced, self.end = spaced, array("I", [end_id]).tobytes()
        self.classes, self.letters = byte_classes(), byte_letters()
        self.letters[10] = 32  # separates the words that go to the model
        self.keys = [np.zeros(PLACES, np.uint64) for _ in range(3)]
        self.counts, self.ids = np.zeros(PLACES, np.uint8), np.zeros((PLACES, MOST), np.uint16)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, data: bytes, firsts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(starts, ends, after a space, of letters) of the units of ``data``, texts that begin at ``firsts``, a space before each; and which bytes are in pieces of another form."""
        buf = np.frombuffer(data, np.uint8)
        kind = self.classes[buf]
        # Neighbours: a stop follows a letter and ends a line or a piece; a break follows a stop; what is else makes its piece one unit.
        before, after = np.concatenate([[_SPACE], kind[:-1]]), np.concatenate([kind[1:], [_SPACE]])
        bad = kind == _OTHER
        stop, line = kind == _STOP, kind == _LINE
        bad |= stop & ((before != _LETTER) | (after == _LETTER) | (after == _STOP) | (after == _OTHER))
        bad |= line & ((before != _STOP) | ((after != _LETTER) & (after != _SPACE)))
        lead = np.flatnonzero(buf >= 0xC3)
        bad[lead[odd_letters(buf, np.minimum(lead, len(buf) - 2))]] = True
        begins = np.flatnonzero(kind == _SPACE) + 1
        whole = np.zeros(len(begins), bool)
        whole[np.searchsorted(begins, np.flatnonzero(bad), side="right") - 1] = True
        cuts = np.flatnonzero(stop | line | ((before == _LINE) & (kind == _LETTER)))
        cuts = cuts[~whole[np.searchsorted(begins, cuts, side="right") - 1]]
        mark = np.zeros(len(buf), bool)
        mark[begins] = mark[cuts] = True
        starts = np.flatnonzero(mark)
        ends = np.append(starts[1:], len(buf) + 1)
        opens = before[starts] == _SPACE
        ends = ends - np.append(opens[1:], True)
        spaced = opens.copy()
        spaced[np.searchsorted(starts, firsts)] = False
        piece = np.searchsorted(begins, starts, side="right") - 1
        odd = np.zeros(len(buf), bool)
        if whole.any():
            odd[1:] = np.repeat(whole, np.diff(begins, append=len(buf) + 1))[: len(buf) - 1]
        return starts, ends, spaced & self.spaced, (kind[starts] == _LETTER) & ~whole[piece], odd

    def by_model(self, words: list[bytes], at_once: int = 1000) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many for each) of words, joined for the library and told apart by the lengths of their tokens."""
        flat, counts = [], []
        for lo in range(0, len(words), at_once):
            joined = b"\n".join(words[lo : lo + at_once])
            if not self.spaced:
                joined = joined.decode().lower().encode()
            own = np.frombuffer(joined, np.uint8)
            ids = np.array(self.words.encode_batch_fast([self.letters[own].tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids)
            gaps = np.flatnonzero(own == 10)
            ends = np.append(gaps, len(own)) - np.arange(len(gaps) + 1)
            reached = np.cumsum(self.sizes[ids])
            cuts = np.searchsorted(reached, ends)
            if not np.array_equal(reached[cuts], ends):
                raise ValueError("tokens run over the end of a word")
            flat.append(ids)
            counts.append(np.diff(cuts, prepend=-1))
        return (np.concatenate(flat), np.concatenate(counts)) if flat else (np.empty(0, np.int64), np.empty(0, np.int64))

    def learn(self, words: list[bytes], others: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many for each) of units; those after a space have it before them."""
        flat, counts = self.by_model(words)
        rest = self.library([w.decode() for w in others])
        return np.concatenate([flat, *rest]).astype(np.uint16), np.concatenate([counts, np.array([len(r) for r in rest], np.int64)])

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        sizes = np.array([len(r) for r in raw])
        data = b" " + b" ".join(raw)
        firsts = np.cumsum(sizes + 1) - sizes
        starts, ends, spaced, letters, odd = self.units(data, firsts)
        if not self.spaced:
            # The library composes before it lower-cases, so what may hold marks that compose goes to it as it stands.
            buf = np.frombuffer(data, np.uint8)
            data = np.where((buf >= 65) & (buf <= 90) & ~odd, buf | 32, buf).astype(np.uint8).tobytes()
        size = ends - starts
        eight = np.ndarray((len(data) + 17,), "<u8", data + bytes(24), strides=(1,))  # the eight bytes from each place on
        key = [eight[starts + 8 * i] & _FIRST[np.clip(size - 8 * i, 0, 8)] for i in range(3)]
        key[2] |= spaced.astype(np.uint64) << np.uint64(56)
        place = key[0] * _C[0] ^ key[1] * _C[1] ^ key[2] * _C[2]
        place = (((place ^ (place >> np.uint64(32))) * _C[0]) >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)
        short = size <= LONGEST
        known = short & (self.keys[0][place] == key[0])
        known[known] = (self.keys[1][place[known]] == key[1][known]) & (self.keys[2][place[known]] == key[2][known])
        counts = np.zeros(len(starts), np.int64)
        counts[known] = self.counts[place[known]]
        table = self.ids[place[known]]
        new = np.flatnonzero(~known)
        number: dict[bytes, int] = {}
        example: list[int] = []
        own = []
        # Words first, then the rest, so that each kind goes to the library in one.
        new = np.concatenate([new[letters[new]], new[~letters[new]]])
        n_words = 0
        for i, lo, hi, word in zip(new.tolist(), (starts - spaced)[new].tolist(), ends[new].tolist(), letters[new].tolist(), strict=True):
            unit = data[lo:hi]
            at = number.setdefault(unit, len(example))
            if at == len(example):
                example.append(i)
                n_words += word
            own.append(at)
        units = list(number)
        flat, many = self.learn(units[:n_words], units[n_words:])
        first = np.cumsum(many) - many
        own = np.array(own, np.int64)
        counts[new] = many[own] if len(own) else 0
        ids = np.empty(int(counts.sum()), np.uint16)
        at = np.cumsum(counts) - counts
        ids[np.repeat(known, counts)] = table[np.arange(MOST) < counts[known][:, None]]
        if len(own):
            ids[ranges(at[new], counts[new])] = flat[ranges(first[own], many[own])]
            example = np.array(example)
            keep = np.flatnonzero(short[example] & (many <= MOST))
            spots, one = np.unique(place[example[keep]], return_index=True)
            keep = keep[one]
            for held, k in zip(self.keys, key, strict=True):
                held[spots] = k[example[keep]]
            self.counts[spots] = many[keep]
            self.ids[spots] = flat[np.minimum(first[keep][:, None] + np.arange(MOST), len(flat) - 1)]
        cuts = at[np.searchsorted(starts, firsts)]
        return np.split(ids.astype("<u4"), cuts[1:])

    def many(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers, the end id last."""
        odd = [not t or t[0] == " " or t[-1] == " " or "  " in t or "<|" in t or "\0" in t for t in texts]
        plain = [t for t, o in zip(texts, odd, strict=True) if not o]
        some = iter(self._encoded(plain) if plain else ())
        whole = iter(self.library([t for t, o in zip(texts, odd, strict=True) if o]))
        return [(array("I", next(whole)) if o else next(some)).tobytes() + self.end for o in odd]


# How each tokenizer file treats the space before a word.
SPACED = {"byte_bpe_50k.json": True, "word_bpe_49k.json": False}


def encoder(name: str, end_id: int = 0) -> Encoder:
    return remembered(f"tokens of {name} and {end_id}", lambda: Encoder(name, end_id, SPACED[name]))


# Fixed values of the coding: ids in a word and bits of each, by selector. Zero bits: a run of zeros.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPED_FROM = 1 << 60
HEAD = struct.Struct("<4sIIII")
MAGIC = b"S8B1"


#: Bits that a number needs, by its value up to 16 bits.
WIDTHS = np.array([v.bit_length() for v in range(1 << 16)], np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs."""
    if not len(ids) or int(ids.max()) < len(WIDTHS):
        return WIDTHS[ids]
    out = np.zeros(len(ids), dtype=np.uint8)
    for shift in (0, 16, 32, 48):
        part = WIDTHS[(ids >> np.uint64(shift)) & np.uint64(0xFFFF)]
        out = np.where(part > 0, part + np.uint8(shift), out)
    return out


def pack_words(ids: np.ndarray) -> np.ndarray:
    """The 64-bit words of ``ids`` (uint64, all below 2^60); each word takes as many ids as it can."""
    n = len(ids)
    if not n:
        return np.empty(0, dtype="<u8")
    best = np.full(n, 15, dtype=np.uint8)
    # The most bits among the next ``count`` ids, for larger and larger counts; a selector holds if they fit.
    most, reach = _widths(ids), 1
    for s in range(14, -1, -1):
        count = int(COUNTS[s])
        if count > n:
            break
        while reach < count:
            step = min(reach, count - reach)
            most = np.maximum(most[: len(most) - step], most[step:])
            reach += step
        np.copyto(best[: n - count + 1], np.uint8(s), where=most <= BITS[s])
    takes = COUNTS.astype(np.uint8)[best].tobytes()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += takes[i]
    starts = np.array(starts)
    used = best[starts]
    words = used.astype(np.uint64) << np.uint64(60)
    for s in np.unique(used):
        if BITS[s]:
            at = np.flatnonzero(used == s)
            first, word = starts[at], words[at]
            for k in range(COUNTS[s]):
                word |= ids[first + k] << np.uint64(k * BITS[s])
            words[at] = word
    return words.astype("<u8")


def unpack_words(words: np.ndarray, n: int) -> np.ndarray:
    words = words.astype(np.uint64)
    used = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[used]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    for s in np.unique(used):
        if BITS[s]:
            at = np.flatnonzero(used == s)
            mask = np.uint64((1 << int(BITS[s])) - 1)
            for k in range(COUNTS[s]):
                out[starts[at] + k] = (words[at] >> np.uint64(k * BITS[s])) & mask
    if len(out) != n:
        raise ValueError(f"a block holds {len(out)} ids and should hold {n}")
    return out


def pack(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """One block: ids of whole documents, and where each of them ends in it.

    Head: magic, documents, ids, words, escapes. Then the ends (the offsets that let a
    reader take one document out), the places and values of escapes, and the words.
    """
    ids = np.asarray(ids, dtype=np.uint64)
    large = np.flatnonzero(ids >= ESCAPED_FROM)
    plain = ids.copy()
    plain[large] = 0
    words = pack_words(plain)
    head = HEAD.pack(MAGIC, len(ends), len(ids), len(words), len(large))
    return head + np.asarray(ends, "<u4").tobytes() + large.astype("<u4").tobytes() + ids[large].astype("<u8").tobytes() + words.tobytes()


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends) of a block."""
    magic, n_docs, n_ids, n_words, n_large = HEAD.unpack_from(block)
    if magic != MAGIC or len(block) != HEAD.size + 4 * n_docs + 12 * n_large + 8 * n_words:
        raise ValueError("not a block, or cut short")
    at = HEAD.size
    ends = np.frombuffer(block, "<u4", n_docs, at)
    places = np.frombuffer(block, "<u4", n_large, at + 4 * n_docs)
    values = np.frombuffer(block, "<u8", n_large, at + 4 * n_docs + 4 * n_large)
    ids = unpack_words(np.frombuffer(block, "<u8", n_words, at + 4 * n_docs + 12 * n_large), n_ids)
    ids[places] = values
    return ids, ends


#: Ids after which a block ends with the document then open.
BLOCK_IDS = 1 << 16

BLOCKS = (
    T.StructType()
    .add("file", T.IntegerType())
    .add("start_in_file", T.LongType())
    .add("doc_ids", T.ArrayType(T.LongType()))
    .add("n_ids", T.LongType())
    .add("block", T.BinaryType())
)


def write_blocks(docs: DataFrame, tokenizer: str, *, end_id: int = 0, files: int | None = None) -> DataFrame:
    """Token ids of all texts as a table of Simple-8b blocks, written to the shared folder.

    Documents are dealt by ranges of doc_id and sorted, so file after file, block
    after block, ids stand in ascending doc_id order (null doc_ids first; equal ones
    by a hash of the text, which ranges divide too, so many rows of one doc_id fill many files).
    Columns other than doc_id and text don't count. A block is a row: file,
    start_in_file (ids before it), doc_ids, n_ids and the block's bytes.
    """
    n = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    dealt = rows.repartitionByRange(n, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")

    def blocks(batches):
        code, file = encoder(tokenizer, end_id), TaskContext.get().partitionId()
        names, parts, held, start = [], [], 0, 0

        def block():
            ends = np.cumsum([len(p) // 4 for p in parts])
            packed = pack(np.frombuffer(b"".join(parts), "<u4"), ends)
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([start], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([held], pa.int64()), pa.array([packed], pa.binary())],
                names=BLOCKS.names,
            )

        for batch in slices(batches, "text", SLICE):
            for name, ids in zip(batch["doc_id"].to_pylist(), code.many(batch["text"].to_pylist()), strict=True):
                names.append(name)
                parts.append(ids)
                held += len(ids) // 4
                if held >= BLOCK_IDS:
                    yield block()
                    start += held
                    names, parts, held = [], [], 0
        if parts:
            yield block()
        released()

    return written(dealt.mapInArrow(blocks, BLOCKS), "tokens")


def read_blocks(blocks: DataFrame, per_document, column: str) -> DataFrame:
    """Decode blocks; a row for each document with what ``per_document(ids)`` (a long) gives.

    Returns doc_id, start (ids of all documents before it, over all files), n_tokens
    and ``column``.
    """
    # A row for each file comes to the driver, a number that the writer was given.
    sizes = {r["file"]: r["n"] for r in blocks.groupBy("file").agg(F.sum("n_ids").alias("n")).collect()}
    before, total = {}, 0
    for file in sorted(sizes):
        before[file], total = total, total + sizes[file]
    out = T.StructType()
    for name in ("doc_id", "start", "n_tokens", column):
        out = out.add(name, T.LongType())

    def rows(batches):
        remembered("no units", dict)  # what the writer remembers is of no use here
        released()
        for batch in slices(batches, "block", 8 * SLICE):
            for file, start, doc_ids, block in zip(*(batch[c].to_pylist() for c in ("file", "start_in_file", "doc_ids", "block")), strict=True):
                ids, ends = unpack(block)
                los = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                values = [per_document(ids[lo:hi]) for lo, hi in zip(los.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(before[file] + start + los), pa.array(ends.astype(np.int64) - los), pa.array(values, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)
        released()

    return blocks.select("file", "start_in_file", "doc_ids", "block").mapInArrow(rows, out)


def crc_of_ids(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def op5_simple8b_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents' ids written as Simple-8b blocks in doc_id order and read back."""
    blocks = write_blocks(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
    return read_blocks(blocks, crc_of_ids, "ids_crc32")


QUERIES = {"op5_simple8b_token_files": op5_simple8b_token_files}
ORACLES: dict[str, str] = {}
