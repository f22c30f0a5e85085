"""Best-fit packing of token sequences under several capacities at once.

A bin has three capacities: tokens, documents, and attention cost (tiles of causal
attention inside its pieces). Pieces go in order of falling length into the open bin that fits best
under all three: the one with the smallest weighted residual norm, or the largest
weighted dot product of residual and demand.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import released, slices, table, text_of, written
from siftwell.llm.tokens import SLICE, encoder

PIECES = (
    T.StructType()
    .add("doc_id", T.LongType())
    .add("piece", T.IntegerType())
    .add("start", T.LongType())
    .add("length", T.LongType())
    .add("ids_crc32", T.LongType())
    .add("ids", T.BinaryType())
)


def cut_pieces(docs: DataFrame, tokenizer: str, max_tokens: int, *, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """Token ids of whole texts, each with the end id, in pieces of at most ``max_tokens``.

    Only documents that are longer are cut; their last piece may be shorter. A null or
    empty text is the end id alone. Columns besides doc_id and text don't count.
    ``ids``: little-endian unsigned 32-bit, left out if ``keep_ids`` is false.
    """
    schema = PIECES if keep_ids else T.StructType(PIECES.fields[:-1])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))

    def cut(batches):
        code = encoder(tokenizer, end_id)
        for batch in slices(batches, "text", SLICE):
            out = [[] for _ in PIECES.names]
            for name, ids in zip(batch["doc_id"].to_pylist(), code.many(batch["text"].to_pylist()), strict=True):
                for k, lo in enumerate(range(0, len(ids), 4 * max_tokens)):
                    part = ids[lo : lo + 4 * max_tokens]
                    for column, value in zip(out, (name, k, lo // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)][: len(schema)], names=schema.names)
        released()

    return rows.mapInArrow(cut, schema)


def tiles(lengths: np.ndarray, tile: int) -> np.ndarray:
    """Tiles of ``tile`` by ``tile`` positions that causal attention inside a piece computes, begun ones too."""
    sides = -(-lengths // tile)
    return sides * (sides + 1) // 2


def vector_best_fit(needs: np.ndarray, capacity: tuple[int, int, int], weights=(1.0, 0.05, 0.25), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each piece; ``needs``: (pieces, 3) tokens, documents and attention cost.

    Pieces go in order of falling tokens (ties: as they come), each into the bin of the best score of those with room
    under all capacities (ties: fewest tokens left, then the state met first). Bins of equal residuals are one
    state with a list of bins, so a step looks at each distinct state only.
    """
    scale, w = 1 / np.array(capacity, np.float64), np.asarray(weights, dtype=np.float64)
    if len(needs) and (needs > np.array(capacity)).any():
        raise ValueError(f"a piece that needs {needs[(needs > np.array(capacity)).any(1)][0].tolist()} fits no bin")
    n = len(needs)
    bins, offsets = np.empty(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    # Residual states; the arrays grow by doubling and freed places are used again.
    room = np.zeros((64, 3))
    members: list[list[int]] = [[] for _ in range(64)]
    place: dict[tuple[int, ...], int] = {}
    free = list(range(63, -1, -1))
    used = 0
    for i in np.argsort(-needs[:, 0], kind="stable").tolist():
        need = needs[i]
        at = np.flatnonzero((room >= need).all(axis=1))
        if len(at):
            left = room[at]
            score = -((((left - need) * scale) ** 2) @ w) if rule == "norm" else ((left * scale) * (need * scale)) @ w
            spot = int(at[np.lexsort((left[:, 0], -score))[0]]) if len(at) > 1 else int(at[0])
            state = tuple(int(x) for x in room[spot])
            own = members[spot].pop()
            if not members[spot]:
                room[spot] = 0
                del place[state]
                free.append(spot)
        else:
            state, own = tuple(capacity), used
            used += 1
        bins[i], offsets[i] = own, capacity[0] - state[0]
        state = tuple(x - y for x, y in zip(state, need.tolist(), strict=True))
        if min(state) > 0:
            if state not in place:
                if not free:
                    free = list(range(2 * len(room) - 1, len(room) - 1, -1))
                    members += [[] for _ in range(len(room))]
                    room = np.concatenate([room, np.zeros_like(room)])
                place[state] = free.pop()
                room[place[state]] = state
            members[place[state]].append(own)
    return bins, offsets


#: Documents in a sequence, and tiles along a full piece. A sequence may cost as many tiles as one full piece.
MAX_DOCUMENTS, SIDES = 24, 16


def packed(
    pieces: DataFrame,
    max_tokens: int,
    *,
    max_documents: int = MAX_DOCUMENTS,
    tile: int | None = None,
    max_attention: int | None = None,
    weights=(1.0, 0.05, 0.25),
    rule: str = "norm",
    pieces_per_group: int = 10_000,
    seed: int = 5,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (place of the piece in its sequence) to ``pieces``.

    A sequence holds at most ``max_tokens`` tokens, ``max_documents`` pieces and
    ``max_attention`` attention tiles (by default those of one piece of ``max_tokens``, below which such a
    piece fits nowhere; many short pieces beside a long one reach it, as a begun tile counts whole).
    A tile's side is a sixteenth of ``max_tokens`` unless stated.

    Pieces are dealt at random to groups of about ``pieces_per_group``, each packed by
    itself: a group wastes less than one sequence, and neither a group nor a task grows
    with the input. Needs doc_id, piece and length; other columns are kept, those named
    sequence_id and offset replaced. Repeated rows are pieces of their own; an empty
    table packs into nothing. A piece over a capacity stops the job.
    """
    side = tile or max(1, max_tokens // SIDES)
    capacity = (max_tokens, max_documents, max_attention or int(tiles(np.array(max_tokens), side)))
    rest = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    src = pieces.select(*[F.col(f"`{c}`") for c in rest])
    groups = max(1, -(-src.count() // pieces_per_group))
    schema = T.StructType([*src.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    dealt = src.withColumn("__sw_group", F.pmod(F.xxhash64(F.lit(seed), *[f"`{c}`" for c in rest if c != "ids"], F.monotonically_increasing_id()), F.lit(groups)))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        own = t.drop_columns(["__sw_group"])
        length = own["length"].to_numpy()
        bins, offsets = vector_best_fit(np.stack([length, np.ones_like(length), tiles(length, side)], axis=1), capacity, weights, rule)
        return own.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("__sw_group").applyInArrow(pack, schema)


def op8_vector_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens, ``MAX_DOCUMENTS`` pieces and the attention tiles of a full piece."""
    pieces = cut_pieces(table(spark, sf_dir, "documents"), "word_bpe_49k.json", 2048, keep_ids=False)
    return packed(written(pieces, "pieces"), 2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op8_vector_best_fit_packing": op8_vector_best_fit_packing}
ORACLES: dict[str, str] = {}
