"""Best-fit packing of token sequences under several capacities at once.

The items that a packing sees differ only in their length (a document counts once, its attention cost is
length squared), so best fit in decreasing order is run over the histogram of lengths: bins in the same
state are held as one entry with a multiplicity. The plan is made on the driver from at most
``max_tokens`` numbers; rows then look up their place by (length, rank within length).

A bin is chosen, among those that hold the item under every capacity, by the least weighted norm of what
would remain (``norm``) or the greatest weighted dot-product of demand and residual (``dot``).
Ranks are counted within (length, salt) and shifted by the counts of the salts before, so that one
length which a third of the rows share isn't sorted by one task.

Null text: empty, one piece that holds only the end id. Repeated rows are packed once each.
An empty table gives an empty result. Other columns are ignored. Of bins that are equally good the one in use
longest is taken; pieces of one length are dealt to their places by row and piece.
"""

from __future__ import annotations

import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm import bpe
from lanewise.llm.common import cut, numbered, text_or_empty

#: Parts of a length's ranks at least, and rows of which a part is made at most where one length has all rows.
SALTS, PART_ROWS = 64, 1 << 26
#: Entries of a plan that are broadcast; a longer one is joined by shuffle.
BROADCAST_SLOTS = 1 << 20


def token_pieces(docs: DataFrame, ranks_file: str = "byte_bpe_50k.tiktoken", max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """_row, doc_id, piece, start, length, ids_crc32: the token ids of every text and ``end_id``, cut from the end into pieces of ``max_tokens``."""

    def tokenize(batches):
        import public_tokenizers

        encode = bpe.piece_ids(public_tokenizers.path(ranks_file))
        known: dict[str, bytes] = {}

        def ids_of(found: list[str]) -> bytes:
            out = []
            for pretoken in found:
                ids = known.get(pretoken)
                if ids is None:
                    if len(known) >= bpe.CACHE // 2:
                        known.clear()
                    ids = known[pretoken] = array("I", encode(pretoken.encode())).tobytes()
                out.append(ids)
            return b"".join(out)

        cache = bpe.ChunkCache(bpe.pattern().findall, ids_of)
        special, end = array("I", [bpe.SPECIAL_ID]).tobytes(), array("I", [end_id]).tobytes()
        for batch in batches:
            at, pieces, starts, lengths, sums = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = special.join(b"".join(cache.of(part)) for part in bpe.segments(text)) + end
                n = len(ids) // 4
                start, stop, piece = 0, (n - 1) % max_tokens + 1, 0
                while start < n:
                    at.append(i)
                    pieces.append(piece)
                    starts.append(start)
                    lengths.append(stop - start)
                    sums.append(zlib.crc32(ids[4 * start : 4 * stop]))
                    start, stop, piece = stop, stop + max_tokens, piece + 1
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row").take(at), batch.column("doc_id").take(at), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))],
                ["_row", "doc_id", "piece", "start", "length", "ids_crc32"],
            )

    texts = numbered(docs.select("doc_id", text_or_empty(docs).alias("text")))
    return texts.mapInArrow(tokenize, f"_row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


@dataclass(frozen=True)
class Capacities:
    """What a bin holds at most; an item that is over a capacity by itself has a bin of its own."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    select: str = "norm"


def plan(histogram: dict[int, int], caps: Capacities) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first bin, items per bin, offset) for all ranks of all lengths."""
    size = np.array([caps.tokens, caps.documents, caps.attention], float)
    weight = np.array(caps.weights)
    residual = np.zeros((64, 3))
    bins = np.zeros((64, 3), np.int64)  # first bin, how many, tokens in each
    used, next_bin, out = 0, 0, []

    def put(state, row) -> None:
        nonlocal residual, bins, used
        if used == len(bins):
            residual, bins = np.concatenate([residual, np.zeros_like(residual)]), np.concatenate([bins, np.zeros_like(bins)])
        residual[used], bins[used] = state, row
        used += 1

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        demand = np.array([length, 1, length * length], float)
        while left:
            fits = (residual[:used] >= demand).all(axis=1) & (bins[:used, 1] > 0)
            if fits.any():
                if caps.select == "norm":
                    score = (weight * ((residual[:used] - demand) / size) ** 2).sum(axis=1)
                else:
                    score = -(weight * (demand / size) * (residual[:used] / size)).sum(axis=1)
                g = int(np.argmin(np.where(fits, score, np.inf)))
                first, n, filled = (int(x) for x in bins[g])
                state = residual[g].copy()
                each = 1 if caps.select == "dot" else int(min(state // demand))
            else:
                state = size.copy()
                each = max(1, int(min(state // demand)))  # no other bin holds the item, so a new one takes what it can
                first, n, filled, g = next_bin, -(-left // each), 0, None
                next_bin += n
            each = min(each, left)
            take = min(n, left // each)  # bins that get ``each`` of this length; fewer remain for a next turn
            out.append((length, rank, rank + take * each, first, each, filled))
            put(state - each * demand, (first, take, filled + each * length))
            if g is None:
                if n > take:
                    put(state, (first + take, n - take, 0))
            else:
                bins[g, 0], bins[g, 1] = first + take, n - take
            left, rank = left - take * each, rank + take * each
        if used > 512:  # entries that are full or used up go
            keep = (bins[:used, 1] > 0) & (residual[:used] >= 1).all(axis=1)
            k = int(keep.sum())
            residual[:k], bins[:k], used = residual[:used][keep], bins[:used][keep], k
    return out


def ranked(pieces: DataFrame, salts: int = SALTS) -> DataFrame:
    """Adds ``_rank``, from 0 without gaps within each length."""
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("_row", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row", "piece")) - 1
    # at most lengths x salts rows: bounded by the parameters
    return salted.withColumn("_own", own).join(F.broadcast(shift), ["length", "_salt"]).withColumn("_rank", F.col("_own") + F.col("_before")).drop("_salt", "_own", "_before")


def place(pieces: DataFrame, caps: Capacities | None = None) -> DataFrame:
    """Adds sequence_id and offset to rows with _row, piece and length; lengths are whole and at least 1."""
    caps = caps or Capacities()
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most caps.tokens rows
    entries = plan(histogram, caps) or [(0, 0, 0, 0, 1, 0)]
    slots = pieces.sparkSession.createDataFrame(entries, "_length long, _from long, _to long, _bin long, _each long, _offset long")
    p, s = ranked(pieces, max(SALTS, sum(histogram.values()) // PART_ROWS)), F.broadcast(slots) if len(entries) <= BROADCAST_SLOTS else slots
    nth = F.col("_rank") - F.col("_from")
    placed = p.join(s, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return placed.select(
        *pieces.columns,
        (F.col("_bin") + F.floor(nth / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + nth % F.col("_each") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, ranks_file: str = "byte_bpe_50k.tiktoken", caps: Capacities | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of ``docs``."""
    caps = caps or Capacities()
    pieces = cut(token_pieces(docs, ranks_file, caps.tokens), "pieces")
    return place(pieces, caps).drop("_row")
