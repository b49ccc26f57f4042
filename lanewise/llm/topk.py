"""Exact top-k by inner product over a bit-sliced index.

Rows stay where they are read: a task forms blocks of at most ``BLOCK_ROWS`` rows and ``BLOCK_VALUES`` components.
A block keeps, for each attribute, its value less the block's least one, without the low bits, as ``SLICES``
bitmaps of one bit per row. For a query,
the slices are added up with bitmap arithmetic: each set bit of a query component contributes the slices of
its attribute (of the complement where the component is negative) at its weight, and carry-save adders turn
all bitmaps of a weight into one, with carries into the next. The k-th largest sum is found from the most
significant slice downward. Dropped low bits can raise a score by a known amount at most, so every row whose
sum is within that amount of the k-th is taken, and those boundary rows are resolved with their whole values.

Queries come to the blocks, in rounds of about ``ROUND_VALUES`` components (32 MB) that are broadcast one after
another; a round builds each block once, for all its queries. A task keeps the k best of all its blocks for each
query, and only these are shuffled, to be merged per query. A round's result is written before the next one's
queries are sent. Nothing is sampled: all rows are indexed and results are exact.

Null vectors and such that hold null or non-finite components take no part, nor do rows with a null vec_id,
which the query's SQL leaves out as well (it compares ids); a query meets rows of its own
length only, and empty vectors meet each other with a score of 0. Equal scores go to the smaller vec_id. Repeated rows are rows of their own; a query doesn't
meet its own row. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.common import cut, cut_all, numbered

BLOCK_ROWS, BLOCK_VALUES = 1 << 16, 1 << 22
#: Components (and two ids each) of the queries of a round, 8 bytes each.
ROUND_VALUES = 1 << 22
SLICES = 6


def whole_vectors(df: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """_row, vec_id, x: floor(scale * component) of the rows that take part."""
    fine = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return numbered(df.select("vec_id", vector)).where(fine).select("_row", "vec_id", F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("x"))


class Block:
    """Values of some rows and their slices."""

    def __init__(self, values: np.ndarray):
        self.values = values
        n, d = values.shape
        self.words = -(-n // 64)
        low = values.min(axis=0)
        spread = values - low
        self.shift = max(0, int(spread.max(initial=0)).bit_length() - SLICES)
        self.low = low
        coarse = (spread >> self.shift).astype(np.uint64)
        bits = np.zeros((d, SLICES, self.words * 64), np.uint8)
        for j in range(SLICES):
            bits[:, j, :n] = (coarse >> np.uint64(j) & np.uint64(1)).T
        self.slices = np.packbits(bits, axis=2, bitorder="little").view(np.uint64)
        self.inverse = ~self.slices
        self.all = np.packbits(np.arange(self.words * 64) < n, bitorder="little").view(np.uint64)

    def summed(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of the sum over attributes of |q| * (what is kept of the attribute, or its complement where q is negative)."""
        weights: dict[int, list[np.ndarray]] = {}
        for sign, slices in ((1, self.slices), (-1, self.inverse)):
            size = np.where(sign * query > 0, np.abs(query), 0)
            for b in range(int(size.max(initial=0)).bit_length()):
                chosen = slices[size >> b & 1 == 1]
                if len(chosen):
                    for j in range(SLICES):
                        weights.setdefault(b + j, []).append(chosen[:, j])
        out, p = [], 0
        while p <= max(weights, default=-1):
            at = weights.pop(p, [])
            maps = np.concatenate(at) if at else np.zeros((1, self.words), np.uint64)
            carries = []
            while len(maps) > 1:
                if len(maps) == 2:
                    carries.append(maps[:1] & maps[1:])
                    maps = maps[:1] ^ maps[1:]
                    break
                k = len(maps) // 3
                a, b, c = maps[:k], maps[k : 2 * k], maps[2 * k : 3 * k]
                half = a ^ b
                carries.append((a & b) | (half & c))
                maps = np.concatenate([half ^ c, maps[3 * k :]])
            if carries:
                weights.setdefault(p + 1, []).extend(carries)
            out.append(maps[0])
            p += 1
        return out

    def boundary(self, query: np.ndarray, k: int, without: int | None = None) -> np.ndarray:
        """Places of the rows that may be among the k best, all others being worse than k of them."""
        rows = self.all.copy()
        if without is not None:
            rows[without >> 6] &= ~np.uint64(1 << (without & 63))
        slices = self.summed(query)
        sure, open_, least = np.zeros_like(rows), rows, 0
        for i in range(len(slices) - 1, -1, -1):
            here = open_ & slices[i]
            n = int(np.bitwise_count(sure | here).sum())
            if n >= k:  # the k-th has this bit
                open_, least = here, least | 1 << i
            else:
                sure, open_ = sure | here, open_ & ~slices[i]
        # a score is its sum's share and between 0 and this more
        error = int(np.abs(query).sum()) * ((1 << self.shift) - 1)
        bound = max(0, least - (-(-error >> self.shift)))
        above, equal = np.zeros_like(rows), rows
        for i in range(len(slices) - 1, -1, -1):
            if bound >> i & 1:
                equal = equal & slices[i]
            else:
                above, equal = above | (equal & slices[i]), equal & ~slices[i]
        return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little"))

    def best(self, query: np.ndarray, ids: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the k best rows, ties to smaller ids."""
        at = self.boundary(query, k, without)
        scores = self.values[at] @ query
        order = np.lexsort((ids[at], -scores))[:k]
        return at[order], scores[order]


def _queries(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length of vector: row numbers, ids and values."""
    table = rows.select("d", "_row", "vec_id", "x").toArrow().combine_chunks()
    out = {}
    for d in pc.unique(table.column("d")).to_pylist():
        own = table.filter(pc.equal(table.column("d"), d))
        out[d] = (own.column("_row").to_numpy(), own.column("vec_id").to_numpy(), _values(own.column("x").combine_chunks(), d))
    return out


def _values(x: pa.ListArray, d: int) -> np.ndarray:
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return np.asarray(x.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(x), d)


class _Best:
    """The k best rows so far of each of some queries of one length."""

    def __init__(self, queries: tuple[np.ndarray, np.ndarray, np.ndarray], k: int):
        self.rows, self.ids, self.values = queries
        self.k, self.found = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(self.rows)

    def meet(self, own: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
        block = Block(values)
        place = {r: at for at, r in enumerate(own.tolist())}
        for i, row in enumerate(self.rows.tolist()):
            at, scores = block.best(self.values[i], ids, self.k, place.get(row))
            before = self.found[i]
            ids_, scores_ = np.concatenate([before[0], ids[at]]), np.concatenate([before[1], scores])
            order = np.lexsort((ids_, -scores_))[: self.k]
            self.found[i] = ids_[order], scores_[order]

    def table(self) -> pa.RecordBatch:
        n = [len(ids) for ids, _ in self.found]
        flat = [np.concatenate([f[j] for f in self.found]) if self.found else np.zeros(0, np.int64) for j in (0, 1)]
        columns = {"q_row": np.repeat(self.rows, n), "query_id": np.repeat(self.ids, n), "vec_id": flat[0], "score": flat[1]}
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns.values()], list(columns))


def _searched(rows: DataFrame, asked: Broadcast, k: int) -> DataFrame:
    """q_row, query_id, vec_id, score: for each query the k best of the rows that a task reads."""

    def search(batches):
        best = {d: _Best(q, k) for d, q in asked.value.items()}
        held: dict[int, list[tuple]] = {}

        def meet(d: int) -> None:
            best[d].meet(*(np.concatenate(c) for c in zip(*held.pop(d), strict=True)))

        for batch in batches:
            sizes = batch.column("d").to_numpy()
            for d in best.keys() & set(np.unique(sizes).tolist()):
                own = batch.filter(pa.array(sizes == d))
                step = max(1, BLOCK_VALUES // max(1, d))
                for at in range(0, own.num_rows, step):
                    part = own.slice(at, step)
                    held.setdefault(d, []).append((part.column("_row").to_numpy(), part.column("vec_id").to_numpy(), _values(part.column("x"), d)))
                    n = sum(len(h[0]) for h in held[d])
                    if n >= BLOCK_ROWS or n * d >= BLOCK_VALUES:
                        meet(d)
        for d in list(held):
            meet(d)
        yield from (b.table() for b in best.values())

    return rows.select("d", "_row", "vec_id", "x").mapInArrow(search, "q_row long, query_id long, vec_id long, score long")


def top_k(df: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner products for each row that ``is_query`` (of vec_id) holds for."""
    rows = cut(whole_vectors(df, vector, scale).where("vec_id is not null").withColumn("d", F.size("x")), "vectors")
    asked = rows.where(is_query)
    rounds = -(-int(asked.agg(F.sum(F.col("d") + 2)).first()[0] or 0) // ROUND_VALUES)
    if not rounds:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def found():
        for i in range(rounds):
            sent = df.sparkSession.sparkContext.broadcast(_queries(asked.where(F.pmod(F.xxhash64("_row"), F.lit(rounds)) == i)))
            yield _searched(rows, sent, k)
            sent.destroy()

    rank = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id"))
    return cut_all(found(), "best").withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
