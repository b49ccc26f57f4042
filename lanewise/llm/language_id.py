"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, for each of ``SLOTS`` positions, one bit per language; the masks at an
n-gram's ``HASHES`` positions, and-ed, name all languages whose filter contains it. A text's n-grams are
looked up at once, bits are counted per language and corrected for each filter's false positives; the
language with the largest corrected share of n-grams wins (ties: the first by name).

Training: n-grams are counted per language over at most about ``per_language`` labelled documents of each
language (a documented bound for fitting; drawn by a hash of the id). An n-gram enters the filter of each
language in which it is at least ``ratio`` times as frequent as in the one that uses it most. The filter
is merged in Spark and has SLOTS masks however much text there is.

Letters are what Unicode calls so, lower-cased; all else is a word boundary. Null text, or one without
letters: ``und`` with score 0. Without any labelled document every text is ``und``. Repeated rows: one
result each. Long texts are taken whole; an empty table gives an empty one. Null labels take no part in training. Labels, ids and sources are no inputs of a prediction.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import OWN, text_or_empty

SIZES = (3, 4)
SLOTS, HASHES = 1 << 20, 3
PER_LANGUAGE = 4000
RATIO, LEAST = 0.5, 2
#: Code points that are taken together.
BLOCK = 1 << 18


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Code point -> that of its lower-case letter, or a blank."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _blocks(texts: list[str]):
    """(first text, one code point array, where each text begins): texts with a blank before, between and after."""
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) < BLOCK):
            size, end = size + len(texts[end]) + 1, end + 1
        joined = " " + " ".join(texts[at:end]) + " "
        points = _folded()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[at:end]])[:-1]
        yield at, points, starts
        at = end


def _grams(points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams whose inner code points are letters, and where they begin."""
    letter = points != 32
    inner = letter[1 : len(points) - n + 2].copy()
    for k in range(2, n - 1):
        inner &= letter[k : len(points) - n + 1 + k]
    at = np.flatnonzero(inner)
    wide = points.astype(np.uint64)
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + wide[at + k]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29)), at


def _positions(h: np.ndarray):
    return [((h >> np.uint64(20 * k)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


class Filters:
    """languages (sorted), masks per position, and each language's share of set positions."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks
        self.false = np.array([self.bit(masks, k).mean() ** HASHES for k in range(len(languages))])

    @staticmethod
    def bit(masks: np.ndarray, k: int) -> np.ndarray:
        word = masks[k // 64]
        return word >> word.dtype.type(k % 64) & word.dtype.type(1)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected shares, a row per text and a column per language; and how many n-grams each text has."""
        hits, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for first, points, starts in _blocks(texts):
            own = slice(first, first + len(starts))
            for n in SIZES:
                h, at = _grams(points, n)
                edges = np.append(np.searchsorted(at, starts), len(at))
                sizes[own] += np.diff(edges)
                found = None
                for p in _positions(h):
                    found = self.masks[:, p] if found is None else found & self.masks[:, p]
                for k in range(len(self.languages)):
                    total = np.concatenate([[0], np.cumsum(self.bit(found, k), dtype=np.int64)])
                    hits[own, k] += np.diff(total[edges])
        share = hits / np.maximum(sizes, 1)[:, None]
        return np.clip((share - self.false) / (1 - self.false), 0, 1), sizes


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, ratio: float = RATIO, least: int = LEAST) -> Filters:
    """labelled: doc_id, text, lang."""
    rows = labelled.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    masks = np.zeros((max(1, -(-len(languages) // 64)), SLOTS), kind)
    if not languages:
        return Filters([], masks)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("text", "lang")

    def count(batches):
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                for _, points, _ in _blocks([t for t, own in zip(texts, langs, strict=True) if own == lang]):
                    h, n = np.unique(np.concatenate([_grams(points, size)[0] for size in SIZES]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), languages.index(lang), np.int32)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = drawn.mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    per = counts.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("of"))  # at most one entry per language
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    total = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, float(n))]) if totals else None
    if total is None:
        return Filters(languages, masks)
    rates = F.transform("of", lambda x: F.struct(x["lang"].alias("lang"), x["n"].alias("n"), (x["n"] / total[x["lang"]]).alias("rate")))
    most = F.array_max(F.transform("of", lambda x: x["rate"]))
    kept = per.select("gram", rates.alias("of")).select("gram", F.filter("of", lambda x: (x["n"] >= least) & (x["rate"] >= ratio * most)).alias("of"))
    bits = kept.select("gram", F.explode("of").alias("of")).select("gram", F.floor(F.col("of.lang") / 64).alias("word"), F.expr("shiftleft(1L, of.lang % 64)").alias("mask"))
    at = F.explode(F.array(*[F.shiftrightunsigned("gram", 20 * k).bitwiseAND(F.lit(SLOTS - 1)) for k in range(HASHES)]))
    merged = bits.select("word", "mask", at.alias("at")).groupBy("word", "at").agg(F.bit_or("mask").alias("mask")).toArrow()  # SLOTS rows per 64 languages at most
    word, at, mask = (merged.column(c).to_numpy() for c in ("word", "at", "mask"))
    masks[word, at] = mask.view(np.uint64).astype(kind)
    return Filters(languages, masks)


def predicted(df: DataFrame, filters: Broadcast, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Appends two columns of the given names: the language and its score."""
    schema = T.StructType([*df.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    at = df.columns.index(text)

    def work(batches):
        known: Filters = filters.value
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            found, scores = ["und"] * len(texts), np.zeros(len(texts))
            if known.languages and texts:
                shares, sizes = known.scores(texts)
                best = shares.argmax(axis=1)
                found = [known.languages[k] if n else "und" for k, n in zip(best, sizes, strict=True)]
                scores = np.where(sizes > 0, shares.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores)], names=schema.names)

    return df.mapInArrow(work, schema)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang); learns from those not held out."""
    apart = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    filters = docs.sparkSession.sparkContext.broadcast(fit(docs.where(~apart).select("doc_id", "text", "lang")))
    texts = docs.select("doc_id", apart.alias("held_out"), text_or_empty(docs).alias("text"))
    return predicted(texts, filters).drop("text")


def in_known_languages(docs: DataFrame, least: float = 0.25) -> DataFrame:
    """``docs`` without texts in no language (``und``) or with a score under ``least`` in the best one; learns from all labelled rows."""
    filters = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text", "lang")))
    lang, score = f"{OWN}lang", f"{OWN}score"
    told = predicted(docs, filters, names=(lang, score))
    return told.where((F.col(lang) != "und") & (F.col(score) >= least)).select(*docs.columns)
