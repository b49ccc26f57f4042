"""Token counts: pieces once per distinct pre-token, joined to per-document pre-token frequencies.

1. A bounded sample of documents names the frequent pre-tokens (``head``, at most ``head_size``).
   Their piece counts are made once and broadcast; the size of that broadcast is fixed by the parameter.
2. One pass over all documents sums the head by lookup and keeps every other pre-token with its
   frequency in the document.
3. The distinct other pre-tokens are given to the tokenizer once each, and their counts are joined to
   the frequencies and summed per document.

Which pre-tokens are in the head changes the cost only. No ids are kept: of each encoding only the length.

Null or empty text: 0 bytes, 0 tokens. Repeated rows: one result row each. Other columns are ignored. An empty
table gives an empty one. A text of exactly ``limit`` tokens isn't over it.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm import bpe
from lanewise.llm.common import cut, numbered, text_or_empty

HEAD_SIZE = 1 << 19
SAMPLE_DOCS = 24_000


@lru_cache(maxsize=2)
def _tokenizer(file: str):
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(public_tokenizers.path(file))


def _lengths(file: str, pretokens: list[str]) -> list[int]:
    return [len(e.ids) for e in _tokenizer(file).encode_batch_fast(pretokens, add_special_tokens=False)]


def _pretokens(batches):
    """Distinct pre-tokens of a partition's texts with their counts."""
    cache = bpe.ChunkCache(bpe.pattern().findall, tuple)
    for batch in batches:
        seen: Counter = Counter()
        for text in batch.column(0).to_pylist():
            for part in bpe.segments(text or ""):
                for found in cache.of(part):
                    seen.update(found)
        yield pa.RecordBatch.from_pydict({"pretoken": list(seen), "n": list(seen.values())})


def head_counts(texts: DataFrame, n_texts: int, file: str, head_size: int, sample_docs: int) -> dict[str, int]:
    """Piece counts of the most frequent pre-tokens of a sample; at most ``head_size`` entries reach the driver."""
    modulus = 1 << 20
    share = min(modulus, -(-modulus * sample_docs // max(1, n_texts)))
    sample = texts.where(F.pmod(F.xxhash64("_row"), F.lit(modulus)) < share).select("text")
    counts = sample.mapInArrow(_pretokens, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    # how many pre-tokens occur how often, then the least frequency that keeps the head within its bound; m pre-tokens in all have at most sqrt(2 m) frequencies
    counts = cut(counts, "head")
    by_n = counts.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect()
    least, total = 0, 0
    for row in by_n:
        if (total := total + row["k"]) > head_size:
            least = row["n"] + 1
            break
    names = counts.where(F.col("n") >= least).select("pretoken").toArrow().column(0).to_pylist()
    return dict(zip(names, _lengths(file, names), strict=True))


def count_tokens(docs: DataFrame, file: str = "byte_bpe_50k.json", limit: int = 1024, head_size: int = HEAD_SIZE, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text)."""
    texts = numbered(docs.select("doc_id", text_or_empty(docs).alias("text")))
    head = head_counts(texts, docs.count(), file, head_size, sample_docs)
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def frequencies(batches):
        known = shared.value

        def make(found):
            return sum(known.get(p, 0) for p in found), [p for p in found if p not in known]

        cache = bpe.ChunkCache(bpe.pattern().findall, make)
        for batch in batches:
            rows, ids, texts = batch.column("_row"), batch.column("doc_id"), batch.column("text").to_pylist()
            sizes, sums, tails = [], [], []
            for text in texts:
                n, rare = 0, Counter()
                parts = bpe.segments(text)
                for part in parts:
                    for pieces, other in cache.of(part):
                        n += pieces
                        if other:
                            rare.update(other)
                sizes.append(len(text.encode()))
                sums.append(n + len(parts) - 1)
                tails.append([{"pretoken": p, "n": k} for p, k in rare.items()])
            tail = pa.array(tails, pa.list_(pa.struct([("pretoken", pa.string()), ("n", pa.int32())])))
            yield pa.RecordBatch.from_arrays([rows, ids, pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), tail], ["_row", "doc_id", "n_bytes", "n_head", "tail"])

    def piece_counts(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_lengths(file, names), pa.int32())], ["pretoken", "pieces"])

    per_doc = cut(
        texts.mapInArrow(frequencies, f"_row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_head long, tail array<struct<pretoken:string,n:int>>"),
        "frequencies",
    )
    tail = per_doc.select("_row", F.inline("tail"))
    pieces = tail.select("pretoken").distinct().mapInArrow(piece_counts, "pretoken string, pieces int")
    rest = tail.join(pieces, "pretoken").groupBy("_row").agg(F.sum(F.col("n").cast("long") * F.col("pieces")).alias("n_tail"))
    n_tokens = F.col("n_head") + F.coalesce("n_tail", F.lit(0))
    return per_doc.select("_row", "doc_id", "n_bytes", "n_head").join(rest, "_row", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
