"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power of an exponent, normalised. The exponent is
bisected in [0, 1] until the weights' entropy meets ``entropy`` (nats), or until no source is repeated more
than ``repetitions`` times; each job evaluates the next six levels of the bisection at once, and only their
sums over sources reach the driver. The budget is ``budget`` tokens or, without one, the least at which every
source's part covers all its documents.

Weights are realised per source as passes: each pass is a permutation of the source's documents by hash.
Whole passes take every document; the last one takes documents until the source's budget is used up.
Running sums are made within (source, pass, bucket of the hash) and shifted by the buckets before, so that
a source which holds a third of all rows isn't summed by one task. A document's block is where its running
sum falls in the budget: blocks of ``block_tokens`` hold each source in about its weight, and within a
block documents stand in hash order.

Tokens are words, i.e. runs without white space. A null source is a source of its own. Rows without tokens
come along in each pass; a source without any tokens passes once. Repeated rows are documents of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.common import OWN, cut, numbered

LEVELS, ROUNDS = 6, 5


@dataclass(frozen=True)
class Mix:
    repetitions: float | None = 4.0
    entropy: float | None = None
    budget: float | None = None
    block_tokens: int = 1 << 20
    buckets: int = 1024
    seed: int = 1


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _exponent(sources: DataFrame, mix: Mix) -> float:
    """sources: share (above 0), tokens. The largest exponent that is mixed enough: entropy at least the target, or repetitions met."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        n = 1 << LEVELS
        at = [low + (high - low) * k / n for k in range(1, n)]
        power, per = F.pow("share", "x"), F.pow("share", F.col("x") - 1)
        each = sources.select("share", "tokens", F.posexplode(F.array(*map(F.lit, at))).alias("k", "x")).groupBy("k")
        sums = {r["k"]: r for r in each.agg(F.sum("tokens").alias("tokens"), F.sum(power).alias("s"), F.sum(power * F.log("share")).alias("l"), F.max(per).alias("h"), F.min(per).alias("m")).collect()}
        left, right = 0, n
        while right - left > 1:  # bisection over the points of this job
            mid = (left + right) // 2
            k = mid - 1
            r = sums[k]
            s, l, most, least = (r[c] for c in "slhm")
            if mix.entropy is not None:
                right_side = -at[k] * l / s + _ln(s) >= mix.entropy  # the entropy falls as the exponent grows
            else:
                budget = mix.budget / r["tokens"] if mix.budget else s / least
                right_side = most * budget / s > mix.repetitions  # repetitions fall as the exponent grows
            left, right = (mid, right) if right_side else (left, mid)
        low, high = low + (high - low) * left / n, low + (high - low) * right / n
    # repetitions are met from ``high`` on, the entropy up to ``low``
    return low if mix.entropy is not None else high


def _ln(x: float) -> float:
    import math

    return math.log(x)


def _key(docs: DataFrame) -> Column:
    return F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit(""))


def _place(mix: Mix, passes: Column, row: str = "_row") -> Column:
    return F.xxhash64(row, passes, F.lit(mix.seed))


def _bucket(place: Column, mix: Mix) -> Column:
    """Buckets follow the order of the hash."""
    return F.floor((place.cast("double") / float(1 << 64) + 0.5) * mix.buckets).cast("int")


def weighted(sizes: DataFrame, mix: Mix) -> DataFrame:
    """_source, tokens, weight, passes (whole ones) and rest (tokens of the last one), a row per source. sizes: _row, _source, n_tokens."""
    sources = cut(sizes.groupBy("_source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    total = sources.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    with_any = sources.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(total or 1)))
    exponent = _exponent(with_any, mix) if total else 1.0
    raised = F.pow("share", F.lit(exponent))
    r = with_any.agg(F.sum(raised).alias("s"), F.min(F.pow("share", F.lit(exponent - 1))).alias("least")).first()
    budget = mix.budget or (total * r["s"] / r["least"] if total else 0.0)
    weight = raised / F.lit(r["s"] or 1.0)
    part = with_any.select("_source", "tokens", weight.alias("weight"), (weight * F.lit(float(budget))).alias("part"))
    # a part within a millionth of whole passes is whole passes
    passes = F.floor(F.col("part") / F.col("tokens") + 1e-6)
    part = part.withColumn("passes", passes.cast("int")).withColumn("rest", F.greatest(F.lit(0.0), F.col("part") - F.col("passes") * F.col("tokens")))
    part = part.withColumn("rest", F.when(F.col("rest") < 1e-6 * F.col("tokens"), 0.0).otherwise(F.col("rest")))
    none = sources.where("tokens = 0").select("_source", "tokens", F.lit(0.0).alias("weight"), F.lit(0.0).alias("part"), F.lit(1).alias("passes"), F.lit(0.0).alias("rest"))
    return cut(part.unionByName(none), "weighted")


def _running(rows: DataFrame, mix: Mix) -> DataFrame:
    """Adds _before: tokens of the same source and pass that stand before a row. rows: _source, pass, place, n_tokens, _row."""
    rows = rows.withColumn("_bucket", _bucket(F.col("place"), mix))
    group = ["_source", "pass"]
    sums = rows.groupBy(*group, "_bucket").agg(F.sum("n_tokens").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))  # over buckets
    sums = sums.select(*group, "_bucket", F.coalesce(earlier, F.lit(0)).alias("_shift"))
    own = F.sum("n_tokens").over(Window.partitionBy(*group, "_bucket").orderBy("place", "_row").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_own", F.coalesce(own, F.lit(0))).join(sums, [*group, "_bucket"]).withColumn("_before", F.col("_own") + F.col("_shift")).drop("_own", "_shift", "_bucket")


def sizes_of(docs: DataFrame) -> DataFrame:
    """_row, doc_id, source, _source, n_tokens of ``docs`` (_row, doc_id, source, text)."""
    return cut(docs.select("_row", "doc_id", "source", _key(docs).alias("_source"), n_words(docs["text"]).alias("n_tokens")), "sizes")


def mixed(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """doc_id, source, n_tokens, pass, weight, block, place: a row for every time a document is taken. docs: doc_id, source, text."""
    mix = mix or Mix()
    sizes = sizes_of(numbered(docs.select("doc_id", "source", "text")))
    plan = weighted(sizes, mix)
    every = sizes.join(plan, "_source").select("_row", "doc_id", "source", "_source", "n_tokens", "weight", "tokens", "part", "passes", "rest", F.explode(F.sequence(F.lit(0), F.col("passes") - F.when(F.col("rest") > 0, 0).otherwise(1))).alias("pass"))
    every = every.where("passes > 0 or rest > 0").withColumn("place", _place(mix, F.col("pass")))
    placed = _running(every, mix).where("pass < passes or _before < rest")
    block = F.floor((F.col("pass") * F.col("tokens") + F.col("_before")) / F.greatest(F.lit(1.0), F.col("weight") * mix.block_tokens)).cast("long")
    return placed.select("doc_id", "source", "n_tokens", "pass", "weight", block.alias("block"), "place")


def repeated(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """``docs`` with each row as often as the mixture takes it. The texts aren't shuffled: a row is in its source's last pass if its hash is up to the last one taken. ``docs`` is a table as it is read."""
    mix = mix or Mix()
    row, source, whole, last_place, n_times, nth = (f"{OWN}{x}" for x in ("row", "source", "passes", "last", "n", "nth"))
    rows = numbered(docs, row)
    sizes = sizes_of(rows.select(F.col(row).alias("_row"), "doc_id", "source", "text"))
    plan = weighted(sizes, mix)
    partial = sizes.join(plan.where("rest > 0"), "_source").select("_row", "_source", "n_tokens", "rest", F.col("passes").alias("pass"))
    last = _running(partial.withColumn("place", _place(mix, F.col("pass"))), mix).where("_before < rest").groupBy("_source").agg(F.max("place").alias("_last"))
    plan = cut(plan.join(last, "_source", "left").select(F.col("_source").alias(source), F.col("passes").alias(whole), F.col("_last").alias(last_place)), "passes")
    taken = rows.withColumn(source, _key(rows)).join(plan, source)
    times = F.col(whole) + F.when(_place(mix, F.col(whole), row) <= F.col(last_place), 1).otherwise(0)
    return taken.withColumn(n_times, times).where(F.col(n_times) > 0).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(n_times)))).select(*docs.columns)
