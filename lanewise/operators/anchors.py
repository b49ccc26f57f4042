"""Mapping without gaps in relational operators: anchors, placements, scores and report modes.

The reference's k-mers are one row each; reads meet them in an equi-join on the k-mer. Whether the
reference side is broadcast is left to its size (Spark's threshold and AQE).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import codecs
from lanewise.functions.scoring import MATCH, MISMATCH


def strands(reference: DataFrame) -> DataFrame:
    """gid (2 rid, odd for the reverse strand), rid, seq, length."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("seq").alias("t")), F.struct(F.lit(1).alias("s"), codecs.reverse_complement(F.col("seq")).alias("t"))))
    return reference.select("rid", "length", both.alias("x")).select((2 * F.col("rid") + F.col("x.s")).alias("gid"), "rid", F.col("x.t").alias("seq"), "length")


def kmers(strands: DataFrame, k: int = 13) -> DataFrame:
    """k, gid, pos of every k-mer."""
    at = strands.where(F.col("length") >= k).select("gid", "seq", F.explode(F.sequence(F.lit(0), (F.col("length") - k).cast("int"))).alias("pos"))
    return at.select(F.substr("seq", F.col("pos") + 1, F.lit(k)).alias("k"), "gid", F.col("pos").cast("long").alias("pos"))


def anchors(reads: DataFrame, k: int = 13, interval: int = 6, most: int = 50) -> DataFrame:
    """read_no, seq, clip, k: the k-mers with which a read may begin, after a clip."""
    return reads.select("read_no", "seq", F.explode(F.sequence(F.lit(0), F.lit(most // interval * interval), F.lit(interval))).alias("clip")).select("read_no", "seq", "clip", F.substr("seq", F.col("clip") + 1, F.lit(k)).alias("k"))


def placements(reads: DataFrame, strands: DataFrame, k: int = 13, length: int = 100) -> DataFrame:
    """read_no, gid, pos, clip, seq, target, length: each place of a read with its shortest clip; target is the strand's text there, length the strand's.

    Only numbers meet on the k-mers; the texts come after, a row per place.
    """
    kmer = anchors(reads, k).select("read_no", "clip", "k")
    hits = kmer.join(kmers(strands, k), "k").select("read_no", "clip", "gid", (F.col("pos") - F.col("clip")).alias("pos"))
    best = hits.where("pos >= 0").groupBy("read_no", "gid", "pos").agg(F.min("clip").alias("clip"))
    texts = strands.select("gid", F.col("seq").alias("text"), "length")
    inside = best.join(texts, "gid").where(F.col("pos") + length <= F.col("length"))
    placed = inside.select("read_no", "gid", "pos", "clip", "length", F.substr("text", (F.col("pos") + 1).cast("int"), F.lit(length)).alias("target"))
    return placed.join(reads.select("read_no", "seq"), "read_no").select("read_no", "gid", "pos", "clip", "seq", "target", "length")


def states(scored: DataFrame, reads: DataFrame, length: int = 100) -> DataFrame:
    """Placements as states in mapping.read_states' form, for records without an index. reads: lane, tile, read_no, mate, calls.

    Places of a read with one CIGAR and the same bases are one seed. Reads without a place have no seeds.
    """
    differ = F.zip_with(F.split("seq", ""), F.split("target", ""), lambda x, y: F.when(x != y, y).otherwise(F.lit("")))
    bases = F.array_join(F.slice(differ, F.col("clip") + 1, F.lit(length)), "")
    one = scored.select("read_no", ungapped_cigar(F.col("seq"), F.col("target"), F.col("clip")).alias("cigar"), bases.alias("bases"), F.struct("gid", (F.col("length") - F.col("pos") - length).cast("long").alias("at")).alias("place"))
    seeds = one.groupBy("read_no", "cigar", "bases").agg(F.array_sort(F.collect_list("place")).alias("places"))  # of one read
    seed = F.struct(F.lit(0).cast("long").alias("low"), F.size("places").cast("long").alias("high"), F.lit(0).alias("most"), "cigar", "bases")
    each = seeds.groupBy("read_no").agg(F.array_sort(F.collect_list(F.struct(seed.alias("seed"), "places"))).alias("x"))  # of one read
    of = lambda c, kind: F.coalesce(F.transform("x", lambda x: x[c]), F.array().cast(kind))
    seeds_of, places_of = of("seed", "array<struct<low:bigint,high:bigint,most:int,cigar:array<struct<len:int,op:int>>,bases:string>>"), of("places", "array<array<struct<gid:int,at:bigint>>>")
    n = F.lit(length)
    return reads.select("lane", "tile", "read_no", "mate", "calls").join(each, "read_no", "left").select("lane", "tile", "read_no", "mate", "calls", n.alias("length"), n.alias("cycle"), n.alias("run_cycle"), seeds_of.alias("seeds"), places_of.alias("places"))


def mismatches(a: Column, b: Column, skip: Column) -> Column:
    """In how many places after ``skip`` two strings of one length differ."""
    pair = F.zip_with(F.split(F.substr(a, skip + 1), ""), F.split(F.substr(b, skip + 1), ""), lambda x, y: (x != y).cast("int"))
    return F.aggregate(pair, F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))


def clip_score(clip: Column, k: int = 13, mismatch: int = 6) -> Column:
    return F.when(clip > 0, (-(F.lit(float(mismatch)) + clip * F.lit(mismatch / k))).cast("int")).otherwise(F.lit(0))


def scored(placed: DataFrame, min_score: int = -20) -> DataFrame:
    """Adds mismatches and score, and keeps what reaches the least score."""
    m = placed.withColumn("mismatches", mismatches(F.col("seq"), F.col("target"), F.col("clip")))
    return m.withColumn("score", clip_score(F.col("clip")) - 6 * F.col("mismatches")).where(F.col("score") >= min_score)


def ungapped_cigar(seq: Column, target: Column, clip: Column) -> Column:
    """Runs of matches and mismatches behind the clip."""
    same = F.zip_with(F.split(seq, ""), F.split(target, ""), lambda x, y: F.when(x == y, MATCH).otherwise(MISMATCH))
    named = F.filter(F.transform(same, lambda op, i: F.struct((i + 1).alias("at"), op.alias("op"))), lambda x: x["at"] > clip)
    runs = F.when(clip > 0, F.array(F.struct(clip.cast("int").alias("len"), F.lit(MISMATCH).alias("op"), F.lit(True).alias("shut")))).otherwise(F.array().cast("array<struct<len:int,op:int,shut:boolean>>"))

    def step(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        grown = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct((last["len"] + 1).alias("len"), last["op"].alias("op"), F.lit(False).alias("shut"))))
        new = F.concat(out, F.array(F.struct(F.lit(1).alias("len"), x["op"].alias("op"), F.lit(False).alias("shut"))))
        return F.when((F.size(out) > 0) & (last["op"] == x["op"]) & ~last["shut"], grown).otherwise(new)

    return F.transform(F.aggregate(named, runs, step), lambda x: F.struct(x["len"].alias("len"), x["op"].alias("op")))


def identity(reads_labels: DataFrame) -> DataFrame:
    """Without an index: two labels of a read that end together have the same interval if their least occurrence and count agree."""
    return reads_labels.groupBy("read_no", "clip").agg(F.min(F.struct("gid", "end")).alias("first"), F.count("*").alias("n"))


def ranked(alignments: DataFrame) -> DataFrame:
    """Adds rank (a total order), best score and the number of places per read."""
    per = Window.partitionBy("read_no")
    order = per.orderBy(F.desc("score"), F.col("clip") > 0, "clip", "gid", "pos")
    return alignments.withColumn("rank", F.row_number().over(order).cast("int")).withColumn("best", F.max("score").over(per)).withColumn("places", F.count("*").over(per))


def reported(ranks: DataFrame, mode: str, n: int = 0) -> DataFrame:
    """The rows of a mode: ALL, ALLBEST, ANYBEST, BESTN or UNIQUE."""
    keep = {"ALL": F.lit(True), "ALLBEST": F.col("score") == F.col("best"), "ANYBEST": F.col("rank") == 1, "BESTN": F.col("rank") <= n, "UNIQUE": F.col("places") == 1}
    return ranks.where(keep[mode])
