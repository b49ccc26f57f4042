"""Mapping to references whose index is too large to broadcast: one shard after another, joined by read.

Contigs are cut into pieces of at most ``SHARD_BASES`` letters, each with as many more as an alignment may span, and
dealt into shards of about that size. A shard's index is broadcast, all reads meet it, and its seeds are written
before the next one is sent, so that one index is in memory at a time. A place belongs to the piece in which its
alignment begins (clip included); what other pieces see of it, cut off at their ends, is left out. Seeds of a read
with one CIGAR, the same bases and score are one, with the places of all shards.

Greedy pruning sees the places of its shard only, so a read can have seeds here, worse than its best, that one
index would have pruned for all places at once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.config import Settings
from lanewise.functions import scoring
from lanewise.operators import index, mapping
from lanewise.session import shared_dir

#: Letters of a shard: 40 bytes of index each, for both strands.
SHARD_BASES = index.BROADCAST_LIMIT // 48


def pieces(reference: DataFrame, most: int, overlap: int) -> tuple[DataFrame, int]:
    """shard, piece (from 0 in its shard), rid, contig (length), begin, least and past (where places that belong to it begin), seq; and the number of shards."""
    rows, shard, room, piece = [], 0, most, 0
    for r in reference.select("rid", "length").orderBy("rid").toLocalIterator():  # numbers of contigs only
        for begin in range(0, r["length"], most):
            own = min(most, r["length"] - begin)
            if own > room and room < most:
                shard, room, piece = shard + 1, most, 0
            last = begin + own == r["length"]
            rows.append((shard, piece, r["rid"], begin, begin if begin else -(1 << 62), 1 << 62 if last else begin + own, own + (0 if last else overlap)))
            room, piece = room - own, piece + 1
    table = reference.sparkSession.createDataFrame(rows, "shard int, piece int, rid int, begin long, least long, past long, size long")
    at = F.substr("seq", (F.col("begin") + 1).cast("int"), F.col("size").cast("int"))
    return table.join(reference.select("rid", F.col("length").alias("contig"), "seq"), "rid").select("shard", "piece", "rid", "contig", "begin", "least", "past", at.alias("seq")), (rows[-1][0] + 1 if rows else 0)


def read_states(reads: DataFrame, reference: DataFrame, settings: Settings, cycles: list[int] | None = None, most: int = SHARD_BASES) -> DataFrame:
    """mapping.read_states without a shared index. reference: rid, name, seq, length."""
    spark, key = reads.sparkSession, [*mapping.READ, "mate"]
    longest = max((s.length for s in settings.segments if s.mate), default=0)
    table, shards = pieces(reference, most, 2 * longest)
    top = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    for k in range(shards):
        own = table.where(F.col("shard") == k)
        shared = index.broadcast(spark, index.build(own.select(F.col("piece").alias("rid"), F.col("piece").cast("string").alias("name"), "seq")))
        states = mapping.read_states(reads, shared, settings, cycles)
        each = states.select(*key, F.explode(F.arrays_zip("seeds", "places")).alias("x")).select(*key, "x.seeds.most", "x.seeds.cigar", "x.seeds.bases", F.explode("x.places").alias("p"))
        each = each.withColumn("piece", F.floor(F.col("p.gid") / 2).cast("int")).join(F.broadcast(own.select("piece", "rid", "contig", "begin", "least", "past", F.length("seq").alias("size"))), "piece")  # of one shard
        forward = F.col("p.gid") % 2 == 0
        # the indexed text of a forward strand runs from its end
        at = F.col("p.at") + F.when(forward, F.col("contig") - F.col("begin") - F.col("size")).otherwise(F.col("begin"))
        each = each.withColumn("at", at).withColumn("left", F.when(forward, F.col("contig") - F.col("at") - scoring.consumed(F.col("cigar"))).otherwise(F.col("at")))
        mine = each.where((F.col("left") >= F.col("least")) & (F.col("left") < F.col("past")))
        mine.select(*key, "most", "cigar", "bases", F.struct((2 * F.col("rid") + F.col("p.gid") % 2).cast("int").alias("gid"), "at").alias("place")).write.mode("append").parquet(top)
        shared.destroy()
    rows = reads.select(*mapping.KEY, "calls").withColumn("length", F.octet_length("calls"))
    turns = F.array(*map(F.lit, sorted(set(cycles)))) if cycles else F.array(F.lit(longest) if longest else F.col("length"))
    rows = rows.withColumn("run_cycle", F.explode(turns)).withColumn("cycle", F.least("run_cycle", "length") if cycles else F.col("length"))
    if not shards:
        found = rows.limit(0).select(*key, F.lit(None).cast(f"array<struct<seed:struct<low:long,high:long,most:int,cigar:{scoring.CIGAR},bases:string>,places:{mapping.PLACES}>>").alias("x"))
    else:
        seeds = spark.read.parquet(top).groupBy(*key, "most", "cigar", "bases").agg(F.array_sort(F.collect_set("place")).alias("places"))  # of one read
        seed = F.struct(F.lit(0).cast("long").alias("low"), F.size("places").cast("long").alias("high"), "most", "cigar", "bases")
        found = seeds.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(seed.alias("seed"), "places"))).alias("x"))  # of one read
    of = lambda c, kind: F.coalesce(F.transform("x", lambda x: x[c]), F.array().cast(kind))
    return rows.join(found, key, "left").select(*mapping.KEY, "calls", "length", "cycle", "run_cycle", of("seed", mapping.SEEDS).alias("seeds"), of("places", f"array<{mapping.PLACES}>").alias("places"))
