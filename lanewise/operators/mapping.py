"""Mapping reads in batch: every read's cycles folded by the kernel, seeds located, records assembled.

The fold runs where the reads are: no shuffle. A state is of one read, mate and run cycle; the mates of a read
that have been sequenced by a run cycle meet once, in one exchange by read, where records are chosen, flagged
and told of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.config import Settings, parse_mode
from lanewise.functions import codecs, scoring
from lanewise.functions.scoring import CIGAR
from lanewise.operators.index import Index
from lanewise.operators.kernel import Reads, Rules

SEEDS = f"array<struct<low:long,high:long,most:int,cigar:{CIGAR},bases:string>>"
PLACES = "array<struct<gid:int,at:long>>"
KEY = ("lane", "tile", "read_no", "mate")
#: A read at a cycle of the run.
READ = ("lane", "tile", "read_no", "run_cycle")
SEED_KIND = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64()), ("most", pa.int32()), ("cigar", pa.list_(pa.struct([("len", pa.int32()), ("op", pa.int32())]))), ("bases", pa.string())]))
PLACE_KIND = pa.list_(pa.list_(pa.struct([("gid", pa.int32()), ("at", pa.int64())])))
#: Reads that are folded together.
TOGETHER = 1 << 14


def seed_columns(reads: Reads, index: Index) -> tuple[pa.Array, pa.Array]:
    """Seeds and places of every read, as columns."""
    seeds = reads.seeds_of()
    rows = [[{"low": s.low, "high": s.high, "most": s.most, "cigar": [{"len": n, "op": op} for n, op in s.cigar], "bases": s.bases} for s in own] for own in seeds]
    places = [[[{"gid": g, "at": p} for g, p in index.places(s.low, s.high)] for s in own] for own in seeds]
    return pa.array(rows, SEED_KIND), pa.array(places, PLACE_KIND)


def read_states(reads: DataFrame, index: Broadcast, settings: Settings, cycles: list[int] | None = None) -> DataFrame:
    """lane, tile, read_no, mate, calls, length, cycle, run_cycle, seeds, places: a row per read, mate and cycle. reads: key, calls binary (whole read).

    ``cycles`` are cycles of every mate; without them there is one state of the whole read, whose run cycle is
    the longest mate's length.
    """
    longest = max((s.length for s in settings.segments if s.mate), default=0)

    def fold(batch: pa.RecordBatch, n: int, rules: Rules):
        grid = np.frombuffer(b"".join(batch.column("calls").to_pylist()), np.uint8).reshape(-1, n)
        state = Reads(len(grid))
        for c in sorted(set(cycles or [n])):
            for done in range(state.cycle, min(c, n)):
                state.take(grid[:, done], rules)
            seeds, places = seed_columns(state, index.value)
            same = lambda x: pa.array(np.full(len(grid), x, np.int32))  # noqa: E731, B023
            columns = [same(n), same(min(c, n)), same(c if cycles else longest or n), seeds, places]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*KEY, "calls")), *columns], [*KEY, "calls", "length", "cycle", "run_cycle", "seeds", "places"])

    def work(batches):
        rules: dict[int, Rules] = {}
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column("calls").to_pylist()], np.int64)
            for n in np.unique(sizes).tolist():
                own = batch.filter(pa.array(sizes == n))
                if n not in rules:
                    rules[n] = Rules(index.value, settings, n)
                for at in range(0, own.num_rows, TOGETHER):
                    yield from fold(own.slice(at, TOGETHER), n, rules[n])

    return reads.select(*KEY, "calls").mapInArrow(work, f"lane int, tile int, read_no long, mate int, calls binary, length int, cycle int, run_cycle int, seeds {SEEDS}, places array<{PLACES}>")


def alignments(states: DataFrame, index: Broadcast, settings: Settings) -> DataFrame:
    """A row per seed with its score, quality and rank: key, cycle, cigar, score, clip, nm, md, mapq, seed (rank), seeds, places."""
    names = states.columns
    rest = [c for c in names if c not in ("seeds", "places")]
    each = states.select(*rest, F.explode(F.arrays_zip("seeds", "places")).alias("x"))
    s = each.select(*rest, F.col("x.seeds.cigar").alias("cigar"), F.col("x.seeds.bases").alias("bases"), F.col("x.places").alias("places"), (F.col("x.seeds.high") - F.col("x.seeds.low")).alias("n"))
    s = s.withColumn("score", scoring.alignment_score(F.col("cigar"), settings)).withColumn("clip", scoring.softclip_length(F.col("cigar")))
    per = Window.partitionBy(*READ, "mate")
    text = scoring.cigar_string(F.col("cigar"), True)
    s = s.withColumn("text", text)
    s = s.withColumn("seed", F.row_number().over(per.orderBy(F.desc("score"), F.col("clip") > 0, "clip", F.size("cigar"), "text", "bases")).cast("int"))
    s = s.withColumn("best", F.max("score").over(per)).withColumn("seeds", F.count("*").over(per)).withColumn("found", F.sum("n").over(per))
    least = settings.scores.least_penalty
    s = s.withColumn("denominator", F.sum(F.pow(F.lit(0.01), (F.col("best") - F.col("score")) / F.lit(float(least))) * F.col("n")).over(per))
    # thresholds depend on a read's length, which the row has
    quality = None
    for mate_length in {x.length for x in settings.segments if x.mate}:
        q = scoring.mapq(F.col("score"), F.col("best"), F.col("denominator"), F.col("found") == 1, F.col("cycle"), mate_length, settings)
        quality = F.when(F.col("length") == mate_length, q) if quality is None else quality.when(F.col("length") == mate_length, q)
    return s.withColumn("mapq", quality).withColumn("nm", scoring.edit_distance(F.col("cigar"))).withColumn("md", scoring.md_string(F.col("cigar"), F.col("bases")))


WINDOW = 10


def _choice(mode: str, best_n: int):
    """Of a read's places in order of mate and rank: which are reported (from 1) and as which of their mate's.

    One near a place that was taken for the same strand (its window of ten or the next) is passed over. The choice
    depends on what was chosen before, so it goes through the places once, in Python, with a set of windows.
    """

    @F.arrow_udf("array<struct<at:int,nth:int>>")
    def chosen(mates: pa.Array, gids: pa.Array, starts: pa.Array, scores: pa.Array) -> pa.Array:
        out = []
        for places in zip(*(x.to_pylist() for x in (mates, gids, starts, scores)), strict=True):
            seen, taken, mate, printed, first = set(), [], None, 0, 0
            for at, (m, gid, start, score) in enumerate(zip(*places, strict=True), 1):
                if m != mate:
                    mate, printed = m, 0
                if (mode == "ANYBEST" and printed) or (mode == "BESTN" and printed >= best_n) or (mode == "ALLBEST" and printed and score != first):
                    continue
                window = start - start % WINDOW
                if (gid, window) in seen or (gid, window + WINDOW) in seen:
                    continue
                first = first if printed else score
                printed += 1
                seen.add((gid, window))
                taken.append({"at": at, "nth": printed})
            out.append(taken)
        return pa.array(out, pa.list_(pa.struct([("at", pa.int32()), ("nth", pa.int32())])))

    return chosen


def records(aligned: DataFrame, reference: DataFrame, settings: Settings) -> DataFrame:
    """The reported places of each read's mates: key, run_cycle, cycle, gid, start, nth (1: primary) and the seed's columns."""
    mode, best_n = parse_mode(settings.out_mode)
    fine = aligned.where((F.col("score") >= settings.min_as) & (F.col("clip") <= settings.max_softclip_ratio * F.col("cycle")))
    if mode == "UNIQUE":
        fine = fine.where("seeds = 1 and found = 1")
    places = F.slice("places", 1, 1) if mode == "ANYBEST" else F.col("places")
    keep = [c for c in fine.columns if c not in ("places", "bases", "denominator", "best", "found", "n")]
    each = fine.select(*keep, F.explode(places).alias("p")).select(*keep, F.col("p.gid").alias("gid"), F.col("p.at").alias("at"))
    lengths = reference.select((F.col("rid")).alias("rid"), F.col("length").alias("contig"), F.col("name").alias("rname"))
    each = each.withColumn("rid", F.floor(F.col("gid") / 2).cast("int")).join(lengths, "rid")
    each = each.withColumn("start", scoring.sam_start(F.col("gid"), F.col("at"), F.col("contig"), F.col("cigar"))).where("start is not null")
    item = F.struct("mate", "seed", "gid", "at", "start", "score", F.struct(*[c for c in each.columns if c not in (*READ, "mate", "seed", "gid", "at", "start", "score")]).alias("rest"))
    grouped = each.groupBy(*READ).agg(F.array_sort(F.collect_list(item)).alias("items"))  # of one read; at most MOST_PLACES places per seed
    of = lambda c: F.transform("items", lambda x: x[c])
    picked = grouped.withColumn("picked", _choice(mode, best_n)(of("mate"), of("gid"), of("start"), of("score")))
    out = picked.select(*READ, F.explode(F.transform("picked", lambda p: F.struct(F.element_at("items", p["at"]).alias("item"), p["nth"].alias("nth")))).alias("c"))
    return out.select(*READ, "c.item.mate", "c.item.gid", "c.item.start", "c.item.score", "c.item.seed", "c.nth", "c.item.rest.*")


def mate_flag(mate: Column, mates: Column) -> Column:
    """Flag bits of a mate among those that have been sequenced: none for a single one."""
    first, last = mate == F.get(mates, F.lit(0)), mate == F.element_at(mates, -1)
    both = F.when(first, codecs.PAIRED | codecs.FIRST).when(last, codecs.PAIRED | codecs.LAST).otherwise(codecs.PAIRED | codecs.FIRST | codecs.LAST)
    return F.when(F.size(mates) > 1, both).otherwise(F.lit(0))


def sam(states: DataFrame, reference: DataFrame, index: Broadcast, settings: Settings, barcodes: DataFrame | None = None) -> DataFrame:
    """Alignment records, a row each, with flags of mates; cycle is that of the run. barcodes: lane, tile, read_no, barcode (formatted) and sample.

    A read's mates are those that ``states`` has of it at the cycle: before the second mate's first cycle, reads are single.
    """
    per = Window.partitionBy(*READ)
    states = states.withColumn("mates", F.sort_array(F.collect_set("mate").over(per)))
    found = records(alignments(states, index, settings), reference, settings)
    read = F.substring("calls", F.lit(1), F.col("cycle"))
    reverse = F.col("gid") % 2 == 1
    place = mate_flag(F.col("mate"), F.col("mates"))
    seq, qual = codecs.read_bases(read), codecs.read_qualities(read)
    one = found.withColumn("flag", place.bitwiseOR(F.when(F.col("nth") > 1, codecs.SECONDARY).otherwise(0)).bitwiseOR(F.when(reverse, codecs.REVERSE).otherwise(0)))
    one = one.withColumn("seq", F.when(F.col("nth") > 1, "*").when(reverse, codecs.reverse_complement(seq)).otherwise(seq)).withColumn("qual", F.when(F.col("nth") > 1, "*").when(reverse, F.reverse(qual)).otherwise(qual))
    text = scoring.cigar_string(F.col("cigar"), settings.extended_cigar)
    turned = F.array_join(F.reverse(F.regexp_extract_all(text, F.lit("([0-9]+[A-Z])"), F.lit(1))), "")
    one = one.withColumn("cigar_text", F.when(reverse, turned).otherwise(text)).withColumn("md", F.when(reverse, codecs.reverse_md(F.col("md"))).otherwise(F.col("md"))).drop("calls", "cigar")
    if settings.report_unmapped:
        mapped = one.select(*READ, "mate").distinct()
        quiet = states
        if parse_mode(settings.out_mode)[0] == "UNIQUE":  # mapped to several places isn't unmapped
            quiet = states.where("size(seeds) = 0 or (size(seeds) = 1 and size(places[0]) = 1)")
        lost = quiet.join(mapped, [*READ, "mate"], "left_anti").select(*READ, "mate", "mates", place.bitwiseOR(F.lit(codecs.UNMAPPED)).alias("flag"), seq.alias("seq"), qual.alias("qual"), F.lit(1).alias("nth"))
        one = one.unionByName(lost, allowMissingColumns=True)
    # what the next mate's first record says; a read has a few mates
    head = F.when(F.col("nth") == 1, F.struct("mate", F.struct("flag", "rname", "start").alias("head")))
    heads = F.map_from_entries(F.collect_list(head).over(per))
    after = F.element_at("mates", (F.array_position("mates", F.col("mate")) % F.size("mates") + 1).cast("int"))
    one = one.withColumn("_next", F.when(F.size("mates") > 1, F.try_element_at(heads, after)))
    lost = F.col("_next").isNull() | codecs.has_flag(F.col("_next.flag"), codecs.UNMAPPED)
    more = F.when(F.size("mates") < 2, 0).otherwise(F.when(lost, codecs.MATE_UNMAPPED).otherwise(0).bitwiseOR(F.when(codecs.has_flag(F.coalesce("_next.flag", F.lit(0)), codecs.REVERSE), codecs.MATE_REVERSE).otherwise(0)))
    one = one.withColumn("rnext", F.when(lost & F.col("_next").isNotNull(), F.col("rname")).otherwise(F.col("_next.rname"))).withColumn("pnext", F.when(lost & F.col("_next").isNotNull(), F.col("start")).otherwise(F.col("_next.start")))
    alone = codecs.has_flag(F.col("flag"), codecs.UNMAPPED) & ~lost
    one = one.withColumn("rname", F.when(alone, F.col("_next.rname")).otherwise(F.col("rname"))).withColumn("start", F.when(alone, F.col("_next.start")).otherwise(F.col("start"))).withColumn("flag", F.col("flag").bitwiseOR(more)).drop("_next")
    if barcodes is not None:
        one = one.join(barcodes, ["lane", "tile", "read_no"])
    else:
        one = one.withColumn("barcode", F.lit("")).withColumn("sample", F.lit("all"))
    tags = F.when(F.col("score").isNotNull(), codecs.tag_map(F.col("score"), F.col("barcode"), F.col("nm"), F.col("md")))
    return one.select(
        "lane", "tile", "read_no", "mate", F.col("run_cycle").alias("cycle"), "sample", F.col("nth").alias("rank"),
        codecs.read_name(F.col("lane"), F.col("tile"), F.col("read_no")).alias("qname"), "flag", F.coalesce("rname", F.lit("*")).alias("rname"),
        (F.coalesce("start", F.lit(-1)) + 1).cast("long").alias("pos"), F.coalesce("mapq", F.lit(0)).alias("mapq"), F.coalesce("cigar_text", F.lit("*")).alias("cigar"),
        F.coalesce("rnext", F.lit("*")).alias("rnext"), (F.coalesce("pnext", F.lit(-1)) + 1).cast("long").alias("pnext"), F.lit(0).cast("long").alias("tlen"), "seq", "qual", tags.alias("tags"),
    )
