"""Thresholds, alignment scores, mapping qualities and record strings as column functions.

A CIGAR here is array<struct<len int, op int>> with the operations MATCH, MISMATCH (a clip at either end),
INSERTION and DELETION. Scores are whole numbers and are cut to 16 bits toward zero at every step.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.config import Settings

MATCH, MISMATCH, INSERTION, DELETION = range(4)
CIGAR = "array<struct<len:int,op:int>>"


def min_cycle_score(cycle: Column, length: int, s: Settings) -> Column:
    """The least score with which an alignment is kept at a cycle."""
    steps = F.ceil((cycle - s.anchor_length) / F.lit(float(s.error_interval)))
    later = F.greatest(F.lit(length * s.scores.match) - steps * s.scores.least_penalty, F.lit(s.min_as))
    return F.when(cycle < s.anchor_length, F.lit(s.min_as)).otherwise(later).cast("int")


def threshold(cycle: int, length: int, s: Settings) -> int:
    """``min_cycle_score`` of one cycle, for the kernel."""
    if cycle < s.anchor_length:
        return s.min_as
    steps = -(-(cycle - s.anchor_length) // s.error_interval)
    return max(length * s.scores.match - steps * s.scores.least_penalty, s.min_as)


def softclip_floor(clip: Column, s: Settings) -> Column:
    return (F.ceil(clip / F.lit(float(s.anchor_length))) * s.scores.least_penalty).cast("int")


def softclip_length(cigar: Column) -> Column:
    first = F.get(cigar, F.lit(0))
    return F.when(first["op"] == MISMATCH, first["len"]).otherwise(F.lit(0))


def alignment_score(cigar: Column, s: Settings) -> Column:
    """Mismatches at either end cost what a clip does."""
    c, n = s.scores, F.size(cigar)
    open_, extend = F.lit(float(c.softclip_open)).cast("float"), F.lit(float(c.softclip_extend)).cast("float")

    def step(total: Column, x: Column) -> Column:
        at, k, op = x["at"], x["len"], x["op"]
        clip = (op == MISMATCH) & ((at == 0) | (at == n - 1))
        value = (
            F.when(k == 0, total.cast("float"))
            .when(clip, total.cast("float") - (open_ + k.cast("float") * extend))
            .when(op == MISMATCH, (total - k * c.mismatch).cast("float"))
            .when(op == INSERTION, (total - c.insertion_open - k * c.insertion_extend).cast("float"))
            .when(op == DELETION, (total - c.deletion_open - k * c.deletion_extend).cast("float"))
            .otherwise((total + k * c.match).cast("float"))
        )
        return value.cast("smallint").cast("int")

    placed = F.transform(cigar, lambda x, i: F.struct(i.alias("at"), x["len"].alias("len"), x["op"].alias("op")))
    return F.aggregate(placed, F.lit(0), step)


def edit_distance(cigar: Column) -> Column:
    """NM: what isn't a match, without the first element whatever it is."""
    return F.aggregate(F.slice(cigar, 2, F.greatest(F.size(cigar) - 1, F.lit(0))), F.lit(0), lambda n, x: n + F.when(x["op"] != MATCH, x["len"]).otherwise(0))


def cigar_string(cigar: Column, extended: bool = False) -> Column:
    """S for a clip in front, then M, I and D; with ``extended`` also X. Neighbours of one letter go together."""
    letter = lambda x, i: F.when((x["op"] == MISMATCH) & (i == 0), "S").when(x["op"] == INSERTION, "I").when(x["op"] == DELETION, "D").when((x["op"] == MISMATCH) & F.lit(extended), "X").otherwise("M")
    named = F.filter(F.transform(cigar, lambda x, i: F.struct(x["len"].alias("len"), letter(x, i).alias("op"))), lambda x: x["len"] > 0)
    empty = F.struct(F.lit("").alias("done"), F.lit(0).alias("n"), F.lit("").alias("op"))

    def step(a: Column, x: Column) -> Column:
        same = a["op"] == x["op"]
        done = F.when(same | (a["n"] == 0), a["done"]).otherwise(F.concat(a["done"], a["n"].cast("string"), a["op"]))
        return F.struct(done.alias("done"), F.when(same, a["n"] + x["len"]).otherwise(x["len"]).alias("n"), x["op"].alias("op"))

    return F.aggregate(named, empty, step, lambda a: F.when(a["n"] == 0, a["done"]).otherwise(F.concat(a["done"], a["n"].cast("string"), a["op"])))


def md_string(cigar: Column, bases: Column) -> Column:
    """Match runs as numbers, and the reference's bases of mismatches and deletions one after another (``bases``); no clip, no marks."""
    empty = F.struct(F.lit("").alias("done"), F.lit(0).alias("run"), F.lit(1).alias("at"))

    def step(a: Column, x: Column) -> Column:
        clip, other = (x["at"] == 0) & (x["op"] == MISMATCH), x["op"].isin(MISMATCH, DELETION)
        letters = F.substr(bases, a["at"], x["len"])
        run = F.when(a["run"] > 0, a["run"].cast("string")).otherwise(F.lit(""))
        took = F.struct(F.concat(a["done"], run, letters).alias("done"), F.lit(0).alias("run"), (a["at"] + x["len"]).alias("at"))
        grew = F.struct(a["done"].alias("done"), (a["run"] + F.when(x["op"] == MATCH, x["len"]).otherwise(0)).alias("run"), a["at"].alias("at"))
        return F.when(other & ~clip, took).otherwise(grew)

    placed = F.transform(cigar, lambda x, i: F.struct(i.alias("at"), x["len"].alias("len"), x["op"].alias("op")))
    return F.aggregate(placed, empty, step, lambda a: F.concat(a["done"], F.when(a["run"] > 0, a["run"].cast("string")).otherwise(F.lit(""))))


def consumed(cigar: Column) -> Column:
    """Bases of the reference (clip included) that an alignment spans."""
    return F.aggregate(cigar, F.lit(0), lambda n, x: n + F.when(x["op"] != INSERTION, x["len"]).otherwise(0))


def sam_start(gid: Column, position: Column, contig: Column, cigar: Column) -> Column:
    """0-based place of the first aligned base; ``position`` is a suffix's start in the indexed text of a strand."""
    forward = contig - position - consumed(cigar) + softclip_length(cigar)
    place = F.when(gid % 2 == 0, forward).otherwise(position)
    return F.when(place >= 0, place)


def errors_of(score: Column, cycle: Column, s: Settings) -> Column:
    """How many least penalties a score lies below the best possible."""
    return (cycle * s.scores.match - score) / F.lit(float(s.scores.least_penalty))


def probability_to_mapq(p: Column) -> Column:
    """Steps for ambiguous placements, else -10 log10 of the error; 42 at most."""
    # fixed values
    steps = F.when(p <= 0.1, 0).when(p <= 0.29, 1).when(p <= 0.435, 2).when(p <= 0.55, 3)
    return F.coalesce(steps, F.floor(-10 * F.log10(1 - F.least(p, F.lit(0.99993))) + 0.5)).cast("int")


def mapq(score: Column, best: Column, denominator: Column, unique: Column, cycle: Column, length: int, s: Settings) -> Column:
    """Of one alignment; denominator: sum over the read's alignments of occurrences * 0.01 ** (errors over the best's)."""
    mine, least = errors_of(score, cycle, s), errors_of(best, cycle, s)
    share = F.pow(F.lit(0.01), mine - least)
    most = 100.0 * errors_of(min_cycle_score(cycle, length, s), cycle, s) / length
    now = 100.0 * mine / cycle
    right = F.when(score == cycle * s.scores.match, F.lit(1.0)).otherwise(0.49995 + 0.5 * (1 - F.pow(F.lit(10.0), -5 - most + 2 * now)))
    return F.when(unique & (score == cycle * s.scores.match), F.lit(42)).otherwise(probability_to_mapq(right * share / denominator))
