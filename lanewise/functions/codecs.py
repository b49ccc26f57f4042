"""Base calls, barcodes, strands and record fields as column functions.

A base call is a byte: the low two bits are the base (A, C, G, T), the others the quality; below 4 it is N.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BASES = "ACGT"
#: SAM flag bits.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, LAST, SECONDARY, FAILED, DUPLICATE, SUPPLEMENTARY = (1 << i for i in range(12))


def base_of(b: Column) -> Column:
    return F.when(b < 4, F.lit("N")).otherwise(F.substring(F.lit(BASES), b.bitwiseAND(F.lit(3)) + 1, F.lit(1)))


def quality_of(b: Column) -> Column:
    """Phred+33 character."""
    return F.char(F.shiftright(b, 2) + 33)


#: What every call stands for, in order of the byte.
_CALLS = "".join(map(chr, range(256)))
_BASES = "".join("N" if b < 4 else BASES[b & 3] for b in range(256))
_QUALITIES = "".join(chr(33 + (b >> 2)) for b in range(256))


def bases_of(calls: Column) -> Column:
    """A read's sequence from its array of base calls."""
    return F.array_join(F.transform(calls, base_of), "")


def qualities_of(calls: Column) -> Column:
    return F.array_join(F.transform(calls, quality_of), "")


def read_bases(calls: Column) -> Column:
    """A read's sequence from its base calls as bytes."""
    return F.translate(F.decode(calls, "ISO-8859-1"), _CALLS, _BASES)


def read_qualities(calls: Column) -> Column:
    return F.translate(F.decode(calls, "ISO-8859-1"), _CALLS, _QUALITIES)


def code_of(base: Column) -> Column:
    """0 to 3; what is no A, C or G counts as T."""
    at = F.instr(F.lit("ACG"), F.upper(base))
    return F.when((F.length(base) == 1) & (at > 0), at - 1).otherwise(F.lit(3)).cast("int")


def call_of(base: Column, quality: Column) -> Column:
    """The byte of a base and a quality; a base that is no letter of the alphabet has no quality: 0."""
    return F.when(F.upper(base).isin(*BASES), quality * 4 + code_of(base)).otherwise(F.lit(0)).cast("int")


def complement(seq: Column) -> Column:
    """Letter by letter; what is no A, C, G or T becomes N."""
    return F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "N"), "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def reverse_md(md: Column) -> Column:
    """An MD string for the other strand: its runs from the end, letters complemented."""
    runs = F.reverse(F.regexp_extract_all(md, F.lit("([0-9]+|[A-Z])"), F.lit(1)))
    return F.array_join(F.transform(runs, lambda r: F.translate(r, "ACGT", "TGCA")), "")


def with_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseOR(F.lit(bit))


def without_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(~bit))


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def formatted_barcode(barcode: Column, lengths: list[int]) -> Column:
    """A dash between the fragments; a barcode that isn't complete yet keeps what there is of its last one."""
    parts, at = [], 1
    for n in lengths:
        parts.append(F.substring(barcode, at, n))
        at += n
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "-")


def read_name(lane: Column, tile: Column, read_no: Column) -> Column:
    return F.concat(F.lit("lane."), lane.cast("string"), F.lit("|tile."), tile.cast("string"), F.lit("|read."), read_no.cast("string"))


def mate_cycle(cycle: Column, start: Column, length: Column) -> Column:
    """How many cycles of a segment are done at a cycle of the run; start is the segment's first cycle."""
    return F.least(length, F.greatest(F.lit(0), cycle - start + 1))


def is_seeding_cycle(cycle: Column, anchor: int, interval: int, most: int) -> Column:
    past = cycle - anchor
    return (past >= 0) & (past <= most) & (past % interval == 0)


def tile_numbers(surfaces: Column, swaths: Column, tiles: Column) -> Column:
    """All tile numbers of a layout: surface * 1000 + swath * 100 + tile."""
    upto = lambda n: F.sequence(F.lit(1), n)
    return F.flatten(F.transform(upto(surfaces), lambda s: F.flatten(F.transform(upto(swaths), lambda w: F.transform(upto(tiles), lambda t: s * 1000 + w * 100 + t)))))


def tag_map(score: Column, barcode: Column, nm: Column, md: Column) -> Column:
    """The tags in the order AS, BC (if there is one), NM, MD."""
    text = lambda x: x.cast("string")
    full = F.create_map(F.lit("AS"), text(score), F.lit("BC"), barcode, F.lit("NM"), text(nm), F.lit("MD"), md)
    return F.when(F.coalesce(barcode, F.lit("")) != "", full).otherwise(F.create_map(F.lit("AS"), text(score), F.lit("NM"), text(nm), F.lit("MD"), md))


_CODE = "CASE upper(base) WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 ELSE 3 END"

#: name -> (arguments, type, what it stands for), of the functions above.
SQL_FUNCTIONS = {
    "lw_base": ("b INT", "STRING", "CASE WHEN b < 4 THEN 'N' ELSE substring('ACGT', (b & 3) + 1, 1) END"),
    "lw_quality": ("b INT", "STRING", "char(33 + shiftright(b, 2))"),
    "lw_code": ("base STRING", "INT", _CODE),
    "lw_call": ("base STRING, quality INT", "INT", f"CASE WHEN upper(base) IN ('A', 'C', 'G', 'T') THEN quality * 4 + {_CODE} ELSE 0 END"),
    "lw_complement": ("seq STRING", "STRING", "translate(regexp_replace(upper(seq), '[^ACGT]', 'N'), 'ACGT', 'TGCA')"),
    "lw_reverse_complement": ("seq STRING", "STRING", "reverse(translate(regexp_replace(upper(seq), '[^ACGT]', 'N'), 'ACGT', 'TGCA'))"),
    "lw_reverse_md": ("md STRING", "STRING", "array_join(transform(reverse(regexp_extract_all(md, '([0-9]+|[A-Z])', 1)), r -> translate(r, 'ACGT', 'TGCA')), '')"),
    "lw_barcode": ("barcode STRING, lengths ARRAY<INT>", "STRING", "array_join(filter(transform(lengths, (n, i) -> substring(barcode, 1 + aggregate(slice(lengths, 1, i), 0, (a, x) -> a + x), n)), p -> p <> ''), '-')"),
    "lw_read_name": ("lane INT, tile INT, read_no BIGINT", "STRING", "concat('lane.', lane, '|tile.', tile, '|read.', read_no)"),
    "lw_mate_cycle": ("cycle INT, start INT, length INT", "INT", "least(length, greatest(0, cycle - start + 1))"),
    "lw_is_seeding_cycle": ("cycle INT, anchor INT, interval INT, most INT", "BOOLEAN", "cycle >= anchor AND cycle - anchor <= most AND (cycle - anchor) % interval = 0"),
    "lw_tile_numbers": ("surfaces INT, swaths INT, tiles INT", "ARRAY<INT>", "flatten(transform(sequence(1, surfaces), s -> flatten(transform(sequence(1, swaths), w -> transform(sequence(1, tiles), t -> s * 1000 + w * 100 + t)))))"),
    "lw_with_flag": ("flags INT, bit INT", "INT", "flags | bit"),
    "lw_without_flag": ("flags INT, bit INT", "INT", "flags & ~bit"),
    "lw_has_flag": ("flags INT, bit INT", "BOOLEAN", "(flags & bit) <> 0"),
    "lw_mapq": ("p DOUBLE", "INT", "CASE WHEN p <= 0.1 THEN 0 WHEN p <= 0.29 THEN 1 WHEN p <= 0.435 THEN 2 WHEN p <= 0.55 THEN 3 ELSE CAST(floor(-10 * log10(1 - least(p, 0.99993D)) + 0.5) AS INT) END"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the scalar functions callable from SQL in this session; they are inlined, not called."""
    for name, (args, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(SQL_FUNCTIONS)
