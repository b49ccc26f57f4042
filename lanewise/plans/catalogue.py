"""The engine's operators as queries over the derived tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise import config
from lanewise.functions import codecs, scoring
from lanewise.operators import anchors, demux
from lanewise.plans import derive
from lanewise.plans.derive import with_tables
from lanewise.session import shared_dir
from lanewise.sources import bcl, fasta

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SETTINGS = config.Settings(reads="100R,4B,4B,100R", anchor_length=13).resolved()
SAMPLES, ERRORS = (("ACGT", "ACGA"), ("CCGT", "TTAA"), ("GATC", "GGTA")), (3, 2)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- decoding ----


def _bytes(spark, sf_dir, *columns):
    return derive.reads(spark, sf_dir).select(*columns, derive.calls(F.col("w")).alias("calls"))


@query(with_tables("calls") + """
SELECT read_no, string_agg(CASE WHEN b < 4 THEN 'N' ELSE substr('ACGT', (b & 3) + 1, 1) END, '' ORDER BY cycle) AS seq FROM calls GROUP BY read_no""")
def decode_base(spark, sf_dir):
    return _bytes(spark, sf_dir, "read_no").select("read_no", codecs.read_bases(F.col("calls")).alias("seq"))


@query(with_tables("calls") + "SELECT read_no, string_agg(chr(33 + (b >> 2)), '' ORDER BY cycle) AS qual FROM calls GROUP BY read_no")
def decode_qual(spark, sf_dir):
    return _bytes(spark, sf_dir, "read_no").select("read_no", codecs.read_qualities(F.col("calls")).alias("qual"))


@query(with_tables("calls") + "SELECT lane, tile, cycle, b, count(*) AS n FROM calls GROUP BY ALL")
def encode_byte(spark, sf_dir):
    one = F.posexplode(F.split(F.decode("calls", "ISO-8859-1"), "")).alias("at", "x")
    n = _bytes(spark, sf_dir, "lane", "tile").select("lane", "tile", one).groupBy("lane", "tile", "at", "x").agg(F.count("*").alias("n"))
    return n.select("lane", "tile", (F.col("at") + 1).alias("cycle"), F.ascii("x").alias("b"), "n")


@query("""SELECT c, CASE upper(c) WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 ELSE 3 END AS code,
CASE upper(c) WHEN 'A' THEN 'T' WHEN 'C' THEN 'G' WHEN 'G' THEN 'C' WHEN 'T' THEN 'A' ELSE 'N' END AS complement, count(*) AS n
FROM (SELECT unnest(string_split(regexp_replace(text, '[^A-Za-z]', '', 'g'), '')) AS c FROM documents) WHERE c <> '' GROUP BY ALL""")
def two_bit_code(spark, sf_dir):
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    c = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split(letters, "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    return c.select("c", codecs.code_of(F.col("c")).alias("code"), codecs.complement(F.col("c")).alias("complement"), "n")


# ---- files of a run, made of the derived calls and read back ----


def _tile_cycles(reads):
    """lane, tile, cycle and the calls of all reads of the tile, by read. reads: lane, tile, read_no, calls."""
    one = reads.select("lane", "tile", "read_no", F.posexplode(F.regexp_extract_all(F.hex("calls"), F.lit(".."), F.lit(0))).alias("at", "b"))
    rows = one.groupBy("lane", "tile", "at").agg(F.array_sort(F.collect_list(F.struct("read_no", "b"))).alias("x"))  # a file of the run
    return rows.select("lane", "tile", (F.col("at") + 1).alias("cycle"), F.unhex(F.array_join(F.transform("x", lambda x: x["b"]), "")).alias("calls"))


def _int32(n: Column) -> Column:
    """Little-endian."""
    return F.concat(*[F.substring(F.unhex(F.lpad(F.hex(n), 8, "0")), i, 1) for i in (4, 3, 2, 1)])


_ORDERED = "ordered_reads AS (SELECT *, row_number() OVER (PARTITION BY lane, tile ORDER BY read_no) - 1 AS place FROM reads)"


@query(with_tables("calls") + """, places AS (SELECT read_no, row_number() OVER (PARTITION BY lane, tile ORDER BY read_no) - 1 AS place FROM reads),
    per AS (SELECT lane, tile, count(*) AS n FROM reads GROUP BY ALL)
SELECT lane, tile, cycle, n, count(*) AS reads, CAST(sum(b * (place + 1)) AS BIGINT) AS weighted FROM calls JOIN places USING (read_no) JOIN per USING (lane, tile) GROUP BY ALL""")
def bcl_scan(spark, sf_dir):
    """Base call files by path and content: their rows counted by the header, and all reads' calls at their places, summed up."""
    files = _tile_cycles(_bytes(spark, sf_dir, "lane", "tile", "read_no")).select(bcl.bcl_path_of(F.lit("run"), F.col("lane"), F.col("tile"), F.col("cycle")).alias("path"), F.concat(_int32(F.octet_length("calls")), "calls").alias("content"))
    each = bcl.calls_in(bcl.parsed(files))
    return each.groupBy("lane", "tile", "cycle", "n").agg(F.count("*").alias("reads"), F.sum(F.col("b") * (F.col("read_no") + 1)).alias("weighted"))


@query(with_tables("reads") + f", {_ORDERED} SELECT lane, tile, place AS read_no, pass FROM ordered_reads")
def filter_scan(spark, sf_dir):
    one = F.array_sort(F.collect_list(F.struct("read_no", F.when(F.col("pass"), "01").otherwise("00").alias("x"))))
    rows = derive.reads(spark, sf_dir).groupBy("lane", "tile").agg(one.alias("x"))  # a file of the run
    content = F.concat(F.unhex(F.lit("0000000003000000")), _int32(F.size("x")), F.unhex(F.array_join(F.transform("x", lambda x: x["x"]), "")))
    return bcl.filters_in(rows.select(bcl.filter_path_of(F.lit("run"), F.col("lane"), F.col("tile")).alias("path"), content.alias("content")))


@query(with_tables("reads") + "SELECT read_no, substr(barcode, 1, 4) || '-' || substr(barcode, 5, 4) AS barcode, substr(barcode, 1, 4) || '-' || substr(barcode, 5, 1) AS at_cycle_5 FROM reads")
def barcode_decode(spark, sf_dir):
    """Barcodes from the base calls of their cycles, whole and after five of them."""
    calls = derive.reads(spark, sf_dir).select("read_no", F.encode(F.translate("barcode", "ACGT", "\xa0\xa1\xa2\xa3"), "ISO-8859-1").alias("calls"))
    upto = lambda n: codecs.formatted_barcode(codecs.read_bases(F.substring("calls", 1, n)), [4, 4])
    return calls.select("read_no", upto(8).alias("barcode"), upto(5).alias("at_cycle_5"))


@query(with_tables("reference") + "SELECT CAST(row_number() OVER (ORDER BY rid) - 1 AS INTEGER) AS rid, 'x>' || name || '_of_' || rid AS name, seq, length FROM reference")
def fasta_scan(spark, sf_dir):
    """Items as FASTA text: headers with spaces and '>', lines of 60 letters that end in both ways, empty lines."""
    lines = F.concat(F.lit("x>"), "name", F.lit(" of "), F.col("rid").cast("string"), F.lit("\r\n"), F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n"), F.lit("\n\n"))
    return fasta.parsed(derive.reference(spark, sf_dir).select(F.col("rid").alias("_n"), lines.alias("value")))


@query(with_tables("reads") + "SELECT lane, tile, count(*) AS n, count(*) FILTER (pass) AS n_pass, sum(length(seq)) FILTER (pass) AS bases FROM reads GROUP BY ALL")
def chastity_filter(spark, sf_dir):
    reads = derive.reads(spark, sf_dir)
    return reads.groupBy("lane", "tile").agg(F.count("*").alias("n"), F.count_if("pass").alias("n_pass"), F.sum(F.when(F.col("pass"), F.length("seq"))).cast("long").alias("bases"))


# ---- barcodes ----

_SAMPLES_SQL = "samples AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(SAMPLES)) + ") AS t(idx, a, b))"


@query(with_tables("reads") + f", {_SAMPLES_SQL} SELECT read_no, idx, CAST(hamming(substr(barcode, 1, 4), a) AS INTEGER) AS d1, CAST(hamming(substr(barcode, 5, 4), b) AS INTEGER) AS d2 FROM reads CROSS JOIN samples")
def barcode_hamming(spark, sf_dir):
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(SAMPLES)])).alias("s")
    r = derive.reads(spark, sf_dir).select("read_no", "barcode", each)
    return r.select("read_no", "s.idx", demux.distance(F.substring("barcode", 1, 4), F.col("s.a")).alias("d1"), demux.distance(F.substring("barcode", 5, 4), F.col("s.b")).alias("d2"))


@query(with_tables("reads") + f""", {_SAMPLES_SQL}, first AS (SELECT read_no, min(idx) AS idx FROM reads JOIN samples ON hamming(substr(barcode, 1, 4), a) <= 3 AND hamming(substr(barcode, 5, 4), b) <= 2 GROUP BY read_no)
SELECT coalesce(a || '-' || b, 'undetermined') AS sample, count(*) AS n FROM reads LEFT JOIN first USING (read_no) LEFT JOIN samples USING (idx) GROUP BY 1""")
def demux_counts(spark, sf_dir):
    return demux.routed(derive.reads(spark, sf_dir), SAMPLES, ERRORS, True).groupBy("sample").agg(F.count("*").alias("n"))


@query(with_tables("reads") + "SELECT DISTINCT doc_id, substr(barcode, 1, 4) || '-' || substr(barcode, 5, 4) AS barcode, substr(barcode, 1, 4) || '-' || substr(barcode, 5, 2) AS partial FROM reads")
def format_barcode(spark, sf_dir):
    one = derive.reads(spark, sf_dir).select("doc_id", "barcode").distinct()
    part = F.substring("barcode", 1, 6)
    return one.select("doc_id", codecs.formatted_barcode(F.col("barcode"), [4, 4]).alias("barcode"), codecs.formatted_barcode(part, [4, 4]).alias("partial"))


# ---- cycles, segments, tiles ----

_SEGMENTS_SQL = "segments AS (SELECT * FROM (VALUES " + ", ".join(f"({s.seg_id}, {s.mate}, {s.length}, {s.start_cycle})" for s in SETTINGS.segments) + ") AS t(seg_id, mate, length, start_cycle))"


def segments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s.seg_id, s.mate, s.length, s.start_cycle) for s in SETTINGS.segments], "seg_id int, mate int, length int, start_cycle int")


def _cycles(spark: SparkSession) -> DataFrame:
    return spark.range(1, SETTINGS.total_cycles + 1).select(F.col("id").cast("int").alias("cycle"))


@query(f"WITH {_SEGMENTS_SQL} SELECT CAST(c AS INTEGER) AS cycle, seg_id, mate, CAST(c - start_cycle + 1 AS INTEGER) AS segment_cycle FROM range(1, {SETTINGS.total_cycles + 1}) AS t(c) JOIN segments ON c >= start_cycle AND c < start_cycle + length")
def segment_of_cycle(spark, sf_dir):
    c, s = _cycles(spark), F.broadcast(segments(spark))  # a row per segment of the run
    inside = (c["cycle"] >= s["start_cycle"]) & (c["cycle"] < s["start_cycle"] + s["length"])
    return c.join(s, inside).select("cycle", "seg_id", "mate", (F.col("cycle") - F.col("start_cycle") + 1).alias("segment_cycle"))


@query(f"WITH {_SEGMENTS_SQL} SELECT CAST(c AS INTEGER) AS cycle, mate, CAST(least(length, greatest(0, c - start_cycle + 1)) AS INTEGER) AS done FROM range(1, {SETTINGS.total_cycles + 1}) AS t(c) CROSS JOIN segments WHERE mate > 0")
def mate_cycle(spark, sf_dir):
    mates = F.explode(F.array(*[F.struct(F.lit(s.mate).alias("mate"), F.lit(s.start_cycle).alias("start"), F.lit(s.length).alias("length")) for s in SETTINGS.segments if s.mate])).alias("m")
    return _cycles(spark).select("cycle", mates).select("cycle", "m.mate", codecs.mate_cycle(F.col("cycle"), F.col("m.start"), F.col("m.length")).alias("done"))


@query("SELECT CAST(c AS INTEGER) AS cycle FROM range(1, 209) AS t(c) WHERE c >= 13 AND c - 13 <= 50 AND (c - 13) % 6 = 0")
def seeding_cycles(spark, sf_dir):
    s = SETTINGS
    return _cycles(spark).where(codecs.is_seeding_cycle(F.col("cycle"), s.anchor_length, s.seeding_interval, s.max_softclip_length))


@query("SELECT CAST(s * 1000 + w * 100 + t AS INTEGER) AS tile FROM range(1, 3) AS a(s), range(1, 4) AS b(w), range(1, 17) AS c(t)")
def tile_layout(spark, sf_dir):
    return spark.range(1).select(F.explode(codecs.tile_numbers(F.lit(2), F.lit(3), F.lit(16))).alias("tile"))


@query(with_tables("reads") + """SELECT read_no, reverse(translate(seq, 'ACGT', 'TGCA')) AS reversed, translate(substr(seq, 1, 9), 'ACGT', 'TGCA') AS complement, CAST(instr('ACG', substr(seq, 1, 1)) + CASE WHEN substr(seq, 1, 1) = 'T' THEN 4 ELSE 0 END - 1 AS INTEGER) AS code,
    CAST(n % 40 * 4 + instr('ACGT', substr(seq, 2, 1)) - 1 AS INTEGER) AS call, CASE WHEN n % 40 = 0 THEN 'N' ELSE substr(seq, 2, 1) END AS base, chr(CAST(33 + n % 40 AS INTEGER)) AS quality,
    substr(barcode, 1, 4) || '-' || substr(barcode, 5, 2) AS barcode, 'lane.' || lane || '|tile.' || tile || '|read.' || read_no AS name, CAST(least(100, greatest(0, n % 300 - 108)) AS INTEGER) AS done,
    n % 100 >= 13 AND n % 100 <= 63 AND (n % 100 - 13) % 6 = 0 AS seeding, CAST((n % 4096) | 16 AS INTEGER) AS turned, CAST((n % 4096) & 4079 AS INTEGER) AS forward, (n & 16) <> 0 AS is_reverse,
    CASE WHEN n % 1000 <= 100 THEN 0 WHEN n % 1000 <= 290 THEN 1 WHEN n % 1000 <= 435 THEN 2 WHEN n % 1000 <= 550 THEN 3 ELSE CAST(floor(-10 * log10(1 - least(n % 1000 / 1000.0, 0.99993)) + 0.5) AS INTEGER) END AS mapq
FROM (SELECT *, abs(read_no) AS n FROM reads)""")
def sql_functions(spark, sf_dir):
    """The scalar functions that ``codecs.register`` makes, called from SQL."""
    codecs.register(spark)
    derive.reads(spark, sf_dir).createOrReplaceTempView("lw_reads")
    return spark.sql("""SELECT read_no, lw_reverse_complement(lower(seq)) AS reversed, lw_complement(substr(seq, 1, 9)) AS complement, lw_code(lower(substr(seq, 1, 1))) AS code, lw_call(substr(seq, 2, 1), CAST(n % 40 AS INT)) AS call,
        lw_base(lw_call(substr(seq, 2, 1), CAST(n % 40 AS INT))) AS base, lw_quality(lw_call(substr(seq, 2, 1), CAST(n % 40 AS INT))) AS quality, lw_barcode(substr(barcode, 1, 6), array(4, 4)) AS barcode,
        lw_read_name(lane, tile, read_no) AS name, lw_mate_cycle(CAST(n % 300 AS INT), 109, 100) AS done, lw_is_seeding_cycle(CAST(n % 100 AS INT), 13, 6, 50) AS seeding, lw_with_flag(CAST(n % 4096 AS INT), 16) AS turned,
        lw_without_flag(CAST(n % 4096 AS INT), 16) AS forward, lw_has_flag(CAST(n % 4096 AS INT), 16) AS is_reverse, lw_mapq(n % 1000 / 1000D) AS mapq FROM (SELECT *, abs(read_no) AS n FROM lw_reads)""")


# ---- strands, k-mers, placements ----


@query(with_tables("reads") + "SELECT read_no, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq, 16 AS flag, 'lane.' || lane || '|tile.' || tile || '|read.' || read_no AS qname FROM reads")
def reverse_complement(spark, sf_dir):
    r = derive.reads(spark, sf_dir)
    return r.select("read_no", codecs.reverse_complement(F.col("seq")).alias("seq"), codecs.with_flag(F.lit(0), codecs.REVERSE).alias("flag"), codecs.read_name(F.col("lane"), F.col("tile"), F.col("read_no")).alias("qname"))


def _strands(spark, sf_dir):
    return anchors.strands(derive.reference(spark, sf_dir))


@query(with_tables("strands") + "SELECT gid, rid, seq, length FROM strands")
def strand_index(spark, sf_dir):
    return _strands(spark, sf_dir).select("gid", "rid", "seq", "length")


@query(with_tables("kmers") + "SELECT k, gid, pos FROM kmers")
def kmer_index(spark, sf_dir):
    return anchors.kmers(_strands(spark, sf_dir))


@query(with_tables("anchors", "kmers") + "SELECT read_no, gid, pos FROM anchors JOIN kmers USING (k) WHERE clip = 0")
def anchor_join(spark, sf_dir):
    a = anchors.anchors(derive.reads(spark, sf_dir)).where("clip = 0")
    return a.join(anchors.kmers(_strands(spark, sf_dir)), "k").select("read_no", "gid", "pos")


@query(with_tables("anchors", "kmers") + "SELECT read_no, clip, gid, pos FROM anchors JOIN kmers USING (k)")
def anchor_join_softclip(spark, sf_dir):
    return anchors.anchors(derive.reads(spark, sf_dir)).join(anchors.kmers(_strands(spark, sf_dir)), "k").select("read_no", "clip", "gid", "pos")


def _repeated(spark, sf_dir):
    """Strands of the items with repeats."""
    return anchors.strands(derive.with_repeats(spark, sf_dir))


def _placed(spark, sf_dir):
    return anchors.placements(derive.all_reads(spark, sf_dir), _repeated(spark, sf_dir))


def _scored(spark, sf_dir):
    return anchors.scored(_placed(spark, sf_dir))


@query(with_tables("placed", "strands", planted=True) + "SELECT p.read_no, p.gid, p.pos, p.clip, CAST(hamming(substr(p.seq, p.clip + 1), substr(s.seq, CAST(p.pos + p.clip + 1 AS BIGINT), 100 - p.clip)) AS INTEGER) AS mismatches FROM placed p JOIN strands s USING (gid)")
def mismatch_count(spark, sf_dir):
    p = _placed(spark, sf_dir)
    return p.select("read_no", "gid", "pos", "clip", anchors.mismatches(F.col("seq"), F.col("target"), F.col("clip")).alias("mismatches"))


@query(with_tables("scored", planted=True) + "SELECT read_no, gid, pos, clip, mismatches, score FROM scored")
def ungapped_extend(spark, sf_dir):
    return _scored(spark, sf_dir).select("read_no", "gid", "pos", "clip", "mismatches", "score")


@query(with_tables("anchors", "kmers", planted=True) + "SELECT read_no, clip, first.gid AS gid, first.e AS \"end\", n FROM (SELECT read_no, clip, min({'gid': gid, 'e': pos + 13}) AS first, count(*) AS n FROM anchors JOIN kmers USING (k) GROUP BY ALL)")
def interval_identity(spark, sf_dir):
    hits = anchors.anchors(derive.all_reads(spark, sf_dir)).join(anchors.kmers(_repeated(spark, sf_dir)), "k")
    return anchors.identity(hits.select("read_no", "clip", "gid", (F.col("pos") + 13).alias("end"))).select("read_no", "clip", "first.gid", "first.end", "n")


@query(with_tables("anchors", "kmers", planted=True) + """SELECT read_no, gid, start, clip FROM (
SELECT read_no, gid, pos - clip AS start, clip, row_number() OVER (PARTITION BY read_no, gid, pos - clip ORDER BY clip) AS r FROM anchors JOIN kmers USING (k)) WHERE r = 1""")
def prune_equal_interval(spark, sf_dir):
    hits = anchors.anchors(derive.all_reads(spark, sf_dir)).join(anchors.kmers(_repeated(spark, sf_dir)), "k")
    return hits.groupBy("read_no", "gid", (F.col("pos") - F.col("clip")).alias("start")).agg(F.min("clip").alias("clip"))


# ---- scores and record fields ----


@query("SELECT CAST(c AS INTEGER) AS cycle, CAST(CASE WHEN c < 13 THEN -20 ELSE greatest(-ceil((c - 13) / 6.0) * 6, -20) END AS INTEGER) AS least FROM range(1, 101) AS t(c)")
def min_cycle_score(spark, sf_dir):
    return _cycles(spark).where("cycle <= 100").select("cycle", scoring.min_cycle_score(F.col("cycle"), 100, SETTINGS).alias("least"))


def _with_cigar(spark, sf_dir):
    return _scored(spark, sf_dir).withColumn("cigar", anchors.ungapped_cigar(F.col("seq"), F.col("target"), F.col("clip")))


#: Runs of matches and mismatches behind the clip, by numbering changes.
_RUNS = with_tables("scored", "reads", "strands", planted=True) + """, cells AS (
    SELECT s.read_no, s.gid, s.pos, s.clip, i, substr(r.seq, i, 1) = substr(g.seq, CAST(s.pos + i AS BIGINT), 1) AS same, substr(g.seq, CAST(s.pos + i AS BIGINT), 1) AS base
    FROM (SELECT *, CAST(unnest(range(clip + 1, 101)) AS INTEGER) AS i FROM scored) s JOIN reads r USING (read_no) JOIN strands g ON g.gid = s.gid
), numbered AS (
    SELECT *, i - row_number() OVER (PARTITION BY read_no, gid, pos, same ORDER BY i) AS run FROM cells
), runs AS (
    SELECT read_no, gid, pos, clip, same, run, min(i) AS i, CAST(count(*) AS INTEGER) AS n, string_agg(base, '' ORDER BY i) AS bases FROM numbered GROUP BY ALL
), ordered AS (
    SELECT *, row_number() OVER (PARTITION BY read_no, gid, pos ORDER BY i) AS nth, count(*) OVER (PARTITION BY read_no, gid, pos) AS total FROM runs
)
"""


@query(_RUNS + """SELECT read_no, gid, pos, CASE WHEN clip > 0 THEN clip || 'S' ELSE '' END || (100 - clip) || 'M' AS cigar,
CASE WHEN clip > 0 THEN clip || 'S' ELSE '' END || string_agg(n || CASE WHEN same THEN 'M' ELSE 'X' END, '' ORDER BY i) AS extended FROM ordered GROUP BY read_no, gid, pos, clip""")
def cigar_string(spark, sf_dir):
    c = _with_cigar(spark, sf_dir)
    return c.select("read_no", "gid", "pos", scoring.cigar_string(F.col("cigar")).alias("cigar"), scoring.cigar_string(F.col("cigar"), True).alias("extended"))


@query(_RUNS + "SELECT read_no, gid, pos, string_agg(CASE WHEN same THEN CAST(n AS VARCHAR) ELSE bases END, '' ORDER BY i) AS md FROM ordered GROUP BY ALL")
def md_string(spark, sf_dir):
    return _with_md(spark, sf_dir).select("read_no", "gid", "pos", "md")


def _with_md(spark, sf_dir):
    c = _with_cigar(spark, sf_dir)
    different = F.zip_with(F.split("seq", ""), F.split("target", ""), lambda x, y: F.struct((x != y).alias("d"), y.alias("base")))
    behind = F.filter(F.transform(different, lambda x, i: F.struct(x["d"].alias("d"), x["base"].alias("base"), i.alias("i"))), lambda x: x["d"] & (x["i"] >= F.col("clip")))
    return c.withColumn("md", scoring.md_string(F.col("cigar"), F.array_join(F.transform(behind, lambda x: x["base"]), "")))


@query(_RUNS + """SELECT read_no, gid, pos, string_agg(CASE WHEN same THEN CAST(n AS VARCHAR) ELSE reverse(translate(bases, 'ACGT', 'TGCA')) END, '' ORDER BY i DESC) AS md FROM ordered GROUP BY ALL""")
def reverse_md(spark, sf_dir):
    return _with_md(spark, sf_dir).select("read_no", "gid", "pos", codecs.reverse_md(F.col("md")).alias("md"))


@query(_RUNS + """SELECT read_no, gid, pos, CAST(sum(CASE WHEN NOT same AND (nth > 1 OR clip > 0) THEN n ELSE 0 END) AS INTEGER) AS nm, clip FROM ordered GROUP BY read_no, gid, pos, clip""")
def edit_distance(spark, sf_dir):
    c = _with_cigar(spark, sf_dir)
    return c.select("read_no", "gid", "pos", scoring.edit_distance(F.col("cigar")).alias("nm"), scoring.softclip_length(F.col("cigar")).alias("clip"))


@query(_RUNS + """SELECT read_no, gid, pos, CAST(trunc(trunc(CASE WHEN clip > 0 THEN -(6.0 + clip * (6.0 / 13)) ELSE 0 END) - sum(CASE WHEN same OR (nth = total AND NOT same) OR (nth = 1 AND clip = 0) THEN 0 ELSE 6 * n END)
- max(CASE WHEN NOT same AND nth = 1 AND clip = 0 THEN 6.0 + n * 6.0 / 13 ELSE 0 END) - max(CASE WHEN NOT same AND nth = total AND NOT (nth = 1 AND clip = 0) THEN 6.0 + n * 6.0 / 13 ELSE 0 END)) AS INTEGER) AS score FROM ordered GROUP BY read_no, gid, pos, clip""")
def alignment_score(spark, sf_dir):
    c = _with_cigar(spark, sf_dir)
    return c.select("read_no", "gid", "pos", scoring.alignment_score(F.col("cigar"), SETTINGS).alias("score"))


@query(with_tables("scored", "strands", planted=True) + "SELECT read_no, gid, s.pos, CASE WHEN gid % 2 = 0 THEN s.pos + clip ELSE length - s.pos - 100 END AS start FROM scored s JOIN strands USING (gid)")
def sam_start_pos(spark, sf_dir):
    c = _with_cigar(spark, sf_dir)
    # where the reversed text of a strand holds the read's last base
    position = F.col("length") - F.col("pos") - 100
    return c.select("read_no", "gid", "pos", scoring.sam_start(F.col("gid"), position, F.col("length"), F.col("cigar")).alias("start"))


_MAPQ_SQL = """, per AS (SELECT *, max(score) OVER w AS best, count(*) OVER w AS places, sum(pow(0.01, -score / 6.0)) OVER w AS total, CASE WHEN score = 0 THEN 1.0 ELSE 0.49995 + 0.5 * (1 - pow(10.0, -5 - 100.0 * (20 / 6.0) / 100 + 2 * (100.0 * (-score / 6.0) / 100))) END AS p
    FROM scored WINDOW w AS (PARTITION BY read_no)), q AS (SELECT *, p * pow(0.01, (best - score) / 6.0) / (total / pow(0.01, -best / 6.0)) AS r FROM per)
SELECT read_no, gid, pos, CAST(CASE WHEN places = 1 AND score = 0 THEN 42 WHEN r <= 0.1 THEN 0 WHEN r <= 0.29 THEN 1 WHEN r <= 0.435 THEN 2 WHEN r <= 0.55 THEN 3 ELSE floor(-10 * log10(1 - least(r, 0.99993)) + 0.5) END AS INTEGER) AS mapq FROM q"""


@query(with_tables("scored", planted=True) + _MAPQ_SQL)
def mapq(spark, sf_dir):
    from pyspark.sql import Window

    per = Window.partitionBy("read_no")
    cycle = F.lit(100)
    s = _scored(spark, sf_dir).withColumn("best", F.max("score").over(per)).withColumn("places", F.count("*").over(per))
    share = F.pow(F.lit(0.01), (F.col("best") - F.col("score")) / F.lit(6.0))
    s = s.withColumn("total", F.sum(share).over(per))
    return s.select("read_no", "gid", "pos", scoring.mapq(F.col("score"), F.col("best"), F.col("total"), F.col("places") == 1, cycle, 100, SETTINGS).alias("mapq"))


# ---- report modes ----

_RANKED = with_tables("scored", planted=True) + """, ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY read_no ORDER BY score DESC, clip > 0, clip, gid, pos) AS INTEGER) AS rank,
    max(score) OVER (PARTITION BY read_no) AS best, count(*) OVER (PARTITION BY read_no) AS places FROM scored)
SELECT read_no, gid, pos, score, rank, CASE WHEN rank > 1 THEN 256 ELSE 0 END + CASE WHEN gid % 2 = 1 THEN 16 ELSE 0 END AS flag FROM ranked WHERE """


def _mode(mode: str, n: int = 0):
    def run(spark, sf_dir):
        rows = anchors.reported(anchors.ranked(_scored(spark, sf_dir)), mode, n)
        flag = F.when(F.col("rank") > 1, codecs.SECONDARY).otherwise(0) + F.when(F.col("gid") % 2 == 1, codecs.REVERSE).otherwise(0)
        return rows.select("read_no", "gid", "pos", "score", "rank", flag.alias("flag"))

    return run


for _name, _n, _where in (("ALL", 0, "true"), ("ALLBEST", 0, "score = best"), ("ANYBEST", 0, "rank = 1"), ("BESTN", 2, "rank <= 2"), ("UNIQUE", 0, "places = 1")):
    QUERIES[f"mode_{_name.lower()}"] = _mode(_name, _n)
    SQL[f"mode_{_name.lower()}"] = _RANKED + _where


# ---- sizes, defaults, tasks ----


@query(with_tables("strands") + "SELECT CAST(sum(length) AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS strands FROM strands")
def genome_size(spark, sf_dir):
    return _strands(spark, sf_dir).agg(F.sum("length").alias("size"), F.count("*").alias("strands"))


_MODES = "(VALUES ('very-fast', 1.25, 0.015), ('fast', 1.125, 0.02), ('balanced', 1.0, 0.025), ('accurate', 0.875, 0.03), ('very-accurate', 0.75, 0.035)) AS m(mode, factor, rate)"


@query(with_tables("strands") + f"SELECT mode, CAST(floor(floor(ln((SELECT sum(length) FROM strands) / 1e-4) / ln(4)) * factor) AS INTEGER) AS anchor FROM {_MODES}")
def default_anchor(spark, sf_dir):
    size = _strands(spark, sf_dir).agg(F.sum("length").alias("n"))
    base = F.floor(F.ln(F.col("n") / 1e-4) / F.ln(F.lit(4.0)))
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(config._ANCHOR_FACTOR[m]).alias("f")) for m in config.ALIGN_MODES])).alias("m")
    return size.select("n", modes).select("m.mode", F.floor(base * F.col("m.f")).cast("int").alias("anchor"))


@query(f"SELECT mode, CAST(trunc(-(100 * rate * 9)) AS INTEGER) AS fixed_gap, CAST(trunc(-(100 * rate * 8)) AS INTEGER) AS least FROM {_MODES}")
def default_min_as(spark, sf_dir):
    gap = config.Scores(insertion_open=6)
    rows = [(m, config.default_min_score(100, m, gap), config.default_min_score(100, m, config.Scores())) for m in config.ALIGN_MODES]
    return spark.createDataFrame(rows, "mode string, fixed_gap int, least int")


@query(with_tables("anchors", "kmers", "reads") + "SELECT lane, tile, clip + 13 AS cycle, count(*) AS seeds FROM anchors JOIN kmers USING (k) JOIN reads USING (read_no) GROUP BY ALL")
def seeds_per_task(spark, sf_dir):
    reads = derive.reads(spark, sf_dir)
    hits = anchors.anchors(reads).join(anchors.kmers(_strands(spark, sf_dir)), "k")
    return hits.join(reads.select("read_no", "lane", "tile"), "read_no").groupBy("lane", "tile", (F.col("clip") + 13).alias("cycle")).agg(F.count("*").alias("seeds"))


@query("""WITH t AS (SELECT user_id % 8 + 1 AS lane, CASE event_type WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'FINISHED' ELSE 'WAITING' END AS status FROM events)
SELECT lane, status, count(*) AS n, bool_and(status = 'FINISHED') AS done FROM t GROUP BY ALL""")
def task_status_counts(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "RUNNING").when(F.col("event_type") == "view", "FINISHED").otherwise("WAITING")
    tasks = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 8 + 1).alias("lane"), kind.alias("status"))
    return tasks.groupBy("lane", "status").agg(F.count("*").alias("n"), F.bool_and(F.col("status") == "FINISHED").alias("done"))


# ---- records of ungapped placements ----

#: Of each placement: its place, how good it is, its texts on the read's strand and on the contig's forward strand.
_PLACES = _RUNS.rstrip() + """, texts AS (
    SELECT read_no, gid, pos, clip, CASE WHEN clip > 0 THEN clip || 'S' ELSE '' END || string_agg(n || CASE WHEN same THEN 'M' ELSE 'X' END, '' ORDER BY i) AS text, count(*) + CASE WHEN clip > 0 THEN 1 ELSE 0 END AS size,
        coalesce(string_agg(bases, '' ORDER BY i) FILTER (NOT same), '') AS bases, string_agg(CASE WHEN same THEN CAST(n AS VARCHAR) ELSE bases END, '' ORDER BY i) AS md,
        string_agg(CASE WHEN same THEN CAST(n AS VARCHAR) ELSE reverse(translate(bases, 'ACGT', 'TGCA')) END, '' ORDER BY i DESC) AS md_reverse,
        (100 - clip) || 'M' || CASE WHEN clip > 0 THEN clip || 'S' ELSE '' END AS cigar_reverse,
        CAST(sum(CASE WHEN NOT same AND (nth > 1 OR clip > 0) THEN n ELSE 0 END) AS INTEGER) AS nm,
        CAST(trunc(trunc(CASE WHEN clip > 0 THEN -(6.0 + clip * (6.0 / 13)) ELSE 0 END) - sum(CASE WHEN same OR (nth = total AND NOT same) OR (nth = 1 AND clip = 0) THEN 0 ELSE 6 * n END)
            - max(CASE WHEN NOT same AND nth = 1 AND clip = 0 THEN 6.0 + n * 6.0 / 13 ELSE 0 END) - max(CASE WHEN NOT same AND nth = total AND NOT (nth = 1 AND clip = 0) THEN 6.0 + n * 6.0 / 13 ELSE 0 END)) AS INTEGER) AS score
    FROM ordered GROUP BY read_no, gid, pos, clip
), per AS (
    SELECT *, max(score) OVER w AS best, count(*) OVER w AS found, sum(pow(0.01, -score / 6.0)) OVER w AS total, CASE WHEN score = 0 THEN 1.0 ELSE 0.49995 + 0.5 * (1 - pow(10.0, -5 - 100.0 * (20 / 6.0) / 100 + 2 * (100.0 * (-score / 6.0) / 100))) END AS p
    FROM texts WINDOW w AS (PARTITION BY read_no)
), likely AS (SELECT *, p * pow(0.01, (best - score) / 6.0) / (total / pow(0.01, -best / 6.0)) AS r FROM per
), placed_records AS (
    SELECT t.*, s.rid, f.name AS rname, CASE WHEN t.gid % 2 = 0 THEN pos + clip ELSE s.length - pos - 100 END AS start, s.length - pos - 100 AS place,
        CASE WHEN found = 1 AND score = 0 THEN 42 WHEN r <= 0.1 THEN 0 WHEN r <= 0.29 THEN 1 WHEN r <= 0.435 THEN 2 WHEN r <= 0.55 THEN 3 ELSE CAST(floor(-10 * log10(1 - least(r, 0.99993)) + 0.5) AS INTEGER) END AS mapq,
        dense_rank() OVER (PARTITION BY read_no ORDER BY score DESC, clip > 0, clip, size, text, bases) AS seed
    FROM likely t JOIN strands s USING (gid) JOIN reference f USING (rid) WHERE score >= -20 AND clip <= 20
)
"""


def _states(spark, sf_dir, reads):
    """Ungapped placements as states of whole reads: read_no and what ``reads`` has besides (lane, tile, mate, calls)."""
    return anchors.states(_scored(spark, sf_dir), reads)


def _whole_reads(spark, sf_dir, *more):
    return derive.all_reads(spark, sf_dir).select("lane", "tile", "read_no", F.lit(1).alias("mate"), derive.calls(F.col("w")).alias("calls"), *more)


@query(_PLACES + """, turn AS (SELECT *, row_number() OVER (PARTITION BY read_no ORDER BY seed, gid, place) AS turn_no FROM placed_records), RECURSIVE_WALK
SELECT read_no, gid, CAST(start AS BIGINT) AS start, score, CAST(row_number() OVER (PARTITION BY read_no ORDER BY turn_no) AS INTEGER) AS nth, CAST(mapq AS INTEGER) AS mapq FROM walk WHERE taken""")
def ungapped_records(spark, sf_dir):
    """Places that remain when those near a better one of the same strand are passed over, in the order of their rank."""
    from lanewise.operators import mapping

    settings = config.Settings(reads="100R", anchor_length=13, out_mode="ALL").resolved()
    found = mapping.alignments(_states(spark, sf_dir, _whole_reads(spark, sf_dir)), None, settings)
    return mapping.records(found, derive.with_repeats(spark, sf_dir), settings).select("read_no", "gid", "start", "score", "nth", "mapq")


SQL["ungapped_records"] = SQL["ungapped_records"].replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_WALK", """walk AS (
    SELECT read_no, 0::BIGINT AS turn_no, 0 AS gid, 0::BIGINT AS start, 0 AS score, 0 AS mapq, CAST([] AS VARCHAR[]) AS seen, false AS taken FROM (SELECT DISTINCT read_no FROM turn)
    UNION ALL
    SELECT t.read_no, t.turn_no, t.gid, t.start, t.score, t.mapq, CASE WHEN new THEN list_append(seen, t.gid || ':' || (t.start - t.start % 10)) ELSE seen END, new
    FROM (SELECT t.*, w.seen, NOT list_contains(w.seen, t.gid || ':' || (t.start - t.start % 10)) AND NOT list_contains(w.seen, t.gid || ':' || (t.start - t.start % 10 + 10)) AS new
          FROM walk w JOIN turn t ON t.read_no = w.read_no AND t.turn_no = w.turn_no + 1) t
)""")

#: The first record of a read, or of a mate: its sequence as called, turned for the reverse strand.
_CALLED = """called AS (SELECT read_no, string_agg(CASE WHEN b < 4 THEN 'N' ELSE substr('ACGT', (b & 3) + 1, 1) END, '' ORDER BY cycle) AS seq, string_agg(chr(33 + (b >> 2)), '' ORDER BY cycle) AS qual FROM
    (SELECT read_no, c AS cycle, CAST(((ascii(substr(w, c, 1)) * 7 + c) % 41) * 4 + instr('ACGT', substr(seq, c, 1)) - 1 AS INTEGER) AS b FROM (SELECT *, CAST(unnest(range(1, 101)) AS INTEGER) AS c FROM reads SEMI JOIN placed_records USING (read_no))) GROUP BY read_no)"""
_CIGAR = "CASE WHEN gid % 2 = 1 THEN cigar_reverse ELSE CASE WHEN clip > 0 THEN clip || 'S' ELSE '' END || (100 - clip) || 'M' END"


@query(_PLACES + f""", first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read_no ORDER BY seed, gid, place) AS nth FROM placed_records) WHERE nth = 1), {_CALLED}
SELECT 'lane.' || lane || '|tile.' || tile || '|read.' || read_no || chr(9) || CASE WHEN gid % 2 = 1 THEN 16 ELSE 0 END || chr(9) || rname || chr(9) || (start + 1) || chr(9) || mapq || chr(9) || {_CIGAR} || chr(9) || '*' || chr(9) || '0' || chr(9) || '0' || chr(9)
    || CASE WHEN gid % 2 = 1 THEN reverse(translate(c.seq, 'ACGT', 'TGCA')) ELSE c.seq END || chr(9) || CASE WHEN gid % 2 = 1 THEN reverse(qual) ELSE qual END
    || chr(9) || 'AS:i:' || score || chr(9) || 'BC:Z:' || substr(barcode, 1, 4) || '-' || substr(barcode, 5, 4) || chr(9) || 'NM:i:' || nm || chr(9) || 'MD:Z:' || CASE WHEN gid % 2 = 1 THEN md_reverse ELSE md END AS line
FROM first JOIN called c USING (read_no) JOIN reads USING (read_no)""")
def sam_lines(spark, sf_dir):
    """The best place of every read as a line of SAM text."""
    from lanewise.operators import mapping
    from lanewise.sources import sam

    settings = config.Settings(reads="100R", anchor_length=13, out_mode="ANYBEST").resolved()
    barcodes = derive.all_reads(spark, sf_dir).select("lane", "tile", "read_no", codecs.formatted_barcode(F.col("barcode"), [4, 4]).alias("barcode"), F.lit("all").alias("sample"))
    records = mapping.sam(_states(spark, sf_dir, _whole_reads(spark, sf_dir)), derive.with_repeats(spark, sf_dir), None, settings, barcodes)
    return records.select(sam.line_of().alias("line"))


@query(_PLACES + """, pairs AS (SELECT read_no, lane, read_no - CASE WHEN read_no % 2 <> 0 THEN 1 ELSE 0 END AS pair, CAST(CASE WHEN read_no % 2 <> 0 THEN 2 ELSE 1 END AS INTEGER) AS mate FROM reads),
turn AS (SELECT p.*, pair, mate, row_number() OVER (PARTITION BY read_no, seed ORDER BY gid, place) AS nth FROM placed_records p JOIN pairs USING (read_no)),
ones AS (SELECT *, row_number() OVER (PARTITION BY pair, mate ORDER BY seed) AS of_mate FROM turn WHERE nth = 1),
leader AS (SELECT pair, gid AS lead_gid, start - start % 10 AS lead FROM ones WHERE mate = 1 AND of_mate = 1),
seconds AS (SELECT o.*, row_number() OVER (PARTITION BY o.pair ORDER BY of_mate) AS r2 FROM ones o LEFT JOIN leader USING (pair) WHERE mate = 2 AND NOT coalesce(gid = lead_gid AND (start - start % 10 = lead OR start - start % 10 + 10 = lead), false)),
heads AS (SELECT pair, mate, gid, rname, start, text FROM ones WHERE mate = 1 AND of_mate = 1 UNION ALL SELECT pair, mate, gid, rname, start, text FROM seconds WHERE r2 = 1),
whole AS (SELECT p.pair, p.mate, p.lane, count(*) OVER (PARTITION BY p.pair, p.lane) AS mates, h.gid, h.rname, h.start, o.gid AS o_gid, o.rname AS o_rname, o.start AS o_start, o.pair IS NOT NULL AS o_mapped
    FROM pairs p LEFT JOIN heads h ON h.pair = p.pair AND h.mate = p.mate LEFT JOIN heads o ON o.pair = p.pair AND o.mate = 3 - p.mate)
SELECT pair AS read_no, mate, CAST(CASE WHEN mates = 2 THEN 1 + CASE mate WHEN 1 THEN 64 ELSE 128 END + CASE WHEN NOT o_mapped THEN 8 WHEN o_gid % 2 = 1 THEN 32 ELSE 0 END ELSE 0 END + CASE WHEN gid IS NULL THEN 4 WHEN gid % 2 = 1 THEN 16 ELSE 0 END AS INTEGER) AS flag,
    coalesce(rname, CASE WHEN mates = 2 THEN o_rname END, '*') AS rname, CAST(coalesce(start, CASE WHEN mates = 2 THEN o_start END, -1) + 1 AS BIGINT) AS pos,
    CASE WHEN mates = 2 THEN coalesce(CASE WHEN o_mapped THEN o_rname ELSE rname END, '*') ELSE '*' END AS rnext, CAST(CASE WHEN mates = 2 THEN coalesce(CASE WHEN o_mapped THEN o_start ELSE start END, -1) + 1 ELSE 0 END AS BIGINT) AS pnext
FROM whole""")
def mate_pairs(spark, sf_dir):
    """Neighbouring reads as the mates of a read, each with its best place or unmapped, and what they tell of each other."""
    from lanewise.operators import mapping

    odd = F.col("read_no") % 2 != 0
    pair = lambda df: df.withColumn("mate", F.when(odd, 2).otherwise(1)).withColumn("read_no", F.col("read_no") - F.when(odd, 1).otherwise(0))
    settings = config.Settings(reads="100R,100R", anchor_length=13, report_unmapped=True).resolved()
    states = pair(_states(spark, sf_dir, _whole_reads(spark, sf_dir).withColumn("tile", F.lit(1101))))
    return mapping.sam(states, derive.with_repeats(spark, sf_dir), None, settings).select("read_no", "mate", "flag", "rname", "pos", "rnext", "pnext")


# ---- the whole mapper on the derived reads; beyond SQL, held against brute force in tests ----


def _mapper(spark, sf_dir, mode="ALL", **more):
    from lanewise.operators import index

    reference = derive.with_repeats(spark, sf_dir)
    settings = config.Settings(reads="100R", anchor_length=13, out_mode=mode, lanes=(1, 2), tiles=(1101, 1102, 1103), **more).resolved()
    return reference, index.broadcast(spark, index.build(reference)), settings


def _calls(spark, sf_dir):
    return _whole_reads(spark, sf_dir, "barcode")


_RECORD = ("lane", "tile", "read_no", "mate", "cycle", "sample", "rank", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "seq", "qual")


@query()
def gapped_align(spark, sf_dir):
    """Every place of every read, with mismatches and gaps."""
    from lanewise.operators import mapping

    reference, shared, settings = _mapper(spark, sf_dir)
    states = mapping.read_states(_calls(spark, sf_dir), shared, settings)
    return mapping.sam(states, reference, shared, settings).select(*_RECORD, F.col("tags")["AS"].alias("score"), F.col("tags")["NM"].alias("nm"), F.col("tags")["MD"].alias("md"))


@query()
def window_dedupe(spark, sf_dir):
    """Places that remain when those near a better one of the same strand are passed over."""
    from lanewise.operators import mapping

    reference, shared, settings = _mapper(spark, sf_dir)
    found = mapping.alignments(mapping.read_states(_calls(spark, sf_dir), shared, settings), shared, settings)
    return mapping.records(found, reference, settings).select("read_no", "mate", "gid", "start", "score", "nth", "mapq")


@query()
def mate_flags(spark, sf_dir):
    """Reads 2i and 2i + 1 (windows of a document, or planted ones) as the mates of a read, with flags that tell of the other mate."""
    from lanewise.operators import index, mapping

    reference = derive.with_repeats(spark, sf_dir)
    settings = config.Settings(reads="100R,100R", anchor_length=13, report_unmapped=True).resolved()
    shared = index.broadcast(spark, index.build(reference))
    odd = F.pmod("read_no", F.lit(2)).cast("int")
    pairs = _calls(spark, sf_dir).select("lane", F.lit(1101).alias("tile"), (F.col("read_no") - odd).alias("read_no"), (odd + 1).alias("mate"), "calls")
    return mapping.sam(mapping.read_states(pairs, shared, settings), reference, shared, settings).select("read_no", "mate", "flag", "rname", "pos", "rnext", "pnext", "cigar")


def _live(cycle):
    def run(spark, sf_dir):
        import uuid

        from lanewise.streaming import live

        top = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
        reference, shared, settings = _mapper(spark, sf_dir, "ANYBEST", out_cycles=(50, 100))
        # what a sequencer would write: for each tile and cycle the calls of all its reads, in one order
        files = _tile_cycles(_calls(spark, sf_dir)).select("lane", "tile", "cycle", F.octet_length("calls").cast("long").alias("n"), "calls")
        files.write.parquet(f"{top}/cycles")
        stream = spark.readStream.schema(files.schema).parquet(f"{top}/cycles")
        live.started(live.states_of(stream, shared, settings), f"{top}/states", f"{top}/checkpoint").awaitTermination()
        return live.report(spark, f"{top}/states", cycle, reference, shared, settings).select(*_RECORD)

    return run


QUERIES["live_map_final"] = _live(100)
QUERIES["live_map_cycle50"] = _live(50)


@query()
def sam_sink_roundtrip(spark, sf_dir):
    """Records written as SAM text by sample, read back."""
    import uuid

    from lanewise.operators import mapping
    from lanewise.sources import sam

    top = f"{shared_dir(spark).removeprefix('file://')}/sam-{uuid.uuid4().hex}"
    reference, shared, settings = _mapper(spark, sf_dir)
    calls = _calls(spark, sf_dir)
    routed = demux.routed(calls.select("lane", "tile", "read_no", "barcode"), SAMPLES, ERRORS, True).select("lane", "tile", "read_no", codecs.formatted_barcode(F.col("barcode"), [4, 4]).alias("barcode"), "sample")
    files = sam.write(mapping.sam(mapping.read_states(calls, shared, settings), reference, shared, settings, routed), reference, top)
    back = sam.read_sam(spark, f"file://{top}") if files else spark.createDataFrame([], "qname string, flag int, rname string, pos long, mapq int, cigar string, tags map<string,string>")
    return back.select("qname", "flag", "rname", "pos", "mapq", "cigar", F.map_entries("tags").alias("tags"))
