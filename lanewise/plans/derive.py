"""Reads, barcodes and reference sequences derived from the tables of prose.

Letters become bases by their place in the alphabet modulo 4. Windows of 100 letters of a document are
reads, benchmark items are reference sequences, barcodes come from a digest of the document's id. Prose seldom
maps with more than perfect matches, so that records have a reference of their own, in which each item is
followed by its first letters again (changed, turned, or as they are and twice), and more reads, cut from the items with
substitutions, gaps, clips and on either strand (``planted``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET, AS_BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
LENGTH = 100

#: The same tables in SQL, to stand before a query; names as of the functions.
SQL = {
    "letters": """letters AS (
        SELECT doc_id, lower(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS w FROM documents WHERE text IS NOT NULL)""",
    "reads": """reads AS (
        SELECT CASE WHEN i < 10000 THEN doc_id * 10000 + i ELSE -(doc_id * 16777216 + i) - 1 END AS read_no, doc_id, i AS window_no, CAST(1 + doc_id % 2 AS INTEGER) AS lane, CAST(1101 + i % 3 AS INTEGER) AS tile, doc_id % 10 <> 0 AS pass,
               translate(substr(w, i * 100 + 1, 100), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq, substr(w, i * 100 + 1, 100) AS w,
               substr(translate(md5(CAST(doc_id AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 8) AS barcode
        FROM (SELECT *, unnest(range(0, CAST(floor(length(w) / 100) AS BIGINT))) AS i FROM letters))""",
    "reference": """reference AS (
        SELECT CAST(item_id AS INTEGER) AS rid, 'item_' || item_id AS name, seq, length(seq) AS length
        FROM (SELECT item_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM benchmark WHERE text IS NOT NULL)
        WHERE length(seq) > 0)""",
    "strands": """strands AS (
        SELECT 2 * rid AS gid, rid, seq, length FROM reference
        UNION ALL SELECT 2 * rid + 1, rid, reverse(translate(seq, 'ACGT', 'TGCA')), length FROM reference)""",
    "calls": """calls AS (
        SELECT read_no, lane, tile, c AS cycle,
               CAST(((ascii(substr(w, c, 1)) * 7 + c) % 41) * 4 + instr('ACGT', substr(seq, c, 1)) - 1 AS INTEGER) AS b
        FROM (SELECT *, CAST(unnest(range(1, 101)) AS INTEGER) AS c FROM reads))""",
    "kmers": """kmers AS (
        SELECT substr(seq, CAST(p + 1 AS BIGINT), 13) AS k, gid, p AS pos
        FROM (SELECT *, unnest(range(0, length - 12)) AS p FROM strands WHERE length >= 13))""",
    "anchors": """anchors AS (
        SELECT read_no, seq, o AS clip, substr(seq, o + 1, 13) AS k FROM (SELECT *, CAST(unnest(range(0, 49, 6)) AS INTEGER) AS o FROM reads))""",
    "placed": """placed AS (
        SELECT a.read_no, k.gid, k.pos - a.clip AS pos, min(a.clip) AS clip, any_value(a.seq) AS seq
        FROM anchors a JOIN kmers k ON a.k = k.k JOIN strands s ON s.gid = k.gid
        WHERE k.pos - a.clip >= 0 AND k.pos - a.clip + 100 <= s.length GROUP BY 1, 2, 3)""",
    "scored": """scored AS (
        SELECT p.read_no, p.gid, p.pos, p.clip, m AS mismatches,
               CAST(trunc(CASE WHEN p.clip > 0 THEN -(6.0 + p.clip * (6.0 / 13)) ELSE 0 END) AS INTEGER) - 6 * m AS score
        FROM (SELECT p.*, CAST(hamming(substr(p.seq, p.clip + 1), substr(s.seq, CAST(p.pos + p.clip + 1 AS BIGINT), 100 - p.clip)) AS INTEGER) AS m FROM placed p JOIN strands s ON s.gid = p.gid) p
        WHERE CAST(trunc(CASE WHEN p.clip > 0 THEN -(6.0 + p.clip * (6.0 / 13)) ELSE 0 END) AS INTEGER) - 6 * m >= -20)""",
}
_NEEDS = {"letters": (), "reads": ("letters",), "reference": (), "strands": ("reference",), "calls": ("reads",), "kmers": ("strands",), "anchors": ("reads",), "placed": ("anchors", "kmers", "strands"), "scored": ("placed", "strands")}

#: The letters of an item that stand behind it again, and the step between the places that reads are cut from.
AGAIN, STEP, FIRST_PLANTED = 130, 7, 1 << 60
#: How planted reads differ from the item, in SQL that Spark and DuckDB share. x: 103 letters of the item; spot, n: places by a sum of the read's numbers.
_OTHER = "translate({}, 'ACGT', 'CGTA')"
_CHANGED = f"concat(substr(x, 1, spot - 1), {_OTHER.format('substr(x, spot, 1)')}, substr(x, spot + 1))"
_VARIANTS = (
    "substr(x, 1, 100)",
    f"substr({_CHANGED}, 1, 100)",
    f"concat(substr({_CHANGED}, 1, spot + n), {_OTHER.format('substr(x, spot + n + 1, 1)')}, substr(x, spot + n + 2, 100 - spot - n - 1))",
    f"reverse(translate(substr({_CHANGED}, 1, 100), 'ACGT', 'TGCA'))",
    f"concat({_OTHER.format('substr(x, 1, 5 + n)')}, substr(x, 6 + n, 95 - n))",
    "concat(substr(x, 1, spot), substr(x, spot + 2 + n % 2, 100 - spot))",
    f"concat(substr(x, 1, spot), {_OTHER.format('substr(x, spot, 1)')}, substr(x, spot + 1, 99 - spot))",
    f"concat(substr(x, 1, 99), {_OTHER.format('substr(x, 100, 1)')})",
)
_VARIANT = "CASE v " + " ".join(f"WHEN {v} THEN {text}" for v, text in enumerate(_VARIANTS)) + " END"
_REPEAT = f"""CASE rid % 3 WHEN 0 THEN concat(substr(seq, 1, 49), {_OTHER.format('substr(seq, 50, 1)')}, substr(seq, 51, {AGAIN - 50}))
    WHEN 1 THEN reverse(translate(substr(seq, 1, {AGAIN}), 'ACGT', 'TGCA')) ELSE concat(substr(seq, 1, {AGAIN}), substr(seq, 1, {AGAIN})) END"""

#: In place of reads and reference: with planted reads, and with repeats.
SQL_PLANTED = {
    "items": SQL["reference"].replace("reference AS", "items AS"),
    "reference": f"""reference AS (SELECT rid, name, seq, length(seq) AS length FROM (SELECT rid, name, concat(seq, {_REPEAT}) AS seq FROM items))""",
    "windows": SQL["reads"].replace("reads AS", "windows AS"),
    "planted": f"""planted AS (
        SELECT {FIRST_PLANTED} + rid * 1000000 + p * 10 + v AS read_no, rid, v, p, {_VARIANT} AS seq FROM (
            SELECT rid, p, v, substr(seq, CAST(p + 1 AS BIGINT), 103) AS x, CAST(20 + (rid * 31 + p * 17 + v * 101) % 60 AS INTEGER) AS spot, CAST((rid * 13 + p * 5 + v) % 18 AS INTEGER) AS n
            FROM (SELECT *, unnest(range(0, 8)) AS v FROM (SELECT rid, seq, unnest(range(0, length - 102, {STEP})) AS p FROM items WHERE length >= 103))))""",
    "reads": """reads AS (
        SELECT read_no, doc_id, window_no, lane, tile, pass, seq, w, barcode FROM windows UNION ALL
        SELECT read_no, CAST(rid AS BIGINT), p, CAST(1 + rid % 2 AS INTEGER), CAST(1101 + v % 3 AS INTEGER), true, seq, translate(seq, 'ACGT', 'abcd'),
               substr(translate(md5(CAST(rid AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 8) FROM planted)""",
}
_NEEDS_PLANTED = _NEEDS | {"items": (), "reference": ("items",), "windows": ("letters",), "planted": ("items",), "reads": ("windows", "planted")}


def with_tables(*names: str, planted: bool = False) -> str:
    """The WITH clause for these tables and those below them."""
    order: list[str] = []
    sql, needs = (SQL | SQL_PLANTED, _NEEDS_PLANTED) if planted else (SQL, _NEEDS)

    def add(name: str) -> None:
        for below in needs[name]:
            add(below)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(sql[n] for n in order) + "\n"


def as_letters(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^A-Za-z]", ""))


def as_bases(letters: Column) -> Column:
    return F.translate(letters, ALPHABET, AS_BASES)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_no, doc_id, window_no, lane, tile, pass, seq, w (the letters), barcode."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", as_letters(F.col("text")).alias("w"))
    # one pass over a text, however long
    cut = docs.select("doc_id", F.posexplode(F.regexp_extract_all("w", F.lit(f"[a-z]{{{LENGTH}}}"), F.lit(0))).alias("i", "window"))
    window = F.col("window")
    return cut.select(
        # windows from the ten-thousandth on have numbers of their own, below zero
        F.when(F.col("i") < 10000, F.col("doc_id") * 10000 + F.col("i")).otherwise(-(F.col("doc_id") * 16777216 + F.col("i")) - 1).alias("read_no"),
        "doc_id",
        F.col("i").cast("long").alias("window_no"),
        (1 + F.col("doc_id") % 2).cast("int").alias("lane"),
        (1101 + F.col("i") % 3).cast("int").alias("tile"),
        (F.col("doc_id") % 10 != 0).alias("pass"),
        as_bases(window).alias("seq"),
        window.alias("w"),
        barcode_of(F.col("doc_id")).alias("barcode"),
    )


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that are cut from items and changed, in the form of ``reads``."""
    at = items(spark, sf_dir).where("length >= 103").select("rid", "seq", F.explode(F.expr(f"sequence(0, CAST(length - 103 AS INT), {STEP})")).alias("p"))
    cut = at.select("rid", "p", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("v"), F.expr("substr(seq, p + 1, 103)").alias("x"))
    placed = cut.withColumn("spot", F.expr("20 + (rid * 31 + p * 17 + v * 101) % 60")).withColumn("n", F.expr("(rid * 13 + p * 5 + v) % 18")).withColumn("seq", F.expr(_VARIANT))
    number = F.lit(FIRST_PLANTED) + F.col("rid").cast("long") * 1000000 + F.col("p") * 10 + F.col("v")
    return placed.select(
        number.alias("read_no"), F.col("rid").cast("long").alias("doc_id"), F.col("p").cast("long").alias("window_no"), (1 + F.col("rid") % 2).alias("lane"), (1101 + F.col("v") % 3).alias("tile"),
        F.lit(True).alias("pass"), "seq", F.translate("seq", "ACGT", "abcd").alias("w"), barcode_of(F.col("rid")).alias("barcode"),
    )


def all_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads of all documents and the planted ones."""
    return reads(spark, sf_dir).unionByName(planted(spark, sf_dir))


def barcode_of(doc_id: Column) -> Column:
    return F.substring(F.translate(F.md5(doc_id.cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, 8)


def calls(letters: Column) -> Column:
    """Base calls of a read, as bytes; the quality goes by the letter and its place, and is sometimes 0, which makes an N."""

    def at(c: int) -> Column:
        codes = [((ord(x) * 7 + c) % 41) * 4 + "ACGT".index(b) for x, b in zip(ALPHABET, AS_BASES, strict=True)]
        return F.translate(F.substring(letters, c, 1), ALPHABET, "".join(chr(b or 255) for b in codes))  # to zero means to drop; no call is 255

    return F.encode(F.replace(F.concat(*map(at, range(1, LENGTH + 1))), F.lit(chr(255)), F.char(F.lit(0))), "ISO-8859-1")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, name, seq, length of the benchmark's items as sequences."""
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("text is not null").select(F.col("item_id").cast("int").alias("rid"), F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("name"), as_bases(as_letters(F.col("text"))).alias("seq"))
    return rows.withColumn("length", F.length("seq").cast("long")).where("length > 0")


reference = items


def with_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items, each with its first letters again behind it."""
    more = items(spark, sf_dir).select("rid", "name", F.expr(f"concat(seq, {_REPEAT})").alias("seq"))
    return more.withColumn("length", F.length("seq").cast("long"))
