"""FASTA as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, keep_spaces: bool = False, trim: bool = False) -> DataFrame:
    """rid, name, seq, length: a row per record, in the order of the file.

    A record begins with ``>`` at the start of a line; others in a header belong to the name. Names have
    underscores for spaces, unless kept; with ``trim`` they end at the first space. A record without letters is
    an error. Letters that aren't A, C, G or T stay; the index takes them for T.
    """
    text = spark.read.text(path, lineSep="\n>").select(F.monotonically_increasing_id().alias("_n"), F.input_file_name().alias("_file"), "value")
    # a file's first record still has its mark
    first = text.select("_n", "_file").groupBy("_file").agg(F.min("_n").alias("_n")).select("_n", F.lit(True).alias("_first"))
    marked = text.join(F.broadcast(first), "_n", "left")  # a row per file
    return parsed(marked.select("_n", F.when(F.col("_first"), F.regexp_replace("value", "^>", "")).otherwise(F.col("value")).alias("value")), keep_spaces, trim)


def parsed(records: DataFrame, keep_spaces: bool = False, trim: bool = False) -> DataFrame:
    """``read`` from a table of _n (in their order) and value, the text of a record behind its ``>``."""
    lines = F.transform(F.split("value", "\n"), lambda x: F.rtrim(F.regexp_replace(x, "\r", "")))
    name = F.get(lines, F.lit(0))
    name = F.regexp_extract(name, "^[^ ]*", 0) if trim else name
    name = name if keep_spaces else F.translate(name, " ", "_")
    seq = F.upper(F.array_join(F.slice(lines, F.lit(2), F.size(lines)), ""))
    rows = records.where("trim(value) <> ''").select("_n", name.alias("name"), _some(seq, name).alias("seq"))
    # the order is found from the numbers alone: no sequence goes to that one task
    order = rows.select("_n", (F.row_number().over(Window.orderBy("_n")) - 1).cast("int").alias("rid"))
    return rows.join(order, "_n").select("rid", "name", "seq", F.length("seq").cast("long").alias("length"))


def _some(seq: Column, name: Column) -> Column:
    return F.when(seq == "", F.raise_error(F.concat(F.lit("a record has no sequence: "), name))).otherwise(seq)
