"""What the operators share: reading tables, cutting lineage, word splitting."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.session import shared_dir

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table of ``sf_dir`` (all without names)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Bytes that a worker is sent at once, about (a longer row goes alone); Spark's 64 MB are held by executor and worker, and results with them.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """What is planned meanwhile sends its workers ``BATCH_BYTES`` at once, or less where the session says so."""
    before = spark.conf.get(_BATCH, None)
    if before and spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) <= BATCH_BYTES:
        yield
        return
    spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Readers of the result never recompute what lies above it, lost executors cost nothing, and
    ids made by monotonically_increasing_id() are frozen. The files go when the process ends.
    """
    return cut_all([df], name)


def cut_all(frames: Iterable[DataFrame], name: str) -> DataFrame:
    """Write frames of one schema (at least one), one after another, as a table in the shared folder and read it back."""
    path = None
    for df in frames:
        path = path or f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
        with _small_batches(df.sparkSession):
            df.write.mode("append").option("compression", "zstd").parquet(path)
        schema = df.schema
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written() -> int:
    """How many tables have been written and not deleted so far; for ``forget``."""
    return len(_written)


def forget(since: int) -> None:
    """Deletes the tables written after the first ``since``, but for the last one, which must not be computed from them any more."""
    for spark, path in _written[since:-1]:
        _delete(spark, path)
    del _written[since:-1]


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass
    _written.clear()


#: Keys that meet their rows by broadcast are at most so many, and have at least so many rows each.
HOT_KEYS, HOT_ROWS = 100_000, 1_000


def hot_keys(rows: DataFrame, on: list[str], counts: DataFrame | None = None) -> DataFrame | None:
    """The keys that have more than one in ``HOT_KEYS`` of all rows (and over ``HOT_ROWS``), so at most ``HOT_KEYS`` of them; None without any.

    counts: the keys with n, how many rows each has, if that is known (keys of a single row may be missing).
    """
    most = max(HOT_ROWS, rows.count() // HOT_KEYS)
    counts = counts if counts is not None else rows.groupBy(*on).agg(F.count("*").alias("n"))
    hot = cut(counts.where(F.col("n") > most).select(*on), "hot")
    return None if hot.isEmpty() else hot


def joined(rows: DataFrame, by_key: DataFrame, on: list[str], how: str = "inner", hot: DataFrame | None | bool = True) -> DataFrame:
    """``rows`` joined with ``by_key``, which has one row per key, without all rows of a hot key in one task.

    Hot keys (``hot_keys`` of rows, if not given) and their rows of ``by_key``, a bounded number, are broadcast; others are shuffled.
    """
    hot = hot_keys(rows, on) if hot is True else hot
    if hot is None:
        return rows.join(by_key, on, how)
    few = F.broadcast(hot)
    heavy = rows.join(few, on, "left_semi").join(F.broadcast(by_key.join(few, on, "left_semi")), on, how)
    return heavy.unionByName(rows.join(few, on, "left_anti").join(by_key, on, how))


#: Columns that the library adds to whole tables begin so; tables have none of their own that do.
OWN = "_lw_"


def _is_scan(df: DataFrame) -> bool:
    """Whether a frame is files, columns and conditions only, whose rows come in one order whenever it is computed."""
    nodes = [df._jdf.queryExecution().analyzed()]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name not in ("Project", "Filter", "SubqueryAlias") and not (name.startswith("Relation") or name == "LogicalRelation"):
            return False
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return True


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """Adds a number of its own to every row, the same whenever it is computed: its place in a table as it is read; anything else is written first."""
    return (df if _is_scan(df) else cut(df, "numbered")).withColumn(name, F.monotonically_increasing_id())


def text_or_empty(df: DataFrame, column: str = "text"):
    return F.coalesce(df[column].cast("string"), F.lit(""))
