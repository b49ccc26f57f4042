"""Every query with SQL gives the same rows as that SQL in DuckDB, on small tables made here."""

import glob
import os
import random

import pytest

import __spark_entry__
from lanewise.plans import catalogue

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew potions from old books".split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Benchmark passages, and documents that hold pieces of them, some with a letter changed."""
    top, rng = tmp_path_factory.mktemp("tables"), random.Random(3)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", ", ", "é", ".\n"]) for _ in range(n))
    items = [(i, prose(60)) for i in range(12)] + [(12, None), (13, "1 2 3")]
    docs = []
    for i in range(60):
        letters = "".join(c for c in items[i % 12][1] if c.isascii() and c.isalpha()).lower()
        piece = letters[i % 9 : i % 9 + 150]
        if i % 3 == 1:
            piece = piece[:30] + "zq" + piece[32:]
        docs.append((i, piece + prose(30) if i % 2 else prose(20) + piece, "en", "s", 1))
    docs += [(60, None, None, None, 0), (61, "", "en", "s", 0), (62, "é 123", "en", "s", 0)]
    events = [(i, i % 13, ("click", "view", "buy")[i % 3]) for i in range(100)]
    for name, rows, schema in (("benchmark", items, "item_id long, text string"), ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("events", events, "event_id long, user_id long, event_type string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{top}/{name}.parquet")
    return str(top)


@pytest.fixture(scope="module")
def duck(tables):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{tables}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}/*.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_is_its_sql(spark, tables, duck, name):
    df = catalogue.QUERIES[name](spark, tables)
    columns = sorted(df.columns)
    found = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
    got = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    assert got == expected and got


@pytest.mark.parametrize("name", ["gapped_align", "window_dedupe", "mate_flags", "live_map_final", "live_map_cycle50", "sam_sink_roundtrip"])
def test_mapper_queries_find_planted_reads(spark, tables, name):
    assert catalogue.QUERIES[name](spark, tables).count() > 5


def test_gapped_finds_all_that_ungapped_does(spark, tables):
    from pyspark.sql import functions as F

    best = catalogue.QUERIES["ungapped_extend"](spark, tables).where("clip = 0 and mismatches = 0").select("read_no").distinct()
    passed = catalogue.QUERIES["gapped_align"](spark, tables).where("cigar = '100M'").select("read_no").distinct()
    assert best.where(F.floor(F.col("read_no") / 10000) % 10 != 0).join(passed, "read_no", "left_anti").count() == 0


@pytest.mark.parametrize("name", ["gapped_align", "window_dedupe", "mate_flags", "live_map_final", "live_map_cycle50"])
def test_mapper_queries_take_reads_of_all_documents(spark, tables, name):
    documents = {r["read_no"] // 10000 for r in catalogue.QUERIES[name](spark, tables).select("read_no").collect()}
    assert {d for d in documents if d % 10 == 0}


def test_entry_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and len(catalogue.SQL) >= 38
