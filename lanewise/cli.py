"""Command lines: build-index, map (live or what is there), output (records of a kept cycle again), simulate, replay.

    python -m lanewise.cli build-index --input genome.fa --out-prefix index
    python -m lanewise.cli map --bcl-dir BaseCalls --index index --reads 100R,8B,100R [--config run.ini] [--live]
    python -m lanewise.cli output --config out/run.ini --index index --out-cycles 50
    python -m lanewise.cli simulate --fastq reads.fq --root run [--failing 0.1 --noise 100]
    python -m lanewise.cli replay --root run --target BaseCalls --reads 100R,8B,100R --speedup 1000

Options have the names of the settings (config.Settings), with dashes; those of the command line win over the
config file, that over RunInfo, that over the defaults.
"""

from __future__ import annotations

import argparse
import sys
import uuid
from dataclasses import fields, replace
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise import config
from lanewise.functions import codecs
from lanewise.operators import demux, index, mapping, shards
from lanewise.sources import bcl, fasta, sam


def _settings_options(parser: argparse.ArgumentParser) -> None:
    for f in (*fields(config.Settings), *fields(config.Scores)):
        if f.name == "scores":
            continue
        name = "continue" if f.name == "continue_from" else f.name.replace("_", "-")
        if "bool" in str(f.type):
            parser.add_argument(f"--{name}", action="store_true", default=None, dest=f.name)
        else:
            parser.add_argument(f"--{name}", default=None, dest=f.name)
    parser.add_argument("--config")
    parser.add_argument("--runinfo")


def settings_of(args: argparse.Namespace) -> config.Settings:
    """From the layers: command line, config file, RunInfo."""
    known = {f.name for f in (*fields(config.Settings), *fields(config.Scores))} - {"scores"}
    line = {k: v for k, v in vars(args).items() if k in known and v is not None}
    ini = config.read_ini(Path(args.config).read_text()) if args.config else {}
    info = config.read_run_info(Path(args.runinfo).read_text()) if args.runinfo else {}
    for name in config.WITHOUT_EFFECT:
        if name in line:
            print(f"--{name.replace('_', '-')} has no effect here", file=sys.stderr)
    merged = config.merged(line, ini, info)
    for name in ("bcl_dir", "index"):
        if not getattr(merged, name):
            raise config.SettingError(f"--{name.replace('_', '-')} is needed")
    return merged


def shared_folders(spark: SparkSession, settings: config.Settings) -> config.Settings:
    """The settings, if their folders can be shared: on a cluster a relative path is each machine's own."""
    if not spark.sparkContext.master.startswith("local"):
        for name in ("temp_dir", "out_dir"):
            if not getattr(settings, name).startswith("/") and "://" not in getattr(settings, name):
                raise config.SettingError(f"--{name.replace('_', '-')} must name a folder that driver and executors share")
    return settings


def build_index(spark: SparkSession, source: str, out: str, keep_spaces: bool, trim: bool) -> int:
    """Writes the reference as a table, and its index beside it if one index can hold it; returns both strands' size."""
    fasta.read(spark, source, keep_spaces, trim).write.mode("overwrite").parquet(out)
    reference = spark.read.parquet(out)
    size = index.genome_size(reference)
    if size <= 2 * shards.SHARD_BASES:
        index.save(spark, index.build(reference), f"{out}.arrays")
    return size


def index_of(spark: SparkSession, path: str, reference: DataFrame):
    """The broadcast index: the stored one, or made again where there is none; None for a reference that needs several."""
    if index.genome_size(reference) > 2 * shards.SHARD_BASES:
        return None
    try:
        return index.broadcast(spark, index.load(spark, f"{path}.arrays"))
    except AnalysisException:  # built without
        return index.broadcast(spark, index.build(reference))


def map_run(spark: SparkSession, merged: config.Settings, live_: bool) -> list[str]:
    """Maps a run; with ``live_`` until it is stopped, else what is there. Returns the files of all output cycles."""
    from lanewise.streaming import live

    reference = spark.read.parquet(merged.index)
    settings = shared_folders(spark, replace(merged, genome_size=index.genome_size(reference)).resolved())
    out = Path(settings.out_dir)
    out.mkdir(parents=True, exist_ok=True)
    (out / "run.ini").write_text(config.write_ini(settings))
    shared = index_of(spark, merged.index, reference)
    if shared is None:
        if live_:
            raise index.TooLarge("a reference of several shards is mapped when the run is there, not live")
        return map_shards(spark, settings, reference)
    if live_:
        bcl.await_lanes(settings.bcl_dir, settings.lanes)
        spark.streams.addListener(live.Progress())
    query = live.run(spark, settings.bcl_dir, shared, settings, f"{settings.temp_dir}/states", f"{settings.temp_dir}/checkpoint", available_now=not live_)
    query.awaitTermination()
    return output(spark, settings, reference, shared)


def map_shards(spark: SparkSession, settings: config.Settings, reference: DataFrame) -> list[str]:
    """Records of whole reads against a reference of several shards."""
    reads = bcl.reads(spark, settings.bcl_dir, settings.segments).where(F.col("lane").isin(list(settings.lanes)) & F.col("tile").isin(list(settings.tiles)))
    failed = bcl.filters(spark, settings.bcl_dir).where(~F.col("pass")).select("lane", "tile", "read_no")
    reads = reads.join(failed, ["lane", "tile", "read_no"], "left_anti")
    codes = reads.where("mate = 0").groupBy("lane", "tile", "read_no").agg(F.array_sort(F.collect_list(F.struct("seg_id", "calls"))).alias("x"))  # of one read
    codes = reads.select("lane", "tile", "read_no").distinct().join(codes, ["lane", "tile", "read_no"], "left")
    barcode = F.coalesce(codecs.read_bases(F.expr("aggregate(x, X'', (a, b) -> concat(a, b.calls))")), F.lit(""))
    routed = demux.for_settings(codes.select("lane", "tile", "read_no", barcode.alias("barcode")), settings)
    states = shards.read_states(reads.where("mate > 0"), reference, settings)
    records = mapping.sam(states, reference, None, settings, routed).withColumn("cycle", F.lit(settings.total_cycles))
    return _written(spark, records, reference, settings)


def _written(spark: SparkSession, records: DataFrame, reference: DataFrame, settings: config.Settings) -> list[str]:
    """Writes records once as a table, then as files of bounded parts."""
    path = f"{settings.temp_dir}/records-{uuid.uuid4().hex}"
    records.write.parquet(path)
    return sam.write(spark.read.parquet(path), reference, settings.out_dir, settings.out_format)


def output(spark: SparkSession, settings: config.Settings, reference, shared) -> list[str]:
    """Records of the output cycles; a cycle that wasn't kept is named and the others are still written."""
    from lanewise.streaming import live

    files = []
    for cycle in settings.out_cycles:
        try:
            records = live.report(spark, f"{settings.temp_dir}/states", cycle, reference, shared, settings, bcl.filters(spark, settings.bcl_dir))
        except ValueError as e:
            print(e)
            continue
        files += _written(spark, records, reference, settings)
    return files


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lanewise", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build-index")
    build.add_argument("--input", required=True)
    build.add_argument("--out-prefix", required=True)
    build.add_argument("--do-not-convert-spaces", action="store_true")
    build.add_argument("--trim-after-space", action="store_true")
    for name in ("map", "output"):
        sub = commands.add_parser(name)
        _settings_options(sub)
        if name == "map":
            sub.add_argument("--live", action="store_true")
    make = commands.add_parser("simulate")
    make.add_argument("--fastq", required=True)
    make.add_argument("--root", required=True)
    make.add_argument("--lane", type=int, default=1)
    make.add_argument("--tiles", default="1101")
    make.add_argument("--failing", type=float, default=0.0, help="share of reads that the filter fails")
    make.add_argument("--noise", type=int, default=0, help="reads of random bases mixed in")
    make.add_argument("--seed", type=int, default=0)
    again = commands.add_parser("replay", help="copies a run cycle by cycle at the pace of a machine")
    again.add_argument("--root", required=True)
    again.add_argument("--target", required=True)
    again.add_argument("--reads", required=True)
    again.add_argument("--machine", default=next(iter(bcl.MACHINES)), choices=list(bcl.MACHINES))
    again.add_argument("--speedup", type=float, default=1.0)
    args = parser.parse_args(argv)
    if args.command == "simulate":
        print(bcl.fastq_to_run(Path(args.fastq).read_text(), args.root, args.lane, config.parse_numbers(args.tiles), args.failing, args.noise, args.seed))
        return
    if args.command == "replay":
        pace = bcl.delays([s.length for s in config.parse_reads(args.reads)], args.machine, args.speedup)
        bcl.replayed(args.root, args.target, lambda cycle: pace[cycle - 1])
        return
    spark = SparkSession.builder.appName("lanewise").getOrCreate()
    if args.command == "build-index":
        print(build_index(spark, args.input, args.out_prefix, args.do_not_convert_spaces, args.trim_after_space))
        return
    merged = settings_of(args)
    if args.command == "map":
        print(*map_run(spark, merged, args.live), sep="\n")
    else:
        reference = spark.read.parquet(merged.index)
        settings = shared_folders(spark, replace(merged, genome_size=index.genome_size(reference)).resolved())
        print(*output(spark, settings, reference, index_of(spark, merged.index, reference)), sep="\n")


if __name__ == "__main__":
    main()
