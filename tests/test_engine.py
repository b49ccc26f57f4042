"""Settings, codecs, scores, the kernel against brute force, files, and batch against stream."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise import config
from lanewise.config import Settings
from lanewise.functions import codecs, scoring
from lanewise.functions.scoring import CIGAR, DELETION, INSERTION, MATCH, MISMATCH
from lanewise.operators import demux, index, kernel, mapping, shards
from lanewise.sources import bcl, fasta, sam
from lanewise.streaming import live

# ---- settings ----


def test_defaults_depend_on_the_mode():
    found = [(s.anchor_length, s.min_as) for s in (Settings(align_mode=m).resolved() for m in config.ALIGN_MODES)]
    assert found == [(16, -12), (14, -16), (13, -20), (11, -24), (9, -28)]


def test_parsers():
    assert [(s.mate, s.length, s.start_cycle) for s in config.parse_reads("100R,4B,4B,100R")] == [(1, 100, 1), (0, 4, 101), (0, 4, 105), (2, 100, 109)]
    assert config.parse_mode("N5") == ("BESTN", 5) and config.parse_mode("H") == ("ALLBEST", 0)
    assert [config.parse_align_mode(x) for x in ("very-fast", "VA", "b")] == ["very-fast", "very-accurate", "balanced"]
    assert config.parse_size("64M") == 64 << 20 and config.parse_numbers("3;1,x 3") == (1, 3)
    for bad in (lambda: config.parse_reads("10X"), lambda: config.parse_mode("best"), lambda: config.parse_format("CRAM"), lambda: config.parse_barcodes("ACX", config.parse_reads("3B"))):
        with pytest.raises(config.SettingError):
            bad()


def test_what_is_missing_is_refused():
    for more in ({"md_style": "sam"}, {"keep_invalid_sequences": True}):
        with pytest.raises(config.SettingError):
            Settings(reads="50R", **more).resolved()


def test_ini_and_priorities():
    s = Settings(reads="50R", out_cycles=(20, 99)).resolved()
    assert s.out_cycles == (20, 50)
    assert config.merged(config.read_ini(config.write_ini(s))).resolved() == s
    assert config.merged({"reads": "10R"}, {"reads": "20R", "report-unmapped": "true"}, {"report-unmapped": False}).report_unmapped
    info = config.read_run_info('<RunInfo><Run Id="r1"><Flowcell>f</Flowcell><Instrument>i</Instrument><Reads><Read Number="1" NumCycles="10" IsIndexedRead="N"/><Read Number="2" NumCycles="4" IsIndexedRead="Y"/></Reads><FlowcellLayout LaneCount="2" SurfaceCount="1" SwathCount="2" TileCount="3"/></Run></RunInfo>')
    assert (info["reads"], info["lanes"], info["tiles"]) == ("10R,4B", (1, 2), (1101, 1102, 1103, 1201, 1202, 1203))


# ---- column functions ----


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_decoding(spark):
    calls = F.array(*map(F.lit, (0x7A, 0x00, 0xA3)))
    assert one(spark, codecs.bases_of(calls)) == "GNT" and one(spark, codecs.qualities_of(calls)) == "?!I"
    assert one(spark, codecs.reverse_complement(F.lit("acgtn"))) == "NACGT"
    assert one(spark, codecs.reverse_md(F.lit("10A5CG3"))) == "3CG5T10"
    assert one(spark, codecs.formatted_barcode(F.lit("ACGTAC"), [4, 4])) == "ACGT-AC"
    assert codecs.register(spark) and spark.sql("SELECT lw_base(122) b, lw_reverse_complement('AAC') r, lw_mate_cycle(120, 109, 100) m").first() == ("G", "GTT", 12)


def cigar(spec):
    return F.lit(None).cast(CIGAR) if spec is None else F.array(*[F.struct(F.lit(n).alias("len"), F.lit(op).alias("op")) for n, op in spec])


def test_golden_scores(spark):
    s = Settings(anchor_length=13).resolved()
    cases = {((100, 0),): 0, ((50, 0), (1, 1), (49, 0)): -6, ((99, 0), (1, 1)): -6, ((6, 1), (94, 0)): -8, ((12, 1), (88, 0)): -11, ((40, 0), (2, 3), (60, 0)): -11, ((40, 0), (1, 2), (59, 0)): -8, ((40, 0), (1, 1), (58, 0), (1, 1)): -12}
    assert {k: one(spark, scoring.alignment_score(cigar(k), s)) for k in cases} == cases
    thresholds = [scoring.threshold(c, 100, s) for c in (5, 13, 14, 19, 20, 26, 31, 32, 100)]
    assert thresholds == [-20, 0, -6, -6, -12, -18, -18, -20, -20]
    assert one(spark, scoring.cigar_string(cigar([(6, 1), (10, 0), (1, 1), (3, 0), (2, 3), (4, 0), (1, 2), (5, 0)]))) == "6S14M2D4M1I5M"
    assert one(spark, scoring.cigar_string(cigar([(10, 0), (1, 1), (3, 0)]), True)) == "10M1X3M"
    assert one(spark, scoring.md_string(cigar([(6, 1), (10, 0), (1, 1), (3, 0), (2, 3), (4, 0)]), F.lit("CGT"))) == "10C3GT4"
    assert one(spark, scoring.edit_distance(cigar([(1, 1), (10, 0), (1, 1), (2, 3), (3, 2)]))) == 6


@pytest.mark.parametrize("seeds, expected", [([(0, 1)], [42]), ([(0, 2)], [3]), ([(0, 3)], [2]), ([(0, 4)], [1]), ([(0, 1), (-6, 1)], [20, 0]), ([(-6, 1)], [42]), ([(-12, 1)], [41]), ([(-18, 1)], [26]), ([(-20, 1)], [20])])
def test_golden_mapq(spark, seeds, expected):
    s = Settings(anchor_length=13).resolved()
    best, total = seeds[0][0], sum(n * 0.01 ** ((seeds[0][0] - a) / 6) for a, n in seeds)
    unique = len(seeds) == 1 and seeds[0][1] == 1
    assert [one(spark, scoring.mapq(F.lit(a), F.lit(best), F.lit(total), F.lit(unique), F.lit(100), 100, s)) for a, _ in seeds] == expected


# ---- kernel ----


def brute_states(contigs, calls, s, length):
    """Seeds after each cycle, on explicit sets of places (strand, end) instead of an index."""
    flip = str.maketrans("ACGT", "TGCA")
    texts = {}
    for i, c in enumerate(contigs):
        texts[2 * i], texts[2 * i + 1] = c, c.translate(flip)[::-1]
    c, k = s.scores, s.anchor_length
    step = lambda at, y: frozenset((g, e + 1) for g, e in at if e < len(texts[g]) and texts[g][e] == y)
    add = lambda cg, op: (*cg[:-1], (cg[-1][0] + 1, op)) if cg[-1][1] == op else (*cg, (1, op))
    seeds, read = [], ""
    for cycle, call in enumerate(calls, 1):
        x = "ACGT"[call & 3]
        read += x
        least = scoring.threshold(cycle, length, s)
        if cycle < k:
            continue
        new = []
        for at, most, cg, bases in seeds:
            last, matched = cg[-1][1], step(at, x)
            if matched and most >= least:
                new.append((matched, most, add(cg, MATCH), bases))
            if len(matched) == len(at):
                continue
            gaps = cycle != length and c.max_gap > 0
            worse = most - c.insertion_extend - c.match - (0 if last == INSERTION else c.insertion_open)
            if gaps and last != DELETION and not (last == INSERTION and cg[-1][0] >= c.max_gap) and worse >= least:
                new.append((at, worse, add(cg, INSERTION), bases))
            for y in "ACGT".replace(x, ""):
                there = step(at, y)
                if not there:
                    continue
                if last not in (INSERTION, DELETION) and most - c.mismatch - c.match >= least:
                    new.append((there, most - c.mismatch - c.match, add(cg, MISMATCH), bases + y))
                gap = most - c.deletion_open - c.deletion_extend
                if gaps and last != INSERTION and gap >= least:

                    def deeper(there, gap, n, text):
                        if gap < s.min_as:
                            return
                        closed = step(there, x)
                        if closed:
                            new.append((closed, gap, (*cg, (n, DELETION), (1, MATCH)), text))
                        if n < c.max_gap and gap - c.deletion_extend >= least:
                            for z in "ACGT".replace(x, ""):
                                if step(there, z):
                                    deeper(step(there, z), gap - c.deletion_extend, n + 1, text + z)

                    deeper(there, gap, 1, bases + y)
        past = cycle - k
        if past <= s.max_softclip_length and past % s.seeding_interval == 0:
            most = (length - past) * c.match - -(-past // k) * c.least_penalty
            at = frozenset((g, e) for g, t in texts.items() for e in range(k, len(t) + 1) if t[e - k : e] == read[past:])
            if most >= least and at:
                new.append((at, most, (*(((past, MISMATCH),) if past else ()), (k, MATCH)), ""))
        clip = lambda cg: cg[0][0] if cg[0][1] == MISMATCH else 0
        kept = {}
        for seed in sorted(new, key=lambda q: (clip(q[2]), -q[1], q[2], q[3])):
            kept.setdefault(seed[0], seed)
        seeds = list(kept.values())
        yield cycle, seeds
    return


def edited(rng, read, n):
    for _ in range(n):
        i, kind = rng.randrange(3, len(read) - 3), rng.choice("XDI")
        read = read[:i] + {"X": rng.choice("ACGT") + read[i + 1 :], "D": read[i + 1 :], "I": rng.choice("ACGT") + read[i:]}[kind]
    return read


def test_kernel_is_brute_force():
    rng = random.Random(4)
    checked = 0
    for _ in range(60):
        contigs = ["".join(rng.choice("ACGT"[: rng.choice((2, 4))]) for _ in range(rng.randrange(30, 90))) for _ in range(rng.randrange(1, 3))]
        contigs[0] += contigs[0][5:25]
        s = Settings(reads="30R", anchor_length=5, min_as=-14, error_interval=rng.choice((2, 3)), seeding_interval=rng.choice((1, 2, 3))).resolved()
        idx = index.Index(contigs=[(str(i), c) for i, c in enumerate(contigs)])
        source = rng.choice(contigs)
        at = rng.randrange(0, max(1, len(source) - 34))
        read = (edited(rng, source[at : at + 34], rng.randrange(0, 3)) + "ACGTAC" * 5)[:30]
        calls = bytes(40 << 2 | "ACGT".index(b) for b in read)
        rules, state = kernel.Rules(idx, s, 30), kernel.Read()
        expected = dict(brute_states(contigs, calls, s, 30))
        for cycle, call in enumerate(calls, 1):
            state.take(call, rules)
            mine = {(frozenset((g, int(idx.lengths[g // 2]) - p) for g, p in idx.places(x.low, x.high)), x.most, x.cigar, x.bases) for x in state.seeds}
            assert mine == set(expected.get(cycle, [])), (contigs, read, cycle)
            checked += len(mine)
        assert kernel.folded(calls, rules).seeds == state.seeds
    assert checked > 2000


def test_suffix_array():
    rng = random.Random(1)
    text = bytes(rng.choice(b"\x01\x02\x03\x04\x00") for _ in range(300))
    import numpy as np

    assert index.suffix_array(np.frombuffer(text, np.uint8)).tolist() == sorted(range(300), key=lambda i: text[i:])


# ---- a run, in batch and as a stream ----

BARCODES = [("ACAG", "TCGA")] * 15 + [("ACGG", "TGGA")] * 5


@pytest.fixture(scope="module")
def genome():
    rng = random.Random(7)
    return "".join(rng.choice("ACGT") for _ in range(2000))


@pytest.fixture(scope="module")
def run_rows(genome):
    """Reads of both mates planted in the genome, with their barcodes, as base calls of whole runs."""
    rng, flip, rows = random.Random(8), str.maketrans("ACGT", "TGCA"), []
    for parts in BARCODES:
        at = rng.randrange(0, 1700)
        first, second = genome[at : at + 40], genome[at + 200 : at + 240].translate(flip)[::-1]
        rows.append(b"".join(bcl.calls_of(x, "I" * len(x)) for x in (first, *parts, second)))
    return rows


def settings(**more):
    return Settings(reads="40R,4B,4B,40R", genome_size=4000, anchor_length=10, out_mode="ANYBEST", lanes=(1,), tiles=(1101,), **more).resolved()


@pytest.fixture(scope="module")
def reference(spark, genome, tmp_path_factory):
    path = tmp_path_factory.mktemp("fasta") / "g.fa"
    path.write_text(f">chr one\r\n{genome[:1000]}\r\n{genome[1000:]}\n>two x\n\n{genome[::-1][:300]}\n")
    return fasta.read(spark, str(path)).cache()


def test_fasta(reference, genome):
    assert [(r["rid"], r["name"], r["length"]) for r in reference.orderBy("rid").collect()] == [(0, "chr_one", 2000), (1, "two_x", 300)]
    assert reference.where("rid = 0").first()["seq"] == genome


def test_bcl_round_trip(spark, tmp_path, run_rows):
    root = str(tmp_path / "run")
    bcl.write_run(root, 1, 1101, run_rows)
    bcl.write_filter(root, 1, 1101, [i % 3 > 0 for i in range(len(run_rows))])
    reads = {(r["mate"], r["seg_id"], r["read_no"]): bytes(r["calls"]) for r in bcl.reads(spark, root, settings().segments).collect()}
    assert reads[1, 0, 3] == run_rows[3][:40] and reads[2, 3, 7] == run_rows[7][48:] and reads[0, 1, 0] == run_rows[0][40:44]
    calls = bcl.basecalls(spark, root).where("cycle = 5 and read_no = 2").first()
    assert calls["b"] == run_rows[2][4]
    assert [r["pass"] for r in bcl.filters(spark, root).orderBy("read_no").collect()] == [i % 3 > 0 for i in range(len(run_rows))]


def streamed(spark, tmp_path, reference, rows, batches, s):
    """Packed states after the cycles came in the given batches, with a new start for each."""
    root, out, check = str(tmp_path / "run"), str(tmp_path / "out"), str(tmp_path / "check")
    import os

    os.makedirs(root)
    shared = index.broadcast(spark, index.build(reference))
    for cycles in batches:
        for c in cycles:
            bcl.write_cycle(root, 1, 1101, c, bytes(r[c - 1] for r in rows))
        live.run(spark, root, shared, s, out, check, buckets=2).awaitTermination()
    return out, shared


def test_stream_is_batch_and_demultiplexes(spark, tmp_path, reference, run_rows):
    s = settings(out_cycles=(30, 88), barcodes="ACAG-TCGA,ACGG-TGGA", barcode_errors="0")
    order = [[c for c in range(1, 89) if c % 2], [c for c in range(1, 60) if c % 2 == 0], list(range(60, 89, 2))]
    out, shared = streamed(spark, tmp_path, reference, run_rows, order, s)
    columns = ["read_no", "mate", "flag", "rname", "pos", "cigar", "mapq", "rnext", "pnext"]
    stream = sorted(map(tuple, live.report(spark, out, 88, reference, shared, s).select(*columns).collect()))
    reads = spark.createDataFrame([(1, 1101, i, m, bytearray(row[a : a + 40])) for i, row in enumerate(run_rows) for m, a in ((1, 0), (2, 48))], "lane int, tile int, read_no long, mate int, calls binary")
    batch = sorted(map(tuple, mapping.sam(mapping.read_states(reads, shared, s), reference, shared, s).select(*columns).collect()))
    assert stream == batch and len(batch) == 2 * len(BARCODES)
    assert {r[5] for r in batch} == {"40M"} and {r[2] for r in batch if r[1] == 1} == {1 | 64 | 32}
    report = lambda **more: {r["sample"]: r["count"] for r in live.report(spark, out, 88, reference, shared, settings(**more)).groupBy("sample").count().collect()}
    assert report(barcodes="ACAG-TCGA", align_undetermined_barcodes=True) == {"ACAG-TCGA": 40}
    assert report(barcodes="ACAG-TCGA", barcode_errors="0", align_undetermined_barcodes=True) == {"ACAG-TCGA": 30, "undetermined": 10}
    assert report(barcodes="ACAG-TCGA", barcode_errors="0,1") == {"ACAG-TCGA": 30}
    assert report(barcodes="ACAG-TCGA,ACGG-TGGA") == {"ACAG-TCGA": 40}
    assert report(barcodes="ACAG-TCGA,ACGG-TGGA", barcode_errors="0") == {"ACAG-TCGA": 30, "ACGG-TGGA": 10}
    early = live.report(spark, out, 30, reference, shared, settings())
    assert early.count() == len(BARCODES) and {r["cigar"] for r in early.collect()} == {"30M"}
    passed = spark.createDataFrame([(1, 1101, i, i > 3) for i in range(10)], "lane int, tile int, read_no long, pass boolean")
    assert live.report(spark, out, 88, reference, shared, settings(), passed).count() == 2 * (len(BARCODES) - 4)
    with pytest.raises(ValueError, match="75"):
        live.report(spark, out, 75, reference, shared, s)


def test_sam_and_bam_hold_the_same(spark, tmp_path, reference, run_rows):
    s = settings(out_format="SAM")
    shared = index.broadcast(spark, index.build(reference))
    reads = spark.createDataFrame([(1, 1101, i, m, bytearray(row[a : a + 40])) for i, row in enumerate(run_rows) for m, a in ((1, 0), (2, 48))], "lane int, tile int, read_no long, mate int, calls binary")
    records = mapping.sam(mapping.read_states(reads, shared, s), reference, shared, s).cache()
    text, binary = (sam.write(records, reference, str(tmp_path), form) for form in ("SAM", "BAM"))
    assert [f.rsplit("/", 1)[1] for f in text + binary] == ["lanewise_cycle40_all.sam", "lanewise_cycle40_all.bam"]
    head, contigs, rows = sam.read_bam(binary[0])
    assert contigs == [("chr_one", 2000), ("two_x", 300)] and head.startswith("@HD\tVN:1.5")
    back = [{**r.asDict(), "tags": dict(r["tags"])} for r in sam.read_sam(spark, text[0]).collect()]
    key = lambda r: (r["qname"], r["flag"])
    assert sorted(back, key=key) == sorted(rows, key=key) and len(rows) == 2 * len(BARCODES)


def test_modes_and_unmapped(spark, reference, genome):
    repeat = genome[100:140]
    ref = spark.createDataFrame([(0, "a", repeat + "ACGTTGCA" * 4 + repeat, 112)], "rid int, name string, seq string, length long")
    shared = index.broadcast(spark, index.build(ref))
    rows = [(1, 1101, 0, 1, bytearray(bcl.calls_of(repeat, "I" * 40))), (1, 1101, 1, 1, bytearray(bcl.calls_of("A" * 40, "I" * 40)))]
    reads = spark.createDataFrame(rows, "lane int, tile int, read_no long, mate int, calls binary")

    def count(mode, **more):
        s = Settings(reads="40R", genome_size=300, anchor_length=10, out_mode=mode, **more).resolved()
        return sorted((r["read_no"], r["flag"], r["pos"], r["mapq"]) for r in mapping.sam(mapping.read_states(reads, shared, s), ref, shared, s).collect())

    assert count("ALL") == [(0, 0, 1, 3), (0, 256, 73, 3)] or count("ALL") == [(0, 0, 73, 3), (0, 256, 1, 3)]
    assert len(count("ANYBEST")) == 1 and len(count("N1")) == 1 and count("UNIQUE") == []
    assert [r for r in count("ANYBEST", report_unmapped=True) if r[0] == 1] == [(1, 4, 0, 0)]


def test_samples_by_first_fit(spark):
    rows = spark.createDataFrame([("ACAGTCGA",), ("ACGGTGGA",), ("AC",), ("",), ("TTTTTTTT",)], "barcode string")
    found = [r["sample"] for r in demux.routed(rows, (("ACAG", "TCGA"), ("ACGG", "TGGA")), (0, 0), True).collect()]
    assert found == ["ACAG-TCGA", "ACGG-TGGA", "ACAG-TCGA", "undetermined", "undetermined"]


def test_fastq_and_replay(spark, tmp_path):
    text = "@r1\nACGTN\n+\nIIII!\n@r2\nTTTTT\n+\n#####\n"
    assert bcl.fastq_to_run(text, str(tmp_path / "a"), 1, (1101, 1102)) == 2
    bcl.replayed(str(tmp_path / "a"), str(tmp_path / "b"))
    rows = {(r["tile"], r["cycle"]): r["b"] for r in bcl.basecalls(spark, str(tmp_path / "b")).collect()}
    assert rows[1101, 2] == 40 << 2 | 1 and rows[1101, 5] == 0 and rows[1102, 1] == 2 << 2 | 3


def test_machine_pace():
    found = bcl.delays([100, 8, 8, 100], "HISEQ_2500_RAPID_DUALBC")
    assert len(found) == 216 and sum(found) == 80881 and found[:2] == [1500, 1] and found[30] == 380
    assert sum(bcl.delays([100, 8, 8, 100], "HISEQ_2500_RAPID_DUALBC", 100)) == pytest.approx(808.81)


# ---- mates, many reads at once, shards, stored indexes, sources ----


def test_many_reads_are_like_one_at_a_time():
    rng = random.Random(21)
    contigs = [("a", "".join(rng.choice("ACG") for _ in range(300))), ("b", "".join(rng.choice("ACGT") for _ in range(200)))]
    idx, s = index.Index(contigs), Settings(reads="40R", anchor_length=6, min_as=-18, error_interval=3, seeding_interval=3).resolved()
    rules, n = kernel.Rules(idx, s, 40), 60
    reads = []
    for i in range(n):
        source = rng.choice(contigs)[1]
        at = rng.randrange(0, len(source) - 44)
        read = (edited(rng, source[at : at + 44], rng.randrange(0, 4)) + "ACGTACGT")[:40] if i % 6 else "".join(rng.choice("ACGT") for _ in range(40))
        reads.append(bytes(rng.choice((0, 40)) << 2 | "ACGT".index(b) for b in read))
    grid = np.frombuffer(b"".join(reads), np.uint8).reshape(n, 40)
    together, seen = kernel.Reads(n), 0
    for c in range(40):
        together.take(grid[:, c], rules)
        if c in (9, 20, 33, 39):
            own = together.seeds_of()
            assert own == [kernel.folded(r, rules, c + 1).seeds for r in reads]
            seen += sum(map(len, own))
    assert seen > 100 and together.calls_of() == reads


def plain_flags(records, mates):
    """From a read's primary records (mate -> start and strand; None: unmapped and reported): flag, rname, pos, rnext, pnext."""
    out = {}
    for i, m in enumerate(mates):
        own, following = records[m], records[mates[(i + 1) % len(mates)]]
        flag = 0
        if len(mates) > 1:
            flag = 1 | (64 if i == 0 else 128 if i == len(mates) - 1 else 192)
        flag |= 4 if own is None else 16 * own[1]
        rname, pos = ("*", 0) if own is None else ("g", own[0] + 1)
        rnext, pnext = "*", 0
        if len(mates) > 1:
            if following is None:
                flag, rnext, pnext = flag | 8, rname, pos
            else:
                flag |= 32 * following[1]
                rnext, pnext = "g", following[0] + 1
                if own is None:
                    rname, pos = rnext, pnext
        out[m] = (flag, rname, pos, rnext, pnext)
    return out


@pytest.mark.parametrize("mates", [(1,), (2,), (1, 2), (1, 2, 3), (2, 3)])
def test_flags_tell_of_the_mates_that_are_there(spark, genome, mates):
    rng, flip = random.Random(22), str.maketrans("ACGT", "TGCA")
    ref = spark.createDataFrame([(0, "g", genome, len(genome))], "rid int, name string, seq string, length long")
    s = Settings(reads="40R,40R,40R", genome_size=4000, anchor_length=10, out_mode="ANYBEST", report_unmapped=True, lanes=(1,), tiles=(1101,)).resolved()
    shared, rows, expected = index.broadcast(spark, index.build(ref)), [], {}
    for read in range(20):
        placed = {}
        for m in mates:
            at, turned, lost = rng.randrange(0, 1900), rng.randrange(2), rng.random() < 0.3
            seq = "".join(rng.choice("AC") for _ in range(40)) if lost else genome[at : at + 40].translate(flip)[::-1] if turned else genome[at : at + 40]
            placed[m] = None if lost else (at, turned)
            rows.append((1, 1101, read, m, bytearray(bcl.calls_of(seq, "I" * 40))))
        expected |= {(read, m): x for m, x in plain_flags(placed, mates).items()}
    reads = spark.createDataFrame(rows, "lane int, tile int, read_no long, mate int, calls binary").repartition(3)
    got = {(r["read_no"], r["mate"]): (r["flag"], r["rname"], r["pos"], r["rnext"], r["pnext"]) for r in mapping.sam(mapping.read_states(reads, shared, s), ref, shared, s).collect()}
    assert got == expected


def test_mates_of_different_progress_meet(spark, tmp_path, reference, genome):
    """At a cycle within the second mate both are told of each other; before it the first is single."""
    flip, rows = str.maketrans("ACGT", "TGCA"), []
    for at in (30, 500, 900):
        rows.append(bcl.calls_of(genome[at : at + 40] + "ACAGTCGA" + genome[at + 200 : at + 240].translate(flip)[::-1], "I" * 88))
    s = settings(out_cycles=(40, 75))
    out, shared = streamed(spark, tmp_path, reference, rows, [range(1, 89)], s)
    first = live.report(spark, out, 40, reference, shared, s).collect()
    assert {(r["mate"], r["flag"], r["rnext"], r["pnext"], r["cycle"]) for r in first} == {(1, 0, "*", 0, 40)} and len(first) == 3
    both = sorted((r["read_no"], r["mate"], r["flag"], r["pos"], r["pnext"], r["cigar"]) for r in live.report(spark, out, 75, reference, shared, s).collect())
    # the second mate's first 27 bases are the last of its place on the forward strand
    assert both == [x for i, at in enumerate((30, 500, 900)) for x in ((i, 1, 97, at + 1, at + 214, "40M"), (i, 2, 145, at + 214, at + 1, "27M"))]


def test_unique_mode_reports_no_ambiguous_read_as_unmapped(spark, genome):
    ref = spark.createDataFrame([(0, "a", genome[:40] + "ACGT" * 9 + genome[:40], 116)], "rid int, name string, seq string, length long")
    shared = index.broadcast(spark, index.build(ref))
    s = Settings(reads="40R", genome_size=300, anchor_length=10, out_mode="UNIQUE", report_unmapped=True).resolved()
    rows = [(1, 1101, i, 1, bytearray(bcl.calls_of(x, "I" * 40))) for i, x in enumerate((genome[:40], "G" * 40))]
    reads = spark.createDataFrame(rows, "lane int, tile int, read_no long, mate int, calls binary")
    assert [(r["read_no"], r["flag"]) for r in mapping.sam(mapping.read_states(reads, shared, s), ref, shared, s).collect()] == [(1, 4)]


def test_shards_give_what_one_index_does(spark, genome):
    rng, flip = random.Random(23), str.maketrans("ACGT", "TGCA")
    contigs = [("x", genome[:1200]), ("y", "".join(rng.choice("ACGT") for _ in range(90))), ("z", genome[1200:2000] + genome[300:420])]
    ref = spark.createDataFrame([(i, n, q, len(q)) for i, (n, q) in enumerate(contigs)], "rid int, name string, seq string, length long")
    s = Settings(reads="50R", genome_size=4000, anchor_length=10, out_mode="ALLBEST", report_unmapped=True).resolved()
    rows = []
    for i in range(150):
        source = contigs[i % 3][1]
        at = rng.randrange(0, len(source) - 54) if i % 4 else min(len(source) - 54, 395 * (i % 3) + rng.randrange(0, 20))  # many across the cuts
        seq = (edited(rng, source[at : at + 54], rng.choice((0, 0, 1, 2))) + "ACGTACG")[:50]
        rows.append((1, 1101, i, 1, bytearray(bcl.calls_of(seq.translate(flip)[::-1] if i % 2 else seq, "I" * 50))))
    reads = spark.createDataFrame(rows, "lane int, tile int, read_no long, mate int, calls binary").repartition(3)
    shared = index.broadcast(spark, index.build(ref))
    table, n = shards.pieces(ref, 400, 100)
    assert n >= 4 and table.count() >= 6
    report = lambda states: {(r["read_no"], r["flag"] & ~256, r["rname"], r["pos"], r["cigar"], (r["tags"] or {}).get("AS"), (r["tags"] or {}).get("MD")) for r in mapping.sam(states, ref, None, s).collect()}
    whole = report(mapping.read_states(reads, shared, s))
    assert report(shards.read_states(reads, ref, s, most=400)) == whole and len(whole) > 140
    assert report(shards.read_states(reads.where("false"), ref, s, most=400)) == set() == report(shards.read_states(reads.where("false"), ref.where("false"), s))


def test_stored_index(spark, tmp_path, genome, monkeypatch):
    made = index.Index([("one", genome[:700]), ("two", genome[700:900])])
    monkeypatch.setattr(index, "PIECE", 1000)
    index.save(spark, made, str(tmp_path / "i"))
    back = index.load(spark, str(tmp_path / "i"))
    assert back.names == made.names and back.size == made.size and all((getattr(back, a) == getattr(made, a)).all() and getattr(back, a).dtype == getattr(made, a).dtype for a in index._ARRAYS)
    with pytest.raises(index.TooLarge):
        index.load(spark, str(tmp_path / "i"), 100)


def test_fasta_headers_with_marks(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 a>b\r\nACgt\r\nNN\r\n>>two\n\nAC\n")
    got = fasta.read(spark, str(tmp_path / "g.fa")).orderBy("rid").collect()
    assert [tuple(r) for r in got] == [(0, "chr1_a>b", "ACGTNN", 6), (1, ">two", "AC", 2)]
    (tmp_path / "h.fa").write_text(">a\nAC\n>b\n")
    with pytest.raises(Exception, match="no sequence"):
        fasta.read(spark, str(tmp_path / "h.fa")).collect()


def test_tiles_in_ranges_and_filters_of_wrong_size(spark, tmp_path, run_rows):
    root = str(tmp_path / "run")
    bcl.write_run(root, 1, 1101, run_rows)
    whole, parts = (sorted((r["seg_id"], r["read_no"], bytes(r["calls"])) for r in bcl.reads(spark, root, settings().segments, n).collect()) for n in (1000, 7))
    assert whole == parts and len(whole) == 4 * len(run_rows)
    bcl.write_filter(root, 1, 1101, [True] * 5)
    path = bcl.filter_path(root, 1, 1101)
    with open(path, "ab") as f:
        f.write(b"\1")
    with pytest.raises(Exception, match="another size"):
        bcl.filters(spark, root).collect()


def test_records_in_parts(spark, tmp_path, reference, run_rows, monkeypatch):
    monkeypatch.setattr(sam, "PART_RECORDS", 9)
    s = settings(out_format="SAM")
    shared = index.broadcast(spark, index.build(reference))
    reads = spark.createDataFrame([(1, 1101, i, 1, bytearray(row[:40])) for i, row in enumerate(run_rows)], "lane int, tile int, read_no long, mate int, calls binary")
    files = sam.write(mapping.sam(mapping.read_states(reads, shared, s), reference, shared, s), reference, str(tmp_path / "out"))
    assert len(files) == 3 and all(f.split("_all.")[1] in ("0.sam", "1.sam", "2.sam") for f in files)
    assert sam.read_sam(spark, str(tmp_path / "out")).select("qname").distinct().count() == len(run_rows)


def test_window_choice_is_a_plain_loop(spark, genome):
    """All places of reads from a repetitive contig, in the order of rank, against a loop over them."""
    repeat = genome[:30]
    contig = "".join(repeat[: 12 + i % 18] + genome[100 + 7 * i : 104 + 7 * i] for i in range(40)) + genome[:300]
    ref = spark.createDataFrame([(0, "a", contig, len(contig))], "rid int, name string, seq string, length long")
    shared = index.broadcast(spark, index.build(ref))
    rows = [(1, 1101, i, 1, bytearray(bcl.calls_of(contig[40 * i : 40 * i + 30], "I" * 30))) for i in range(20)]
    reads = spark.createDataFrame(rows, "lane int, tile int, read_no long, mate int, calls binary")
    for mode in ("ALL", "ALLBEST", "ANYBEST", "N2"):
        s = Settings(reads="30R", genome_size=2000, anchor_length=8, out_mode=mode).resolved()
        found = mapping.alignments(mapping.read_states(reads, shared, s), shared, s).cache()
        got = {}
        for r in mapping.records(found, ref, s).collect():
            got.setdefault(r["read_no"], []).append((r["nth"], r["gid"], r["start"], r["score"]))
        by_read = {}
        for r in found.where((F.col("score") >= s.min_as) & (F.col("clip") <= s.max_softclip_ratio * 30)).collect():
            span = sum(x["len"] for x in r["cigar"] if x["op"] != INSERTION)
            for p in r["places"][:1] if mode == "ANYBEST" else r["places"]:
                start = len(contig) - p["at"] - span + r["clip"] if p["gid"] % 2 == 0 else p["at"]
                if start >= 0:
                    by_read.setdefault(r["read_no"], []).append((r["seed"], p["gid"], p["at"], start, r["score"]))
        for read, places in by_read.items():
            seen, out = set(), []
            for _, gid, _, start, score in sorted(places):
                if (mode == "ANYBEST" and out) or (mode == "N2" and len(out) == 2) or (mode == "ALLBEST" and out and score != out[0][3]):
                    break
                if (gid, start // 10) not in seen and (gid, start // 10 + 1) not in seen:
                    seen.add((gid, start // 10))
                    out.append((len(out) + 1, gid, start, score))
            assert sorted(got.get(read, [])) == out, (mode, read)
        assert sum(map(len, got.values())) >= 20


def test_status_and_progress(spark, tmp_path, reference, run_rows):
    said = []
    listener = live.Progress(said.append)
    spark.streams.addListener(listener)
    s = settings(out_cycles=(20,))
    streamed(spark, tmp_path, reference, run_rows, [range(1, 21), range(22, 30)], s)
    got = sorted(map(tuple, live.status(spark, str(tmp_path / "check")).collect()))
    assert got == [(1, 1101, 0, 20), (1, 1101, 1, 20)]
    for _ in range(50):
        if sum("ended" in x for x in said) == 2:
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert any("20 files" in x and "last cycle 20" in x for x in said) and any("last cycle 29" in x for x in said)


def test_noise_and_lanes(spark, tmp_path):
    text = "".join(f"@r{i}\nACGTACGT\n+\nIIIIIIII\n" for i in range(40))
    assert bcl.fastq_to_run(text, str(tmp_path / "a"), 1, (1101,), 0.5, 10, 3) == 50
    names = (tmp_path / "a/L001/s_1_1101.names").read_text().split()
    assert sorted(names) == sorted([f"r{i}" for i in range(40)] + [f"noise.{i}" for i in range(10)])
    passed = [r["pass"] for r in bcl.filters(spark, str(tmp_path / "a")).collect()]
    assert len(passed) == 50 and 10 < sum(passed) < 40
    bcl.await_lanes(str(tmp_path / "a"), (1,))
    with pytest.raises(TimeoutError):
        bcl.await_lanes(str(tmp_path / "a"), (1, 2), 0.01, 0.05)


# ---- whole records against plain Python ----


def plain_score(cigar, s):
    total, last = 0, len(cigar) - 1
    for i, (n, op) in enumerate(cigar):
        if op == MISMATCH and i in (0, last):
            total = int(float(np.float32(total) - (np.float32(s.scores.softclip_open) + np.float32(n) * np.float32(s.scores.softclip_extend))))
        elif op == MISMATCH:
            total -= n * s.scores.mismatch
        elif op == INSERTION:
            total -= s.scores.insertion_open + n * s.scores.insertion_extend
        elif op == DELETION:
            total -= s.scores.deletion_open + n * s.scores.deletion_extend
        else:
            total += n * s.scores.match
    return total


def plain_texts(cigar, bases):
    """CIGAR, extended CIGAR and MD."""
    named = lambda extended: ["S" if i == 0 and op == MISMATCH else {MATCH: "M", MISMATCH: "X" if extended else "M", INSERTION: "I", DELETION: "D"}[op] for i, (_, op) in enumerate(cigar)]

    def text(letters):
        out = []
        for (n, _), letter in zip(cigar, letters, strict=True):
            if out and out[-1][1] == letter:
                out[-1][0] += n
            else:
                out.append([n, letter])
        return [f"{n}{letter}" for n, letter in out]

    md, run, at = [], 0, 0
    for i, (n, op) in enumerate(cigar):
        if op == DELETION or (op == MISMATCH and i):
            md += [str(run)] * (run > 0) + [bases[at : at + n]]
            run, at = 0, at + n
        elif op == MATCH:
            run += n
    return text(named(False)), text(named(True)), md + [str(run)] * (run > 0)


def plain_mapq(score, best, total, unique, length, s):
    if unique and score == length * s.scores.match:
        return 42
    errors = lambda x: (length * s.scores.match - x) / s.scores.least_penalty
    share = 0.01 ** (errors(score) - errors(best))
    most, now = 100 * errors(scoring.threshold(length, length, s)) / length, 100 * errors(score) / length
    right = 1.0 if score == length * s.scores.match else 0.49995 + 0.5 * (1 - 10 ** (-5 - most + 2 * now))
    p = right * share / total
    return next((i for i, top in enumerate((0.1, 0.29, 0.435, 0.55)) if p <= top), None) if p <= 0.55 else math.floor(-10 * math.log10(1 - min(p, 0.99993)) + 0.5)


def plain_records(contigs, calls, s, length):
    """flag, contig, pos, mapq, cigar, seq, qual, score, nm, md of a single read, by the rules alone."""
    seeds = []
    for cycle, found in brute_states([c for _, c in contigs], calls, s, length):
        seeds = found if cycle == length else seeds
    rows = []
    for at, _, cigar, bases in seeds:
        text, extended, md = plain_texts(cigar, bases)
        clip = cigar[0][0] if cigar[0][1] == MISMATCH else 0
        rows.append((-plain_score(cigar, s), clip > 0, clip, len(cigar), "".join(extended), bases, cigar, at, text, md))
    rows.sort(key=lambda r: r[:6])
    if not rows:
        return []
    best, found = -rows[0][0], sum(len(r[7]) for r in rows)
    total = sum(len(r[7]) * 0.01 ** ((best + r[0]) / s.scores.least_penalty) for r in rows)
    bases_, quals = "".join("N" if b < 4 else "ACGT"[b & 3] for b in calls), "".join(chr(33 + (b >> 2)) for b in calls)
    flip, out, seen = str.maketrans("ACGTN", "TGCAN"), [], set()
    mode = s.out_mode
    for minus, _, clip, _, _, _, cigar, at, text, md in rows:
        if -minus < s.min_as or clip > s.max_softclip_ratio * length:
            continue
        places = sorted((g, len(contigs[g // 2][1]) - e) for g, e in at)
        for g, p in places[:1] if mode == "ANYBEST" else places:
            if mode == "ANYBEST" and out:
                break
            span = sum(n for n, op in cigar if op != INSERTION)
            start = p if g % 2 else len(contigs[g // 2][1]) - p - span + clip
            if start < 0 or (g, start // 10) in seen or (g, start // 10 + 1) in seen:
                continue
            seen.add((g, start // 10))
            second, turned = bool(out), g % 2 == 1
            seq, qual = ("*", "*") if second else (bases_.translate(flip)[::-1], quals[::-1]) if turned else (bases_, quals)
            told = [x.translate(flip) for x in (re.findall("[0-9]+|[A-Z]", "".join(md))[::-1] if turned else md)] if turned else md
            nm = sum(n for n, op in cigar[1:] if op != MATCH)
            out.append((256 * second + 16 * turned, contigs[g // 2][0], start + 1, plain_mapq(-minus, best, total, found == 1, length, s), "".join(text[::-1] if turned else text), seq, qual, str(-minus), str(nm), "".join(told)))
    return out


@pytest.mark.parametrize("mode", ["ALL", "ANYBEST"])
def test_records_are_those_of_plain_rules(spark, mode):
    rng, flip = random.Random(31), str.maketrans("ACGT", "TGCA")
    contigs = [("one", "".join(rng.choice("ACGT") for _ in range(220))), ("two", "".join(rng.choice("ACGT") for _ in range(90)))]
    contigs[0] = ("one", contigs[0][1] + contigs[0][1][20:90] + contigs[1][1][10:60].translate(flip)[::-1])
    ref = spark.createDataFrame([(i, n, q, len(q)) for i, (n, q) in enumerate(contigs)], "rid int, name string, seq string, length long")
    s = Settings(reads="36R", genome_size=800, anchor_length=7, min_as=-20, error_interval=3, seeding_interval=3, out_mode=mode).resolved()
    rows, expected, letters = [], {}, set()
    for i in range(70):
        source = rng.choice(contigs)[1]
        at = rng.randrange(0, len(source) - 42)
        read = (edited(rng, source[at : at + 42], rng.choice((0, 1, 1, 2))) + "ACGTAC")[:36]
        read = "".join(rng.choice("ACGT") for _ in range(5)) + read[5:] if i % 7 == 0 else read
        read = read.translate(flip)[::-1] if i % 2 else read
        calls = bytes(rng.choice((0, 3, 30, 40)) << 2 | "ACGT".index(b) for b in read)
        rows.append((1, 1101, i, 1, bytearray(calls)))
        expected[i] = plain_records(contigs, calls, s, 36)
    reads = spark.createDataFrame(rows, "lane int, tile int, read_no long, mate int, calls binary").repartition(3)
    shared, got = index.broadcast(spark, index.build(ref)), {i: [] for i in range(70)}
    for r in sorted(mapping.sam(mapping.read_states(reads, shared, s), ref, shared, s).collect(), key=lambda r: r["rank"]):
        got[r["read_no"]].append((r["flag"], r["rname"], r["pos"], r["mapq"], r["cigar"], r["seq"], r["qual"], r["tags"]["AS"], r["tags"]["NM"], r["tags"]["MD"]))
        letters |= set(re.findall("[A-Z]", r["cigar"]))
    for i, x in expected.items():
        assert got[i] == x, i
    assert letters >= set("MIDS") and sum(map(len, expected.values())) > 60 and len({x[7] for xs in expected.values() for x in xs}) > 4
