"""Alignment records as SAM text and BAM files, one per cycle and sample, or several where there are many records.

Records are dealt by (cycle, sample, part), sorted by read within, and written by the tasks under a name of the
attempt's own, which the task then renames to the part's. A rerun replaces what was there with the same.
"""

from __future__ import annotations

import re
import struct
import zlib
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TYPES = {"AS": "i", "NM": "i", "BC": "Z", "MD": "Z"}
#: Records that one task sorts and writes.
PART_RECORDS = 1 << 19
COLUMNS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def header(contigs: list[tuple[str, int]], program: str = "lanewise", version: str = "1") -> str:
    return "@HD\tVN:1.5\tGO:query\n" + "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in contigs) + f"@PG\tID:{program}\tPN:{program}\tVN:{version}\n"


def line(row: dict) -> str:
    tags = row.get("tags") or {}
    return "\t".join([*(str(row[c]) for c in COLUMNS), *(f"{k}:{_TYPES.get(k, 'Z')}:{v}" for k, v in tags.items())]) + "\n"


def line_of() -> Column:
    """``line`` as a column, of a record's columns."""
    kind = F.create_map(*[F.lit(x) for pair in _TYPES.items() for x in pair])
    tags = F.transform(F.map_entries("tags"), lambda t: F.concat(t["key"], F.lit(":"), F.coalesce(F.try_element_at(kind, t["key"]), F.lit("Z")), F.lit(":"), t["value"]))
    return F.concat_ws("\t", *[F.col(c).cast("string") for c in COLUMNS], tags)


def _bin(start: int, end: int) -> int:
    """The smallest bin of the fixed scheme (512 Mb down to 16 kb) that holds an interval."""
    end -= 1
    for shift in (14, 17, 20, 23, 26):
        if start >> shift == end >> shift:
            return ((1 << (29 - shift)) - 1) // 7 + (start >> shift)
    return 0


_OPS, _CODES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"


def bam_record(row: dict, contig_of: dict[str, int]) -> bytes:
    cigar = [(int(n), _OPS.index(op)) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", row["cigar"])]
    seq = "" if row["seq"] == "*" else row["seq"]
    qual = bytes(ord(c) - 33 for c in row["qual"]) if seq and row["qual"] != "*" else b"\xff" * len(seq)
    codes = [_CODES.index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    tags = b"".join(k.encode() + (b"i" + struct.pack("<i", int(v)) if _TYPES.get(k) == "i" else b"Z" + str(v).encode() + b"\0") for k, v in (row.get("tags") or {}).items())
    rid, pos = contig_of.get(row["rname"], -1), row["pos"] - 1
    span = sum(n for n, op in cigar if _OPS[op] in "MDN=X") or 1
    mate = rid if row["rnext"] == "=" else contig_of.get(row["rnext"], -1)
    name = row["qname"].encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", rid, pos, len(name), row["mapq"], _bin(max(pos, 0), max(pos, 0) + span), len(cigar), row["flag"], len(seq), mate, row["pnext"] - 1, row["tlen"])
    body += name + b"".join(struct.pack("<I", n << 4 | op) for n, op in cigar) + packed + qual + tags
    return struct.pack("<i", len(body)) + body


def bam_header(text: str, contigs: list[tuple[str, int]]) -> bytes:
    raw = text.encode()
    refs = b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in contigs)
    return b"BAM\1" + struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(contigs)) + refs


def bgzf(data: bytes) -> bytes:
    """Blocks of at most 65280 bytes, each a gzip member that states its size."""
    out = []
    for at in range(0, len(data), 65280):
        part = data[at : at + 65280]
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = deflate.compress(part) + deflate.flush()
        out.append(struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def write(records: DataFrame, reference: DataFrame, out_dir: str, form: str = "SAM", prefix: str = "lanewise", parts: int | None = None) -> list[str]:
    """``<prefix>_cycle<c>_<sample>.sam`` (or .bam), with parts ``.<k>`` behind the sample where there are several; returns the files.

    A part has some PART_RECORDS records, if ``parts`` doesn't say how many there are; that takes a count, so ``records``
    should be a table then. ``out_dir`` is a folder that driver and executors share.
    """
    contigs = [(r["name"], r["length"]) for r in reference.select("rid", "name", "length").orderBy("rid").collect()]
    text, contig_of = header(contigs), {n: i for i, (n, _) in enumerate(contigs)}
    top = Path(out_dir)

    def emit(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["lane"], r["tile"], r["read_no"], r["mate"] or 0, r["rank"]))
        first = rows[0]
        name = f"{prefix}_cycle{first['cycle']}_{first['sample']}{'' if first['parts'] == 1 else '.' + str(first['part'])}.{form.lower()}"
        for r in rows:
            r["tags"] = dict(r["tags"]) if r["tags"] else {}
        if form == "SAM":
            data = (text + "".join(map(line, rows))).encode()
        else:
            data = bgzf(bam_header(text, contigs)) + bgzf(b"".join(bam_record(r, contig_of) for r in rows)) + END
        import os
        import uuid

        top.mkdir(parents=True, exist_ok=True)
        attempt = top / f".{name}.{uuid.uuid4().hex}"
        attempt.write_bytes(data)
        os.replace(attempt, top / name)  # the last attempt of a task wins; all write the same
        return pa.table({"file": [str(top / name)], "n": [len(rows)]})

    if parts is None:
        many = {(r["cycle"], r["sample"]): -(-r["n"] // PART_RECORDS) for r in records.groupBy("cycle", "sample").agg(F.count("*").alias("n")).collect()}  # a row per file
        of = [x for (cycle, sample), n in many.items() if n > 1 for x in (F.lit(f"{cycle} {sample}"), F.lit(n))]
        count = F.coalesce(F.try_element_at(F.create_map(*of), F.concat_ws(" ", "cycle", "sample")), F.lit(1)) if of else F.lit(1)
    else:
        count = F.lit(parts)
    dealt = records.withColumn("parts", count.cast("int")).withColumn("part", F.pmod(F.xxhash64("lane", "tile", "read_no"), F.col("parts")).cast("int"))
    return sorted(r["file"] for r in dealt.groupBy("cycle", "sample", "part").applyInArrow(emit, "file string, n long").collect())  # a row per file


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Records of SAM text, with tags as a map."""
    f = F.split("value", "\t")
    numbers = {"flag": "int", "pos": "long", "mapq": "int", "pnext": "long", "tlen": "long"}
    tags = F.map_from_entries(F.transform(F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substr(t, F.lit(6)).alias("v"))))
    return spark.read.text(path).where("value NOT LIKE '@%'").select(*[F.get(f, F.lit(i)).cast(numbers.get(c, "string")).alias(c) for i, c in enumerate(COLUMNS)], tags.alias("tags"))


def read_bam(path: str) -> tuple[str, list[tuple[str, int]], list[dict]]:
    """Header, contigs and records of a BAM file, for tests and small files."""
    import gzip

    data = gzip.decompress(Path(path).read_bytes())
    n = struct.unpack_from("<i", data, 4)[0]
    text, at = data[8 : 8 + n].decode(), 8 + n
    count, at = struct.unpack_from("<i", data, at)[0], at + 4
    contigs = []
    for _ in range(count):
        k = struct.unpack_from("<i", data, at)[0]
        contigs.append((data[at + 4 : at + 3 + k].decode(), struct.unpack_from("<i", data, at + 4 + k)[0]))
        at += 8 + k
    rows = []
    while at < len(data):
        size = struct.unpack_from("<i", data, at)[0]
        rid, pos, ln, mapq, _, nc, flag, ns, mrid, mpos, tlen = struct.unpack_from("<iiBBHHHiiii", data, at + 4)
        p = at + 36
        qname, p = data[p : p + ln - 1].decode(), p + ln
        cigar = "".join(f"{v >> 4}{_OPS[v & 15]}" for v in struct.unpack_from(f"<{nc}I", data, p)) or "*"
        p += 4 * nc
        seq = "".join(_CODES[b >> 4] + _CODES[b & 15] for b in data[p : p + (ns + 1) // 2])[:ns] or "*"
        p += (ns + 1) // 2
        qual = "".join(chr(q + 33) for q in data[p : p + ns]) or "*"
        p, tags = p + ns, {}
        while p < at + 4 + size:
            key, kind = data[p : p + 2].decode(), data[p + 2 : p + 3]
            if kind == b"i":
                tags[key], p = str(struct.unpack_from("<i", data, p + 3)[0]), p + 7
            else:
                end = data.index(b"\0", p)
                tags[key], p = data[p + 3 : end].decode(), end + 1
        name = lambda i: contigs[i][0] if i >= 0 else "*"
        rows.append(dict(zip(COLUMNS, (qname, flag, name(rid), pos + 1, mapq, cigar, name(mrid), mpos + 1, tlen, seq, qual), strict=True)) | {"tags": tags})
        at += 4 + size
    return text, contigs, rows
