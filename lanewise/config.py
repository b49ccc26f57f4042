"""Settings of a run: defaults that depend on one another, parsers, ini files and RunInfo.

A value given on the command line wins over the config file, that over RunInfo, that over the default; a
switch that the config sets can't be unset. Settings are frozen once made.
"""

from __future__ import annotations

import configparser
import io
import math
import re
import xml.etree.ElementTree as ET
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any


class SettingError(ValueError):
    """A value that no setting can have."""


@dataclass(frozen=True)
class Segment:
    seg_id: int
    mate: int  # 0: barcode
    length: int
    start_cycle: int

    @property
    def is_barcode(self) -> bool:
        return self.mate == 0


def parse_reads(text: str) -> tuple[Segment, ...]:
    """``100R,8B,100R``: segments of reads (mates from 1 on) and barcodes, in cycle order."""
    out, mate, cycle = [], 0, 1
    for i, token in enumerate(text.split(",")):
        m = re.fullmatch(r"\s*([0-9]+)([RB])\s*", token)
        if not m:
            raise SettingError(f"read structure: {token!r}")
        mate += m[2] == "R"
        out.append(Segment(i, mate if m[2] == "R" else 0, int(m[1]), cycle))
        cycle += int(m[1])
    return tuple(out)


def parse_mode(text: str) -> tuple[str, int]:
    """(ALL, UNIQUE, BESTN, ALLBEST or ANYBEST, how many)."""
    names = {"ALL": "ALL", "A": "ALL", "UNIQUE": "UNIQUE", "U": "UNIQUE", "ALLBEST": "ALLBEST", "H": "ALLBEST", "ANYBEST": "ANYBEST", "B": "ANYBEST"}
    if text in names:
        return names[text], 0
    if m := re.fullmatch(r"(?:BESTN|N)([0-9]*)", text):
        return "BESTN", int(m[1] or 0)
    raise SettingError(f"output mode: {text!r}")


ALIGN_MODES = ("very-fast", "fast", "balanced", "accurate", "very-accurate")


def parse_align_mode(text: str) -> str:
    """By first letters, in any case; V needs an F or A right after it or after ``very-``."""
    t = text.upper()
    if t[:1] in "FBA" and t:
        return {"F": "fast", "B": "balanced", "A": "accurate"}[t[0]]
    if t[:1] == "V":
        for at in (1, 5):
            if t[at : at + 1] in ("F", "A") and t[at : at + 1]:
                return "very-fast" if t[at] == "F" else "very-accurate"
    raise SettingError(f"align mode: {text!r}")


def parse_format(text: str) -> str:
    names = {"SAM": "SAM", "S": "SAM", "BAM": "BAM", "B": "BAM"}
    if text.upper() not in names:
        raise SettingError(f"output format: {text!r}")
    return names[text.upper()]


def parse_size(text: str) -> int:
    """Bytes, with B, K or M behind."""
    m = re.fullmatch(r"([0-9]+)([BKM]?)", text.strip())
    if not m:
        raise SettingError(f"size: {text!r}")
    return int(m[1]) * {"": 1, "B": 1, "K": 1024, "M": 1024 * 1024}[m[2]]


def parse_numbers(text: str) -> tuple[int, ...]:
    """Sorted, each once; what is no number is left out."""
    return tuple(sorted({int(t) for t in re.split(r"[ ,:;&|]+", text) if t.isdigit()}))


def parse_barcodes(text: str, segments: tuple[Segment, ...]) -> tuple[tuple[str, ...], ...]:
    lengths = [s.length for s in segments if s.is_barcode]
    out = []
    for code in filter(None, text.split(",")):
        parts = tuple(code.strip().upper().split("-"))
        if not all(re.fullmatch("[ACGT]+", p) for p in parts) or [len(p) for p in parts] != lengths:
            raise SettingError(f"barcode {code!r} doesn't fit the segments {lengths}")
        out.append(parts)
    return tuple(out)


def parse_barcode_errors(text: str, n: int) -> tuple[int, ...]:
    """One number holds for all fragments."""
    values = tuple(int(t) for t in text.split(",") if t.strip())
    if len(values) == 1:
        values *= max(1, n)
    if n and len(values) != n:
        raise SettingError(f"barcode errors {text!r} for {n} fragments")
    return values


def tiles_up_to(largest: int) -> tuple[int, ...]:
    """All tiles of a layout whose last tile is ``largest``: surface, swath, two digits."""
    surface, swath, tile = largest // 1000, largest // 100 % 10, largest % 100
    return tuple(a * 1000 + b * 100 + c for a in range(1, surface + 1) for b in range(1, swath + 1) for c in range(1, tile + 1))


_ANCHOR_FACTOR = dict(zip(ALIGN_MODES, (1.25, 1.125, 1.0, 0.875, 0.75), strict=True))
_ERROR_RATE = dict(zip(ALIGN_MODES, (0.015, 0.02, 0.025, 0.03, 0.035), strict=True))


def default_anchor(genome_size: int, mode: str = "balanced") -> int:
    """genome_size: both strands. The length at which a random match is rarer than one in ten thousand, then by mode."""
    return int(int(math.log(genome_size / 1e-4, 4)) * _ANCHOR_FACTOR[mode])


@dataclass(frozen=True)
class Scores:
    match: int = 0
    mismatch: int = 6
    insertion_open: int = 5
    deletion_open: int = 5
    insertion_extend: int = 3
    deletion_extend: int = 3
    max_gap: int = 3
    softclip_open: float | None = None
    softclip_extend: float | None = None

    @property
    def least_penalty(self) -> int:
        return min(self.mismatch + self.match, self.deletion_open + self.deletion_extend, self.insertion_open + self.insertion_extend + self.match)

    @property
    def largest_penalty(self) -> int:
        return max(self.mismatch + self.match, self.deletion_open + self.deletion_extend, self.insertion_open + self.insertion_extend + self.match)


def default_min_score(length: int, mode: str, scores: Scores) -> int:
    return int(length * scores.match - length * _ERROR_RATE[mode] * scores.largest_penalty)


#: Settings that are read and kept, and change nothing: Spark deals out work and memory, and nothing is dropped for a base's quality.
WITHOUT_EFFECT = ("min_basecall_quality", "force_resort", "block_size", "compression", "num_threads", "num_out_threads")


@dataclass(frozen=True)
class Settings:
    """Everything a run is told, with the derived defaults filled in by ``resolved``."""

    reads: str = "100R"
    genome_size: int = 18362
    bcl_dir: str = ""
    index: str = ""
    lanes: tuple[int, ...] = tuple(range(1, 9))
    tiles: tuple[int, ...] | None = None
    max_tile: int = 2316
    barcodes: str = ""
    barcode_errors: str = "2"
    align_undetermined_barcodes: bool = False
    run_id: str = ""
    flowcell_id: str = ""
    instrument_id: str = ""
    out_dir: str = "./out"
    out_format: str = "BAM"
    out_cycles: tuple[int, ...] | None = None
    out_mode: str = "ANYBEST"
    report_unmapped: bool = False
    extended_cigar: bool = False
    force_resort: bool = False
    max_softclip_ratio: float = 0.2
    align_mode: str = "balanced"
    anchor_length: int | None = None
    error_interval: int | None = None
    seeding_interval: int | None = None
    max_softclip_length: int | None = None
    min_basecall_quality: int = 1
    keep_invalid_sequences: bool = False
    min_as: int | None = None
    scores: Scores = field(default_factory=Scores)
    temp_dir: str = "./temp"
    keep_files: tuple[int, ...] = ()
    keep_all_files: bool = False
    block_size: str = "64M"
    compression: int = 2
    num_threads: int = 1
    num_out_threads: int | None = None
    continue_from: int = 1
    n_policy: str = "as_a"
    md_style: str = "compact"

    @property
    def segments(self) -> tuple[Segment, ...]:
        return parse_reads(self.reads)

    @property
    def total_cycles(self) -> int:
        return sum(s.length for s in self.segments)

    @property
    def barcode_lengths(self) -> list[int]:
        return [s.length for s in self.segments if s.is_barcode]

    def resolved(self) -> Settings:
        """With every default worked out and every value checked."""
        mates = [s for s in self.segments if not s.is_barcode]
        if not mates:
            raise SettingError("no read in the read structure")
        if self.md_style != "compact":
            raise SettingError(f"md_style {self.md_style} isn't there, only compact")
        if self.keep_invalid_sequences:
            raise SettingError("keep_invalid_sequences isn't there: sequences of invalid reads aren't kept")
        if self.continue_from != 1:
            raise SettingError("continue isn't there: a run that is mapped again goes on from its checkpoint")
        mode = parse_align_mode(self.align_mode)
        k = self.anchor_length or default_anchor(self.genome_size, mode)
        s, first = self.scores, mates[0].length
        s = replace(s, softclip_open=float(s.mismatch) if s.softclip_open is None else s.softclip_open, softclip_extend=s.mismatch / k if s.softclip_extend is None else s.softclip_extend)
        total = self.total_cycles
        cycles = tuple(sorted({min(c, total) for c in self.out_cycles})) if self.out_cycles else (total,)
        parse_mode(self.out_mode)
        parse_size(self.block_size)
        codes = parse_barcodes(self.barcodes, self.segments)
        parse_barcode_errors(self.barcode_errors, len(self.barcode_lengths))
        return replace(
            self,
            scores=s,
            align_mode=mode,
            anchor_length=k,
            error_interval=self.error_interval if self.error_interval is not None else k // 2,
            seeding_interval=max(1, self.seeding_interval if self.seeding_interval is not None else k // 2),
            max_softclip_length=self.max_softclip_length if self.max_softclip_length is not None else first // 2,
            min_as=self.min_as if self.min_as is not None else default_min_score(first, mode, s),
            out_cycles=cycles,
            out_format=parse_format(self.out_format),
            tiles=tuple(sorted(set(self.tiles))) if self.tiles else tiles_up_to(self.max_tile),
            lanes=tuple(sorted(set(self.lanes))),
            keep_files=tuple(range(1, total + 1)) if self.keep_all_files else tuple(sorted(set(self.keep_files))),
            compression=min(2, self.compression),
            temp_dir=self.temp_dir or self.bcl_dir,
            align_undetermined_barcodes=self.align_undetermined_barcodes or not codes,
            num_out_threads=self.num_out_threads if self.num_out_threads is not None else max(1, self.num_threads // 2),
        )


_SCORE_NAMES = {f.name for f in fields(Scores)}


def _typed(name: str, value: Any) -> Any:
    if not isinstance(value, str):
        return value
    if name in ("lanes", "tiles", "out_cycles", "keep_files"):
        return parse_numbers(value)
    kind = {f.name: str(f.type) for f in fields(Settings)}[name]
    if "bool" in kind:
        return value.strip().lower() in ("1", "true", "yes", "on")
    return int(value) if "int" in kind and "tuple" not in kind else float(value) if "float" in kind else value


def merged(*layers: dict[str, Any]) -> Settings:
    """Settings from layers of decreasing priority; names may have dashes. A switch that any layer sets is set."""
    known, scores = {}, {}
    for layer in reversed(layers):
        for name, value in layer.items():
            name = {"continue": "continue_from", "max_gap_length": "max_gap", "match_score": "match", "mismatch_penalty": "mismatch"}.get(n := name.replace("-", "_"), n)
            if name in _SCORE_NAMES:
                scores[name] = float(value) if name.startswith("softclip") else int(value)
            elif name in {f.name for f in fields(Settings)} and value is not None:
                typed = _typed(name, value)
                known[name] = (known.get(name) or typed) if isinstance(typed, bool) else typed
            elif value is not None:
                raise SettingError(f"no such setting: {name}")
    return Settings(**known, scores=Scores(**scores))


def read_ini(text: str) -> dict[str, str]:
    """A flat file of key=value lines."""
    parser = configparser.ConfigParser(interpolation=None)
    parser.read_string("[run]\n" + text)
    return {k: v for k, v in parser["run"].items() if v != ""}


def write_ini(settings: Settings) -> str:
    out = io.StringIO()
    for name, value in asdict(settings).items():
        if name == "scores":
            for n, v in value.items():
                out.write(f"{n}={'' if v is None else v}\n")
        else:
            shown = ",".join(map(str, value)) if isinstance(value, tuple) else "" if value is None else value
            out.write(f"{'continue' if name == 'continue_from' else name.replace('_', '-')}={shown}\n")
    return out.getvalue()


def read_run_info(text: str) -> dict[str, Any]:
    """Run, flowcell and instrument ids, reads, lanes and tiles of a RunInfo.xml."""
    run = ET.fromstring(text).find("Run")
    if run is None:
        raise SettingError("no Run in RunInfo")
    out: dict[str, Any] = {"run_id": run.get("Id", ""), "flowcell_id": run.findtext("Flowcell", ""), "instrument_id": run.findtext("Instrument", "")}
    reads = sorted(run.iterfind("Reads/Read"), key=lambda r: int(r.get("Number", 0)))
    if reads:
        out["reads"] = ",".join(f"{r.get('NumCycles')}{'B' if r.get('IsIndexedRead') == 'Y' else 'R'}" for r in reads)
    layout = run.find("FlowcellLayout")
    if layout is not None:
        out["lanes"] = tuple(range(1, int(layout.get("LaneCount", 1)) + 1))
        a, b, c = (int(layout.get(n, 1)) for n in ("SurfaceCount", "SwathCount", "TileCount"))
        out["tiles"] = tiles_up_to(a * 1000 + b * 100 + c)
    return out
