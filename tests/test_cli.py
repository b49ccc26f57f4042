"""The command line from a FASTQ text to SAM files, and re-output with other options."""

import random
from pathlib import Path

import pytest

from lanewise import cli, config
from lanewise.sources import sam


def test_from_fastq_to_sam(spark, tmp_path, capsys):
    rng = random.Random(2)
    genome = "".join(rng.choice("ACGT") for _ in range(600))
    (tmp_path / "g.fa").write_text(f">one\n{genome}\n")
    starts = [rng.randrange(0, 550) for _ in range(12)]
    (tmp_path / "r.fq").write_text("".join(f"@r{i}\n{genome[a : a + 40]}\n+\n{'I' * 40}\n" for i, a in enumerate(starts)))
    root, idx, out, temp = (str(tmp_path / n) for n in ("run", "index", "out", "temp"))
    cli.main(["simulate", "--fastq", str(tmp_path / "r.fq"), "--root", root, "--tiles", "1101,1102"])
    cli.main(["build-index", "--input", str(tmp_path / "g.fa"), "--out-prefix", idx])
    assert capsys.readouterr().out.split() == ["12", "1200"]
    common = ["--bcl-dir", root, "--index", idx, "--reads", "40R", "--out-dir", out, "--temp-dir", temp, "--lanes", "1", "--tiles", "1101,1102", "--out-format", "SAM"]
    cli.main(["map", *common, "--out-cycles", "25,40"])
    assert sorted(p.name for p in Path(out).glob("*.sam")) == ["lanewise_cycle25_undetermined.sam", "lanewise_cycle40_undetermined.sam"]
    rows = sam.read_sam(spark, f"{out}/lanewise_cycle40_undetermined.sam").collect()
    assert sorted(r["pos"] for r in rows) == sorted(a + 1 for a in starts) and {r["cigar"] for r in rows} == {"40M"}
    # again from what was kept, as BAM; a cycle that wasn't kept is named
    capsys.readouterr()
    cli.main(["output", "--config", f"{out}/run.ini", "--out-cycles", "30,40", "--out-format", "BAM"])
    said = capsys.readouterr().out
    assert "cycle 30 wasn't kept" in said and "lanewise_cycle40_undetermined.bam" in said
    assert len(sam.read_bam(f"{out}/lanewise_cycle40_undetermined.bam")[2]) == 12


def test_needed_settings():
    parser_args = type("Args", (), {"config": None, "runinfo": None, "reads": "40R", "bcl_dir": None, "index": None})()
    with pytest.raises(config.SettingError):
        cli.settings_of(parser_args)
