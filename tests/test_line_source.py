"""Ranges of bytes lose no line and read none twice, wherever they are cut; conditions are asked while reading."""

import io
import random

import pytest

from moleweave.operators.molecules import molecules
from moleweave.sources.line_source import lines, register_source


def whole(data):
    out, at = [], 0
    for part in data.split(b"\n"):
        out.append((at, part))
        at += len(part) + 1
    return out[:-1] if data.endswith(b"\n") or not data else out


def test_every_cut_of_random_files():
    rng = random.Random(4)
    for _ in range(200):
        data = b"".join(rng.choice([b"CCO a", b"", b"C", b"c1ccccc1 benzene", "é x".encode()]) + b"\n" for _ in range(rng.randint(0, 12))) + rng.choice([b"", b"CC last"])
        step, size = rng.randint(1, 30), rng.randint(1, 40)
        found = [x for at in range(0, len(data), step) for x in lines(io.BytesIO(data), at, min(at + step, len(data)), size)]
        assert found == whole(data), (data, step, size)


@pytest.mark.parametrize("split", [7, 64, 1000, 10**9])
def test_read_in_spark(spark, tmp_path, split):
    register_source(spark)
    rng = random.Random(1)
    rows = [(rng.choice(["CCO", "c1ccccc1Br", "CN", "[Na+].[Cl-]"]), f"m{k}") for k in range(300)]
    for part in range(3):
        text = "\n".join(f"{s}\t{n}" for s, n in rows[part::3]) + ("\r\n" if part else "")
        (tmp_path / f"part-{part}.smi").write_text(text, newline="")
    (tmp_path / "_SUCCESS").write_text("")
    df = spark.read.format("smiles_lines").option("path", f"file://{tmp_path}").option("splitBytes", split).load()
    assert sorted((r.smiles, r.name) for r in df.collect()) == sorted(rows)
    assert df.rdd.getNumPartitions() == sum(-(-(tmp_path / f"part-{p}.smi").stat().st_size // split) for p in range(3))
    assert df.where("smiles like '%Br%'").count() == df.where("smiles = 'c1ccccc1Br'").count() == sum("Br" in s for s, _ in rows)
    assert df.where("smiles like 'C%' and name <> 'm3'").count() == sum(s.startswith("C") and n != "m3" for s, n in rows)
    few = spark.read.format("smiles_lines").option("path", f"file://{tmp_path}").option("splitBytes", split).option("contains", "[,Cl").load()
    assert {r.smiles for r in few.collect()} == {"[Na+].[Cl-]"} and molecules(few).where("parse_ok").count() == sum("Cl" in s for s, _ in rows)
