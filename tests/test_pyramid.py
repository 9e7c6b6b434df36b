"""Stored resolutions of a curve against the curve itself."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from cisloom.operators import curves as C
from cisloom.operators.pyramid import Pyramid

SCHEMA = "seq string, start bigint, span bigint, value double"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(rng.choice(["X", "a b/c"]), rng.randrange(-9000, 60_000), 5, round(rng.uniform(-5, 5), 3)) for _ in range(1500)] + [(None, 1, 1, 1.0), ("X", None, 1, 1.0), ("X", 5, 1, None)]
    p = Pyramid(str(tmp_path_factory.mktemp("p") / "p"), base=4, levels=4)
    p.write(spark.createDataFrame(rows, SCHEMA).repartition(3))
    return rows, p


def cells(rows, seq, width, start, end):
    out = defaultdict(list)
    for s, at, _, v in rows:
        if s == seq and at is not None and v is not None and start // width <= at // width <= end // width:
            out[at // width * width].append(v)
    return {at: (width, len(v), round(sum(v) / len(v), 9), min(v), max(v)) for at, v in out.items()}


@pytest.mark.parametrize("width", [4, 32, 256, 2048])
def test_viewports(spark, stored, width):
    rows, p = stored
    for seq, start, end in (("X", 100, 50_000), ("a b/c", -8000, -1), ("none", 0, 100)):
        n = max(1, (end - start + 1) // width)
        level = p.level_for(start, end, n)
        assert p.width(level) <= max(4, (end - start + 1) // n)
        got = {r["start"]: (r["span"], r["n"], round(r["mean"], 9), r["lowest"], r["highest"]) for r in p.viewport(spark, seq, start, end, n).collect()}
        assert got == cells(rows, seq, p.width(level), start, end)


def test_other_folders_are_not_read(spark, stored):
    _, p = stored
    view = p.viewport(spark, "X", 20_000, 30_000, 2000)
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and all(x in plan.split("PartitionFilters:")[1].split("]")[0] for x in ("level", "seq", "tile"))
    files = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    read = files(p._between(spark, 0, 20_000, 30_000, "X"))
    assert 0 < len(read) <= 2 < len(files(p.read(spark))) and all("level=0" in f and "seq=X" in f for f in read)
    assert len(view.collect()) <= 2502


@pytest.mark.parametrize(("start", "bins", "part"), [(0, 20, 2048), (256, 33, 256), (-4096, 64, 32), (4, 100, 36)])
def test_raster_from_any_level(spark, stored, start, bins, part):
    rows, p = stored
    curve = spark.createDataFrame([r for r in rows if None not in r], SCHEMA)
    end = start + bins * part - 1
    assert sorted(map(tuple, p.rasterise(spark, start, end, bins).collect())) == sorted(map(tuple, C.rasterise(curve, start, end, bins).collect()))


def test_parts_must_fit(spark, stored):
    with pytest.raises(ValueError, match="whole cells"):
        stored[1].rasterise(spark, 1, 100, 10)


def test_empty_curve(spark, tmp_path):
    p = Pyramid(str(tmp_path / "p"))
    p.write(spark.createDataFrame([], SCHEMA))
    assert p.viewport(spark, "X", 0, 100).collect() == []
