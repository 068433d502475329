"""Versions of a lake: dead runs, single tiles, state of cells between runs, tiles of several zooms, order in files."""

import glob
import random
import struct
from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lithotile.functions import geo
from lithotile.operators import metrics
from lithotile.plans import pipeline
from lithotile.sources import lake, snapshots

NOW = datetime(2025, 1, 1)


def source(spark, kinds):
    """Points of four tiles; kinds: the amenity or highway of point i."""
    point = lambda x, y: bytearray(struct.pack("<BIdd", 1, 1, x, y))
    rows = [(f"node/{i}", {k: "x"}, point(36.4 + (i % 20) * 0.03, -1.5 + (i // 20) * 0.03), "kenya") for i, k in enumerate(kinds)]
    return spark.createDataFrame(rows, "feature_id string, tags map<string,string>, geometry binary, country string")


def files(path):
    return {f: open(f, "rb").read() for f in glob.glob(f"{path}/p_tile_z=*/**/*.parquet", recursive=True)}


def rows(spark, path):
    return {r.feature_id: r for r in lake.scan_lake(spark, path).collect()}


def test_versions(spark, tmp_path):
    path = str(tmp_path / "ke/features")
    first = pipeline.run(spark, "kenya", source(spark, ["highway"] * 400), str(tmp_path), now=NOW)
    before, held = rows(spark, path), files(path)
    assert first["total_features"] == len(before) == 400 and len(first["tileKeys"]) == first["tile_count"] > 3

    # a run that dies after its files are written, and one that dies while it publishes, change nothing
    changed = source(spark, ["amenity"] * 400)
    out = pipeline.plan(changed, pipeline.resolve("kenya"), now=NOW)
    for dies in ("tile_stats", "publish"):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(lake if dies == "tile_stats" else snapshots, dies, lambda *_, **__: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                lake.write_lake(out, path)
        assert rows(spark, path) == before and lake.read_manifest(spark, path) == first
    (tmp_path / "ke/features/_versions/0000000001.json").write_text("")  # cut off while it was written
    assert rows(spark, path) == before

    # a run on one tile rewrites that tile only
    t = first["tileKeys"][1]
    tile = (t["z"], t["x"], t["y"])
    second = pipeline.run(spark, "kenya", changed, str(tmp_path), now=NOW, tiles=[tile])
    after = rows(spark, path)
    assert all(files(path)[f] == data for f, data in held.items())
    assert {i for i in after if after[i].feature_type == "amenity"} == {i for i in before if before[i][10:13] == tile or (before[i].tile_z, before[i].tile_x, before[i].tile_y) == tile} != set()
    assert set(after) == set(before) and second["total_features"] == 400
    other = [e for e in second["tileKeys"] if (e["z"], e["x"], e["y"]) != tile]
    assert other == [e for e in first["tileKeys"] if (e["z"], e["x"], e["y"]) != tile]
    assert lake.read_tile(spark, path, *tile).count() == t["featureCount"]

    # of two runs at once one is refused
    with pytest.MonkeyPatch.context() as m:
        stats = lake.tile_stats
        m.setattr(lake, "tile_stats", lambda df: (m.undo(), lake.write_lake(out, path, tiles=[tile]), stats(df))[2])
        with pytest.raises(snapshots.Conflict):
            lake.write_lake(out, path, tiles=[tile])

    # an empty tile goes; files of dead and old runs go with a vacuum, and readers see the same
    lake.write_lake(out.limit(0), path, tiles=[tile])
    left = rows(spark, path)
    assert set(left) == {i for i in before if (before[i].tile_z, before[i].tile_x, before[i].tile_y) != tile}
    assert len(snapshots.vacuum(spark, path, keep=1)) >= 3 and rows(spark, path) == left
    assert len(snapshots.versions(spark, path)) == 1 and len(files(path)) < len(held)
    with pytest.raises(FileNotFoundError):
        lake.scan_lake(spark, str(tmp_path / "none"))


def test_cells_keep_their_state(spark, tmp_path):
    """With hysteresis, cells whose entropy moves little keep the last run's bucket; others take the new one."""
    rng = random.Random(1)
    crowd = lambda kinds: spark.createDataFrame([(f"node/{i}", {k: "x"}, bytearray(struct.pack("<BIdd", 1, 1, 36.8 + (i % 3) * 0.05 + i * 1e-7, -1.3)), "kenya") for i, k in enumerate(kinds)], "feature_id string, tags map<string,string>, geometry binary, country string")
    kinds = [rng.choice(["highway", "building", "amenity", "landuse"][: 2 + i % 3]) for i in range(600)]
    near = [k if i % 40 or i % 3 else "boundary" for i, k in enumerate(kinds)]
    far = [k if i % 3 else rng.choice(["highway", "building", "amenity", "landuse", "natural", "waterway", "boundary"]) for i, k in enumerate(kinds)]
    path = str(tmp_path / "ke/features")
    state = lambda: {r.h3_8: (r.entropy_score, r.entropy_bucket) for r in spark.read.parquet(f"{path}/_cells/{snapshots.current(spark, path)['run']}").collect()}
    pipeline.run(spark, "kenya", crowd(kinds), str(tmp_path), now=NOW)
    old = state()
    fresh = lambda k: {r.h3_8: (r.entropy_score, r.entropy_bucket) for r in metrics.cell_metrics(pipeline.stage(crowd(k), pipeline.resolve("kenya"))).collect()}
    kept = 0
    for k in (near, far):
        pipeline.run(spark, "kenya", crowd(k), str(tmp_path), now=NOW, hysteresis=True)
        want = {c: (e, old[c][1] if abs(e - old[c][0]) < 0.2 else b) for c, (e, b) in fresh(k).items()}
        kept += sum(want[c][1] != fresh(k)[c][1] for c in want)
        assert state() == want
        assert {r.h3_8: r.entropy_bucket for r in lake.scan_lake(spark, path).collect()} == {c: b for c, (_, b) in want.items()}
        old = state()
    assert kept or len(old) == 3


def test_cells_beyond_a_tile(spark, tmp_path):
    """A run on one tile counts its cells' rows in other tiles, and leaves other cells' state."""
    path = str(tmp_path / "ke/features")
    rng = random.Random(3)
    kinds = [rng.choice(["highway", "amenity", "landuse"]) for _ in range(300)]
    edge = lambda n: spark.createDataFrame([(f"node/{i}", {k: "x"}, bytearray(struct.pack("<BIdd", 1, 1, 36.5625 + (i - 150) * 2e-4, -1.3)), "kenya") for i, k in enumerate(kinds[:n])], "feature_id string, tags map<string,string>, geometry binary, country string")
    pipeline.run(spark, "kenya", edge(300), str(tmp_path), now=NOW)
    whole = rows(spark, path)
    tiles = {(r.tile_z, r.tile_x, r.tile_y) for r in whole.values()}
    assert len(tiles) == 2
    pipeline.run(spark, "kenya", edge(300), str(tmp_path), now=NOW, tiles=[min(tiles)])
    assert rows(spark, path) == whole
    assert len(spark.read.parquet(f"{path}/_cells/{snapshots.current(spark, path)['run']}").collect()) == len({r.h3_8 for r in whole.values()})


def test_adaptive_tiles(spark, tmp_path):
    rng = random.Random(2)
    points = [(36.8 + rng.gauss(0, 0.001), -1.3 + rng.gauss(0, 0.001)) for _ in range(900)] + [(rng.uniform(-170, 170), rng.uniform(-80, 80)) for _ in range(300)] + [(10.0, 10.0)] * 40
    df = spark.createDataFrame([(f"node/{i}", x, y) for i, (x, y) in enumerate(points)] + [("node/none", None, None)], "feature_id string, centroid_lng double, centroid_lat double")
    leaves = metrics.adaptive_tiles(df, 25, 2, 14)
    leaves.write.parquet(str(tmp_path / "leaves"))
    leaves = spark.read.parquet(str(tmp_path / "leaves"))
    got = {(r.tile_z, r.tile_x, r.tile_y): r.n for r in leaves.collect()}
    assert sum(got.values()) == len(points) and all(n <= 25 or z == 14 for (z, _, _), n in got.items())
    held = lambda z, x, y: sum(geo.tile_of(*p, z) == (x, y) for p in points)
    for (z, x, y), n in random.Random(4).sample(sorted(got.items()), 40):
        assert held(z, x, y) == n and (z == 2 or held(z - 1, x >> 1, y >> 1) > 25)
    placed = metrics.with_adaptive_tiles(df.withColumns({c: F.lit(0) for c in lake.TILE}), leaves, 2, 14)
    assert {(r.tile_z, r.tile_x, r.tile_y): r["count"] for r in placed.filter("centroid_lat is not null").groupBy(*lake.TILE).count().collect()} == got and placed.count() == len(points) + 1


def test_lake_of_several_zooms(spark, tmp_path):
    m = pipeline.run(spark, "kenya", source(spark, ["highway"] * 400), str(tmp_path), now=NOW, target_features=40)
    assert m["total_features"] == 400 and max(t["featureCount"] for t in m["tileKeys"]) <= 40 and len({t["z"] for t in m["tileKeys"]}) > 1
    path = str(tmp_path / "ke/features")
    box = (36.5, -1.4, 36.7, -1.2)
    seen = lake.scan_lake(spark, path, lake.tile_range(box, snapshots.current(spark, path)["zooms"], "p_"))
    inside = F.col("centroid_lng").between(box[0], box[2]) & F.col("centroid_lat").between(box[1], box[3])
    assert seen.filter(inside).count() == lake.scan_lake(spark, path).filter(inside).count() > 0 and seen.count() < 400


def test_order_in_files_and_resolutions(spark, tmp_path):
    rng = random.Random(5)
    kinds = [rng.choice(["highway", "building", "amenity"]) for _ in range(400)]
    m = pipeline.run(spark, "kenya", source(spark, kinds), str(tmp_path), now=NOW, resolutions=(8, 9))
    assert m["h3Resolutions"] == [8, 9]
    for f in files(str(tmp_path / "ke/features")):
        t = pq.ParquetFile(f).read().to_pylist()
        keys = [(r["tile_z"], r["tile_x"], r["tile_y"], r["entropy_bucket"], r["zorder_key"], -r["importance_byte"], r["feature_id"]) for r in t]
        assert keys == sorted(keys) and all(r["h3_7"] is None and r["h3_10"] is None and r["h3_8"] and r["h3_9"] for r in t)
    for bad in ((), (6, 8), (11,)):
        with pytest.raises(ValueError):
            pipeline.run(spark, "kenya", source(spark, kinds), str(tmp_path), resolutions=bad)
