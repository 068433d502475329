"""Features of GeoJSON files by byte ranges against json.load, for ranges of a few bytes."""

import json
import random

import pytest

from lithotile.operators import exporters
from lithotile.sources import geojson


def collection(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(['"', "\\", "{", "}", "[", "]", ":", ",", " ", "a", "é", "\n", "features", "漢"], k=rng.randint(0, 8)))

    def value(depth=0):
        kind = rng.randint(0, 6 if depth < 3 else 4)
        return [word(), rng.random(), None, True, rng.randint(-5, 5)][kind] if kind < 5 else [value(depth + 1) for _ in range(rng.randint(0, 3))] if kind == 5 else {word(): value(depth + 1) for _ in range(rng.randint(0, 3))}

    def feature():
        if rng.random() < 0.1:
            return {}
        point = {"type": "Point", "coordinates": [rng.randint(0, 9), rng.randint(0, 9)]} if rng.random() < 0.8 else None
        return {"id": rng.randint(0, 99), "type": "Feature", "geometry": point, "properties": {word(): value() for _ in range(rng.randint(0, 4))}, "features": [{"x": 1}]}

    top = {"type": "FeatureCollection", word() + "1": [{"no": {"features": [{"z": 1}]}}], "name}": "a } b", "crs": {"features": [{"y": 2}]}, "features": [feature() for _ in range(rng.randint(8, 20))], word() + "2": [{"more": 1}], "other": value()}
    keys = list(top)
    rng.shuffle(keys)
    return {k: top[k] for k in keys}


@pytest.mark.parametrize(("size", "step"), [(900, 64), (1 << 20, 1 << 20)])
def test_features_equal_json_load(spark, tmp_path, monkeypatch, size, step):
    monkeypatch.setattr(geojson, "STEP", step)
    want = []
    for seed in range(3):
        c = collection(seed)
        text = json.dumps(c, indent=random.Random(seed).choice([None, 1]), ensure_ascii=seed % 2 == 0)
        (tmp_path / f"{seed}.json").write_text(text + "\n" * (seed % 3))
        want += json.loads(text)["features"]
    (tmp_path / "none.json").write_text('{"features": {"a": {"b": {}}}, "x": []}')
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        found = geojson.read_features(spark, str(tmp_path))
        got = [json.loads(r.text) for r in found.collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    order = lambda v: json.dumps(v, sort_keys=True)
    assert sorted(map(order, got)) == sorted(map(order, want)) and len(want) > 20


def test_rows_of_a_large_file_come_from_many_tasks(spark, tmp_path):
    path = tmp_path / "big.json"
    with open(path, "w") as f:
        f.write('{"type": "FeatureCollection", "features": [')
        f.write(", ".join(json.dumps({"type": "Feature", "id": i, "geometry": {"type": "LineString", "coordinates": [[i, 0], [0, 1]]}, "properties": {"n": i, f"k{i % 3}": "v}{"}}) for i in range(20_000)))
        f.write("]}")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200_000)
    try:
        df = exporters.read_geojson(spark, str(path))
        assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 8
        assert df.columns == ["id", "type", "geometry_type", "geometry_wkt", "prop_k0", "prop_k1", "prop_k2", "prop_n"]
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(int(r.id) for r in rows) == list(range(20_000)) and all(r.prop_n == r.id and r[f"prop_k{int(r.id) % 3}"] == "v}{" for r in rows)
    assert rows[0].geometry_wkt == f"LINESTRING ({rows[0].id} 0, 0 1)"
