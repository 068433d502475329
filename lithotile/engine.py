"""The query service as plain methods: each returns a DataFrame or a dict."""

from __future__ import annotations

import time
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .functions import zoom as Z
from .operators import viewport as V
from .sources import lake, snapshots
from .sources import registry as R


class Engine:
    def __init__(self, spark: SparkSession, tile_zoom: int = 10):
        self.spark, self.tile_zoom = spark, tile_zoom

    def info(self) -> dict:
        return {"name": "lithotile", "datasets": R.DATASETS.keys(), "building_datasets": R.BUILDINGS.keys(), "towns": len(R.TOWNS), "spark": self.spark.version}

    def health(self) -> dict:
        start = time.perf_counter()
        self.spark.range(1).count()
        return {"status": "healthy", "latency_ms": round((time.perf_counter() - start) * 1000, 2), "views": lake.list_views(self.spark)}

    def zoom(self, zoom: int, lat: float = 0.0) -> dict:
        return Z.describe(zoom, lat)

    def datasets(self) -> dict:
        return {k: asdict(d) for k, d in R.DATASETS.items()}

    def building_datasets(self) -> dict:
        return {k: asdict(d) for k, d in R.BUILDINGS.items()}

    def dataset(self, key: str) -> dict:
        return asdict(R.DATASETS.get(key)) | {"views": self.views(key), "towns": [k for k, _ in R.towns_of(key)]}

    def building_dataset(self, key: str) -> dict:
        b = R.BUILDINGS.get(key)
        return asdict(b) | {"views": self.views(key), "towns": [k for k, _ in R.towns_of(b.osm_dataset_key)] if b.osm_dataset_key else []}

    def views(self, key: str) -> list[str]:
        return [v for v in lake.list_views(self.spark) if v.startswith(key.replace("-", "_") + "_")]

    def towns(self) -> DataFrame:
        return R.towns_df(self.spark)

    def town(self, key: str) -> dict:
        return asdict(R.TOWNS.get(key))

    def town_bbox_params(self, key: str, zoom: int | None = None) -> dict:
        return R.TOWNS.get(key).bbox_params(zoom)

    def town_buildings_params(self, key: str, zoom: int | None = None) -> dict:
        t = R.TOWNS.get(key)
        found = R.buildings_of(t.dataset_key) if t.dataset_key else None
        if found is None:
            raise ValueError(f"no building dataset for town {key!r}")
        return t.bbox_params(found[1].zoom_gate if zoom is None else zoom) | {"dataset": found[0]}

    def town_cell_params(self, key: str, resolution: int = 9, zoom: int | None = None) -> dict:
        return R.TOWNS.get(key).cell_params(resolution, zoom)

    def query_bbox(self, dataset: str, box: V.Box, zoom: int | None = None, limit: int | None = None) -> DataFrame:
        d = R.DATASETS.get(dataset)
        tiles = lake.tile_range(V.check_box(box), self._zooms(lake.features_path(d)), "p_")
        return V.query_bbox(lake.scan_features(self.spark, d, tiles), box, zoom, limit)

    def query_h3(self, dataset: str, cell: str, resolution: int | None = None, zoom: int | None = None, limit: int | None = None) -> DataFrame:
        d = R.DATASETS.get(dataset)
        tiles = lake.cell_tiles(V.check_cell(cell), self._zooms(lake.features_path(d)))
        return V.query_h3(lake.scan_features(self.spark, d, tiles), cell, resolution, zoom, limit)

    def _zooms(self, path: str) -> list[int]:
        """Zooms of the tiles that a lake has; the usual one where there is no lake, whose scan then says so."""
        version = snapshots.current(self.spark, path)
        return version["zooms"] if version else [self.tile_zoom]

    def query_buildings(self, dataset: str, box: V.Box, zoom: int, **options) -> DataFrame:
        b = R.BUILDINGS.get(dataset)
        V.check_gate(zoom, b)
        return V.query_buildings(self._buildings(b, box, options.get("mode", "cells")), b, box, zoom, **options)

    def building_stats(self, dataset: str, box: V.Box, zoom: int, **options) -> DataFrame:
        b = R.BUILDINGS.get(dataset)
        V.check_gate(zoom, b)
        return V.building_stats(self._buildings(b, box), b, box, zoom, **options)

    def _buildings(self, b: R.BuildingDataset, box: V.Box, mode: str = "cells") -> DataFrame:
        """Rows of cells whose centre lies in the box may lie a little beyond it, so tiles are pruned by a wider box."""
        V.check_box(box)
        if not b.h3_enriched:
            return lake.scan_buildings(self.spark, b)
        wide = box if mode == "box" else V.around_cells(box, 9)
        return lake.scan_buildings(self.spark, b, tiles=lake.tile_range(wide, self._zooms(b.enriched_path()), "p_") if wide else None)

    def read_tile(self, dataset: str, z: int, x: int, y: int) -> DataFrame:
        """The rows of a tile; a tile that the lake does not hold is not found."""
        rows = lake.read_tile(self.spark, lake.lake_path(R.DATASETS.get(dataset)), z, x, y)
        if rows.isEmpty():
            raise V.QueryError(f"the lake of {dataset} has no tile {z}/{x}/{y}", "NOT_FOUND", dataset=dataset, z=z, x=x, y=y)
        return rows

    def read_manifest(self, dataset: str) -> dict:
        try:
            return lake.read_manifest(self.spark, lake.lake_path(R.DATASETS.get(dataset)))
        except (AnalysisException, FileNotFoundError) as e:
            raise V.QueryError(f"the lake of {dataset} has no manifest", "NOT_FOUND", dataset=dataset) from e
