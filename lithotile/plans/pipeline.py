"""The batch plan: source rows to a partitioned lake with a manifest."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..sources import lake, snapshots
from ..sources.registry import BUILDINGS, DATASETS, BuildingDataset, Dataset
from ..sources.shared import bounded_join, folder


def resolve(key: str) -> Dataset | BuildingDataset:
    if key in DATASETS:
        return DATASETS.get(key)
    if key in BUILDINGS:
        return BUILDINGS.get(key)
    raise ValueError(f"unknown dataset {key!r}; known: {', '.join([*DATASETS, *BUILDINGS])}")


def plan(source: DataFrame, dataset: Dataset | BuildingDataset, zoom: int = 10, now: datetime | None = None, **options) -> DataFrame:
    """The lake's rows, lazily: decode, cells, metrics, importance."""
    now = now or datetime.now(timezone.utc)
    return metrics.enrich(stage(source, dataset, zoom), now.strftime("%Y%m%dT%H%M"), **options)


def stage(source: DataFrame, dataset: Dataset | BuildingDataset, zoom: int = 10, order_by: int = 8) -> DataFrame:
    return (metrics.stage_buildings if isinstance(dataset, BuildingDataset) else metrics.stage_features)(source, dataset, zoom, order_by=order_by)


def run(
    spark: SparkSession, key: str, source: DataFrame, root: str | None = None, zoom: int = 10, resolutions: tuple[int, ...] = (7, 8, 9, 10), now: datetime | None = None,
    *, tiles: list[tuple[int, int, int]] | None = None, target_features: int | None = None, hysteresis: bool = False,
) -> dict:
    """Write a new version of the lake with its manifest and its cells' state; returns the manifest.

    Geometry is decoded once: staged rows are written to the shared folder, and density, metrics and the range sampling of
    the writer read them there. resolutions: those whose cells are stored, of 7 to 10; the second one (or the only one) orders rows.
    tiles: only these tiles are written, from the source's rows in them; metrics of their cells count the rows of the cells in
    other tiles too. target_features: tiles of several zooms, with at most so many features each. hysteresis: cells whose entropy has
    moved little keep the bucket that the version before has. Cells that this run doesn't touch keep the state they have.
    """
    if not resolutions or not set(resolutions) <= set(metrics.RESOLUTIONS):
        raise ValueError("the lake stores resolutions 7 to 10")
    if tiles is not None and target_features is not None:
        raise ValueError("tiles of several zooms are chosen over the whole lake")
    dataset = resolve(key)
    path = lake.lake_path(dataset, root).rstrip("/")
    now = now or datetime.now(timezone.utc)
    work = folder(spark)
    stage(source, dataset, zoom, resolutions[1] if len(resolutions) > 1 else resolutions[0]).write.parquet(f"{work}/staged")
    staged = spark.read.parquet(f"{work}/staged")
    before = snapshots.current(spark, path)
    rows, around, density = staged, staged, None
    if tiles is not None:
        rows = staged.filter(lake.in_tiles(tiles))
        of = lambda c: bounded_join(staged, rows.select(c).distinct(), [c], "left_semi")
        around, density = of("h3_8"), metrics.cell_density(of("h3_9"))
    if target_features is not None:
        metrics.adaptive_tiles(staged, target_features).write.parquet(f"{work}/leaves")
        rows = metrics.with_adaptive_tiles(staged, spark.read.parquet(f"{work}/leaves"))
    state = metrics.cell_metrics(around)
    old = spark.read.parquet(f"{path}/_cells/{before['run']}") if before and before.get("cells") else None
    if hysteresis and old is not None:
        state = metrics.damped(state, old)
    state.write.parquet(f"{work}/state")
    state = spark.read.parquet(f"{work}/state")
    out = metrics.enrich(rows, now.strftime("%Y%m%dT%H%M"), metrics=state, density=density)
    out = out.withColumns({f"h3_{r}": F.lit(None).cast("string") for r in metrics.RESOLUTIONS if r not in resolutions})
    subdir = "buildings/" if isinstance(dataset, BuildingDataset) else ""

    def cells(run: str) -> bool:
        kept = state if old is None or tiles is None else old.join(state, "h3_8", "left_anti").unionByName(state)
        kept.write.parquet(f"{path}/_cells/{run}")
        return True

    def manifest(run: str) -> bool:
        document = lake.manifest_document(spark.read.parquet(f"{path}/_tiles/{run}"), dataset.country, zoom, resolutions, subdir, now)
        document.write.option("lineSep", "\n").text(f"{path}/_manifests/{run}")
        return True

    lake.write_lake(out, path, tiles=tiles, cells=cells, manifest=manifest)
    return lake.read_manifest(spark, path)


def largest_tiles(stats: DataFrame, n: int = 10) -> DataFrame:
    return stats.orderBy(F.desc("feature_count"), *lake.TILE).limit(n)
