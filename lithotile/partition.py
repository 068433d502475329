"""Command line: python -m lithotile.partition --dataset KEY (--source PATH | --table NAME) [--output ROOT] [--zoom N] [--target-features N] [--tiles Z/X/Y ...] [--hysteresis] [--dry-run]."""

from __future__ import annotations

import argparse

from .plans import pipeline
from .session import local_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--dataset", required=True)
    rows = p.add_mutually_exclusive_group(required=True)
    rows.add_argument("--source", help="Parquet path of the source rows")
    rows.add_argument("--table", help="table or view of the session's catalog that holds them")
    p.add_argument("--output")
    p.add_argument("--zoom", type=int, default=10)
    p.add_argument("--h3-resolutions", type=int, nargs="+", default=[7, 8, 9, 10])
    p.add_argument("--target-features", type=int, help="tiles of several zooms with at most so many features each, instead of tiles of one zoom")
    p.add_argument("--tiles", nargs="+", help="Z/X/Y of the tiles to write again; the others stay")
    p.add_argument("--hysteresis", action="store_true", help="cells whose entropy has moved little keep their bucket")
    p.add_argument("--dry-run", action="store_true")
    a = p.parse_args(argv)
    try:
        print(pipeline.resolve(a.dataset))
        if a.dry_run:
            return 0
        tiles = [tuple(map(int, t.split("/"))) for t in a.tiles] if a.tiles else None
        spark = local_session()
        m = pipeline.run(spark, a.dataset, spark.read.parquet(a.source) if a.source else spark.table(a.table), a.output, a.zoom, tuple(a.h3_resolutions), tiles=tiles, target_features=a.target_features, hysteresis=a.hysteresis)
    except ValueError as e:
        print(e)
        return 1
    print(f"{m['total_features']} features in {m['tile_count']} tiles")
    for t in sorted(m["tileKeys"], key=lambda t: -t["featureCount"])[:10]:
        print(f"  {t['z']}/{t['x']}/{t['y']}: {t['featureCount']} features, {t['compressedSizeBytes']} bytes, {t['fetchPriority']}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
