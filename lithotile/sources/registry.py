"""Datasets, building datasets and towns: frozen configurations in registries."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_
from typing import Generic, TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]
X = TypeVar("X")


def lake_root() -> str:
    return os.environ.get("LITHOTILE_LAKE_ROOT", "./lake").rstrip("/")


class Registry(Generic[X]):
    """Named configurations. Names are unique; unknown names raise ValueError."""

    def __init__(self, kind: str):
        self.kind, self._items = kind, {}

    def register(self, key: str, item: X) -> None:
        if key in self._items:
            raise ValueError(f"{self.kind} {key!r} is registered already")
        self._items[key] = item

    def deregister(self, key: str) -> None:
        self._items.pop(key, None)

    def get(self, key: str) -> X:
        if key not in self._items:
            raise ValueError(f"unknown {self.kind} {key!r}; known: {', '.join(self.keys())}")
        return self._items[key]

    def keys(self) -> list[str]:
        return sorted(self._items)

    def items(self) -> list[tuple[str, X]]:
        return sorted(self._items.items())

    def __contains__(self, key: str) -> bool:
        return key in self._items

    def __len__(self) -> int:
        return len(self._items)

    def __iter__(self) -> Iterator[str]:
        return iter(self.keys())


@dataclass(frozen=True)
class Dataset:
    country: str
    base_path: str
    h3_resolutions: tuple[int, ...] = (7, 8, 9, 10)
    country_filter: str | None = None
    bbox: Box | None = None

    def parquet_glob(self) -> str:
        return f"{self.base_path.rstrip('/')}/**/*.parquet"

    def source_filter(self, geometry: str = "geometry", country: str = "country") -> Column:
        """Rows with a geometry, of the country if one is set. The box is a second step, on decoded geometry."""
        x = F.col(geometry).isNotNull()
        return x & (F.col(country) == self.country_filter) if self.country_filter else x


@dataclass(frozen=True)
class BuildingDataset:
    country: str
    base_path: str
    osm_dataset_key: str | None = None
    quadkey_prefixes: tuple[str, ...] = ()
    zoom_gate: int = 14
    h3_enriched: bool = False
    utm_epsg: int = 32637
    has_height: bool = True
    has_occupancy: bool = True
    h3_resolutions: tuple[int, ...] = field(default=(7, 8, 9, 10))

    def parquet_glob(self) -> str:
        return f"{self.base_path.rstrip('/')}/**/*.parquet"

    def enriched_path(self, root: str | None = None) -> str:
        return f"{(root or lake_root()).rstrip('/')}/{self.country.lower()}/buildings"

    def enriched_parquet_glob(self, root: str | None = None) -> str:
        return f"{self.enriched_path(root)}/**/*.parquet"

    def quadkey_filter(self, prefix: str | None = None, column: str = "quadkey") -> Column:
        """The caller's prefix, else the dataset's, else no filter; pushed to Parquet as prefixes."""
        prefixes = [prefix] if prefix else list(self.quadkey_prefixes)
        return reduce(or_, [F.col(column).startswith(p) for p in prefixes]) if prefixes else F.lit(True)


def view_name(key: str, tier: str = "view") -> str:
    """Names of views: hyphens are not fit for unquoted SQL."""
    return f"{key.replace('-', '_')}_{tier}"


@dataclass(frozen=True)
class Town:
    """A named viewport: centre and half extents in degrees."""

    name: str
    lat: float
    lng: float
    lat_extent: float
    lng_extent: float
    dataset_key: str | None = None
    country_code: str | None = None

    def __post_init__(self) -> None:
        if not (-90 <= self.lat <= 90 and -180 <= self.lng <= 180):
            raise ValueError(f"{self.name}: centre outside the world")
        if self.lat_extent <= 0 or self.lng_extent <= 0:
            raise ValueError(f"{self.name}: extents must be positive")
        if self.lat_extent * 2 > 10 or self.lng_extent * 2 > 10:
            raise ValueError(f"{self.name}: wider than 10 degrees")

    @property
    def bbox(self) -> Box:
        return self.lng - self.lng_extent, self.lat - self.lat_extent, self.lng + self.lng_extent, self.lat + self.lat_extent

    @property
    def area_km2(self) -> float:
        """With 111.32 km to a degree both ways, as the town model reports it."""
        import math

        return 2 * self.lat_extent * 111.32 * 2 * self.lng_extent * 111.32 * math.cos(math.radians(self.lat))

    def bbox_params(self, zoom: int | None = None) -> dict:
        if self.dataset_key is None:
            raise ValueError(f"{self.name} has no dataset")
        sw_lng, sw_lat, ne_lng, ne_lat = self.bbox
        return {"dataset": self.dataset_key, "sw_lng": sw_lng, "sw_lat": sw_lat, "ne_lng": ne_lng, "ne_lat": ne_lat} | ({"zoom": zoom} if zoom is not None else {})

    def cell_params(self, resolution: int = 9, zoom: int | None = None) -> dict:
        from ..functions import h3

        if self.dataset_key is None:
            raise ValueError(f"{self.name} has no dataset")
        return {"dataset": self.dataset_key, "h3_cell": h3.to_hex(h3.latlng_to_cells([self.lat], [self.lng], (resolution,))[0])[0], "resolution": resolution} | ({"zoom": zoom} if zoom is not None else {})


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-")


# Key, name, latitude, longitude, half extents, dataset and country of the hand-picked towns.
CURATED = """
nairobi|Nairobi|-1.2921|36.8219|0.18|0.22|kenya|KE
mombasa|Mombasa|-4.0435|39.6682|0.10|0.12|kenya|KE
kisumu|Kisumu|-0.1022|34.7617|0.08|0.10|kenya|KE
las-palmas|Las Palmas de Gran Canaria|28.1235|-15.4366|0.10|0.12|canary|ES
santa-cruz|Santa Cruz de Tenerife|28.4636|-16.2518|0.10|0.12|canary|ES
prague|Prague|50.0755|14.4378|0.07|0.12||CZ
"""
# Name, latitude and longitude of the listed towns, all of dataset kenya.
LISTED = """
Bomet -0.719605 35.239962; Bungoma 0.782925 34.719168; Busia 0.371205 34.264795; Chuka -0.225222 37.423263; Eldoret 0.519833 35.271548;
Embu -0.535948 37.665288; Garissa -0.523633 40.356405; Hola -1.497681 40.034911; Homa Bay -0.56396 34.318782; Isiolo 1.00606 38.747895;
Iten 0.67307 35.510263; Kabarnet 0.496524 35.743139; Kajiado -2.121717 36.786255; Kakamega 0.49571 34.801549; Kapenguria 1.252252 35.090992;
Kapsabet 0.200498 35.10115; Kericho -0.320997 35.226128; Kerugoya -0.49633 37.278584; Kiambu -1.036395 36.843131; Kilifi -3.150739 39.675072;
Kisii -0.738942 34.753985; Kisumu -0.108233 34.751699; Kitale 1.018076 35.000236; Kitui -1.564222 38.372812; Kwale -4.183607 39.105095;
Lamu -2.267496 40.901038; Lodwar 3.116586 35.602294; Machakos -1.279005 37.39527; Malindi -3.220861 40.10005; Mandera 3.228533 40.705615;
Maralal 1.1 36.7; Marsabit 2.857958 37.715489; Mbale 0.083501 34.720326; Meru 0.225451 37.777262; Migori -1.019224 34.309543;
Mombasa -4.05052 39.667169; Murang'a -0.723656 37.157586; Nairobi -1.302398 36.828851; Naivasha -0.722442 36.438783; Nakuru -0.280272 36.071205;
Nanyuki 0.01403 37.074632; Narok -1.277937 35.477423; Nyamira -0.651791 34.934167; Nyeri -0.419296 36.951701; Ol Kalou -0.289173 36.314787;
Siaya -0.060401 34.200135; Thika -1.180695 36.930847; Wajir 1.93944 40.024736; Wote -1.780317 37.629035; Wundanyi -3.064856 38.180552
"""
# Half extents (lat, lng) of listed towns; all others have 0.08 and 0.10.
EXTENTS = {"Nairobi": (0.18, 0.22), "Nakuru": (0.12, 0.14), "Mombasa": (0.10, 0.12), "Eldoret": (0.10, 0.12)}

DATASETS: Registry[Dataset] = Registry("dataset")
BUILDINGS: Registry[BuildingDataset] = Registry("building dataset")
TOWNS: Registry[Town] = Registry("town")


def register_town(key: str, town: Town, on_conflict: str = "skip") -> bool:
    """Whether it was added. on_conflict: skip keeps the town that is there, raise refuses."""
    if key in TOWNS and on_conflict == "skip":
        return False
    TOWNS.register(key, town)
    return True


def import_towns(spark: SparkSession, path: str, dataset_key: str | None, country_code: str, on_conflict: str = "skip") -> dict[str, str]:
    """Register the towns of a CSV file with the header name,lat,lng,lat_extent,lng_extent; both extents may be empty.

    Coordinates are rounded to 6 digits and extents default as for listed towns. Gives for each key: added, kept (the key was
    there) or the error, which does not stop the others. A town list is for people to choose from, so it fits the driver.
    """
    out = {}
    for r in spark.read.csv(path, "name string, lat double, lng double, lat_extent double, lng_extent double", header=True).collect():
        key = slug(r.name or "")
        try:
            if not key or r.lat is None or r.lng is None:
                raise ValueError("a town needs a name, a latitude and a longitude")
            a, b = EXTENTS.get(r.name, (0.08, 0.10))
            town = Town(r.name, round(r.lat, 6), round(r.lng, 6), a if r.lat_extent is None else r.lat_extent, b if r.lng_extent is None else r.lng_extent, dataset_key, country_code)
            out[key] = "added" if register_town(key, town, on_conflict) else "kept"
        except ValueError as e:
            out[key] = str(e)
    return out


def _fill() -> None:
    env = os.environ.get
    DATASETS.register("canary", Dataset("ES", env("LITHOTILE_DATASET_CANARY", f"{lake_root()}/es/"), country_filter="canary-islands"))
    DATASETS.register("kenya", Dataset("KE", env("LITHOTILE_DATASET_KENYA", f"{lake_root()}/ke/"), country_filter="kenya"))
    raw = env("LITHOTILE_BUILDINGS_ROOT", "s3a://us-west-2.opendata.source.coop/tge-labs/openbuildingmap/")
    BUILDINGS.register("kenya-buildings", BuildingDataset("KE", env("LITHOTILE_BUILDINGS_KENYA", raw), "kenya", ("1223", "1232", "1233"), utm_epsg=32637))
    BUILDINGS.register("canary-buildings", BuildingDataset("ES", env("LITHOTILE_BUILDINGS_CANARY", raw), "canary", ("1202", "1203"), utm_epsg=32628))
    for line in CURATED.strip().splitlines():
        key, name, lat, lng, a, b, dataset, country = line.split("|")
        TOWNS.register(key, Town(name, float(lat), float(lng), float(a), float(b), dataset or None, country))
    for entry in LISTED.replace("\n", " ").split(";"):
        name, lat, lng = entry.strip().rsplit(" ", 2)
        a, b = EXTENTS.get(name, (0.08, 0.10))
        register_town(slug(name), Town(name, float(lat), float(lng), a, b, "kenya", "KE"))


_fill()


def towns_df(spark: SparkSession) -> DataFrame:
    rows = [(k, t.name, t.lat, t.lng, t.lat_extent, t.lng_extent, t.dataset_key, t.country_code) for k, t in TOWNS.items()]
    return spark.createDataFrame(rows, "key string, name string, lat double, lng double, lat_extent double, lng_extent double, dataset_key string, country_code string")


def building_datasets_df(spark: SparkSession) -> DataFrame:
    rows = [(k, b.country, b.osm_dataset_key, b.zoom_gate, b.utm_epsg, b.h3_enriched) for k, b in BUILDINGS.items()]
    return spark.createDataFrame(rows, "building_key string, country string, osm_dataset_key string, zoom_gate int, utm_epsg int, h3_enriched boolean")


def towns_of(dataset_key: str) -> list[tuple[str, Town]]:
    return [(k, t) for k, t in TOWNS.items() if t.dataset_key == dataset_key]


def buildings_of(dataset_key: str) -> tuple[str, BuildingDataset] | None:
    return next(((k, b) for k, b in BUILDINGS.items() if b.osm_dataset_key == dataset_key), None)
