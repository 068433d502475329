"""Feature classes, importance, entropy classes and heights as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags in order of precedence with the type they give, road classes, and class weights.
TYPE_OF_TAG = [("highway", "road"), ("building", "building"), ("amenity", "amenity"), ("landuse", "landuse"), ("natural", "natural"), ("waterway", "waterway"), ("boundary", "boundary")]
ROAD_CLASS = {"motorway": 1, "trunk": 2, "primary": 3, "secondary": 4, "tertiary": 5}
CLASS_WEIGHT = {
    "hospital": 0.9, "university": 0.9, "station": 0.85, "mall": 0.6, "commercial": 0.6, "residential": 0.3, "utility": 0.1,
    "civ": 0.7, "com": 0.6, "ind": 0.4, "res": 0.3, "unk": 0.1,
}
DEFAULT_WEIGHT, DEFAULT_AREA, TRAJECTORY_M = 0.1, 500.0, 5000.0
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?([nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
_N = r"([0-9]+(?:\.[0-9]+)?)"


def feature_type(tags: Column) -> Column:
    return F.coalesce(*[F.when(tags[tag].isNotNull(), F.lit(kind)) for tag, kind in TYPE_OF_TAG], F.lit("unknown"))


def road_class(highway: Column) -> Column:
    x = F.lit(6)
    for name, n in ROAD_CLASS.items():
        x = F.when(highway == name, n).otherwise(x)
    return x.cast("byte")


def try_double(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def try_int(text: Column) -> Column:
    """Whole numbers as they are, decimals and exponents rounded half away from zero, anything else null."""
    return F.coalesce(text.try_cast("int"), F.round(try_double(text)).try_cast("int"))


def importance(area: Column, building: Column, amenity: Column, occupancy: Column, neighbours: Column) -> Column:
    """0.4 area + 0.5 class + 0.1 density + 0.2 trajectory, within 0 and 1. Empty tags fall through to the next."""
    full = lambda c: F.when(c != "", c)
    tag = F.lower(F.coalesce(full(building), full(amenity), full(occupancy), F.lit("")))
    weights = F.create_map(*[F.lit(x) for kv in CLASS_WEIGHT.items() for x in kv])
    a = F.least(F.lit(1.0), F.log10(F.greatest(F.coalesce(area, F.lit(DEFAULT_AREA)), F.lit(1.0)) / 500.0 + 1.0) / 2.0)
    c = F.coalesce(weights[tag], F.lit(DEFAULT_WEIGHT))
    d = 1.0 / (1.0 + neighbours)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), a * 0.4 + c * 0.5 + d * 0.1 + 0.2 * math.exp(-TRAJECTORY_M / 500.0)))


def importance_byte(score: Column) -> Column:
    return F.rint(score * 127.0).cast("byte")


def entropy_bucket(entropy: Column, buckets: int = 10) -> Column:
    return F.least(F.floor(F.least(entropy / math.log2(10), F.lit(1.0)) * buckets), F.lit(buckets - 1)).cast("int")


def adaptive_resolution(entropy: Column, variance: Column, resolutions: tuple[int, ...] = (7, 8, 9, 10)) -> Column:
    return F.when((entropy > 2.0) | (variance > 0.25), max(resolutions)).when(entropy > 1.0, resolutions[len(resolutions) // 2]).otherwise(min(resolutions))


def hysteresis(new_entropy: Column, old_entropy: Column, new_bucket: Column, old_bucket: Column, delta: float = 0.20) -> Column:
    """The old bucket while the entropy has moved by less than delta; cells without a past take the new one."""
    return F.when(F.abs(new_entropy - old_entropy) < delta, old_bucket).otherwise(new_bucket)


def height_m(raw: Column) -> Column:
    """H:floors and HBET:low-high at 3.5 m a floor, HHT:metres, or a plain number of metres."""
    g = lambda p, i: F.regexp_extract(raw, p, i).try_cast("double")
    between = rf"^HBET:{_N}-{_N}$"
    return F.when(raw.rlike(f"^H:{_N}$"), g(f"^H:{_N}$", 1) * 3.5).when(raw.rlike(between), (g(between, 1) + g(between, 2)) / 2.0 * 3.5).when(raw.rlike(f"^HHT:{_N}$"), g(f"^HHT:{_N}$", 1)).otherwise(try_double(raw))


def height_floors(raw: Column) -> Column:
    g = lambda p, i: F.regexp_extract(raw, p, i).try_cast("double")
    between = rf"^HBET:{_N}-{_N}$"
    return F.when(raw.rlike(f"^H:{_N}$"), g(f"^H:{_N}$", 1)).when(raw.rlike(between), (g(between, 1) + g(between, 2)) / 2.0).when(raw.rlike(f"^HHT:{_N}$"), g(f"^HHT:{_N}$", 1) / 3.5).otherwise(try_double(raw) / 3.5)


def height_m_raw_path(raw: Column) -> Column:
    """The unenriched path's reading: HBET at 3.0 m a floor or a plain number; other encodings are null."""
    between = rf"^HBET:{_N}-{_N}$"
    g = lambda i: F.regexp_extract(raw, between, i).try_cast("double")
    return F.when(raw.rlike(between), (g(1) + g(2)) / 2.0 * 3.0).otherwise(try_double(raw))


def zorder_key(cell_long: Column, feature_id: Column) -> Column:
    """Cell first, then a hash of the id, both within 31 bits."""
    m = F.lit((1 << 31) - 1).cast("long")
    h = F.xxhash64(feature_id)
    return F.when(cell_long.isNotNull(), F.pmod(cell_long, m) * F.lit(1 << 31).cast("long") + F.pmod(h, m)).otherwise(h.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def partition_run_id(cell_hex: Column, minute: str) -> Column:
    """minute: UTC as yyyymmddThhmm, taken once a run."""
    return F.substring(F.sha2(F.concat(F.coalesce(cell_hex, F.lit("")), F.lit(f":{minute}")), 256), 1, 16)


def fetch_priority(entropy: Column, size: Column) -> Column:
    return F.when((entropy > 1.5) & (size > 50_000), "immediate").when(size < 5_000, "defer").otherwise("background")
