"""Selecting scans, fields and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietsky.functions.grammar import length_range, number_list


def by_scan(df: DataFrame, scans: list[int] | str | None) -> DataFrame:
    """Keeps the asked scans that there are; None and `*` are all."""
    wanted = number_list(scans) if isinstance(scans, str) else scans
    return df if wanted is None else df.where(F.col("scan_number").isin(wanted))


def by_field(df: DataFrame, fields: DataFrame, wanted: list[str] | None) -> DataFrame:
    """Keeps fields by name, or by number where that is in range; each entry may be a comma list. An unknown one raises ValueError."""
    if not wanted:
        return df
    known = {r["field_id"]: r["name"] for r in fields.select("field_id", "name").collect()}  # a row for each field
    ids = set()
    for w in (p.strip() for item in wanted for p in item.split(",")):
        own = {i for i, n in known.items() if n == w} or ({int(w)} if w.isdigit() and int(w) in known else set())
        if not own:
            raise ValueError(f"no field {w!r}")
        ids |= own
    return df.where(F.col("field_id").isin(sorted(ids)))


def baselines_in_range(baselines: DataFrame, antennas: DataFrame, uvrange: str) -> DataFrame:
    """baselines(antenna1, antenna2) whose halved squared length lies between the squared ends of uvrange, ends included, in whichever order they stand."""
    lo, hi = sorted(length_range(uvrange))
    p = [F.broadcast(antennas.select(F.col("antenna_id").alias(f"antenna{i}"), F.col("position").alias(f"_p{i}"))) for i in (1, 2)]
    d2 = 0.5 * F.aggregate(F.zip_with("_p1", "_p2", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return baselines.join(p[0], "antenna1").join(p[1], "antenna2").where(d2.between(lo * lo, hi * hi)).select(baselines.columns)
