"""From tables to flags: reading, selecting, flagging, reporting and writing, in one call or from the command line."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietsky.operators import stats
from quietsky.plans import strategy
from quietsky.sources import tables


@dataclass(frozen=True)
class Options:
    """What to flag, and how; the defaults flag all of `data` by the default strategies. stored: the main table's name in the catalog, in place of the folder's."""

    data_column: str = "data"
    subtract_column: str | None = None
    mode: str = "total_power"
    scans: str | None = None
    field_names: list[str] = field(default_factory=list)
    ignore_flags: bool = False
    strategy_file: str | None = None
    mask_file: str = ""
    mask_folders: tuple[str, ...] = ()
    dilate: str | None = None
    stored: str | None = None


def strategies_of(options: Options) -> list[dict]:
    """The file's steps, or the default ones, checked before anything is read."""
    steps = strategy.DEFAULT if options.strategy_file is None else tables.load_strategies(options.strategy_file)
    strategy.checked(steps)
    return steps


def masks_of(spark: SparkSession, options: Options) -> DataFrame | None:
    """mask_id and freq_hz of what the mask files mask, dilated; None without files."""
    files = tables.find_masks(options.mask_file, options.mask_folders)
    return tables.read_masks(spark, files, options.dilate).where("masked").select("mask_id", "freq_hz") if files else None


def flag_tables(main: DataFrame, side: dict[str, DataFrame], options: Options, masks: DataFrame | None = None, strategies: list[dict] | None = None, counted: bool = False) -> DataFrame:
    """By the given strategies or those of the options, new flags of the rows of main that the options select; channels, correlations, fields and antennas come from the side tables."""
    return strategy.flag(
        main, tables.channels_of(side), tables.correlations_of(side), strategies=strategies_of(options) if strategies is None else strategies, mode=options.mode, scans=options.scans, fields=side["field"],
        field_names=options.field_names, antennas=side["antenna"], masks=masks, ignore_flags=options.ignore_flags, with_model=options.subtract_column is not None,
        counted=counted, in_place=options.stored is not None,
    )


def flag_and_commit(spark: SparkSession, path: str, out: str, options: Options, strategies: list[dict] | None = None) -> str:
    """Flags the tables in the folder `path` (main, unless it is a stored one, and the side tables), commits flags and counts to out, and returns the version.

    A selection that no row meets raises ValueError before anything is written. Samples are read once: the tasks that flag windows count them too.
    """
    steps = strategies_of(options) if strategies is None else strategies
    side = tables.read_side_tables(spark, path)
    columns = (options.data_column, options.subtract_column)
    main = tables.read_stored(spark, options.stored, *columns) if options.stored else tables.read_visibilities(spark, f"{path}/main", *columns)
    if strategy.selected(main, options.scans, side["field"], options.field_names).isEmpty():
        raise ValueError(f"no rows with scans {options.scans or 'all'} and fields {options.field_names or 'all'}")
    return tables.commit_flags(flag_tables(main, side, options, masks_of(spark, options), steps, counted=True), out)


def counts(spark: SparkSession, path: str, out: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Flagged samples after and before a run that committed version, by antenna, baseline, field, scan and stretch of frequency.

    They are those of windows, as the steps see them: one quantity for all correlations unless the mode is standard, times that only other baselines have
    flagged, of repeated rows the last, and without a row's own flags if these are ignored.
    """
    side, base = tables.read_side_tables(spark, path), tables.read_counts(spark, out, version)
    after, before = (base.select(*tables.BASELINE, "chan", F.col(c).alias("flagged"), "size") for c in ("after", "before"))
    return tuple(stats.dimensions(b, side["antenna"], tables.channels_of(side), side["field"]) for b in (after, before))


def run(spark: SparkSession, path: str, out: str, options: Options) -> list[str]:
    """flag_and_commit(), and the report of its counts, with the edges of the bins."""
    steps = strategies_of(options)
    version = flag_and_commit(spark, path, out, options, steps)
    edges = stats.edge_lines(tables.channels_of(tables.read_side_tables(spark, path)))
    return [f"{len(steps)} steps", *stats.report(*counts(spark, path, out, version)), *edges]


def parsed(arguments: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quietsky", description="Finds and flags interference in visibility tables.")
    p.add_argument("tables", help="folder with main and the side tables, as Parquet")
    p.add_argument("flags", help="folder for the flags, by field, data description and scan")
    p.add_argument("--data-column", default="data")
    p.add_argument("--subtract-column", help="model to subtract before flagging")
    p.add_argument("--mode", default="total_power", choices=["standard", *strategy.MODES])
    p.add_argument("--scans", help="numbers and ranges, such as 1,4~6; all without it")
    p.add_argument("--fields", action="append", default=[], help="names or numbers; again for more")
    p.add_argument("--ignore-flags", action="store_true")
    p.add_argument("--strategies", help="YAML file; the default list without it")
    p.add_argument("--mask", default="", help="a mask file")
    p.add_argument("--mask-folder", action="append", default=[])
    p.add_argument("--dilate", help="channels or a bandwidth by which masks grow to each side")
    p.add_argument("--stored", help="name of a stored main table, in place of the folder's")
    return p.parse_args(arguments)


def main(arguments: list[str] | None = None) -> None:
    a = parsed(arguments)
    options = Options(a.data_column, a.subtract_column, a.mode, a.scans, a.fields, a.ignore_flags, a.strategies, a.mask, tuple(a.mask_folder), a.dilate, a.stored)
    spark = SparkSession.builder.appName("quietsky").getOrCreate()
    print("\n".join(run(spark, a.tables, a.flags, options)))
