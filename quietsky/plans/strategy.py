"""Strategies: lists of flagging steps, applied to windows in one pass, and the way from tables to flags."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietsky.functions import stokes
from quietsky.functions.complexes import residual
from quietsky.functions.grammar import length_range
from quietsky.operators import flags as native
from quietsky.operators import kernels, packing, selection

TASKS = ("flag_nans_zeros", "flag_autos", "unflag", "combine_with_input_flags", "apply_static_mask", "sum_threshold", "uvcontsub_flagger")


# The steps of the default list and their parameters. What a step does not name has the default of its flagger.
DEFAULT = [
    {"name": "missing", "task": "flag_nans_zeros"},
    {"name": "known interference", "task": "apply_static_mask", "kwargs": {"accumulation_mode": "or", "uvrange": ""}},
    {
        "name": "outliers",
        "task": "sum_threshold",
        "kwargs": {
            "outlier_nsigma": 10, "windows_freq": [1, 2, 4, 8], "spike_width_time": 12.5, "spike_width_freq": 10.0, "background_iterations": 5, "num_major_iterations": 5,
        },
    },
    {"name": "far from the fit", "task": "uvcontsub_flagger", "kwargs": {"major_cycles": 7, "or_original_from_cycle": 1, "taylor_degrees": 20, "sigma": 15.0}},
    {"name": "missing again", "task": "flag_nans_zeros"},
    {"name": "known interference, short baselines", "task": "apply_static_mask", "kwargs": {"accumulation_mode": "or", "uvrange": "0~550"}},
    {
        "name": "very broad outliers",
        "task": "sum_threshold",
        "kwargs": {
            "outlier_nsigma": 10, "windows_freq": [32, 48, 64, 128], "spike_width_time": 6.5, "spike_width_freq": 64.0, "background_iterations": 5, "num_major_iterations": 1,
        },
    },
    {
        "name": "broad outliers",
        "task": "sum_threshold",
        "kwargs": {
            "outlier_nsigma": 10, "windows_freq": [1, 2, 4, 8], "spike_width_time": 6.5, "spike_width_freq": 10.0, "background_iterations": 5, "num_major_iterations": 1,
        },
    },
    {
        "name": "narrow outliers",
        "task": "sum_threshold",
        "kwargs": {
            "outlier_nsigma": 10, "windows_freq": [1, 2, 4, 8], "spike_width_time": 2.0, "spike_width_freq": 10.0, "background_iterations": 5, "num_major_iterations": 1,
        },
    },
    {"name": "far from the final fit", "task": "uvcontsub_flagger", "kwargs": {"major_cycles": 10, "or_original_from_cycle": 0, "taylor_degrees": 25, "sigma": 13.0}},
    {"name": "autocorrelations", "task": "flag_autos"},
    {"name": "input flags", "task": "combine_with_input_flags"},
]


def checked(strategies: list[dict]) -> list[tuple[str, dict]]:
    """Task and parameters of each step; an unknown or missing task, or missing parameters, raise ValueError."""
    out = []
    for s in strategies:
        task = s.get("task")
        if task not in TASKS:
            raise ValueError(f"strategy {s.get('name')!r} has no known task: {task!r}")
        if task in ("sum_threshold", "uvcontsub_flagger", "apply_static_mask") and "kwargs" not in s:
            raise ValueError(f"strategy {s.get('name')!r} needs kwargs")
        options = dict(s.get("kwargs") or {})
        if task == "apply_static_mask" and options.get("accumulation_mode", "or").strip() not in ("or", "override"):
            raise ValueError(f"strategy {s.get('name')!r}: no such accumulation mode")
        out.append((task, options))
    return out


@dataclass(frozen=True)
class Instrument:
    """What the steps need to know besides samples, of the size of an instrument: masked channels of each mask, by data description, and antenna positions."""

    hits: dict[int, list[set[int]]]
    places: dict[int, np.ndarray]


def instrument(channels: DataFrame, masks: DataFrame | None, antennas: DataFrame | None) -> Instrument:
    """From channels(chan, chan_freq, chan_width, and data_desc_id unless all are alike), masks(mask_id, freq_hz) and antennas(antenna_id, position)."""
    hits: dict[int, list[set[int]]] = {}
    if masks is not None:
        known = sorted(r[0] for r in masks.select("mask_id").distinct().collect())
        own = channels if "data_desc_id" in channels.columns else channels.withColumn("data_desc_id", F.lit(-1))
        found = {d: {m: set() for m in known} for d in (r[0] for r in own.select("data_desc_id").distinct().collect())}
        for r in native.masked_channels(own, masks, ["data_desc_id"]).collect():
            found[r["data_desc_id"]][r["mask_id"]].add(r["chan"])
        hits = {d: [by[m] for m in known] for d, by in found.items()}
    places = {r["antenna_id"]: np.array(r["position"]) for r in antennas.collect()} if antennas is not None else {}
    return Instrument(hits, places)


#: Rows of a stored table that become arrays at once.
ROWS = 4096
#: Flagged samples of a channel of a window, before the steps and after them, and all its samples.
COUNTS = "array<struct<before:bigint,after:bigint,size:bigint>>"


def flag_baselines(rows: DataFrame, strategies: list[dict], known: Instrument, keep: list[str] | None = None, *, counted: bool = False, in_place: bool = False) -> DataFrame:
    """row_id, GROUP, time, antenna1, antenna2, keep, and flag, [chan][corr], of each of rows(these, data) after all steps.

    The one shuffle of data brings the rows of a baseline of a group together, as arrays; they are its window of time by channel for each
    correlation, and every step runs on that. Of several rows of one time the one with the highest row_id is in the window, and all get its flags.
    Times that only other baselines have are NaN and flagged in it, and so is what is null: a row's data or flag, a channel of it, or a number. Rows of a
    baseline whose shapes differ raise ValueError. Without steps a row keeps the flags it has.

    counted: adds `counts`, by channel, of the window with its empty cells, in one row of each baseline, the one with the lowest row_id, null in the others.
    in_place: rows that lie in buckets of baselines (tables.store_visibilities) stay where they are, and only the times come to them; of other rows the result is the same.
    """
    steps = checked(strategies)
    if not known.places and any(task == "apply_static_mask" and o.get("uvrange", "").strip() not in ("", "*") for task, o in steps):
        raise ValueError("a mask for a range of baselines needs the antennas' positions")
    out = ["row_id", *packing.GROUP, "time", "antenna1", "antenna2", *(keep or []), "flag", *(["counts"] if counted else [])]

    def run(key: tuple, batches: Iterable[pa.RecordBatch], times: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """Batches become arrays as they come and flags leave in batches, so a window is held once, not as Arrow tables beside it."""
        field = {n: k.as_py() for n, k in zip(packing.BASELINE, key, strict=True)}
        kept, parts = [], []
        for batch in batches:
            if "times" in batch.schema.names:
                line = batch.column("times")
                if line.null_count < len(line):
                    times = line.drop_null().flatten().to_numpy()
                batch = batch.filter(line.is_null())
            if batch.num_rows:
                parts.append(_planes(batch.column("data"), batch.column("flag"), field))
                kept.append(batch.select([n for n in out if n not in ("flag", "counts")]))
        own = pa.Table.from_batches(kept)
        del kept
        n_chan, n_corr = _one_shape(parts, field)
        times = np.sort(times)
        at = np.searchsorted(times, own.column("time").to_numpy())
        order = pc.array_sort_indices(own.column("row_id").combine_chunks()).to_numpy()
        last = np.full(len(times), -1)
        last[at[order]] = order  # of rows with one time the last stays
        new = np.zeros((len(own), n_chan, n_corr), dtype=bool)
        sums = np.zeros((3, n_chan), dtype=np.int64)
        hits = known.hits.get(field["data_desc_id"], known.hits.get(-1, []))
        for corr in range(n_corr):
            plane, flag = np.full((len(times), n_chan), complex(np.nan, np.nan)), np.ones((len(times), n_chan), dtype=bool)
            start = 0
            for i, (vis, before) in enumerate(parts):
                there = at[start : start + len(vis)]
                mine = np.flatnonzero(last[there] == np.arange(start, start + len(vis)))
                start += len(vis)
                if vis.shape[1:] == (n_chan, n_corr):  # else it is null throughout
                    plane[there[mine]], flag[there[mine]] = vis[mine, :, corr], before[mine, :, corr]
                if corr + 1 == n_corr:
                    parts[i] = None
            del vis, before
            first = flag
            for task, o in steps:
                flag = _step(task, o, plane, flag, first, field["antenna1"], field["antenna2"], hits, known.places)
            new[:, :, corr] = flag[at]
            sums += np.stack([first.sum(0), flag.sum(0), np.full(n_chan, len(times))])
        del plane, flag, first
        lowest, of_line = order[0], pa.StructArray.from_arrays([pa.array(x) for x in sums], names=["before", "after", "size"])
        start = 0
        for batch in own.to_batches():
            n, some = batch.num_rows, new[start : start + batch.num_rows]
            inner = pa.ListArray.from_arrays(pa.array(np.arange(n * n_chan + 1) * n_corr, pa.int32()), pa.array(some.ravel()))
            columns = [*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * n_chan, pa.int32()), inner)]
            if counted:
                is_lowest = np.arange(start, start + n) == lowest
                ends = pa.array(np.append(0, np.cumsum(is_lowest * n_chan)), pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, of_line if is_lowest.any() else of_line.slice(0, 0), mask=pa.array(~is_lowest)))
            yield pa.RecordBatch.from_arrays(columns, names=out)
            start += n

    def together(key: tuple[pa.Scalar, ...], window: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(key, window)

    def beside(key: tuple, own: pa.Table, line: pa.Table) -> pa.Table:
        return pa.Table.from_batches(run(key, own.to_batches(ROWS), line.column("times").combine_chunks().flatten().to_numpy()))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | {"flag": "array<array<boolean>>", "counts": COUNTS}
    schema = ", ".join(f"{n} {kinds[n]}" for n in out)
    if in_place:
        of = rows.select(*packing.BASELINE, "row_id", "time", *(keep or []), "data", "flag").groupBy(*packing.BASELINE)
        line = packing.lines(rows).select(*[F.col(c).alias(f"_{c}") for c in packing.BASELINE], "times")
        return of.cogroup(line.groupBy(*[f"_{c}" for c in packing.BASELINE])).applyInArrow(beside, schema)
    return packing.gathered(rows, keep or []).groupBy(*packing.BASELINE).applyInArrow(together, schema)


def _shape(lists: pa.Array, where: dict) -> tuple[int, int]:
    """Channels and correlations of rows of [chan][corr], null ones left out."""
    rows = lists.drop_null()
    channels = rows.flatten().drop_null()
    sizes = [set(x.value_lengths().unique().to_pylist()) for x in (rows, channels)]
    if any(len(s) > 1 for s in sizes):
        raise ValueError(f"rows of {where} have several shapes: {sorted(sizes[0])} channels, {sorted(sizes[1])} correlations")
    return tuple(s.pop() if s else 0 for s in sizes)


def _planes(data: pa.Array, flags: pa.Array, where: dict) -> tuple[np.ndarray, np.ndarray]:
    """Values and flags as [row][chan][corr]; null is NaN and flagged."""
    shape, other = _shape(data, where), _shape(flags, where)
    if 0 not in shape and 0 not in other and shape != other:
        raise ValueError(f"rows of {where} have data of {shape} and flags of {other}")
    shape = tuple(map(max, shape, other))
    if not (data.null_count or flags.null_count or data.flatten().null_count or flags.flatten().null_count or data.flatten().flatten().null_count):
        values = data.flatten().flatten()
        re, im = (values.field(part).to_numpy(zero_copy_only=False) for part in ("re", "im"))
        return (re + 1j * im).reshape(len(data), *shape), _flags(flags.flatten().flatten()).reshape(len(data), *shape)
    vis, before = np.full((len(data), *shape), complex(np.nan, np.nan)), np.ones((len(data), *shape), dtype=bool)
    for i in range(len(data)):
        for c in range(shape[0]):
            value, flag = data[i][c].as_py() if data[i].is_valid else None, flags[i][c].as_py() if flags[i].is_valid else None
            for k in range(shape[1]):
                v, f = value[k] if value else None, flag[k] if flag else None
                known = v is not None and v["re"] is not None and v["im"] is not None
                if known:
                    vis[i, c, k] = complex(v["re"], v["im"])
                before[i, c, k] = not known or f is None or f
    return vis, before


def _one_shape(parts: list[tuple[np.ndarray, np.ndarray]], where: dict) -> tuple[int, int]:
    """Channels and correlations of a baseline's batches; one that is null throughout has none of its own."""
    shapes = sorted({vis.shape[1:] for vis, _ in parts})
    most = tuple(map(max, zip(*shapes, strict=True)))
    if any(n not in (0, m) for shape in shapes for n, m in zip(shape, most, strict=True)):
        raise ValueError(f"rows of {where} have several shapes: {shapes} channels and correlations")
    return most


def _flags(flat: pa.Array) -> np.ndarray:
    return flat.fill_null(True).to_numpy(zero_copy_only=False).astype(bool)


def apply_strategies(windows: DataFrame, strategies: list[dict], channels: DataFrame, masks: DataFrame | None = None, antennas: DataFrame | None = None) -> DataFrame:
    """bl, antenna1, antenna2, GROUP, corr, time_idx, chan and flag after all steps, for dense samples (PRODUCT, antenna1, antenna2, time_idx, chan, re, im, flag)."""
    return packing.flag_samples(flag_baselines(packing.as_rows(windows), strategies, instrument(channels, masks, antennas), ["bl", "time_idx"]))


def _step(task: str, o: dict, vis: np.ndarray, flag: np.ndarray, first: np.ndarray, a1: int, a2: int, hits: list[set[int]], places: dict) -> np.ndarray:
    if task == "flag_nans_zeros":
        return flag | (vis == 0) | np.isnan(vis)
    if task == "flag_autos":
        return flag | (a1 == a2)
    if task == "unflag":
        return np.zeros_like(flag)
    if task == "combine_with_input_flags":
        return flag | first
    if task == "sum_threshold":
        return flag | kernels.sum_threshold_flags(np.abs(vis), flag, **o)
    if task == "uvcontsub_flagger":
        return kernels.uvcontsub_flags(vis, flag, **o)
    lo, hi = sorted(length_range(o.get("uvrange", "")))
    if o.get("uvrange", "").strip() not in ("", "*"):
        d2 = 0.5 * float(((places[a1] - places[a2]) ** 2).sum())
        if not lo * lo <= d2 <= hi * hi:
            return flag
    if not hits:
        return flag
    override = o.get("accumulation_mode", "or").strip() == "override"
    own = hits[-1] if override else set().union(*hits)
    masked = np.broadcast_to(np.isin(np.arange(flag.shape[1]), sorted(own))[None, :], flag.shape)
    return masked.copy() if override else flag | masked


MODES: dict[str, Callable] = {"polarisation": stokes.polarised, "total_power": stokes.total_power}


def quantity(df: DataFrame, mode: str, corr_types: list[int] | dict[int, list[int]], with_model: bool = False) -> DataFrame:
    """Rows' data as it is flagged: less the model if there is one; as one Stokes amplitude for all correlations unless the mode is standard.

    corr_types: the correlations of every row, or of each data description.
    """
    if with_model:
        df = df.withColumn("data", F.zip_with("data", "model", residual))
    if mode == "standard":
        return df
    if mode not in MODES:
        raise ValueError(f"no flagging mode {mode!r}")

    def amplitude(own: list[int]) -> Column:
        return F.transform("data", lambda v: F.array(F.struct(MODES[mode](v, own).alias("re"), F.lit(0.0).alias("im"))))

    if isinstance(corr_types, dict):
        data = F.coalesce(*[F.when(F.col("data_desc_id") == d, amplitude(own)) for d, own in corr_types.items()])
    else:
        data = amplitude(corr_types)
    return df.withColumns({"data": data, "flag": F.transform("flag", lambda f: F.array(F.exists(f, lambda x: x)))})


def selected(rows: DataFrame, scans: list[int] | str | None, fields: DataFrame | None, field_names: list[str] | None) -> DataFrame:
    """Rows of the asked scans and fields."""
    rows = selection.by_scan(rows, scans)
    return rows if fields is None else selection.by_field(rows, fields, field_names)


def flag(rows: DataFrame, channels: DataFrame, corr_types: list[int] | dict[int, list[int]], *, strategies: list[dict] | None = None, mode: str = "standard", scans: list[int] | str | None = None,
         fields: DataFrame | None = None, field_names: list[str] | None = None, antennas: DataFrame | None = None, masks: DataFrame | None = None, ignore_flags: bool = False, with_model: bool = False,
         counted: bool = False, in_place: bool = False) -> DataFrame:
    """New flags of main-table rows(row_id, GROUP, time, antenna1, antenna2, data, flag): the whole way, as one plan.

    Select, subtract the model, form the quantity, flag each baseline's window, and flag all correlations alike. Data
    descriptions may differ in channels and correlations: then channels has data_desc_id, and corr_types is by it.
    A selection that nothing meets gives an empty table of the same columns. counted and in_place are those of flag_baselines().
    """
    rows = selected(rows, scans, fields, field_names)
    if ignore_flags:
        rows = rows.withColumn("flag", F.transform("flag", lambda c: F.transform(c, lambda k: F.lit(False))))
    ready = quantity(rows, mode, corr_types, with_model)
    out = packing.equalised(flag_baselines(ready, DEFAULT if strategies is None else strategies, instrument(channels, masks, antennas), counted=counted, in_place=in_place))
    if mode != "standard":
        own = corr_types if isinstance(corr_types, dict) else {}
        n = F.coalesce(*[F.when(F.col("data_desc_id") == d, len(c)) for d, c in own.items()]) if own else F.lit(len(corr_types))
        out = out.withColumn("flag", F.transform("flag", lambda f: F.array_repeat(f[0], n)))
    return out.select("row_id", *packing.GROUP, "time", "antenna1", "antenna2", "flag", *(["counts"] if counted else []))
