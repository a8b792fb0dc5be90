"""Iterative flaggers of one product, a plane of time by channel, on NumPy arrays.

Tasks run these on the planes that Spark brings together; quietsky.operators.threshold has the single steps as
DataFrame operations, and the tests hold the two against each other. A step goes through a plane some lines at a time, so beside the plane
itself there are a few arrays of its size and working arrays of bounded size, however wide a filter is.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np

from quietsky.functions.boxes import PASSES, radius

#: Fixed value: from a median of absolute values to a standard deviation.
MAD_NORMAL = 1.4826
#: Numbers of a working array, and the fewest lines that are taken at once, however long they are.
SLAB, FEWEST = 1 << 16, 8
#: Places up to which near_sums() adds one by one.
SLIDING = 64


def slabs(lines: int, size: int) -> Iterator[slice]:
    """Stretches of lines of that size, as many at once as SLAB holds, but at least FEWEST."""
    step = max(FEWEST, SLAB // max(1, size))
    for a in range(0, lines, step):
        yield slice(a, min(a + step, lines))


def running_sums(x: np.ndarray, w: int) -> np.ndarray:
    """Sums of each w neighbours along axis 0, as differences of running sums."""
    c = np.zeros((len(x) + 1, *x.shape[1:]))
    np.cumsum(x, axis=0, out=c[1:])
    return c[w:] - c[:-w]


def near_sums(x: np.ndarray, w: int) -> np.ndarray:
    """running_sums() that add nothing but their own values, so that a large one elsewhere costs no digits: in order, or, of many, stretches of powers of two."""
    n = len(x) - w + 1
    if w < SLIDING:
        out = x[:n].copy()
        for i in range(1, w):
            out += x[i : i + n]
        return out
    out, size, at = np.zeros((n, *x.shape[1:])), 1, 0
    while True:
        if w & size:
            out, at = out + x[at : at + n], at + size
        if 2 * size > w:
            return out
        x, size = x[:-size] + x[size:], 2 * size


#: How sums of neighbours are made.
Sums = Callable[[np.ndarray, int], np.ndarray]


def _box(y: np.ndarray, r: int, passes: int, sums: Sums = running_sums) -> None:
    """box() along axis 0 of a plane, in place."""
    for s in slabs(y.shape[1], len(y) + 2 * r * passes):
        x = np.pad(y[:, s], ((r * passes, r * passes), (0, 0)))
        for _ in range(passes):
            x = sums(np.pad(x, ((r, r), (0, 0))), 2 * r + 1) / (2 * r + 1)
        y[:, s] = x[r * passes : len(x) - r * passes]


def _turned(x: np.ndarray, axis: int) -> np.ndarray:
    """x as a plane whose axis 0 is that axis."""
    y = np.moveaxis(x, axis, 0)
    return y if y.ndim == 2 else y.reshape(len(y), -1)


def box(x: np.ndarray, r: int, passes: int, axis: int, sums: Sums = running_sums) -> np.ndarray:
    """Passes of a box of radius r along an axis of x, of one or two axes, which is zero outside; what leaves the array between passes counts."""
    out = np.array(x, dtype=float if r else None)
    if r:
        _box(_turned(out, axis), r, passes, sums)
    return out


def _reached(ok: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """Whether any of ok lies within reach along the axis."""
    if reach == 0:
        return ok
    out = np.empty(ok.shape, dtype=bool)
    y, to = _turned(ok, axis), _turned(out, axis)
    for s in slabs(y.shape[1], len(y) + 2 * reach):
        c = np.cumsum(np.pad(y[:, s].astype(np.int64), ((reach + 1, reach), (0, 0))), axis=0)
        to[:, s] = c[2 * reach + 1 :] - c[: -(2 * reach + 1)] > 0
    return out


def masked_gaussian(x: np.ndarray, flags: np.ndarray, sigma: tuple[float, float], passes: int = PASSES, sums: Sums = running_sums) -> np.ndarray:
    """Smooths what is not flagged; NaN where nothing unflagged is within the filter's support."""
    near = ~flags
    value, weight = np.where(near, x, 0.0), near.astype(float)
    for axis, s in enumerate(sigma):
        r = radius(s, passes)
        if r:
            _box(_turned(value, axis), r, passes, sums)
            _box(_turned(weight, axis), r, passes, sums)
        near = _reached(near, r * passes, axis)
    with np.errstate(invalid="ignore", divide="ignore"):
        np.divide(value, weight, out=value)
    value[~near] = np.nan
    return value


def interpolated(x: np.ndarray) -> np.ndarray:
    """Fills NaN along the last axis: straight lines between neighbours, the nearest value at the edges, 0 if there is none."""
    return _fill(x.copy())


def _fill(out: np.ndarray) -> np.ndarray:
    """interpolated(), in place."""
    at = np.arange(out.shape[-1])
    rows = out.reshape(-1, out.shape[-1])
    for s in slabs(*rows.shape):
        for i in s.start + np.flatnonzero(np.isnan(rows[s]).any(axis=1)):
            row, bad = rows[i], np.isnan(rows[i])
            row[bad] = np.interp(at[bad], at[~bad], row[~bad]) if not bad.all() else 0.0
    return out


def median_abs(x: np.ndarray, flags: np.ndarray) -> float:
    own = x[~flags]
    np.abs(own, out=own)
    return float(np.median(own, overwrite_input=True)) if own.size else np.nan


def background(x: np.ndarray, flags: np.ndarray, iterations: int, spike: tuple[float, float], reject: float, ends: np.ndarray, sums: Sums = running_sums) -> np.ndarray:
    """A smooth background. From the widest filter on, what stands out from it in its stretch of channels is left out of the next one."""
    flags = flags.copy()
    for wide in range(iterations, 0, -1):
        away = masked_gaussian(x, flags, (wide * spike[0], wide * spike[1]), sums=sums)
        np.abs(np.subtract(x, away, out=away), out=away)
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            with np.errstate(invalid="ignore"):
                flags[:, a:b] |= away[:, a:b] > MAD_NORMAL * reject * median_abs(away[:, a:b], flags[:, a:b])
        del away
    return _fill(masked_gaussian(x, flags, spike, sums=sums))


def threshold_series(x: np.ndarray, limit: np.ndarray, windows: list[int], rho: float, a: int, b: int, sums: Sums = running_sums) -> np.ndarray:
    """Columns of x, series along axis 0, against a limit each; flags from place a to b."""
    high, low = np.zeros(x.shape, dtype=bool), np.zeros(x.shape, dtype=bool)
    for w in windows:
        if w > len(x):
            continue
        t = limit / rho ** np.log2(w)
        y = np.where(high & (x > t), t, np.where(low & (x < -t), -t, x))
        mean = sums(y, w) / w
        with np.errstate(invalid="ignore"):
            for hit, out in ((mean > t, high), (-mean > t, low)):
                n = np.cumsum(np.pad(hit, ((w, w - 1), (0, 0))).astype(np.int64), axis=0)
                out |= n[w:] - n[:-w] > 0
    return (high | low)[a:b]


def _middle(x: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Medians along axis 0 of what is neither flagged nor NaN; NaN where there is nothing."""
    out = np.empty(x.shape[1])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        for s in slabs(x.shape[1], len(x)):
            out[s] = np.nanmedian(np.where(flags[:, s], np.nan, x[:, s]), axis=0, overwrite_input=True)
    return out


def sum_threshold(x: np.ndarray, flags: np.ndarray, axis: int, windows: list[int], nsigma: float, rho: float, ends: np.ndarray | None = None, sums: Sums = running_sums) -> np.ndarray:
    """Runs of samples along an axis whose mean is too far from zero; each stretch between ends has its own limit.

    Input flags count only for the limit, nsigma deviations by the median of absolute values. A stretch is searched together with the
    neighbours that its windows reach. No windows give no flags.
    """
    if axis not in (0, 1):
        raise ValueError("axis is 0 or 1")
    y, f = (x, flags) if axis == 0 else (x.T, flags.T)
    out = np.zeros(x.shape, dtype=bool)
    to = out if axis == 0 else out.T
    windows = [int(w) for w in windows]
    ends = np.array([0, len(y)]) if ends is None else ends
    reach = max(windows, default=1) - 1
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if a == b or not windows:
            continue
        lo, hi = max(a - reach, 0), min(b + reach, len(y))
        for s in slabs(y.shape[1], hi - lo):
            middle = _middle(np.abs(y[a:b, s]), f[a:b, s])
            limit = np.where(np.isnan(middle), np.inf, nsigma * MAD_NORMAL * middle)
            to[a:b, s] = threshold_series(y[lo:hi, s], limit, windows, rho, a - lo, b - lo, sums)
    return out


def smeared(flags: np.ndarray, extend: int, axis: int) -> np.ndarray:
    """Each place takes the flags from extend // 2 before it, extend places in all; an extend of 0 clears everything."""
    out = np.empty(flags.shape, dtype=bool)
    y, to = _turned(flags, axis), _turned(out, axis)
    at = np.arange(len(y))
    lo, hi = np.clip(at - extend // 2, 0, len(y)), np.clip(at - extend // 2 + extend, 0, len(y))
    for s in slabs(y.shape[1], len(y)):
        c = np.cumsum(np.pad(y[:, s].astype(np.int64), ((1, 0), (0, 0))), axis=0)
        to[:, s] = c[hi] - c[lo] > 0
    return out


def averaged(amp: np.ndarray, flags: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Means of k channels over what is neither flagged nor NaN; bins without any are 0 and flagged."""
    bins = -(-amp.shape[1] // k)
    pad = ((0, 0), (0, bins * k - amp.shape[1]))
    mean, none = np.empty((len(amp), bins)), np.empty((len(amp), bins), dtype=bool)
    for s in slabs(len(amp), bins * k):
        own = amp[s]
        ok = np.pad(~flags[s] & ~np.isnan(own), pad).reshape(len(own), bins, k)
        n = ok.sum(axis=2)
        total = np.where(ok, np.pad(np.nan_to_num(own, posinf=np.inf, neginf=-np.inf), pad).reshape(len(own), bins, k), 0).sum(axis=2)
        mean[s], none[s] = np.where(n > 0, total / np.maximum(n, 1), 0.0), n == 0
    return mean, none


def _one_pass(amp: np.ndarray, flags: np.ndarray, o: dict, windows_time: list, windows_freq: list, ends: np.ndarray) -> np.ndarray:
    k, nsigma, rho = o["average_freq"], o["outlier_nsigma"], o["rho"]
    x, f = averaged(amp, flags, k)
    spectrum = _middle(x, f)[None, :]
    spec_flags, spectrum = np.isnan(spectrum), np.nan_to_num(spectrum)
    width = o["spike_width_freq"] / k
    rest = (o["background_iterations"],), (o["background_reject"], ends)
    spectrum = spectrum - background(spectrum, spec_flags, *rest[0], (0.0, width), *rest[1])
    spec = sum_threshold(spectrum, spec_flags, 1, windows_freq, nsigma, rho, ends)
    f |= spec
    np.subtract(x, background(x, f, *rest[0], (o["spike_width_time"], width), *rest[1]), out=x)
    time = sum_threshold(x, f, 0, windows_time, nsigma, rho)
    freq = sum_threshold(x, f | time, 1, windows_freq, nsigma, rho, ends)
    del x
    both = smeared(spec | time | freq, o["time_extend"], 0)
    full = smeared(np.repeat(both, k, axis=1)[:, : amp.shape[1]], o["freq_extend"], 1)
    rows = full.sum(axis=1) > o["flag_all_freq_frac"] * full.shape[1]
    channels = full.sum(axis=0) > o["flag_all_time_frac"] * full.shape[0]
    return full | rows[:, None] | channels[None, :] | np.isnan(amp)


#: Defaults of the SumThreshold flagger.
SUM_THRESHOLD = {
    "outlier_nsigma": 4.5, "windows_time": (1, 2, 4, 8), "windows_freq": (1, 2, 4, 8), "background_reject": 2.0, "background_iterations": 1,
    "spike_width_time": 12.5, "spike_width_freq": 10.0, "time_extend": 3, "freq_extend": 3, "freq_chunks": 10, "average_freq": 1,
    "flag_all_time_frac": 0.6, "flag_all_freq_frac": 0.8, "rho": 1.3, "num_major_iterations": 5,
}


def sum_threshold_flags(amp: np.ndarray, flags: np.ndarray, **options) -> np.ndarray:
    """New flags of one plane of amplitudes: those of the last iteration, which has seen the input's and all earlier ones.

    With average_freq above 1, windows and spike width along frequency shrink by it, rounded up.
    """
    o = {**SUM_THRESHOLD, **options}
    k = int(o["average_freq"])
    bins = -(-amp.shape[1] // k)
    windows_time = [int(w) for w in o["windows_time"] if w <= amp.shape[0]]
    windows_freq = sorted({w for w in (int(np.ceil(w / k)) for w in o["windows_freq"]) if w <= bins})
    ends = np.linspace(0, bins, int(o["freq_chunks"]) + 1).astype(int)
    seen, new = flags.astype(bool), np.zeros(flags.shape, dtype=bool)
    for _ in range(int(o["num_major_iterations"])):
        new = _one_pass(amp, seen, o, windows_time, windows_freq, ends)
        seen = seen | new
    return new


#: Defaults of the fit-and-clip flagger.
UVCONTSUB = {"major_cycles": 5, "or_original_from_cycle": 1, "taylor_degrees": 20, "sigma": 5.0}


def _mean(vis: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Means along axis 0 of what is neither flagged nor NaN; added row after row, as numpy does for a whole plane. 0 where there is nothing."""
    total, n = np.zeros((1, vis.shape[1]), dtype=vis.dtype), np.zeros(vis.shape[1], dtype=np.int64)
    for s in slabs(*vis.shape):
        out = flags[s] | np.isnan(vis[s])
        own = np.where(out, 0, vis[s])
        total[0] = np.sum(own if s.start == 0 else np.concatenate([total, own]), axis=0)
        n += len(out) - out.sum(axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(total[0] / n, nan=0.0)


def _median(x: np.ndarray) -> float:
    """Median of a list, which is put in another order; NaN of nothing."""
    return float(np.median(x, overwrite_input=True)) if x.size else np.nan


def uvcontsub_flags(vis: np.ndarray, flags: np.ndarray, **options) -> np.ndarray:
    """Flags of one plane of visibilities: what is far from the low Fourier terms of the mean spectrum, cycle by cycle.

    Before the given cycle new flags replace the old ones, so a NaN is unflagged; from it on they are added.
    """
    o = {**UVCONTSUB, **options}
    out = flags.astype(bool).copy()
    away = np.empty(vis.shape)
    for cycle in range(int(o["major_cycles"])):
        if out.all():
            break
        terms = np.fft.fft(_mean(vis, out))
        terms[int(o["taylor_degrees"]) :] = 0
        smooth = np.fft.ifft(terms)[None, :]
        for s in slabs(*vis.shape):
            away[s] = np.abs(vis[s] - smooth)
        own = away[~out & ~np.isnan(away)]
        own -= _median(own)
        mad = _median(np.abs(own, out=own))
        del own
        new = away > o["sigma"] * mad
        out = out | new if cycle >= o["or_original_from_cycle"] else new
    return out
