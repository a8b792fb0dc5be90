"""Stokes parameters from correlations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ids of Stokes parameters and correlations.
IDS = {"I": 1, "Q": 2, "U": 3, "V": 4, "RR": 5, "RL": 6, "LR": 7, "LL": 8, "XX": 9, "XY": 10, "YX": 11, "YY": 12}

# Each parameter is factor * (first + sign * second), from linear or from circular feeds.
LINEAR = {"I": ("XX", "YY", 0.5, 1), "Q": ("XX", "YY", 0.5, -1), "U": ("XY", "YX", 0.5, 1), "V": ("XY", "YX", -0.5j, -1)}
CIRCULAR = {"I": ("RR", "LL", 0.5, 1), "Q": ("RL", "LR", 0.5, 1), "U": ("RL", "LR", -0.5j, -1), "V": ("RR", "LL", 0.5, -1)}


def terms(corr_types: list[int]) -> dict[str, tuple[int, int, complex, int]]:
    """For each parameter that the correlations give: their places, the factor and the sign. Circular feeds win over linear ones."""
    out = {}
    for forms in (LINEAR, CIRCULAR):
        for name, (a, b, factor, sign) in forms.items():
            if IDS[a] in corr_types and IDS[b] in corr_types:
                out[name] = (corr_types.index(IDS[a]), corr_types.index(IDS[b]), complex(factor), sign)
    return out


def power(vis: Column, term: tuple[int, int, complex, int]) -> Column:
    """Squared modulus of one parameter of vis, an array of complex numbers over correlations."""
    a, b, factor, sign = term
    re, im = vis[a]["re"] + sign * vis[b]["re"], vis[a]["im"] + sign * vis[b]["im"]
    return abs(factor) ** 2 * (re * re + im * im)


def _sum(parts: list[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def polarised(vis: Column, corr_types: list[int], names: tuple[str, ...] = ("Q", "U", "V")) -> Column:
    """Root of the summed powers of those of the named parameters that there are."""
    own = terms(corr_types)
    parts = [power(vis, own[n]) for n in names if n in own]
    if not parts:
        raise ValueError("the correlations give none of the parameters")
    return F.sqrt(_sum(parts))


def total_power(vis: Column, corr_types: list[int]) -> Column:
    return polarised(vis, corr_types, ("I", "Q", "U", "V"))


def unpolarised(vis: Column, corr_types: list[int], names: tuple[str, ...] = ("Q", "U", "V")) -> Column:
    """What of the intensity is not polarised: |I| less the polarised part."""
    own = terms(corr_types)
    if "I" not in own:
        raise ValueError("the correlations do not give the intensity")
    return F.sqrt(power(vis, own["I"])) - polarised(vis, corr_types, names)
