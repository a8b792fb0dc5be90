"""The small grammars of arguments: lists of numbers, ranges of lengths, widths of dilation."""

from __future__ import annotations

import math
import re

#: Units of a dilation width, in Hz.
UNITS = {"GHz": 1e9, "MHz": 1e6, "kHz": 1e3, "Hz": 1.0}


def number_list(text: str, unit: str = "m") -> list[int] | None:
    """`1,4~6` as [1, 4, 5, 6]; a blank or `*` as None, which stands for all. Ranges include their ends; one that descends is empty."""
    if text.strip() in ("", "*"):
        return None
    out: set[int] = set()
    for part in text.split(","):
        m = re.fullmatch(rf"\s*(\d+)\s*(?:~\s*(\d+)\s*(?:{re.escape(unit)})?)?\s*", part)
        if not m:
            raise ValueError(f"{part!r} is neither a number nor a range of numbers")
        out.update(range(int(m[1]), int(m[2] or m[1]) + 1))
    return sorted(out)


def length_range(text: str, unit: str = "m") -> tuple[float, float]:
    """`0~550m` as (0.0, 550.0); a blank or `*` as (0, inf)."""
    if not isinstance(text, str):
        raise ValueError("a range is text")
    if text.strip() in ("", "*"):
        return 0.0, math.inf
    number = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
    m = re.fullmatch(rf"\s*({number})\s*~\s*({number})\s*(?:{re.escape(unit)})?\s*", text)
    if not m:
        raise ValueError(f"{text!r} is no range")
    return float(m[1]), float(m[2])


def dilation(width: int | str | None, channel_width: float) -> int:
    """Channels on each side: a number of them, or a bandwidth such as `1.5MHz`, of which a part counts whole. None and 0 are none."""
    if width is None or width == "":
        return 0
    if isinstance(width, int) or width.strip().isdigit():
        return int(width)
    m = re.fullmatch(r"\s*(\d+\.?\d*|\.\d+)\s*([A-Za-z]+)\s*", width)
    if not m or m[2] not in UNITS:
        raise ValueError(f"{width!r} is neither channels nor a bandwidth in {', '.join(UNITS)}")
    return int(float(m[1]) * UNITS[m[2]] / channel_width) + 1


def merged_chunks(chunks: list[tuple[int, ...]], most: list[int]) -> list[tuple[int, ...]]:
    """Joins neighbours of parallel lists of sizes, greedily, while no list's sum is above its maximum."""
    if len(chunks) != len(most) or len({len(c) for c in chunks}) > 1:
        raise ValueError("the lists of chunks and the maxima differ in number")
    out: list[list[int]] = [[] for _ in chunks]
    held = [0] * len(chunks)
    for sizes in zip(*chunks, strict=True):
        if any(held) and any(h + s > m for h, s, m in zip(held, sizes, most, strict=True)):
            for o, h in zip(out, held, strict=True):
                o.append(h)
            held = [0] * len(chunks)
        held = [h + s for h, s in zip(held, sizes, strict=True)]
    if any(held):
        for o, h in zip(out, held, strict=True):
            o.append(h)
    return [tuple(o) for o in out]
