"""Clipping of many lines and rings at once: numpy over the vertices of a whole Arrow batch, no loop over them.

Parts are ragged: ``xy`` holds the vertices of all of them, one after the other, and ``sizes`` how many each has. Results
are those of geometry.clip_line() and clip_ring() for each part.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa


class Parts(NamedTuple):
    """row: which row a part belongs to, in ascending order; start: how far along its whole part it begins."""

    row: np.ndarray
    sizes: np.ndarray
    xy: np.ndarray
    start: np.ndarray


def _within(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def clip_lines(parts: Parts, rect: np.ndarray) -> Parts:
    """The runs of each part within its row's rectangle; rect: (left, top, right, bottom) for each row."""
    at = np.flatnonzero(_within(parts.sizes) > 0)  # each vertex but the first of its part ends a segment
    of = np.repeat(np.arange(len(parts.sizes)), parts.sizes)[at]
    a, b = parts.xy[at - 1], parts.xy[at]
    box = rect[parts.row[of]]
    d = b - a
    length = np.hypot(d[:, 0], d[:, 1])
    lo, hi, out = np.zeros(len(at)), np.ones(len(at)), np.zeros(len(at), bool)
    for step, room in ((-d[:, 0], a[:, 0] - box[:, 0]), (d[:, 0], box[:, 2] - a[:, 0]), (-d[:, 1], a[:, 1] - box[:, 1]), (d[:, 1], box[:, 3] - a[:, 1])):
        q = np.divide(room, step, out=np.zeros_like(room), where=step != 0)
        lo = np.where(step < 0, np.maximum(lo, q), lo)
        hi = np.where(step > 0, np.minimum(hi, q), hi)
        out |= (step == 0) & (room < 0)
    shown = ~out & (lo <= hi) & ~((lo == hi) & (length > 0))

    first = np.ones(len(at), bool)
    first[1:] = of[1:] != of[:-1]
    open_before = np.zeros(len(at), bool)  # whether the segment before leaves a run that this one may go on with
    open_before[1:] = shown[:-1] & (hi[:-1] >= 1) & ~first[1:]
    new = shown & (~open_before | (lo > 0))
    along = np.cumsum(length, dtype=np.longdouble) - length
    along = (along - np.repeat(along[first], np.diff(np.append(np.flatnonzero(first), len(at))))).astype(np.float64)

    places = np.cumsum(shown.astype(np.int64) + new)  # a segment shown adds its end, the first of a run its start as well
    xy = np.empty((places[-1] if len(places) else 0, 2))
    xy[places[new] - 2] = a[new] + d[new] * lo[new, None]
    xy[places[shown] - 1] = np.where((hi == 1)[shown, None], b[shown], a[shown] + d[shown] * hi[shown, None])
    sizes = np.diff(np.append(places[new] - 2, len(xy)))
    return Parts(parts.row[of[new]], sizes, xy, along[new] + length[new] * lo[new])


def clip_rings(parts: Parts, rect: np.ndarray) -> Parts:
    """What of each ring lies within its row's rectangle, in the same winding. Rings of which under three vertices are
    left go. The four sides cut one after the other."""
    row, sizes, xy = parts.row, parts.sizes, parts.xy
    for axis, side, keep in ((0, 0, 1), (0, 2, -1), (1, 1, 1), (1, 3, -1)):
        of = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes)
        before = np.arange(len(xy)) - 1
        some = sizes > 0
        before[(ends - sizes)[some]] = ends[some] - 1
        a, b, bound = xy[before], xy, rect[row[of], side]
        in_b = keep * (b[:, axis] - bound) >= 0
        in_a = in_b[before]
        crosses = in_a != in_b
        places = np.cumsum(crosses.astype(np.int64) + in_b)
        new = np.empty((places[-1] if len(places) else 0, 2))
        c, other = np.flatnonzero(crosses), 1 - axis
        t = (bound[c] - a[c, axis]) / (b[c, axis] - a[c, axis])
        cut = np.empty((len(c), 2))
        cut[:, axis], cut[:, other] = bound[c], a[c, other] + (b[c, other] - a[c, other]) * t
        new[places[c] - 1 - in_b[c]] = cut
        new[places[in_b] - 1] = b[in_b]
        left = np.bincount(of, weights=crosses.astype(np.int64) + in_b, minlength=len(sizes)).astype(np.int64)
        stays = left >= 3
        xy, row, sizes = new[np.repeat(stays, left)], row[stays], left[stays]
    return Parts(row, sizes, xy, np.zeros(len(sizes)))


def ragged(parts: pa.ListArray) -> Parts:
    """The parts of all rows of ARRAY<ARRAY<DOUBLE>>; null rows have none."""
    rings = parts.flatten()  # leaves out what lies under nulls, and heeds slices
    counts = parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    widths = rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = rings.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (widths % 2).any():  # an x without its y is no vertex
        values = values[~((_within(widths) == np.repeat(widths, widths) - 1) & np.repeat(widths % 2 == 1, widths))]
    return Parts(np.repeat(np.arange(len(parts)), counts), widths // 2, values.reshape(-1, 2), np.zeros(len(widths)))


def coordinates(parts: pa.ListArray) -> np.ndarray:
    """How many coordinates the rows before each have in all."""
    widths = parts.flatten().value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.append(0, np.cumsum(widths))[np.cumsum(counts) - counts]


def chosen(parts: Parts, rows: np.ndarray) -> Parts:
    """The parts of the rows for which the mask is true."""
    keep = rows[parts.row]
    return Parts(parts.row[keep], parts.sizes[keep], parts.xy[np.repeat(keep, parts.sizes)], parts.start[keep])


def together(pieces: list[Parts]) -> Parts:
    """Parts of disjoint rows as one, in the order of rows."""
    row, sizes, xy, start = (np.concatenate(x) for x in zip(*pieces))
    by = np.argsort(row, kind="stable")
    first = (np.cumsum(sizes) - sizes)[by]
    return Parts(row[by], sizes[by], xy[np.repeat(first, sizes[by]) + _within(sizes[by])], start[by])


def as_struct(parts: Parts, null: np.ndarray) -> pa.StructArray:
    """STRUCT<parts ARRAY<ARRAY<DOUBLE>>, starts ARRAY<DOUBLE>> with a row for each of null, the mask of null rows."""
    rows = pa.array(np.append(0, np.cumsum(np.bincount(parts.row, minlength=len(null)))).astype(np.int32))
    vertices = pa.array(np.append(0, np.cumsum(parts.sizes * 2)).astype(np.int32))
    rings = pa.ListArray.from_arrays(vertices, pa.array(parts.xy.ravel()))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(rows, rings), pa.ListArray.from_arrays(rows, pa.array(parts.start))], ["parts", "starts"], mask=pa.array(null))
