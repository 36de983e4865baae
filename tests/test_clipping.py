"""Clipping by batches against one part at a time."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tilewright.functions import clipping
from tilewright.functions import geometry as G


def made(rng, n):
    """Rows of parts: null, empty, single points, vertices on the edges, repeated vertices, in and out."""
    at = lambda: rng.choice([0.0, 100.0, 50.0, rng.uniform(-80, 180), rng.uniform(20, 80)])

    def part():
        xy = [at() for _ in range(2 * rng.choice([0, 1, 2, 3, 5, 12]))]
        return xy + xy[-2:] if rng.random() < 0.3 else xy

    return [None if rng.random() < 0.1 else [part() for _ in range(rng.choice([0, 1, 1, 3]))] for _ in range(n)]


def batch(rows, kinds, rects):
    found = clipping.ragged(pa.array(rows, pa.list_(pa.list_(pa.float32()))))
    line, ring = np.array(kinds) == "LineString", np.array(kinds) == "Polygon"
    rect = np.array(rects, dtype=np.float64).reshape(-1, 4)
    cut = [clipping.clip_lines(clipping.chosen(found, line), rect), clipping.clip_rings(clipping.chosen(found, ring), rect), clipping.chosen(found, ~line & ~ring)]
    return clipping.as_struct(clipping.together(cut), np.array([r is None for r in rows], bool)).to_pylist()


@pytest.mark.parametrize("seed", range(6))
def test_batches_equal_single_parts(seed):
    rng = random.Random(seed)
    rows = [r if r is None else [[float(np.float32(v)) for v in p] for p in r] for r in made(rng, 400)]
    kinds = [rng.choice(["LineString", "Polygon", "Unknown"]) for _ in rows]
    rects = [(rng.choice([0.0, 10.0]), 0.0, 100.0, rng.choice([100.0, 60.0])) for _ in rows]
    got = batch(rows, kinds, rects)
    assert len(got) == len(rows)
    for g, ps, kind, rect in zip(got, rows, kinds, rects):
        if ps is None:
            assert g is None
        elif kind == "LineString":
            want = [(p, start) for part in ps for p, start, _ in G.clip_line(part, rect)]
            assert g["parts"] == [p for p, _ in want] and g["starts"] == pytest.approx([s for _, s in want], abs=1e-9)
        else:
            want = [p for p in (G.clip_ring(p, rect) for p in ps if p) if p] if kind == "Polygon" else ps
            assert g == {"parts": want, "starts": [0.0] * len(want)}


def test_no_rows_and_nothing_left():
    assert batch([], np.array([], dtype=str), []) == []
    assert batch([None, None], ["Polygon", "LineString"], [(0, 0, 1, 1)] * 2) == [None, None]
    away = [[5.0, 5.0, 6.0, 5.0, 6.0, 6.0]]
    assert batch([away, away], ["Polygon", "LineString"], [(0, 0, 1, 1)] * 2) == [{"parts": [], "starts": []}] * 2


def test_an_x_without_its_y_is_no_vertex():
    (got,) = batch([[[0.25, 0.5, 0.75, 0.5, 9.0], [0.5]]], ["LineString"], [(0, 0, 1, 1)])
    assert got == {"parts": [[0.25, 0.5, 0.75, 0.5]], "starts": [0.0]}


def test_slices_of_batches():
    rows = pa.array([[[0.0, 0.0]], None, [[1.0, 2.0, 3.0, 4.0], [5.0, 6.0]], []], pa.list_(pa.list_(pa.float64())))
    found = clipping.ragged(rows.slice(1))
    assert found.row.tolist() == [1, 1] and found.sizes.tolist() == [2, 1] and found.xy.ravel().tolist() == [1, 2, 3, 4, 5, 6]


def test_batches_are_cut_in_slices(monkeypatch):
    """No more vertices at once than the bound, but for a row that has more; the rows are those of one cut."""
    from tilewright.operators import drawlist

    rng = random.Random(3)
    rows = pa.array(made(rng, 300), pa.list_(pa.list_(pa.float32())))
    more = [pa.array([rng.choice(["LineString", "Polygon", "Unknown"]) for _ in rows]), *(pa.array([v] * 300) for v in (0.0, 10.0, 100.0, 90.0))]
    whole = drawlist._cut(rows, *more)
    seen = []
    monkeypatch.setattr(drawlist, "AT_ONCE", 64)
    monkeypatch.setattr(drawlist.clipping, "ragged", lambda p, own=clipping.ragged: seen.append((len(p), len(own(p).xy))) or own(p))
    assert drawlist.cut_parts(rows, *more).equals(whole)
    assert drawlist.cut_parts(rows.slice(7, 200), *(c.slice(7, 200) for c in more)).equals(whole.slice(7, 200))
    assert len(seen) > 20 and max(n for _, n in seen) < 64
    assert drawlist.cut_parts(rows.slice(0, 0), *(c.slice(0, 0) for c in more)).to_pylist() == []


def test_stamps_cut_each_line_once(spark):
    from tilewright import queries

    plan = queries.draw_stamps(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
