"""Tiles over a run of frames: the current level, what is retained of levels before it, and labels parked to fade out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .folds import Rows, fold

Key = tuple[int, int, int]


@dataclass
class Tile:
    """A tile since the frame in which it was asked for; it is there ``delay`` frames later, if it has an image."""

    since: int
    delay: int
    symbols: bool

    def loaded(self, now: int) -> bool:
        return now >= self.since + self.delay


def overlap(a: Key, b: Key) -> bool:
    """Whether two tiles are equal or one lies above the other."""
    if a[0] < b[0]:
        a, b = b, a
    n = a[0] - b[0]
    return (a[1] >> n, a[2] >> n) == b[1:]


@dataclass
class Levels:
    """The sets of one view. A new zoom moves the current level to the retained tiles, where it stays until the new one has
    arrived and faded in, or it leaves the screen; labels of tiles that go are parked for one fade."""

    fade: int
    zoom: int | None = None
    current: dict[Key, Tile] = field(default_factory=dict)
    retained: dict[Key, Tile] = field(default_factory=dict)
    ghosts: list[tuple[Key, int]] = field(default_factory=list)

    def frame(self, now: int, zoom: int, box: tuple[int, int, int, int], load: Callable[[Key, int], Tile]) -> None:
        """box: the first and last column and row of the level that are on the screen."""
        self.ghosts = [g for g in self.ghosts if now - g[1] < self.fade]
        if zoom != self.zoom:
            for k, t in self.current.items():
                if k in self.retained:
                    self._park(k, self.retained[k], now)
                self.retained[k] = t
            self.current, self.zoom = {}, zoom
        layout = [(zoom, x, y) for x in range(box[0], box[1] + 1) for y in range(box[2], box[3] + 1)]
        self.current = {k: self.current.get(k) or load(k, now) for k in layout}
        ready = all(t.loaded(now - self.fade) for t in self.current.values())
        for k, t in list(self.retained.items()):
            if ready or not t.loaded(now) or not self._on_screen(k, box):
                self._park(k, self.retained.pop(k), now)

    def _park(self, key: Key, tile: Tile, now: int) -> None:
        if tile.symbols and tile.loaded(now):
            self.ghosts.append((key, now))

    def _on_screen(self, key: Key, box: tuple[int, int, int, int]) -> bool:
        z, x, y = key
        up, down = max(self.zoom - z, 0), max(z - self.zoom, 0)
        return box[0] >> up <= x >> down <= box[1] >> up and box[2] >> up <= y >> down <= box[3] >> up

    def needed(self, key: Key, now: int) -> bool:
        """Whether a retained tile's labels are still wanted: where a tile of the level is loading without labels, or where
        the level has no tile."""
        if not self.retained[key].symbols:
            return False
        over = [t for k, t in self.current.items() if overlap(k, key)]
        return not over or any(not t.loaded(now) for t in over)

    def state(self, now: int) -> Iterator[tuple[str, Key, bool]]:
        """(role, tile, flag): current tiles and whether they are loading, retained ones and whether their labels are needed,
        and ghosts."""
        yield from (("current", k, not t.loaded(now)) for k, t in self.current.items())
        yield from (("retained", k, self.needed(k, now)) for k in self.retained)
        yield from (("ghost", k, False) for k, _ in self.ghosts)


def retention(frames: DataFrame, load: Callable[[Key], tuple[int, bool]], fade: int = 2) -> DataFrame:
    """(view, frame, role, z, x, y, flag) of every frame of frames(view, frame, zoom, x0, x1, y0, y1). load(tile) tells after how many
    frames a tile is there, and whether it has labels. A view is one group; it holds the tiles of a screen."""

    def step(rows: Rows) -> Iterator[tuple]:
        levels = Levels(fade)
        for r in rows:
            now = int(r["frame"])
            levels.frame(now, int(r["zoom"]), tuple(int(r[k]) for k in ("x0", "x1", "y0", "y1")), lambda k, n: Tile(n, *load(k)))
            yield from ((r["view"], now, role, *k, flag) for role, k, flag in levels.state(now))

    f = frames.select("view", "frame", "zoom", "x0", "x1", "y0", "y1")
    kind = f.schema["view"].dataType.simpleString()
    return fold(f, ["view"], ["frame"], step, f"view {kind}, frame long, role string, z int, x long, y long, flag boolean")
