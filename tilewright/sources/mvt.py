"""Mapbox Vector Tiles: bytes to feature rows, in Arrow batches; and an encoder for fixtures and sinks."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterable, Iterator, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXTENT = 4096
TYPES = {1: "Point", 2: "LineString", 3: "Polygon"}
#: Vertices that a part of each type needs.
LEAST = {1: 1, 2: 2, 3: 3}
MOVE_TO, LINE_TO, CLOSE = 1, 2, 7

PROPERTY = "struct<t:string,s:string,d:double,l:bigint,b:boolean>"
FEATURES = f"""status string, source_layer string, extent int, ord int, fid bigint, geom_type string, parts array<array<float>>,
ring_areas array<double>, minx double, miny double, maxx double, maxy double, properties map<string,{PROPERTY}>"""
_PROPERTY = pa.struct([("t", pa.string()), ("s", pa.string()), ("d", pa.float64()), ("l", pa.int64()), ("b", pa.bool_())])


class Corrupt(ValueError):
    """Bytes that end within a field, or a number that is too long."""


# -- protocol buffers -------------------------------------------------------------------------------------------


def varint(b: bytes, at: int) -> tuple[int, int]:
    """An unsigned 64-bit number of at most 10 bytes, and the place after it."""
    n = shift = 0
    while True:
        if at >= len(b) or shift > 63:
            raise Corrupt("varint")
        c = b[at]
        n |= (c & 0x7F) << shift
        at += 1
        if c < 0x80:
            return n & 0xFFFFFFFFFFFFFFFF, at
        shift += 7


def fields(b: bytes) -> Iterator[tuple[int, int, Any]]:
    """(number, wire type, value) of a message's fields; a value is a number or bytes."""
    at = 0
    while at < len(b):
        tag, at = varint(b, at)
        wire = tag & 7
        if wire == 0:
            v, at = varint(b, at)
        elif wire in (1, 2, 5):
            size = 8 if wire == 1 else 4 if wire == 5 else 0
            if wire == 2:
                size, at = varint(b, at)
            if at + size > len(b):
                raise Corrupt("field")
            v = b[at : at + size]
            at += size
        else:
            raise Corrupt("wire type")
        yield tag >> 3, wire, v


def packed(b: bytes) -> list[int]:
    out, at = [], 0
    while at < len(b):
        v, at = varint(b, at)
        out.append(v)
    return out


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def zigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


# -- decoding ---------------------------------------------------------------------------------------------------


def _value(b: bytes) -> dict[str, Any] | None:
    """A property's value as a tagged struct; the last field counts. An empty message is a null that is there."""
    out: dict[str, Any] = {"t": "null"}
    for n, _, v in fields(b):
        if n == 1:
            out = {"t": "string", "s": v.decode("utf-8", "replace")}
        elif n == 2:
            out = {"t": "double", "d": struct.unpack("<f", v)[0]}
        elif n == 3:
            out = {"t": "double", "d": struct.unpack("<d", v)[0]}
        elif n in (4, 5):
            out = {"t": "int", "l": signed(v)}
        elif n == 6:
            out = {"t": "int", "l": zigzag(v)}
        elif n == 7:
            out = {"t": "bool", "b": v != 0}
    return out


def geometry(kind: int, commands: list[int]) -> tuple[list[np.ndarray], list[float]] | None:
    """The parts of a geometry, as x,y,x,y.. in 32-bit floats, and the signed areas of a polygon's rings; None for
    what can't be drawn: a line before a move, an unknown command, or no part with enough vertices.
    Counts that go beyond the numbers there are cut."""
    parts: list[list[int]] = []
    now: list[int] | None = None
    x = y = at = 0
    while at < len(commands):
        op, count = commands[at] & 7, commands[at] >> 3
        at += 1
        if op == CLOSE:
            continue
        if op not in (MOVE_TO, LINE_TO) or op == LINE_TO and now is None:
            return None
        count = min(count, (len(commands) - at) // 2)
        for k in range(at, at + 2 * count, 2):
            x += zigzag(commands[k])
            y += zigzag(commands[k + 1])
            if op == MOVE_TO and (kind != 1 or now is None):
                now = []
                parts.append(now)
            now += (x, y)
        at += 2 * count
        if count == 0 and len(commands) - at < 2:
            break
    kept = [np.array(p, dtype=np.float32) for p in parts if len(p) >= 2 * LEAST[kind]]
    if not kept:
        return None
    return kept, [shoelace(p) for p in kept] if kind == 3 else []


def shoelace(p: np.ndarray) -> float:
    """Signed area of a closed ring, y down: exterior rings are positive."""
    x, y = p[0::2].astype(np.float64), p[1::2].astype(np.float64)
    return float(((x - np.roll(x, -1)) * (y + np.roll(y, -1))).sum() / 2)


def gunzip(b: bytes) -> bytes:
    """Inflates what begins like gzip, and leaves all else."""
    return gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b


def decode(b: bytes, keep: Mapping[str, set[str] | None] | None = None) -> list[dict[str, Any]]:
    """The features of a tile, as rows of FEATURES. keep: the source-layers to read with the properties to keep
    (None: all of them); the others are skipped. Id 0 is no id. Of layers with one name the last counts."""
    layers: dict[str, list[dict[str, Any]]] = {}
    for n, wire, v in fields(gunzip(b)):
        if n == 3 and wire == 2:
            name, rows = _layer(v, keep)
            if name is not None and rows:
                layers.pop(name, None)
                layers[name] = rows
    return [r for rows in layers.values() for r in rows]


def _layer(b: bytes, keep: Mapping[str, set[str] | None] | None) -> tuple[str | None, list[dict[str, Any]]]:
    name, extent, keys, values, raw = "", EXTENT, [], [], []
    for n, _, v in fields(b):
        if n == 1:
            name = v.decode("utf-8", "replace")
            if keep is not None and name not in keep:
                return None, []
        elif n == 2:
            raw.append(v)
        elif n == 3:
            keys.append(v.decode("utf-8", "replace"))
        elif n == 4:
            values.append(_value(v))
        elif n == 5:
            extent = v
    wanted = None if keep is None else keep.get(name)
    rows = []
    for k, f in enumerate(raw):
        row = _feature(f, keys, values, wanted)
        if row:
            rows.append({"status": "data", "source_layer": name, "extent": extent, "ord": k, **row})
    return name, rows


def _feature(b: bytes, keys: list[str], values: list[Any], wanted: set[str] | None) -> dict[str, Any] | None:
    fid, kind, tags, commands = 0, 0, [], []
    for n, wire, v in fields(b):
        if n == 1:
            fid = signed(v)
        elif n == 2:
            tags = packed(v) if wire == 2 else [*tags, v]
        elif n == 3:
            kind = v
        elif n == 4:
            commands = packed(v) if wire == 2 else [*commands, v]
    found = geometry(kind, commands) if kind in TYPES and commands else None
    if found is None:
        return None
    parts, areas = found
    every = np.concatenate(parts)
    xs, ys = every[0::2], every[1::2]
    props = {}
    for i in range(0, len(tags) - 1, 2):
        if tags[i] < len(keys) and tags[i + 1] < len(values) and (wanted is None or keys[tags[i]] in wanted):
            props[keys[tags[i]]] = values[tags[i + 1]]
    return {
        "fid": fid or None, "geom_type": TYPES[kind], "parts": parts, "ring_areas": areas, "properties": list(props.items()),
        "minx": float(xs.min()), "miny": float(ys.min()), "maxx": float(xs.max()), "maxy": float(ys.max()),
    }


def decode_tiles(tiles: DataFrame, keep: Mapping[str, set[str] | None] | None = None, keys: tuple[str, ...] = ("source", "z", "x", "y"), bytes_col: str = "bytes") -> DataFrame:
    """One row per feature of tiles(source, z, x, y, bytes): the keys and FEATURES. A tile that can't be read gives
    one row with status corrupt; tiles without bytes give none."""
    names = [c.strip().split(" ")[0] for c in FEATURES.replace("\n", " ").split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.float32())), pa.list_(pa.float64()), *[pa.float64()] * 4, pa.map_(pa.string(), _PROPERTY)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict[str, Any]] = []
            of: list[int] = []

            def out() -> pa.RecordBatch:
                take = pa.array(of, pa.int64())
                cols = [b.column(k).take(take) for k in keys]
                cols += [pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)]
                made = pa.RecordBatch.from_arrays(cols, [*keys, *names])
                rows.clear(), of.clear()
                return made

            for i, v in enumerate(b.column(bytes_col)):
                raw = v.as_py()
                if not raw:
                    continue
                try:
                    found = decode(raw, keep)
                except (Corrupt, OSError, EOFError, struct.error, zlib.error):
                    found = [{"status": "corrupt"}]
                rows += found
                of += [i] * len(found)
                if len(rows) >= 5000:
                    yield out()
            yield out()

    slim = tiles.select(*keys, bytes_col)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{kinds}, {FEATURES}")


def prepared_size(features: DataFrame, keys: tuple[str, ...] = ("source", "z", "x", "y")) -> DataFrame:
    """An estimate of each decoded tile's bytes: 128, 16 and 4 a number for each part, 48 for each property and 32."""
    parts = F.aggregate("parts", F.lit(0), lambda a, p: a + F.size(p) * 4 + 16)
    per = F.coalesce(parts + F.size("properties") * 48 + 32, F.lit(0))
    return features.groupBy(*keys).agg((F.sum(per) + 128).alias("bytes"))


# -- encoding ---------------------------------------------------------------------------------------------------


def put_varint(n: int) -> bytes:
    n &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def put(number: int, v: int | bytes) -> bytes:
    if isinstance(v, int):
        return put_varint(number << 3) + put_varint(v)
    return put_varint(number << 3 | 2) + put_varint(len(v)) + v


def command(op: int, count: int) -> int:
    return count << 3 | op


def to_zigzag(v: int) -> int:
    return 2 * v if v >= 0 else -2 * v - 1


def commands_of(kind: int, parts: Iterable[Iterable[tuple[int, int]]]) -> list[int]:
    out, x, y = [], 0, 0
    parts = [list(p) for p in parts]
    if kind == 1:
        parts = [[q for p in parts for q in p]]
    for p in parts:
        steps = []
        for a, b in p:
            steps.append((to_zigzag(a - x), to_zigzag(b - y)))
            x, y = a, b
        head = len(steps) if kind == 1 else 1
        out += [command(MOVE_TO, head), *(v for s in steps[:head] for v in s)]
        if len(steps) > head:
            out += [command(LINE_TO, len(steps) - head), *(v for s in steps[head:] for v in s)]
        if kind == 3:
            out.append(command(CLOSE, 1))
    return out


def encode_value(v: Any) -> bytes:
    if v is None:
        return b""
    if isinstance(v, bool):
        return put(7, int(v))
    if isinstance(v, int):
        return put(4, v) if v >= 0 else put(6, to_zigzag(v))
    if isinstance(v, float):
        return put_varint(3 << 3 | 1) + struct.pack("<d", v)
    return put(1, str(v).encode())


def encode_layer(name: str, features: Iterable[tuple[int, list[int], Mapping[str, Any], int | None]], extent: int = EXTENT) -> bytes:
    """features: (type, geometry commands, properties, id)."""
    keys: dict[str, int] = {}
    values: dict[bytes, int] = {}
    body = b""
    for kind, commands, props, fid in features:
        tags = [n for k, v in props.items() for n in (keys.setdefault(k, len(keys)), values.setdefault(encode_value(v), len(values)))]
        f = (put(1, fid) if fid is not None else b"") + put(2, b"".join(map(put_varint, tags))) + put(3, kind) + put(4, b"".join(map(put_varint, commands)))
        body += put(2, f)
    return put(1, name.encode()) + body + b"".join(put(3, k.encode()) for k in keys) + b"".join(put(4, v) for v in values) + put(5, extent) + put(15, 2)


def encode_tile(*layers: bytes) -> bytes:
    return b"".join(put(3, y) for y in layers)
