"""Style documents as themes: ordered layers with compiled filters and properties, and what they read."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .expressions import Compiled, Context, compile_filter, property_column

log = logging.getLogger("tilewright")

#: Zoom above which maxzoom doesn't count as declared.
TOP_ZOOM = 24.0

# Each layer type's properties with their kind and default. Layout first, then paint.
PROPERTIES: dict[str, dict[str, tuple[str, Any]]] = {
    "background": {"background-color": ("color", "#000000"), "background-opacity": ("number", 1)},
    "fill": {"fill-color": ("color", "#000000"), "fill-opacity": ("number", 1), "fill-outline-color": ("color", None), "fill-antialias": ("boolean", True), "fill-pattern": ("string", None)},
    "line": {
        "line-color": ("color", "#000000"), "line-width": ("number", 1), "line-opacity": ("number", 1), "line-gap-width": ("number", 0), "line-dasharray": ("numbers", None),
        "line-cap": ("string", "butt"), "line-join": ("string", "miter"), "line-pattern": ("string", None),
    },
    "circle": {
        "circle-radius": ("number", 5), "circle-color": ("color", "#000000"), "circle-opacity": ("number", 1), "circle-stroke-color": ("color", "#000000"),
        "circle-stroke-width": ("number", 0), "circle-stroke-opacity": ("number", 1),
    },
    "symbol": {
        "symbol-placement": ("string", "point"), "symbol-sort-key": ("number", 0), "symbol-spacing": ("number", 250), "text-field": ("string", ""), "text-size": ("number", 16),
        "text-font": ("strings", ["Open Sans Regular"]), "text-max-width": ("number", 10), "text-letter-spacing": ("number", 0), "text-transform": ("string", "none"),
        "text-anchor": ("string", "center"), "text-variable-anchor": ("strings", None), "text-radial-offset": ("number", 0), "text-offset": ("numbers", [0, 0]),
        "text-padding": ("number", 2), "text-allow-overlap": ("boolean", False), "text-optional": ("boolean", False), "text-max-angle": ("number", 45), "text-keep-upright": ("boolean", True),
        "text-rotation-alignment": ("string", "auto"), "icon-image": ("string", ""), "icon-size": ("number", 1), "icon-anchor": ("string", "center"), "icon-allow-overlap": ("boolean", False), "icon-offset": ("numbers", [0, 0]),
        "icon-rotate": ("number", 0), "icon-rotation-alignment": ("string", "auto"), "text-color": ("color", "#000000"), "text-opacity": ("number", 1), "text-halo-color": ("color", None),
        "text-halo-width": ("number", 0), "icon-opacity": ("number", 1), "icon-color": ("color", "#000000"), "icon-halo-color": ("color", None), "icon-halo-width": ("number", 0),
    },
    "raster": {
        "raster-opacity": ("number", 1), "raster-brightness-min": ("number", 0), "raster-brightness-max": ("number", 1), "raster-contrast": ("number", 0),
        "raster-saturation": ("number", 0), "raster-hue-rotate": ("number", 0),
    },
}
#: Properties whose plain texts may hold {tokens}.
TOKENS = frozenset({"text-field", "icon-image"})
SKIPPED = frozenset({"hillshade", "heatmap", "sky"})
#: Properties of a type that are read under another type's prefix.
RENAMED = {"fill-extrusion": {"fill-color": "fill-extrusion-color", "fill-opacity": "fill-extrusion-opacity", "fill-pattern": "fill-extrusion-pattern"}}


@dataclass(frozen=True)
class Layer:
    """One layer of a style, as written; columns are compiled for a context."""

    index: int
    id: str
    type: str
    source: str | None
    source_layer: str | None
    minzoom: float
    maxzoom: float
    filter: Any
    properties: dict[str, Any] = field(hash=False)

    def filter_column(self, ctx: Context) -> Compiled:
        return compile_filter(self.filter, ctx)

    def property(self, name: str, ctx: Context) -> Compiled:
        kind, default = PROPERTIES[self.type][name]
        return property_column(self.properties.get(name), kind, default, ctx, tokens=name in TOKENS)

    def resolved(self, ctx: Context) -> dict[str, Column]:
        """All properties, by name with _ for -."""
        return {n.replace("-", "_"): self.property(n, ctx).value.col for n in PROPERTIES[self.type]}

    def referenced(self, ctx: Context) -> set[str] | None:
        """The feature properties that the filter and the properties read; None: any of them."""
        found: set[str] = set()
        for c in [self.filter_column(ctx), *(self.property(n, ctx) for n in PROPERTIES[self.type])]:
            if c.properties is None:
                return None
            found |= c.properties
        return found

    def covers(self, zoom: Column) -> Column:
        return (zoom >= self.minzoom) & (zoom < self.maxzoom)

    def covers_band(self, zoom: Column) -> Column:
        """Whether the layer shows anywhere from this zoom to the next."""
        return (zoom + 1 > self.minzoom) & (zoom < self.maxzoom)

    def shapes(self, geometry_type: Column) -> Column:
        """Fills take polygons, circles points, lines all but points."""
        return {"fill": geometry_type == "Polygon", "circle": geometry_type == "Point", "line": geometry_type != "Point"}.get(self.type, F.lit(True))


@dataclass
class Theme:
    id: str
    layers: list[Layer]
    warnings: list[str]

    def source_layers(self) -> dict[str, set[str]]:
        found: dict[str, set[str]] = {}
        for y in self.layers:
            if y.source and y.source_layer:
                found.setdefault(y.source, set()).add(y.source_layer)
        return found

    def referenced_properties(self, ctx: Context) -> dict[tuple[str, str], set[str] | None]:
        """By source and source-layer, what a decoder has to keep; None absorbs all."""
        found: dict[tuple[str, str], set[str] | None] = {}
        for y in self.layers:
            if y.source and y.source_layer:
                k, r = (y.source, y.source_layer), y.referenced(ctx)
                found[k] = None if r is None or found.get(k, set()) is None else found.get(k, set()) | r
        return found

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(y.index, y.id, y.type, y.source, y.source_layer, y.minzoom, y.maxzoom) for y in self.layers]
        return spark.createDataFrame(rows, "layer_index int, id string, type string, source string, source_layer string, minzoom double, maxzoom double")

    def background(self, ctx: Context, zoom: float) -> Column | None:
        """The colour of the first background layer at a zoom, with its opacity."""
        from ..functions import color

        for y in self.layers:
            if y.type == "background" and y.minzoom <= zoom < y.maxzoom:
                p = y.resolved(ctx)
                return color.with_opacity(p["background_color"], p["background_opacity"])
        return None


def read_theme(style: dict[str, Any], id: str | None = None) -> Theme:
    """A theme from a style document. A layer that can't be read is left out with a warning, never an error."""
    layers, warnings = [], []
    for n, raw in enumerate(style.get("layers") or []):
        try:
            y = _layer(len(layers), raw, warnings)
        except (TypeError, ValueError, KeyError, AttributeError) as e:
            warnings.append(f"layer {n}: {e}")
            continue
        if y:
            layers.append(y)
    for w in warnings:
        log.warning(w)
    made = f"{style.get('name', '')}@{style.get('version', '')}#{(style.get('metadata') or {}).get('modified', '')}"
    return Theme(id or made, layers, warnings)


def _layer(index: int, raw: dict[str, Any], warnings: list[str]) -> Layer | None:
    kind = raw["type"]
    layout, paint = raw.get("layout") or {}, raw.get("paint") or {}
    if layout.get("visibility") == "none":
        return None
    if kind in SKIPPED:
        log.info("layer type %s is not drawn", kind)
        return None
    given = {**layout, **paint}
    for name, other in RENAMED.get(kind, {}).items():
        given[name] = given.get(other)
    kind = {"fill-extrusion": "fill"}.get(kind, kind)
    if kind not in PROPERTIES:
        warnings.append(f"layer {raw.get('id')}: unknown type {kind}")
        return None
    if "fill-antialias" in given:
        given["fill-antialias"] = given["fill-antialias"] is not False
    return Layer(
        index, str(raw.get("id", "")), kind, raw.get("source"), raw.get("source-layer"), float(raw.get("minzoom", 0)), float(raw.get("maxzoom", TOP_ZOOM)),
        raw.get("filter"), {k: v for k, v in given.items() if k in PROPERTIES[kind]},
    )
