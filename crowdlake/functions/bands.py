"""Severity bands for map layers, as ``CASE WHEN`` Columns.

Crowd edges are closed above (``<=``), traffic edges are open (``<``); circles
and arrows use different thresholds. A NULL / NaN value falls through to the
last band, as the reference's ``if/elif/else`` chain does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band names and colours of the map layers.
GREEN, YELLOW, ORANGE, RED, GREY = "green", "yellow", "orange", "red", "grey"
COUNT_COLOURS = {GREEN: "#05FA05", YELLOW: "#FFFF00", ORANGE: "#FFA500", RED: "#FF0000"}
FLOW_COLOURS = {GREEN: "#00FF00", YELLOW: "#FFFF00", ORANGE: "#FFA500", RED: "#FF0000"}
ARROW_COLOURS = {GREEN: "#00FF00", YELLOW: "#FFFF00", ORANGE: "#FFA500", RED: "#FF0000"}
COUNT_EDGES = (50.0, 100.0, 150.0)        # circles, people per 3 minutes
FLOW_EDGES = (1.0, 6.0, 12.0)             # circles, people per metre per minute
ARROW_COUNT_EDGES = (20.0, 50.0, 80.0)    # arrows, people per 3 minutes
ARROW_FLOW_EDGES = (1.0, 5.0, 10.0)       # arrows, people per metre per minute
TRAFFIC_EDGES = (0.5, 0.7, 0.85)          # road segments, open upper edges
TRAFFIC_RGBA = {
    GREY: (180, 180, 180, 80),
    GREEN: (46, 204, 113, 220),
    YELLOW: (241, 196, 15, 220),
    ORANGE: (230, 126, 34, 220),
    RED: (231, 76, 60, 220),
}
STOP_TRAM_COLOUR, STOP_OTHER_COLOUR = "blue", "red"
HIGHLIGHT_RGBA = (255, 0, 0, 220)
DEFAULT_RGBA = (30, 144, 255, 180)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _closed_band(x: Column, edges) -> Column:
    lo, mid, hi = edges
    return (F.when(x <= F.lit(lo), F.lit(GREEN))
            .when(x <= F.lit(mid), F.lit(YELLOW))
            .when(x <= F.lit(hi), F.lit(ORANGE))
            .otherwise(F.lit(RED)))


def _colour(band: Column, colours: dict) -> Column:
    expr = None
    for name, hexcode in colours.items():
        expr = (F.when(band == name, F.lit(hexcode)) if expr is None
                else expr.when(band == name, F.lit(hexcode)))
    return expr


def band_count(c) -> dict[str, Column]:
    """Circles by count: <=50 / <=100 / <=150 / above; radius 2 + 0.2 * count."""
    x = _c(c)
    band = _closed_band(x, COUNT_EDGES)
    return {"band": band, "colour": _colour(band, COUNT_COLOURS),
            "radius": F.lit(2.0) + x * F.lit(0.2)}


def band_flow(c) -> dict[str, Column]:
    """Circles by flow: <=1 / <=6 / <=12 / above; radius 2 + flow."""
    x = _c(c)
    band = _closed_band(x, FLOW_EDGES)
    return {"band": band, "colour": _colour(band, FLOW_COLOURS), "radius": F.lit(2.0) + x}


def band_arrow_count(c) -> dict[str, Column]:
    band = _closed_band(_c(c), ARROW_COUNT_EDGES)
    return {"band": band, "colour": _colour(band, ARROW_COLOURS)}


def band_arrow_flow(c) -> dict[str, Column]:
    band = _closed_band(_c(c), ARROW_FLOW_EDGES)
    return {"band": band, "colour": _colour(band, ARROW_COLOURS)}


def band_traffic(c) -> dict[str, Column]:
    """Road colour: NULL grey, then <0.5 / <0.7 / <0.85 / above, as an RGBA array."""
    x = _c(c)
    lo, mid, hi = TRAFFIC_EDGES
    band = (F.when(x.isNull() | F.isnan(x), F.lit(GREY))
            .when(x < F.lit(lo), F.lit(GREEN))
            .when(x < F.lit(mid), F.lit(YELLOW))
            .when(x < F.lit(hi), F.lit(ORANGE))
            .otherwise(F.lit(RED)))
    rgba = None
    for name, vals in TRAFFIC_RGBA.items():
        arr = F.array(*[F.lit(v) for v in vals])
        rgba = F.when(band == name, arr) if rgba is None else rgba.when(band == name, arr)
    return {"band": band, "rgba": rgba}


def stop_class(mode, name, lines) -> dict[str, Column]:
    """Transit stop colour (tram blue, others red) and popup label."""
    colour = F.when(_c(mode) == F.lit("Tram"), F.lit(STOP_TRAM_COLOUR)).otherwise(F.lit(STOP_OTHER_COLOUR))
    label = F.concat(F.lit("<b>"), _c(name), F.lit("</b><br>Type: "), _c(mode),
                     F.lit("<br>Lijnen: "), _c(lines))
    return {"colour": colour, "label": label}


def highlight_flag(id_col, selected: list[str]) -> dict[str, Column]:
    """Chosen ids get the highlight RGBA, others the default."""
    sel = _c(id_col).isin(list(selected)) if selected else F.lit(False)
    out = {"highlighted": sel}
    for i, ch in enumerate("rgba"):
        out[ch] = F.when(sel, F.lit(HIGHLIGHT_RGBA[i])).otherwise(F.lit(DEFAULT_RGBA[i]))
    return out
