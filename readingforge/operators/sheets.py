"""From sheet images to cell images: finding the table, fitting its rows, following its lines.

A sheet is one row with an image; each is worked on alone, in NumPy, and gives 496 rows.  Nothing
is shuffled.  Two geometries: `fixed` cuts the form's known boxes out of the flattened table,
`calibrated` follows every printed line and flattens each cell by itself, falling back to the fixed
crop where the lines can't be trusted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..schema import DAYS, KINDS, LOW_GEOMETRY_CONFIDENCE, POINTS, kind_order
from ..sources.images import IMAGE, decode_png, pack, unpack

# The flattened table, the form's column bounds on a table of 1097 x 577, the range
# of its day rows there, and the paddings of a crop.
TABLE = (2400, 1260)
REFERENCE = (1097, 577)
COLUMNS = [20, 70, 120, 170, 218, 267, 315, 362, 410, 458, 504, 552, 598, 646, 692, 740, 786]
ROWS = (98, 570)
PADDING_TOP, PADDING_BOTTOM = 0.03, 0.06
MIN_TABLE_SHARE = 0.25
ROW_SPACING, ROW_TOP, STRONG, MIN_STRONG, MIN_MEDIAN = (0.90, 1.23), (0.04, 0.20), 0.20, 30, 0.70
BANDS_ACROSS, BANDS_DOWN, MATCH_ACROSS, MATCH_DOWN, REACH = 8, 6, 4, 3, 0.42
CELL_WIDTH, CELL_HEIGHT, MIN_AREA, GAPS = (0.5, 1.5), (0.5, 1.5), 0.5, (0.5, 1.5)
PEAK, BEND = 0.25, 0.30
#: How far from its bound a line counts, in rows.
NEAR_BOUND = 0.15


def bounds(width: int = TABLE[0], height: int = TABLE[1]) -> tuple[np.ndarray, np.ndarray]:
    """The 17 column and 32 row bounds of a flattened table."""
    x = np.rint(np.array(COLUMNS) / REFERENCE[0] * width).astype(int)
    top, bottom = (round(r / REFERENCE[1] * height) for r in ROWS)
    return x, np.rint(np.linspace(top, bottom, DAYS + 1)).astype(int)


def corners(image: np.ndarray, width: int = 1200) -> np.ndarray | None:
    """The corners of the table: the largest connected set of ruled lines, if it is large enough."""
    small = K.bounded(K.grey(image), width)
    scale = image.shape[1] / small.shape[1]
    rows, columns = K.line_masks(small, small.shape[0] / 33, small.shape[1] / 18)
    marks = K.dilate(rows | columns, 3, 3)
    parts = K.components(marks)
    if not parts:
        return None
    _, top, left, h, w = max(parts, key=lambda p: p[3] * p[4])
    if h * w < MIN_TABLE_SHARE * small.size:
        return None
    y, x = np.nonzero(marks[top : top + h, left : left + w])
    found = K.ordered_corners(np.stack([x + left, y + top], 1))
    return found * scale


def flattened(image: np.ndarray) -> np.ndarray:
    found = corners(image)
    if found is None:
        return K.resize_area(image, *TABLE)
    return K.warp(image, found, *TABLE)


def ruling(mask: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each pixel row the share of the form's width, from its first column bound to its last, that
    a horizontal line covers there or in the rows next to it."""
    return K.dilate(mask[:, x[0] : x[-1]], 3, 1).mean(1)


def ridges(strength: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Middles and heights of the runs in which a profile is above `floor`."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (strength > floor).astype(np.int8), [0]])))
    spans = list(zip(edge[::2], edge[1::2], strict=True))
    return np.array([(a + b - 1) / 2 for a, b in spans]), np.array([strength[a:b].max() for a, b in spans])


def sequences(lines: np.ndarray, height: int, row: float) -> np.ndarray:
    """(top, spacing) of all sequences of bounds that the form allows and whose first or second and last
    or last but one bound are found lines."""
    a, b = (v.ravel() for v in np.meshgrid(lines, lines, indexing="ij"))
    out = []
    for first in (0, 1):
        for last in (DAYS - 1, DAYS):
            spacing = (b - a) / (last - first)
            out.append(np.stack([a - first * spacing, spacing], 1))
    every = np.concatenate(out)
    top, spacing = every.T
    allowed = (spacing >= row * ROW_SPACING[0]) & (spacing <= row * ROW_SPACING[1]) & (top >= height * ROW_TOP[0]) & (top <= height * ROW_TOP[1])
    return every[allowed]


def fitted_rows(table: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, dict]:
    """Row bounds from the printed lines, or the known bounds, with the reasons against the lines.

    Two found lines fix a sequence of 32 evenly spaced bounds.  The sequence that meets the most ruling
    wins (a line counts less, the further from its bound it is), and is then fitted by least squares to
    the lines that it meets."""
    height, row = table.shape[0], float(np.median(np.diff(y)))
    mask, _ = K.line_masks(table, row, float(np.median(np.diff(x))))
    strength = ruling(mask, x)
    lines, heights = ridges(strength, STRONG)
    facts = {"top": None, "spacing": None, "strong": 0, "median_strength": 0.0, "reason": "no lines that could bound the rows"}
    every = sequences(lines, height, row)
    if not len(every):
        return y, facts
    reach, step = NEAR_BOUND * row, np.arange(DAYS + 1)
    place = every[:, :1] + every[:, 1:] * step
    right = np.clip(np.searchsorted(lines, place), 1, len(lines) - 1) if len(lines) > 1 else np.zeros(place.shape, int)
    near = np.where(np.abs(lines[right - 1] - place) <= np.abs(lines[right] - place), right - 1, right)
    away = np.abs(lines[near] - place)
    k = int((heights[near] * np.clip(1 - away / reach, 0, 1)).sum(1).argmax())
    met = away[k] <= reach
    spacing, top = np.polyfit(step[met], lines[near[k, met]], 1) if met.sum() > 1 else every[k, ::-1]
    seen = np.where(met, heights[near[k]], 0.0)
    strong, median, last = int((seen > STRONG).sum()), float(np.median(seen)), top + spacing * DAYS
    reasons = [text for wrong, text in (
        (strong < MIN_STRONG, f"{strong} of {DAYS + 1} bounds are ruled"), (median < MIN_MEDIAN, f"the ruling of a bound is {median:.3f} in the median"),
        (abs(last - (height - 1)) > row, f"the last bound is {abs(last - (height - 1)):.0f} pixels from the table's edge")) if wrong]
    facts = {"top": float(top), "spacing": float(spacing), "strong": strong, "median_strength": median, "reason": "; ".join(reasons) or None}
    if reasons:
        return y, facts
    return np.rint(np.minimum(top + spacing * step, height - 1)).astype(int), facts


def measured(mask: np.ndarray, expected: np.ndarray, ends: tuple[int, int], bands: int, least: int) -> list[dict]:
    """For each boundary (rows of `mask`) where it lies in each band: coordinate, position,
    confidence; lone outliers are dropped, and it is reliable if enough bands agree."""
    spacing = float(np.median(np.diff(expected)))
    edges = np.linspace(*ends, bands + 1).astype(int)
    profiles = [mask[:, a:b].mean(1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    at = (edges[:-1] + edges[1:]) / 2
    out = []
    for e in expected:
        found = [K.peak_near(p, e, int(REACH * spacing), 0.3) for p in profiles]
        offsets = np.array([f[0] - e if f else np.nan for f in found], float)
        offsets[np.abs(offsets) > REACH * spacing] = np.nan
        between = (offsets[:-2] + offsets[2:]) / 2
        lone = np.abs(offsets[1:-1] - between) > PEAK * spacing  # by the offsets as they were found
        offsets[1:-1][lone] = np.nan
        good = np.isfinite(offsets)
        reliable = int(good.sum()) >= least
        line = np.interp(at, at[good], offsets[good]) if reliable else np.zeros(bands)
        if reliable and bands > 2 and np.abs(np.diff(line, 2)).max() > BEND * spacing:
            reliable, line = False, np.zeros(bands)  # too curved
        out.append({
            "expected": float(e), "at": at, "position": e + line, "direct": int(good.sum()), "reliable": reliable, "fixed": False,
            "confidence": float(np.mean([f[1] for f, g in zip(found, good, strict=True) if g])) if good.any() else 0.0})
    return out


def followed(curves: list[dict]) -> list[dict]:
    """Curves that couldn't be measured take the mean offset of the nearest measured ones within two."""
    out = []
    for k, c in enumerate(curves):
        if not c["reliable"]:
            near = [next((curves[j] for j in js if 0 <= j < len(curves) and curves[j]["reliable"]), None) for js in ((k - 1, k - 2), (k + 1, k + 2))]
            offsets = [(n["position"] - n["expected"]) for n in near if n]
            c = c | {"position": c["expected"] + (np.mean(offsets, axis=0) if offsets else np.zeros(len(c["at"]))), "confidence": 0.5 * c["confidence"] + 0.2 * bool(offsets), "fixed": not offsets}
        out.append(c)
    return out


def ascending(curves: list[dict]) -> list[dict]:
    """Curves of which two neighbours come too close or too far apart anywhere go back to where they
    were expected: of the first such pair the one that is less certain, until there is none."""
    out = [dict(c) for c in curves]
    spacing = float(np.median(np.diff([c["expected"] for c in out])))
    for _ in range(2 * len(out)):
        gaps = np.diff([c["position"] for c in out], axis=0)
        wrong = np.flatnonzero(((gaps < GAPS[0] * spacing) | (gaps > GAPS[1] * spacing)).any(1))
        if not len(wrong):
            break
        free = [out[k] for k in (wrong[0], wrong[0] + 1) if not out[k]["fixed"]]
        if not free:
            break
        weak = min(free, key=lambda c: (c["confidence"], c["direct"]))
        weak |= {"position": np.full(len(weak["at"]), weak["expected"]), "confidence": 0.0, "fixed": True}
    return out


def mesh(across: list[dict], down: list[dict]) -> np.ndarray:
    """Where the row and column curves cross: 32 x 17 x (x, y), by a few rounds of substitution."""
    out = np.zeros((len(across), len(down), 2))
    for i, r in enumerate(across):
        for j, c in enumerate(down):
            x, y = c["expected"], r["expected"]
            for _ in range(4):
                x, y = np.interp(y, c["at"], c["position"]), np.interp(x, r["at"], r["position"])
            out[i, j] = x, y
    return out


def rejected(quad: np.ndarray, width: float, height: float, shape: tuple[int, ...]) -> str | None:
    """Why a cell's corners can't be used."""
    if not np.isfinite(quad).all():
        return "not finite"
    if quad.min() < 0 or quad[:, 0].max() > shape[1] or quad[:, 1].max() > shape[0]:
        return "outside the table"
    w, h = np.linalg.norm(quad[[1, 2]] - quad[[0, 3]], axis=1), np.linalg.norm(quad[[3, 2]] - quad[[0, 1]], axis=1)
    if not ((w > CELL_WIDTH[0] * width) & (w < CELL_WIDTH[1] * width)).all():
        return "unlikely width"
    if not ((h > CELL_HEIGHT[0] * height) & (h < CELL_HEIGHT[1] * height)).all():
        return "unlikely height"
    (ax, ay), (bx, by) = quad[2] - quad[0], quad[3] - quad[1]
    if abs(ax * by - ay * bx) / 2 < MIN_AREA * width * height:  # half the cross product of the diagonals
        return "too small"
    return None


class Grid:
    """A flattened table with its bounds and, for the calibrated geometry, its curves and crossings."""

    def __init__(self, image: np.ndarray, geometry: str = "fixed"):
        self.table = flattened(image)
        self.x, y = bounds(self.table.shape[1], self.table.shape[0])
        self.y, self.rows = fitted_rows(self.table, self.x, y)
        self.across = self.down = self.crossings = None
        if geometry == "calibrated":
            lines, columns = K.line_masks(self.table, float(np.median(np.diff(self.y))), float(np.median(np.diff(self.x))))
            self.across = ascending(followed(measured(lines, self.y, (self.x[0], self.x[-1]), BANDS_ACROSS, MATCH_ACROSS)))
            self.down = ascending(followed(measured(columns.T, self.x, (self.y[0], self.y[-1]), BANDS_DOWN, MATCH_DOWN)))
            self.crossings = mesh(self.across, self.down)

    def box(self, d: int, c: int) -> np.ndarray:
        """The corners of a cell by the form's bounds."""
        x, y = self.x, self.y
        return np.array([[x[c], y[d]], [x[c + 1], y[d]], [x[c + 1], y[d + 1]], [x[c], y[d + 1]]], float)

    def quad(self, d: int, c: int) -> np.ndarray:
        """Its corners by the curves."""
        k = self.crossings
        return np.array([k[d, c], k[d, c + 1], k[d + 1, c + 1], k[d + 1, c]])

    def sides(self, d: int, c: int) -> list[dict]:
        """The curves above, below, left and right of it."""
        return [self.across[d], self.across[d + 1], self.down[c], self.down[c + 1]]

    def reason(self, d: int, c: int) -> str | None:
        return rejected(self.quad(d, c), float(self.x[c + 1] - self.x[c]), float(self.y[d + 1] - self.y[d]), self.table.shape)


def names() -> list[tuple[int, int, dict]]:
    """Row, column, and day, point and type of the cells in form order."""
    return [(d, c, {"day": d + 1, "point": c // 2 + 1, "reading_type": KINDS[c % 2]}) for d in range(DAYS) for c in range(2 * POINTS)]


def cut(image: np.ndarray, geometry: str = "fixed") -> list[dict]:
    """The 496 cells of a sheet in form order, with their geometry's facts."""
    g, out = Grid(image, geometry), []
    for d, c, name in names():
        (x1, y1), _, (x2, y2), _ = g.box(d, c).astype(int)
        h = y2 - y1
        fixed = K.crop(g.table, (x1, y1 - int(h * PADDING_TOP), x2, y2 + int(h * PADDING_BOTTOM)))
        row = name | {"geometry_rejection_reason": None, "uses_fallback_geometry": False, "local_geometry_confidence": 1.0, "image": fixed}
        if g.crossings is not None:
            quad, reason, sides = g.quad(d, c), g.reason(d, c), g.sides(d, c)
            row |= {
                "geometry_rejection_reason": reason, "uses_fallback_geometry": reason is not None or any(k["fixed"] for k in sides),
                "local_geometry_confidence": float(min(k["confidence"] for k in sides))}
            if reason is None:
                quad[:2, 1] -= h * PADDING_TOP
                quad[2:, 1] += h * PADDING_BOTTOM
                row["image"] = K.warp(g.table, quad, fixed.shape[1], fixed.shape[0])
        out.append(row)
    return out


def source(curve: dict) -> str:
    return "fixed_fallback" if curve["fixed"] else "detected" if curve["reliable"] else "interpolated"


def facts(image: np.ndarray) -> list[dict]:
    """Of each cell how far its calibrated corners are from the form's, how sure its sides are and where
    they come from, and its size."""
    g, out = Grid(image, "calibrated"), []
    for d, c, name in names():
        box, quad, sides = g.box(d, c), g.quad(d, c), g.sides(d, c)
        moved, length = quad - box, lambda a, b: float(np.linalg.norm(quad[a] - quad[b]))  # noqa: B023
        sources = [source(k) for k in sides]
        out.append(name | {
            "fixed_corners": box.tolist(), "calibrated_corners": np.round(quad, 6).tolist(), "corner_displacements": np.round(moved, 6).tolist(),
            "maximum_corner_displacement": round(float(np.linalg.norm(moved, axis=1).max()), 6), "boundary_confidences": [round(float(k["confidence"]), 6) for k in sides], "boundary_sources": sources,
            "interpolation_count": sources.count("interpolated"), "fallback_count": sources.count("fixed_fallback"), "local_row_height": round((length(3, 0) + length(2, 1)) / 2, 6), "local_column_width": round((length(1, 0) + length(2, 3)) / 2, 6)})
    return out


TELEMETRY = """sheet_id string, filename string, day int, point int, reading_type string, fixed_corners array<array<double>>, calibrated_corners array<array<double>>, corner_displacements array<array<double>>,
maximum_corner_displacement double, boundary_confidences array<double>, boundary_sources array<string>, interpolation_count int, fallback_count int, local_row_height double, local_column_width double"""


def telemetry(sheets: DataFrame) -> DataFrame:
    """The facts of all cells of `sheets` (sheet_id, image)."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                rows = [{"sheet_id": r.sheet_id, "filename": f"day_{k['day']:02d}_point_{k['point']:02d}_{k['reading_type']}.png", **k} for k in facts(unpack(r.image))]
                yield pd.DataFrame(rows)

    return sheets.select("sheet_id", "image").mapInPandas(step, TELEMETRY)


def manifest(rows: DataFrame) -> DataFrame:
    """sheet_id, items: the telemetry of a sheet's cells in form order as one JSON array; 496 items at most."""
    item = F.struct("filename", *[c for c in rows.columns if c not in ("sheet_id", "filename")])
    place = F.struct("day", "point", kind_order(F.col("reading_type")).alias("k"), item.alias("item"))
    return rows.groupBy("sheet_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["item"])).alias("items"))


def preflight_facts(sheets: DataFrame) -> DataFrame:
    """What `reports.preflight` needs to know of each sheet."""
    schema = "sheet_id string, row_sequence_used boolean, strong_bounds int, row_sequence_reason string, fixed_cells int, calibrated_cells int, invalid_cells int, fallback_boundaries int, low_confidence_boundaries int"

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                g = Grid(unpack(r.image), "calibrated")
                curves = g.across + g.down
                yield pd.DataFrame([{
                    "sheet_id": r.sheet_id, "row_sequence_used": g.rows["reason"] is None, "strong_bounds": g.rows["strong"], "row_sequence_reason": g.rows["reason"], "fixed_cells": len(names()), "calibrated_cells": len(names()),
                    "invalid_cells": sum(g.reason(d, c) is not None for d, c, _ in names()), "fallback_boundaries": sum(k["fixed"] for k in curves),
                    "low_confidence_boundaries": sum(not k["fixed"] and k["confidence"] < LOW_GEOMETRY_CONFIDENCE for k in curves)}])

    return sheets.select("sheet_id", "image").mapInPandas(step, schema)


def overlay(g: Grid) -> np.ndarray:
    """The table with its bounds: known ones grey, followed ones green, those that went back red."""
    out = np.repeat(K.grey(g.table)[..., None], 3, axis=2)
    h, w = out.shape[:2]
    for curves, at, length, turned in ((g.across, g.y, w, False), (g.down, g.x, h, True)):
        along = np.arange(length)
        for k, bound in enumerate(at):
            curve = curves[k] if curves else None
            colour = (160, 160, 160) if curve is None else (0, 0, 220) if curve["fixed"] else (0, 160, 0)
            place = np.full(length, float(bound)) if curve is None else np.interp(along, curve["at"], curve["position"])
            place = np.rint(place).astype(int).clip(0, (w if turned else h) - 1)
            out[(along, place) if turned else (place, along)] = colour
    return out


def pictures(sheets: DataFrame) -> DataFrame:
    """filename, image: of each sheet the flattened table, its two line masks, and its bounds drawn on it."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                g = Grid(unpack(r.image), "calibrated")
                lines, columns = K.line_masks(g.table, float(np.median(np.diff(g.y))), float(np.median(np.diff(g.x))))
                shown = {"table": g.table, "rows": np.where(lines, 0, 255).astype(np.uint8), "columns": np.where(columns, 0, 255).astype(np.uint8), "bounds": overlay(g)}
                yield pd.DataFrame([{"filename": f"{r.sheet_id}_{name}.png", "image": pack(np.ascontiguousarray(image))} for name, image in shown.items()])

    return sheets.select("sheet_id", "image").mapInPandas(step, f"filename string, image {IMAGE}")


def restored(items: DataFrame) -> DataFrame:
    """Items of the queue (sheet_id, png, orientation_choice) as upright sheets: by the choice, or as each
    looks where that is `auto` or null."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                image = decode_png(bytes(r.png))
                chosen = r.orientation_choice if r.orientation_choice not in (None, "auto") else K.orientation(image)["rotation"]
                rows.append({"sheet_id": r.sheet_id, "image": pack(K.rotated(image, chosen)), "rotation": chosen})
            yield pd.DataFrame(rows)

    return items.select("sheet_id", "png", "orientation_choice").mapInPandas(step, f"sheet_id string, image {IMAGE}, rotation string")


CELLS = f"sheet_id string, filename string, day int, point int, reading_type string, geometry_rejection_reason string, uses_fallback_geometry boolean, local_geometry_confidence double, image {IMAGE}"


def cells(sheets: DataFrame, geometry: str = "fixed") -> DataFrame:
    """The cells of `sheets` (sheet_id, image), 496 rows each."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                rows = cut(unpack(r.image), geometry)
                name = lambda k: f"day_{k['day']:02d}_point_{k['point']:02d}_{k['reading_type']}.png"
                yield pd.DataFrame([{"sheet_id": r.sheet_id, "filename": name(k), **k, "image": pack(np.ascontiguousarray(k["image"]))} for k in rows])

    return sheets.select("sheet_id", "image").mapInPandas(step, CELLS)


BOUNDARIES = "sheet_id string, axis string, index int, expected_position double, detected_position double, spacing double, continuity double"


def boundaries(sheets: DataFrame) -> DataFrame:
    """What the lines of a sheet were measured to be, for the alignment report."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                table = flattened(unpack(r.image))
                x, y = bounds(table.shape[1], table.shape[0])
                rows, columns = K.line_masks(table, float(np.median(np.diff(y))), float(np.median(np.diff(x))))
                out = []
                for axis, found, at, n in (("horizontal", measured(rows, y, (x[0], x[-1]), BANDS_ACROSS, MATCH_ACROSS), y, BANDS_ACROSS), ("vertical", measured(columns.T, x, (y[0], y[-1]), BANDS_DOWN, MATCH_DOWN), x, BANDS_DOWN)):
                    spacing = float(np.median(np.diff(at)))
                    out += [(r.sheet_id, axis, k, c["expected"], float(np.median(c["position"])) if c["reliable"] else None, spacing, c["direct"] / n) for k, c in enumerate(found)]
                yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in BOUNDARIES.split(",")])

    return sheets.select("sheet_id", "image").mapInPandas(step, BOUNDARIES)


def oriented(sheets: DataFrame, choice: str | None = None) -> DataFrame:
    """`sheets` turned upright: by `choice` (a rotation), or as each looks; with the decision."""
    schema = f"sheet_id string, image {IMAGE}, rotation string, confident boolean, clockwise_score double, counterclockwise_score double, margin double"

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                image = unpack(r.image)
                seen = K.orientation(image)
                if choice not in (None, "auto"):
                    seen["rotation"] = choice
                yield pd.DataFrame([{"sheet_id": r.sheet_id, "image": pack(K.rotated(image, seen["rotation"])), **seen}])

    return sheets.select("sheet_id", "image").mapInPandas(step, schema)
