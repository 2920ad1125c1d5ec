"""Image kernels in NumPy: grey and BGR images as uint8 arrays.  They follow the behaviour of the
usual operations, not another library's pixels."""

from __future__ import annotations

import numpy as np

BLANK_INK, MIN_COMPONENT, CANVAS, BORDER = 0.003, 6, (112, 40), 0.06
OCR_SCALE, OCR_PAD = 4, 16
ORIENTATION_SCORE, ORIENTATION_MARGIN = 0.10, 0.25


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return np.rint(image[..., :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def bgr(image: np.ndarray) -> np.ndarray:
    return np.repeat(image[..., None], 3, axis=2) if image.ndim == 2 else image[..., :3]


def otsu(image: np.ndarray) -> int:
    """The threshold that parts the grey values into the two most distinct classes."""
    n = np.bincount(image.ravel(), minlength=256).astype(float)
    low = np.cumsum(n)
    mass = np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * low - mass * low[-1]) ** 2 / (low * (low[-1] - low))
    return int(np.nan_to_num(between, posinf=0).argmax())


def ink(image: np.ndarray) -> np.ndarray:
    """Dark marks on light paper."""
    g = grey(image)
    return g <= otsu(g) if g.min() < g.max() else np.zeros(g.shape, bool)


def _shifted(mask: np.ndarray, reach: int, axis: int, fill: bool) -> np.ndarray:
    pad = [(0, 0), (0, 0)]
    pad[axis] = (reach, reach)
    p = np.pad(mask, pad, constant_values=fill)
    return np.lib.stride_tricks.sliding_window_view(p, 2 * reach + 1, axis=axis)


def dilate(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """By a rectangle of odd sides."""
    return _shifted(_shifted(mask, height // 2, 0, False).any(-1), width // 2, 1, False).any(-1)


def erode(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    return _shifted(_shifted(mask, height // 2, 0, True).all(-1), width // 2, 1, True).all(-1)


def opened(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    return dilate(erode(mask, height, width), height, width)


def line_masks(image: np.ndarray, row_height: float, column_width: float) -> tuple[np.ndarray, np.ndarray]:
    """Horizontal and vertical printed lines: ink in runs of about half a cell."""
    marks = ink(image)
    odd = lambda x: max(3, int(x) | 1)
    return opened(marks, 1, odd(column_width * 0.5)), opened(marks, odd(row_height * 0.5), 1)


def edges(image: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Where brightness changes most: gradients (Sobel) that are largest along their own direction and
    above `high`, or above `low` and connected with such."""
    g = np.pad(grey(image).astype(float), 1, mode="edge")
    across = g[:-2] + 2 * g[1:-1] + g[2:]
    down = g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]
    dx, dy = across[:, 2:] - across[:, :-2], down[2:] - down[:-2]
    size = np.abs(dx) + np.abs(dy)
    p = np.pad(size, 1)
    at = lambda y, x: p[1 + y : p.shape[0] - 1 + y, 1 + x : p.shape[1] - 1 + x]
    steep, slope = np.abs(dy) > 2.414 * np.abs(dx), np.abs(dy) > 0.414 * np.abs(dx)
    same = dx * dy > 0
    ahead = np.where(steep, at(1, 0), np.where(~slope, at(0, 1), np.where(same, at(1, 1), at(1, -1))))
    behind = np.where(steep, at(-1, 0), np.where(~slope, at(0, -1), np.where(same, at(-1, -1), at(-1, 1))))
    weak = (size > low) & (size > behind) & (size >= ahead)
    found = weak & (size > high)
    while True:  # as long as a path of weak ones is
        grown = weak & dilate(found, 3, 3)
        if grown.sum() == found.sum():
            return found
        found = grown


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """area, top, left, height and width of the eight-connected parts, by runs and union."""
    labels: list[int] = []
    runs: list[tuple[int, int, int, int]] = []

    def root(i: int) -> int:
        while labels[i] != i:
            labels[i] = labels[labels[i]]
            i = labels[i]
        return i

    before: list[int] = []
    for y in range(mask.shape[0]):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]])))
        here = []
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            k = len(runs)
            runs.append((y, int(a), int(b), k))
            labels.append(k)
            for j in before:
                if runs[j][1] <= b and runs[j][2] >= a:
                    labels[root(j)] = root(k)
            here.append(k)
        before = here
    out: dict[int, list[int]] = {}
    for y, a, b, k in runs:
        box = out.setdefault(root(k), [0, y, a, y + 1, b])
        box[0] += b - a
        box[1], box[2], box[3], box[4] = min(box[1], y), min(box[2], a), max(box[3], y + 1), max(box[4], b)
    return [(n, t, le, bo - t, r - le) for n, t, le, bo, r in out.values()]


def resize_area(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each pixel is the mean of the area it covers."""

    def axis(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        w = np.clip(np.minimum(edges[1:, None], np.arange(1, n + 1)) - np.maximum(edges[:-1, None], np.arange(n)), 0, 1)
        return w / w.sum(1, keepdims=True)

    rows, columns = axis(image.shape[0], height), axis(image.shape[1], width)
    out = np.tensordot(rows, image.astype(float), (1, 0))
    out = np.moveaxis(np.tensordot(columns, out, (1, 1)), 0, 1)
    return np.rint(out).clip(0, 255).astype(np.uint8)


def resize_cubic(image: np.ndarray, scale: int) -> np.ndarray:
    """Enlarged by cubic convolution (a = -0.75)."""

    def axis(n: int) -> np.ndarray:
        x = (np.arange(n * scale) + 0.5) / scale - 0.5
        w = np.zeros((n * scale, n))
        for k in range(-1, 3):
            d = np.abs(x - (np.floor(x) + k))
            v = np.where(d <= 1, 1.25 * d**3 - 2.25 * d**2 + 1, -0.75 * d**3 + 3.75 * d**2 - 6 * d + 3)
            np.add.at(w, (np.arange(n * scale), np.clip(np.floor(x).astype(int) + k, 0, n - 1)), v)
        return w

    out = np.tensordot(axis(image.shape[0]), image.astype(float), (1, 0))
    out = np.moveaxis(np.tensordot(axis(image.shape[1]), out, (1, 1)), 0, 1)
    return np.rint(out).clip(0, 255).astype(np.uint8)


def bounded(image: np.ndarray, width: int) -> np.ndarray:
    """At most so wide."""
    if image.shape[1] <= width:
        return image
    return resize_area(image, width, max(1, round(image.shape[0] * width / image.shape[1])))


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The projection that takes four points to four points."""
    a = []
    for (x, y), (u, v) in zip(source, target, strict=True):
        a += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    return np.linalg.svd(np.array(a, float))[2][-1].reshape(3, 3)


def ordered_corners(points: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left, by sums and differences."""
    p = np.asarray(points, float).reshape(-1, 2)
    s, d = p.sum(1), p[:, 1] - p[:, 0]
    return np.array([p[s.argmin()], p[d.argmin()], p[s.argmax()], p[d.argmax()]])


def warp(image: np.ndarray, corners: np.ndarray, width: int, height: int) -> np.ndarray:
    """The quadrilateral as a rectangle, by bilinear sampling."""
    back = homography(np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], float), ordered_corners(corners))
    x, y = np.meshgrid(np.arange(width), np.arange(height))
    p = np.stack([x, y, np.ones_like(x)], -1) @ back.T
    with np.errstate(divide="ignore", invalid="ignore"):
        u, v = p[..., 0] / p[..., 2], p[..., 1] / p[..., 2]
    return sample(image, u, v)


def sample(image: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Bilinear values at columns u and rows v, the border repeated."""
    h, w = image.shape[:2]
    u, v = np.clip(u, 0, w - 1), np.clip(v, 0, h - 1)
    x, y = np.minimum(u.astype(int), max(w - 2, 0)), np.minimum(v.astype(int), max(h - 2, 0))
    x2, y2 = np.minimum(x + 1, w - 1), np.minimum(y + 1, h - 1)
    f, g = u - x, v - y
    if image.ndim == 3:
        f, g = f[..., None], g[..., None]
    out = image[y, x] * (1 - f) * (1 - g) + image[y, x2] * f * (1 - g) + image[y2, x] * (1 - f) * g + image[y2, x2] * f * g
    return np.rint(out).clip(0, 255).astype(np.uint8)


def equalised(image: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Local contrast: tile histograms cut at a limit and equalised, blended between tiles."""
    g = grey(image)
    h, w = g.shape
    ty, tx = max(1, min(tiles, h // 4)), max(1, min(tiles, w // 4))
    ys, xs = np.linspace(0, h, ty + 1).astype(int), np.linspace(0, w, tx + 1).astype(int)
    maps = np.zeros((ty, tx, 256))
    for i in range(ty):
        for j in range(tx):
            part = g[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            n = np.bincount(part.ravel(), minlength=256).astype(float)
            top = max(1.0, clip * part.size / 256)
            over = np.maximum(n - top, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(n, top) + over / 256) * 255 / part.size
    cy, cx = (ys[:-1] + ys[1:] - 1) / 2, (xs[:-1] + xs[1:] - 1) / 2
    fy, fx = np.interp(np.arange(h), cy, np.arange(ty)), np.interp(np.arange(w), cx, np.arange(tx))
    y0, x0 = fy.astype(int), fx.astype(int)
    y1, x1 = np.minimum(y0 + 1, ty - 1), np.minimum(x0 + 1, tx - 1)
    a, b = (fy - y0)[:, None], (fx - x0)[None, :]
    at = lambda y, x: maps[y[:, None], x[None, :], g]
    out = (at(y0, x0) * (1 - a) * (1 - b) + at(y0, x1) * (1 - a) * b + at(y1, x0) * a * (1 - b) + at(y1, x1) * a * b)
    return np.rint(out).clip(0, 255).astype(np.uint8)


def without_lines(marks: np.ndarray) -> np.ndarray:
    """Ink without the straight lines that run through most of the cell."""
    h, w = marks.shape
    rows = opened(marks, 1, max(3, int(w * 0.6) | 1))
    columns = opened(marks, max(3, int(h * 0.8) | 1), 1)
    return marks & ~(rows | columns)


def variants(image: np.ndarray) -> dict[str, np.ndarray]:
    """The versions of a cell that are recognised: as it is, grey, with contrast, in black and white."""
    g = grey(image)
    c = equalised(g)
    return {"original": bgr(image), "grayscale": g, "contrast": c, "binary": np.where(c <= otsu(c), 0, 255).astype(np.uint8)}


def prepared(image: np.ndarray) -> np.ndarray:
    """What a recogniser gets: colour, four times as large, with a white margin."""
    big = resize_cubic(bgr(image), OCR_SCALE)
    return np.pad(big, ((OCR_PAD, OCR_PAD), (OCR_PAD, OCR_PAD), (0, 0)), constant_values=255)


def blank_canvas(image: np.ndarray) -> np.ndarray:
    """The inside of a cell at a fixed size with a white edge."""
    g = grey(image)
    dy, dx = int(g.shape[0] * BORDER), int(g.shape[1] * BORDER)
    inner = g[dy : g.shape[0] - dy, dx : g.shape[1] - dx]
    out = resize_area(inner if inner.size else g, *CANVAS)
    out[[0, -1], :] = 255
    out[:, [0, -1]] = 255
    return out


def blankness(image: np.ndarray, normalise: bool = True, threshold: float = BLANK_INK, least: int = MIN_COMPONENT) -> dict:
    """How much ink a cell has: is_blank, ink_ratio, component_count and the largest part's share of
    the area, of the width, of the height, and its width by its height."""
    canvas = blank_canvas(image) if normalise else grey(image)
    h, w = canvas.shape
    marks = without_lines(ink(canvas)) if int(canvas.max()) - int(canvas.min()) >= 40 else np.zeros((h, w), bool)
    parts = sorted((p for p in components(marks) if p[0] >= least), reverse=True)
    ratio = sum(p[0] for p in parts) / (h * w)
    n, _, _, ph, pw = parts[0] if parts else (0, 0, 0, 0, 0)
    return {
        "is_blank": ratio < threshold, "ink_ratio": ratio, "component_count": len(parts), "largest_ratio": n / (h * w), "largest_width_ratio": pw / w,
        "largest_height_ratio": ph / h, "largest_aspect_ratio": pw / ph if ph else 0.0}


def layout_score(image: np.ndarray) -> float:
    """How much an image looks like a form the right way up: long rulings, and a header band with
    less ruling on top than at the bottom."""
    g = bounded(grey(image), 600)
    rows, columns = line_masks(g, g.shape[0] / 33, g.shape[1] / 18)
    density = (rows | columns).mean()
    top, bottom = (rows[: g.shape[0] // 8] | columns[: g.shape[0] // 8]).mean(), (rows[-g.shape[0] // 8 :] | columns[-g.shape[0] // 8 :]).mean()
    return float(density + (bottom - top))


def rotated(image: np.ndarray, rotation: str) -> np.ndarray:
    turns = {"none": 0, "counterclockwise": 1, "half": 2, "clockwise": 3}[rotation]
    return np.ascontiguousarray(np.rot90(image, turns))


def orientation(image: np.ndarray) -> dict:
    """A landscape image stays; else both quarter turns are scored, and one is confident if its
    score is high enough and far enough ahead."""
    if image.shape[1] >= image.shape[0]:
        return {"rotation": "none", "confident": True, "clockwise_score": 0.0, "counterclockwise_score": 0.0, "margin": 0.0}
    c, k = layout_score(rotated(image, "clockwise")), layout_score(rotated(image, "counterclockwise"))
    best, margin = max(c, k), abs(c - k) / max(c, k, 1e-9)
    return {"rotation": "clockwise" if c >= k else "counterclockwise", "confident": best >= ORIENTATION_SCORE and margin >= ORIENTATION_MARGIN, "clockwise_score": c, "counterclockwise_score": k, "margin": margin}


def peak_near(strength: np.ndarray, at: float, reach: int, floor: float) -> tuple[int, float] | None:
    """The first highest place within reach, if it is high enough."""
    low, high = max(0, int(round(at)) - reach), min(len(strength), int(round(at)) + reach + 1)
    if low >= high:
        return None
    k = low + int(strength[low:high].argmax())
    return (k, float(strength[k])) if strength[k] >= floor else None


def crop(image: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    x1, y1, x2, y2 = box
    return image[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)]
