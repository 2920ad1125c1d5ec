"""Scanned PDF files to pages, as far as that needs no renderer: a page that shows nothing but one upright
picture over all of it is that picture.  Other pages go to a renderer of the caller, or are an error.

What is read of a file: its objects (also those in object streams), the page tree with what pages
inherit, and the operators of page contents.  Streams are plain or deflated."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .images import IMAGE, pack

# The share of a page that its picture has to cover and how far off its edges may be, the
# resolution of rendered pages and the largest number of pixels.
COVER, EDGE, DPI, MAX_PIXELS = 0.98, 0.01, 300, 40_000_000

Renderer = Callable[[bytes, int, int], np.ndarray]

_TOKEN = re.compile(rb"<<|>>|\[|\]|/[^\s<>\[\]()/%]*|\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|[^\s<>\[\]()/%]+")


class Ref(int):
    """The number of another object."""


def parse(data: bytes):
    """The first value of some PDF text: dict, list, Ref, name (str), number, text or keyword (bytes)."""
    tokens = _TOKEN.findall(data)
    value, _ = _value(tokens, 0)
    return value


def _value(tokens: list[bytes], i: int):
    t = tokens[i]
    if t == b"<<":
        out, i = {}, i + 1
        while i < len(tokens) and tokens[i] != b">>":
            key = tokens[i][1:].decode("latin-1")
            out[key], i = _value(tokens, i + 1)
        return out, i + 1
    if t == b"[":
        out, i = [], i + 1
        while i < len(tokens) and tokens[i] != b"]":
            item, i = _value(tokens, i)
            out.append(item)
        return out, i + 1
    if t.startswith(b"/"):
        return t[1:].decode("latin-1"), i + 1
    if i + 2 < len(tokens) and tokens[i + 2] == b"R" and t.isdigit() and tokens[i + 1].isdigit():
        return Ref(t), i + 3
    try:
        return float(t), i + 1
    except ValueError:
        return t, i + 1


class Document:
    def __init__(self, data: bytes):
        if b"/Encrypt" in data:
            raise ValueError("encrypted PDF")
        self.objects: dict[int, tuple[object, bytes]] = {}
        for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S):
            head, mark, body = m[2].partition(b"stream")
            body = body[2:] if body.startswith(b"\r\n") else body[1:] if mark else b""
            self.objects[int(m[1])] = (parse(head) if head.strip() else None, body.rpartition(b"endstream")[0] if mark else b"")
        for value, _ in list(self.objects.values()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                self._packed(value, self.stream(next(k for k, v in self.objects.items() if v[0] is value)))

    def _packed(self, head: dict, text: bytes) -> None:
        first = int(self.of(head["First"]))
        numbers = [int(x) for x in text[:first].split()]
        for number, at in zip(numbers[::2], numbers[1::2]):
            self.objects.setdefault(number, (parse(text[first + at :]), b""))

    def of(self, value):
        """A value, followed to the object that it refers to."""
        while isinstance(value, Ref):
            value = self.objects.get(int(value), (None, b""))[0]
        return value

    def raw(self, number: int) -> bytes:
        value, body = self.objects[number]
        n = self.of(value.get("Length"))
        return body[: int(n)] if isinstance(n, float) and n <= len(body) else body

    def stream(self, number: int) -> bytes:
        filters = self.of(self.objects[number][0].get("Filter"))
        filters = [self.of(f) for f in filters] if isinstance(filters, list) else [filters] if filters else []
        data = self.raw(number)
        for f in filters:
            if f != "FlateDecode":
                raise ValueError(f"streams by {f} aren't read")
            data = zlib.decompressobj().decompress(data)
        return data

    def pages(self) -> list[dict]:
        root = next((v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
        if root is None:
            raise ValueError("no catalog")
        out: list[dict] = []

        def walk(node: dict, inherited: dict, depth: int) -> None:
            own = inherited | {k: node[k] for k in ("MediaBox", "CropBox", "Resources", "Rotate") if k in node}
            if depth > 64:
                raise ValueError("page tree too deep")
            if "Kids" in node:
                for kid in self.of(node["Kids"]):
                    walk(self.of(kid), own, depth + 1)
            else:
                out.append(own | {"Contents": node.get("Contents")})

        walk(self.of(root["Pages"]), {}, 0)
        return out

    def size(self, page: dict) -> tuple[float, float, float, float]:
        box = [float(self.of(x)) for x in self.of(page.get("CropBox") or page["MediaBox"])]
        return min(box[0], box[2]), min(box[1], box[3]), abs(box[2] - box[0]), abs(box[3] - box[1])

    def scan(self, page: dict) -> tuple[int, float] | None:
        """The object of the one picture that is the whole page, and its resolution."""
        if self.of(page.get("Rotate") or 0.0) not in (0.0, 0):
            return None
        contents = self.of(page["Contents"])
        parts = contents if isinstance(contents, list) else [page["Contents"]]
        try:
            text = b"\n".join(self.stream(int(p)) for p in parts if isinstance(p, Ref))
        except (ValueError, zlib.error):
            return None
        matrix, held, shown, numbers = np.eye(3), [], [], []
        for t in _TOKEN.findall(text):
            if t == b"q":
                held.append(matrix)
            elif t == b"Q":
                matrix = held.pop() if held else np.eye(3)
            elif t == b"cm":
                a, b, c, d, e, f = numbers[-6:]
                matrix = np.array([[a, b, 0], [c, d, 0], [e, f, 1]]) @ matrix
            elif t == b"Do":
                shown.append((name, matrix))  # noqa: F821  a name stands before
            elif t.startswith(b"/"):
                name = t[1:].decode("latin-1")  # noqa: F841
                continue
            elif re.fullmatch(rb"[-+]?\d*\.?\d+", t):
                numbers.append(float(t))
                continue
            elif t not in (b"gs", b"/"):
                return None  # text, paths, shadings
            numbers = []
        pictures = self.of((self.of(page.get("Resources")) or {}).get("XObject")) or {}
        if len(shown) != 1 or shown[0][0] not in pictures:
            return None
        number = int(pictures[shown[0][0]])
        facts = self.of(pictures[shown[0][0]])
        (a, b, _), (c, d, _), (e, f, _) = shown[0][1]
        x, y, w, h = self.size(page)
        upright = a > 0 and d > 0 and abs(b) < 1e-6 and abs(c) < 1e-6
        near = abs(e - x) <= EDGE * w and abs(f - y) <= EDGE * h and abs(e + a - x - w) <= EDGE * w and abs(f + d - y - h) <= EDGE * h
        if facts.get("Subtype") != "Image" or "SMask" in facts or not upright or not near or a < COVER * w or d < COVER * h:
            return None
        width, height = int(self.of(facts["Width"])), int(self.of(facts["Height"]))
        if width * height > MAX_PIXELS:
            return None
        return number, round((width * 72 / w + height * 72 / h) / 2, 2)

    def picture(self, number: int) -> np.ndarray | bytes | None:
        """A grey or BGR image, or a JPEG file as it is, or None for other codings."""
        facts = self.objects[number][0]
        filters = self.of(facts.get("Filter"))
        if filters == "DCTDecode" or isinstance(filters, list) and [self.of(f) for f in filters] == ["DCTDecode"]:
            return self.raw(number)
        channels = {"DeviceGray": 1, "DeviceRGB": 3}.get(str(self.of(facts.get("ColorSpace"))))
        if channels is None or self.of(facts.get("BitsPerComponent")) != 8 or "DecodeParms" in facts:
            return None
        try:
            data = np.frombuffer(self.stream(number), np.uint8)
        except (ValueError, zlib.error):
            return None
        image = data[: int(self.of(facts["Height"])) * int(self.of(facts["Width"])) * channels].reshape(int(self.of(facts["Height"])), int(self.of(facts["Width"])), channels)
        return image[..., 0] if channels == 1 else image[..., ::-1]


def decode(data: bytes, render: Renderer | None = None) -> list[dict]:
    """page, method (embedded or rendered), dpi, and image or jpeg of all pages of a file."""
    document, out = Document(data), []
    for k, page in enumerate(document.pages()):
        found = document.scan(page)
        own = document.picture(found[0]) if found else None
        if own is not None:
            jpeg = own if isinstance(own, bytes) else None
            out.append({"page": k + 1, "method": "embedded", "dpi": found[1], "image": None if jpeg else pack(own), "jpeg": jpeg})
            continue
        _, _, w, h = document.size(page)
        if round(w * DPI / 72) * round(h * DPI / 72) > MAX_PIXELS:
            raise ValueError(f"page {k + 1} is too large")
        if render is None:
            raise ValueError(f"page {k + 1} needs a renderer")
        out.append({"page": k + 1, "method": "rendered", "dpi": float(DPI), "image": pack(render(data, k, DPI)), "jpeg": None})
    if not out:
        raise ValueError("no pages")
    return out


PAGES = f"fingerprint string, source_filename string, page int, method string, dpi double, image {IMAGE}, jpeg binary, error string"


def pages(files: DataFrame, render: Renderer | None = None) -> DataFrame:
    """The pages of `files` (fingerprint, source_filename, content); a file that can't be read is one
    row with an error."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                try:
                    rows = [p | {"error": None} for p in decode(bytes(r.content), render)]
                except Exception as e:  # noqa: BLE001  damaged files fail in many ways
                    rows = [{"page": None, "method": None, "dpi": None, "image": None, "jpeg": None, "error": f"{type(e).__name__}: {e}"}]
                frame = pd.DataFrame([{"fingerprint": r.fingerprint, "source_filename": r.source_filename} | p for p in rows])
                yield frame.astype({"page": "Int32"})

    return files.select("fingerprint", "source_filename", "content").mapInPandas(step, PAGES)
