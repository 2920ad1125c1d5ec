"""Uploads to pages and images: routing by content, fingerprints, PNG both ways."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PNG = b"\x89PNG\r\n\x1a\n"


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files with content, kind (by their first bytes, then by suffix) and fingerprint.  Spark's
    scan leaves empty files out."""
    df = spark.read.format("binaryFile").load(path)
    return df.select("path", "content", F.element_at(F.split("path", "/"), -1).alias("source_filename"), kind_of(F.col("content"), F.col("path")).alias("kind"), F.sha2("content", 256).alias("fingerprint"))


def kind_of(content: Column, path: Column) -> Column:
    """pdf, png, jpeg, empty or unknown.  What the bytes say wins over the suffix."""
    head = F.hex(F.substring(content, 1, 8))
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1))
    return (
        F.when(F.octet_length(content) == 0, "empty").when(F.startswith(head, F.lit("255044462D")), "pdf").when(head == PNG.hex().upper(), "png").when(F.startswith(head, F.lit("FFD8FF")), "jpeg")
        .when(suffix == "pdf", "pdf").otherwise("unknown"))


def sheet_ids(pages: DataFrame) -> DataFrame:
    """`pages` (fingerprint, page) with sheet_id: it depends on content and page, not on the name."""
    return pages.withColumn("sheet_id", F.sha2(F.concat_ws(":", "fingerprint", F.lit("page"), F.col("page").cast("string")), 256))


def load_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images (PNG, JPEG) as origin, height, width, n_channels and rows of blue, green, red."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")


def data_url(png: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.base64(png))


def encode_png(image: np.ndarray) -> bytes:
    """A grey or BGR image as PNG, without loss."""
    image = np.ascontiguousarray(image if image.ndim == 2 else image[..., ::-1], np.uint8)
    h, w = image.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """A grey or BGR image of a PNG with 8 bits a channel that isn't interlaced."""
    if not data.startswith(PNG):
        raise ValueError("not a PNG image")
    at, body, w, h, channels = 8, b"", 0, 0, 0
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", part)
            channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour, 0)
            if depth != 8 or interlaced or not channels:
                raise ValueError("unsupported PNG")
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    above = np.zeros(w * channels, np.int32)
    for y in range(h):
        line, f = raw[y, 1:].astype(np.int32), raw[y, 0]
        if f == 1:
            line = line.reshape(w, channels).cumsum(axis=0).ravel() & 255
        elif f == 2:
            line = (line + above) & 255
        elif f:
            for k in range(w * channels):
                left = line[k - channels] if k >= channels else 0
                corner = above[k - channels] if k >= channels else 0
                if f == 3:
                    guess = (left + above[k]) // 2
                else:
                    p = left + above[k] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above[k]), 1, above[k]), (abs(p - corner), 2, corner))[2]
                line[k] = (line[k] + guess) & 255
        out[y], above = line, line
    image = out.reshape(h, w, channels)
    return image[..., 0] if channels < 3 else image[..., 2::-1]


def pack(image: np.ndarray) -> dict:
    return {"height": image.shape[0], "width": image.shape[1], "channels": 1 if image.ndim == 2 else 3, "data": image.tobytes()}


def unpack(row) -> np.ndarray:
    shape = (row["height"], row["width"]) if row["channels"] == 1 else (row["height"], row["width"], row["channels"])
    return np.frombuffer(row["data"], np.uint8).reshape(shape)


IMAGE = "struct<height:int,width:int,channels:int,data:binary>"


def to_png(images: DataFrame, column: str = "image") -> DataFrame:
    """`images` with `png`, the image column encoded."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(png=[encode_png(unpack(x)) for x in b[column]])

    return images.mapInPandas(step, ", ".join(f"`{n}` {t}" for n, t in images.dtypes) + ", png binary")


def from_png(images: DataFrame, column: str = "png") -> DataFrame:
    """`images` with `image`, decoded from PNG files: what `to_png` stored."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(image=[pack(decode_png(bytes(x))) for x in b[column]])

    rest = [(n, t) for n, t in images.dtypes if n != "image"]
    return images.select(*[n for n, _ in rest]).mapInPandas(step, ", ".join(f"`{n}` {t}" for n, t in rest) + f", image {IMAGE}")


PAGE_COLUMNS = ["fingerprint", "source_filename", "page", "image", "error"]


def decoded_pages(spark: SparkSession, path: str, render=None) -> DataFrame:
    """fingerprint, source_filename, page, image, error of all uploads of a folder.  Files that are empty,
    unknown or damaged, and scans that PDF files hold as JPEG, are rows with an error."""
    from . import pdf

    files = uploads(spark, path)
    struct = F.struct("height", "width", F.col("nChannels").alias("channels"), "data")
    raster = load_images(spark, path).select(F.regexp_replace("origin", "^file:/+", "/").alias("_path"), struct.alias("image"))
    own = files.filter("kind IN ('png', 'jpeg')").withColumn("_path", F.regexp_replace("path", "^file:/+", "/")).join(raster, "_path", "left")
    images = own.select("fingerprint", "source_filename", F.lit(1).alias("page"), "image", F.when(F.col("image").isNull(), "the image can't be decoded").alias("error"))
    scans = pdf.pages(files.filter("kind = 'pdf'"), render)
    scans = scans.withColumn("error", F.coalesce("error", F.when(F.col("jpeg").isNotNull(), "the page is a JPEG file: decode it as an upload of its own")))
    other = files.filter("kind IN ('empty', 'unknown')").select("fingerprint", "source_filename", F.lit(None).cast("int").alias("page"), F.lit(None).cast(IMAGE).alias("image"), F.concat("kind", F.lit(" content")).alias("error"))
    return images.unionByName(scans.select(*PAGE_COLUMNS)).unionByName(other)


def only_page(pages: DataFrame) -> DataFrame:
    """`pages`, if each file has exactly one."""
    from ..operators.pairing import guard

    counts = pages.groupBy("fingerprint").agg(F.count("page").alias("n")).filter("n <> 1")
    guard(counts, "files without exactly one page")
    return pages


def queue_items(pages: DataFrame) -> DataFrame:
    """Pages as items of the queue: sheet_id, fingerprint, page, display_name, png."""
    good = sheet_ids(pages.filter("error IS NULL"))
    several = F.count(F.lit(1)).over(Window.partitionBy("fingerprint", "source_filename")) > 1
    name = F.when(several, F.concat("source_filename", F.lit(" - page "), F.col("page").cast("string"))).otherwise(F.col("source_filename"))
    return to_png(good.withColumn("display_name", name)).select("sheet_id", "fingerprint", "page", "display_name", "png")


def named_crops(spark: SparkSession, folder: str) -> DataFrame:
    """filename and image of a folder of crops."""
    struct = F.struct("height", "width", F.col("nChannels").alias("channels"), "data")
    return load_images(spark, folder).select(F.element_at(F.split("origin", "/"), -1).alias("filename"), struct.alias("image"))


def sample_cells(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Crops whose names tell their cell (filename, day, point, reading_type, image), and the names of
    the others."""
    from ..functions.readings import place_of

    crops = named_crops(spark, folder).withColumn("_p", place_of(F.col("filename")))
    told = F.col("_p.day").isNotNull()
    return crops.filter(told).select("filename", "_p.day", "_p.point", "_p.reading_type", "image"), crops.filter(~told).select("filename")


def label_cells(spark: SparkSession, labels: DataFrame, folder: str) -> DataFrame:
    """The crops of a labelled sample, without the truth: sheet_id, filename, day, point, reading_type,
    image.  A label without a crop is an error."""
    rows = labels.select("sheet_id", "filename", "day", "point", "reading_type").join(named_crops(spark, folder), "filename", "left")
    lost = F.raise_error(F.concat(F.lit("no crop of "), "filename")).cast(IMAGE)
    return rows.select("sheet_id", "filename", "day", "point", "reading_type", F.when(F.col("image").isNull(), lost).otherwise(F.col("image")).alias("image"))


def save_pngs(images: DataFrame, folder: str, column: str = "image") -> None:
    """A PNG file for each row of `images` (filename and an image) in a folder that all executors reach."""

    def step(rows) -> None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(base, recursive=True)
        for r in rows:
            with system.open_output_stream(f"{base}/{r['filename']}") as out:
                out.write(encode_png(unpack(r[column])))

    images.select("filename", column).foreachPartition(step)


def save_review_crops(cells: DataFrame, results: DataFrame, folder: str) -> None:
    """The crops of the cells that a person has to look at."""
    wanted = results.filter("needs_review").select("sheet_id", "filename")
    save_pngs(cells.join(wanted, ["sheet_id", "filename"], "left_semi"), folder)
