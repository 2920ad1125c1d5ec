"""From cell images to cell results.  Recognition itself is a component of the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import readings as R
from ..schema import VARIANT
from ..sources.images import unpack
from . import consensus, verify

CONSENSUS_ORDER = ("original", "grayscale", "contrast")
FALLBACK_ORDER = ("grayscale", "original", "contrast")
BATCH = 16


class Recogniser(Protocol):
    """Texts and scores of prepared images, in their order."""

    def predict(self, images: list[np.ndarray]) -> list[tuple[str, float]]: ...


_models: dict[str, Recogniser] = {}


def model_of(factory: Callable[[], Recogniser]) -> Recogniser:
    """One model for each worker process."""
    key = f"{factory.__module__}.{factory.__qualname__}"
    if key not in _models:
        _models[key] = factory()
    return _models[key]


RECOGNISED = "sheet_id string, filename string, day int, point int, reading_type string, variant string, ord int, raw_text string, confidence double"


def recognise(cells: DataFrame, factory: Callable[[], Recogniser], variants: tuple[str, ...], first: int = 0) -> DataFrame:
    """A row for each cell and variant.  Cells have sheet_id, filename, day, point, reading_type, image."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_of(factory)
        for b in batches:
            keys, images = [], []
            for r in b.itertuples(index=False):
                made = kernels.variants(unpack(r.image))
                for k, v in enumerate(variants, first):
                    keys.append((r.sheet_id, r.filename, r.day, r.point, r.reading_type, v, k))
                    images.append(kernels.prepared(made[v]))
            found: list[tuple[str, float]] = []
            for i in range(0, len(images), BATCH):
                part = model.predict(images[i : i + BATCH])
                if len(part) != len(images[i : i + BATCH]):
                    raise ValueError("the recogniser must return a result for each image")
                found += part
            yield pd.DataFrame([(*k, t, float(s)) for k, (t, s) in zip(keys, found, strict=True)], columns=[c.strip().split(" ")[0] for c in RECOGNISED.split(",")])

    return cells.select("sheet_id", "filename", "day", "point", "reading_type", "image").mapInPandas(step, RECOGNISED)


KEYS = ["sheet_id", "filename", "day", "point"]


def by_consensus(cells: DataFrame, factory: Callable[[], Recogniser]) -> DataFrame:
    """All three variants of every cell."""
    return consensus.assemble(recognise(cells, factory, CONSENSUS_ORDER), KEYS)


def adaptive(cells: DataFrame, factory: Callable[[], Recogniser]) -> DataFrame:
    """Grey first; what isn't valid as it stands gets the other variants too."""
    grey = recognise(cells, factory, FALLBACK_ORDER[:1])
    text = R.clean(F.col("raw_text"))
    safe = (text == R.normalise(text)) & R.is_valid(text, F.col("reading_type"))
    grey = grey.withColumn("safe", F.coalesce(safe, F.lit(False))).persist()
    rest = cells.join(grey.filter("NOT safe").select("sheet_id", "filename"), ["sheet_id", "filename"], "left_semi")
    return consensus.assemble(grey.drop("safe").unionByName(recognise(rest, factory, FALLBACK_ORDER[1:], 1)), KEYS)


def blank_gate(cells: DataFrame) -> DataFrame:
    """`cells` with the measures of their ink, before anything is recognised."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.join(pd.DataFrame([kernels.blankness(unpack(x)) for x in b["image"]], index=b.index).rename(columns=lambda c: c if c == "is_blank" else f"blank_{c}"))

    extra = "is_blank boolean, blank_ink_ratio double, blank_component_count int, blank_largest_ratio double, blank_largest_width_ratio double, blank_largest_height_ratio double, blank_largest_aspect_ratio double"
    return cells.mapInPandas(step, ", ".join(f"`{n}` {t}" for n, t in cells.dtypes) + ", " + extra)


GEOMETRY = ("geometry_rejection_reason", "uses_fallback_geometry", "local_geometry_confidence")


def process(cells: DataFrame, factory: Callable[[], Recogniser], strategy: str = "consensus") -> DataFrame:
    """Verified cell results: blank cells are set aside, the others recognised, likely blanks found.
    Cells may have the columns of their GEOMETRY, which stay; a badly cut cell is no likely blank.
    A filled cell that the recogniser lost is an error."""
    gated = blank_gate(cells).persist()
    filled = {"consensus": by_consensus, "adaptive": adaptive}[strategy](gated.filter("NOT is_blank"), factory)
    measures = [c for c in gated.columns if c.startswith("blank_") or c == "is_blank"]
    geometry = [c for c in GEOMETRY if c in gated.columns]
    rows = gated.drop("image").join(filled.drop("reading_type"), KEYS, "left")
    none = F.expr("cast(array() as array<string>)")
    lost = F.raise_error(F.concat(F.lit("no recognition of "), "filename")).cast(f"array<{VARIANT}>")
    variants = F.when(F.col("variants").isNull() & ~F.col("is_blank"), lost).otherwise(F.coalesce("variants", F.expr(f"cast(array() as array<{VARIANT}>)")))
    rows = rows.select(
        *KEYS, "reading_type", *measures, *geometry, variants.alias("variants"), F.coalesce("consensus_prediction", F.lit("")).alias("consensus_prediction"),
        F.coalesce("agreement_count", F.lit(0)).alias("agreement_count"), F.coalesce("average_consensus_confidence", F.lit(0.0)).alias("average_consensus_confidence"),
        F.coalesce("final_value", F.lit("")).alias("final_value"), F.lit(False).alias("human_verified"), F.coalesce("ocr_uncertainty_reasons", none).alias("ocr_uncertainty_reasons"),
        F.coalesce("postprocessing_status", F.lit("blank")).alias("postprocessing_status"), F.coalesce("candidate_interpretations", none).alias("candidate_interpretations"))
    if len(geometry) == len(GEOMETRY):
        rows = rows.withColumn("serious_geometry", R.serious_geometry(*[F.col(c) for c in GEOMETRY]))
    return verify.verify(verify.likely_blank(rows))


def counts(cells: DataFrame, results: DataFrame) -> DataFrame:
    """Cells, filled cells, model inputs and inputs saved against three for each filled cell."""
    filled = F.count_if(~F.col("is_blank") | (F.size("variants") > 0))
    inputs = F.sum(F.size("variants"))
    return results.agg(F.count(F.lit(1)).alias("cells"), filled.alias("filled"), inputs.alias("inputs"), F.greatest(3 * filled - inputs, F.lit(0)).alias("saved"))
