"""Picture expressions over arrays of grey values (0 to 255); decoding and scaling happen before."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

SIDE, LOW = 32, 8  # pixels of a side, and frequencies of a side that the hash keeps


def luminance(pixels: Column) -> Column:
    """Mean grey value; null without pixels."""
    return F.when(F.size(pixels) > 0, F.aggregate(pixels, F.lit(0.0), lambda s, p: s + p.cast("double")) / F.size(pixels))


def black(pixels: Column, below: float = 10.0) -> Column:
    return F.coalesce(luminance(pixels) < below, F.lit(True))


def first_lit(frames: DataFrame, keys: Sequence[str], order: Sequence[Column], pixels: str, below: float = 10.0) -> DataFrame:
    """The first frame of each film, in the given order, that is not black; films of black frames alone have none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return frames.filter(~black(F.col(pixels), below)).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def _cosines() -> np.ndarray:
    k, n = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * SIDE))


@F.pandas_udf(LongType())
def perceptual_hash(pixels: pd.Series) -> pd.Series:
    """64 bits of a picture of 32 x 32 grey values, rows first: which low frequencies of its cosine transform exceed their median. Null for other sizes."""
    c = _cosines()

    def one(p) -> int | None:
        if p is None or len(p) != SIDE * SIDE:
            return None
        low = (c @ np.asarray(p, float).reshape(SIDE, SIDE) @ c.T).ravel()
        bits = int("".join("1" if x else "0" for x in low > np.median(low)), 2)
        return bits - 2**64 if bits >= 2**63 else bits

    return pd.Series([one(p) for p in pixels], dtype="Int64")
