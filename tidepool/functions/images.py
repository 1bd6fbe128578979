"""Perceptual hash of 32 x 32 luma matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def phash(pixels: pd.Series) -> pd.Series:
    """Signs of the 8 x 8 low DCT-II coefficients against the median of those without the first, as 16 hex digits."""
    i = np.arange(32)
    basis = np.cos(np.pi * (2 * i[None, :] + 1) * np.arange(8)[:, None] / 64)

    def one(p):
        if p is None or len(p) != 1024:
            return None
        low = (basis @ np.array(p, float).reshape(32, 32) @ basis.T).ravel()
        bits = low > np.median(low[1:])
        return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"

    return pixels.map(one)
