"""Normalisation of raw payloads into domain columns."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType


def side_of(kind: Column, is_buy: Column) -> Column:
    """From the text, or else from the flag."""
    return F.coalesce(F.when(F.lower(kind).isin("buy", "sell"), F.lower(kind)), F.when(is_buy, "buy").when(~is_buy, "sell"))


def lamports(amount: Column) -> Column:
    """Amounts over a million are in billionths."""
    return F.when(amount > 1e6, amount / 1e9).otherwise(amount)


def slot_of(index: Column) -> Column:
    return F.substring(index, 1, 12).cast("long")


_CURVE = StructType([StructField("price", DoubleType()), StructField("progress", DoubleType()), StructField("complete", BooleanType())])


@F.pandas_udf(_CURVE)
def parse_curve(raw: pd.Series) -> pd.DataFrame:
    """A little-endian account: 8 bytes of tag, five unsigned longs, one flag."""

    def one(b):
        if b is None or len(b) < 49:
            return (None, None, None)
        _, tokens, sol, _, real, _, done = struct.unpack("<8sQQQQQ?", bytes(b[:49]))
        return (sol / tokens if tokens else None, max(0.0, min(1.0, real / 85e9)), done)

    return pd.DataFrame([one(b) for b in raw], columns=["price", "progress", "complete"])
