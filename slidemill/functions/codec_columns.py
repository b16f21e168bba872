"""The codec as column functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from slidemill.functions import codec

RANGE = StructType([StructField(c, IntegerType()) for c in ("width", "height", "least", "most")])


@F.pandas_udf(BinaryType())
def grey_jpeg(value: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([codec.encode_jpeg(np.full((h, w, 3), v, np.uint8), 75) for v, w, h in zip(value, width, height, strict=True)])


@F.pandas_udf(RANGE)
def picture_range(data: pd.Series) -> pd.DataFrame:
    images = [codec.decode_image(bytes(b)) for b in data]
    return pd.DataFrame([(i.shape[1], i.shape[0], int(i.min()), int(i.max())) for i in images], columns=["width", "height", "least", "most"])
