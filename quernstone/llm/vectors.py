"""What the operators on embeddings read: vectors of finite components, scaled to whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256


def whole(vector: Column) -> Column:
    """Each component c as floor(SCALE * c), computed in doubles; an array of long."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not null and holds only finite components; an empty vector is one of those."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.where(F.col(vector).isNotNull() & F.forall(vector, finite))
