"""Size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """Broadcast a side that a count proves small; otherwise leave the join to Catalyst and AQE.

    Used for request-shaped sides (queries, vocabularies, runs, policies), whose
    rows are at most a few hundred bytes unless ``max_rows`` says otherwise.
    """
    return F.broadcast(df) if df.count() <= max_rows else df
