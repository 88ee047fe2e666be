from __future__ import annotations

from pyspark.sql import DataFrame


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Raise ``ValueError`` when ``df`` lacks one of ``columns``."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; the frame has {df.columns}")
    return df
