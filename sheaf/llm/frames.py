"""Small helpers for the pandas side of Arrow functions."""

from __future__ import annotations

import pandas as pd


def plain(pdf: pd.DataFrame) -> pd.DataFrame:
    """A frame that converts to Arrow arrays of its schema: empty columns have no number type of their own."""
    return pdf.astype(object) if pdf.empty else pdf


def empty(*columns: str) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
