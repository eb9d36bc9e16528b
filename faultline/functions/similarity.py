"""Lexical similarity that no SQL function gives: the ratio of matching blocks of two normalised texts."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.text import normalize_answer


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([1.0 if not x and not y else 0.0 if not x or not y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def semantic_similarity(prediction: Column, gold: Column) -> Column:
    """Normalisation stays in the JVM; only the block matching runs in Arrow batches."""
    return _ratio(normalize_answer(prediction), normalize_answer(gold))
