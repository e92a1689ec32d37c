"""F1 literal_similarity and F2 char_similarity as Arrow-batched pandas UDFs.

Both are ``difflib.SequenceMatcher`` scores, which no built-in Spark function computes
(it is block matching, not LCS). They run only on pairs that survive the native
prefilters (loose in-order substring match, length bands), one Arrow batch at a time.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal_similarity_py(literal_tokens, line) -> float:
    """Share of the template's literal tokens found, in order, in the line's tokens
    (sum of matching block sizes, autojunk off); 0 when there are no literals."""
    lits = list(literal_tokens) if literal_tokens is not None else []
    if not lits or line is None:
        return 0.0
    sm = difflib.SequenceMatcher(None, lits, line.split(), autojunk=False)
    return sum(b.size for b in sm.get_matching_blocks()) / len(lits)


def char_similarity_py(a, b) -> float:
    """SequenceMatcher ratio on the two strings (autojunk on)."""
    if a is None or b is None:
        return 0.0
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def literal_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([literal_similarity_py(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def char_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([char_similarity_py(x, y) for x, y in zip(a, b)], dtype="float64")
