"""Stable identifiers: FNV-1a over length-prefixed components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---- fixed values: 64-bit FNV-1a
OFFSET_BASIS, PRIME = 0xCBF29CE484222325, 0x100000001B3
# ----


def fnv1a(values: pd.Series) -> pd.Series:
    """Lower-case hexadecimal hashes without leading zeros of byte strings, all rows a byte at a time."""
    lengths = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-lengths, kind="stable")
    out = np.full(len(values), OFFSET_BASIS, np.uint64)
    joined = np.frombuffer(b"".join(values.iloc[i] for i in order), np.uint8).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths[order])[:-1]]) if len(order) else np.empty(0, np.int64)
    state = out[order]
    ordered = lengths[order]
    for j in range(int(ordered[0]) if len(ordered) else 0):
        n = int(np.searchsorted(-ordered, -j, side="left"))  # rows longer than j
        state[:n] = (state[:n] ^ joined[starts[:n] + j]) * np.uint64(PRIME)
    out[order] = state
    return pd.Series([f"{x:x}" for x in out.tolist()])


@F.pandas_udf(StringType())
def _fnv1a(values: pd.Series) -> pd.Series:
    return fnv1a(values)


def stable_id(prefix: str, *components: Column) -> Column:
    """``prefix-<hash>``; a component is its UTF-8 length, a colon, its bytes and 0xFF. The same input, the same id."""
    end = F.unhex(F.lit("FF"))
    text = [F.encode(c.cast("string"), "UTF-8") for c in components]
    parts = [x for t in text for x in (F.encode(F.concat(F.octet_length(t).cast("string"), F.lit(":")), "UTF-8"), t, end)]
    return F.concat(F.lit(prefix + "-"), _fnv1a(F.concat(*parts)))
