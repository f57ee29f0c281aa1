"""Vectors as arrays of floats; products in double."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import STOP_WORDS


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Of length one; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


@lru_cache(maxsize=1 << 18)
def _bucket(token: str, dim: int) -> tuple[int, float]:
    h = hashlib.blake2b(token.encode(), digest_size=8).digest()
    return int.from_bytes(h[:4], "little") % dim, 1.0 if h[4] & 1 else -1.0


def hash_vectors(texts: list[str | None], dim: int = 256) -> np.ndarray:
    """Signed buckets of content words, twice, and of word pairs; rows of length one."""
    import re

    out = np.zeros((len(texts), dim), np.float32)
    for row, text in enumerate(texts):
        words = re.findall("[a-z0-9]+", (text or "").lower())
        content = [w for w in words if w not in STOP_WORDS]
        for feature, weight in [*((w, 2.0) for w in content), *((f"{a}_{b}", 1.0) for a, b in zip(words, words[1:], strict=False))]:
            at, sign = _bucket(feature, dim)
            out[row, at] += sign * weight
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def hash_embedding(dim: int = 256):
    """A pandas UDF: text -> vector. No built-in makes blake2b."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(hash_vectors(list(texts), dim)))

    return embed
