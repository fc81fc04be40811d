"""Vector functions on ARRAY<FLOAT> or ARRAY<DOUBLE> columns, evaluated by the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    # The vector and its length enter the function as data, so a vector made by an Arrow function may be passed.
    both = F.array(F.struct(a.alias("v"), norm(a).alias("n")))
    return F.element_at(F.transform(both, lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(x.cast("double")))), 1)


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


#: Texts whose vectors are held at once.
TEXTS = 8192


def hashed_embedding(dims: int = 256):
    """Offline stand-in for an embedder: an Arrow function from token hashes (array<long>) to signed counts by hash,
    unit length. Much weaker than a neural model, but deterministic. Its ``agreement`` (lists of tokens to dot products of
    neighbours) makes the vectors of a row's texts where they are compared."""

    @F.pandas_udf("array<float>")
    def embed(hashes: pd.Series) -> pd.Series:
        def one(h) -> np.ndarray:
            h = np.asarray(h if h is not None else [], np.int64)
            v = np.bincount(h % dims, np.where((h >> 40) & 1, 1.0, -1.0), dims)
            n = np.sqrt((v * v).sum())
            return (v / n if n else v).astype(np.float32)

        return hashes.map(one)

    @F.arrow_udf("array<double>")
    def agreement(lists: pa.Array) -> pa.Array:
        """For each list of texts (hashes of each) the dot products of neighbouring vectors; 0 for the first text."""
        texts = lists.flatten()
        hashes = np.asarray(texts.flatten(), np.int64)
        of = np.repeat(np.arange(len(texts)), np.asarray(texts.value_lengths(), np.int64))
        first = np.cumsum(np.asarray(lists.value_lengths().fill_null(0), np.int64))
        out = np.zeros(len(texts))
        for lo in range(1, len(texts), TEXTS):
            hi = min(lo + TEXTS, len(texts))
            some = slice(*np.searchsorted(of, [lo - 1, hi]))
            n, h = hi - lo + 1, hashes[some]
            v = np.bincount(h % dims * n + of[some] - (lo - 1), np.where((h >> 40) & 1, 1.0, -1.0), dims * n).reshape(dims, n)
            size = np.sqrt((v * v).sum(axis=0))
            v = np.divide(v, size, out=v, where=size > 0).astype(np.float32).astype(np.float64)
            for row in v:  # place by place, as ``dot`` adds
                out[lo:hi] += row[:-1] * row[1:]
        out[first[first < len(texts)]] = 0.0
        offsets = pa.array(np.r_[0, first].astype(np.int32), mask=np.r_[np.asarray(lists.is_null()), False] if lists.null_count else None)
        return pa.ListArray.from_arrays(offsets, pa.array(out))

    def hashed(tokens):
        return F.transform(tokens, lambda t: F.xxhash64(t))  # an Arrow function cannot stand inside a higher-order one

    def vector(tokens):
        return embed(hashed(tokens))

    vector.agreement = lambda lists: agreement(F.transform(lists, hashed))
    return vector


def checked(a: Column, dims: int) -> Column:
    """The vector if it has ``dims`` places; an error otherwise."""
    return F.when(F.size(a) == dims, a).otherwise(F.raise_error(F.concat(F.lit(f"vector of {dims} places expected, found "), F.size(a).cast("string"))))
