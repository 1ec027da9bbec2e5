"""A registry of models: factories by name, each loaded once a worker and run on Arrow batches.

Networks themselves aren't part of this engine; a factory may load any.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from graphloom.store import ship

#: Factories: a name, and what makes a function from a list of values to a list of vectors.
FACTORIES: dict[str, Callable[[], Callable[[list], list]]] = {}
_LOADED: dict[str, Callable[[list], list]] = {}


def register(name: str, factory: Callable[[], Callable[[list], list]]) -> None:
    FACTORIES[name] = factory


def registered() -> list[str]:
    return sorted(FACTORIES)


def embed(name: str, column: str | Column) -> Column:
    """Vectors of a column by a registered model."""
    ship(SparkSession.active())
    factory = FACTORIES[name]

    @F.pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        from graphloom.functions import models

        if name not in models._LOADED:
            models._LOADED[name] = factory()
        return pd.Series(models._LOADED[name](values.tolist()))

    return run(column)


def detect(name: str, column: str | Column) -> Column:
    """Boxes of a column by a registered model: arrays of (label, x, y, width, height, confidence)."""
    ship(SparkSession.active())
    factory = FACTORIES[name]

    @F.pandas_udf("array<struct<label:string,x:double,y:double,width:double,height:double,confidence:double>>")
    def run(values: pd.Series) -> pd.Series:
        from graphloom.functions import models

        if name not in models._LOADED:
            models._LOADED[name] = factory()
        return pd.Series(models._LOADED[name](values.tolist()))

    return run(column)


def hashed_bag(dim: int = 64) -> Callable[[], Callable[[list], list]]:
    """A factory that needs no weights: signed counts of hashed words."""

    def factory():
        import zlib

        def run(texts: list) -> list:
            out = []
            for t in texts:
                v = np.zeros(dim, np.float32)
                for w in (t or "").lower().split():
                    h = zlib.crc32(w.encode())
                    v[h % dim] += 1 if h >> 31 else -1
                out.append(v.tolist())
            return out

        return run

    return factory


register("hashed-bag", hashed_bag())
