"""User-supplied scorers over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def batch_scorer(rows: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], features: str, keys: list[str]) -> DataFrame:
    """(keys, logits) by a user's model: ``load`` makes it once a task, it maps a matrix of features to one of logits."""
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("logits", T.ArrayType(T.DoubleType()))])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            out = batch[keys].copy()
            out["logits"] = list(np.asarray(model(np.stack(batch[features].to_numpy())), dtype=float)) if len(batch) else []
            yield out

    return rows.select(*keys, features).mapInPandas(score, schema)


def variants(rows: DataFrame, change: Callable[[pd.DataFrame, str], pd.DataFrame], names: list[str]) -> DataFrame:
    """Each row once a named variant, changed by a user's function of a batch and the name."""
    schema = T.StructType([*rows.schema.fields, T.StructField("variant", T.StringType())])

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in names:
                yield change(batch, name).assign(variant=name)

    return rows.mapInPandas(make, schema)
