"""Embedding in batches and waves: what fails is set aside, and what is done stays done."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranking

#: Texts of a batch, times that a task tries one.
BATCH, TRIES = 64, 2

Embedder = Callable[[list[str]], list[list[float]]]


def batched(pending: DataFrame, order: str, wave_batches: int, keep: Callable[[DataFrame], DataFrame], batch: int = BATCH) -> DataFrame:
    """pending with the numbers of batch and wave: runs of so many rows in one order, and runs of so many batches."""
    at = F.col("place") - 1
    return ranking.place_sorted(pending, [F.col(order)], keep).withColumn("batch", F.floor(at / batch)).withColumn("wave", F.floor(at / (batch * wave_batches))).drop("place")


def embedded(rows: DataFrame, id_col: str, text_col: str, embedder: Embedder, tries: int = TRIES) -> DataFrame:
    """(id_col, batch, vector, error) of rows with their batch: a batch that the embedder fails on, or gives another number of
    vectors for, has an error in place of vectors. Other batches don't notice."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        texts, vectors, error = frame[text_col].tolist(), None, None
        for _ in range(tries):
            try:
                vectors, error = embedder(texts), None
                if len(vectors) == len(texts):
                    break
                error, vectors = f"{len(vectors)} vectors for {len(texts)} texts", None
            except Exception as why:  # an embedder's failures are counted, not the job's
                error = f"{type(why).__name__}: {why}"
        return pd.DataFrame({id_col: frame[id_col], "batch": frame["batch"], "vector": vectors if vectors is not None else [None] * len(texts), "error": error})

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, "batch", text_col).groupBy("batch").applyInPandas(run, f"{id_col} {kind}, batch bigint, vector array<double>, error string")
