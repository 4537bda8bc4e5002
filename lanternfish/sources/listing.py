"""Listings of source trees as tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P

ENTRIES = "path string, rel_path string, folder boolean, mtime double, size bigint"


def _file_system(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _milliseconds(ns: int | None) -> float:
    return (ns or 0) // 1_000_000 / 1000


def list_files(spark: SparkSession, root: str, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """(path, rel_path, mtime, size, language) of the supported files under a root. Folders are listed in rounds, a level each,
    their share by each task, and pruned before the next round: nothing below an excluded or hidden one is ever opened. keep
    holds what a round has found, so that no round is run twice; an index writes it and reads it again. Links to folders aren't followed; a folder
    that can't be read counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = _file_system(root)
        for batch in batches:
            for path, rel in batch[["path", "rel_path"]].itertuples(index=False):
                try:
                    found = system.get_file_info(fs.FileSelector(path))
                except OSError:
                    continue
                rows = [(x.path, f"{rel}{x.base_name}", x.type == fs.FileType.Directory, _milliseconds(x.mtime_ns), x.size or 0) for x in found if not (x.type == fs.FileType.Directory and os.path.islink(x.path))]
                yield pd.DataFrame(rows, columns=["path", "rel_path", "folder", "mtime", "size"])

    rounds, frontier = [], spark.createDataFrame([(_file_system(root)[1].rstrip("/") or "/", "")], "path string, rel_path string")
    while True:
        rounds.append(keep(frontier.mapInPandas(run, ENTRIES)))
        below = rounds[-1].where("folder").select("path", F.concat("rel_path", F.lit("/")).alias("rel_path")).where(~P.pruned_in_scan(F.col("rel_path")))
        if not (folders := below.count()):
            break
        frontier = below.repartition(min(folders, 4 * spark.sparkContext.defaultParallelism))
    rows = reduce(DataFrame.unionAll, rounds).where(~F.col("folder") & P.supported(F.col("path")))
    return rows.select("path", "rel_path", "mtime", "size", P.language(F.col("path")).alias("language"))


def list_paths(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """The same of some paths alone, those that are there."""
    system, base = _file_system(root)
    found = [x for x in system.get_file_info(paths) if x.type == fs.FileType.File]
    rows = spark.createDataFrame([(x.path, os.path.relpath(x.path, base), _milliseconds(x.mtime_ns), x.size) for x in found], "path string, rel_path string, mtime double, size bigint")
    rows = rows.where(P.supported(F.col("path")) & ~P.pruned_in_scan(F.col("rel_path")) & ~F.startswith("rel_path", F.lit("../")))
    return rows.withColumn("language", P.language(F.col("path")))


def with_content(files: DataFrame, root: str) -> DataFrame:
    """Files (path, ...) with their bytes, read by the tasks that hold their rows; what is gone meanwhile has no row."""
    columns = files.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = _file_system(root)
        for batch in batches:
            for start in range(len(batch)):  # a file at a time: they may be large
                row = batch.iloc[start : start + 1]
                try:
                    with system.open_input_stream(row["path"].iloc[0]) as stream:
                        yield row.assign(content=[stream.read()])
                except OSError:
                    continue

    return files.mapInPandas(run, T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())])).select(*columns, "content")


def save_listing(listing: DataFrame, path: str) -> None:
    listing.drop("content").write.mode("overwrite").json(path)


def load_listing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, rel_path string, mtime double, size bigint, language string").json(path)


def breakdown(listing: DataFrame) -> DataFrame:
    """(language, n) and a row with language null for the total."""
    return listing.rollup("language").agg(F.count("*").alias("n"))
