"""Boosted models as stored trees: an append-only, versioned registry, and scoring through it.

    <root>/trees/version=<v>/name=<slug>     one folder for each model: its trees as arrays
    <root>/models                            one row for each model and version, only ever added to

Rows are scored in one pass, whatever the number of models: each row carries the path of
its model, and a task keeps the models it met last. Nothing is filtered or scanned per zone.
"""

from __future__ import annotations

import re
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast.session import shared_folder

#: Models that a task keeps at once.
KEPT = 16
COLUMNS = ["model", "tree", "feature", "threshold", "value"]


def slug(name: Column) -> Column:
    """A folder name of its own for every model name."""
    return F.concat(F.lower(F.regexp_replace(name, "[^A-Za-z0-9]+", "_")), F.lit("_"), F.hex(F.crc32(name.cast("binary"))))


def path_of(root: str, name: Column) -> Column:
    return F.concat(F.lit(f"{root}/name="), slug(name))


def publish(trees: DataFrame, root: str | None = None, version: str | None = None) -> str:
    """Store trees, a folder for each model, under a version of their own; returns the folder above them."""
    folder = f"{root or shared_folder(trees.sparkSession)}/trees/version={version or uuid.uuid4().hex}"
    trees.withColumn("name", slug(F.col("model"))).repartition("name").sortWithinPartitions("name", "tree").write.partitionBy("name").parquet(folder)
    return folder


def load(path: str) -> list[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Trees of one model's folder, as tasks read them: name, number, inputs, thresholds, values."""
    system, base = _system(path)
    table = pq.read_table(base, filesystem=system, columns=COLUMNS, partitioning=None).sort_by("tree")
    plain, arrays = (table[c].to_pylist() for c in COLUMNS[:2]), (table[c] for c in COLUMNS[2:])
    return [(name, tree, *(v.values.to_numpy() for v in found)) for name, tree, *found in zip(*plain, *arrays)]


def _system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path; a bare path is a shared mount."""
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def stacked(trees: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """All trees of a model in three arrays, a row for each, and the number of levels."""
    size = max(len(t[2]) for t in trees)
    feature, threshold, value = np.full((len(trees), size), -1, np.int32), np.zeros((len(trees), size)), np.zeros((len(trees), size))
    for k, (_, _, f, t, v) in enumerate(trees):
        feature[k, : len(f)], threshold[k, : len(f)], value[k, : len(f)] = f, t, v
    return feature, threshold, value, size.bit_length() - 1


def apply(model: tuple[np.ndarray, np.ndarray, np.ndarray, int], x: np.ndarray, some: int = 64) -> np.ndarray:
    """Sum of all trees for each row of inputs; an unknown input counts as the largest."""
    feature, threshold, value, levels = model
    columns = np.ascontiguousarray(np.where(np.isnan(x), np.inf, x).T).ravel()
    out, rows, nodes = np.zeros(len(x)), np.arange(len(x)), np.arange(feature.shape[1])
    for at in range(0, len(feature), some):
        part = np.empty((len(x), min(some, len(feature) - at)))
        for k in range(part.shape[1]):
            # A leaf's next node is itself, since nothing is above infinity.
            inner = feature[at + k] >= 0
            start, limit, left = np.where(inner, feature[at + k], 0).astype(np.int64) * len(x), np.where(inner, threshold[at + k], np.inf), np.where(inner, 2 * nodes + 1, nodes)
            node = np.zeros(len(x), np.int64)
            for _ in range(levels):
                where = start.take(node)
                where += rows
                above = columns.take(where) > limit.take(node)
                node = left.take(node)
                node += above
            part[:, k] = value[at + k].take(node)
        out += part.sum(axis=1)
    return out


def predict(rows: DataFrame, features: list[str], path: str, name: str) -> DataFrame:
    """Every row with the prediction of the model at its path, null where the path is; one pass, no shuffle."""
    kept_columns, at = rows.columns, [rows.columns.index(f) for f in features]
    where = rows.columns.index(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: OrderedDict[str, tuple] = OrderedDict()
        for batch in batches:
            paths = np.array(batch.column(where).to_pylist(), object)
            out = np.full(len(paths), np.nan)
            x = np.column_stack([batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in at]) if len(paths) else np.zeros((0, len(at)))
            for one in sorted({p for p in paths if p is not None}):
                if one not in models:
                    models[one] = stacked(load(one))
                    while len(models) > KEPT:
                        models.popitem(last=False)
                models.move_to_end(one)
                mine = np.flatnonzero(paths == one)
                for part in np.array_split(mine, max(1, len(mine) // 4096)):
                    out[part] = apply(models[one], x[part])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64(), mask=np.isnan(out))], [*kept_columns, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))


def append(models: DataFrame, root: str) -> None:
    """Add rows (zone_id, version, model_path, metrics and so on) to the registry; earlier ones stay."""
    models.write.mode("append").parquet(f"{root}/models")


def entries(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.option("mergeSchema", "true").parquet(f"{root}/models")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current(registry: DataFrame) -> DataFrame:
    """The latest version of every zone's model."""
    newest = F.row_number().over(W.partitionBy("zone_id").orderBy(F.desc("trained_at"), F.desc("version")))
    return registry.withColumn("_rank", newest).filter("_rank = 1").drop("_rank")


def routed(rows: DataFrame, registry: DataFrame, default_zone: str) -> DataFrame:
    """Each row with the path of its zone's latest model, else of the default zone's: model_zone, model_path, is_default_model."""
    latest = current(registry).select("zone_id", F.col("model_path").alias("_path"))
    spare = latest.filter(F.col("zone_id") == default_zone).agg(F.max("_path")).first()[0]
    own = F.col("_path").isNotNull()
    return rows.join(latest, "zone_id", "left").withColumns({
        "is_default_model": ~own, "model_zone": F.when(own, F.col("zone_id")).otherwise(F.lit(default_zone)), "model_path": F.coalesce("_path", F.lit(spare)),
    }).drop("_path")
