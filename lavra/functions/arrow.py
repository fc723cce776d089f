"""Helpers around mapInArrow."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SMALL_PIECE = 1 << 18


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per context, so that they need no installation or path of their own."""
    context = spark.sparkContext
    if getattr(context, "_lavra_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="lavra-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    at = Path(folder) / f"{root.name}.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(f.relative_to(root.parent)))
    context.addPyFile(str(at))
    context._lavra_shipped = True


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def lists(values: pa.Array, offsets) -> pa.Array:
    """A list column from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
