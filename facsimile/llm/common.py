"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.session import scratch_path

#: Rows and bytes of one Arrow batch between the JVM and a Python worker.
ARROW_ROWS = 1000
ARROW_BYTES = 4 << 20


def arrow_limits(spark: SparkSession) -> None:
    """Keep Arrow batches small, so a run of very long texts does not fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and return a frame that reads it.

    Later passes read the files, so a lost executor never replays what came before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`written` that nothing reads any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/facsimile/" in f:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remainder(id_col: Column, mod: int) -> Column:
    """crc32 of an id written as text, modulo ``mod``; null for a null id."""
    return F.crc32(id_col.cast("string")) % mod


def is_fold(id_col: Column, mod: int, fold: int) -> Column:
    """True where the id's remainder is ``fold``; a null id is in no fold."""
    return F.coalesce(remainder(id_col, mod) == fold, F.lit(False))


def out_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch with the given columns in the order of ``schema``."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


FAN = 16    # states folded by one task, and brought to the driver at last


def folded(states: DataFrame, fold: Callable[[list[bytes]], bytes], name: str) -> list[bytes]:
    """Fold task states (one binary column) to at most ``FAN`` of them, which the driver gets.

    Every round deals the states evenly and writes what is left, a ``FAN``-th of it, so
    no task ever folds more than that many.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for b in batches:
            for raw in b.column(0).to_pylist():
                held = [fold([*held, raw])] if held else [raw]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["state"])

    states = written(states.toDF("state"), name)
    n = states.count()
    while n > FAN:
        n = -(-n // FAN)
        states = written(states.repartition(n).mapInArrow(run, "state binary"), name)
    return [r[0] for r in states.collect()]


def sound_vector(vec: Column) -> Column:
    """True for a vector (array<double>) that is not null and holds neither null nor non-finite entries."""
    return F.coalesce(vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matrices(batch: pa.RecordBatch, column: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) for each length of the vectors in a batch's list column."""
    col = batch.column(column)
    size = pc.list_value_length(col).to_numpy()
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        part = col if len(rows) == len(col) else col.take(pa.array(rows))
        yield d, rows, part.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), d)


HOT = 1000      # a key with more than this share of all rows goes by broadcast: fewer keys than this


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` joined with ``table``, which has each key once and, in ``weight``, its number of rows.

    Keys with more than a ``HOT``-th of all rows, of which there are fewer than ``HOT``,
    meet their rows by broadcast; those left are too small to fill a task and meet by a
    merge.  ``weight`` stays a column of the result; rows without a match are left out.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(table.where(F.col(weight) * HOT > total))
    cold = table.where(F.col(weight) * HOT <= total).hint("merge")
    names = [*rows.columns, *(c for c in table.columns if c not in rows.columns)]
    few = rows.join(hot, keys)
    rest = rows.join(F.broadcast(table.where(F.col(weight) * HOT > total).select(*keys)), keys, "left_anti").join(cold, keys)
    return few.select(*names).unionByName(rest.select(*names))
