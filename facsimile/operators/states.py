"""Task states: partial results of numpy work that are merged key by key over the cluster."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 32      # parts of a key's states that are merged apart first


BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, so wide rows do not fill a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def merged_states(states: DataFrame, keys: list[str], merge: Callable) -> DataFrame:
    """``states`` (keys, ``state`` binary) with one row a key, its states merged by ``merge(a, b)``.

    Two rounds: first a key's states are dealt over ``SALTS`` tasks, then what is left
    of it meets.  Within a task the states of a key stand together and are merged as
    they come, so a task holds two of them at a time however many there are.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in states.schema.fields)
    names = states.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for row in zip(*cols):
                key, state = row[:-1], pickle.loads(row[-1])
                if held is not None and key == at:
                    held = merge(held, state)
                    continue
                if held is not None:
                    yield _row(names, b.schema, at, held)
                at, held = key, state
        if held is not None:
            yield _row(names, None, at, held)

    def _row(names, schema, key, state) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, (*key, pickle.dumps(state))))], types)

    types = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in states.schema.fields])
    states = states.select(*keys, "state")
    names = states.columns
    salted = states.withColumn("__salt", F.pmod(F.xxhash64("state"), F.lit(SALTS)))
    once = salted.repartition(*keys, "__salt").sortWithinPartitions(*keys).drop("__salt").mapInArrow(run, kinds)
    return once.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, kinds)


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
