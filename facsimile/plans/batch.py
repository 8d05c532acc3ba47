"""Batch synthesis (F9, F10): many datasets in one Spark job.

The source loops over uploaded files, synthesising each separately and recording a
status row.  Here the datasets are one DataFrame with a ``dataset`` column.  The copula
(the default model) keeps a model row for each dataset
(:mod:`facsimile.operators.copula_groups`); the independent method takes per-dataset
statistics from one ``groupBy``, cuts the synthetic ids of all datasets from one
``range`` and draws categories through the grouped lookup.  A dataset that cannot be
read or synthesised has its reason in the status; the others go on.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.functions import rng
from facsimile.functions.names import free_name, named
from facsimile.operators.copula_groups import synthesize_groups
from facsimile.operators.profile import num, profile
from facsimile.operators.synth import ROW, format_numeric, resample_column, synthetic_ids
from facsimile.schema import SynthConfig

SMALL_TABLE = 20_000        # datasets up to which a row for each of them may be broadcast
DATASET = "__dataset__"     # the datasets' names, beside the source's columns


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose rows are counted and few; beyond that the planner decides."""
    return F.broadcast(df) if rows <= SMALL_TABLE else df


def _dataset_of_id(ids: DataFrame, stretches: list[tuple[str, int, int]]) -> DataFrame:
    """Attach the dataset whose stretch [start, start + n) holds the id.

    An equi-join on a block number plus a range check; a stretch of many blocks is cut
    on the executors.
    """
    spark = ids.sparkSession
    total = sum(n for _, _, n in stretches)
    block = max(1, math.ceil(total / max(1, len(stretches))))
    rows = [(name, s, s + n) for name, s, n in stretches if n > 0]
    tbl = spark.createDataFrame(rows, f"{DATASET} string, __s long, __e long")
    tbl = tbl.withColumn("__b", F.explode(F.sequence(F.expr(f"__s div {block}"), F.expr(f"(__e - 1) div {block}"))))
    j = ids.withColumn("__b", F.floor(F.col(ROW) / block).cast("long"))
    j = j.join(_small(tbl, 2 * len(rows)), (j["__b"] == tbl["__b"]) & (j[ROW] >= tbl["__s"]) & (j[ROW] < tbl["__e"]))
    return j.select(ROW, DATASET)


def synthesize_batch(df: DataFrame, key: str = "dataset", config: SynthConfig | None = None) -> DataFrame:
    """(dataset, id, <columns>) -- a synthetic table per dataset, by ``config.method``.

    ``config.num_samples`` is the row count per dataset (None: as many as its source).
    'independent': numeric draws use the dataset's own mean and std; other columns
    resample the dataset's own values; 'copula': see ``synthesize_groups``.  Formatting
    follows the whole batch's profile.  A null dataset is one of its own.  Where a source column is
    called ``dataset`` or ``id``, the output's own columns get an underscore in front.
    """
    cfg = config or SynthConfig(method="independent")
    if cfg.method == "copula":
        return synthesize_groups(df, key, cfg)[0]
    cols = [c for c in df.columns if c != key]
    _, specs = profile(df.select(*[named(c) for c in cols]))
    by = {s.name: s for s in specs}
    numeric = [c for c in cols if by[c].kind in ("numeric", "boolean")]
    cats = [c for c in cols if c not in numeric]
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    # null stays a dataset: names travel with a mark in front
    src = df.withColumn(DATASET, F.coalesce(F.concat(F.lit("="), named(key).cast("string")), F.lit("-")))
    stats = src.groupBy(DATASET).agg(
        F.count(F.lit(1)).alias("__n"),
        *[e for i, c in enumerate(numeric) for e in (F.avg(num(c, types[c])).alias(f"__m{i}"),
                                                     F.stddev_samp(num(c, types[c])).alias(f"__s{i}"))])
    rows = sorted(stats.select(DATASET, "__n").collect())   # one row per dataset
    stretches, start = [], 0
    for name, have in rows:
        n = have if cfg.num_samples is None else int(cfg.num_samples)
        stretches.append((name, start, n))
        start += n
    out = _dataset_of_id(synthetic_ids(df.sparkSession, start, ROW), stretches).join(_small(stats, len(rows)), DATASET)
    exprs = [F.col(DATASET), F.col(ROW)]
    for i, c in enumerate(numeric):
        m, s = F.col(f"__m{i}"), F.col(f"__s{i}")
        z = rng.standard_normal(F.col(ROW), c, cfg.seed, cfg.fast)
        draw = F.when(s.isNull() | (s == 0), m).otherwise(m + s * z)
        exprs.append(format_numeric(draw, by[c], cfg.keep_int).alias(c))
    out = out.select(*exprs)
    for c in cats:
        out = resample_column(out, src.select(DATASET, named(c)), c, by[c], cfg.seed, cfg.fast, group=DATASET, row=ROW)
    dataset = free_name("dataset", cols)
    name = F.when(F.col(DATASET) != "-", F.substring(DATASET, 2, 1 << 30))
    return out.select(name.alias(dataset), F.col(ROW).alias(free_name("id", [*cols, dataset])), *[named(c) for c in cols])


def batch_status(original: DataFrame, synthetic: DataFrame, key: str = "dataset") -> DataFrame:
    """(dataset, original_rows, synthetic_rows, status) -- 'Success' when rows came out."""
    o = original.groupBy(named(key).cast("string").alias("dataset")).agg(F.count(F.lit(1)).alias("original_rows"))
    s = synthetic.groupBy("dataset").agg(F.count(F.lit(1)).alias("synthetic_rows"))
    j = o.join(s.withColumnRenamed("dataset", "__d"), F.col("dataset").eqNullSafe(F.col("__d")), "left")
    return j.select("dataset", "original_rows", F.coalesce("synthetic_rows", F.lit(0)).alias("synthetic_rows"),
                    F.when(F.col("synthetic_rows") > 0, F.lit("Success")).otherwise(F.lit("Failed")).alias("status"))


def run_batch(spark, paths: list[str], output_dir: str, config: SynthConfig | None = None):
    """The batch flow: read many CSV files, synthesise every good dataset in one job, write
    one folder per dataset, return the status.

    Files may differ in layout: a dataset has the columns of its own file.  A bad file is
    reported with its reason, one with a header alone as 'Failed', and the others go on.
    Output folders follow the '<name>_synthetic.csv' naming as partition values.
    """
    from facsimile.functions.text import synthetic_file_name
    from facsimile.sources import io

    cfg = config or SynthConfig(method="copula")
    done = None
    layouts, load_status = io.read_csv_layouts(spark, paths)
    for k, data in enumerate(layouts):      # one job for each layout, however many files share it
        key = free_name("dataset", [c for c in data.columns if c != io.FILE])
        data = data.withColumnRenamed(io.FILE, key)
        if cfg.method == "copula":
            fake, status = synthesize_groups(data, key, cfg)
        else:
            fake = synthesize_batch(data, key, cfg)
            status = batch_status(data, fake.select(F.col(fake.columns[0]).alias("dataset")), key)
        place = fake.withColumn("__file", synthetic_file_name(F.col(fake.columns[0]))).drop(*fake.columns[:2])
        io.write_batch(place.withColumnRenamed("__file", key), f"{output_dir}/layout={k}", key)
        done = status if done is None else done.unionByName(status)
    bad = load_status.where(F.col("status") != "Loaded").select(
        "dataset", F.col("rows").alias("original_rows"), F.lit(0).cast("bigint").alias("synthetic_rows"), "status")
    done = bad if done is None else done.unionByName(bad)
    return done.withColumn("dataset", synthetic_file_name(F.col("dataset")))
