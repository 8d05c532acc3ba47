"""Independent synthesis: numeric columns from N(mean, std), the others by weighted
resampling of their observed values; plus the sample table generator and batches.

Every random number is a hash of (synthetic row id, column, seed), so the rows do not
depend on partitioning and the md5 form has an exact SQL twin.

Weighted resampling of a column with N non-null values: sort the distinct values,
give each an interval [lo, hi) of width = its count on 0..N-1, draw idx = floor(u*N)
and take the value whose interval holds idx.  The lookup is an equi-join on
block = idx div B (intervals exploded to the blocks they touch) plus a range filter:
broadcast when the exploded table is proven small, shuffle-hash otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions.names import free_name, named
from facsimile.functions import rng
from facsimile.functions.consts import const_map
from facsimile.functions.fmt import round2, round_year
from facsimile.operators.profile import num, profile
from facsimile.schema import ColumnSpec, SynthConfig
from facsimile.session import cut_lineage, default_parallelism, reused, written

DRIVER_FREQ_LIMIT = 20000        # distinct values collected to build a broadcast lookup
DRIVER_BYTES_LIMIT = 64 << 20    # ... and their bytes
BROADCAST_BLOCK_LIMIT = 2000000  # exploded lookup rows allowed in a broadcast
ROWS_PER_PARTITION = 1000000     # synthetic rows generated per task
CHUNK = 1 << 20                  # blocks per first-level chunk of the two-level explode


ROW = "__synthetic_row__"           # name of a synthetic row's number, beside the source's columns


def synthetic_ids(spark: SparkSession, n: int, name: str = "id") -> DataFrame:
    parts = max(default_parallelism(spark), math.ceil(n / ROWS_PER_PARTITION))
    return spark.range(0, n, 1, numPartitions=parts).toDF(name)


# ---------------------------------------------------------------- numeric

def numeric_draw(row_id: Column, spec: ColumnSpec, seed: int, fast: bool) -> Column:
    """N(mean, std); a constant (or single-row) column repeats its mean; all-null -> null."""
    if spec.mean is None:
        return F.lit(None).cast("double")
    if spec.std is None or spec.std == 0 or math.isnan(spec.std):
        return F.lit(float(spec.mean))
    return rng.normal(row_id, spec.name, spec.mean, spec.std, seed, fast)


def format_numeric(c: Column, spec: ColumnSpec, keep_int: bool = False) -> Column:
    """Year-like -> half-even integer; other numbers -> 2 decimals (ints too, unless keep_int)."""
    if spec.is_year:
        return round_year(c)
    if keep_int and spec.dtype in ("tinyint", "smallint", "int", "bigint"):
        return round_year(c)
    return round2(c)


# ---------------------------------------------------------------- categorical lookup

def _offsets_distributed(freq: DataFrame, order: list[str]) -> DataFrame:
    """Prefix sums over a large frequency table without a global window.

    Range-partition by the sort key, sort inside partitions, checkpoint (the two uses
    below must see the same partitions), add each partition's starting offset (one
    number per partition) to a running sum inside the partition.
    """
    spark = freq.sparkSession
    parts = default_parallelism(spark)
    ranged = (freq.repartitionByRange(parts, *order).sortWithinPartitions(*order)
              .withColumn("pid", F.spark_partition_id()))
    ranged = cut_lineage(ranged)
    totals = sorted((r["pid"], r["t"]) for r in ranged.groupBy("pid").agg(F.sum("cnt").alias("t")).collect())
    start, acc = {}, 0
    for pid, t in totals:
        start[pid] = acc
        acc += t
    off = const_map(start)   # one number per partition, one expression
    base = off[F.col("pid").cast("long")] if off is not None else F.lit(0)
    w = Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    hi = F.sum("cnt").over(w) + base
    return ranged.select(*order, (hi - F.col("cnt")).alias("lo"), hi.alias("hi"))


def _blocks(intervals: DataFrame, block: int) -> DataFrame:
    """(block, v, lo, hi) for every block an interval touches.

    Two explode levels with a repartition between keep the rows any one task creates
    bounded even when one value holds a third of the column.
    """
    first = F.floor(F.col("lo") / block).cast("long")
    last = F.floor((F.col("hi") - 1) / block).cast("long")
    lvl1 = intervals.select("v", "lo", "hi", first.alias("b0"), last.alias("b1"),
                            F.explode(F.sequence(F.floor(first / CHUNK), F.floor(last / CHUNK))).alias("chunk"))
    lvl1 = lvl1.repartition(default_parallelism(intervals.sparkSession))
    lo_b = F.greatest(F.col("b0"), F.col("chunk") * CHUNK)
    hi_b = F.least(F.col("b1"), F.col("chunk") * CHUNK + (CHUNK - 1))
    return lvl1.select(F.explode(F.sequence(lo_b, hi_b)).alias("block"), "v", "lo", "hi")


class Lookup:
    """Weighted-resampling lookup: intervals of the sorted (group, value) pairs laid
    end to end on 0..N-1, cut into blocks of ``block`` positions.

    ``groups`` maps each group to (start, count) of its stretch; without a group there
    is one stretch (None -> (0, N)).
    """

    def __init__(self, blocks: DataFrame, block: int, broadcastable: bool, groups: dict):
        self.blocks, self.block, self.broadcastable, self.groups = blocks, block, broadcastable, groups


def _lookup_from_rows(spark, rows: list[tuple], dtype: str, grouped: bool) -> Lookup:
    """Driver-side prefix sums for a proven-small frequency table [(group, value, count)]."""
    rows = sorted(rows, key=lambda r: ((r[0] if grouped else 0), r[1]))
    ivs, groups, lo = [], {}, 0
    for g, v, cnt in rows:
        g = g if grouped else None
        if g not in groups:
            groups[g] = [lo, 0]
        groups[g][1] += cnt
        ivs.append((v, lo, lo + cnt))
        lo += cnt
    if not grouped and None not in groups:
        groups[None] = [0, 0]
    block = max(1, math.ceil(lo / max(1, len(ivs))))
    tbl = [(b, v, a, z) for v, a, z in ivs for b in range(a // block, (z - 1) // block + 1)]
    blocks = spark.createDataFrame(tbl, f"block long, v {dtype}, lo long, hi long")
    return Lookup(blocks, block, True, {g: tuple(x) for g, x in groups.items()})


def _few(counts: DataFrame, values: list[str], rows: int) -> bool:
    """Whether a written table of counts may be collected: proven by its rows and its values' bytes."""
    size = sum((F.coalesce(F.octet_length(F.col(v).cast("string")), F.lit(0)) for v in values), F.lit(0))
    r = counts.agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("long")).alias("b")).first()
    return r["n"] <= rows and (r["b"] or 0) <= DRIVER_BYTES_LIMIT


def small_lookups(df: DataFrame, columns: list[str]) -> dict[str, Lookup]:
    """Lookups of several small columns from ONE scan: each row is exploded into one
    typed cell per column and counted per (column, value).  The counts are written; a
    column is collected only if its part of them is proven small, and is left out here (for
    the distributed lookup) if it is not."""
    if not columns:
        return {}
    cells = [F.struct(F.lit(k).alias("k"), *[(named(c) if j == k else F.lit(None).cast(df.schema[c].dataType))
                                              .alias(f"v{j}") for j, c in enumerate(columns)])
             for k, c in enumerate(columns)]
    long = df.select(F.explode(F.array(*cells)).alias("z")).select("z.*")
    keep = F.lit(False)
    for k in range(len(columns)):
        keep = keep | ((F.col("k") == k) & F.col(f"v{k}").isNotNull())
    values = [f"v{k}" for k in range(len(columns))]
    counts = written(long.where(keep).groupBy(*long.columns).agg(F.count(F.lit(1)).alias("cnt")), "counts")
    size = sum((F.coalesce(F.octet_length(F.col(v).cast("string")), F.lit(0)) for v in values), F.lit(0)).cast("long")
    small = [r["k"] for r in counts.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).collect()     # a row a column
             if r["n"] <= DRIVER_FREQ_LIMIT and r["b"] <= DRIVER_BYTES_LIMIT]
    rows = counts.where(F.col("k").isin(small)).collect() if small else []
    return {columns[k]: _lookup_from_rows(df.sparkSession, [(None, r[f"v{k}"], r["cnt"]) for r in rows if r["k"] == k],
                                          df.schema[columns[k]].dataType.simpleString(), False) for k in small}


def categorical_lookup(df: DataFrame, column: str, spec: ColumnSpec | None = None,
                       group: str | None = None) -> Lookup:
    spark = df.sparkSession
    keys = ([named(group).alias("g")] if group else []) + [named(column).alias("v")]
    freq = written(df.where(named(column).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")), "freq")
    dtype = freq.schema["v"].dataType.simpleString()
    if DRIVER_FREQ_LIMIT and _few(freq, ["g", "v"] if group else ["v"], DRIVER_FREQ_LIMIT):
        return _lookup_from_rows(spark, [((r["g"] if group else None), r["v"], r["cnt"]) for r in freq.collect()], dtype, bool(group))
    order = (["g"] if group else []) + ["v"]
    intervals = _offsets_distributed(freq, order)
    if group:
        groups = {r["g"]: (int(r["s"]), int(r["n"])) for r in
                  intervals.groupBy("g").agg(F.min("lo").alias("s"), F.sum(F.col("hi") - F.col("lo")).alias("n"))
                  .collect()}   # one row per group (datasets)
    stats = intervals.agg(F.count(F.lit(1)).alias("d"), F.max("hi").alias("n")).first()
    d, n_total = int(stats["d"]), int(stats["n"] or 0)
    if not group:
        groups = {None: (0, n_total)}
    block = max(1, math.ceil(n_total / max(1, d)))
    # the rows and the bytes of what a broadcast would carry
    wide = intervals.agg(F.max(F.octet_length(F.col("v").cast("string")))).first()[0] or 0
    rows = d + n_total // block
    return Lookup(_blocks(intervals.select("v", "lo", "hi"), block), block,
                  rows <= BROADCAST_BLOCK_LIMIT and rows * wide <= DRIVER_BYTES_LIMIT, groups)


def _group_lookup(groups: dict, group: str | None, which: int) -> Column:
    if group is None:
        return F.lit(groups[None][which] if None in groups else 0)
    # text keys (dataset names) as one expression; other key types keep their own literal type
    m = const_map({g: v[which] for g, v in groups.items()}) if all(isinstance(g, str) for g in groups) else None
    if m is None:
        m = F.create_map(*[F.lit(x) for g, v in groups.items() for x in (g, v[which])])
    return F.coalesce(m[named(group)], F.lit(0))


def resample_column(ids: DataFrame, df: DataFrame, column: str, spec: ColumnSpec | None,
                    seed: int, fast: bool, out: str | None = None, group: str | None = None,
                    lookup: Lookup | None = None, row: str = "id") -> DataFrame:
    """Add ``out`` (default ``column``) to ``ids`` by weighted resampling of ``df[column]``
    (within the row's ``group`` when given); ``row`` names the row number.  A group with no value gets ''."""
    out = out or column
    lk = lookup if lookup is not None else categorical_lookup(df, column, spec, group)
    vtype = lk.blocks.schema["v"].dataType
    start, count = _group_lookup(lk.groups, group, 0), _group_lookup(lk.groups, group, 1)
    idx = start + F.floor(rng.uniform(named(row), column, seed, fast) * count).cast("long")
    draws = (ids.withColumn("__idx", F.when(count > 0, idx))
             .withColumn("__blk", F.floor(F.col("__idx") / lk.block).cast("long")))
    right = lk.blocks.select(F.col("block").alias("__blk"), F.col("v").alias(out),
                             F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
    if lk.broadcastable:
        right = F.broadcast(right)
    joined = draws.join(right, (draws["__blk"] == right["__blk"]) & (draws["__idx"] >= right["__lo"])
                        & (draws["__idx"] < right["__hi"]), "left")
    empty = F.lit("") if isinstance(vtype, T.StringType) else F.lit(None).cast(vtype)
    return (joined.withColumn(out, F.when(F.col("__idx").isNull(), empty).otherwise(named(out)))
            .drop("__idx", "__blk", "__lo", "__hi"))


# ---------------------------------------------------------------- tables

def synthesize_independent(df: DataFrame, config: SynthConfig | None = None,
                           specs: list[ColumnSpec] | None = None, n_rows: int | None = None) -> DataFrame:
    """numeric columns N(mean, std) + format; others by weighted resampling.

    Column order follows the source.  Booleans count as numeric here (as in pandas'
    ``is_numeric_dtype``).  All-null text columns become ''.
    """
    with reused(df) as d:
        return _synthesize_independent(d, config, specs, n_rows)


def _synthesize_independent(df: DataFrame, config: SynthConfig | None, specs: list[ColumnSpec] | None,
                            n_rows: int | None) -> DataFrame:
    cfg = config or SynthConfig()
    if specs is None or n_rows is None:
        n_rows, specs = profile(df)
    n = cfg.num_samples if cfg.num_samples is not None else n_rows
    spark = df.sparkSession
    ids = synthetic_ids(spark, n, ROW)
    by_name = {s.name: s for s in specs}
    num_cols, cat_cols = [], []
    for c in df.columns:
        s = by_name[c]
        (num_cols if s.kind in ("numeric", "boolean") else cat_cols).append(c)
    draws = {c: numeric_draw(F.col(ROW), by_name[c], cfg.seed, cfg.fast) for c in num_cols}
    if cfg.year_rule_on == "synthetic" and num_cols:
        by_name = {**by_name, **synthetic_year_rule(ids, draws, by_name)}
    exprs = [F.col(ROW)] + [format_numeric(draws[c], by_name[c], cfg.keep_int).alias(c) for c in num_cols]
    out = ids.select(*exprs)
    small = [c for c in cat_cols if 0 < by_name[c].count and by_name[c].distinct <= DRIVER_FREQ_LIMIT]
    lookups = small_lookups(df, small)
    for c in cat_cols:
        s = by_name[c]
        if s.count == 0:
            out = out.withColumn(c, F.lit(""))
            continue
        out = resample_column(out, df.select(named(c)), c, s, cfg.seed, cfg.fast, lookup=lookups.get(c), row=ROW)
        if cfg.stringify:
            out = out.withColumn(c, named(c).cast("string"))
    kept = [F.col(ROW).alias(free_name("id", df.columns))] if cfg.keep_id else []
    return out.select(*kept, *[named(c) for c in df.columns])


def synthetic_year_rule(ids: DataFrame, draws: dict[str, Column], specs: dict[str, ColumnSpec]) -> dict:
    """The source's variant of the value rule: judged on the *synthetic* draws (all in
    1900..2100 and fewer than 200 distinct).  One aggregate over the generated ids; the
    exact distinct count is only taken for columns whose draws are all in range and whose
    sketch is small, so the set stays bounded."""
    from dataclasses import replace

    cols = [c for c in draws if specs[c].kind == "numeric"]
    if not cols:
        return {}
    gen = ids.select(*[draws[c].alias(f"d{i}") for i, c in enumerate(cols)])
    r = gen.agg(*[e for i in range(len(cols)) for e in (
        F.coalesce(F.bool_and(F.col(f"d{i}").between(1900, 2100)), F.lit(True)).alias(f"in{i}"),
        F.approx_count_distinct(f"d{i}").alias(f"ad{i}"))]).first()
    small = [i for i in range(len(cols)) if r[f"in{i}"] and r[f"ad{i}"] < 1000]
    exact = gen.agg(*[F.size(F.collect_set(f"d{i}")).alias(f"n{i}") for i in small]).first() if small else {}
    out = {}
    for i, c in enumerate(cols):
        by_value = i in small and exact[f"n{i}"] < 200
        out[c] = replace(specs[c], year_by_value=by_value)
    return out


# ---------------------------------------------------------------- sample table

# Fixed values of the built-in sample table (energy use of buildings).
SAMPLE_START = "2024-01-01 00:00:00"
SAMPLE_BUILDINGS = ["Office", "Retail", "Industrial"]


def sample_energy_table(ids: DataFrame, seed: int = 42, fast: bool = False) -> DataFrame:
    """Hourly rows from 2024-01-01: clipped normals, Bernoulli(0.7), choice of 3, uniform.

    ``ids`` supplies the row ids (``id`` column), so the table grows with whatever
    drives it.
    """
    i = F.col("id")
    return ids.select(
        i.alias("id"),
        F.timestamp_add("HOUR", i, F.lit(SAMPLE_START).cast("timestamp_ntz")).alias("timestamp"),
        round2(rng.clip(rng.normal(i, "energy_consumption", 45, 15, seed, fast), 0, 100)).alias("energy_consumption"),
        round2(rng.normal(i, "temperature", 22, 5, seed, fast)).alias("temperature"),
        round2(rng.clip(rng.normal(i, "humidity", 65, 10, seed, fast), 30, 90)).alias("humidity"),
        rng.bernoulli(i, "occupancy", 0.7, seed, fast).alias("occupancy"),
        rng.choice(i, "building_type", SAMPLE_BUILDINGS, seed, fast).alias("building_type"),
        round2(rng.uniform_between(i, "energy_price", 0.10, 0.30, seed, fast)).alias("energy_price"),
    )


def num_samples_default(rows: int, requested: int | None) -> int:
    """Missing request -> as many rows as the input (slider caps are UI limits, dropped)."""
    return rows if requested is None else int(requested)


__all__ = ["synthesize_independent", "resample_column", "sample_energy_table", "synthetic_ids",
           "numeric_draw", "format_numeric", "num", "num_samples_default"]
