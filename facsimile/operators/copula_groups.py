"""Gaussian copulas of many datasets at once: a model row for each dataset, never a job for each.

Fit: one count of the distinct cells of all datasets and columns, ranked by a range sort
(a dataset that holds a third of all rows is many tasks' work); from the ranks, exact
quantile knots or, for columns of few values, the values themselves; then the normal
scores of all rows and one Gram block a dataset; last, a Cholesky factor a dataset.
Everything that belongs to a dataset travels as a row keyed by it, next to the rows of
the dataset (``beside``), so the number of jobs and the size of the plan are the same
for one dataset and for a million, and the driver holds nothing of them.

A dataset that cannot be fitted carries its reason in ``error`` and yields no rows; the
others go on.

Sample: row k of a dataset takes its normals from md5 of (k, column, dataset, seed), so
rows do not depend on partitioning.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions.consts import double_array
from facsimile.functions.fmt import moment_of, round_year, strip, whole_moment
from facsimile.functions.latent import PROBS, Z_N, Marginal, latent_correlation, nearest_positive
from facsimile.functions.names import free_name, named
from facsimile.operators.gram import Block
from facsimile.operators.profile import filled_text, num, profile
from facsimile.operators.states import merged_states, small_batches
from facsimile.operators.synth import format_numeric
from facsimile.schema import LABEL_MAX_DISTINCT, SynthConfig
from facsimile.session import default_parallelism, written

DISCRETE_MAX = 100          # a numeric column of a dataset with so many values at most keeps to these
HOT_ROWS = 1 << 20          # rows of a dataset beyond which they are dealt over several tasks,
HOT_PARTS = 1024            # ... or this share of all rows: fewer datasets than this are dealt so
CHUNK = 1 << 16             # rows of a dataset drawn at a time
CHUNKS = 1 << 14            # chunks of one first-level stretch


@dataclass(frozen=True)
class Plan:
    """Which columns are modelled how; the same for all datasets."""

    numeric: tuple[str, ...]
    text: tuple[str, ...]
    temporal: tuple[str, ...]

    @property
    def modelled(self) -> tuple[str, ...]:
        return self.numeric + self.text

    @property
    def names(self) -> tuple[str, ...]:
        return self.modelled + self.temporal


def _key(c: Column) -> Column:
    """A dataset's name as a key without nulls."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def _name(g: Column) -> Column:
    return F.when(g != F.lit("-"), F.substring(g, 2, 1 << 30))


def plan_columns(df: DataFrame, key: str) -> Plan:
    kinds = {"numeric": [], "text": [], "temporal": []}
    for f in df.schema.fields:
        if f.name == key:
            continue
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            kinds["numeric"].append(f.name)
        elif isinstance(f.dataType, T.StringType):
            kinds["text"].append(f.name)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            kinds["temporal"].append(f.name)
        else:
            raise TypeError(f"unsupported column type: {f.name} {f.dataType.simpleString()}")
    return Plan(*(tuple(v) for v in kinds.values()))


def ranked_cells(df: DataFrame, key: str, plan: Plan) -> DataFrame:
    """(g, c, v, s, cnt, lo, n, d): the distinct cells of every dataset and column in order.

    ``c`` numbers the plan's columns, ``v`` holds a number and ``s`` a text; ``lo`` is
    how many cells of the dataset and column are smaller, ``n`` and ``d`` how many
    there are and how many distinct ones.  Missing numbers and dates are left out;
    missing and blank texts are 'Unknown', as everywhere, but a column of a dataset
    without any text at all has no cells.
    """
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    cells = []
    for i, c in enumerate(plan.names):
        if c in plan.numeric:
            v, s, w = num(named(c), types[c]), none_s, F.lit(1)
        elif c in plan.text:
            v, s, w = none_d, strip(filled_text(c)), F.when(named(c).isNull(), 0).otherwise(1)
        else:
            v, s, w = whole_moment(named(c), types[c]), none_s, F.lit(1)
        cells.append(F.struct(F.lit(i).alias("c"), v.alias("v"), s.alias("s"), w.alias("w")))
    long = df.select(_key(named(key)).alias("g"), F.inline(F.array(*cells))).where("v is not null or s is not null")
    counts = long.groupBy("g", "c", "v", "s").agg(F.count(F.lit(1)).alias("cnt"), F.sum("w").alias("w"))
    order = ["g", "c", "v", "s"]
    ranged = counts.repartitionByRange(default_parallelism(df.sparkSession), *order).withColumn("pid", F.spark_partition_id())
    ranged = written(ranged, "cells")      # the number of a cell's range stays with it
    own = Window.partitionBy("g", "c")     # a row for each range: no more than there are partitions
    before = own.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("pid", "g", "c").agg(F.sum("cnt").alias("t"), F.count(F.lit(1)).alias("k"), F.sum("w").alias("w"))
    parts = parts.select("pid", "g", "c", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"), F.sum("t").over(own).alias("n"),
                         F.sum("k").over(own).alias("d"), F.sum("w").over(own).alias("given"))
    inside = Window.partitionBy("pid", "g", "c").orderBy("v", "s").rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.drop("w").join(parts.where("given > 0").hint("merge"), ["pid", "g", "c"])
            .select("g", "c", "v", "s", "cnt", (F.col("base") + F.coalesce(F.sum("cnt").over(inside), F.lit(0))).alias("lo"), "n", "d"))


def _pieces(ranked: DataFrame, plan: Plan) -> DataFrame:
    """(g, c, kind, k, v, s, cnt, n, d): what a marginal is made of, at most two rows a knot or one a value."""
    limit = F.when(F.col("c") < len(plan.numeric), F.lit(DISCRETE_MAX)).otherwise(F.lit(LABEL_MAX_DISTINCT))
    modelled = ranked.where(F.col("c") < len(plan.modelled))
    few = modelled.where(F.col("d") <= limit).select("g", "c", F.lit("value").alias("kind"), F.lit(0).alias("k"), "v", "s", "cnt", "n", "d")
    probs = [0.0, *PROBS, 1.0]
    many = modelled.where((F.col("c") < len(plan.numeric)) & (F.col("d") > limit))
    # a cell without a target rank inside it or next to it is gone by two binary searches
    many = (many.withColumn("r0", (F.col("lo") - 1.5) / (F.col("n") - 1)).withColumn("r1", (F.col("lo") + F.col("cnt") + 0.5) / (F.col("n") - 1)))
    splits = [-math.inf, *probs, math.inf]
    many = Bucketizer(splitsArray=[splits, splits], inputCols=["r0", "r1"], outputCols=["b0", "b1"]).transform(many).where("b0 <> b1")
    ps = double_array(probs)
    span = F.sequence(F.col("b0").cast("int"), F.col("b1").cast("int") - 1)     # bucket b begins at probability b - 1
    target = lambda k: (F.col("n") - 1) * F.element_at(ps, k + 1)
    held = lambda r: (r >= F.col("lo")) & (r < F.col("lo") + F.col("cnt"))
    low = F.transform(F.filter(span, lambda k: held(F.floor(target(k)))), lambda k: F.struct(k.alias("k"), F.lit("low").alias("kind")))
    high = F.transform(F.filter(span, lambda k: held(F.ceil(target(k)))), lambda k: F.struct(k.alias("k"), F.lit("up").alias("kind")))
    knots = many.select("g", "c", F.explode(F.concat(low, high)).alias("t"), "v", "s", "cnt", "n", "d").select(
        "g", "c", "t.kind", "t.k", "v", "s", "cnt", "n", "d")
    return few.unionByName(knots)


def _marginal(rows: list[tuple]) -> Marginal:
    """A marginal from its pieces [(kind, k, v, s, cnt, n)]."""
    n = rows[0][5]
    if rows[0][0] == "value":
        own = sorted((r[2] if r[3] is None else r[3], r[4]) for r in rows)
        return Marginal(n, values=[v for v, _ in own], cum=np.cumsum([c for _, c in own]) / n)
    at = {(r[0], r[1]): r[2] for r in rows}
    probs = [0.0, *PROBS, 1.0]
    q = []
    for k, p in enumerate(probs):
        h = (n - 1) * p
        lo, hi = at["low", k], at["up", k]
        q.append(lo + (h - math.floor(h)) * (hi - lo))
    return Marginal(n, knots=np.array(q[1:1 + Z_N]), ends=(q[0], q[-1]))


_MODEL = "g string, rows long, payload binary, error string"
_MODEL_ARROW = pa.schema([("g", pa.string()), ("rows", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])


def _model_row(g, rows, payload, error) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(g=g, rows=rows, payload=None if payload is None else pickle.dumps(payload), error=error)], _MODEL_ARROW)


def _reason(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def _assembled(pieces: DataFrame, sizes: DataFrame, plan: Plan) -> DataFrame:
    """(g, rows, payload, error): the marginals of every dataset; ``sizes`` is (g, rows)."""
    head = sizes.select("g", F.lit(-1).alias("c"), F.lit("size").alias("kind"), F.lit(0).alias("k"), F.lit(None).cast("double").alias("v"),
                        F.lit(None).cast("string").alias("s"), F.col("rows").alias("cnt"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("d"))
    together = head.unionByName(pieces).repartition("g").sortWithinPartitions("g", "c", "kind", "k", "v", "s")
    width = len(plan.modelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, held = None, 0, []

        def give():
            try:
                own: list = [None] * width
                for c in sorted({h[0] for h in held}):
                    own[c] = _marginal([h[1:] for h in held if h[0] == c])
                return _model_row(at, rows, dict(marginals=own), None)
            except Exception as e:  # noqa: BLE001 - the dataset's own failure, carried as its row
                return _model_row(at, rows, None, _reason(e))

        for b in batches:
            for g, c, kind, k, v, s, cnt, n in zip(*(b.column(x).to_pylist() for x in ("g", "c", "kind", "k", "v", "s", "cnt", "n"))):
                if g != at:
                    if at is not None:
                        yield give()
                    at, rows, held = g, 0, []
                if c < 0:
                    rows = cnt
                else:
                    held.append((c, kind, k, v, s, cnt, n))
        if at is not None:
            yield give()

    return together.mapInArrow(run, _MODEL)


def beside(rows: DataFrame, models: DataFrame, body: Callable, schema: str) -> DataFrame:
    """``body`` over all rows of every dataset, beside the dataset's model.

    ``rows`` has g and more; ``models`` (g, rows, payload, error) is written already.  A
    dataset's model stands first in each of its tasks and its rows stream past it; a
    dataset with very many rows is dealt over several tasks.  ``body(g, payload, state,
    batch)`` returns the new state; after a dataset's last rows it is called with None
    for the batch and returns what the task yields.  Rows of a dataset whose model is
    an error are passed over.
    """
    total = models.agg(F.sum("rows")).first()[0] or 0
    part = max(HOT_ROWS, -(-total // HOT_PARTS))
    salts = F.expr(f"(rows + {part - 1}) div {part}")
    good = models.where("error is null")
    hot = F.broadcast(good.where(F.col("rows") > part).select("g", salts.alias("salts")))      # fewer than HOT_PARTS rows
    cols = rows.columns
    spread = F.pmod(F.xxhash64(*[named(c) for c in cols if c != "g"]), F.coalesce("salts", F.lit(1))).cast("long")
    body_rows = rows.join(hot, "g", "left").select(*[named(c) for c in cols], spread.alias("salt"), F.lit(1).alias("kind"),
                                                   F.lit(None).cast("binary").alias("payload"))
    heads = good.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(salts, F.lit(1)) - 1)).alias("salt"),
                        F.lit(0).alias("kind"), "payload")
    both = body_rows.unionByName(heads, allowMissingColumns=True)
    both = both.repartition("g", "salt").sortWithinPartitions("g", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, payload, state = None, None, None
        for b in batches:
            g, salt, kind = (b.column(c).to_pylist() for c in ("g", "salt", "kind"))
            cut = [0, *(i for i in range(1, len(g)) if kind[i] == 0 or (g[i], salt[i]) != (g[i - 1], salt[i - 1]) or kind[i - 1] == 0), len(g)]
            for lo, hi in zip(cut[:-1], cut[1:]):
                if lo == hi:
                    continue
                if kind[lo] == 0:
                    if state is not None:
                        yield body(at, payload, state, None)
                    at, payload, state = g[lo], pickle.loads(b.column("payload")[lo].as_py()), None
                elif g[lo] == at:       # else the dataset's model is an error
                    state = body(at, payload, state, b.slice(lo, hi - lo))
        if state is not None:
            yield body(at, payload, state, None)

    return both.mapInArrow(run, schema)


_STATE = pa.schema([("g", pa.string()), ("state", pa.binary())])


def _scored(plan: Plan) -> Callable:
    """The Gram block of the normal scores of a dataset's rows."""
    width = len(plan.numeric)

    def body(g, payload, state, batch):
        if batch is None:
            return pa.RecordBatch.from_pylist([dict(g=g, state=pickle.dumps(state))], _STATE)
        own = payload["marginals"]
        z = np.zeros((batch.num_rows, len(own)))
        if width:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            for i in range(width):
                if own[i] is not None and own[i].varies:
                    z[:, i] = own[i].scores(x[:, i])
        if len(own) > width:
            t = np.array(batch.column("t").flatten().to_pylist(), object).reshape(-1, len(own) - width)
            for i in range(width, len(own)):
                if own[i] is not None and own[i].varies:
                    z[:, i] = own[i].scores(t[:, i - width])
        zero = np.zeros(len(own))
        new = Block.of(z, z, zero, zero)
        return new if state is None else state.plus(new)

    return body


def _solved(models: DataFrame, states: DataFrame) -> DataFrame:
    """The models with the Cholesky factor of their latent correlation."""
    both = (models.select("g", F.lit(0).alias("kind"), "rows", "payload", "error")
            .unionByName(states.select("g", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("rows"), F.col("state").alias("payload"),
                                       F.lit(None).cast("string").alias("error"))))
    both = both.repartition("g").sortWithinPartitions("g", "kind")

    def finish(g, rows, payload, error, block) -> pa.RecordBatch:
        if error is not None:
            return _model_row(g, rows, None, error)
        try:
            model = pickle.loads(payload)
            own = [m if m is not None else Marginal(0) for m in model["marginals"]]
            r = np.eye(len(own))
            if block is not None and len(own):
                r = latent_correlation(pickle.loads(block).correlations(), own)
            r = nearest_positive(r)
            return _model_row(g, rows, dict(model, corr=r, chol=np.linalg.cholesky(r)), None)
        except Exception as e:  # noqa: BLE001 - the dataset's own failure, carried as its row
            return _model_row(g, rows, None, _reason(e))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = None, None
        for b in batches:
            for g, kind, rows, payload, error in zip(*(b.column(c).to_pylist() for c in ("g", "kind", "rows", "payload", "error"))):
                if kind == 0:
                    if held is not None:
                        yield finish(*held, block)
                    held, block = (g, rows, payload, error), None
                else:
                    block = payload
        if held is not None:
            yield finish(*held, block)

    return both.mapInArrow(run, _MODEL)


@dataclass
class GroupedCopula:
    """``models`` (g, rows, payload, error), a row a dataset; ``ranked`` the cells that columns not modelled are drawn from."""

    plan: Plan
    models: DataFrame
    ranked: DataFrame


def fit_groups(df: DataFrame, key: str = "dataset") -> GroupedCopula:
    """Fit every dataset of ``df`` (rows told apart by ``key``; null is a dataset of its own) in a fixed number of jobs."""
    small_batches(df.sparkSession)
    plan = plan_columns(df, key)
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    ranked = written(ranked_cells(df, key, plan), "ranked") if plan.names else None
    sizes = df.groupBy(_key(named(key)).alias("g")).agg(F.count(F.lit(1)).alias("rows"))
    if ranked is None:
        pieces = sizes.where("false").select("g", F.lit(0).alias("c"), F.lit("").alias("kind"), F.lit(0).alias("k"), F.lit(0.0).alias("v"),
                                             F.lit("").alias("s"), F.col("rows").alias("cnt"), F.col("rows").alias("n"), F.col("rows").alias("d"))
    else:
        pieces = _pieces(ranked, plan)
    models = written(_assembled(pieces, sizes, plan), "marginals")
    rows = df.select(_key(named(key)).alias("g"), F.array(*[num(named(c), types[c]) for c in plan.numeric]).cast("array<double>").alias("x"),
                     F.array(*[strip(filled_text(c)) for c in plan.text]).cast("array<string>").alias("t"))
    states = beside(rows, models, _scored(plan), "g string, state binary")
    merged = merged_states(states, ["g"], Block.plus)
    return GroupedCopula(plan, written(_solved(models, merged), "models"), ranked)


def _normals(ids: np.ndarray, stream: str, seed: int) -> np.ndarray:
    """Box-Muller on two 52-bit uniforms of one md5, as ``rng.standard_normal`` does it."""
    tail = f":{stream}:{seed}".encode()
    md5 = hashlib.md5
    digest = [md5(b"%d" % i + tail).digest() for i in ids.tolist()]
    raw = np.frombuffer(b"".join(digest), ">u8").reshape(-1, 2)
    a, b = raw[:, 0].astype(np.uint64), raw[:, 1].astype(np.uint64)
    u1 = (a >> np.uint64(12)).astype(float) / 2.0 ** 52
    u2 = (((a & np.uint64(0xFFF)) << np.uint64(40)) | (b >> np.uint64(24))).astype(float) / 2.0 ** 52     # hex digits 14 to 26
    return np.sqrt(-2.0 * np.log(1.0 - u1)) * np.cos(2.0 * math.pi * u2)


def _uniforms(ids: np.ndarray, stream: str, seed: int) -> np.ndarray:
    tail = f":{stream}:{seed}".encode()
    raw = np.frombuffer(b"".join(hashlib.md5(b"%d" % i + tail).digest() for i in ids.tolist()), ">u8").reshape(-1, 2)
    return (raw[:, 0].astype(np.uint64) >> np.uint64(12)).astype(float) / 2.0 ** 52


def sample_groups(fitted: GroupedCopula, num_samples: int | None = None, seed: int = 42) -> DataFrame:
    """(g, row, n{i} or t{i} of every modelled column, u{i} of every text or temporal one): raw draws of all datasets.

    ``num_samples`` rows a dataset, or as many as its source has.  ``u`` is the place a
    value that is not modelled is drawn from, 0 to 1.
    """
    plan = fitted.plan
    n = F.col("rows") if num_samples is None else F.lit(int(num_samples)).cast("long")
    whole = CHUNK * CHUNKS
    # two levels, so a dataset of any size makes bounded arrays and its chunks spread
    first = fitted.models.where("error is null").select("g", "payload", n.alias("n")).where("n > 0")
    first = first.withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {whole}"))))
    first = first.repartition("g", "a")
    last = F.least(F.lit(CHUNKS).cast("long"), F.expr(f"(n - a * {whole} + {CHUNK - 1}) div {CHUNK}")) - 1
    chunks = first.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    chunks = chunks.select("g", "payload", (F.col("a") * whole + F.col("b") * CHUNK).alias("start"), "n").repartition("g", "start")
    width, total = len(plan.numeric), len(plan.modelled)
    fields = [*(f"n{i} double" for i in range(width)), *(f"t{i} string" for i in range(width, total)), *(f"u{i} double" for i in range(width, len(plan.names)))]
    schema = pa.schema([("g", pa.string()), ("row", pa.int64()), *((f"n{i}", pa.float64()) for i in range(width)),
                        *((f"t{i}", pa.string()) for i in range(width, total)), *((f"u{i}", pa.float64()) for i in range(width, len(plan.names)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, model = None, None
        for b in batches:
            for g, payload, start, n_rows in zip(*(b.column(c).to_pylist() for c in ("g", "payload", "start", "n"))):
                if g != at:
                    at, model = g, pickle.loads(payload)
                name = g[1:]
                for lo in range(start, min(start + CHUNK, n_rows), 1 << 13):
                    ids = np.arange(lo, min(lo + (1 << 13), start + CHUNK, n_rows))
                    z = np.stack([_normals(ids, f"copula:{c}:{name}", seed) for c in plan.modelled], 1) if total else np.zeros((len(ids), 0))
                    z = z @ model["chol"].T
                    cols = [pa.array([g] * len(ids)), pa.array(ids)]
                    for i, m in enumerate(model["marginals"]):
                        kind = pa.float64() if i < width else pa.string()
                        if m is None:
                            cols.append(pa.nulls(len(ids), kind))
                        else:
                            cols.append(pa.array(m.draws(z[:, i]), kind))
                    cols += [pa.array(_uniforms(ids, f"copula:{plan.names[i]}:{name}", seed)) for i in range(width, len(plan.names))]
                    yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return chunks.mapInArrow(run, ", ".join(["g string", "row long", *fields]))


def _looked_up(out: DataFrame, ranked: DataFrame, i: int, wanted: Column, value: str) -> DataFrame:
    """``out`` with ``r{i}``: for rows where ``wanted``, the cell of column ``i`` at the row's place among the dataset's cells.

    Both sides meet on (dataset, block of ranks), so a large dataset's rows spread.
    """
    cells = ranked.where(F.col("c") == i).withColumn("block", F.expr("greatest(1, (n + d - 1) div d)"))
    meta = cells.groupBy("g").agg(F.max("n").alias("n"), F.max("block").alias("block"))
    first, last = F.expr("lo div block"), F.expr("(lo + cnt - 1) div block")
    wide = 1 << 16
    stretch = cells.withColumn("a", F.explode(F.sequence(F.expr(f"(lo div block) div {wide}"), F.expr(f"((lo + cnt - 1) div block) div {wide}"))))
    stretch = stretch.repartition("g", "a", "lo")
    blocks = stretch.select("g", F.explode(F.sequence(F.greatest(first, F.col("a") * wide), F.least(last, F.col("a") * wide + wide - 1))).alias("blk"),
                            F.col(value).alias(f"r{i}"), "lo", (F.col("lo") + F.col("cnt")).alias("hi"))
    placed = out.join(meta.hint("merge"), "g", "left")
    idx = F.when(wanted, F.least(F.floor(F.col(f"u{i}") * F.col("n")).cast("long"), F.col("n") - 1))
    placed = placed.withColumn("idx", idx).withColumn("blk", F.expr("idx div block"))
    joined = placed.join(blocks.hint("merge"), (placed["g"] == blocks["g"]) & (placed["blk"] == blocks["blk"])
                         & (placed["idx"] >= blocks["lo"]) & (placed["idx"] < blocks["hi"]), "left")
    return joined.select(*[placed[c] for c in out.columns], blocks[f"r{i}"])


def synthesize_groups(df: DataFrame, key: str = "dataset", config: SynthConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(synthetic rows, status): (dataset, id, <columns>) and (dataset, original_rows, synthetic_rows, status).

    ``id`` counts the rows of a dataset from 0.  Numbers follow the source's formatting
    rules of the whole batch, except that a column of few values in a dataset keeps to
    these values; text columns of more than 50 values and dates are drawn from the
    dataset's own, by their frequency.  A column a dataset has no value of is null, or ''
    if it is text.  If a column is called like the key or ``id``, the
    output's own columns get an underscore in front.
    """
    cfg = config or SynthConfig(method="copula")
    fitted = fit_groups(df, key)
    plan = fitted.plan
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    cols = [c for c in df.columns if c != key]
    _, specs = profile(df.select(*[named(c) for c in cols])) if cols else (0, [])
    by = {s.name: s for s in specs}
    out = sample_groups(fitted, cfg.num_samples, cfg.seed)
    width = len(plan.numeric)
    exprs = {}
    for i, c in enumerate(plan.names):
        if i < width:
            x = F.col(f"n{i}")
            if by[c].dtype in ("tinyint", "smallint", "int", "bigint", "boolean"):
                x = round_year(x).cast("double")
            exprs[c] = format_numeric(x, by[c], cfg.keep_int)
        elif by[c].count == 0:
            exprs[c] = F.lit("") if c in plan.text else F.lit(None).cast(types[c])
        elif c in plan.text:
            if not (by[c].distinct_exact and by[c].distinct <= LABEL_MAX_DISTINCT):     # else no dataset has more
                out = _looked_up(out, fitted.ranked, i, F.col(f"t{i}").isNull(), "s")
                exprs[c] = F.coalesce(f"t{i}", f"r{i}", F.lit(""))
            else:
                exprs[c] = F.coalesce(f"t{i}", F.lit(""))
        else:
            out = _looked_up(out, fitted.ranked, i, F.lit(True), "v")
            value = moment_of(F.col(f"r{i}"), types[c])
            exprs[c] = value.cast("string") if cfg.stringify else value
    dataset = free_name("dataset", cols)
    fake = out.select(_name(F.col("g")).alias(dataset), F.col("row").alias(free_name("id", [*cols, dataset])), *[exprs[c].alias(c) for c in cols])
    made = F.when(F.col("error").isNull(), F.col("rows") if cfg.num_samples is None else F.lit(int(cfg.num_samples)).cast("long")).otherwise(F.lit(0))
    status = fitted.models.select(
        _name(F.col("g")).alias("dataset"), F.col("rows").alias("original_rows"), made.cast("long").alias("synthetic_rows"),
        F.when(F.col("error").isNotNull(), F.concat(F.lit("Error: "), F.col("error")))
        .when(made > 0, F.lit("Success")).otherwise(F.lit("Failed")).alias("status"))
    return fake, status
