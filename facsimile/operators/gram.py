"""Correlations of many columns from masked Gram blocks.

For columns X with a mask M of what is present, the pairwise-complete moments of all
pairs are four products: M'M (rows both are present in), X'M (sums), (X*X)'M (sums of
squares) and X'X.  Tasks form them with numpy for blocks of columns, around a value of
their own for every column so that nothing cancels, and the blocks are merged over the
cluster.  Neither the number of expressions in the plan nor what the driver holds grows
with the square of the columns, nor with the groups.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.functions.names import named
from facsimile.operators.profile import num
from facsimile.operators.states import merged_states, small_batches

BLOCK = 256             # columns of a block
PAIRS_PER_PASS = 64     # pairs of blocks a task holds at a time
HELD = 1 << 23          # numbers a task holds before it passes them on


@dataclass
class Block:
    """Moments of columns I (rows) and J (columns) around ``ci`` and ``cj``."""

    ci: np.ndarray
    cj: np.ndarray
    n: np.ndarray       # rows where both are present
    si: np.ndarray      # sums of i - ci over those rows
    sj: np.ndarray      # sums of j - cj
    qi: np.ndarray      # sums of squares
    qj: np.ndarray
    q: np.ndarray       # sums of products

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, ci: np.ndarray, cj: np.ndarray) -> Block:
        mx, my = ~np.isnan(x), ~np.isnan(y)
        x, y = np.where(mx, x - ci, 0.0), np.where(my, y - cj, 0.0)
        if mx.all() and my.all():
            one = lambda a, axis: np.repeat(a, x.shape[1], 0) if axis else np.repeat(a, y.shape[1], 1)
            n = np.full((x.shape[1], y.shape[1]), float(len(x)))
            return cls(ci, cj, n, one(x.sum(0)[:, None], 0), one(y.sum(0)[None], 1), one((x * x).sum(0)[:, None], 0),
                       one((y * y).sum(0)[None], 1), x.T @ y)
        fx, fy = mx.astype(float), my.astype(float)
        return cls(ci, cj, fx.T @ fy, x.T @ fy, fx.T @ y, (x * x).T @ fy, fx.T @ (y * y), x.T @ y)

    def moved(self, ci: np.ndarray, cj: np.ndarray) -> Block:
        """The same moments around other values."""
        a, b = (self.ci - ci)[:, None], (self.cj - cj)[None]
        if not a.any() and not b.any():
            return self
        return Block(ci, cj, self.n, self.si + a * self.n, self.sj + b * self.n, self.qi + 2 * a * self.si + a * a * self.n,
                     self.qj + 2 * b * self.sj + b * b * self.n, self.q + a * self.sj + b * self.si + a * b * self.n)

    def plus(self, other: Block) -> Block:
        o = other.moved(self.ci, self.cj)
        return Block(self.ci, self.cj, self.n + o.n, self.si + o.si, self.sj + o.sj, self.qi + o.qi, self.qj + o.qj, self.q + o.q)

    def correlations(self) -> np.ndarray:
        """Pearson's r; NaN where fewer than two rows or no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            vi = self.qi - self.si * self.si / self.n
            vj = self.qj - self.sj * self.sj / self.n
            r = (self.q - self.si * self.sj / self.n) / (np.sqrt(vi) * np.sqrt(vj))
            # what rounding leaves of a constant column is no variance
            flat = (vi <= 1e-14 * self.qi) | (vj <= 1e-14 * self.qj)
        return np.where(flat | ~np.isfinite(r), np.nan, np.clip(r, -1.0, 1.0))


def gram_blocks(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """(g, bi, bj, state): a merged :class:`Block` for each group and pair of column blocks, bi <= bj.

    ``by`` names the group column, taken as text (a null group stays one of its own);
    without it g is null.  Each pass reads the columns of its blocks only.
    """
    small_batches(df.sparkSession)
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    starts = list(range(0, len(columns), BLOCK))
    pairs = [(a, b) for a in range(len(starts)) for b in range(a, len(starts))]
    out = None
    for lo in range(0, len(pairs), PAIRS_PER_PASS):
        mine = pairs[lo:lo + PAIRS_PER_PASS]
        used = sorted({k for p in mine for k in p})
        place, names = {}, []
        for k in used:
            own = columns[starts[k]:starts[k] + BLOCK]
            place[k] = (len(names), len(names) + len(own))
            names += own
        group = named(by).cast("string") if by else F.lit(None).cast("string")
        rows = df.select(group.alias("g"), F.array(*[num(named(c), types[c]) for c in names]).alias("x"))
        part = rows.mapInArrow(_task(mine, place, len(names)), "g string, bi int, bj int, state binary")
        out = part if out is None else out.unionByName(part)
    return merged_states(out, ["g", "bi", "bj"], Block.plus)


def _task(pairs: list[tuple[int, int]], place: dict[int, tuple[int, int]], width: int):
    schema = pa.schema([("g", pa.string()), ("bi", pa.int32()), ("bj", pa.int32()), ("state", pa.binary())])

    def give(held: dict) -> pa.RecordBatch:
        rows = [dict(g=g, bi=i, bj=j, state=pickle.dumps(s)) for (g, i, j), s in held.items()]
        return pa.RecordBatch.from_pylist(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        centre: dict = {}
        numbers = 0
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, width)
            x[~np.isfinite(x)] = np.nan
            coded = b.column(0).dictionary_encode()
            code = coded.indices.fill_null(len(coded.dictionary)).to_numpy()
            groups = [*coded.dictionary.to_pylist(), None]
            order = np.argsort(code, kind="stable")
            cut = np.searchsorted(code[order], np.arange(len(groups) + 1))
            for k, g in enumerate(groups):
                if cut[k] == cut[k + 1]:
                    continue
                own = x if cut[k + 1] - cut[k] == len(x) else x[order[cut[k]:cut[k + 1]]]
                if g not in centre:
                    present = ~np.isnan(own)
                    centre[g] = np.where(present, own, 0.0).sum(0) / np.maximum(present.sum(0), 1)
                c = centre[g]
                for i, j in pairs:
                    (a, z), (u, v) = place[i], place[j]
                    new = Block.of(own[:, a:z], own[:, u:v], c[a:z], c[u:v])
                    was = held.get((g, i, j))
                    if was is None:
                        numbers += 6 * new.n.size
                    held[g, i, j] = new if was is None else was.plus(new)
            if numbers > HELD and len(centre) > 1:
                yield give(held)
                held, centre, numbers = {}, {}, 0
        if held:
            yield give(held)

    return run


def correlations(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """(g, i, j, corr) of all ordered pairs of columns by position: Pearson on the rows where both are present.

    Null where fewer than two rows are, or where a column does not vary; infinite values
    count as missing.  No rows give no rows.
    """
    schema = pa.schema([("g", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("corr", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, bi, bj, raw in zip(*(b.column(k).to_pylist() for k in range(4))):
                r = pickle.loads(raw).correlations()
                i, j = np.indices(r.shape, dtype=np.int32)
                i, j, r = i.ravel() + np.int32(bi * BLOCK), j.ravel() + np.int32(bj * BLOCK), r.ravel()
                if bi != bj:
                    i, j, r = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([r, r])
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(r), pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                                  pa.array(r, from_pandas=True)], schema=schema)

    return gram_blocks(df, columns, by).mapInArrow(run, "g string, i int, j int, corr double")
