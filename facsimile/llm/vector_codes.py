"""Vector codes: product quantisation in integers, nearest entries found by their Walsh-Hadamard transforms.

Part and entry are zero-padded to a power of two and transformed; squared differences
of the transforms add up to the padded length times the squared distance.  They are
accumulated in sequency order (smooth patterns, which hold most of a difference, first),
and an entry is out as soon as its sum passes the whole sum of the best one so far.
Integers throughout, so every distance, tie and codebook is exact.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import arrow_limits, folded, matrices, sound_vector, written

SCALE = 1024
ROWS = 512          # rows compared with a codebook at a time
HOT = 1000          # a label with more than this share of all rows is joined by broadcast: fewer labels than this
LONG = (1 << 63) - 1

Books = dict[int, list[np.ndarray]]     # length of a vector -> part -> entries x components


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): longs, or Python integers where longs might not hold the sums."""
    top = np.abs(x).max(initial=0.0)
    if top * scale * max(1, x.shape[-1]) < 1 << 28:
        return np.floor(x * scale).astype(np.int64)
    # doubles from 2**52 on are whole numbers
    whole = [[int(v) * scale if abs(v) >= 1 << 52 else math.floor(v * scale) for v in row] for row in x.tolist()]
    return np.array(whole, object).reshape(x.shape)


def split(x: np.ndarray, parts: int) -> list[np.ndarray]:
    """Equal consecutive parts; zeros fill up a length that the parts do not divide."""
    width = -(-x.shape[1] // parts)
    full = np.zeros((len(x), width * parts), x.dtype)
    full[:, :x.shape[1]] = x
    return [full[:, j * width:(j + 1) * width] for j in range(parts)]


def sequency_order(size: int) -> np.ndarray:
    """The places of the Walsh functions in a Hadamard transform, by their sign changes."""
    j, place = np.arange(size), np.arange(size)
    gray = j ^ (j >> 1)
    place = np.zeros(size, np.int64)
    for b in range(size.bit_length() - 1):      # bit-reversed Gray code
        place |= (gray >> b & 1) << (size.bit_length() - 2 - b)
    return place


def walsh(x: np.ndarray) -> np.ndarray:
    """Integer Walsh-Hadamard transform of the rows, zero-padded to a power of two, in sequency order."""
    size = 1 << max(0, x.shape[1] - 1).bit_length()
    out = np.zeros((len(x), size), x.dtype)
    out[:, :x.shape[1]] = x
    step = 1
    while step < size:
        pairs = out.reshape(len(x), -1, 2, step)
        a, b = pairs[:, :, 0].copy(), pairs[:, :, 1].copy()
        pairs[:, :, 0], pairs[:, :, 1] = a + b, a - b
        step *= 2
    return out[:, sequency_order(size)]


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, its squared distance) of each row, ties to the lower index.

    While many pairs of a row and an entry are left they are all taken one coefficient
    further; once an eighth is left, those alone.
    """
    kind = object if object in (part.dtype, entries.dtype) else np.int64
    have = walsh(entries.astype(kind))
    size = have.shape[1]
    if kind is not object:
        top = int(np.abs(part).max(initial=0)) + int(np.abs(entries).max(initial=0))
        kind = np.int32 if (size * top) ** 2 < 1 << 31 else np.int64    # the sums are size * squared distance
    have = have.astype(kind)
    columns = np.ascontiguousarray(have.T)
    index, error = np.zeros(len(part), np.int64), np.zeros(len(part), part.dtype)
    for lo in range(0, len(part), ROWS):
        x = walsh(part[lo:lo + ROWS]).astype(kind)
        n = np.arange(len(x))
        whole = lambda e: ((x - have[e]) ** 2).sum(1, dtype=kind)  # noqa: E731  of one entry a row
        sums, done, alive, bound = np.zeros((len(x), len(have)), kind), 0, None, None
        while done < size:
            gap = np.subtract.outer(x[:, done], columns[done])
            gap *= gap
            sums += gap
            done += 1
            if done >= 4 and done & (done - 1) == 0 and done < size:
                tried = whole(sums.argmin(1))
                bound = tried if bound is None else np.minimum(bound, tried)
                alive = sums <= bound[:, None]
                if 8 * np.count_nonzero(alive) <= alive.size:
                    break
        if done == size:
            best = sums.argmin(1)       # the first, so the lowest, of equal ones
            index[lo:lo + len(x)], error[lo:lo + len(x)] = best, sums[n, best] // size
            continue
        row, entry = np.nonzero(alive)
        sums = sums[row, entry]
        while done < size:
            more = min(size, 2 * done)
            sums = sums + ((x[row, done:more] - have[entry, done:more]) ** 2).sum(1, dtype=kind)
            done = more
            first = np.searchsorted(row, n)             # every row keeps its best entry
            at = np.flatnonzero(sums == np.minimum.reduceat(sums, first)[row])
            best = at[np.searchsorted(row[at], n)]      # entries ascend within a row
            bound = np.minimum(bound, whole(entry[best]))
            stay = sums <= bound[row]
            row, entry, sums = row[stay], entry[stay], sums[stay]
        at = np.flatnonzero(sums == bound[row])
        best = at[np.searchsorted(row[at], n)]
        index[lo:lo + len(x)], error[lo:lo + len(x)] = entry[best], sums[best] // size
    return index, error


def _start(vectors: DataFrame, length: int, parts: int, codes: int) -> list[np.ndarray]:
    """The parts of the vectors of one length with the smallest ids."""
    rows = vectors.where(F.size("vec") == length).orderBy(F.col("id").asc_nulls_last(), "vec").limit(codes).select("vec").collect()
    x = integers(np.array([r[0] for r in rows], float).reshape(len(rows), length))
    return split(x, parts)


def _fold(states: list[bytes]) -> bytes:
    """Sums and counts of entries added up as Python integers."""
    out: dict = {}
    for raw in states:
        for key, (n, total) in pickle.loads(raw).items():
            if key in out:
                out[key] = (out[key][0] + n, out[key][1].astype(object) + total.astype(object))
            else:
                out[key] = (n, total)
    return pickle.dumps(out)


def _round(vectors: DataFrame, books: Books) -> Books:
    """Codebooks whose entries are the floored means of the parts nearest to them; unused ones stay."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for b in batches:
            for d, _, x in matrices(b):
                own = shared.value[d]
                for j, part in enumerate(split(integers(x), len(own))):
                    index, _ = nearest(part, own[j])
                    total = np.zeros(own[j].shape, part.dtype)
                    np.add.at(total, index, part)
                    n = np.bincount(index, minlength=len(total))
                    if (d, j) in state:
                        was = state[d, j]
                        if total.dtype == object or was[1].dtype == object:
                            total = total.astype(object) + was[1].astype(object)
                        else:
                            total = total + was[1]      # 2**28 * rows of a task: within a long
                        n = n + was[0]
                    state[d, j] = n, total
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], names=["state"])

    parts = folded(vectors.select("vec").mapInArrow(run, "state binary"), _fold, "code_sums")
    new = {d: [e.copy() for e in own] for d, own in books.items()}
    for (d, j), (n, total) in pickle.loads(_fold(parts)).items():
        used = n > 0
        mean = total[used].astype(object) // n[used, None].astype(object)
        if new[d][j].dtype != object and np.abs(mean).max(initial=0) * max(1, d) < 1 << 28:
            mean = mean.astype(np.int64)
        else:
            new[d][j] = new[d][j].astype(object)
        new[d][j][used] = mean
    return new


def fit(vectors: DataFrame, parts: int = 4, codes: int = 256, rounds: int = 4) -> Books:
    """Codebooks of ``vectors`` (id, vec), one set for each length of vectors.

    The driver holds the codebooks, ``parts * codes`` entries a length; every round the
    tasks send it one sum and count an entry, folded on the way.
    """
    lengths = [r[0] for r in vectors.groupBy(F.size("vec").alias("d")).count().orderBy("d").select("d").collect()]   # a row a length
    books = {d: _start(vectors, d, parts, codes) for d in lengths}
    for _ in range(rounds if books else 0):
        books = _round(vectors, books)
    return books


def digest(own: list[np.ndarray]) -> str:
    """SHA-256 of a codebook set's integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for part in own for v in part.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, books: Books, digits: int = 2) -> DataFrame:
    """``vectors`` (id, vec and more) without vec, with ``code``, ``error`` and ``books``, the codebooks' digest.

    ``code`` is the indexes' hex digits in part order; an error that no long holds is null.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((books, {d: digest(own) for d, own in books.items()}))
    rest = [f for f in vectors.schema if f.name != "vec"]
    at_vec = vectors.columns.index("vec")
    names = [*(f.name for f in rest), "code", "error", "books"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, digests = shared.value
        for b in batches:
            for d, rows, x in matrices(b, at_vec):
                got = [nearest(part, e) for part, e in zip(split(integers(x), len(have[d])), have[d])]
                error = sum(e.astype(object) for _, e in got).tolist()
                code = ["".join(f"{v:0{digits}x}" for v in row) for row in np.stack([i for i, _ in got], 1).tolist()]
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(f.name).take(take) for f in rest), pa.array(code),
                     pa.array([e if e <= LONG else None for e in error], pa.int64()), pa.array([digests[d]] * len(rows))], names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return vectors.mapInArrow(run, f"{kinds}, code string, error long, books string")


def with_group_error(coded: DataFrame, group: str) -> DataFrame:
    """``coded`` with ``group_error``, the sum of ``error`` over rows with an equal ``group`` (nulls together).

    Groups with more than a ``HOT``-th of all rows, of which there are fewer than
    ``HOT``, get their sum by broadcast; all others are too small to fill a task and meet
    by a merge.  A sum that no long holds is null.
    """
    sums = written(coded.groupBy(F.col(group).alias("own")).agg(F.try_sum("error").alias("group_error"), F.count(F.lit(1)).alias("n")), "group_errors")
    total = sums.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(sums.where(F.col("n") * HOT > total).drop("n"))
    cold = sums.where(F.col("n") * HOT <= total).drop("n").hint("merge")
    same = F.col(group).eqNullSafe(F.col("own"))
    return coded.join(hot, same).drop("own").unionByName(coded.join(hot, same, "left_anti").join(cold, same).drop("own"))


def quantise(vectors: DataFrame, parts: int = 4, codes: int = 256, rounds: int = 4, id_col: str = "vec_id",
             vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every vector of finite components.

    Components become floor(1024 * x).  Each of ``parts`` consecutive parts has a
    codebook, which starts as that part of the ``codes`` vectors with the smallest ids (a
    null id is the largest; rows with one id follow their vectors' order) and is refined
    ``rounds`` times.  Vectors that are null or hold null or non-finite components are
    left out.  Vectors of different lengths have codebooks of their own; zeros fill up a
    length that the parts do not divide.  Repeated rows count one by one.  Components
    too large for long arithmetic are computed as Python integers; an error no long
    holds is null.  No rows give no rows; other columns are not read.
    """
    arrow_limits(vectors.sparkSession)
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), v.alias("vec")).where(sound_vector(v))
    books = fit(rows.select("id", "vec"), parts, codes, rounds)
    coded = written(encode(rows, books, len(f"{codes - 1:x}")), "codes")
    return with_group_error(coded, "label").select(
        F.col("id").alias(id_col), "code", "error", F.col("group_error").alias("label_error"), F.col("books").alias("codebooks_sha256"))
