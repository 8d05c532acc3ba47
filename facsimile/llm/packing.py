"""Best-fit packing of token sequences by exact complements of length sums.

Only how many pieces there are of each length reaches the driver: at most ``capacity``
numbers.  The plan it makes says how often each pattern of lengths is used and is
bounded by the capacity too, whatever the number of pieces; the pieces then take their
places by their rank among those of their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facsimile.llm.common import arrow_limits, written
from facsimile.llm.encode import encoder

SALTS = 64    # parts of the pieces of one length, ranked apart


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids): whole texts encoded, ended with ``end_id``, long ones cut.

    A null text is empty and so is one piece of the end id alone.
    """
    arrow_limits(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            ids, limits = enc.encode(b.column(1))
            rows = []
            for i, (lo, hi) in enumerate(zip(limits[:-1].tolist(), limits[1:].tolist())):
                own = np.append(ids[lo:hi], np.uint32(end_id)).astype("<u4")
                rows += [(i, p, at, min(capacity, len(own) - at), own[at:at + capacity].tobytes())
                         for p, at in enumerate(range(0, len(own), capacity))]
            i, p, at, n, raw = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(i, pa.int64())), pa.array(p, pa.int32()), pa.array(at, pa.int64()),
                 pa.array(n, pa.int64()), pa.array(raw, pa.binary())], names=["id", "piece", "start", "length", "ids"])

    return src.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids binary")


def _bits(x: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little"))


class _Sums:
    """Which lengths, and which sums of two and three lengths, there are pieces for."""

    def __init__(self, count: np.ndarray):
        self.count, self.n = count, len(count) - 1
        self.mask = (1 << (self.n + 1)) - 1
        self.refresh()

    def refresh(self) -> None:
        one = sum(1 << int(i) for i in np.flatnonzero(self.count))
        two = 0
        for a in _bits(one, self.n).tolist():
            twice = one if self.count[a] > 1 else one & ~(1 << a)
            two |= twice << a
        self.one, self.two = one, two & self.mask

    def fill(self, gap: int, held: dict[int, int]) -> list[int] | None:
        """One, two or three available lengths that sum to ``gap`` exactly, the longest first.

        ``held`` is what the open pattern has taken already and the counts still hold.
        """
        left = lambda a, *more: self.count[a] - held.get(a, 0) - more.count(a) > 0
        if self.one >> gap & 1 and left(gap):
            return [gap]
        below = self.one & ((1 << gap) - 1)
        mirror = lambda bits: int(format(bits & ((1 << (gap + 1)) - 1), f"0{gap + 1}b")[::-1], 2)  # noqa: E731  bit i -> gap - i
        if self.two >> gap & 1:
            for a in _bits(below & mirror(self.one), self.n)[::-1].tolist():
                if left(a) and left(gap - a, a):
                    return [a, gap - a]
        for a in _bits(below & mirror(self.two), self.n)[::-1].tolist():
            if left(a):
                rest = gap - a
                for b in _bits(below, self.n)[::-1].tolist():
                    if b < rest and left(b, a) and self.one >> (rest - b) & 1 and left(rest - b, a, b):
                        return [a, b, rest - b]
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """[(times, lengths)]: patterns that use every piece once, none longer than ``capacity``.

    A pattern opens with the longest length left.  While one, two or three available
    lengths fill its gap exactly it is closed with them; otherwise it takes the longest
    length that fits (best fit) and looks again.  A pattern is used as often as its
    lengths allow, so each use empties a length or halves one, and there are
    O(capacity * log) patterns for any number of pieces.
    """
    count = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit into {capacity}")
        count[length] += n
    out, sums = [], _Sums(count)
    while (some := np.flatnonzero(count)).size:
        pattern, held, gap = [], {}, capacity
        longest = int(some[-1])
        while True:
            if pattern:
                exact = sums.fill(gap, held) if gap else []
                if exact is not None:
                    pattern += exact
                    break
            fits = next((int(a) for a in some[np.searchsorted(some, min(gap, longest), "right") - 1::-1]
                         if a <= gap and count[a] > held.get(int(a), 0)), None)
            if fits is None:
                break
            pattern.append(fits)
            held[fits] = held.get(fits, 0) + 1
            gap -= fits
        need = {a: pattern.count(a) for a in pattern}
        times = min(int(count[a]) // n for a, n in need.items())
        changed = False
        for a, n in need.items():
            count[a] -= times * n
            changed |= count[a] <= 1
        if changed:
            sums.refresh()
        out.append((times, pattern))
    return out


def place(sized: DataFrame, capacity: int) -> DataFrame:
    """``sized`` (id, piece, length, ...) with ``sequence_id`` and ``offset`` (longs).

    Ranks among the pieces of one length are counted in ``SALTS`` parts each, so a length
    that a third of all pieces have is not one task's; the parts' sizes, at most
    capacity * SALTS numbers, give each part its first rank.
    """
    spark = sized.sparkSession
    salt = F.pmod(F.xxhash64("id", "piece"), F.lit(SALTS)).cast("int")
    salted = sized.withColumn("__salt", salt)
    parts = sorted((r[0], r[1], r[2]) for r in salted.groupBy("length", "__salt").count().collect())
    counts: dict[int, int] = {}
    first: dict[tuple[int, int], int] = {}
    for length, s, n in parts:
        first[length, s] = counts.get(length, 0)
        counts[length] = first[length, s] + n
    # for each length: ranks from which a slot of a pattern is used, and what it gives
    table: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, pattern in plan(counts, capacity):
        at = 0
        for length in pattern:
            table.setdefault(length, []).append((used.get(length, 0), sequence, at))
            used[length] = used.get(length, 0) + times
            at += length
        sequence += times
    slots = spark.sparkContext.broadcast({k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in table.items()})
    firsts = spark.sparkContext.broadcast(first)
    order = [F.col(c) for c in ("id", "piece", "crc") if c in sized.columns]
    ranked = salted.withColumn(
        "__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)).cast("long") - 1)
    names = [c for c in sized.columns]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, base = slots.value, firsts.value
        for b in batches:
            length = b.column("length").to_numpy()
            part = b.column("__salt").to_numpy()
            rank = b.column("__rank").to_numpy() + np.fromiter(
                (base[k] for k in zip(length.tolist(), part.tolist())), np.int64, len(length))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                lo, s, o = slot[n]
                k = np.searchsorted(lo, rank[at], "right") - 1
                seq[at], off[at] = s[k] + rank[at] - lo[k], o[k]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(off)],
                                             names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "__salt", "__rank").mapInArrow(run, f"{types}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, crc, sequence_id, offset): a place for every piece of every document.

    Pieces are encoded once and their sizes kept in the shared folder.  Rows with one id
    are packed one by one; no rows give no rows.
    """
    cut = pieces(docs, tokenizer, end_id, capacity, id_col, text_col)
    sized = written(cut.select("id", "piece", "start", "length", F.crc32("ids").alias("crc")), "pieces")
    return place(sized, capacity)


def sequences(placed: DataFrame, with_ids: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences themselves.

    ``placed`` comes from :func:`pack`, ``with_ids`` from :func:`pieces`; a sequence
    gathers at most ``capacity`` ids.
    """
    keys = ["id", "piece", "start", "length"]
    both = placed.select(*keys, "sequence_id", "offset").join(with_ids, keys)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (both.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p"))
            .select("sequence_id", "n_tokens", F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids")))
