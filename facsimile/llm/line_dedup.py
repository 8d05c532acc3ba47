"""Line dedup: documents probe sharded count arrays that a minimal perfect hash over distinct line hashes indexes.

A line stands as the 128-bit hash of its key.  The hashes are dealt over shards; each
shard holds a minimal perfect hash of its distinct line hashes, a bit or two a hash and
level, and arrays by its numbers: a fingerprint, in how many documents the line is, and
the largest id that holds it.  Probes travel as packed hashes, never as lines, and stream
past the arrays of their shard, so neither a group nor an array set need fit a join.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import arrow_limits, written

STRIP = b"\x20\x09\x0a\x0b\x0c\x0d"
NO_ID = -(1 << 63)          # stands for a null id: smaller than any other
SHARD_KEYS = 1 << 14        # line hashes a shard, about
BLOCK = 1 << 16             # probes of one shard beyond which they are dealt over several tasks
PARTS = 4096                # ... or this share of all probes, so no more shards than this are dealt so
SEEN = 300_000              # line hashes a task counts before it passes them on
PROBE = np.dtype([("a", "<u8"), ("b", "<u8"), ("id", "<i8"), ("text", "<i8"), ("nth", "<i4")])


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """A line's key, white space stripped and A-Z lower-cased; None when it is shorter than ``min_chars``."""
    key = line.strip(STRIP)
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key.lower()      # of bytes: A-Z alone


def distinct_keys(text: bytes, min_chars: int) -> dict[bytes, int]:
    """The keys of a text, numbered by their first line."""
    out: dict[bytes, int] = {}
    for line in text.split(b"\n"):
        if len(line) >= min_chars and (key := key_of(line, min_chars)) is not None:
            out.setdefault(key, len(out))
    return out


def drop_lines(text: bytes, gone: set[int], min_chars: int) -> tuple[bytes, int]:
    """(text without the lines whose key's number is in ``gone``, lines dropped)."""
    lines = text.split(b"\n")
    number: dict[bytes, int] = {}
    kept = []
    for line in lines:
        key = key_of(line, min_chars)
        if key is None or number.setdefault(key, len(number)) not in gone:
            kept.append(line)
    return b"\n".join(kept), len(lines) - len(kept)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spot(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return _mix(a ^ _mix(b + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))) % np.uint64(size)


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys: n keys get the numbers 0..n-1.

    Level by level, keys alone in their place of a bit array take it, the others go on to
    the next level; a key's number is how many bits are set before its own.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels    # boolean arrays
        below = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.rank = [np.cumsum(x, dtype=np.int64) - 1 + lo for x, lo in zip(levels, below)]

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(a):
            if len(levels) == 200:
                raise ValueError("line hashes are not distinct")
            size = max(8, 2 * len(a))
            at = _spot(a, b, len(levels), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = ~alone[at]
            a, b = a[left], b[left]
        return cls(levels)

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each key; of a key that was not given any number, or -1."""
        out = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for k, (bits, rank) in enumerate(zip(self.levels, self.rank)):
            at = _spot(a[left], b[left], k, len(bits)).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out


_HEAD = struct.Struct("<IIB")


def pack_shard(a: np.ndarray, b: np.ndarray, count: np.ndarray, last: np.ndarray) -> bytes:
    """A shard's perfect hash and its fingerprint, count and last-id arrays as bytes."""
    mph = PerfectHash.of(a, b)
    at = mph.number(a, b)
    kind = np.min_scalar_type(int(count.max(initial=0)))
    fp, n, top = np.zeros(len(a), "<u4"), np.zeros(len(a), kind), np.zeros(len(a), "<i8")
    fp[at], n[at], top[at] = b >> np.uint64(32), count, last
    sizes = np.array([len(x) for x in mph.levels], "<u4")
    return b"".join([_HEAD.pack(len(a), len(sizes), kind.itemsize), sizes.tobytes(),
                     *(np.packbits(x).tobytes() for x in mph.levels), fp.tobytes(), n.tobytes(), top.tobytes()])


class Shard:
    """The arrays of one shard, ready to be probed."""

    def __init__(self, payload: bytes):
        n, levels, width = _HEAD.unpack_from(payload)
        sizes = np.frombuffer(payload, "<u4", levels, _HEAD.size).tolist()
        at, bits = _HEAD.size + 4 * levels, []
        for m in sizes:
            bits.append(np.unpackbits(np.frombuffer(payload, np.uint8, -(-m // 8), at), count=m).astype(bool))
            at += -(-m // 8)
        self.mph = PerfectHash(bits)
        self.fp = np.frombuffer(payload, "<u4", n, at)
        self.count = np.frombuffer(payload, f"<u{width}", n, at + 4 * n)
        self.last = np.frombuffer(payload, "<i8", n, at + (4 + width) * n)

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents that hold each line, the largest id of them); 0 documents where the fingerprint differs."""
        at = self.mph.number(a, b)
        known = at >= 0
        known[known] = self.fp[at[known]] == b[known] >> np.uint64(32)
        count, last = np.zeros(len(a), np.int64), np.full(len(a), NO_ID, np.int64)
        count[known], last[known] = self.count[at[known]], self.last[at[known]]
        return count, last


def _digests(keys) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, doc, hash): the id as a long with nulls as NO_ID, and the text's hash; both name a row's result."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = F.col(f"`{id_col}`")
    return docs.select(own.alias("id"), text.alias("text"), F.coalesce(own.try_cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.xxhash64(text).alias("hash"))


def line_counts(src: DataFrame, min_chars: int) -> DataFrame:
    """(a, b, n, last): hashes of keys, summed within a task; a task may pass on a hash more than once."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("last", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}

        def give() -> pa.RecordBatch:
            both = np.frombuffer(b"".join(seen), "<i8").reshape(-1, 2)
            n, last = np.array(list(seen.values()), np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (both[:, 0], both[:, 1], n, last)], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                for h in map(xxhash.xxh3_128_digest, distinct_keys(text, min_chars)):
                    was = seen.get(h)
                    if was is None:
                        seen[h] = [1, doc]
                    else:
                        was[0] += 1
                        if doc > was[1]:
                            was[1] = doc
                if len(seen) > SEEN:
                    yield give()
                    seen = {}
        yield give()

    return src.select("doc", "text").mapInArrow(run, "a long, b long, n long, last long")


def shard_arrays(counts: DataFrame, shards: int) -> DataFrame:
    """(shard, probes, payload): the arrays of every shard; ``probes`` is how often documents will ask them."""
    schema = pa.schema([("shard", pa.int64()), ("probes", pa.int64()), ("payload", pa.binary())])

    def build(key, table):
        a, b, n, last = (table.column(c).to_numpy() for c in ("a", "b", "n", "last"))
        payload = pack_shard(a.view("<u8"), b.view("<u8"), n, last)
        return pa.Table.from_pylist([dict(shard=key[0].as_py(), probes=int(n.sum()), payload=payload)], schema)

    dealt = counts.withColumn("shard", F.pmod("a", F.lit(shards))).repartition("shard")
    whole = dealt.groupBy("shard", "a", "b").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    return whole.groupBy("shard").applyInArrow(build, "shard long, probes long, payload binary")


def repeated_lines(src: DataFrame, arrays: DataFrame, shards: int, min_docs: int, min_chars: int) -> DataFrame:
    """(doc, hash, nth): the numbers of a document's keys in ``min_docs`` documents and in one with a larger id."""
    total = arrays.agg(F.sum("probes")).first()[0] or 0
    block = max(BLOCK, total // PARTS)
    # shards asked more often than a block: fewer than PARTS rows
    hot = {r[0]: -(-r[1] // block) for r in arrays.where(F.col("probes") > block).select("shard", "probes").collect()}
    shared = src.sparkSession.sparkContext.broadcast((np.array(sorted(hot), np.int64), np.array([hot[s] for s in sorted(hot)], np.int64)))
    schema = pa.schema([("shard", pa.int64()), ("salt", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, salts = shared.value
        for batch in batches:
            found, sizes = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                keys = distinct_keys(text, min_chars)
                found += keys
                sizes.append(len(keys))
            if not found:
                continue
            out = np.zeros(len(found), PROBE)
            out["a"], out["b"] = _digests(found)
            for name, col in (("id", 0), ("text", 2)):
                out[name] = np.repeat(batch.column(col).to_numpy(), sizes)
            out["nth"] = np.arange(len(found)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            shard = out["a"].view("<i8") % shards
            salt = np.zeros(len(out), np.int64)
            if len(names):
                at = np.minimum(np.searchsorted(names, shard), len(names) - 1)
                many = np.where(names[at] == shard, salts[at], 1)
                salt = (_mix(out["text"].view("<u8") ^ _mix(out["id"].view("<u8"))) % many.astype("<u8")).astype(np.int64)
            order = np.lexsort((salt, shard))
            out, shard, salt = out[order], shard[order], salt[order]
            cut = np.flatnonzero(np.diff(shard, prepend=-1) | np.diff(salt, prepend=-1))
            raw, ends = out.tobytes(), [*cut[1:].tolist(), len(out)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[cut]), pa.array(salt[cut]), pa.array(np.ones(len(cut), np.int32)),
                 pa.array([raw[lo * PROBE.itemsize:hi * PROBE.itemsize] for lo, hi in zip(cut.tolist(), ends)], pa.binary())],
                schema=schema)

    probes = src.select("doc", "text", "hash").mapInArrow(ask, "shard long, salt long, kind int, payload binary")
    copies = F.greatest(F.lit(1).cast("long"), F.expr(f"(probes + {block - 1}) div {block}"))
    have = (arrays.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
            .select("shard", "salt", F.lit(0).alias("kind"), "payload"))
    met = have.unionByName(probes).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, arrays_here = None, None
        for batch in batches:
            got = []
            for s, kind, payload in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "payload"))):
                if kind == 0:
                    at, arrays_here = s, Shard(payload)
                    continue
                rows = np.frombuffer(payload, PROBE)
                count, last = arrays_here.probe(rows["a"], rows["b"]) if at == s else (np.zeros(1), None)
                if not count.all():
                    raise RuntimeError("a line has no count: the documents changed between two reads")
                got.append(rows[(count >= min_docs) & (last != rows["id"])])
            out = np.concatenate(got) if got else np.zeros(0, PROBE)
            yield pa.RecordBatch.from_arrays([pa.array(out["id"]), pa.array(out["text"]), pa.array(out["nth"])], names=["doc", "hash", "nth"])

    return met.mapInArrow(answer, "doc long, hash long, nth int")


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, text): documents without lines that many documents repeat.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased.
    Keys of at least ``min_chars`` code points in at least ``min_docs`` documents lose
    all their lines except in the document with the largest id that holds them; other
    lines stay as they are.  A null or empty text is one empty line.  Every row is a
    document of its own: repeated rows count one by one, and rows that share the largest
    id all keep the line.  A null id (or one that is no integer) is smaller than all
    others and equal to another null.  No rows give no rows; other columns are not read.

    The documents are read three times; they must not change meanwhile (checked).
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    src = _source(docs, id_col, text_col)
    counts = written(line_counts(src, min_chars), "line_counts")
    shards = max(1, -(-counts.count() // SHARD_KEYS))
    arrays = written(shard_arrays(counts, shards), "line_arrays")
    gone = (repeated_lines(src, arrays, shards, min_docs, min_chars)
            .groupBy("doc", "hash").agg(F.collect_set("nth").alias("gone")))     # at most a document's lines
    # the same plan at every size: texts stream past a hash table of a partition's few numbers, unsorted
    both = src.join(gone.hint("shuffle_hash"), ["doc", "hash"], "left").select("id", "text", "gone")
    names = [id_col, "n_lines", "n_dropped", text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, dropped = [], [], []
            for text, numbers in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                n.append(text.count(b"\n") + 1)
                text, less = drop_lines(text, set(numbers), min_chars) if numbers else (text, 0)
                texts.append(text)
                dropped.append(less)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                names=names)

    kind = src.schema["id"].dataType.simpleString()
    return both.mapInArrow(run, f"`{id_col}` {kind}, n_lines long, n_dropped long, `{text_col}` string")
