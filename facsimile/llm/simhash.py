"""SimHash near-duplicates: fingerprints and meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facsimile.llm.common import arrow_limits, hot_join, out_batch, written
from facsimile.llm.components import connected_components

SEED = 42
CHUNK = 1 << 15   # shingles hashed at a time


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of a whole text over word shingles, repeats included.

    A-Z is lower-cased; words are runs without ASCII white space; a text with fewer
    words than a shingle is one shingle; a text without words (or null) gives 0.  A bit
    is set when it is set in over half the shingles' XXH64 values.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    k = min(words, len(tokens))
    line = b" ".join(tokens)
    ends = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends]
    n = len(tokens) - k + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        h = np.fromiter((digest(line[s:e - 1], SEED) for s, e in zip(starts[lo:hi], ends[lo + k - 1:hi + k - 1])),
                        np.uint64, hi - lo)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): one row per document; ``fp`` holds the 64 bits as a signed long."""
    arrow_limits(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    probe = pa.schema([("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            schema = pa.schema([b.schema.field(0), *probe])
            yield out_batch(schema, id=b.column(0), fp=pa.array(fps))

    return src.mapInArrow(run, f"id {kind}, fp long")


def flips(radius: int) -> list[int]:
    """Signed long masks of all 64-bit words with at most ``radius`` bits set."""
    out = [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def fingerprint_links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): verified links that connect exactly the distinct fingerprints within ``max_bits``.

    ``fps`` has one column ``fp`` of distinct values.  Every fingerprint emits all words
    within half the distance (rounded up; those within the half rounded down are *near*).
    Two fingerprints within ``max_bits`` meet on a word that is near to at least one of
    them.  Fingerprints are distinct, so a word gathers at most as many rows as the ball
    has words.  In each word every fingerprint is linked with the first near one instead
    of with all others: such a pair is at most ``max_bits`` apart, and any other link of
    the word joins two members of that star.
    """
    lo, hi = max_bits // 2, (max_bits + 1) // 2
    if not 0 <= max_bits <= 6:
        raise ValueError(f"max_bits must be 0..6, not {max_bits}")
    masks = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(int(m.bit_count() if m >= 0 else (m + (1 << 64)).bit_count()) > lo).alias("far"))
                      for m in flips(hi)])
    variants = (fps.select("fp", F.explode(masks).alias("x"))
                .select("fp", F.col("fp").bitwiseXOR(F.col("x.m")).alias("word"), F.col("x.far").alias("far")))
    w = Window.partitionBy("word").orderBy("far", "fp").rowsBetween(Window.unboundedPreceding, 0)
    met = variants.select("fp", F.first("fp").over(w).alias("hub"), F.first("far").over(w).alias("hub_far"))
    return (met.where("fp <> hub and not hub_far")
            .select(F.greatest("fp", "hub").alias("a"), F.least("fp", "hub").alias("b")).distinct()
            .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                    max_bits: int = 2) -> DataFrame:
    """(id, fingerprint, component_id): the class of every document by SimHash distance.

    component_id is the smallest id reachable over links of at most ``max_bits``
    differing bits, the document itself included.  Documents with one fingerprint (all
    texts without words among them) form one class before any candidate is made, so a
    group of copies costs one row.  A null id takes part with its text but is never the
    smallest unless its class has no other; repeated ids are one row each.
    """
    fp = written(fingerprints(docs, id_col, text_col, words), "simhash")
    classes = written(fp.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash_classes")
    comp = connected_components(fingerprint_links(classes.select("fp"), max_bits))
    member = classes.join(comp, classes.fp == comp.node, "left").select(
        "fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    reach = member.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(member.join(reach, "component").select("fp", "n", "component_id"), "simhash_named")
    return (hot_join(fp, named, ["fp"], "n")      # a third of all texts may have one fingerprint
            .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id"))
