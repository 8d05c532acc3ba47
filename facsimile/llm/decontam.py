"""Benchmark decontamination by winnowed k-gram fingerprints, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import written

GRAM = 5     # words of a fingerprint; shorter windows use their own length
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of a text's words in order: A-Z lower-cased, words of a-z, 0-9 and all beyond ASCII."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.transform(F.filter(F.split(plain, OTHER), lambda w: w != ""), lambda w: F.xxhash64(w))


def with_winnowed(frame: DataFrame, size: int, name: str) -> DataFrame:
    """``frame`` with the chosen fingerprints of its ``words`` for windows of ``size`` words in ``name``.

    A fingerprint is the hash of up to ``GRAM`` consecutive words, in the place of its
    first word; null stands for each that is not the least of any window.  Equal least
    ones are all kept, so two texts that share the words of a window keep at least one
    fingerprint at the same place of it, whatever surrounds them.  A text shorter than a
    window has none.  Each step is a column of its own: inside the next step's lambda it
    is looked up, not made again.
    """
    k, window = _shape(size)
    none = F.array().cast("array<bigint>")
    whole = frame.withColumn("__g", F.when(F.size("words") >= size, F.transform(
        F.sequence(F.lit(0), F.size("words") - k),
        lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(k)]))).otherwise(none) if k > 1
        else F.when(F.size("words") >= size, F.col("words")).otherwise(none))
    if window == 1:
        return whole.withColumnRenamed("__g", name)
    least = whole.withColumn("__m", F.when(F.size("__g") >= window, F.transform(
        F.sequence(F.lit(0), F.size("__g") - window),
        lambda i: F.least(*[F.get("__g", i + j) for j in range(window)]))).otherwise(none))
    # a hash is chosen if it is the least of a window around it: the largest of those windows' least ones
    return least.withColumn(name, F.transform("__g", lambda h, i: F.when(
        h == F.greatest(*[F.get("__m", i - j) for j in range(window)]), h))).drop("__g", "__m")


def _shape(length: int) -> tuple[int, int]:
    """(words of a fingerprint, fingerprints of a window) for windows of ``length`` words."""
    k = min(GRAM, length)
    return k, length - k + 1


def _test_side(benchmark: DataFrame, item_col: str, text_col: str, length: int) -> DataFrame:
    """(item, size, words): the benchmark's items with words; ``size`` is their window length."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"),
                             word_hashes(F.col(f"`{text_col}`")).alias("words")).where(F.size("words") > 0)
    return items.withColumn("size", F.least(F.size("words"), F.lit(length)))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items, items_sha256, contaminated) of every document.

    A window is ``window`` consecutive words of a benchmark item, or the whole item if it
    has fewer but not none.  A document word is hit if any occurrence of a window covers
    it.  Texts of both sides are winnowed, equal fingerprints joined, and each such hit
    extended to all windows that hold the fingerprint, which must agree word by word.

    Null and empty texts have no words and no hits; items without words are left out;
    an item with a null id hits words but is not listed.  Repeated documents are one row
    each.  Without benchmark items nothing is hit.  The benchmark's fingerprints are
    written first, so the planner knows their size and broadcasts them only below its limit.
    """
    items = written(_test_side(benchmark, item_col, item_text_col, window), "bench_items")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())      # at most ``window`` numbers
    keyed = None
    for size in sizes:
        k, _ = _shape(size)
        part = with_winnowed(items.where(F.col("size") == size), size, "prints").select(
            "item", "words", "size", F.posexplode_outer("prints").alias("ipos", "h"))
        part = part.where("h is not null").select(
            F.col("h").alias("ih"), F.col("size").alias("isize"), "item", "ipos", F.size("words").alias("in_words"),
            F.greatest(F.col("ipos") - (size - k), F.lit(0)).alias("ilo"), "words").select(
            "ih", "isize", "item", "ipos", "in_words", "ilo",
            F.slice("words", F.col("ilo") + 1, F.lit(2 * size - k)).alias("iwords"))
        keyed = part if keyed is None else keyed.unionByName(part)

    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("th"),
                      word_hashes(F.col(f"`{text_col}`")).alias("words"))
    for size in sizes:
        src = with_winnowed(src, size, f"prints{size}")
    # one entry without a partner keeps every document in the join; its hash spreads them
    entry = lambda size, hashes: F.struct(F.lit(size).alias("size"), hashes.alias("hashes"))
    entries = F.array(entry(0, F.array(F.xxhash64("id", "th"))),
                      *[entry(s, F.col(f"prints{s}")) for s in sizes])
    prints = (src.select("id", "th", "words", F.explode(entries).alias("e"))
              .select("id", "th", "words", F.col("e.size").alias("size"), F.posexplode_outer("e.hashes").alias("pos", "h"))
              .where("h is not null"))
    gram = F.least(F.col("size"), F.lit(GRAM))
    lo = F.greatest(F.col("pos") - (F.col("size") - gram), F.lit(0))
    prints = prints.select("id", "th", "size", "pos", "h", F.size("words").alias("n_words"), lo.alias("lo"),
                           F.slice("words", lo + 1, F.greatest(2 * F.col("size") - gram, F.lit(0))).alias("near"))
    if keyed is None:
        hits = prints.where("size = 0").select("id", "th", "n_words", F.lit(None).cast("string").alias("item"),
                                               F.lit(None).cast("int").alias("at"), F.lit(0).alias("size"))
    else:
        keyed = written(keyed, "bench_prints")
        met = prints.join(keyed, (F.col("h") == F.col("ih")) & (F.col("size") == F.col("isize")), "left")
        met = met.where("isize is not null or size = 0")
        # every window that holds the fingerprint: it starts ``back`` words before it
        back = F.explode(F.when(F.col("size") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("size") - gram)))
        met = met.select("*", back.alias("back"))
        at, iat = F.col("pos") - F.col("back"), F.col("ipos") - F.col("back")
        same = ((at >= 0) & (iat >= 0) & (at + F.col("size") <= F.col("n_words")) & (iat + F.col("size") <= F.col("in_words"))
                & (F.slice("near", at - F.col("lo") + 1, F.col("size")) == F.slice("iwords", iat - F.col("ilo") + 1, F.col("size"))))
        hits = (met.where((F.col("size") == 0) | F.when((at >= F.col("lo")) & (iat >= F.col("ilo")), same).otherwise(False))
                .select("id", "th", "n_words", "item", F.when(F.col("size") > 0, at).alias("at"), "size"))
    span = F.when(F.col("at").isNotNull(), F.struct("at", (F.col("at") + F.col("size")).alias("end")))
    per = hits.groupBy("id", "th").agg(
        F.max("n_words").alias("n_words"), F.count(F.when(F.col("size") == 0, 1)).alias("copies"),
        F.array_sort(F.collect_set(span)).alias("spans"),
        F.array_sort(F.collect_set(F.when(F.col("at").isNotNull(), F.col("item")))).alias("items"))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("spans", none, lambda a, s: F.struct(
        F.greatest(a["end"], s["end"]).alias("end"),
        (a["n"] + F.greatest(s["end"] - F.greatest(s["at"], a["end"]), F.lit(0))).alias("n")))["n"]
    out = per.select("id", "n_words", "copies", covered.cast("long").alias("n_hit"), "items")
    return (out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_hit",
                    F.size("items").cast("long").alias("n_items"), "items",
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated")))
