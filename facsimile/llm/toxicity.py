"""Toxicity: a logistic classifier whose score may not change when identity terms are swapped.

Texts are read a batch at a time: the words of a batch are coded once, features are
taken of its distinct words, all at once, and sums run over (text, feature) pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.functions.names import free_name
from facsimile.llm.common import arrow_limits, slices, written

BUCKETS = 1 << 18       # of character n-grams; words and their beginnings keep a 63-bit hash
PAIRS = 1_000_000       # (feature, counts) rows a task holds before it sums them up
#: First and last code points of scripts without spaces.
UNSPACED = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))

# Words that name a group of people; each row's words are swapped for one another.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "african", "european", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)


@dataclass(frozen=True)
class ToxicParams:
    """``fit_rows`` bounds the labelled rows the weights are fitted on; feature counts use all of them."""

    fit_rows: int = 20_000
    features: int = 1024        # kept of the words and word beginnings, and as many character n-grams, by evidence
    min_docs: int = 3
    ridge: float = 1e-5
    swap_penalty: float = 1.0   # weight of squared score changes under swaps
    swaps: int = 2000           # swapped sentences used, of the fitted rows
    rounds: int = 40            # tens of accelerated gradient steps


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text of each word, its place among the distinct words, distinct words) of a batch; words are runs of letters."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    split = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, r"[^\p{L}]+", " "))
    limits = split.offsets.to_numpy()
    coded = split.flatten().dictionary_encode()
    row, at = np.repeat(np.arange(len(limits) - 1), np.diff(limits)), coded.indices.to_numpy()
    empty = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    if empty.any():
        row, at = row[~empty[at]], at[~empty[at]]
    return row, at, coded.dictionary


def word_features(distinct: pa.Array, grams: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) pairs of distinct words: each word, its beginnings of four to six letters and its character n-grams.

    The n-grams are taken at every place of the whole word: four characters, and two and
    three in scripts without spaces, where a "word" is a clause.  A feature is a number:
    an n-gram's bucket, or a negative hash.  With ``grams``, a mask of buckets, only
    n-grams of those are taken.
    """
    n = pc.utf8_length(distinct).to_numpy().astype(np.int64)
    code = np.frombuffer("".join(distinct.to_pylist()).encode("utf-32-le"), "<u4").astype(np.uint64)
    first = np.cumsum(n) - n
    word = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(code)) - first[word]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(code + np.uint64(0x9E3779B97F4A7C15) * (place + 1).astype(np.uint64)))])
    top = np.uint64(1 << 63)

    def beginning(which: np.ndarray, size) -> np.ndarray:
        kind = 0 if size is None else size
        end = first[which] + (n[which] if size is None else size)
        return (_mix((total[end] - total[first[which]]) ^ np.uint64(kind)) | top).view(np.int64)

    every = np.arange(len(n))
    owner, feature = [every], [beginning(every, None)]
    for k in (4, 5, 6):
        longer = np.flatnonzero(n > k)
        owner.append(longer)
        feature.append(beginning(longer, k))
    bare = np.zeros(len(n), bool)
    for lo, hi in UNSPACED:
        bare[word[(code >= lo) & (code <= hi)]] = True
    for k, here in ((4, ~bare), (2, bare), (3, bare)):
        at = np.flatnonzero((place + k <= n[word]) & here[word])
        gram = np.full(len(at), k, np.uint64)
        for i in range(k):
            gram = _mix(gram * np.uint64(0x9E3779B97F4A7C15) + code[at + i])
        gram = (gram % np.uint64(BUCKETS)).astype(np.int64)
        if grams is not None:
            at, gram = at[grams[gram]], gram[grams[gram]]
        own = np.unique(word[at] * BUCKETS + gram)      # an n-gram counts once a word
        owner.append(own // BUCKETS)
        feature.append(own % BUCKETS)
    return np.concatenate(owner), np.concatenate(feature)


def _by_word(owner: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, count, values): the values of word w are values[first[w]:first[w] + count[w]]."""
    order = np.argsort(owner, kind="stable")
    count = np.bincount(owner, minlength=size)
    return np.cumsum(count) - count, count, value[order]


def _spread(row: np.ndarray, at: np.ndarray, first: np.ndarray, count: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of every value of every word in ``at``."""
    n = count[at]
    end = np.cumsum(n)
    return np.repeat(row, n), values[np.repeat(first[at] - end + n, n) + np.arange(end[-1] if len(end) else 0)]


def _groups() -> dict[str, tuple[str, ...]]:
    return {w: g for g in IDENTITY_TERMS for w in g}


@dataclass
class ToxicModel:
    """Weights of the kept features; a feature counts log(1 + its words) in a text.

    ``features`` holds the kept features in rising order, ``index`` the numbers of the
    identity terms among them.
    """

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray | None = None
    bias: float = -20.0

    def kept(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(word, number) pairs of the words' features that are kept."""
        if not len(self.features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams = np.zeros(BUCKETS, bool)
        grams[self.features[self.features >= 0]] = True
        owner, feature = word_features(distinct, grams)
        at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
        have = self.features[at] == feature
        return owner[have], at[have]

    def count(self, row: np.ndarray, at: np.ndarray, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, words) in rising order: how often each kept feature is in each whole text."""
        first, n, values = _by_word(*self.kept(distinct), len(distinct))
        some = n[at] > 0
        pair_row, pair = _spread(row[some], at[some], first, n, values)
        size = max(1, len(self.features))
        key, times = np.unique(pair_row * size + pair, return_counts=True)
        return key // size, key % size, times

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Score of every text of a batch."""
        z = np.full(len(texts), self.bias)
        if self.weights is not None and len(self.features):
            row, at, times = self.count(*words(texts))
            z += np.bincount(row, self.weights[at] * np.log1p(times), len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def score(self, text: str | None) -> float:
        return float(self.scores(pa.array([text], pa.string()))[0])


def feature_counts(labelled: DataFrame) -> DataFrame:
    """(feature, n, bad): labelled texts, and toxic ones, that hold each feature; all rows count."""
    schema = pa.schema([("feature", pa.int64()), ("n", pa.int64()), ("bad", pa.int64())])

    def summed(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        feature, n, bad = (np.concatenate(x) for x in zip(*held))
        own, at = np.unique(feature, return_inverse=True)
        return own, np.bincount(at, n).astype(np.int64), np.bincount(at, bad).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in slices(batches, 500):
            row, at, distinct = words(b.column(0))
            label = b.column(1).to_numpy() > 0
            pair = np.unique(row * max(1, len(distinct)) + at)      # a word counts once a text
            row, at = pair // max(1, len(distinct)), pair % max(1, len(distinct))
            owner, feature = word_features(distinct)
            own, code = np.unique(feature, return_inverse=True)
            row, code = _spread(row, at, *_by_word(owner, code, len(distinct)))
            pair = np.unique(row * max(1, len(own)) + code)         # and so does a feature
            row, code = pair // max(1, len(own)), pair % max(1, len(own))
            n = np.bincount(code, minlength=len(own))
            held.append((own[n > 0], n[n > 0], np.bincount(code, label[row], len(own))[n > 0]))
            size += len(own)
            if size > PAIRS:
                held = [summed(held)]
                size = len(held[0][0])
                if size > PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in summed(held)], schema=schema)

    part = labelled.mapInArrow(run, "feature long, n long, bad long")
    return part.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def _train(x_at: list[np.ndarray], x_val: list[np.ndarray], y: np.ndarray, swaps: list[tuple[int, np.ndarray]],
           size: int, p: ToxicParams) -> tuple[np.ndarray, float]:
    """Ridge logistic regression plus ``swap_penalty`` times the mean squared change of the logit under swaps.

    Accelerated gradient steps on the (row, feature, value) triples; ``swaps`` holds, per
    changed sentence, the difference of its feature vector to the swapped one.
    """
    row = np.repeat(np.arange(len(x_at)), [len(a) for a in x_at])
    col = np.concatenate(x_at).astype(np.int64) if x_at else np.zeros(0, np.int64)
    val = np.concatenate(x_val) if x_val else np.zeros(0)
    n = max(1, len(y))
    diff = np.stack([d for _, d in swaps]) if swaps else np.zeros((0, size))
    # a feature's own curvature scales its steps
    curve = 0.25 * np.bincount(col, val * val, size) / n + p.ridge
    if len(diff):
        curve += p.swap_penalty * (diff * diff).sum(0) / len(diff)
    w, v, b, vb = np.zeros(size), np.zeros(size), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), 0.0
    per_row = max(1.0, np.bincount(row, minlength=n).max() if len(row) else 1.0)
    step = 1 / np.sqrt(per_row)
    for t in range(p.rounds * 10):
        wl, bl = w + 0.9 * v, b + 0.9 * vb
        prob = 1 / (1 + np.exp(-np.clip(bl + np.bincount(row, val * wl[col], n), -40, 40)))
        err = (prob - y) / n
        g = np.bincount(col, val * err[row], size) + p.ridge * wl
        if len(diff):
            g += p.swap_penalty * diff.T @ (diff @ wl) / len(diff)
        v = 0.9 * v - 0.1 * step * g / curve
        vb = 0.9 * vb - 0.1 * err.sum() / 0.25
        w, b = w + v, b + vb
    return w, b


def fit(docs: DataFrame, labels: DataFrame, params: ToxicParams = ToxicParams(), id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic") -> ToxicModel:
    """Learn from the texts of ``docs`` whose id ``labels`` marks 0 or 1.

    First all labelled texts count how many of them, and how many toxic ones, hold each
    word, word beginning and character n-gram; of the words with their beginnings and of
    the n-grams the ``features`` with the strongest evidence either way are kept, the
    identity terms always.  Then the weights are fitted on ``fit_rows`` rows at
    most, taken by a hash of their id; only their kept features come to the driver.
    Rows with a null id, text or label teach nothing; an id with several labels counts
    once for each.  Without labelled rows every score is near 0.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    lab = (labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
           .where("id is not null and y is not null").distinct())
    txt = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    total, bad = lab.join(txt.select("id"), "id").agg(F.count("y"), F.sum("y")).first()
    model = ToxicModel()
    if not total or not bad or bad == total:
        return model
    base = bad / total
    # labels grow with the corpus: they are dealt by id like the texts, at every size alike
    stats = feature_counts(txt.join(lab.hint("merge"), "id").select("text", "y")).where(F.col("n") >= params.min_docs)
    z = (F.col("bad") - base * F.col("n")) / F.sqrt(F.col("n") * base * (1 - base))
    stats = written(stats.select("feature", F.abs(z).alias("z"), (F.col("feature") >= 0).alias("gram")), "features")
    keep: set[int] = set()
    for gram in (False, True):
        top = stats.where(F.col("gram") == gram).orderBy(F.desc("z"), "feature").limit(params.features).collect()
        keep.update(r["feature"] for r in top)
    terms = pa.array([w for g in IDENTITY_TERMS for w in g], pa.large_string())
    owner, feature = word_features(terms)
    keep.update(feature.tolist())
    model.features = np.array(sorted(keep), np.int64)
    # a word's own feature comes first
    model.index = dict(zip(terms.to_pylist(), np.searchsorted(model.features, feature[:len(terms)]).tolist()))
    spot = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_003)) / 1_000_003
    chosen = lab.where(spot < params.fit_rows / total).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(params.fit_rows)
    shared = spark.sparkContext.broadcast(model)
    groups = _groups()
    schema = pa.schema([("id_hash", pa.int64()), ("y", pa.int32()), *((c, pa.binary()) for c in ("at", "val", "swap_at", "swap_val"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, 500):
            row, at, distinct = words(b.column(1))
            one = m.count(row, at, distinct)
            plain = distinct.to_pylist()
            named = np.array([w in groups for w in plain], bool)
            rows_named = np.unique(row[named[at]]) if len(plain) else row
            other_words = [groups[w][(groups[w].index(w) + 1) % len(groups[w])] if w in groups else w for w in plain]
            touched = np.isin(row, rows_named)
            two = m.count(row[touched], at[touched], pa.array(other_words, pa.large_string()))
            rows = []
            cut = [np.searchsorted(x[0], np.arange(b.num_rows + 1)) for x in (one, two)]
            for i, (h, y) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                lo, hi = cut[0][i], cut[0][i + 1]
                f, v = one[1][lo:hi], np.log1p(one[2][lo:hi])
                swap_at, swap_val = f[:0], v[:0]
                if cut[1][i] < cut[1][i + 1] or i in rows_named:
                    lo, hi = cut[1][i], cut[1][i + 1]
                    d = np.zeros(len(m.features))
                    d[f] += v
                    d[two[1][lo:hi]] -= np.log1p(two[2][lo:hi])
                    swap_at = np.flatnonzero(d)
                    swap_val = d[swap_at]
                rows.append(dict(id_hash=h, y=y, at=f.astype("<i4").tobytes(), val=v.astype("<f8").tobytes(),
                                 swap_at=swap_at.astype("<i4").tobytes(), swap_val=swap_val.astype("<f8").tobytes()))
            yield pa.RecordBatch.from_pylist(rows, schema)

    got = txt.join(F.broadcast(chosen), "id").select(F.xxhash64(F.col("id").cast("string")).alias("h"), "text", "y").mapInArrow(
        run, "id_hash long, y int, at binary, val binary, swap_at binary, swap_val binary").collect()
    got.sort(key=lambda r: (r["y"], r["at"], r["val"]))     # the same sums whatever the tasks' order
    swaps = []
    # by the hash of the id, so both labels are among them as they are among all
    for i, r in enumerate(sorted((r for r in got if r["swap_at"]), key=lambda r: r["id_hash"])[:params.swaps]):
        d = np.zeros(len(keep))
        d[np.frombuffer(r["swap_at"], "<i4")] = np.frombuffer(r["swap_val"], "<f8")
        swaps.append((i, d))
    # labelled sentences without identity terms: the swap of a mention put into them changes these features
    own = [model.kept(terms.slice(i, 1))[1] for i in range(len(terms))]
    number = {w: i for i, w in enumerate(terms.to_pylist())}
    for g in IDENTITY_TERMS:
        for one, two in zip(g, (*g[1:], g[0])):
            d = np.zeros(len(keep))
            d[own[number[one]]] += np.log(2)
            d[own[number[two]]] -= np.log(2)
            swaps.append((-1, d))
    model.weights, model.bias = _train([np.frombuffer(r["at"], "<i4") for r in got], [np.frombuffer(r["val"], "<f8") for r in got],
                                       np.array([float(r["y"] > 0) for r in got]), swaps, len(keep), params)
    return model


def predict(docs: DataFrame, model: ToxicModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score 0..1, higher where a toxic label is likelier.

    Any columns pass through; one that has the output's name is replaced.  A null or
    empty text gets the score of a text without any kept feature.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(model)
    rest = [f for f in docs.schema if f.name != name]
    keep = docs.select(*[F.col(f"`{f.name}`") for f in rest], F.col(f"`{text_col}`").cast("string").alias(free_name("text", docs.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            score = shared.value.scores(b.column(b.num_columns - 1))
            pa.default_memory_pool().release_unused()       # a worker that waits keeps little
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score, pa.float64())],
                                             names=[*(f.name for f in rest), name])

    return keep.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{name}` double"]))
