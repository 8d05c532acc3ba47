"""Language ID by the nearest of several centroids per language, with rejection by distance."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.functions.names import free_name
from facsimile.llm.common import arrow_limits, slices

UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
_STEP = 1 << 20     # characters counted at a time
_MIX = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass(frozen=True)
class LangParams:
    """``fit_rows`` bounds the labelled rows a model is fitted on, over all languages together."""

    fit_rows: int = 4000
    centroids: int = 4          # per language
    dims_log2: int = 12         # hashed n-grams of one, two and three characters
    max_languages: int = 200    # more distinct labels than that raise an error
    rounds: int = 8             # of clustering
    reject_share: float = 0.5   # a text is rejected below this share of the similarity
    reject_quantile: float = 0.005  # that all but this part of the fitted texts of its length reach


def letters(text: str | None) -> str:
    """Lower-case letters of a text, every other run one space; empty if there is no letter."""
    s = _OTHER.sub(" ", text.lower()) if text else ""
    return s if any(map(str.isalpha, s)) else ""


def ngram_counts(s: str, dims_log2: int) -> np.ndarray:
    """Hashed counts of the n-grams of one to three characters of a whole text."""
    out = np.zeros(1 << dims_log2, np.float32)
    shift = np.uint64(64 - dims_log2)
    code = np.frombuffer(f" {s} ".encode("utf-32-le", "surrogatepass"), "<u4")
    for lo in range(0, len(code), _STEP):
        c = code[lo:lo + _STEP + 2].astype(np.uint64) + np.uint64(1)
        key, own = np.zeros(len(c), np.uint64), min(_STEP, len(code) - lo)
        for n, m in enumerate(_MIX):
            key = (key[:len(c) - n] ^ c[n:]) * m
            out += np.bincount((key[:own] >> shift).astype(np.int64), minlength=len(out))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


@dataclass
class LangModel:
    """Languages, IDF weights, unit centroids with their language, and the lowest similarity by length."""

    params: LangParams
    langs: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    centroids: np.ndarray | None = None
    owner: np.ndarray | None = None
    floor: np.ndarray | None = None     # by the whole part of log2 of the number of letters

    def vectors(self, texts: list[str]) -> np.ndarray:
        counts = np.stack([ngram_counts(s, self.params.dims_log2) for s in texts])
        return _unit(np.log1p(counts) * self.idf)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine with the nearest centroid, rejected) of every text.

        A text without letters (or any text when nothing was learned) is ``und`` with
        score 0 and rejected.  Ties go to the language that comes first in order.
        """
        clean = [letters(t) for t in texts]
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        rejected = np.ones(len(texts), bool)
        at = [i for i, s in enumerate(clean) if s]
        for lo in range(0, len(at), 256) if self.langs else ():
            part = at[lo:lo + 256]
            sim = self.vectors([clean[i] for i in part]) @ self.centroids.T
            best = sim.argmax(1)
            top = np.clip(sim[np.arange(len(part)), best], 0, 1).astype(float)
            size = np.log2([len(clean[i]) for i in part]).astype(int).clip(0, len(self.floor) - 1)
            for i, b, s, f in zip(part, best, top, self.floor[size]):
                lang[i], score[i], rejected[i] = self.langs[self.owner[b]], s, s < f
        return lang, score, rejected


def _cluster(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means from spread-out starting rows; rows are unit vectors."""
    chosen = [x.mean(0)]
    near = x @ chosen[0]
    for _ in range(min(k, len(x)) - 1):
        chosen.append(x[int(near.argmin())])
        near = np.maximum(near, x @ chosen[-1])
    cent = _unit(np.stack(chosen))
    for _ in range(rounds):
        own = (x @ cent.T).argmax(1)
        cent = _unit(np.stack([x[own == j].mean(0) if (own == j).any() else cent[j] for j in range(len(cent))]))
    return cent


def fit(labelled: DataFrame, params: LangParams = LangParams(), id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> LangModel:
    """Learn from the texts and non-null languages of ``labelled``; id and source are not features.

    The sample takes about as many rows of each language, by a hash of their id, and
    ``fit_rows`` in all at most; only their hashed n-gram counts come to the driver.
    Null texts and texts without letters teach nothing.
    """
    spark = labelled.sparkSession
    arrow_limits(spark)
    src = labelled.select(F.xxhash64(F.col(f"`{id_col}`").cast("string")).alias("h"),
                          F.col(f"`{text_col}`").cast("string").alias("text"),
                          F.col(f"`{lang_col}`").cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in src.groupBy("lang").count().limit(params.max_languages + 1).collect()}
    if len(sizes) > params.max_languages:
        raise ValueError(f"more than {params.max_languages} languages")
    model = LangModel(params)
    if not sizes:
        return model
    per = max(1, params.fit_rows // len(sizes))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per / n))])
    spot = F.pmod(F.col("h"), F.lit(1_000_003)) / 1_000_003
    sample = src.where(spot < share[F.col("lang")]).orderBy("h", "text").limit(params.fit_rows)
    dims = params.dims_log2
    schema = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("at", pa.binary()), ("count", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            rows = []
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                if s := letters(text):
                    c = ngram_counts(s, dims)
                    at = np.flatnonzero(c)
                    rows.append(dict(lang=lang, n=len(s), at=at.astype("<u4").tobytes(), count=c[at].astype("<f4").tobytes()))
            yield pa.RecordBatch.from_pylist(rows, schema)

    got = sample.mapInArrow(count, "lang string, n long, at binary, count binary").collect()
    if not got:
        return model
    x = np.zeros((len(got), 1 << dims), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], "<u4")] = np.frombuffer(r["count"], "<f4")
    model.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + np.float32(1e-3)
    np.log1p(x, out=x)
    x *= model.idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    model.langs = sorted({r["lang"] for r in got})
    y = np.array([model.langs.index(r["lang"]) for r in got])
    cents = [_cluster(x[y == j], params.centroids, params.rounds) for j in range(len(model.langs))]
    model.centroids = np.concatenate(cents)
    model.owner = np.concatenate([np.full(len(c), j) for j, c in enumerate(cents)])
    best = (x @ model.centroids.T).max(1)
    size = np.log2([r["n"] for r in got]).astype(int)
    floor = np.array([np.quantile(best[size == b], params.reject_quantile) if (size == b).sum() >= 20 else np.nan
                      for b in range(40)])
    # lengths with few fitted texts: the value of the next length up to the shortest known, falling to 0 below it
    known = np.flatnonzero(~np.isnan(floor))
    filled = np.interp(np.arange(40), known, floor[known]) if len(known) else np.zeros(40)
    if len(known):
        filled[:known[0]] *= np.arange(known[0]) / max(1, known[0])
    model.floor = params.reject_share * np.minimum.accumulate(filled[::-1])[::-1]
    return model


def predict(docs: DataFrame, model: LangModel, text_col: str = "text", names: tuple[str, str, str] = (
        "lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with the predicted language, the similarity 0..1 and whether it is rejected.

    Any columns pass through; one that has an output's name is replaced.  A null or
    letterless text is ``und``, score 0 and rejected.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(model)
    rest = [f for f in docs.schema if f.name not in names]
    keep = docs.select(*[F.col(f"`{f.name}`") for f in rest], F.col(f"`{text_col}`").cast("string").alias(free_name("text", docs.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, rejected = shared.value.predict(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                                             names=[*(f.name for f in rest), *names])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest]
    return keep.mapInArrow(run, ", ".join([*schema, f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean"]))
