"""Language-model scores by deleted interpolation of word n-grams.

The corpus is gathered by its distinct n-grams, not its tokens: a *lot* of texts sends
the counts of its distinct n-grams to the parts of the hash space.  A part adds up the
counts of all lots and answers each lot in the order of its n-grams.  A lot then meets
its texts again, numbers the n-grams anew and knows the corpus count of each.  It writes
the counts of its tokens in order, compressed; the weights and then the scores come from
those, so texts are cut into words twice, not once a step.  A word that a third of all
texts hold costs one entry a lot.  Only compressed texts, distinct n-grams and their
counts are shuffled.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import ARROW_BYTES, arrow_limits, written

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_LANE, _ONES = np.uint64(0x94D049BB133111EB), np.uint64(0xFFFFFFFFFFFFFFFF)
END = xxhash.xxh64_intdigest(b"", 1)       # no word is empty
START = xxhash.xxh64_intdigest(b"", 2)
_SQUEEZE, _SWELL = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()      # costly to make for every small array


@dataclass(frozen=True)
class LmParams:
    """``lot_tokens``: about as many tokens are a lot (more if one text has more)."""

    lot_tokens: int = 1_000_000
    part_chars: int = 16_000_000    # the n-grams of about so many characters are a part: a lot has a row for each part
    piece_tokens: int = 65_536      # about as many tokens' counts are one row of those written for the scores
    buckets: int = 64           # of contexts, by the whole part of log2 of their count: any count has its own
    grid: int = 48              # cells a side in which held-out counts are added up
    em_rounds: int = 60


def _zip(a: np.ndarray) -> bytes:
    """A compressed array, byte planes apart."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize)
    head = struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a))
    return head + _SQUEEZE.compress(np.ascontiguousarray(raw.T).tobytes())


def _unzip(b: bytes) -> np.ndarray:
    kind, n = struct.unpack_from("<2sQ", b)
    dtype = np.dtype("<" + kind.decode())
    raw = _SWELL.decompress(b[struct.calcsize("<2sQ"):], max_output_size=max(1, n * dtype.itemsize))
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).ravel()


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit keys of two words in order."""
    x = (before * _A) ^ (word + _B)
    x ^= x >> np.uint64(29)
    x *= _B
    return x ^ (x >> np.uint64(32))


_WIDE = 64      # bytes; longer words are few


def word_keys(words: pa.Array) -> np.ndarray:
    """64-bit keys of large binary words without nulls: their eight-byte lanes mixed in order, longer words digested."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))     # the eight bytes from every place on
    size = np.diff(offsets)
    keys = pair_keys(np.full(len(size), _LANE), size.astype(np.uint64))
    some = np.flatnonzero((size > 0) & (size <= _WIDE))
    for k in range(0, _WIDE, 8):
        some = some[size[some] > k]
        left = np.minimum(size[some] - k, 8).astype(np.uint64)
        lane = lanes[offsets[some] - offsets[0] + k] & (_ONES >> (np.uint64(64) - np.uint64(8) * left))
        keys[some] = pair_keys(keys[some], lane)
    for i in np.flatnonzero(size > _WIDE).tolist():
        keys[i] = xxhash.xxh64_intdigest(words[i].as_py())
    return keys


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths of the texts, distinct keys of words and pairs, the place of every word, then of every pair).

    The words of a text in order, A-Z lower-cased and cut at ASCII white space, and END.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_binary()).view(pa.large_string())))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    some = pc.greater(pc.binary_length(flat), 0)        # white space at an end of a text leaves an empty word
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    lengths = before[offsets[1:]] - before[offsets[:-1]] + 1
    coded = flat.filter(some).dictionary_encode()
    del lists, flat, some, before
    known = np.append(word_keys(coded.dictionary.view(pa.large_binary())), np.uint64(END))
    ends = np.cumsum(lengths) - 1
    body = np.ones(int(lengths.sum()), bool)
    body[ends] = False
    code = np.full(len(body), len(known) - 1, np.int64)
    code[body] = coded.indices.to_numpy()
    del coded, body
    pa.default_memory_pool().release_unused()       # a worker that waits keeps little
    words = known[code]
    before = np.concatenate([[np.uint64(START)], words[:-1]])
    before[ends[:-1] + 1] = START
    pairs, place = np.unique(pair_keys(before, words), return_inverse=True)
    del words, before
    # both kinds in one order: every word before the first pair that is not below it
    order = np.argsort(known)
    ahead = np.searchsorted(pairs, known[order])
    of_word, of_pair = np.empty(len(known), np.int64), np.arange(len(pairs))
    of_word[order] = ahead + np.arange(len(known))
    of_pair += np.cumsum(np.bincount(ahead, minlength=len(pairs) + 1))[:-1]
    distinct = np.empty(len(known) + len(pairs), np.uint64)
    distinct[of_word], distinct[of_pair] = known, pairs
    return lengths, distinct, np.concatenate([of_word[code], of_pair[place]])


def _cuts(distinct: np.ndarray, parts_log2: int) -> list[int]:
    """Where the sorted keys of each part of the hash space begin, and their end."""
    if not parts_log2:
        return [0, len(distinct)]
    firsts = np.arange(1 << parts_log2, dtype=np.uint64) << np.uint64(64 - parts_log2)
    return [*np.searchsorted(distinct, firsts).tolist(), len(distinct)]


def _lots(batches: Iterator[pa.RecordBatch], lot_tokens: int) -> Iterator[tuple[int, list[tuple]]]:
    """(name, rows) of each lot of a task: rows of (id, held, text as bytes) of one file block, cut by their bytes."""
    rows, size, number, place = [], 0, 0, None
    name = lambda: xxhash.xxh64_intdigest(struct.pack("<qq", place, number)) >> 1
    for b in batches:
        for i, held, text, at in zip(*(c.to_pylist() for c in b.columns)):
            if at != place and rows:
                yield name(), rows
                rows, size = [], 0
            place, number = at, number if at == place else 0
            raw = (text or "").encode("utf-8", "surrogatepass")
            rows.append((i, held, raw))
            size += len(raw) + 8
            if size >= 6 * lot_tokens:
                yield name(), rows
                rows, size, number = [], 0, number + 1
    if rows:
        yield name(), rows


def _asked(src: DataFrame, parts_log2: int, p: LmParams) -> DataFrame:
    """(part, lot, keys, counts): each lot's distinct n-grams with their counts in training texts."""
    schema = pa.schema([("part", pa.int32()), ("lot", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in _lots(batches, p.lot_tokens):
            lengths, distinct, at = _numbered([r[2] for r in rows])
            weight = np.tile(np.repeat(~np.array([r[1] for r in rows]), lengths), 2)
            count = np.bincount(at, weight, len(distinct)).astype("<u4") << 1
            count[at[:len(at) // 2]] |= 1       # the last bit marks words
            cut = _cuts(distinct, parts_log2)
            out, size = [], 0
            for q, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])):
                if lo < hi:
                    step = np.diff(distinct[lo:hi], prepend=np.uint64(0)).astype("<u8")
                    out.append(dict(part=q, lot=name, keys=_zip(step), counts=_zip(count[lo:hi])))
                    size += len(out[-1]["keys"]) + len(out[-1]["counts"])
                    if size >= ARROW_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return src.mapInArrow(run, "part int, lot long, keys binary, counts binary")


def _add_up(key, frame: pd.DataFrame) -> pd.DataFrame:
    """A part's corpus counts for each lot in the order it asked, with a checksum of its keys; and the words' totals."""
    lots = frame.sort_values("lot")
    keys = [np.cumsum(_unzip(d), dtype=np.uint64) for d in lots["keys"]]
    sums = [zlib.crc32(k.tobytes()) for k in keys]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    ends = np.cumsum([len(k) for k in keys])[:-1]
    flat = np.concatenate([_unzip(m) for m in lots["counts"]])
    total = np.bincount(at, flat >> 1, len(distinct)).astype("<u8")
    word = np.zeros(len(distinct), bool)
    word[at[(flat & 1) == 1]] = True
    small = total.astype("<u4") if total.max(initial=0) < 1 << 32 else total
    n, v = int(total[word].sum()), int((total[word] > 0).sum())
    return pd.DataFrame({"lot": [*lots.lot, -1], "part": int(key[0]), "counts": [*(_zip(small[i]) for i in np.split(at, ends)), None],
                         "sum": [*sums, 0], "n": [*[0] * len(lots), n], "v": [*[0] * len(lots), v]})


def _texts(src: DataFrame, kind: str, p: LmParams) -> DataFrame:
    """(lot, part = -1, counts, sum): the compressed texts of each lot, in the shape of an answer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in _lots(batches, p.lot_tokens):
            ids = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]),
                                              pa.array([r[2] for r in rows], pa.large_binary())], names=["id", "held", "text"])
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([-1], pa.int32()), pa.array([_stream(ids, 3)], pa.binary()),
                                              pa.array([0])], names=["lot", "part", "counts", "sum"])

    return src.mapInArrow(run, "lot long, part int, counts binary, sum long")


def _counted(frame: pd.DataFrame, parts_log2: int):
    """(ids, held, lengths of the texts, counts of each token's word and pair) of a lot."""
    texts = frame[frame.part < 0]
    answers = frame[frame.part >= 0].sort_values("part")
    if len(texts) != 1:
        raise RuntimeError("a lot has not been read the same way twice: write the input first (stable=False)")
    rows = _table(texts.counts.iloc[0])
    ids, held = rows.column("id").to_pylist(), np.array(rows.column("held").to_pylist(), bool)
    lengths, distinct, at = _numbered(rows.column("text").to_pylist())
    cut = _cuts(distinct, parts_log2)
    own = {q: zlib.crc32(distinct[lo:hi].tobytes()) for q, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])) if lo < hi}
    if own != dict(zip(answers.part.tolist(), answers["sum"].tolist())):
        raise RuntimeError("a lot has not been read the same way twice: write the input first (stable=False)")
    both = np.concatenate([_unzip(d) for d in answers.counts])[at]
    return ids, held, lengths, both[:len(at) // 2], both[len(at) // 2:]


def _contexts(c1: np.ndarray, lengths: np.ndarray, starts: int) -> np.ndarray:
    """The counts of the words before, for a text's first word that of the texts."""
    ctx = np.concatenate([[0.0], c1[:-1]])
    ctx[np.cumsum(lengths) - lengths] = starts
    return ctx


def _pieces(ids: list, held: np.ndarray, lengths: np.ndarray, c1: np.ndarray, c2: np.ndarray, tokens: int) -> Iterator[dict]:
    """(texts, c1, c2), compressed, for runs of whole texts of about so many tokens."""
    ends = np.cumsum(lengths)
    lo = 0
    while lo < len(ids):
        first = int(ends[lo] - lengths[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, first + tokens, "right")))
        last = int(ends[hi - 1])
        texts = pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), pa.array(held[lo:hi]), pa.array(lengths[lo:hi])],
                                           names=["id", "held", "length"])
        yield {"texts": _stream(texts, 1), "c1": _zip(c1[first:last]), "c2": _zip(c2[first:last])}
        lo = hi


def _stream(batch: pa.RecordBatch, level: int) -> bytes:
    """A batch as compressed Arrow stream, read by :func:`_table`."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=level).compress(sink.getvalue().to_pybytes())


def _table(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(_SWELL.decompress(blob)).read_all()


def _estimates(c1: np.ndarray, c2: np.ndarray, ctx: np.ndarray, n: int, less: np.ndarray | int = 0):
    """(context counts, maximum-likelihood probabilities of pairs and words); ``less`` 1 leaves the token itself out."""
    ctx = ctx - less
    p2 = np.divide(c2 - less, ctx, out=np.zeros_like(c2), where=ctx > 0)
    return ctx, np.maximum(p2, 0), np.maximum(c1 - less, 0) / np.maximum(1, n - less)


def _mixed(ctx: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float, w: np.ndarray) -> np.ndarray:
    """log10 of the mixed estimates; after a context never seen the pair's weight goes to the others."""
    b = _bucket(ctx, len(w))
    full = np.where(ctx > 0, 1.0, w[b, 0] + w[b, 1])
    return np.log10((w[b, 0] * p0 + w[b, 1] * p1 + np.where(ctx > 0, w[b, 2] * p2, 0)) / full)


def _bucket(ctx: np.ndarray, buckets: int) -> np.ndarray:
    return np.clip(np.log2(np.maximum(ctx, 0) + 1).astype(int), 0, buckets - 1)


def mixture(cells: dict[tuple[int, int, int], tuple[float, float, float, float]], buckets: int, rounds: int) -> np.ndarray:
    """Weights (uniform, word, pair) of every bucket by expectation-maximisation.

    ``cells`` holds (tokens, mean uniform, mean word and mean pair probability) of the
    held-out counts.  A bucket without any takes the weights of the nearest one below.
    """
    out = np.tile(np.array([0.05, 0.65, 0.3]), (buckets, 1))
    for b in range(buckets):
        own = np.array([c for (k, _, _), c in sorted(cells.items()) if k == b])
        if not len(own):
            out[b] = out[b - 1] if b else [0.1, 0.9, 0.0]
            continue
        n, p = own[:, 0], own[:, 1:]
        w = out[b].copy()
        for _ in range(rounds):
            share = w * p
            share /= share.sum(1, keepdims=True)
            w = (n[:, None] * share).sum(0) / n.sum()
            w = np.maximum(w, [1e-6, 0, 0])     # any text keeps a probability
            w /= w.sum()
        out[b] = w
    return out


def score(docs: DataFrame, held: str, params: LmParams = LmParams(), id_col: str = "doc_id", text_col: str = "text",
          parts_log2: int | None = None, stable: bool = False) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, deleted_score) of every document.

    ``held`` names a boolean column: rows where it is true teach nothing (null: false).
    Tokens are a whole text's words (A-Z lower-cased, cut at ASCII white space) and one
    end.  ``base_score`` adds log10((c+1)/(N+1*(V+1))) over the tokens.  ``score`` is the
    log10 probability under pair, word and uniform estimates mixed by the count of the
    word before; the weights come from counts with the token itself left out.  A
    training text is part of those counts and so looks likely to the model whatever it
    says; ``deleted_score`` leaves each of its tokens out of the counts it is judged
    by, so a text that the corpus holds once more stands apart.  For other texts it is
    ``score``.  A null
    or empty text is its end alone; repeated rows are one each; without training rows
    all probability is uniform.  Every n-gram of every training text is counted.

    The texts are read twice and must come in the same file blocks and order each
    time: ``stable`` says that ``docs`` is a scan of files, which does.  Otherwise it is
    written first.  A lot whose n-grams differ between two reads raises an error.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{held}`"), F.lit(False)).alias("held"),
                      F.col(f"`{text_col}`").cast("string").alias("text"))
    src = src if stable else written(src, "lm_texts")
    src = src.withColumn("place", F.xxhash64(F.input_file_name(), F.input_file_block_start()))
    kind = src.schema["id"].dataType.simpleString()
    if parts_log2 is None:
        chars = src.agg(F.sum(F.length("text"))).first()[0] or 0
        parts_log2 = int(np.clip(np.ceil(np.log2(max(1, chars / params.part_chars))), 0, 20))
    answers = written(_asked(src, parts_log2, params).groupBy("part").applyInPandas(
        _add_up, "lot long, part int, counts binary, sum long, n long, v long"), "lm_counts")
    totals = answers.where("lot < 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    n, v = int(totals[0]), int(totals[1])
    starts = src.where(~F.col("held")).count()
    both = answers.where("lot >= 0").select("lot", "part", "counts", "sum").unionByName(_texts(src, kind, params))
    grid, buckets = params.grid, params.buckets

    def tally(key, frame: pd.DataFrame) -> pd.DataFrame:
        ids, held_, lengths, c1, c2 = _counted(frame, parts_log2)
        pieces = pd.DataFrame(_pieces(ids, held_, lengths, c1, c2, params.piece_tokens))
        on = np.repeat(~held_, lengths)
        c1, c2 = c1.astype(float), c2.astype(float)
        ctx, p2, p1 = _estimates(c1[on], c2[on], _contexts(c1, lengths, starts)[on], n, 1)
        b = _bucket(ctx, buckets)
        place = lambda p: np.where(p > 0, np.clip(np.log2(np.maximum(p, 1e-300) * (v + 1)) + grid // 4, 1, grid - 1), 0).astype(int)
        cell = (b * grid + place(p1)) * grid + place(p2)
        size = buckets * grid * grid
        m, s1, s2 = np.bincount(cell, minlength=size), np.bincount(cell, p1, size), np.bincount(cell, p2, size)
        some = np.flatnonzero(m)
        shape = {"cell": np.full(len(pieces), -1), "m": 0, "s1": 0.0, "s2": 0.0}
        return pd.concat([pieces.assign(**shape), pd.DataFrame({"texts": None, "c1": None, "c2": None, "cell": some, "m": m[some],
                                                                "s1": s1[some], "s2": s2[some]})], ignore_index=True)

    counted = written(both.groupBy("lot").applyInPandas(
        tally, "texts binary, c1 binary, c2 binary, cell long, m long, s1 double, s2 double"), "lm_counted")
    cells = (counted.where("cell >= 0").groupBy("cell").agg(F.sum("m"), F.sum("s1"), F.sum("s2"))
             .collect())        # at most buckets * grid * grid
    p0 = 1 / (v + 1)
    weights = mixture({(c // grid ** 2, c // grid % grid, c % grid): (float(m), p0, s1 / m, s2 / m) for c, m, s1, s2 in cells},
                      buckets, params.em_rounds)
    if not n:
        weights[:] = [1.0, 0.0, 0.0]
    shared = spark.sparkContext.broadcast(weights)

    def rated(texts: bytes, c1: bytes, c2: bytes) -> pd.DataFrame:
        rows = _table(texts)
        ids, held_ = rows.column("id").to_pylist(), np.array(rows.column("held").to_pylist(), bool)
        lengths = rows.column("length").to_numpy()
        c1, c2 = _unzip(c1).astype(float), _unzip(c2).astype(float)
        ctx = _contexts(c1, lengths, starts)
        first = np.cumsum(lengths) - lengths
        total = np.add.reduceat(_mixed(*_estimates(c1, c2, ctx, n), p0, shared.value), first)
        without = total
        if not held_.all():
            own = np.repeat(np.where(held_, 0, 1), lengths)
            without = np.add.reduceat(_mixed(*_estimates(c1, c2, ctx, n, own), p0, shared.value), first)
        base = np.add.reduceat(np.log10((c1 + 1) / (n + (v + 1))), first)
        return pd.DataFrame({"id": pd.Series(ids, dtype=object if None in ids else None), "held_out": held_, "n_tokens": lengths,
                             "n_known": np.add.reduceat((c1 > 0).astype(np.int64), first), "train_tokens": n,
                             "base_score": base, "score": total, "deleted_score": without})

    def rate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield from map(rated, f.texts, f.c1, f.c2)

    out = counted.where("cell < 0").select("texts", "c1", "c2").mapInPandas(
        rate, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
              "deleted_score double")
    return out.withColumnRenamed("id", id_col)
