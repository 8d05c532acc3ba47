"""Line dedup, whitening and vector codes against brute force, and their edge cases."""

import hashlib
import math
import re

import numpy as np
import pytest

from facsimile.llm import line_dedup as L
from facsimile.llm import vector_codes as V
from facsimile.llm import whitening as W

BAD = [None, [1.0, None] * 4, [float("nan")] * 8, [float("inf")] + [0.0] * 7]


def brute_lines(rows, min_docs=5, min_chars=40):
    """[(id, n_lines, n_dropped, text)] by the contract, a row a document."""
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    none = -(1 << 63)
    holders = {}
    for k, (i, t) in enumerate(rows):
        for key in {low(x) for x in (t or "").split("\n")}:
            holders.setdefault(key, []).append(none if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        own = none if i is None else i
        kept = [x for x in lines if len(low(x)) < min_chars or len(holders[low(x)]) < min_docs or max(holders[low(x)]) == own]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_rows():
    rng = np.random.default_rng(0)
    common = [f"line number {k} that very many documents of the set repeat" for k in range(30)]
    common += ["é" * 39, "é" * 40, "x" * 39, "x" * 40, "　" + "y" * 40, "y" * 40]
    rows = []
    for i in range(120):
        lines = [str(rng.choice(common)) for _ in range(int(rng.integers(0, 12)))]
        lines = [" \t" + x.upper() + "\r" if rng.random() < 0.3 else x for x in lines]
        lines += [f"only document {i} says this one, and nobody else does", "short"]
        rows.append((int(rng.integers(0, 60)) if i % 9 else None, "\n".join(rng.permutation(lines))))
    return rows + [(7, None), (8, ""), (9, "\n\n"), (10, rows[3][1]), (10, rows[3][1]), (11, "\n".join(common * 200)), (None, None)]


def test_line_dedup_by_brute_force(spark, monkeypatch):
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, "a", 3) for i, t in rows], "doc_id long, text string, n_lines string, shard int")
    want = sorted(brute_lines(rows), key=repr)
    assert sum(r[2] for r in want) > 100
    assert sorted((tuple(r) for r in L.dedup_lines(docs).collect()), key=repr) == want
    # many shards, and hot ones dealt over several tasks
    for name, value in (("SHARD_KEYS", 8), ("BLOCK", 16), ("PARTS", 64), ("SEEN", 20)):
        monkeypatch.setattr(L, name, value)
    assert sorted((tuple(r) for r in L.dedup_lines(docs).collect()), key=repr) == want
    assert L.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_names_and_limits(spark):
    docs = spark.createDataFrame([(k, "A line\nb") for k in range(3)], "key int, body string")
    got = sorted(tuple(r) for r in L.dedup_lines(docs, 3, 6, "key", "body").collect())
    assert got == [(0, 2, 1, "b"), (1, 2, 1, "b"), (2, 2, 0, "A line\nb")]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, 1 << 63, (2, n)).astype("<u8")
    mph = L.PerfectHash.of(a, b)
    assert sorted(mph.number(a, b).tolist()) == list(range(n))
    assert sum(len(x) for x in mph.levels) <= 5 * n + 64
    count, last = rng.integers(1, 1 << 20, n), rng.integers(-9, 9, n)
    shard = L.Shard(L.pack_shard(a, b, count, last))
    got = shard.probe(a, b)
    assert (got[0] == count).all() and (got[1] == last).all()
    other = rng.integers(0, 1 << 63, (2, 500)).astype("<u8")
    assert shard.probe(*other)[0].sum() == 0        # not a line of the shard: the fingerprint differs
    with pytest.raises(ValueError):
        L.PerfectHash.of(np.array([5, 5], "<u8"), np.array([6, 6], "<u8"))


def walsh_rows(size):
    """Rows of the Walsh matrix by their sign changes, from the definition of Hadamard's."""
    h = np.array([[1]])
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(1))]


@pytest.mark.parametrize("width", [0, 1, 2, 3, 8, 16, 21])
def test_walsh_and_nearest(width):
    rng = np.random.default_rng(width)
    x, c = rng.integers(-40, 40, (600, width)), rng.integers(-40, 40, (70, width))
    c[60:] = c[:10]     # equal entries: the lower index wins
    x[:20] = c[50:70]
    size = 1 << max(0, width - 1).bit_length()
    assert (V.walsh(x) == np.pad(x, ((0, 0), (0, size - width))) @ walsh_rows(size).T).all()
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    for kind in (np.int64, object):
        index, error = V.nearest(x.astype(kind), c.astype(kind))
        assert (index == d.argmin(1)).all() and (error == d.min(1)).all()
    # smooth rows: most entries go early, the pairs left go on alone
    x, c = np.cumsum(x, 1) * 30, np.cumsum(c, 1) * 30
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    index, error = V.nearest(x, c)
    assert (index == d.argmin(1)).all() and (error == d.min(1)).all()


def brute_codes(rows, parts=4, codes=256, rounds=4):
    """{id: (code, error)} and the digest, in Python integers; ids without repeats."""
    kept = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[int(v) * 1024 if abs(v) >= 1 << 52 else math.floor(v * 1024) for v in vec] for _, vec, _ in kept]
    width = -(-len(x[0]) // parts)
    x = [v + [0] * (width * parts - len(v)) for v in x]
    books = [[v[j * width:(j + 1) * width] for v in x[:codes]] for j in range(parts)]

    def assign(j):
        out = []
        for v in x:
            d = [sum((a - b) ** 2 for a, b in zip(v[j * width:(j + 1) * width], e)) for e in books[j]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        for j in range(parts):
            own = assign(j)
            for k in range(len(books[j])):
                mine = [v[j * width:(j + 1) * width] for v, (i, _) in zip(x, own) if i == k]
                if mine:
                    books[j][k] = [sum(col) // len(mine) for col in zip(*mine)]
    got = [assign(j) for j in range(parts)]
    error = [sum(g[i][1] for g in got) for i in range(len(x))]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [(i, "".join(f"{g[k][0]:02x}" for g in got), error[k], label) for k, (i, _, label) in enumerate(kept)], digest


@pytest.mark.parametrize("dims, scale", [(8, 1.0), (10, 1.0), (8, 1e12)])
def test_vector_codes_by_brute_force(spark, dims, scale):
    rng = np.random.default_rng(dims)
    rows = [(i, (scale * rng.normal(size=dims)).tolist(), None if i % 7 == 0 else i % 3) for i in range(300)]
    rows += [(1000 + i, rows[i][1], 2) for i in range(20)] + [(None, [0.0] * dims, 1)]
    want, digest = brute_codes(rows)
    by = {}
    for _, _, e, label in want:
        by[label] = by.get(label, 0) + e
    bad = [(2000 + k, v, 1) for k, v in enumerate(BAD)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, embedding array<double>, label int, code string")
    got = sorted((tuple(r) for r in V.quantise(df).collect()), key=repr)
    long = lambda e: e if e < 1 << 63 else None
    sums = {k: long(sum(e for _, _, e, own in want if own == k)) for k in by}
    if scale > 1:
        assert any(e >= 1 << 63 for _, _, e, _ in want)
        got = [r[:3] + r[4:] for r in got]      # a sum that no long holds depends on which errors are null
        assert got == sorted(((i, c, long(e), digest) for i, c, e, _ in want), key=repr)
    else:
        assert got == sorted(((i, c, e, sums[label], digest) for i, c, e, label in want), key=repr)


def test_vector_codes_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert V.quantise(empty).count() == 0
    few = spark.createDataFrame([(3, [1.0, 2.0], "a"), (3, [1.0, 2.0], "a"), (1, [0.5], "b"), (2, [], None), (4, None, "a")],
                                "vec_id long, embedding array<float>, label string")
    got = sorted(tuple(r)[:4] for r in V.quantise(few).collect())       # a length has codebooks of its own
    assert got == [(1, "00000000", 0, 0), (2, "00000000", 0, 0), (3, "00000000", 0, 0), (3, "00000000", 0, 0)]


def solved(a, k):
    return W.directions(np.linalg.qr(a, "r"), len(a), (0,) * a.shape[1], k)


def matrices():
    rng = np.random.default_rng(0)
    for d in (1, 2, 3, 7, 64, 130):
        yield rng.standard_normal((400, d))
    yield rng.standard_normal((400, 40)) * np.logspace(0, -6, 40)
    yield rng.standard_normal((400, 40)) * np.logspace(-6, 0, 40)
    yield rng.standard_normal((400, 3)) @ rng.standard_normal((3, 40))     # low rank
    yield np.linalg.qr(rng.standard_normal((400, 40)))[0]                  # all values equal
    yield rng.standard_normal((5, 40))                                     # fewer rows than columns
    yield np.concatenate([np.eye(40)] * 3)
    yield np.zeros((9, 6))
    half = rng.standard_normal((400, 20))
    yield np.concatenate([half, half], 1)
    yield 12 * np.eye(21) + np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)   # pairs of close values


@pytest.mark.parametrize("a", matrices(), ids=lambda a: "x".join(map(str, a.shape)))
def test_qd_solver(a):
    n, k = len(a), min(32, a.shape[1])
    m = solved(a, k)
    want = np.zeros(a.shape[1])
    s = np.linalg.svd(a, compute_uv=False) ** 2 / n
    want[:len(s)] = s
    top = max(want[0], 1e-300)
    assert np.allclose(m.values, want[:k], rtol=1e-9, atol=1e-14 * top)
    assert np.abs(m.vectors.T @ m.vectors - np.eye(k)).max() < 1e-12
    assert np.abs(a.T @ (a @ m.vectors) / n - m.vectors * m.values).max() <= 1e-13 * top * max(1, a.shape[1])
    assert m.trace == pytest.approx(want.sum(), rel=1e-12, abs=1e-300)


def test_qd_solver_has_high_relative_accuracy():
    """Values of a graded bidiagonal matrix, down to the smallest, against exact arithmetic on its determinant."""
    diag, upper = np.array([1.0, 1e-5, 1e-10, 1e-15]), np.array([1e-3, 1e-8, 1e-13])
    got = W.squared_singular_values(diag, upper)
    assert np.prod(np.sqrt(got)) == pytest.approx(np.prod(diag), rel=1e-12)
    assert (got > 0).all() and (np.diff(got) < 0).all()


def test_whitening_by_numpy(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12))).astype(np.float32)
    x = np.concatenate([x, x[:50]])
    rows = [(i, [float(v) for v in r], 1.0) for i, r in enumerate(x)] + [(None, [float(v) for v in x[0]], 1.0)]
    rows += [(5000 + k, v, 1.0) for k, v in enumerate(BAD)] + [(6000, [], 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened double").repartition(37)   # two rounds of folding
    models = W.fit(df, 5)
    got = W.whiten(df, models).toPandas()
    x = np.concatenate([x, x[:1]])
    z = np.floor(64 * x.astype(float)).astype(np.int64) + 1_000_000
    n, total = len(z), z.sum(0)
    c = (n * z - total) / n
    w, v = np.linalg.eigh(c.T @ c / n)
    w, v = w[::-1], v[:, ::-1]
    assert len(got) == 5 * n and set(got.component) == {1, 2, 3, 4, 5} and (got.n == n).all()
    white = c @ v[:, :5] / np.sqrt(w[:5])
    dev = ((n * z - total) ** 2).sum(1)
    sign = {}
    for r in got.itertuples():
        i = n - 1 if np.isnan(r.vec_id) else int(r.vec_id)
        k = r.component - 1
        assert r.deviation == dev[i] and r.explained == pytest.approx(w[k] / w.sum(), rel=1e-9)
        s = sign.setdefault(k, np.sign(r.whitened * white[i, k]))
        assert r.whitened == pytest.approx(s * white[i, k], abs=1e-9)
    assert got.identity_error.max() < 1e-10 and got.identity_error.nunique() == 1


def test_whitening_edges(spark):
    kind = "vec_id long, embedding array<double>"

    def whole(rows):
        df = spark.createDataFrame(rows, kind)
        return sorted(tuple(r) for r in W.whiten(df, W.fit(df, 3)).collect())

    assert whole([]) == []
    assert whole([(1, [2.0, 3.0])]) == [(1, 1, 1, 0, None, 0.0, 0.0), (1, 2, 1, 0, None, 0.0, 0.0)]
    got = whole([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [7.0]), (4, [7.0])])      # lengths stand apart
    assert [r[:4] for r in got] == [(1, 1, 2, 128 ** 2), (1, 2, 2, 128 ** 2), (2, 1, 2, 128 ** 2), (2, 2, 2, 128 ** 2), (3, 1, 2, 0), (4, 1, 2, 0)]
    assert abs(got[0][4]) == pytest.approx(1) and got[0][4] == -got[2][4] and got[1][4] is None and got[4][4] is None
    assert [r[5] for r in got] == [1.0, 0.0, 1.0, 0.0, 0.0, 0.0]
    huge = whole([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 1e-300])])       # deviations no long holds
    assert all(r[3] is None for r in huge[:4]) and all(math.isfinite(r[4]) for r in huge if r[4] is not None)
