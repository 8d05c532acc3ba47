"""Embedding near-duplicates: inverted lists, residual product quantisation, exact cosine rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import arrow_limits, hot_join, written
from facsimile.llm.components import connected_components

QUERIES = 256       # queries whose lookup tables are made at a time
PAIRS = 1 << 20     # (query, vector) pairs looked up at a time, about


@dataclass(frozen=True)
class PqParams:
    """``fit_rows`` bounds the sample that lists and codebooks are fitted on; every vector is indexed.

    Every length of vectors has lists and codebooks of its own, a list for about
    ``per_list`` of its vectors up to ``max_lists``.  Two linked vectors of different lists
    lie on either side of the plane between the centroids, so one of them is within half
    the link's length of it: with both sides searching, ``margin`` 0.5 misses no link
    whatever the vectors.  A smaller one searches less and may miss some.  Lists near each
    other form a region of about ``block`` bytes of vectors, which travel together.
    """

    fit_rows: int = 20_000
    per_list: int = 32
    max_lists: int = 4096
    subspaces: int = 8
    codes: int = 256
    rounds: int = 6
    margin: float = 0.5
    block: int = 4 << 20


@dataclass
class Index:
    """Lists and codebooks of the vectors of one length; ``first`` is the number of its first list and region among all."""

    coarse: np.ndarray      # lists x dims
    books: np.ndarray       # subspaces x codes x dims of a subspace
    region: np.ndarray      # of each list
    limit: float            # largest distance of unit vectors that are linked
    margin: float
    first: int = 0


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([(x[i:i + 4096] @ c.T - half).argmax(1) for i in range(0, len(x), 4096)] or [np.zeros(0, int)])


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    cent = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, cent)
        order = np.argsort(own, kind="stable")
        have, first = np.unique(own[order], return_index=True)
        total = np.add.reduceat(x[order], first, axis=0)
        cent[have] = total / np.diff(np.append(first, len(own)))[:, None]
    return cent.astype(float)


def fit(sample: np.ndarray, rows: int, min_cosine: float, params: PqParams) -> Index:
    """Lists and codebooks from a sample of unit vectors; ``rows`` is the number of all vectors."""
    dims = sample.shape[1]
    lists = int(np.clip(rows // params.per_list, 1, max(1, min(params.max_lists, len(sample) // 4))))
    coarse = _kmeans(sample, lists, params.rounds)
    rest = sample - coarse[_nearest(sample, coarse)]
    width = -(-dims // params.subspaces)
    rest = np.pad(rest, ((0, 0), (0, width * params.subspaces - dims)))
    books = np.stack([_kmeans(rest[:, m * width:(m + 1) * width], min(params.codes, len(rest)), params.rounds, m + 1)
                      for m in range(params.subspaces)])
    regions = int(np.clip(-(-rows * 8 * dims // params.block), 1, lists))
    region = _nearest(coarse, _kmeans(coarse, regions, params.rounds))
    limit = float(np.sqrt(max(0.0, 2 - 2 * min_cosine)))
    return Index(coarse, books, region, limit, params.margin * limit + 1e-9)


def probes(x: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own list of each vector, vector, list): the lists each vector must search, its own among them.

    To lie in another list's cell a neighbour has to cross the plane between the two
    centroids; a list is searched when that plane is within the index's margin.
    """
    c = index.coarse
    size = (c * c).sum(1)
    owns, rows, lists = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(x), 512):
        part = x[lo:lo + 512]
        d = size - 2 * part @ c.T
        own = d.argmin(1)
        between = np.sqrt(np.maximum(size[None] + size[own][:, None] - 2 * c[own] @ c.T, 1e-30))
        near = (d - d[np.arange(len(part)), own, None]) <= 2 * index.margin * between
        near[np.arange(len(part)), own] = True
        r, j = np.nonzero(near)
        owns.append(own)
        rows.append(r + lo)
        lists.append(j)
    return np.concatenate(owns), np.concatenate(rows), np.concatenate(lists)


def encode(x: np.ndarray, own: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, what they stand for, distance of each vector to that) of the residuals in the own lists."""
    m, _, width = index.books.shape
    rest = np.pad(x - index.coarse[own], ((0, 0), (0, m * width - x.shape[1])))
    codes = np.stack([_nearest(rest[:, j * width:(j + 1) * width], index.books[j]) for j in range(m)], 1)
    back = np.concatenate([index.books[j][codes[:, j]] for j in range(m)], 1)[:, :x.shape[1]] + index.coarse[own]
    return codes, back, np.linalg.norm(x - back, axis=1)


def candidates(queries: np.ndarray, probe_row: np.ndarray, probe_list: np.ndarray, have: np.ndarray, home: np.ndarray,
               index: Index) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, vector) pairs whose table-lookup distance leaves a link possible, some queries at a time.

    A query meets the vectors of the lists it probes (``probe_row`` rises).  Its distance
    to what a vector's codes stand for is a sum over a table of the query, one entry a
    code, and a number of the vector; it differs from the distance to the vector by the
    vector's coding error at most, so no link is missed.
    """
    m, codes_n, width = index.books.shape
    order = np.argsort(home, kind="stable")
    codes, back, error = encode(have, home, index)
    lists = len(index.coarse)
    count = np.bincount(home, minlength=lists)
    first = np.cumsum(count) - count
    probe = count[probe_list] > 0
    probe_row, probe_list = probe_row[probe], probe_list[probe]
    place = (codes[order] + np.arange(m) * codes_n).astype(np.int32)
    half = (0.5 * (back * back).sum(1))[order].astype(np.float32)
    # |q - b|^2 <= (limit + error)^2 + slack with |q| = 1, as a least q . b
    least = (0.5 + half - 0.5 * ((index.limit + error[order]) ** 2 + 1e-4)).astype(np.float32)
    centre = index.coarse.astype(np.float32)
    books = index.books.astype(np.float32)
    load = np.cumsum(np.bincount(probe_row, count[probe_list], len(queries)))
    lo = 0
    while lo < len(queries):
        hi = int(min(lo + QUERIES, max(lo + 1, np.searchsorted(load, (load[lo - 1] if lo else 0) + PAIRS))))
        q = np.pad(queries[lo:hi].astype(np.float32), ((0, 0), (0, m * width - queries.shape[1])))
        table = np.einsum("qmw,mkw->qmk", q.reshape(len(q), m, width), books, optimize=True).reshape(len(q), -1)
        a, b = np.searchsorted(probe_row, [lo, hi])
        r, j = probe_row[a:b] - lo, probe_list[a:b]
        near = (q[:, :queries.shape[1]] @ centre.T)[r, j]
        n = count[j]
        end = np.cumsum(n)
        row = np.repeat(r, n)
        at = np.repeat(first[j] - end + n, n) + np.arange(end[-1] if len(end) else 0)
        dot = np.repeat(near, n)
        flat, base = table.ravel(), row * table.shape[1]
        for k in range(m):
            dot += flat[base + place[at, k]]
        fits = np.flatnonzero(dot >= least[at])
        yield row[fits] + lo, order[at[fits]]
        lo = hi


def _unit(raw: list[bytes], dims: int) -> np.ndarray:
    x = np.stack([np.frombuffer(r, "<f8" if len(r) == 8 * dims else "<f4") for r in raw]).astype(float)
    x /= np.abs(x).max(1, keepdims=True)        # the length of a very long or short vector stays finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give nodes of ``label`` (each its set's least node) that pairs connect one label, in place."""
    while True:
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        if (low == high).all():
            return
        np.minimum.at(label, high, low)
        while (nxt := label[label]).tobytes() != label.tobytes():
            label[:] = nxt


def _search(table: pa.Table, index: Index, dims: int, min_cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, links, other class) of one block: links of either side, and pairs that connect what is linked."""
    none = (np.zeros(0, np.int64),) * 3
    role = table.column("role").to_numpy()
    have, ask = table.filter(pa.array(role == 0)), table.filter(pa.array(role == 1))
    if not len(have) or not len(ask):
        return none
    vx, qx = _unit(have.column("vec").to_pylist(), dims), _unit(ask.column("vec").to_pylist(), dims)
    vid, vn, qid, qn = (t.column(c).to_numpy() for t in (have, ask) for c in ("cid", "n"))
    lists = [np.frombuffer(p, "<u2" if len(index.coarse) < 1 << 16 else "<u4") for p in ask.column("lists").to_pylist()]
    back = [np.frombuffer(p, "<u2" if len(index.coarse) < 1 << 16 else "<u4") for p in have.column("lists").to_pylist()]
    vhome, qhome = (np.array([p[0] for p in x], np.int64) for x in (back, lists))     # the own list comes first
    probe_row = np.repeat(np.arange(len(lists)), [len(p) for p in lists])
    size = len(index.coarse)
    searched = np.sort(np.repeat(np.arange(len(back)), [len(p) for p in back]) * size + np.concatenate(back))
    node, at = np.unique(np.concatenate([vid, qid]), return_inverse=True)
    vat, qat = at[:len(vid)], at[len(vid):]
    label, links = np.arange(len(node)), np.zeros(len(node), np.int64)
    for q, v in candidates(qx, probe_row, np.concatenate(lists).astype(np.int64), vx, vhome, index):
        near = np.einsum("ij,ij->i", qx[q], vx[v]) >= min_cosine
        near &= vid[v] != qid[q]
        q, v = q[near], v[near]
        if not len(q):
            continue
        np.add.at(links, qat[q], vn[v])
        key = v * size + qhome[q]
        known = searched[np.minimum(np.searchsorted(searched, key), len(searched) - 1)] == key
        np.add.at(links, vat[v[~known]], qn[q[~known]])     # v does not search q's list: its side counts here
        _joined(label, qat[q], vat[v])
    some, tied = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(node)))
    return (np.concatenate([node[some], node[tied]]), np.concatenate([links[some], np.zeros(len(tied), np.int64)]),
            np.concatenate([np.full(len(some), -1), node[label[tied]]]))


def near_duplicates(vectors: DataFrame, min_cosine: float = 0.95, params: PqParams = PqParams(), id_col: str = "vec_id",
                    vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every vector, by cosine in double precision.

    Equal vectors form one class before any candidate is made; a class counts with its
    size.  Vectors link with vectors of their own length; each length is indexed by
    itself, so the driver reads the classes once a length.  Vectors that are null or
    zero, or hold null or non-finite components, link with nothing, themselves' copies
    included.  A link found from either side counts for both, once.  ``component_id`` is
    the smallest id reachable, the vector itself included.  Rows are told apart by their
    vectors, not by their ids: rows with one id link with each other like any others.  A
    null id is larger than any other; ``kept`` is true where the id is the component's.
    """
    spark = vectors.sparkSession
    arrow_limits(spark)
    v = F.col(f"`{vec_col}`").cast("array<double>")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # 128 bits of hash stand for a vector
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("vec"), F.coalesce(sound, F.lit(False)).alias("sound"),
                          F.xxhash64(v).alias("k1"), F.xxhash64(F.lit(1), v).alias("k2"))
    grouped = rows.where("sound").groupBy("k1", "k2").agg(F.first("vec").alias("vec"), F.min("id").alias("least"), F.count("*").alias("n"))
    classes = written(grouped.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    indexes: dict[int, Index] = {}
    first = 0
    for d, total in sorted(classes.groupBy(F.size("vec")).count().where("count > 1").collect()):    # one row a length
        sample = classes.where(F.size("vec") == d).orderBy(F.xxhash64("k1"), "k1").limit(params.fit_rows).select("vec").collect()
        x = np.array([r[0] for r in sample], float)
        x /= np.abs(x).max(1, keepdims=True)
        indexes[d] = fit(x / np.linalg.norm(x, axis=1, keepdims=True), total, min_cosine, params)
        indexes[d].first = first
        first += len(indexes[d].coarse)
    shared = spark.sparkContext.broadcast(indexes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.list_value_length(b.column(0)).to_numpy()
            for d in np.unique(size).tolist():
                if d in shared.value:
                    yield deal_length(b.filter(pa.array(size == d)), d)

    def deal_length(b: pa.RecordBatch, d: int) -> pa.RecordBatch:
        index = shared.value[d]
        vec = b.column(0).flatten().to_numpy().reshape(-1, d)
        small = vec.astype("<f4")
        raw = [x.tobytes() for x in (small if (small == vec).all() else vec.astype("<f8"))]
        unit = vec / np.abs(vec).max(1, keepdims=True)
        own, row, lists = probes(unit / np.linalg.norm(unit, axis=1, keepdims=True), index)
        kind = "<u2" if len(index.coarse) < 1 << 16 else "<u4"
        cut = np.searchsorted(row, np.arange(len(vec) + 1))
        names = [np.concatenate([[o], lists[lo:hi][lists[lo:hi] != o]]).astype(kind).tobytes()
                 for o, lo, hi in zip(own.tolist(), cut[:-1].tolist(), cut[1:].tolist())]
        asked = np.unique(row * len(index.coarse) + index.region[lists])
        who = np.concatenate([np.arange(len(vec)), asked // len(index.coarse)])
        where = np.concatenate([index.region[own], asked % len(index.coarse)]) + index.first
        role = (np.arange(len(who)) >= len(vec)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(where, pa.int64()), pa.array(np.full(len(who), d, np.int32)), pa.array(role), b.column(1).take(pa.array(who)),
             b.column(2).take(pa.array(who)), pa.array([raw[i] for i in who], pa.binary()), pa.array([names[i] for i in who], pa.binary())],
            names=["region", "dims", "role", "cid", "n", "vec", "lists"])

    dealt = written(classes.select("vec", "cid", "n").mapInArrow(
        deal, "region long, dims int, role int, cid long, n long, vec binary, lists binary"), "regions")
    # a region is dealt in blocks: every block of its vectors meets every block of its queries
    per_block = F.greatest(F.lit(256), F.floor(F.lit(params.block) / (F.col("dims") * 8)))
    size = dealt.groupBy("region", "dims").agg(F.count(F.when(F.col("role") == 0, 1)).alias("vs"), F.count(F.when(F.col("role") == 1, 1)).alias("qs"))
    size = size.select("region", *(F.greatest(F.lit(1), F.ceil(F.col(c) / per_block)).cast("int").alias(k) for c, k in (("vs", "vb"), ("qs", "qb"))))
    # a row a region: no more than max_lists for each length
    placed = dealt.join(F.broadcast(size), "region")
    mine = F.pmod(F.xxhash64("cid"), F.when(F.col("role") == 0, F.col("vb")).otherwise(F.col("qb"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("role") == 0, F.col("qb")).otherwise(F.col("vb")) - 1))
    blocks = (placed.withColumn("mine", mine).withColumn("other", other)
              .withColumn("vblock", F.when(F.col("role") == 0, F.col("mine")).otherwise(F.col("other")))
              .withColumn("qblock", F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("mine"))))

    def search(table):
        d = table.column("dims")[0].as_py()
        cid, links, joined = _search(table, shared.value[d], d, min_cosine)
        return pa.table({"cid": pa.array(cid, pa.int64()), "links": pa.array(links, pa.int64()), "other": pa.array(joined, pa.int64())})

    found = written(blocks.select("region", "vblock", "qblock", "dims", "role", "cid", "n", "vec", "lists")
                    .groupBy("region", "vblock", "qblock").applyInArrow(search, "cid long, links long, other long"), "links")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comp = connected_components(found.where("other >= 0").select("cid", "other"))
    tree = written(classes.select("cid", "k1", "k2", "least", "n").join(counts, "cid", "left")
                   .join(comp, F.col("cid") == comp["node"], "left")
                   .select("k1", "k2", "n", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                           F.coalesce("component", "cid").alias("root")), "classes")
    least = tree.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    named = written(hot_join(tree, written(least, "roots"), ["root"], "size").select("k1", "k2", "n", "n_links", "component_id"), "named")
    kinds = [F.col("id").alias(id_col), "n_links", "component_id",
             F.coalesce(F.col("id").eqNullSafe(F.col("component_id")), F.lit(False)).alias("kept")]
    linked = hot_join(rows.where("sound").select("id", "k1", "k2"), named, ["k1", "k2"], "n").select(*kinds)
    alone = rows.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")).select(*kinds)
    return linked.unionByName(alone)
