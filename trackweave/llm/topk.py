"""Exact top-k search by inner product: norm-bucketed retrieval.

Vectors are grouped by length: candidates are range-partitioned by norm and cut into buckets of similar norm, queries into
blocks likewise. The longest candidates, a bounded number, give each query a first lower bound of its k-th best score. A bucket can hold a
better one only if bound / (norm of the query * longest norm in the bucket), the local cosine threshold, is at most 1; blocks
whose queries all rule a bucket out never meet it. A task raises its queries' bounds as scores come in; pairs of block and bucket pass it as a stream, as a sort would keep each pair's vectors. For the others, each query picks how it prunes by its local threshold: by
coordinate, if it is high (a unit vector of that cosine must lie in a narrow range on the query's largest coordinates; ranges are
found in sorted columns), or else by length (only candidates long enough). What is left is verified by exact products.

Components are floor(scale * x), so products are whole numbers: exact in doubles below 2**53, in Python integers beyond.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from trackweave.llm.common import settled, small_batches


@dataclass(frozen=True)
class SearchParams:
    """bucket, block: vectors in a bucket of candidates and a block of queries. seeds: longest candidates for the first bounds. cosine: local threshold from which coordinates prune; focus: how many."""

    k: int = 5
    scale: int = 256
    bucket: int = 2048
    block: int = 512
    seeds: int = 2048
    cosine: float = 0.85
    focus: int = 3


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, v (whole numbers as doubles), dim, norm. A vector that is null or holds a null or non-finite component is left out, as is a null id. Products beyond 64 bits are cut to its limits, as are components."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(~bad)
    v = v.select("vec_id", F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("double")).alias("v"))
    return v.withColumns({"dim": F.size("v"), "norm": F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))})


def packed(x: DataFrame, size: int) -> DataFrame:
    """Blocks of vectors near in norm: dim, least and greatest norm, ids and vectors packed. x is range-partitioned by (dim, norm)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def out(dim: int) -> Iterator[pa.RecordBatch]:
            ids, data, norms = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            for a in range(0, len(ids), size):
                part = np.argsort(-norms[a : a + size], kind="stable") + a
                yield pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([norms[part[-1]]]), pa.array([norms[part[0]]]), pa.array([ids[part].tobytes()], pa.binary()), pa.array([data[part].tobytes()], pa.binary())], ["dim", "low", "high", "ids", "data"])
        for b in batches:
            ids, norms, v = (b.column(c) for c in ("vec_id", "norm", "v"))
            lengths = pc.list_value_length(v).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                data = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                held.setdefault(int(dim), []).append((ids.to_numpy()[at], data, norms.to_numpy()[at]))
                if sum(len(x[0]) for x in held[int(dim)]) >= size:
                    yield from out(int(dim))
        for dim in list(held):
            yield from out(dim)
    return x.mapInArrow(run, "dim long, low double, high double, ids binary, data binary")


def unpacked(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(data, np.float64).reshape(len(i), dim)


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of whole numbers; bound: of their size."""
    if bound < 2**52:
        return a @ b.T
    return a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T


def kept(query: np.ndarray, norm: float, low_score: float, vectors: np.ndarray, norms: np.ndarray, columns: np.ndarray, order: np.ndarray, p: SearchParams) -> np.ndarray | slice:
    """Rows of a bucket (longest first) that may score low_score or more."""
    if low_score <= 0 or norm == 0:
        return slice(None)
    long_enough = int(np.searchsorted(-norms, -(low_score / norm) * (1 - 1e-9), "right"))
    local = low_score / (norm * norms[0]) if norms[0] else 2.0
    if local > 1 + 1e-9:
        return slice(0, 0)
    if local < p.cosine:
        return slice(0, long_enough)  # by length
    unit, rows = query / norm, None
    for f in np.argsort(-np.abs(unit))[: p.focus]:  # by coordinate
        q, t = unit[f], min(1.0, local)
        spread = np.sqrt(max(0.0, (1 - t * t) * (1 - q * q)))
        low, high = (q * t - spread if q * t - spread > -1 else -1.0), q * t + spread
        low = -1.0 if -q >= t else low
        high = 1.0 if q >= t else high
        a, b = np.searchsorted(columns[f], low - 1e-9, "left"), np.searchsorted(columns[f], high + 1e-9, "right")
        inside = order[f][a:b]
        rows = inside if rows is None else np.intersect1d(rows, inside, assume_unique=True)
    return np.sort(rows[rows < long_enough])


def best_of_bucket(qi: np.ndarray, q: np.ndarray, least: np.ndarray, ci: np.ndarray, c: np.ndarray, p: SearchParams) -> list[tuple[int, int, int]]:
    """(query, vector, score) of each query's k best in the bucket that score at least its bound, equal scores by smaller id."""
    norms, q_norms = np.sqrt((c * c).sum(1)), np.sqrt((q * q).sum(1))
    least = np.where(np.abs(least) >= 2.0**53, np.nextafter(least, -np.inf), least)  # rounded scores
    bound = float(norms.max(initial=0) * q_norms.max(initial=0))
    local = np.where(q_norms * norms.max(initial=0) > 0, least / np.maximum(q_norms * norms.max(initial=0), 1e-300), 0)
    narrow = (least > 0) & (local >= p.cosine)
    out: list[tuple[int, int, int]] = []
    if narrow.any():
        unit = c / np.maximum(norms, 1e-300)[:, None]
        order = np.argsort(unit, axis=0, kind="stable").T
        columns = np.take_along_axis(unit.T, order, 1)
        for r in np.flatnonzero(narrow):
            rows = kept(q[r], q_norms[r], least[r], c, norms, columns, order, p)
            s = products(q[r : r + 1], c[rows], bound)[0]
            out += _top(qi[r], s, ci[rows], least[r], p.k)
    wide = np.flatnonzero(~narrow)
    if len(wide):
        # by length: the block's queries share the longest prefix that any of them needs
        need = [kept(q[r], q_norms[r], least[r], c, norms, c, c, p) for r in wide]
        upto = max(len(c) if n.stop is None else n.stop for n in need)
        s = products(q[wide], c[:upto], bound)
        ok = (s >= least[wide, None]).astype(bool)
        for j in np.flatnonzero(ok.any(1)):
            at = np.flatnonzero(ok[j])
            out += _top(qi[wide[j]], s[j][at], ci[at], least[wide[j]], p.k)
    return out


def _top(query: int, scores: np.ndarray, ids: np.ndarray, least: float, k: int) -> list[tuple[int, int, int]]:
    ok = np.flatnonzero((scores >= least) & (ids != query))
    if len(ok) > k:
        s = scores[ok]
        ok = ok[s >= np.partition(s, len(s) - k)[len(s) - k]]
    found = sorted((-min(max(int(scores[j]), -(2**63)), 2**63 - 1), int(ids[j])) for j in ok)[:k]
    return [(int(query), i, -s) for s, i in found]


def longest(x: DataFrame, n: int) -> DataFrame:
    """The n longest vectors. Tasks send their n longest to one task, and it alone sends any to the driver; they are 64 at most, whatever the splits of x."""
    return settled(x.coalesce(64).orderBy(F.desc("norm"), "vec_id").limit(n))


def spread_of(n: int, parts: int, cores: int, p: SearchParams) -> int:
    """Groups that buckets of n vectors are dealt to: a few for each core, more only where one would have over 16 buckets. Each block of queries is copied to all of them, so they don't follow the shuffle's partitions."""
    buckets = -(-n // p.bucket)
    return max(1, min(parts, buckets, max(4 * cores, -(-buckets // 16))))


def search(vectors: DataFrame, every: int = 50, p: SearchParams = SearchParams()) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other vectors for each vector whose id is divisible by `every`.

    Vectors that are null or hold a null or a non-finite component take no part, nor do null ids; those of another length than the query's are no candidates. Rows of
    a repeated id are candidates each, and as queries one with the best of all; rows of the query's id are no candidates. Equal scores go to smaller ids; an empty table gives an empty result. Extra columns are ignored.
    """
    small_batches(vectors.sparkSession)
    x = settled(quantised(vectors, p.scale))
    seeds = [r.asDict() for r in longest(x, p.seeds).select("vec_id", "v").collect()]
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(s["v"]) for s in seeds}:
        own = [s for s in seeds if len(s["v"]) == dim]
        by_dim[dim] = np.array([s["vec_id"] for s in own], np.int64), np.array([s["v"] for s in own], np.float64).reshape(len(own), dim)
    shared = x.sparkSession.sparkContext.broadcast(by_dim)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least, need = [], []
            for dim, ids, data, low in zip(*(b.column(c).to_pylist() for c in ("dim", "ids", "data", "low")), strict=True):
                qi, q = unpacked(ids, data, dim)
                bound = np.full(len(qi), -np.inf)
                if dim in shared.value:
                    si, s = shared.value[dim]
                    scores = products(q, s, float(np.sqrt((q * q).sum(1).max(initial=0) * (s * s).sum(1).max(initial=0)))).astype(np.float64)
                    scores[qi[:, None] == si[None, :]] = -np.inf
                    if len(si) > p.k:
                        bound = np.partition(scores, len(si) - p.k, axis=1)[:, len(si) - p.k]
                norms = np.sqrt((q * q).sum(1))
                least.append(bound.tobytes())
                # the least norm of a bucket's longest vector that can matter to the block
                need.append(float(np.where(bound > 0, bound / np.maximum(norms, 1e-300), 0).min(initial=np.inf)) * (1 - 1e-9))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("dim", "ids", "data")), pa.array(least, pa.binary()), pa.array(need)], ["dim", "ids", "data", "least", "need"])

    parts = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, n_queries = x.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    full = lambda rows, size, most: max(1, min(most, -(-rows // size)))  # noqa: E731  partitions, none for less than a bucket or block
    buckets = packed(x.repartitionByRange(full(n, p.bucket, parts), "dim", F.desc("norm"), "vec_id").sortWithinPartitions("dim", F.desc("norm")), p.bucket)
    queries = packed(x.filter(F.col("vec_id") % every == 0).repartitionByRange(full(n_queries, p.block, max(1, parts // 4)), "dim", F.desc("norm"), "vec_id").sortWithinPartitions("dim", F.desc("norm")), p.block)
    queries = queries.mapInArrow(bounded, "dim long, ids binary, data binary, least binary, need double")
    # blocks meet buckets in groups: a bucket goes to one, each block of queries to all
    groups = spread_of(n, parts, x.sparkSession.sparkContext.defaultParallelism, p)
    spread = buckets.withColumn("_group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    q = queries.select(F.col("dim"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "least", "need", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"))
    pairs = q.join(spread, ["_group", "dim"]).filter("high >= need").select("dim", "q_ids", "q_data", "least", "high", "ids", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, np.ndarray] = {}  # by block of queries: the k best scores that this task has seen of each
        for b in batches:
            for i in range(b.num_rows):
                dim, q_ids, q_data, least, ids, data = (b.column(c)[i].as_py() for c in ("dim", "q_ids", "q_data", "least", "ids", "data"))
                qi, q = unpacked(q_ids, q_data, dim)
                seen = best.setdefault((dim, xxhash.xxh3_128_digest(q_ids + q_data)), np.full((len(qi), p.k), -np.inf))
                rows = best_of_bucket(qi, q, np.maximum(np.frombuffer(least), seen.min(1)), *unpacked(ids, data, dim), p)
                if rows and len(np.unique(qi)) == len(qi):
                    of = {x: r for r, x in enumerate(qi.tolist())}
                    for query, _, score in rows:
                        r = of[query]
                        seen[r, seen[r].argmin()] = max(seen[r].min(), score)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")


def search_sql(every: int, k: int, scale: int) -> str:
    return f"""
    with x as (select vec_id, list_transform(embedding, lambda c: floor({scale}::double * c::double)) v from embeddings where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
    s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint score from x q join x c on q.vec_id % {every} = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
    r as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int rank from s)
    select query_id, rank, vec_id, score from r where rank <= {k}"""
