"""Exact vector search over an embeddings table (id, vector)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_VALUES = 4_000_000  # of a part's vectors, or a block's, 32 MB
LEAST_ROWS = 1_000  # of a part, where there are more cores than full parts
QUERY_STEP, ROW_STEP = 1_000, 4_000  # vectors multiplied at once
METRICS = ("cosine", "dot", "l2")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Score in double precision; null where the dimensions differ, or under
    cosine a vector has no length."""
    same = F.size(a) == F.size(b)
    if metric == "dot":
        score = dot(a, b)
    elif metric == "l2":
        score = F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))
    elif metric == "cosine":
        length = norm(a) * norm(b)
        score = F.when(length > 0, dot(a, b) / length)
    else:
        raise ValueError(f"metric must be one of {METRICS}")
    return F.when(same, score)


def admission(vector: Column, dimension: int, metric: str = "cosine") -> Column:
    """'ok', or why a vector cannot be indexed."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    zero = (norm(vector) == 0) if metric == "cosine" else F.lit(False)
    return (
        F.when(vector.isNull() | (F.size(vector) != dimension), "wrong_dimension").when(~finite, "non_finite").when(zero, "zero_norm").otherwise("ok")
    )


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def _checked(query: list[float], k: int, metric: str) -> None:
    if not 1 <= k <= 1024:
        raise ValueError("k must be 1 to 1024")
    if any(x != x or abs(x) == float("inf") for x in query):
        raise ValueError("the query has a value that is not finite")
    if metric == "cosine" and not any(query):
        raise ValueError("the query has no length")


def nearest(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """(id, score): the k best, ties by id; constraints apply before the k are
    taken. Spark keeps k rows per task, so nothing is sorted whole."""
    _checked(query, k, metric)
    found = vectors if where is None else vectors.where(where)
    scored = found.select("id", similarity(F.col("vector"), literal(query), metric).alias("score")).where("score is not null and not isnan(score)")
    return scored.orderBy(F.col("score").asc() if metric == "l2" else F.col("score").desc(), "id").limit(k)


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", block: int = 10_000) -> DataFrame:
    """(query_id, id, score, rank) for a stated set of query vectors (query_id,
    query). Rows and queries are dealt to parts and blocks of a bounded size, and
    each part meets each block in one group, which keeps k rows a query: a matrix
    product finds who can be among them, the score itself is that of
    :func:`similarity`. All pairs are compared, so time grows with their number."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    rows = vectors.where(F.forall("vector", lambda x: x.isNotNull())).select("id", "vector", F.size("vector").alias("dimension"))
    asked = queries.where(F.forall("query", lambda x: x.isNotNull())).select("query_id", "query", F.size("query").alias("dimension"))
    n, values = rows.agg(F.count("*"), F.sum("dimension")).first()
    n_asked, values_asked = asked.agg(F.count("*"), F.sum("dimension")).first()
    parts = max(1, -(-(values or 0) // BLOCK_VALUES), min(4 * vectors.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)))
    blocks = max(1, -(-n_asked // block), -(-(values_asked or 0) // BLOCK_VALUES))
    deal = lambda key, m: F.pmod(F.xxhash64(key), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    key = ["part", "block", "dimension"]
    left = rows.withColumn("part", deal("id", parts)).withColumn("block", every(blocks))
    right = asked.withColumn("block", deal("query_id", blocks)).withColumn("part", every(parts))
    left, right = (df.repartition(min(parts * blocks, 2_000), *key).groupBy(*key) for df in (left, right))
    kinds = [(f"{c} {df.schema[c].dataType.simpleString()}") for df, c in ((queries, "query_id"), (vectors, "id"))]
    scored = left.cogroup(right).applyInArrow(_group_best(k, metric), ", ".join([*kinds, "score double"]))
    best = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(best, "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _matrix(column: pa.ChunkedArray, dimension: int) -> np.ndarray:
    values = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return values.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dimension)


def _first_copies(matrix: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Which rows to look at: of equal vectors the k that come first by ``order``,
    since equal vectors score alike."""
    if not matrix.shape[1]:
        return np.argsort(order)[:k]
    same = np.unique(np.ascontiguousarray(matrix).view(f"V{matrix.shape[1] * 8}").ravel(), return_inverse=True)[1]
    by = np.lexsort((order, same))
    return by[_place(same[by]) < k]


def _place(groups: np.ndarray) -> np.ndarray:
    """The place of each row in its group, from 0; groups stand together."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.array([], int)
    return np.arange(len(groups)) - np.repeat(starts, np.diff(np.r_[starts, len(groups)]))


def _group_best(k: int, metric: str):
    def total(products) -> np.ndarray:  # one after another, as F.aggregate adds them
        out = 0.0
        for x in products:
            out = out + x
        return out

    def score(v: np.ndarray, q: np.ndarray, v_norm: np.ndarray, q_norm: np.ndarray) -> np.ndarray:
        zero = np.zeros(v.shape[1])
        if metric == "l2":
            return np.sqrt(total([zero, *((a - b) * (a - b) for a, b in zip(v, q))]))
        dots, length = total([zero, *(a * b for a, b in zip(v, q))]), v_norm * q_norm
        return dots if metric == "dot" else np.where(length == 0, np.nan, dots / length)

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        empty = not rows.num_rows or not asked.num_rows
        dimension = 0 if empty else rows["dimension"][0].as_py()
        take_v, take_q, scores = [np.array([], int)], [np.array([], int)], [np.array([])]
        with np.errstate(all="ignore"):
            if not empty:
                V, Q = _matrix(rows["vector"], dimension), _matrix(asked["query"], dimension)
                order = np.unique(rows["id"].to_numpy(), return_inverse=True)[1]
                kept = _first_copies(V, order, k)
                V, order = V[kept], order[kept]
                v_norm, q_norm = (np.sqrt(total([np.zeros(len(m)), *(x * x for x in m.T)])) for m in (V, Q))
                unit = (V / v_norm[:, None], Q / q_norm[:, None]) if metric == "cosine" else (V, Q)
                for lo in range(0, len(Q), QUERY_STEP):
                    found = best_of(V, Q, order, v_norm, q_norm, unit, lo)
                    for into, x in zip((take_v, take_q, scores), found):
                        into.append(x)
                take_v = [kept[np.concatenate(take_v)]]
        at_v, at_q = np.concatenate(take_v), np.concatenate(take_q)
        return pa.table({"query_id": asked["query_id"].take(at_q), "id": rows["id"].take(at_v), "score": np.concatenate(scores)})

    def best_of(V, Q, order, v_norm, q_norm, unit, lo) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, query, score) of the k best of each query from ``lo`` on."""
        hi = min(lo + QUERY_STEP, len(Q))
        bar = np.full(hi - lo, -np.inf)  # the k-th best so far; greater is better
        v, q, s = np.array([], int), np.array([], int), np.array([])
        for at in range(0, len(V), ROW_STEP):
            to = min(at + ROW_STEP, len(V))
            near = unit[1][lo:hi] @ unit[0][at:to].T
            if metric == "cosine":
                slack = np.full(hi - lo, 1e-9)
            elif metric == "dot":
                slack = 1e-9 * q_norm[lo:hi] * v_norm[at:to].max()
            else:
                near = 2 * near - v_norm[at:to] ** 2 - q_norm[lo:hi, None] ** 2
                slack = 1e-9 * (q_norm[lo:hi] ** 2 + (v_norm[at:to] ** 2).max())
            if to - at > k:
                low = np.partition(np.where(np.isnan(near), -np.inf, near), to - at - k, axis=1)[:, to - at - k] if at == 0 else bar
                can_q, can_v = np.nonzero(~(near < (np.maximum(low, bar) - slack)[:, None]))
            else:
                can_q, can_v = (x.ravel() for x in np.indices(near.shape))
            can_v, can_q = can_v + at, can_q + lo
            exact = score(V[can_v].T, Q[can_q].T, v_norm[can_v], q_norm[can_q])
            real = ~np.isnan(exact)
            v, q, s = np.r_[v, can_v[real]], np.r_[q, can_q[real]], np.r_[s, exact[real]]
            by = np.lexsort((order[v], s if metric == "l2" else -s, q))
            place = _place(q[by])
            by, place = by[place < k], place[place < k]
            v, q, s = v[by], q[by], s[by]
            full = place == k - 1
            bar[q[full] - lo] = -(s[full] ** 2) if metric == "l2" else s[full]
        return v, q, s

    return run


def passes(vector: Column, query: list[float], minimum: float, metric: str = "cosine") -> Column:
    """Semantic filter: has a vector of the query's size and a score that is good
    enough (at most, under l2)."""
    score = similarity(vector, literal(query), metric)
    return F.coalesce((score <= minimum) if metric == "l2" else (score >= minimum), F.lit(False))


def cost(vector: Column, query: list[float], metric: str = "cosine") -> Column:
    """Semantic step cost: 1 - cosine, or the distance; a dot product is no cost."""
    if metric == "dot":
        raise ValueError("a dot product is no cost")
    score = similarity(vector, literal(query), metric)
    return 1 - score if metric == "cosine" else score
