"""Exact top-k search by inner product, block at a time.

The rows are dealt to groups by ranges of ids, and each group keeps its rows in blocks of consecutive ids: a forward index of the
components, and the greatest and least value of each component. A query's bound for a block is the sum over its
components of the greater of its products with the two; blocks are taken in descending order of their bounds, and a
query is done as soon as the next bound falls below its k-th score. Every group returns its k best for each query, and
the k best of these are the result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseforge.llm import common

#: Rows of a block, rows of a group, and queries that are scored together.
BLOCK, GROUP, QUERIES = 512, 65_536, 256
#: Groups that even a small table is split into, as far as each has SMALL rows.
SPREAD, SMALL = 12, 4_096


def search_group(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, stats: list | None = None):
    """The k best (query id, id, score) of each query among the group's rows, without the row of the query's own id; rows stand in the order of their ids.

    Scores are exact: products are added as doubles where all sums stay below 2**53, else as Python integers.
    """
    if not len(ids) or not len(query_ids):
        return
    dim = max(vectors.shape[1], queries.shape[1])
    vectors, queries = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (vectors, queries))
    most = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(dim, 1)
    if most >= 2.0**53:
        vectors, queries = (np.array([[int(v) for v in r] for r in x], dtype=object) for x in (vectors, queries))
    cuts = list(range(0, len(ids), BLOCK))
    blocks = [(ids[lo : lo + BLOCK], vectors[lo : lo + BLOCK]) for lo in cuts]
    top = np.array([v.max(0) for _, v in blocks])
    low = np.array([v.min(0) for _, v in blocks])
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    bounds = plus.dot(top.T) + minus.dot(low.T)
    order = np.argsort(-bounds, axis=1, kind="stable")
    n = len(query_ids)
    best: list[list[tuple]] = [[] for _ in range(n)]
    open_ = np.arange(n)
    for turn in range(len(blocks)):
        at = order[open_, turn]
        kth = np.array([best[q][-1][0] if len(best[q]) >= k else None for q in open_], dtype=object)
        keep = np.array([x is None or -bounds[q, b] <= x for q, b, x in zip(open_, at, kth, strict=True)], bool)
        open_, at = open_[keep], at[keep]
        if not len(open_):
            break
        for b in np.unique(at).tolist():
            own, rows = blocks[b]
            asked = open_[at == b]
            scores = queries[asked].dot(rows.T)
            if stats is not None:
                stats.append(len(asked))
            for q, s in zip(asked.tolist(), scores, strict=True):
                s = s.copy()
                same = own == query_ids[q]
                if len(s) > 2 * k and s.dtype != object:
                    floor = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                    at_ = np.flatnonzero((s >= floor) & ~same)
                else:
                    at_ = np.flatnonzero(~same)
                found = sorted([*best[q], *((-int(x), int(i)) for x, i in zip(s[at_], own[at_], strict=True))])
                best[q] = found[:k]
    for q in range(n):
        for x, i in best[q]:
            yield int(query_ids[q]), i, -x


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best candidates of each query by integer inner product of floor(1024 * x): query_id, rank, id, score.

    A candidate never answers a query of its own id. Equal scores go to the smaller id. Rows whose vector is null, or
    holds null or non-finite components, or whose id is null, take no part; shorter vectors count as if filled with
    zeros; of rows of one id each stands for itself. Empty tables give no rows. Fewer than k candidates are all returned.
    Scores are exact, also beyond 2**53; one of the k best that doesn't fit a long raises an OverflowError.
    Queries are sent to every group of candidates in turn, which is the whole work of an exact search; neither side is
    broadcast.
    """

    def whole(df):
        x = F.col(vector_col).cast("array<double>")
        good = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        return df.where(good).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: v * 1024.0).alias("v"))

    rows = whole(candidates)
    total = candidates.count()
    ranges = common.by_range(rows, "id", max(-(-total // GROUP), min(SPREAD, -(-total // SMALL))))
    groups = ranges.parts
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    dealt = ranges(rows).select(F.col("bucket").alias("part"), F.lit(0).alias("kind"), "id", "v")
    asked = whole(queries).select(every.alias("part"), F.lit(1).alias("kind"), "id", "v")

    def run(batches):
        import pyarrow as pa

        ids, vectors, held_ids, held = [], [], [], []

        def matrix(rows):
            dim = max(map(len, rows), default=0)
            if all(len(r) == dim for r in rows):
                return np.floor(np.array(rows, dtype=float).reshape(len(rows), dim))
            return np.floor(np.array([[*r, *[0.0] * (dim - len(r))] for r in rows]))

        def answers():
            out = list(search_group(np.array(ids, np.int64), forward[0], np.array(held_ids, np.int64), matrix(held), k))
            q, i, s = zip(*out, strict=True) if out else ((), (), ())
            if any(x >> 63 not in (0, -1) for x in s):
                raise OverflowError("a score among the best doesn't fit a long")
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "id", "score"])

        forward = [None]
        for b in batches:
            for kind, i, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if kind == 0:
                    ids.append(i)
                    vectors.append(np.array(v, dtype=float))
                    continue
                if forward[0] is None:
                    forward[0] = matrix(vectors)
                    vectors.clear()
                held_ids.append(i)
                held.append(v)
                if len(held) >= QUERIES:
                    yield answers()
                    held_ids, held = [], []
        if held and ids:
            if forward[0] is None:
                forward[0] = matrix(vectors)
            yield answers()

    found = dealt.unionByName(asked).repartitionById(groups, F.col("part")).sortWithinPartitions("kind", "id").mapInArrow(run, "query_id long, id long, score long")
    # the k best of each partition are kept before the shuffle, so no query's answers of all groups meet at once
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op4_topk(spark, sf_dir: str) -> DataFrame:
    """The ten best of all rows for every row whose id is divisible by 100."""
    rows = common.table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 100 = 0")).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024e0) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
