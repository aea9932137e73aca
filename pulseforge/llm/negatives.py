"""Hard negatives by one-dimensional distance keys.

Vectors get one more component, so that all have the same length; a greater inner product with a query is then a
smaller distance from it. Each row belongs to its nearest pivot and is stored by (pivot, distance from the pivot). By
the triangle inequality a row whose key is far from the query's own distance to that pivot is far from the query. A
search scans the interval of keys around the query's own, and widens it until the bound of the remaining rows certifies
what has been found.

Rings of keys (of one pivot, between two quantiles of its distances) are cells. A cell is split into groups of bounded
size by hashed ids, and each group is scanned by itself; a query isn't sent to cells that its bound excludes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseforge.llm import common

#: Pivots, rings of a pivot, rows that the pivots are chosen from, rows of a group, and rows that a scan takes in at a time.
PIVOTS, RINGS, SAMPLE, GROUP, STEP = 16, 8, 4_096, 32_768, 512
#: Above this squared length sums of products may not be exact as doubles; nothing is pruned then, and scores are Python integers.
EXACT = 2.0**51
#: Share of the scale of all scores that bounds are widened by, for rounding.
SLACK = 1e-9


def whole_rows(df: DataFrame, id_col: str, label_col: str, vector_col: str, scale: float, moved: str | None, classes: int) -> DataFrame:
    """id, label, v of the rows that take part: floor(scale * x), labels moved on where `moved` says so; of rows of one id the one of the least label and vector."""
    x = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    v = F.transform(x, lambda c: c * F.lit(float(scale)))
    # floor of a double as a double; what a long can't hold has no fraction
    v = F.transform(v, lambda c: F.when(F.abs(c) < 2.0**62, F.floor(c).cast("double")).otherwise(c))
    label = F.col(label_col).cast("long")
    if moved:
        label = F.when(F.expr(moved), (label + 1) % classes).otherwise(label)
    rows = df.where(good).select(F.col(id_col).cast("long").alias("id"), label.alias("label"), v.alias("v"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


class Index:
    """Rows by (cell, part), each with its key, and what bounds need: pivots, the common length and the cells (at most PIVOTS * RINGS)."""

    def __init__(self, rows: DataFrame, pivots: int = PIVOTS, rings: int = RINGS, group: int = GROUP):
        rows = common.cut(rows, "vectors")
        size = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
        total, self.most, self.dim = rows.agg(F.count("*"), F.max(size), F.max(F.size("v"))).first()
        self.total, self.most, self.dim = total, float(self.most or 0.0), int(self.dim or 0)
        self.exact = self.most < EXACT
        self.pivots = self._pivots(rows, pivots) if self.exact and total else np.zeros((1, self.dim + 1))
        most, dim, exact, told = self.most, self.dim, self.exact, self.pivots

        def keyed(batches):
            import pyarrow as pa

            for b in batches:
                raw = matrix(b.column("v"), dim)
                pivot, dist = np.zeros(len(raw), np.int32), np.zeros(len(raw))
                if exact:
                    d = distances(raw, rest(raw, most), told)
                    pivot = d.argmin(1).astype(np.int32)
                    dist = d.min(1) if len(d) else dist
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot), pa.array(dist)], names=["id", "label", "v", "pivot", "dist"])

        keys = common.cut(rows.mapInArrow(keyed, "id long, label long, v array<double>, pivot int, dist double"), "keys")
        shares = [i / rings for i in range(1, rings)]
        cuts = keys.groupBy("pivot").agg(F.percentile_approx("dist", shares, 1000).alias("cuts")) if shares else keys.select("pivot", F.array().cast("array<double>").alias("cuts")).distinct()
        placed = keys.join(F.broadcast(cuts), "pivot")  # a row for each pivot
        ring = F.size(F.filter("cuts", lambda c: c < F.col("dist")))
        placed = placed.withColumn("cell", F.col("pivot") * rings + ring)
        self.cells = placed.groupBy("cell").agg(F.min("pivot").alias("pivot"), F.min("dist").alias("near"), F.max("dist").alias("far"), F.count("*").alias("n")).orderBy("cell").collect()  # at most pivots * rings
        self.parts, first = [], 0
        for c in self.cells:
            self.parts.append((c.cell, c.pivot, c.near, c.far, first, max(1, -(-c.n // group))))
            first += self.parts[-1][-1]
        self.groups = max(first, 1)
        sent = F.broadcast(rows.sparkSession.createDataFrame([(p[0], p[4], p[5]) for p in self.parts] or [(-1, 0, 1)], "cell int, first int, many int"))
        part = F.col("first") + F.pmod(F.xxhash64("id"), F.col("many")).cast("int")
        placed = placed.join(sent, "cell").withColumn("part", part).select("id", "label", "v", "pivot", "dist", "cell", "part")
        # stored by part, within it by (pivot, distance)
        self.rows = common.cut(placed.repartitionById(self.groups, F.col("part")).sortWithinPartitions("part", "pivot", "dist", "id"), "index")
        common.remove(rows, keys)

    def _pivots(self, rows: DataFrame, pivots: int) -> np.ndarray:
        """Pivots far from each other, from at most SAMPLE rows (those of the lowest hashed ids)."""
        found = rows.select("v", F.xxhash64("id", F.lit(13)).alias("o")).orderBy("o").limit(SAMPLE).collect()  # bounded by SAMPLE
        x = np.array([[*r.v, *[0.0] * (self.dim - len(r.v))] for r in found])
        x = np.column_stack([x, rest(x, self.most)])
        at = [int(np.abs(x - x.mean(0)).sum(1).argmin())]
        near = ((x - x[at[0]]) ** 2).sum(1)
        while len(at) < pivots and near.max() > 0:
            at.append(int(near.argmax()))
            near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
        centres = x[at]
        for _ in range(4):  # towards the middle of what belongs to them
            own = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.array([x[own == i].mean(0) if (own == i).any() else c for i, c in enumerate(centres)])
        return centres

    def remove(self) -> None:
        common.remove(self.rows)

    def visits(self, asked: DataFrame, home: bool = False) -> DataFrame:
        """asked (with v and least, the score below which nothing is wanted) once for each part that may hold what is wanted; `home`: only for the part of the nearest cell.

        Adds part and key, the query's distance from that part's pivot. A null `least` excludes nothing.
        """
        parts, told, most, dim, exact = self.parts, self.pivots, self.most, self.dim, self.exact
        names = asked.columns

        def run(batches):
            import pyarrow as pa

            pivot = np.array([p[1] for p in parts], int)
            near, far = (np.array([p[k] for p in parts], float) for k in (2, 3))
            for b in batches:
                raw = matrix(b.column(names.index("v")), dim)
                least = b.column(names.index("least")).to_numpy(zero_copy_only=False).astype(float)
                d = distances(raw, np.zeros(len(raw)), told)[:, pivot] if exact else np.zeros((len(raw), len(parts)))
                gap = np.maximum(0, np.maximum(near - d, d - far))
                best = upper(gap, (raw * raw).sum(1)[:, None], most) if exact else np.full(d.shape, np.inf)
                ids = b.column(0).to_numpy()
                if home:
                    at = gap.argmin(1) if len(parts) else np.zeros(0, int)
                    pairs = [(i, parts[c][4] + int(ids[i]) % parts[c][5], c) for i, c in enumerate(at.tolist())]
                else:
                    pairs = [(i, k, c) for i, c in zip(*(x.tolist() for x in np.nonzero(~(best < least[:, None]))), strict=True) for k in range(parts[c][4], parts[c][4] + parts[c][5])]
                for lo in range(0, len(pairs), 4096):
                    lot = pairs[lo : lo + 4096]
                    out = b.take(pa.array([p[0] for p in lot], pa.int64()))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array([p[1] for p in lot], pa.int32()), pa.array([float(d[p[0], p[2]]) for p in lot], pa.float64())], names=[*names, "part", "key"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
        return asked.mapInArrow(run, f"{kinds}, part int, key double")

    def scan(self, visits: DataFrame, search, extra: dict[str, str], out: str) -> DataFrame:
        """Runs search(query, part) for each visit, in the task that holds the part; yields rows of the schema `out`.

        extra: the visits' columns beside id, label, v, part and key, by their types.
        """
        blank = {n: F.lit(None).cast(k) for n, k in extra.items()}
        held = self.rows.select("part", F.lit(0).alias("kind"), F.col("dist").alias("key"), "id", "label", "v", *(c.alias(n) for n, c in blank.items()))
        asked = visits.select("part", F.lit(1).alias("kind"), "key", "id", "label", "v", *extra)
        most, dim, exact, names = self.most, self.dim, self.exact, [c.split()[0] for c in out.split(", ")]

        def run(batches):
            import pyarrow as pa

            rows, part, at = [], None, None
            found: list[tuple] = []

            def answers():
                columns = list(zip(*found, strict=True)) or [()] * len(names)
                if any(isinstance(x, int) and x >> 63 not in (0, -1) for c in columns for x in c):
                    raise OverflowError("a score among the best doesn't fit a long")
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

            for b in batches:
                parts, kinds = (b.column(k).to_numpy() for k in (0, 1))
                edges = np.flatnonzero(np.diff(parts * 2 + kinds)) + 1
                for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(parts)], strict=True):
                    if hi == lo:
                        continue
                    piece = b.slice(lo, hi - lo)
                    if parts[lo] != at:
                        rows, part, at = [], None, parts[lo]
                    keys, ids, labels = (piece.column(k).to_numpy() for k in (2, 3, 4))
                    v = matrix(piece.column(5), dim)
                    if kinds[lo] == 0:
                        rows.append((keys, ids, labels, v))
                        continue
                    if part is None:
                        part = Part(rows, most, exact)
                    more = [piece.column(6 + k).to_pylist() for k in range(len(extra))]
                    for i in range(hi - lo):
                        query = (int(ids[i]), int(labels[i]), v[i], float(keys[i]), *(m[i] for m in more))
                        found.extend(search(query, part))
                        if len(found) >= 8192:
                            yield answers()
                            found = []
            yield answers()

        both = held.unionByName(asked).repartitionById(self.groups, F.col("part")).sortWithinPartitions("part", "kind", "key", "id")
        return both.mapInArrow(common.lean(run), out)


def matrix(column, dim: int) -> np.ndarray:
    """A list column as a matrix of dim columns; shorter vectors are filled with zeros."""
    offsets = np.asarray(column.offsets)
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == dim).all():
        return values.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    at = offsets - offsets[0] if len(offsets) else offsets
    for i, n in enumerate(sizes.tolist()):
        out[i, :n] = values[at[i] : at[i] + n]
    return out


def rest(x: np.ndarray, most: float) -> np.ndarray:
    """The further component, with which all vectors have the squared length `most`."""
    return np.sqrt(np.maximum(most - (x * x).sum(1), 0))


def distances(x: np.ndarray, further: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    whole = np.column_stack([x, further])
    return np.sqrt(np.maximum((whole * whole).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * whole @ pivots.T, 0))


def upper(gap, own, most: float):
    """No row at a distance of gap or more has a greater score; own is the query's squared length."""
    return (own + most - np.maximum(gap * (1 - SLACK) - SLACK * np.sqrt(most + own), 0) ** 2) / 2 * (1 + SLACK) + 0.5


class Part:
    """One group's rows in the order of their keys, with scans that widen around a query's own key."""

    def __init__(self, rows: list[tuple], most: float, exact: bool):
        self.keys, self.ids, self.labels, self.v = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0)))
        self.most, self.exact, self.scanned = most, exact, 0

    def scores(self, q: np.ndarray, lo: int, hi: int) -> np.ndarray:
        self.scanned += hi - lo
        if self.exact:
            return (self.v[lo:hi] @ q).astype(np.int64)
        return np.array([sum(int(a) * int(b) for a, b in zip(r.tolist(), q.tolist(), strict=True)) for r in self.v[lo:hi]], object)

    def annuli(self, q: np.ndarray, key: float):
        """Yields (ids, labels, scores, bound): the next rows by key, nearest first, and a bound of all scores still to come."""
        n = len(self.keys)
        own = float(q @ q) if self.exact else 0.0
        at = int(np.searchsorted(self.keys, key))
        lo = hi = at
        while lo > 0 or hi < n:
            left = key - self.keys[lo - 1] if lo else np.inf
            right = self.keys[hi] - key if hi < n else np.inf
            a, b = (max(0, lo - STEP), lo) if left <= right else (hi, min(n, hi + STEP))
            lo, hi = min(lo, a), max(hi, b)
            gap = min(key - self.keys[lo - 1] if lo else np.inf, self.keys[hi] - key if hi < n else np.inf)
            bound = -np.inf if gap == np.inf else upper(max(gap, 0.0), own, self.most) if self.exact else np.inf
            yield self.ids[a:b], self.labels[a:b], self.scores(q, a, b), bound


def best(held: list[tuple], ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple]:
    """The k best (-score, id) of those held and the new ones."""
    if len(ids) > 4 * k and scores.dtype != object:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[scores >= floor], scores[scores >= floor]
    return sorted([*held, *((-int(s), int(i)) for s, i in zip(scores.tolist(), ids.tolist(), strict=True))])[:k]


def search_positives(query: tuple, part: Part, k: int):
    """(anchor, id, score) of the k best other rows of the same label in this part, not below the query's `least`."""
    anchor, label, q, key, least = query
    held: list[tuple] = []
    for ids, labels, scores, bound in part.annuli(q, key):
        good = (labels == label) & (ids != anchor)
        if least is not None:
            good &= scores >= least
        held = best(held, ids[good], scores[good], k)
        if (least is not None and bound < least) or (len(held) >= k and bound < -held[-1][0]):
            break
    return [(anchor, i, -s) for s, i in held]


def search_negatives(query: tuple, part: Part, k: int, low: int, high: int):
    """(anchor, positive, positive's score, id, score) of the k best rows of other labels within each positive's band in this part."""
    anchor, label, q, key, positives, scores_of = query
    bands = [(p, s, -(-low * s // 100), high * s // 100) for p, s in zip(positives, scores_of, strict=True)]
    held: list[list[tuple]] = [[] for _ in bands]
    todo = [i for i, b in enumerate(bands) if b[2] <= b[3]]
    for ids, labels, scores, bound in part.annuli(q, key):
        other = (labels != label) & (ids != anchor)
        ids, scores = ids[other], scores[other]
        for i in todo:
            inside = (scores >= bands[i][2]) & (scores <= bands[i][3])
            held[i] = best(held[i], ids[inside], scores[inside], k)
        todo = [i for i in todo if bound >= bands[i][2] and (len(held[i]) < k or bound >= -held[i][-1][0])]
        if not todo:
            break
    return [(anchor, b[0], b[1], i, -s) for b, h in zip(bands, held, strict=True) for s, i in h]


def first(df: DataFrame, by: list[str], score: str, id_col: str, k: int) -> DataFrame:
    """The k first rows of each `by`, by descending score and ascending id, with their rank."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), id_col))
    return df.withColumn("rank", place).where(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame, anchors: str = "id % 50 = 0", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", moved: str | None = None, classes: int = 10,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of each anchor's positives.

    Scores are inner products of floor(scale * x). An anchor's positives are its best other rows of the same label; a
    positive's negatives are the best rows of other labels whose score is at least low and at most high percent of the
    positive's; equal scores go to the smaller id. `anchors` is a condition on id, `moved` one on the table's columns
    where the label first becomes (label + 1) % classes. Rows with a null id, label or vector, or a null or non-finite
    component take no part. Of rows of one id one takes part, that of the least label and vector; shorter vectors
    count as if filled with zeros. A positive without negatives, an anchor without positives and an empty table give no
    rows. Scores are exact; one of the best that doesn't fit a long raises an OverflowError.

    Every group of rows answers by itself and is bounded in size; each anchor is sent to the groups that its bound
    doesn't exclude, first to one near it, whose positives give the bound.
    """
    index = Index(whole_rows(df, id_col, label_col, vector_col, scale, moved, classes))
    asked = index.rows.where(anchors).select("id", "label", "v", F.lit(None).cast("long").alias("least"))
    near = lambda query, part: search_positives(query, part, positives)
    told = "anchor_id long, id long, score long"
    kth = index.scan(index.visits(asked, home=True), near, {"least": "long"}, told)
    kth = kth.groupBy(F.col("anchor_id").alias("id")).agg(F.when(F.count("*") >= positives, F.min("score")).alias("least"))
    asked = asked.drop("least").join(kth, "id", "left").select("id", "label", "v", "least")
    found = index.scan(index.visits(asked), near, {"least": "long"}, told)
    found = common.cut(first(found, ["anchor_id"], "score", "id", positives), "positives")
    # at most `positives` each; one below zero has an empty band
    lists = found.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("p"), "score"))).alias("l"), F.min(F.when(F.col("score") >= 0, F.col("score"))).alias("s"))
    least = F.floor(F.col("s") * (low / 100.0 * (1 - SLACK))) - 1
    banded = asked.drop("least").join(lists.where("s is not null"), "id").select("id", "label", "v", least.alias("least"), F.col("l.p").alias("positives"), F.col("l.score").alias("scores"))
    bands = lambda query, part: search_negatives(query, part, negatives, low, high)
    hard = index.scan(index.visits(banded), bands, {"positives": "array<long>", "scores": "array<long>"}, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    out = first(hard, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 50, among all rows."""
    out = hard_negatives(common.table(spark, sf_dir, "embeddings"), moved="vec_id % 7 = 0")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256e0) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""
