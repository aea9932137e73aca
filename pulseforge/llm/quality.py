"""Quality by a naive Bayes support vector machine over n-grams of words and of word shapes.

Log-count ratios of the hashed n-grams come from all labelled rows, counted by Spark. The strongest n-grams stay; a
text is the set of those that it holds, each scaled by its ratio, brought to length one. A linear model with hinge loss
is fitted to a bounded sample by dual coordinate descent, and a sigmoid, fitted to margins of held-out thirds of the
sample, makes margins probabilities.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseforge.llm import common

#: Bits of an n-gram's hash (bounds the table of counts), n-grams that stay, labelled rows that the model is fitted on.
BITS, KEPT, SAMPLE = 20, 1 << 15, 12_000
#: Characters of text whose n-grams are made at once.
CHUNK = 1 << 20
#: Smoothing of counts, least rows that hold an n-gram, cost of the hinge loss, passes at most, and least violation that goes on.
ALPHA, LEAST, COST, PASSES, GAP = 1.0, 3, 1.0, 60, 1e-2
#: Share of the linear model; the rest is the mean absolute weight, as naive Bayes alone would weigh.
BLEND = 0.75

ODD = 0x9E3779B97F4A7C15
#: Kinds of bytes: 0 white space, 1 a-z, 2 A-Z, 3 digits, 4 other ASCII, 5 from 0x80 on.
KIND = np.array([0 if b in b" \t\n\v\f\r" else 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b < 128 else 5 for b in range(256)], np.uint8)
#: A byte's part in its word's hash: letters without case, digits and bytes from 0x80 on.
PART = np.array([0 if KIND[b] in (0, 4) else b + 32 if KIND[b] == 2 else b for b in range(256)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, shape and text index of each word (what stands between white space) of all texts.

    A shape tells the case, the marks at the end and within, the size, and how far back the same word stood (up to three words).
    """
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    kind = KIND[data]
    gap = kind == 0
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    n = len(start)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start, "right")
    size = end - start
    # a word's hash is the sum of its bytes' parts, each mixed with its place in the word
    heads = np.concatenate([[0], start])
    place = np.arange(len(data)) - np.repeat(heads, np.diff(np.append(heads, len(data))))
    code = mixed(PART[data] + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(1)) * (PART[data] > 0)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code, dtype=np.uint64)])
    h = sums[end] - sums[start]

    def count(mask):
        c = np.concatenate([[0], np.cumsum(mask)])
        return c[end] - c[start]

    upper, lower, marks, digits = count(kind == 2), count((kind == 1) | (kind == 5)), count(kind == 4), count(kind == 3)
    case = np.where(upper == 0, np.where(lower > 0, 1, 0), np.where(lower == 0, 4, np.where((upper == 1) & (kind[start] == 2), 2, 3)))
    last = np.where(kind[end - 1] == 4, data[end - 1], 0)
    back = np.zeros(n, np.int64)
    for k in (3, 2, 1):
        if n > k:
            back[k:] = np.where((h[k:] == h[:-k]) & (doc[k:] == doc[:-k]) & (h[k:] != 0), k, back[k:])
    shape = case + 8 * last.astype(np.int64) + (1 << 11) * np.minimum(marks, 4) + (1 << 14) * np.minimum(size // 2, 15) + (1 << 18) * back + (1 << 20) * (digits > 0)
    return h, shape.astype(np.uint64), doc


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams (with repeats) and the text index of each: words and pairs, and shapes alone, in pairs and triples."""
    h, shape, doc = words(texts)
    shift, out, docs = np.uint64(64 - BITS), [], []
    coarse = shape & np.uint64(~(15 << 14) & (1 << 64) - 1)
    for salt, grams in ((1, [h]), (2, [h, h]), (3, [shape]), (4, [coarse, coarse]), (5, [coarse, coarse, coarse])):
        k = len(grams)
        if len(h) < k:
            continue
        m = len(h) - k + 1
        x = np.full(m, salt, np.uint64)
        for i, g in enumerate(grams):
            x = mixed(x * np.uint64(ODD) + g[i : i + m])
        same = doc[:m] == doc[k - 1 :]
        out.append((x >> shift)[same])
        docs.append(doc[:m][same])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out).astype(np.int64), np.concatenate(docs)


def distinct(at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = np.unique(doc.astype(np.int64) << BITS | at)
    return pair & ((1 << BITS) - 1), pair >> BITS


def descent(rows: list[np.ndarray], x: list[np.ndarray], y: np.ndarray, size: int, cost: np.ndarray, passes: int = PASSES, gap: float = GAP) -> np.ndarray:
    """Weights of the hinge-loss model by dual coordinate descent: each step solves one row's multiplier exactly.

    rows hold the places and x the values of each row, cost is each row's upper bound of its multiplier. The passes go
    through the rows in a fixed shuffled order and end once no multiplier could gain more than `gap`.
    """
    w, a = np.zeros(size), np.zeros(len(rows))
    square = np.array([float(v @ v) for v in x])
    order = np.random.default_rng(5)
    for _ in range(passes):
        most = 0.0
        for i in order.permutation(len(rows)):
            if not square[i]:
                continue
            g = y[i] * float(w[rows[i]] @ x[i]) - 1
            p = min(g, 0) if a[i] <= 0 else max(g, 0) if a[i] >= cost[i] else g
            if p:
                most = max(most, abs(p))
                new = min(max(a[i] - g / square[i], 0.0), cost[i])
                w[rows[i]] += (new - a[i]) * y[i] * x[i]
                a[i] = new
        if most < gap:
            break
    return w


def sigmoid_of(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))) by Newton's method, with Platt's targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    z = np.column_stack([margin, np.ones(len(margin))])
    c = np.array([0.0, np.log((up + 1) / (down + 1))])

    def loss(c):
        s = z @ c
        return float((np.logaddexp(0, s) - t * s).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ c))
        grad = z.T @ (p - t)
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + 1e-9 * np.eye(2), grad)
        size, here = 1.0, loss(c)
        while size > 1e-8 and loss(c - size * step) > here - 1e-4 * size * float(grad @ step):
            size /= 2
        c = c - size * step
        if np.abs(grad).max() < 1e-7 * len(y):
            break
    return float(c[0]), float(c[1])


def train(bitmaps: list[bytes], labels: list[int], ratio: np.ndarray) -> dict:
    """Weights (with the ratios in them) and the sigmoid of the sample's rows, whose sets of kept n-grams are bitmaps."""
    size = len(ratio)
    rows = [np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), count=size)) for b in bitmaps]
    y = np.where(np.array(labels) > 0, 1.0, -1.0)
    norms = [float(np.sqrt((ratio[r] ** 2).sum())) or 1.0 for r in rows]
    # a last place of value one is the bias
    x = [np.append(ratio[r] / n, 1.0) for r, n in zip(rows, norms, strict=True)]
    at = [np.append(r, size) for r in rows]
    cost = np.where(y > 0, COST * len(y) / (2 * max((y > 0).sum(), 1)), COST * len(y) / (2 * max((y < 0).sum(), 1)))

    def fitted(own):
        w = descent([at[i] for i in own], [x[i] for i in own], y[own], size + 1, cost[own])
        return np.append(BLEND * w[:-1] + (1 - BLEND) * np.abs(w[:-1]).mean(), w[-1])

    margin, third = np.zeros(len(y)), np.arange(len(y)) % 3
    for k in range(3):
        own = np.flatnonzero(third != k)
        if len(set(y[own])) == 2:
            w = fitted(own)
            for i in np.flatnonzero(third == k):
                margin[i] = w[at[i]] @ x[i]
    w = fitted(np.arange(len(y)))
    a, b = sigmoid_of(margin, y)
    return {"w": w, "a": max(a, 0.0), "b": b}


def counts(rows: DataFrame) -> np.ndarray:
    """How many rows (text, y) of each label hold each n-gram: 2 by 2**BITS.

    Each task adds up its own rows and sends packed slices of its table; each slice is added up as it streams in, so no
    task holds more than tables of fixed size. What reaches the driver is one table.
    """
    width = 1 << (BITS - 6)

    def count(batches):
        import zlib

        import pyarrow as pa

        held = np.zeros((2, 1 << BITS), np.int32)
        for ys, texts in common.chunks(batches, ["y", "text"], most=CHUNK):
            at, doc = distinct(*features(texts))
            kind = np.array(ys)[doc]
            for k in (0, 1):
                held[k] += np.bincount(at[kind == k], minlength=1 << BITS).astype(np.int32)
        lots = [(i, held[:, i * width : (i + 1) * width]) for i in range(64)]
        lots = [(i, zlib.compress(np.ascontiguousarray(x).tobytes(), 1)) for i, x in lots if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in lots], pa.int32()), pa.array([x for _, x in lots], pa.binary())], names=["slice", "packed"])

    def add(batches):
        import zlib

        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held[i] = held.get(i, 0) + np.frombuffer(zlib.decompress(x.as_py()), np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["slice", "packed"])

    lots = rows.select("y", "text").mapInArrow(common.lean(count), "slice int, packed binary")
    out = np.zeros((2, 1 << BITS), np.int64)
    for r in lots.repartition(16, "slice").mapInArrow(common.lean(add), "slice int, packed binary").collect():  # at most 64 rows of fixed size
        out[:, r.slice * width : (r.slice + 1) * width] = np.frombuffer(r.packed, np.int64).reshape(2, width)
    return out


def strongest(n: np.ndarray, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """The places of the strongest n-grams (log-count ratio by the root of the count) of those in at least LEAST rows, ascending, and their ratios."""
    smooth = n + ALPHA
    ratio = np.log(smooth[1] / smooth[1].sum() / (smooth[0] / smooth[0].sum()))
    at = np.flatnonzero(n.sum(0) >= LEAST)
    order = np.argsort(-np.abs(ratio[at]) * np.sqrt(n.sum(0)[at]), kind="stable")[:kept]
    at = np.sort(at[order])
    return at.astype(np.int32), ratio[at]


def untaught() -> dict:
    return {"at": np.zeros(0, np.int32), "ratio": np.zeros(0), "w": np.zeros(1), "a": 0.0, "b": 0.0}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> dict:
    """A model: counts come from all labelled rows, weights from at most `sample` labelled ids (those of the lowest hashed ids).

    Rows with a null id, label or text, and labels other than 0 and 1, teach nothing; of labels of one id the least
    counts. In the sample, of rows of one id the one of the least set of n-grams counts. Without rows of both labels every text has
    the score 0.5.
    """
    spark = docs.sparkSession
    taught = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    taught = common.cut(taught, "taught")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    # only texts that may have a label are shuffled
    labelled = common.MemberBits(taught, "id").split(texts, "id").where("__may").select("id", "text")
    n = counts(labelled.join(taught, "id"))
    at, ratio = strongest(n)
    order = F.xxhash64("id", F.lit(17))
    few = taught.orderBy(order).limit(sample).toPandas()  # bounded by `sample`
    common.remove(taught)
    if not len(at) or few["y"].nunique() < 2:
        return untaught()
    rows = texts.join(F.broadcast(spark.createDataFrame(few, taught.schema)), "id")
    sent = spark.sparkContext.broadcast(at)

    def sets(parts):
        import pyarrow as pa

        slot = slots(sent.value)
        for keys, ys, texts in parts:
            here, doc = distinct(*features(texts))
            here, doc = here[slot[here] >= 0], doc[slot[here] >= 0]
            ends = np.searchsorted(doc, np.arange(len(texts) + 1))
            held = []
            for i in range(len(texts)):
                mark = np.zeros(len(sent.value), bool)
                mark[slot[here[ends[i] : ends[i + 1]]]] = True
                held.append(np.packbits(mark).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ys, pa.int32()), pa.array(held, pa.binary())], names=["id", "y", "held"])

    def learn(batches):
        """At most `sample` sets of KEPT bits in one task: one row with the model, or none."""
        import pyarrow as pa

        ys, held = [], []
        for b in batches:
            ys += b.column(0).to_pylist()
            held += b.column(1).to_pylist()
        if len(set(ys)) == 2:
            m = train(held, ys, ratio)
            yield pa.RecordBatch.from_arrays([pa.array([m["w"].tobytes()]), pa.array([m["a"]]), pa.array([m["b"]])], names=["w", "a", "b"])

    kind = rows.schema["id"].dataType.simpleString()
    bitmaps = common.map_rows(rows, ["id", "y", "text"], sets, f"id {kind}, y int, held binary", CHUNK)
    one = bitmaps.groupBy("id").agg(F.min(F.struct("held", "y")).alias("r")).select(order.alias("o"), "id", "r.y", "r.held").repartition(1).sortWithinPartitions("o", "id").select("y", "held")
    told = one.mapInArrow(common.lean(learn), "w binary, a double, b double").collect()
    if not told:
        return untaught()
    return {"at": at, "ratio": ratio, "w": np.frombuffer(told[0].w), "a": told[0].a, "b": told[0].b}


def slots(at: np.ndarray) -> np.ndarray:
    """The number of each n-gram's hash among those that stay, or -1."""
    out = np.full(1 << BITS, -1, np.int32)
    out[at] = np.arange(len(at), dtype=np.int32)
    return out


def score_texts(m: dict, slot: np.ndarray, texts: list[str | None]) -> np.ndarray:
    at, doc = features(texts)
    own = slot[at]
    pair = np.unique(doc[own >= 0].astype(np.int64) << BITS | own[own >= 0])
    own, doc = pair & ((1 << BITS) - 1), pair >> BITS
    total = np.bincount(doc, weights=m["w"][own] * m["ratio"][own], minlength=len(texts))
    norm = np.sqrt(np.bincount(doc, weights=m["ratio"][own] ** 2, minlength=len(texts)))
    margin = total / np.where(norm > 0, norm, 1) + m["w"][-1]
    return 1 / (1 + np.exp(-np.clip(m["a"] * margin + m["b"], -30, 30)))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (0 to 1) of every row; a null or empty text has the score of no n-grams. Other columns aren't read; an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(parts):
        import pyarrow as pa

        m = sent.value
        slot = slots(m["at"])
        for keys, texts in parts:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(score_texts(m, slot, texts))], names=["key", "score"])

    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return common.map_rows(rows, ["key", "text"], work, f"key {kind}, score double", CHUNK).withColumnRenamed("key", id_col)


def op11_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labels of three quarters of them; remainder 2 is held out."""
    docs = common.table(spark, sf_dir, "documents")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    out = score(docs, fit(docs, common.table(spark, sf_dir, "labels").where(part != 2)))
    return out.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
