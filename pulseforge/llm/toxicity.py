"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct hashed words, word pairs, pairs with one word between, and triples. FTRL-proximal
keeps a learning rate for each coordinate and an L1 penalty, which leaves few weights; these are broadcast as two sorted
arrays, and texts are scored by the features that have a weight.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseforge.llm import common

#: Bits of a feature's hash, which bound what is broadcast (8 bytes for each of at most 2**BITS weights); most labelled texts that a model is fitted on.
BITS, SAMPLE = 22, 12_000
#: Characters of text whose features are made at once.
CHUNK = 1 << 20
EPOCHS, ALPHA, BETA, L1, L2 = 5, 2.0, 1.0, 6.0, 0.0
#: Bias of a model that had no rows of both labels: nothing counts as toxic.
UNTAUGHT = -1.0
#: Weight of a toxic row; there are fewer of them.
POSITIVE = 2.0

#: Bytes that part words become blanks, A-Z become a-z; digits, letters and bytes from 0x80 stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts and the index of the text of each (with repeats)."""
    split = [t.encode("utf-8", "surrogatepass").translate(FOLD).split() if t else [] for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    n = int(sizes.sum())
    h = np.fromiter(map(zlib.crc32, itertools.chain.from_iterable(split)), np.uint64, n)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    h = h * np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - BITS)

    def mixed(x, y):
        z = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + y
        return z

    out, docs = [(h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> shift], [doc]
    for gap in (1, 2):
        if n > gap:
            same = doc[gap:] == doc[:-gap]
            pair = mixed(h[:-gap], h[gap:] + np.uint64(gap))
            out.append((pair * np.uint64(0x94D049BB133111EB) >> shift)[same])
            docs.append(doc[gap:][same])
    if n > 2:
        same = doc[2:] == doc[:-2]
        triple = mixed(mixed(h[:-2], h[1:-1]), h[2:] + np.uint64(3))
        out.append((triple * np.uint64(0x94D049BB133111EB) >> shift)[same])
        docs.append(doc[2:][same])
    return np.concatenate(out).astype(np.int64), np.concatenate(docs)


class Ftrl:
    """FTRL-proximal for logistic loss with one rate for each coordinate; coordinate 2**BITS is the bias and isn't penalised."""

    def __init__(self, size: int = 1 << BITS):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.bias = size

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == self.bias, 0.0, L1)
        w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, y: float) -> None:
        at = np.append(at, self.bias)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
        g *= POSITIVE if y else 1.0
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g

    def compact(self) -> dict:
        at = np.flatnonzero(self.z[:-1])
        w = self.weights(at)
        at, w = at[w != 0], w[w != 0]
        return {"at": at.astype(np.int32), "w": w.astype(np.float32), "bias": float(self.weights(np.array([self.bias]))[0])}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> dict:
    """A model of at most `sample` labelled rows (those of the lowest hashed ids), taken in the order of their hashed ids.

    Rows with a null id, label or text teach nothing; of rows of one id the first label counts. Without rows of both
    labels the model has no weights and the bias UNTAUGHT.
    """
    spark = docs.sparkSession
    order = F.xxhash64(F.col("id"), F.lit(11))
    taught = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    taught = taught.orderBy(order).limit(sample).toPandas()  # bounded by `sample`
    if not len(taught):
        return {"at": np.zeros(0, np.int32), "w": np.zeros(0, np.float32), "bias": UNTAUGHT}
    small = F.broadcast(spark.createDataFrame(taught))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(small, "id")

    def work(parts):
        import pyarrow as pa

        for keys, ys, texts in parts:
            at, doc = features(texts)
            pair = np.unique(doc.astype(np.int64) << BITS | at)
            sizes = np.bincount(pair >> BITS, minlength=len(keys))
            values = (pair & ((1 << BITS) - 1)).astype(np.int32)
            ends = np.cumsum(sizes) * 4
            raw = values.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ys, pa.int32()), pa.array([raw[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], pa.binary())], names=["id", "y", "raw"])

    found = common.map_rows(rows.select(F.col("id").cast("long"), F.col("y").cast("int"), "text"), ["id", "y", "text"], work, "id long, y int, raw binary", CHUNK)
    def train(batches):
        """The bounded sample in one task: one row with the model, or none."""
        import pyarrow as pa

        pairs, last = [], None
        for t in batches:
            for i, y, raw in zip(t.column("id").to_pylist(), t.column("y").to_pylist(), t.column("raw"), strict=True):
                if i != last:  # of rows of one id the first counts
                    pairs.append((np.frombuffer(raw.as_py(), np.int32), float(y)))
                last = i
        if len({y for _, y in pairs}) == 2:
            model = Ftrl()
            for _ in range(EPOCHS):
                for at, y in pairs:
                    model.learn(at, y)
            m = model.compact()
            yield pa.RecordBatch.from_arrays([pa.array([m["at"].tobytes()]), pa.array([m["w"].tobytes()]), pa.array([m["bias"]])], names=["at", "w", "bias"])

    one = found.withColumn("o", order).repartition(1).sortWithinPartitions("o", "id", F.xxhash64("raw")).select("id", "y", "raw")
    told = one.mapInArrow(common.lean(train), "at binary, w binary, bias double").collect()
    if not told:
        return {"at": np.zeros(0, np.int32), "w": np.zeros(0, np.float32), "bias": UNTAUGHT}
    return {"at": np.frombuffer(told[0].at, np.int32), "w": np.frombuffer(told[0].w, np.float32), "bias": told[0].bias}


def score_texts(m: dict, table: np.ndarray, texts: list[str | None]) -> np.ndarray:
    at, doc = features(texts)
    hit = table[at] != 0
    pair = np.unique(doc[hit].astype(np.int64) << BITS | at[hit])
    total = m["bias"] + np.bincount(pair >> BITS, weights=table[pair & ((1 << BITS) - 1)], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (0 to 1) of every row; a null or empty text has the score of no features. Other columns aren't read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(parts):
        import pyarrow as pa

        m = sent.value
        table = np.zeros(1 << BITS, np.float32)
        table[m["at"]] = m["w"]
        for keys, texts in parts:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(score_texts(m, table, texts))], names=["key", "score"])

    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return common.map_rows(rows, ["key", "text"], work, f"key {kind}, score double", CHUNK).withColumnRenamed("key", id_col)


def score_rows(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with all its columns and the score of each row; a column score of docs is replaced. Null and empty texts have the score of no features."""
    docs = docs.drop("score")
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = sent.value
        table = np.zeros(1 << BITS, np.float32)
        table[m["at"]] = m["w"]
        for t in batches:
            parts = [score_texts(m, table, texts) for (texts,) in common.chunks([t], [text_col], text_col, CHUNK)]
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=[*names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(common.lean(run), f"{kinds}, score double")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels outside fold 0."""
    docs = common.table(spark, sf_dir, "documents")
    labels = common.table(spark, sf_dir, "labels").where(common.crc_fold() != 0)
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(common.crc_fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
