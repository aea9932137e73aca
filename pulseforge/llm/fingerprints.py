"""Canonical exact fingerprints of documents.

A text is brought to NFKC, case-folded, and its white space is folded; the 128-bit xxh3 of what remains is the
fingerprint. Rows of equal fingerprints are one bucket; inside a bucket the canonical texts are compared byte by byte
with the bucket's first row, so that a collision of the hash never joins different texts.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseforge.llm import common

#: Rows of one bucket that a salt holds, and rows of a range of ids.
SALT_ROWS, RANGE_ROWS = 512, 20_000


def canonical(text: str | None) -> bytes:
    """Normalised, case-folded text with single blanks; null counts as empty."""
    if not text:
        return b""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(data: bytes, bits: int = 128) -> str:
    """Lowercase hex of the wide hash; fewer bits serve tests of collisions."""
    import xxhash

    return xxhash.xxh3_128_hexdigest(data) if bits == 128 else f"{xxhash.xxh3_128_intdigest(data) >> (128 - bits):x}"


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 128) -> DataFrame:
    """id_col and fingerprint of each row. Null and empty texts share one fingerprint; an empty table gives no rows."""

    def work(parts):
        import pyarrow as pa

        for keys, texts in parts:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([digest(canonical(t), bits) for t in texts])], names=["key", "fingerprint"])

    rows = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return common.map_rows(rows, ["key", "text"], work, f"key {kind}, fingerprint string").withColumnRenamed("key", id_col)


def groups(df: DataFrame, prints: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 128) -> DataFrame:
    """Group of each row of prints (id_col, fingerprint): the smallest id whose canonical text has the same bytes.

    Returns id_col, fingerprint, group_id for rows whose group holds another id; all other rows are groups of their own.
    Large buckets are split into salts, each with a copy of the bucket's first text. What differs from it (a collision)
    is compared again among itself until nothing is left. Rows without id have no group. Rows of one id with different
    fingerprints each have a group of their own; a repeated row counts once. `bits` is that of the fingerprints.
    """
    spark = df.sparkSession
    distinct = prints.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), "fingerprint").distinct()
    buckets = distinct.groupBy("fingerprint").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    members = common.cut(distinct.join(buckets, "fingerprint"), "members")
    rows = common.MemberBits(members, "id").keep(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")

    def work(parts):
        import pyarrow as pa

        for keys, texts in parts:
            made = [canonical(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([digest(c, bits) for c in made]), pa.array(made, pa.binary())], names=["id", "fingerprint", "canon"])

    kind = rows.schema["id"].dataType.simpleString()
    canon = common.map_rows(rows, ["id", "text"], work, f"id {kind}, fingerprint string, canon binary").dropDuplicates(["id", "fingerprint"])
    left, found, used = members, None, []
    while True:
        salted = left.withColumn("salt", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("n") / SALT_ROWS))))
        texts = salted.join(canon, ["id", "fingerprint"])
        heads = left.where("id = first").select("fingerprint", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.ceil(F.col("n") / SALT_ROWS)) - 1)).alias("salt"))
        heads = heads.join(canon.withColumnRenamed("canon", "head"), ["id", "fingerprint"]).drop("id")
        told = common.cut(texts.join(heads, ["fingerprint", "salt"]).select("id", "fingerprint", "first", (F.col("canon") == F.col("head")).alias("same")), "told")
        same = told.where("same").select(F.col("id").alias(id_col), "fingerprint", F.col("first").alias("group_id"))
        found = same if found is None else found.unionByName(same)
        used.append(told)
        rest = told.where("not same").select("id", "fingerprint")
        if rest.isEmpty():
            return found
        again = rest.groupBy("fingerprint").agg(F.min("id").alias("first"), F.count("*").alias("n"))
        left = common.cut(rest.join(again, "fingerprint"), "left")


def with_next(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Rows dealt to ranges of ascending ids; each range also gets the next range's first row (the last range the very first one).

    Columns key, text, halo; sorted within partitions by halo and id. Rows of one id stand in the order of their texts'
    hashes; null ids come first.
    """
    spark = df.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    ids = df.select(key.alias("order"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = ids.count()
    parts = min(100_000, max(parts, -(-total // RANGE_ROWS))) if total else 1
    bucketed = common.by_range(ids, "order", parts)
    firsts = sorted((r["bucket"], r["first"]) for r in bucketed(ids).groupBy("bucket").agg(F.min("order").alias("first")).collect())
    halo = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    extra = F.broadcast(spark.createDataFrame(halo, "order long, before int"))  # a row for each range
    rows = bucketed(df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), key.alias("order"))).join(extra, "order", "left")
    here = F.struct(F.col("bucket").alias("part"), F.lit(0).alias("halo"))
    there = F.struct(F.col("before").alias("part"), F.lit(1).alias("halo"))
    rows = rows.select("key", "text", "order", F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("to"))
    rows = rows.select("key", "text", "order", F.col("to.part").alias("part"), F.col("to.halo").alias("halo"))
    return rows.repartitionById(bucketed.parts, F.col("part")).sortWithinPartitions("halo", "order", F.xxhash64("text")).select("key", "text", "halo")


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text: its last half replaced by the start of the next row's text.

    Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Likeness of exact
    fingerprints is 1 for equal canonical bytes and 0 otherwise. A single row is its own next row.
    """

    def work(parts):
        import hashlib

        import pyarrow as pa

        held, plain = None, None
        for keys, texts, halos in parts:
            out = []
            for key, text, halo in zip(keys, texts, halos, strict=True):
                text = text or ""
                canon = plain = canonical(text)
                mark = digest(canon)
                if held is not None:
                    key0, text0, canon0, mark0 = held
                    n = len(text0)
                    edited = text0[: n - n // 2] + text[: n // 2]
                    canon1 = canonical(edited)
                    out.append((key0, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark0, digest(canon1), float(canon1 == canon0), float(canon == canon0)))
                held = None if halo else (key, text, canon, mark)
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()], strict=True)],
                names=["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    rows = with_next(df, id_col, text_col).select(F.col("key").cast("long"), "text", "halo")
    return common.map_rows(rows, ["key", "text", "halo"], work, "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, with the group of equal canonical texts."""
    docs = common.table(spark, sf_dir, "documents")
    out = common.cut(edited_fingerprints(docs).withColumnRenamed("key", "doc_id"), "prints")
    same = groups(docs, out.select("doc_id", "fingerprint"))
    return out.join(same, ["doc_id", "fingerprint"], "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.coalesce("group_id", "doc_id").alias("group_id")
    )
