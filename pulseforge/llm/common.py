"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseforge.functions.steps import cut, remove, shared_dir  # noqa: F401

#: Characters of text that a Python worker handles at once (a single longer text is still handled whole).
CHUNK_CHARS = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(kernel: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A kernel of mapInArrow that gives freed memory back to the machine when its task ends; Python workers live on between tasks."""

    def run(batches):
        yield from kernel(batches)
        import contextlib
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


def map_rows(df: DataFrame, cols: list[str], work: Callable[[Iterator[tuple]], Iterable], schema: str, most: int = CHUNK_CHARS) -> DataFrame:
    """Map each partition through work, which gets lists of columns (a few MB of text at once) and yields record batches.

    A result column of the name of one of cols gets that column's Arrow type, so ids of any type come through.
    """

    def run(batches):
        kinds: dict = {}

        def noted():
            for b in batches:
                kinds.update(zip(b.schema.names, b.schema.types, strict=True))
                yield b

        for out in work(chunks(noted(), cols, most=most)):
            yield typed(out, kinds)

    return df.select(*cols).mapInArrow(lean(run), schema)


def typed(batch, kinds: dict):
    """The batch with the columns that kinds names cast to its types."""
    import pyarrow as pa

    columns = [c if c.type == kinds.get(n, c.type) else c.cast(kinds[n]) for n, c in zip(batch.schema.names, batch.columns, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def chunks(batches, cols: list[str], text: str = "text", most: int = CHUNK_CHARS) -> Iterator[tuple]:
    """Column lists of consecutive rows, cut so that their texts hold about `most` characters."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        at = batch.schema.get_field_index(text)
        if at < 0:
            for lo in range(0, n, 65536):
                part = batch.slice(lo, 65536)
                yield tuple(part.column(batch.schema.get_field_index(c)).to_pylist() for c in cols)
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(at).cast(pa.large_string())), 0).to_pylist()
        lo, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                part = batch.slice(lo, i - lo)
                yield tuple(part.column(batch.schema.get_field_index(c)).to_pylist() for c in cols)
                lo, held = i, 0
            held += size
        if lo < n:
            part = batch.slice(lo, n - lo)
            yield tuple(part.column(batch.schema.get_field_index(c)).to_pylist() for c in cols)


def arrays(batches, cols: list[str], text: str = "text", most: int = CHUNK_CHARS) -> Iterator[tuple]:
    """Arrow columns of consecutive rows, cut so that their texts hold about `most` bytes (a single longer text is a lot of its own)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        lo = 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
            part = batch.slice(lo, hi - lo)
            yield tuple(part.column(c) for c in cols)
            lo = hi


def whole_rows(batches, text_col: str, others: list[str] = (), most: int = CHUNK_CHARS) -> Iterator[tuple]:
    """Lots of consecutive rows as (row, text, *others): batches hold whole rows in the struct column `row`, so that their texts are sent once."""
    import pyarrow as pa

    def unwrapped():
        for b in batches:
            row = b.column("row")
            yield pa.RecordBatch.from_arrays([row, row.field(text_col), *(b.column(c) for c in others)], names=["row", "text", *others])

    return arrays(unwrapped(), ["row", "text", *others], most=most)


def record_batch(schema: list[tuple], columns: list) -> object:
    """A record batch from (name, arrow type) pairs and as many lists or arrays."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=t) for (_, t), c in zip(schema, columns, strict=True)],
        names=[n for n, _ in schema],
    )


def crc_fold(col: str = "doc_id"):
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(5))


class MemberBits:
    """A bitmap of fixed size over hashed ids: never misses a member, may keep others.

    It is built by an aggregation to at most 2**(bits - 6) words and broadcast, so its size never grows with the data;
    when it fills up, it keeps more rows than needed and results stay the same.
    """

    def __init__(self, members: DataFrame, col: str, bits: int = 25):
        import numpy as np

        spark = members.sparkSession
        self.bits = bits
        words = (
            members.select(self.slot(col).alias("s"))
            .groupBy((F.col("s") / 64).cast("int").alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("b"))
            .toPandas()
        )
        table = np.zeros(1 << (bits - 6), dtype=np.int64)
        if len(words):
            table[words["w"].to_numpy()] = words["b"].to_numpy()
        self.sent = spark.sparkContext.broadcast(table.view(np.uint8))

    def slot(self, col):
        """A value's place in the bitmap."""
        return F.pmod(F.xxhash64(F.col(col) if isinstance(col, str) else col), F.lit(1 << self.bits))

    def hits(self, slots):
        """Which of the slots (a numpy array) may be members'; for kernels."""
        import numpy as np

        return ((self.sent.value[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).astype(bool)

    def keep(self, df: DataFrame, col: str) -> DataFrame:
        """Rows of df whose col may be a member."""
        import pyarrow as pa

        sent, bits, names = self.sent, self.bits, df.columns

        def run(batches):
            import numpy as np

            table = sent.value
            for b in batches:
                slot = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
                hit = (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
                kept = b.filter(pa.array(hit.astype(bool)))
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=names)

        return df.select("*", self.slot(col).alias("__slot")).mapInArrow(run, df.schema)

    def split(self, df: DataFrame, col) -> DataFrame:
        """df and __may: whether col may be a member. The rows themselves stay out of Python."""
        sent = self.sent

        def may(slot):
            import numpy as np
            import pandas as pd

            slot = slot.to_numpy()
            return pd.Series(((sent.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool))

        return df.withColumn("__may", F.pandas_udf(may, "boolean", F.PandasUDFType.SCALAR)(F.coalesce(self.slot(col), F.lit(0))))


def by_range(df: DataFrame, order: str, parts: int) -> Callable[[DataFrame], DataFrame]:
    """A function that adds the column `bucket`: the number of the id range (of about equal rows in df) of the long column `order`.

    The function's `parts` tells how many ranges there are at most. Equal values share a range; the ranges follow each
    other in the order of their values.
    """
    import math

    from pyspark.ml.feature import Bucketizer

    cuts = []
    if parts > 1:
        probabilities = [i / parts for i in range(1, parts)]
        cuts = sorted(set(df.select(F.col(order).cast("double").alias("x")).approxQuantile("x", probabilities, 0.1 / parts)))
    cuter = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="x", outputCol="bucket") if cuts else None

    def add(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("x", F.col(order).cast("double"))
        rows = cuter.transform(rows) if cuter else rows.withColumn("bucket", F.lit(0))
        return rows.withColumn("bucket", F.col("bucket").cast("int")).drop("x")

    add.parts = len(cuts) + 1
    return add
