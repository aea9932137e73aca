"""MinHash near-duplicate detection with sequential Bayesian verification.

Rows of one set of shingles are one class; its smallest id stands for it. Signatures of the classes are banded. Candidate
pairs are compared a batch of hashes at a time: a pair is dropped once the posterior probability that its similarity
reaches the threshold (uniform prior) falls below the chosen miss probability. The pairs that are left are verified on
the full sets. Pairs are taken in an order that keeps their number linear: first each class with the leader of a band
bucket (its smallest id), then, only in buckets that still hold several components, the members of different components,
in blocks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseforge.llm import common

WORDS, NEED = 5, 75
#: Hashes of a signature, rows of a band, hashes that are compared at a time, and the probability that a true pair is dropped at a step.
HASHES, ROWS, STEP, MISS = 128, 4, 32, 1e-5
#: Members of a block of a band bucket, shingles of its members, and passes in which each member gets only its best candidate of another component.
BLOCK, FILL, PASSES = 1024, 1 << 20, 1


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; with fewer words the whole sequence is one shingle."""
    import xxhash

    split = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not split:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split))
    if len(h) < words:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), len(h))], np.uint64)
    n = len(h) - words + 1
    out = h[:n].copy()
    for k in range(1, words):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        out ^= out >> np.uint64(29)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of each minimum; sets aren't empty."""
    a, b = permutations()
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint16)
    for j in range(HASHES):
        low = np.minimum.reduceat(flat * a[j] + b[j], starts)
        out[:, j] = (low * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)
    return out


def least_matches(threshold: float = NEED / 100, miss: float = MISS) -> dict[int, int]:
    """For each number of compared hashes, the fewest matches with which the similarity may still reach the threshold.

    With a uniform prior, m matches of n give a posterior Beta(m + 1, n - m + 1), whose tail above t is P(Binomial(n + 1, t) <= m).
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                out[n] = m
                break
    return out


def survive(x: np.ndarray, y: np.ndarray, need: dict[int, int]) -> np.ndarray:
    """Matches of pairs of signatures (rows of x and y), or -1 for those dropped at some step."""
    alive = np.arange(len(x))
    matches = np.zeros(len(x), np.int32)
    for n in range(STEP, HASHES + 1, STEP):
        matches[alive] += (x[alive, n - STEP : n] == y[alive, n - STEP : n]).sum(1, dtype=np.int32)
        alive = alive[matches[alive] >= need[n]]
    out = np.full(len(x), -1, np.int32)
    out[alive] = matches[alive]
    return out


def sketch(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th (hash of the text), n (size of the set), mark (digest of the set; null if it is empty) and signature of each row."""

    def work(parts):
        import pyarrow as pa
        import xxhash

        for keys, ths, texts in parts:
            sets = list(map(shingles, texts))
            full = [s for s in sets if len(s)]
            sigs = iter(signatures(full) if full else ())
            sig = [next(sigs).tobytes() if len(s) else None for s in sets]
            mark = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(list(map(len, sets)), pa.int64()), pa.array(mark, pa.binary()), pa.array(sig, pa.binary()), pa.array(ths, pa.int64())], names=["id", "n", "mark", "sig", "th"])

    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return common.map_rows(rows, ["id", "th", "text"], work, f"id {kind}, n long, mark binary, sig binary, th long", common.CHUNK_CHARS // 4)


def components(edges: DataFrame, cut=common.cut) -> DataFrame:
    """id and comp (smallest id reachable) of every id in edges (a, b).

    Each round hangs every id on its smallest neighbour, follows two such steps, and contracts the edges, until none is
    left; all of it is joins and aggregations that combine before the shuffle.
    """
    labels, edges = None, cut(edges.where("a <> b").select("a", "b").distinct(), "edges")
    while not edges.isEmpty():
        old = [edges]
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        for _ in range(2):
            high = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
            up = cut(up.join(high, "p", "left").select("a", F.coalesce("q", "p").alias("p")), "up")
            old.append(up)
        if labels is None:
            labels = up.select(F.col("a").alias("id"), F.col("p").alias("comp"))
            labels.cut_path = old.pop().cut_path  # they are the last of `up`
        else:
            old.append(labels)
            labels = cut(labels.join(up.select(F.col("a").alias("comp"), "p"), "comp", "left").select("id", F.coalesce("p", "comp").alias("comp")), "labels")
        a = up.select("a", F.col("p").alias("pa"))
        b = up.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = cut(edges.join(a, "a").join(b, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
        common.remove(*old)
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    return labels


class Shingles:
    """Sets of compressed texts by their marks; the last few hundred thousand shingles are kept."""

    def __init__(self, most: int = 500_000):
        import zstandard

        self.open, self.held, self.size, self.most = zstandard.ZstdDecompressor(), {}, 0, most

    def of(self, mark: bytes, z: bytes) -> np.ndarray:
        if mark not in self.held:
            found = shingles(self.open.decompress(z).decode("utf-8", "surrogatepass"))
            if self.size + len(found) > self.most:
                self.held, self.size = {}, 0
            self.held[mark] = found
            self.size += len(found)
        return self.held[mark]


class Linker:
    """The steps over one table of documents."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.need = least_matches()

    def run(self) -> DataFrame:
        """id, th (xxhash64 of the text), n_shingles, component_id of every row."""
        rows = common.cut(sketch(self.docs, "id", "text"), "sketch")
        full = rows.where("id is not null and mark is not null")
        self.reps = common.cut(full.groupBy("mark").agg(F.min("id").alias("id"), F.min_by("sig", "id").alias("sig"), F.max("n").alias("n")), "reps")
        bands = self.reps.select("id", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1)), lambda b: F.xxhash64(b, F.expr("sig").substr(b * (2 * ROWS) + 1, F.lit(2 * ROWS))))).alias("band", "key"))
        leaders = bands.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("size")).where("size > 1")
        self.members = common.cut(bands.join(leaders, "key"), "members")
        shared = self.members.where("id <> leader").groupBy("id", "leader").count()
        best = shared.groupBy("id").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("b"))
        tried = self.verify(self.screen(best.select(F.col("id").alias("a"), "b")))
        comps = self.absorb(self.reps.select("id", F.col("id").alias("comp")), tried)
        for _ in range(PASSES):
            pairs = self.across(comps).join(tried.select("a", "b"), ["a", "b"], "left_anti")
            pairs = pairs.groupBy("asker").agg(F.max(F.struct("matches", "a", "b", "ma", "mb")).alias("x")).select("x.*")
            again = self.verify(common.cut(pairs.select("a", "b", "ma", "mb").dropDuplicates(), "pairs"))
            if again.where("linked").isEmpty():
                break
            comps = self.absorb(comps, again)
            tried = tried.unionByName(again)
        links = common.cut(self.across(comps, exact=True).select("a", "b", F.lit(True).alias("linked")).distinct(), "links")
        if not links.isEmpty():
            comps = self.absorb(comps, links)
        classes = self.reps.select("mark", "id").join(comps, "id", "left").select("mark", F.coalesce("comp", "id").alias("found"))
        named = rows.where("mark is not null").join(classes, "mark", "left").select("id", "th", "n", "found")
        alone = rows.where("mark is null").select("id", "th", "n", F.lit(None).cast("long").alias("found"))
        return named.unionByName(alone).select("id", "th", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("found", "id")).alias("component_id"))

    def absorb(self, comps: DataFrame, tried: DataFrame) -> DataFrame:
        """comps (id, comp of every class) with the components joined that the verified links connect."""
        end = lambda c: comps.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}"))
        edges = tried.where("linked").join(end("a"), "a").join(end("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        labels = components(edges)
        up = labels.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        out = common.cut(comps.distinct().join(up, "comp", "left").select("id", F.coalesce("up", "comp").alias("comp")), "comps")
        common.remove(labels, comps)
        return out

    def screen(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that the comparison of signatures leaves, with the marks of both."""
        side = lambda c: self.reps.select(F.col("id").alias(c), F.col("mark").alias(f"m{c}"), F.col("sig").alias(f"s{c}"))
        need = self.need

        def run(batches):
            import pyarrow as pa

            for t in batches:
                x, y = (np.frombuffer(b"".join(t.column(i).to_pylist()), np.uint16).reshape(-1, HASHES) for i in (4, 5))
                kept = t.filter(pa.array(survive(x, y, need) >= 0))
                yield pa.RecordBatch.from_arrays(kept.columns[:4], names=["a", "b", "ma", "mb"])

        joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ma", "mb", "sa", "sb")
        return common.cut(joined.mapInArrow(common.lean(run), "a long, b long, ma binary, mb binary"), "screened")

    def texts(self, ids: DataFrame) -> DataFrame:
        """id, mark and compressed text of the ids (and perhaps of a few others)."""
        bits = common.MemberBits(ids, "id")

        def work(batches):
            import pyarrow as pa
            import xxhash
            import zstandard

            pack = zstandard.ZstdCompressor(3)
            for keys, texts, slots in common.arrays(batches, ["id", "text", "slot"], most=common.CHUNK_CHARS // 4):
                hit = pa.array(bits.hits(slots.to_numpy(zero_copy_only=False)))
                mark, packed = [], []
                for t in texts.filter(hit).to_pylist():
                    s = shingles(t)
                    mark.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    packed.append(pack.compress((t or "").encode("utf-8", "surrogatepass")))
                yield pa.RecordBatch.from_arrays([keys.filter(hit), pa.array(mark, pa.binary()), pa.array(packed, pa.binary())], names=["id", "mark", "z"])

        rows = self.docs.where("id is not null").select("id", "text", bits.slot("id").alias("slot"))
        found = rows.mapInArrow(common.lean(work), "id long, mark binary, z binary")
        return found.where("mark is not null").dropDuplicates(["id", "mark"])

    def verify(self, pairs: DataFrame) -> DataFrame:
        """a, b and linked (on the full sets) of pairs (a, b, ma, mb)."""
        spark = pairs.sparkSession
        if pairs.isEmpty():
            return spark.createDataFrame([], "a long, b long, linked boolean")
        texts = common.cut(self.texts(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "texts")
        side = lambda c: texts.select(F.col("id").alias(c), F.col("mark").alias(f"m{c}"), F.col("z").alias(f"z{c}"))

        def run(batches):
            import pyarrow as pa

            of = Shingles().of
            for t in batches:
                told = []
                for ma, za, mb, zb in zip(*(t.column(i).to_pylist() for i in range(2, 6)), strict=True):
                    x, y = of(mb, zb), of(ma, za)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    told.append(100 * both >= NEED * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(told, pa.bool_())], names=["a", "b", "linked"])

        joined = pairs.join(side("a"), ["a", "ma"]).join(side("b"), ["b", "mb"]).select("a", "b", "ma", "za", "mb", "zb")
        found = joined.mapInArrow(common.lean(run), "a long, b long, linked boolean")
        out = common.cut(found.groupBy("a", "b").agg(F.max("linked").alias("linked")), "verified")
        common.remove(texts, pairs)
        return out

    def across(self, comps: DataFrame, exact: bool = False) -> DataFrame:
        """Pairs of members of a bucket in different components: asker, matches, a, b and their marks.

        Without `exact`, each member gets the pair of a block that has most matching hashes. With it, all pairs that the
        comparison of signatures leaves are verified on the full sets inside the block's task, each pair in the first band
        that it shares, and one linked pair for each member and other component is returned.
        """
        # linked sets differ in size by less than a factor; a class is two factors wide, so a member asks its own class and
        # that beside its half of it
        rows = self.members.join(comps, "id")
        mixed = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min_by("comp", "id").alias("main"), F.count("*").alias("held"), F.sum("n").alias("filled")).where("low <> high")
        rows = rows.join(mixed.select("key", "main", "held", "filled"), "key")
        if "sig" not in rows.columns:  # the signatures of what stands in mixed buckets, for all passes
            rows = rows.join(self.reps.select("id", "mark", "sig"), "id")
        rows = common.cut(rows, "mixed")
        # components only grow, so other buckets are never mixed again
        self.members = rows.drop("comp", "main", "held", "filled")
        schema = "asker long, matches int, a long, b long, ma binary, mb binary"
        if rows.isEmpty():
            return rows.sparkSession.createDataFrame([], schema)
        step = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / NEED) + 1e-9).cast("int")
        rows = rows.withColumns({"cls": F.floor(step / 2).cast("int"), "beside": F.when(step % 2 == 0, -1).otherwise(1), "small": (F.col("held") <= BLOCK) & (F.col("filled") <= FILL)})
        # members of the leader's component stand; all others stand too and also ask
        kind = F.when(F.col("comp") == F.col("main"), 0).otherwise(1).alias("kind")
        own_names = ["band", "id", "comp", "mark", "sig"]
        stand = rows.select("key", "cls", kind, *own_names, "n", "small")
        ask = rows.where("comp <> main").select("key", F.explode(F.array(F.col("cls"), F.col("cls") + F.col("beside"))).alias("cls"), F.lit(2).alias("kind"), *own_names, "n", "small")
        names = ["key", "cls", "block", "turn", "kind", *own_names]
        one = lambda side: side.where("small").withColumns({"block": F.lit(0), "turn": F.lit(0)}).select(*names)
        # both sides of a larger bucket are dealt to blocks: a group holds a block that stands and a block that asks, whatever the bucket's size and texts
        big = lambda side: side.where("not small")
        count = lambda side, name: big(side).groupBy("key", "cls").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / FILL)).cast("int").alias(name))
        blocks = common.cut(count(stand, "blocks").join(count(ask, "turns"), ["key", "cls"]), "blocks")
        own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        stands = big(stand).join(blocks, ["key", "cls"]).withColumn("block", own("blocks")).withColumn("turn", every("turns")).select(*names)
        asks = big(ask).join(blocks, ["key", "cls"]).withColumn("turn", own("turns")).withColumn("block", every("blocks")).select(*names)
        need = self.need
        dealt = one(stand).unionByName(one(ask)).unionByName(stands).unionByName(asks)
        if exact:
            dealt = common.cut(dealt, "dealt")
            dealt = dealt.join(common.cut(self.texts(dealt.select("id").distinct()), "texts"), ["id", "mark"])
        else:
            dealt = dealt.withColumn("z", F.lit(None).cast("binary"))
        parts = int(self.reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = dealt.repartition(parts, *names[:4]).sortWithinPartitions(*names[:5]).select(*names, "z")

        def compare(group, shingles_of):
            """Survivors between the asking and the standing rows of one block."""
            stand_, ask_ = [r for r in group if r[0] < 2], [r for r in group if r[0] == 2]
            if not stand_ or not ask_:
                return
            own, comp = np.array([r[2] for r in stand_]), np.array([r[3] for r in stand_])
            asks_too = np.array([r[0] == 1 for r in stand_])
            sigs = np.frombuffer(b"".join(r[5] for r in stand_), np.uint16).reshape(-1, HASHES)
            for _, band, i, c, mark, sig, z in ask_:
                mine = np.frombuffer(sig, np.uint16)
                other = np.flatnonzero((comp != c) & ~(asks_too & (own > i)) if exact else comp != c)
                if not len(other):
                    continue
                matches = survive(np.broadcast_to(mine, (len(other), HASHES)), sigs[other], need)
                hit = np.flatnonzero(matches >= 0)
                hit = hit[np.lexsort((own[other[hit]], -matches[hit]))]
                done = set()
                for k, m in zip(other[hit].tolist(), matches[hit].tolist(), strict=True):
                    if exact:
                        first = int((mine.reshape(-1, ROWS) == sigs[k].reshape(-1, ROWS)).all(1).argmax())
                        if first != band or comp[k] in done:
                            continue
                        x, y = shingles_of(mark, z), shingles_of(stand_[k][4], stand_[k][6])
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if 100 * both < NEED * (len(x) + len(y) - both):
                            continue
                        done.add(comp[k])
                    j = int(own[k])
                    yield (i, m, i, j, mark, stand_[k][4]) if i > j else (i, m, j, i, stand_[k][4], mark)
                    if not exact:
                        break

        def run(batches):
            import pyarrow as pa

            sets = Shingles()

            def out(rows):
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["asker", "matches", "a", "b", "ma", "mb"])

            at, group, found = None, [], []
            for t in batches:
                for key, size, block, turn, *row in zip(*(t.column(i).to_pylist() for i in range(11)), strict=True):
                    if (key, size, block, turn) != at:
                        found += compare(group, sets.of)
                        at, group = (key, size, block, turn), []
                        if len(found) > 5000:
                            yield out(found)
                            found = []
                    group.append(row)
            found += compare(group, sets.of)
            yield out(found)

        return dealt.mapInArrow(common.lean(run), schema)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id of every row; rows are linked from a similarity of NEED percent of their five-word shingles.

    A null or empty text has no shingles and is linked with nothing; with fewer than five words the whole sequence is one
    shingle. Rows of one id count as one document with several texts; a row without id has no component. An empty table
    gives no rows; other columns are ignored.
    """
    return Linker(df, id_col, text_col).run().drop("th").withColumnRenamed("id", id_col)


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that are no near-duplicate of one with a smaller id; rows without text or id stay.

    Rows of one id are told apart by their texts: only the one that has a partner goes.
    """
    found = Linker(df, id_col, text_col).run()
    gone = common.cut(found.where("id <> component_id").select("id", "th").distinct(), "gone")
    gone = gone.select(F.col("id").alias("__id"), F.col("th").alias("__th"))
    return df.join(gone, (F.col(id_col).cast("long") == F.col("__id")) & (F.xxhash64(text_col) == F.col("__th")), "left_anti")


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates of all documents."""
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
