"""Deletion of repeated lines and runs by winnowing over line hashes.

Hashed lines are of two kinds: the lines that line ends make, and, because copied passages begin and end inside those,
the rolling lines of LINE words from each word on. A window of the first kind is one line, as a single line may be a
copy; a window of the second kind is RUN words, and its least rolling line is its fingerprint, so that two equal
windows always have the same one. The windows that follow each other with one fingerprint make a stretch of words.

1. Places of lines and stretches are joined by content with the first place; later ones go as a whole.
2. Where one fingerprint lies in unequal stretches (a copy begins or ends there, or was edited), the match is extended
   both ways from it: each window of RUN words that holds the fingerprint is joined with its first place.

So a word goes exactly if it stands in a line of at least LEAST words that is an earlier line, or in a window of RUN
words that stands earlier: in a text of a smaller id, or in the same text before it (windows of one text may overlap).
Lines and windows are equal if 96 bits of the xxh3-128 of their folded bytes are. Only numbers are shuffled, besides the
texts that have something to extend or to delete.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseforge.llm import common

#: Words of the shortest line that goes alone, of a window, and of a rolling line.
LEAST, RUN, LINE = 3, 50, 8

#: Bytes that part words become 0, A-Z become a-z; digits, letters and bytes from 0x80 stay.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 0 for b in range(256)], np.uint8)

#: Bytes whose words are hashed at once.
BLOCK = 1 << 20
#: Low bits of a key of the least rolling line: its place, so that of equal lines the first is taken.
PLACE = np.uint64(28)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        a = np.full(n + 1, b, np.uint64)
        a[0] = 1
        both.append(np.cumprod(a))
    return both[0], both[1]


def _mix(h: np.ndarray) -> np.ndarray:
    for shift, times in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of a column of texts: starts and ends in bytes, hashes, and the texts' bounds in words."""

    #: Odd bases of the sums that hash bytes to words and words to rolling lines.
    BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    _bytes = _mix(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def __init__(self, texts, hashed: bool = True):
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
        self.at = at - at[0]
        folded = FOLD[self.data]
        inside = folded != 0
        edge = np.zeros(len(folded) + 1, bool)  # a text begins here
        edge[self.at] = True
        before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1] if len(inside) else inside
        after = np.concatenate([inside[1:], [False]]) & ~edge[1:] if len(inside) else inside
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, self.at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        if hashed:
            self.hash(folded)

    @classmethod
    def powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if base not in cls._tables or len(cls._tables[base][0]) <= n:
            cls._tables[base] = _powers(base, max(n, 1 << 16) * 3 // 2)
        return cls._tables[base]

    def hash(self, folded: np.ndarray) -> None:
        n = len(self.starts)
        words = np.zeros(n, np.uint64)
        cuts = np.unique(np.concatenate([np.searchsorted(self.starts, np.arange(0, len(folded) + BLOCK, BLOCK)), [n]]))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            a, b = int(self.starts[lo]), int(self.ends[hi - 1])
            up, down = self.powers(self.BASES[0], b - a)
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(self._bytes[folded[a:b]] * up[: b - a], out=sums[1:])
            s, e = self.starts[lo:hi] - a, self.ends[lo:hi] - a
            words[lo:hi] = (sums[e] - sums[s]) * down[s]
        words = _mix(words + (self.ends - self.starts).astype(np.uint64))
        up, down = self.powers(self.BASES[1], n)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * up[:n])]), down
        # the words with one blank behind each
        size = self.ends - self.starts
        self.begin = np.cumsum(size + 1) - size - 1
        inside = folded != 0
        self.compact = np.zeros(int(size.sum()) + n, np.uint8)
        self.compact[np.arange(int(size.sum())) + np.repeat(np.arange(n), size)] = folded[inside]

    def rolling(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of the words from lo to before hi, by sums; they only choose fingerprints, and equal ones needn't be equal words."""
        sums, down = self.sums
        return _mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))

    def digests(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of the xxh3-128 of the folded bytes of the words from lo to before hi, with one blank between words; together they tell stretches apart."""
        import xxhash

        if not len(lo):
            return np.zeros(0, np.uint64), np.zeros(0, np.int32)
        view, digest = memoryview(self.compact), xxhash.xxh3_128_digest
        told = b"".join([digest(view[i:j]) for i, j in zip(self.begin[lo].tolist(), (self.begin[hi - 1] + self.ends[hi - 1] - self.starts[hi - 1]).tolist(), strict=True)])
        both = np.frombuffer(told, np.uint64).reshape(-1, 2)
        return both[:, 0].copy(), (both[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Word ranges of the lines of at least LEAST words."""
        if not len(self.starts):
            return (np.zeros(0, np.int64),) * 2
        line = np.searchsorted(np.flatnonzero((self.data == 10) | (self.data == 13)), self.starts)
        first = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (self.doc[1:] != self.doc[:-1])]))
        last = np.append(first[1:], len(line))
        keep = last - first >= LEAST
        return first[keep], last[keep]

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ranges of the windows that follow each other with one fingerprint, and the fingerprint."""
        n = len(self.starts)
        if n < RUN:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(n - LINE + 1)
        h = self.rolling(at, at + LINE)
        key = h >> PLACE << PLACE | at.astype(np.uint64)
        width, done = RUN - LINE + 1, 1
        while done < width:
            step = min(done, width - done)
            key = np.minimum(key[:-step], key[step:])
            done += step
        at = np.flatnonzero(self.doc[: n - RUN + 1] == self.doc[RUN - 1 :])
        if not len(at):
            return at, at, np.zeros(0, np.uint64)
        least = (key[at] & np.uint64((1 << 28) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1])]))
        last = np.append(first[1:], len(at)) - 1
        return at[first], at[last] + RUN, h[least[first]]


def marks(words: Words) -> tuple[np.ndarray, ...]:
    """digests, fingerprint (0 for lines), lo and hi of all lines and stretches, in words of the whole column, and whether an equal one stands earlier in the same text."""
    a, b = words.lines()
    s, e, f = words.stretches()
    lo, hi = np.concatenate([a, s]), np.concatenate([b, e])
    f = np.concatenate([np.zeros(len(a), np.uint64), np.maximum(f, np.uint64(1)) if len(f) else f])
    h, c = words.digests(lo, hi)
    return h, c, f, lo, hi, repeated_inside(words.doc[lo] if len(lo) else lo, lo, h, c, f != 0)


def repeated_inside(doc: np.ndarray, lo: np.ndarray, h: np.ndarray, c: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether an equal one (of the same kind) begins earlier in the same text."""
    again = np.zeros(len(lo), bool)
    if len(lo) > 1:
        order = np.lexsort((lo, kind, h, doc))
        x, y = order[1:], order[:-1]
        again[x] = (h[x] == h[y]) & (c[x] == c[y]) & (doc[x] == doc[y]) & (kind[x] == kind[y])
    return again


def _places(docs: DataFrame) -> DataFrame:
    """Lines and stretches: digests h and c, fingerprint f (null for lines), id, th, lo, hi. Rows without h are repeated inside their text."""

    def run(batches):
        import pyarrow as pa

        for ids, ths, texts in common.arrays(batches, ["id", "th", "text"]):
            words = Words(texts)
            h, c, f, lo, hi, own = marks(words)
            doc = words.doc[lo]
            base = words.bounds[doc]
            doc = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h.view(np.int64), mask=own), pa.array(c, mask=own), pa.array(f.view(np.int64), mask=own | (f == 0)),
                    ids.take(doc), ths.take(doc), pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32)),
                ],
                names=["h", "c", "f", "id", "th", "lo", "hi"],
            )

    return docs.mapInArrow(common.lean(run), "h long, c int, f long, id long, th long, lo int, hi int")


def _windows(rows: DataFrame) -> DataFrame:
    """Windows of RUN words inside the parts (lo, hi) of each text: digests h and c, id, th, lo. Rows without h are repeated inside their text."""

    def run(batches):
        import pyarrow as pa

        for ids, ths, texts, parts in common.arrays(batches, ["id", "th", "text", "parts"]):
            words = Words(texts)
            doc, first, last = unpacked(parts)
            n = np.maximum(last - first - RUN + 1, 0)
            at = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            doc = np.repeat(doc, n)
            lo = at + words.bounds[doc]
            h, c = words.digests(lo, lo + RUN)
            own = repeated_inside(doc, lo, h, c, np.zeros(len(lo), bool))
            doc = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64), mask=own), pa.array(c, mask=own), ids.take(doc), ths.take(doc), pa.array(at.astype(np.int32))],
                names=["h", "c", "id", "th", "lo"],
            )

    return rows.select("id", "th", "text", "parts").mapInArrow(common.lean(run), "h long, c int, id long, th long, lo int")


def packed(lo, hi):
    """A range of words in one long."""
    return F.shiftleft(F.col(lo).cast("long"), 32).bitwiseOR(F.col(hi).cast("long") if isinstance(hi, str) else hi.cast("long"))


def unpacked(ranges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, lo and hi of a column of lists of packed ranges."""
    flat = ranges.flatten().to_numpy()
    counts = np.diff(ranges.offsets.to_numpy())
    if ranges.null_count:
        counts = np.where(ranges.is_valid().to_numpy(zero_copy_only=False), counts, 0)
    return np.repeat(np.arange(len(ranges)), counts), flat >> 32, flat & 0xFFFFFFFF


def _told(rows: DataFrame) -> DataFrame:
    """Rows (h, c, id, ...) whose content stands in more than one place, and `first`: the least id that has it. Sums by content are combined before the shuffle; a hot content's rows are split by the join."""
    first = rows.groupBy("h", "c").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    return rows.join(first, ["h", "c"])


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th (hash of the text: rows of one id are told apart by their texts) and text of the rows that have both."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).where("id is not null and text is not null")


def repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th, lo, hi: lines and runs of words (from lo to before hi) that also stand earlier; they may overlap. th is xxhash64 of the text."""
    docs = _keyed(df, id_col, text_col)
    rows = common.cut(_places(docs), "places")
    own = rows.where("h is null").select("id", "th", "lo", "hi")
    told = common.cut(_told(rows.where("h is not null")).where("id > first or f is not null").select("id", "th", "lo", "hi", "f", (F.col("id") > F.col("first")).alias("later")), "told")
    later = told.where("later").select("id", "th", "lo", "hi")
    # fingerprints in unequal stretches: the first place of each stretch is enough, the others are later as a whole
    held = told.where("not later and f is not null")
    unequal = held.groupBy("f").count().where("count > 1").select("f")
    parts = held.join(unequal, "f", "left_semi").groupBy("id", "th").agg(F.collect_set(packed("lo", "hi")).alias("parts"))
    parts = common.cut(parts, "parts")
    texts = common.MemberBits(parts.select("id"), "id").keep(docs, "id").join(parts, ["id", "th"])
    whole = common.cut(_windows(texts), "windows")
    extended = whole.where("h is null").unionByName(_told(whole.where("h is not null")).where("id > first").select(*whole.columns)).select("id", "th", "lo", (F.col("lo") + RUN).cast("int").alias("hi"))
    return own.unionByName(later).unionByName(extended)


def without(words: Words, row: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """The texts without the words of the ranges (row, lo, hi) and what stands behind each run up to the next word, and how many words went from each.

    A line end stays where a run begins inside a line and reaches over its end.
    """
    import pyarrow as pa

    first, size, n = words.bounds[row], np.diff(words.bounds)[row], len(words.starts)
    lo, hi = np.clip(lo, 0, size) + first, np.clip(hi, 0, size) + first
    some = hi > lo
    steps = np.bincount(lo[some], minlength=n + 1) - np.bincount(hi[some], minlength=n + 1)
    gone = np.cumsum(steps)[:n] > 0
    # runs of words that go, cut where texts begin
    text = words.doc
    join = np.concatenate([[False], gone[:-1] & (text[1:] == text[:-1])]) if n else gone
    nxt = np.concatenate([gone[1:] & (text[1:] == text[:-1]), [False]]) if n else gone
    i, j = np.flatnonzero(gone & ~join), np.flatnonzero(gone & ~nxt) + 1
    d = text[i]
    heads, tails = i == words.bounds[d], j == words.bounds[d + 1]
    begin = np.where(heads, words.at[d], words.starts[i])
    end = np.where(tails, words.at[d + 1], words.starts[np.minimum(j, max(n - 1, 0))]) if n else begin
    size = len(words.data)
    keep = np.cumsum(np.bincount(begin, minlength=size + 1) - np.bincount(end, minlength=size + 1))[:size] <= 0
    line = np.flatnonzero(words.data == 10)
    ends = lambda x: np.searchsorted(line, x)  # noqa: E731  line ends before a byte
    inside = ~heads & ~tails & (ends(end) > ends(begin))
    inside[inside] &= ends(words.starts[i[inside]]) == ends(words.ends[i[inside] - 1])
    keep[line[ends(end[inside]) - 1]] = True
    at = np.concatenate([[0], np.cumsum(keep)])[words.at]
    made = pa.Array.from_buffers(pa.large_string(), len(words.at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(words.data[keep])])
    return made, np.bincount(text[gone], minlength=len(words.at) - 1)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with lines and runs that stand earlier deleted from text_col, and words_removed (long).

    All columns and rows of df stay (a text may become empty); a column words_removed of df is replaced. Null and empty
    texts, texts of fewer than LEAST words and rows without id stay as they are (words_removed is 0). Rows of one id are
    told apart by their texts and lose nothing to each other, so a repeated row loses nothing to its twin.
    An empty table gives no rows.
    """
    df = df.drop("words_removed") if "words_removed" in df.columns else df
    runs = repeated_runs(df, id_col, text_col)
    spans = common.cut(runs.groupBy("id", "th").agg(F.collect_list(packed("lo", "hi")).alias("runs")), "runs")
    has = common.MemberBits(spans.select("id"), "id")
    rows = has.split(df.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th")), "id")
    plain = rows.where("not __may").select("row.*", F.lit(0).cast("long").alias("words_removed"))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for row, texts, runs in common.whole_rows(batches, text_col, ["runs"]):
            new, gone = without(Words(texts, hashed=False), *unpacked(runs))
            new = pc.if_else(texts.is_valid(), new.cast(texts.type), texts)
            yield pa.RecordBatch.from_arrays([*(new if n == text_col else row.field(n) for n in names), pa.array(gone)], names=[*names, "words_removed"])

    names = df.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    edited = rows.where("__may").drop("__may").join(spans, ["id", "th"], "left").select("row", "runs").mapInArrow(common.lean(run), f"{kinds}, words_removed long")
    return plain.unionByName(edited)


def op3_linededup(spark, sf_dir: str) -> DataFrame:
    """All documents without their repeated lines and runs."""
    return dedup_lines(common.table(spark, sf_dir, "documents")).select("doc_id", "text", "words_removed")
