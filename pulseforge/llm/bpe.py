"""BPE encoding and decoding by a pair occurrence index.

All new words of a partition's batch are laid out in one array. An index maps each adjacent pair (by its merge rank) to
all positions that hold it. The active ranks sit in a heap and are applied in ascending order, each to all its
positions at once; only pairs beside a merge are looked up again and put into the lists of their ranks. A merge makes a
token that only later merges use, so this order gives what merging each word for itself gives.
"""

from __future__ import annotations

import gc
import heapq
import itertools
import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseforge.llm import common

#: White space as in Unicode's White_Space property.
SPACES = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


#: Marks that often end a word; each run of them is one word of its own.
MARKS = ".,;:!?"

#: Characters of text whose new words are encoded at once.
LOT_CHARS = 8 << 20


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from U+0100."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(other)) for b in range(256)]


def load_tables(path: str) -> dict:
    """Arrays of a tokenizer file, ready to be broadcast; their size is the vocabulary's."""
    spec = json.loads(open(path, encoding="utf-8").read())
    model = spec["model"]
    vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    chars = byte_chars()
    made: dict[str, int] = {}
    keys, new, ordered = [], [], True
    for rank, (a, b) in enumerate(merges):
        if a not in vocab or b not in vocab or a + b not in vocab:
            raise ValueError(f"merge {rank} has a token that the vocabulary lacks")
        ordered &= made.get(a, -1) < rank and made.get(b, -1) < rank and a + b not in made
        made[a + b] = rank
        keys.append(vocab[a] << 32 | vocab[b])
        new.append(vocab[a + b])
    used = {x for m in merges for x in m}
    ordered &= all(rank < next_ for rank, next_ in _first_uses(merges, made, used))
    if not ordered:
        raise ValueError("a merge uses a token that a later merge makes; ranks can't be applied to all positions at once")
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    names = [""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
    for token, i in vocab.items():
        names[i] = token
    for t in spec["added_tokens"]:
        names[t["id"]] = t["content"]
    byte, end = [vocab[c] for c in chars], [vocab[c + suffix] for c in chars]
    at = {k: i for i, k in enumerate(keys)}
    pairs = np.array([[at.get(a << 32 | b, -1) for a in byte for b in second] for second in (byte, end)], dtype=np.int32)
    return {
        "pairs": pairs,
        "first": np.array([vocab[c] for c in chars], dtype=np.int32),
        "last": np.array([vocab[c + suffix] for c in chars], dtype=np.int32),
        "keys": np.array(keys, dtype=np.int64)[order],
        "ranks": order.astype(np.int32),
        "new": np.array(new, dtype=np.int32),
        "names": names,
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
        "lower": spec.get("normalizer") is not None,
        "spaced": spec.get("normalizer") is None,
    }


def _first_uses(merges, made, used):
    """(rank that makes a token, lowest rank that uses it)."""
    first: dict[str, int] = {}
    for rank, pair in enumerate(merges):
        for x in pair:
            first.setdefault(x, rank)
    return [(made[x], first[x]) for x in used if x in made]


def encode_words(t: dict, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and how many each has. Words hold at least one byte."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    n = len(raw)
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    ids = t["first"][raw]
    ids[ends] = t["last"][raw[ends]]
    nxt = np.arange(1, n + 1, dtype=np.int32)
    nxt[ends] = -1
    prv = np.arange(-1, n - 1, dtype=np.int32)
    prv[starts] = -1
    keys, ranks, new = t["keys"], t["ranks"], t["new"]

    def rank_of(at: np.ndarray) -> np.ndarray:
        """Merge rank of the pair that begins at each position, or -1."""
        right = nxt[at]
        pair = ids[at].astype(np.int64) << 32 | ids[right]
        k = np.searchsorted(keys, pair)
        k[k == len(keys)] = 0
        return np.where((keys[k] == pair) & (right >= 0), ranks[k], -1)

    rank = np.full(n, -1, dtype=np.int32)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(at: np.ndarray, r: np.ndarray) -> None:
        """Put positions into the lists of their ranks."""
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        cuts = np.flatnonzero(np.diff(r)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(r)], strict=True):
            k = int(r[lo])
            if k not in index:
                index[k] = []
                heapq.heappush(heap, k)
            index[k].append(at[lo:hi])

    if n > 1:
        pair = raw[:-1].astype(np.int32) << 8 | raw[1:]
        final = np.zeros(n, bool)
        final[ends] = True
        rank[:-1] = np.where(final[:-1], -1, np.where(final[1:], t["pairs"][1][pair], t["pairs"][0][pair]))
    at = np.flatnonzero(rank >= 0).astype(np.int32)
    if len(at):
        enter(at, rank[at])
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[rank[at] == r]
        if not len(at):
            continue
        if len(at) > 1:  # a position whose left neighbour takes it part in the same pair (aaa): leftmost goes first
            clash = np.flatnonzero(nxt[at[:-1]] == at[1:])
            if len(clash):
                keep = np.ones(len(at), bool)
                for i in clash.tolist():
                    if keep[i]:
                        keep[i + 1] = False
                at = at[keep]
        gone = nxt[at]
        after = nxt[gone]
        ids[at] = new[r]
        rank[gone] = -1
        ids[gone] = -1
        nxt[at] = after
        has = after >= 0
        prv[after[has]] = at[has]
        before = prv[at]
        near = np.concatenate([at, before[before >= 0]])
        found = rank_of(near)
        rank[near] = found
        hit = found >= 0
        if hit.any():
            enter(near[hit], found[hit])
    alive = ids >= 0
    return ids[alive], np.add.reduceat(alive.astype(np.int64), starts)


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of pool one after the other."""
    shift = starts - (np.cumsum(sizes) - sizes)
    return pool[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]


class Encoder:
    """Encodes texts with a cache of chunks (what stands between white space) that is emptied when it is full."""

    def __init__(self, tables: dict, most: int = 600_000):
        import regex

        self.t, self.most = tables, most
        self.clear()
        self.special = regex.compile("|".join(map(regex.escape, sorted(tables["special"], key=len, reverse=True)))) if tables["special"] else None
        self.words = (
            regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACES}\p{{L}}\p{{N}}]+")
            if tables["lower"]
            else regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
        )
        self.odd = re.compile(rf"[\x01\t\x0b-\r\x1c-\x1f{SPACES[4:]}]")
        self.gap = regex.compile(rf"[{SPACES}]+")

    def split(self, text: str) -> list[str]:
        """Keys of chunks whose encodings, joined, are the text's; chunk() tells what a key stands for."""
        if self.t["lower"]:
            if self.odd.search(text):
                return [x for x in self.gap.split(text) if x]
            return text.split()
        if "  " in text or " \n" in text or "\n\n\n" in text or text.endswith("\n\n") or self.odd.search(text):
            return ["\x01" + text]
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = "\x01" + parts[0]
        return parts

    def chunk(self, key: str) -> str:
        """A key stands for itself if it begins with a line end or texts are spaced out anyway, for its rest after \\x01, and else for a blank and itself."""
        if self.t["lower"] or key[:1] == "\n":
            return key
        return key[1:] if key[:1] == "\x01" else " " + key

    def learn(self, keys: set[str]) -> None:
        """Encode keys that the cache lacks."""
        fresh = [c for c in keys if c not in self.index]
        if not fresh:
            return
        if len(self.index) + len(fresh) > self.most:
            self.clear()
            fresh = list(keys)
        lower = self.t["lower"]
        text = "\n".join(fresh)
        special = self.special if any(x in text for x in self.t["special"]) else None
        lows = self.normal(text).split("\n") if lower else fresh
        cores = [k.rstrip(MARKS) for k in lows]
        plain = list(map(str.isalpha, cores))  # most keys are letters, then perhaps marks: two words
        first = list(itertools.compress(cores, plain))
        words = dict.fromkeys(first if lower else map(" ".__add__, first))
        words = dict(zip(words, range(1, len(words) + 1), strict=True))
        number = words.setdefault
        flat = np.zeros((len(first), 2), np.int64)
        flat[:, 0] = list(map(words.__getitem__, first if lower else map(" ".__add__, first)))
        tails = [k[len(c) :] for k, c in zip(itertools.compress(lows, plain), first, strict=True)]
        marks = {t: number(t, len(words) + 1) if t else 0 for t in set(tails)}
        flat[:, 1] = list(map(marks.__getitem__, tails))
        rest: list[int] = []
        sizes: list[int] = []
        odd = [k for k, ok in zip(fresh, plain, strict=True) if not ok]
        for key in odd:
            at, lo, c = len(rest), 0, self.chunk(key)
            if c[:1] == "\n" and (core := c[1:].rstrip(MARKS)).isalpha():
                rest += (number("\n", len(words) + 1), number(core, len(words) + 1))
                rest.append(number(c[1 + len(core) :], len(words) + 1) if len(core) + 1 < len(c) else 0)
                sizes.append(3)
                continue
            for h in special.finditer(c) if special else ():
                rest += [number(w, len(words) + 1) for w in self.find(c[lo : h.start()])]
                rest.append(-1 - self.t["special"][h[0]])
                lo = h.end()
            rest += [number(w, len(words) + 1) for w in self.find(c[lo:])]
            rest.append(0)
            sizes.append(len(rest) - at)
        fresh = [*itertools.compress(fresh, plain), *odd]
        sizes = np.concatenate([np.full(len(first), 2, np.int64), np.array(sizes, np.int64)])
        plan = np.concatenate([flat.ravel(), np.array(rest, np.int64)])
        ids, counts = encode_words(self.t, [w.encode("utf-8", "surrogatepass") for w in words])
        counts = np.concatenate([[0], counts, [1]])
        starts = np.cumsum(counts) - counts
        token = plan < 0
        at = np.where(token, len(counts) - 1, plan)
        made = gather(np.append(ids, 0).astype(np.int32), starts[at], counts[at])
        held = counts[at]
        if token.any():
            made[(np.cumsum(held) - held)[token]] = -1 - plan[token]
        held = np.add.reduceat(held, np.cumsum(sizes) - sizes)
        self.index.update(zip(fresh, range(len(self.starts), len(self.starts) + len(fresh)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(held) - held])
        self.sizes = np.concatenate([self.sizes, held])
        self.pool = np.concatenate([self.pool, made])

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.pool, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, part: str) -> list[str]:
        """Words of a part without special tokens."""
        return self.words.findall(self.normal(part) if self.t["lower"] else part)

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then lower case character by character."""
        if text.isascii():
            return text.lower()
        import unicodedata

        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # Python's one rule by context is the final sigma

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        held = gc.isenabled()
        gc.disable()  # millions of new objects, none of them in cycles
        try:
            split = list(map(self.split, texts))
            self.learn(set().union(*split))
            n = np.fromiter(map(len, split), np.int64, len(split))
            at = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(n.sum()))
        finally:
            if held:
                gc.enable()
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(n)]
        return gather(self.pool, self.starts[at], sizes), np.diff(ends, prepend=0)


def encode_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of every row: columns id_col, ids array<int>, decoded string.

    A null text counts as empty and gives no ids and an empty decoded text. Repeated rows and null ids are kept as they
    are, other columns are ignored. A very long text is handled whole. Decoding joins the tokens' strings by one space,
    as for a tokenizer file without decoder.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(load_tables(tokenizer_path))

    def work(parts):
        import pyarrow as pa

        encoder, names = Encoder(sent.value), sent.value["names"]
        for keys, texts in parts:
            ids, sizes = encoder.encode([x or "" for x in texts])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            strung = list(map(names.__getitem__, ids.tolist()))
            decoded = pa.array([" ".join(strung[i:j]) for i, j in itertools.pairwise(ends.tolist())], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), decoded], names=["key", "ids", "decoded"])

    rows = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return common.map_rows(rows, ["key", "text"], work, f"key {kind}, ids array<int>, decoded string", LOT_CHARS).withColumnRenamed("key", id_col)


def decode_ids(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decoded text of arrays of ids: id_col, decoded string. Null or empty arrays give an empty text; an unknown id is skipped."""
    names = load_tables(tokenizer_path)["names"]
    sent = df.sparkSession.sparkContext.broadcast(names)

    def run(batches):
        import pyarrow as pa

        names = sent.value
        for b in batches:
            out = [" ".join([names[i] for i in ids or [] if i is not None and 0 <= i < len(names)]) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["key", "decoded"])

    rows = df.select(F.col(id_col).alias("key"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, decoded string").withColumnRenamed("key", id_col)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded texts of all documents."""
    import public_tokenizers

    out = encode_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
