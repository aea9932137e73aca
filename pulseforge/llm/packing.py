"""Packing of token sequences by non-negative least squares over a length histogram.

A document's ids are cut into whole windows and one rest. The rests are counted by length class, all combinations of at
most three classes that fill a window are enumerated, and non-negative least squares gives each combination's repeat
count against the histogram. The counts are rounded and dealt out; rests that no combination took are cut greedily
into the free room of the combinations and then into further windows. What is left at the end of a partition goes to
sequences of a power of two.

Each partition packs its own documents a few million tokens at a time (the rest goes on to the next lot), so nothing is
shuffled, memory doesn't depend on the partition's size, and a lost task gives the same sequences again.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseforge.llm import bpe, common

#: Length classes of a window, tokens that a lot holds, and the id that ends a document.
CLASSES, LOT, END_ID = 64, 2 << 20, 1
#: Characters of text that are encoded at once.
CHUNK = 2 << 20


def combinations(classes: int = CLASSES, depth: int = 3) -> np.ndarray:
    """Rows: how many rests of each class (1..classes) a combination has; each fills the window and has at most depth parts."""
    found = []
    for parts in range(1, depth + 1):
        for c in itertools.combinations_with_replacement(range(1, classes + 1), parts):
            if sum(c) == classes:
                found.append(np.bincount(c, minlength=classes + 1)[1:])
    return np.array(found, dtype=np.float64)


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |ax - b|, by the active set method.

    Each step frees a column and lowers |ax - b|, so no set of free columns comes twice and the loop ends by itself; the
    guard against rounding (a step that lowers nothing) ends it at the best x found.
    """
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    gram, ab = a.T @ a, a.T @ b
    tol = 1e-8 * max(1.0, float(np.abs(ab).max(initial=0)))
    left = np.inf
    while True:
        w = ab - gram @ x
        if left <= (left := float(((a @ x - b) ** 2).sum())):
            break
        w[free] = -np.inf
        k = int(np.argmax(w))
        if w[k] <= tol:
            break
        free[k] = True
        while True:
            at = np.flatnonzero(free)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            bad = z <= 0
            old = x[at]
            step = (old[bad] / np.maximum(old[bad] - z[bad], 1e-300)).min()
            x[at] = old + step * (z - old)
            free[at[(x[at] <= 1e-12) & bad]] = False
            if not free.any():
                break
    return x


class Packer:
    """Packs documents that are given lot by lot. pieces: (key, start, ids, total, sequence, offset)."""

    def __init__(self, window: int, first: int):
        self.window, self.next = window, first
        self.unit = max(1, -(-window // CLASSES))
        self.sets = combinations(-(-window // self.unit))
        #: Long rests are harder to place later, so their misfit counts more.
        self.weight = np.linspace(0.2, 1.0, self.sets.shape[1])
        self.rests: list[tuple] = []
        self.held = 0

    def sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, key, ids: bytes):
        """Yield the document's whole windows; keep its rest."""
        total, w = len(ids) // 4, self.window
        whole = total // w * w
        for lo in range(0, whole, w):
            yield key, lo, ids[lo * 4 : (lo + w) * 4], total, self.sequence(), 0
        if total > whole:
            self.rests.append((key, whole, ids[whole * 4 :], total))
            self.held += total - whole

    def flush(self, last: bool):
        """Pack the rests; without last, what doesn't fill a window is kept."""
        w, rests = self.window, self.rests
        bins: list[list[int]] = [[] for _ in range(self.sets.shape[1])]
        for i in range(len(rests) - 1, -1, -1):
            bins[-(-len(rests[i][2]) // 4 // self.unit) - 1].append(i)
        counts = np.array(list(map(len, bins)), dtype=np.float64)
        repeat = np.rint(nnls((self.sets * self.weight).T, counts * self.weight)).astype(int)
        groups: list[list[int]] = []
        for k in np.argsort(-repeat, kind="stable").tolist():
            if repeat[k] <= 0:
                break
            need = self.sets[k].astype(int)
            at = np.flatnonzero(need).tolist()
            for _ in range(repeat[k]):
                if any(len(bins[j]) < need[j] for j in at):
                    break
                groups.append([bins[j].pop() for j in at for _ in range(need[j])])
        loose = [i for b in reversed(bins) for i in reversed(b)]
        size = [len(r[2]) // 4 for r in rests]
        room = sum(w - sum(size[i] for i in g) for g in groups)
        left = sum(size[i] for i in loose)
        while groups and room > left:  # too little to fill all free room: take combinations apart again
            g = groups.pop()
            taken = sum(size[i] for i in g)
            room, left, loose = room - (w - taken), left + taken, loose + g
        stream = iter(loose)
        current, at = None, 0

        def fill(number: int, offset: int, length: int):
            """Cut pieces from the loose rests until length tokens are placed."""
            nonlocal current, at
            while length:
                if current is None:
                    current, at = rests[next(stream)], 0
                key, start, ids, total = current
                n = min(length, len(ids) // 4 - at)
                yield key, start + at, ids[at * 4 : (at + n) * 4], total, number, offset
                at, offset, length = at + n, offset + n, length - n
                if at * 4 == len(ids):
                    current = None

        for g in groups:
            number, offset = self.sequence(), 0
            for i in g:
                key, start, ids, total = rests[i]
                yield key, start, ids, total, number, offset
                offset += size[i]
            yield from fill(number, offset, w - offset)
        left -= room
        while left >= w:
            yield from fill(self.sequence(), 0, w)
            left -= w
        power = 1 << w.bit_length()
        while last and left:
            if power <= left:
                yield from fill(self.sequence(), 0, power)
                left -= power
            else:
                power >>= 1
        self.rests, self.held = [], 0
        if left:
            if current is not None:
                key, start, ids, total = current
                self.rests.append((key, start + at, ids[at * 4 :], total))
            self.rests += [rests[i] for i in stream]
            self.held = left


def load_encoder(path: str) -> dict:
    """What a task needs to encode as the tokenizer file does: for byte-level merges in the order of their ids the tokens' bytes and special tokens, else the tables of bpe."""
    import json

    spec = json.loads(open(path, encoding="utf-8").read())
    model, special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    level = (spec.get("pre_tokenizer") or {}).get("type"), spec.get("normalizer"), model.get("end_of_word_suffix")
    merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    byte = {c: b for b, c in enumerate(bpe.byte_chars())}
    letters = [model["vocab"].get(c, -1) for c in byte]
    if level != ("ByteLevel", None, None) or letters == [] or min(letters) < 0 or max(letters) >= merged[0] or any(x >= y for x, y in itertools.pairwise(merged)):
        return {"tables": bpe.load_tables(path)}
    ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}
    return {"ranks": ranks, "special": special, "pattern": rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+(?!\S)|\s+"}


def encoder_of(loaded: dict):
    """A function from texts to the ids of all, one after the other as unsigned 32-bit integers, and how many each has."""
    if "tables" in loaded:
        return bpe.Encoder(loaded["tables"]).encode
    import tiktoken

    own = tiktoken.Encoding("packing", pat_str=loaded["pattern"], mergeable_ranks=loaded["ranks"], special_tokens=loaded["special"])

    def encode(texts: list[str]):
        parts = [own.encode_to_numpy(t, allowed_special="all") for t in texts]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.fromiter(map(len, parts), np.int64, len(parts))

    return encode


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = END_ID) -> DataFrame:
    """Pack every document's ids and an end id into sequences of at most window tokens (a power of two).

    Returns a row per piece: id_col, start, length, ids (binary, unsigned little-endian 32-bit), doc_tokens, sequence_id,
    offset. A null or empty text is its end id alone; repeated rows and null ids are packed like others; an empty table
    gives no rows; other columns are ignored. Sequences are full or of a power of two, so there is no padding.
    """
    sent = df.sparkSession.sparkContext.broadcast(load_encoder(tokenizer_path))
    end = int(end_id).to_bytes(4, "little")

    def work(parts):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder_of(sent.value)
        packer = Packer(window, TaskContext.get().partitionId() << 32)
        kind = None

        def batch(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), pa.array([len(x) // 4 for x in cols[2]], pa.int64()), pa.array(cols[2], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[3:])],
                names=["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        def flat(parts):
            nonlocal kind
            for keys, texts in parts:
                kind = kind or pa.array(keys).type
                ids, sizes = encode([x or "" for x in texts])
                raw, at = ids.astype("<u4").tobytes(), 0
                for key, n in zip(keys, (sizes * 4).tolist(), strict=True):
                    yield from packer.add(key, raw[at : at + n] + end)
                    at += n
                    if packer.held >= LOT:
                        yield from packer.flush(False)
            yield from packer.flush(True)

        rows = flat(parts)
        while out := list(itertools.islice(rows, 2000)):
            yield batch(out)

    rows = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = common.map_rows(rows, ["key", "text"], work, f"key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long", CHUNK)
    return out.withColumnRenamed("key", id_col)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with a checksum of their ids."""
    import public_tokenizers

    out = pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
