"""Language identification by interpolated Kneser-Ney character models.

Words (runs of letters, lower case, with a boundary before and after) are scored by a character model of order five for
each language. Counts come from all training rows; the models stand in sorted arrays of 64-bit n-gram hashes, one row
for each n-gram and one column for each language, or in slices where they are large. A text gets the language of the lowest cross-entropy per character.
Texts whose lowest cross-entropy is beyond what texts of their length have on calibration rows are rejected.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseforge.llm import common

ORDER = 5
#: Most n-grams that are held at once. A larger model is estimated by joins and scored slice by slice; no n-gram is left out.
MAX_GRAMS = 2_000_000
#: Distinct words that a task holds before it turns them into n-gram counts.
MAX_WORDS = 400_000
#: Distinct words whose n-grams are held at once.
WORDS = 1 << 15
UNDETERMINED = "und"
#: Share of usual rows that may be rejected; shares above the two measured quantiles; rows that a length class needs for a limit of its own.
REJECT, NEAR, FAR, LEAST = 1e-4, 0.10, 0.03, 200
#: Length classes: powers of two of the number of characters.
CLASSES = 32

#: Bytes that can't be part of a word become blanks, A-Z become a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Parts of the text between ASCII characters that aren't letters."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def grams(words: list[bytes]):
    """Events (a letter or the end of a word) of the words: index of the word, and by order the hash, context hash, suffix hash, validity and whether it begins a word."""
    text = "\n" + "\n".join([w.decode("utf-8", "replace") for w in words]).lower() + "\n"
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kinds, inverse = np.unique(cp, return_inverse=True)
    letter = np.array([chr(k).isalpha() for k in kinds.tolist()])[inverse]
    word = np.cumsum(cp == 10) - 1
    word[cp == 10] -= 1  # the end of a word belongs to it
    cp = np.where(letter, cp, 2).astype(np.uint64)
    event = letter.copy()
    event[1:] |= ~letter[1:] & letter[:-1]
    at = np.arange(len(cp))
    start = np.maximum.accumulate(np.where(letter, 0, at))
    start = np.concatenate([[0], start[:-1]])
    dist = at - start
    unit = (cp + np.uint64(1)) * _MUL
    unit ^= unit >> np.uint64(29)
    out, before = [], None
    at = np.flatnonzero(event)
    for k in range(1, ORDER + 1):
        if k == 1:
            h = unit * np.uint64(0xBF58476D1CE4E5B9)
            ctx = sfx = np.zeros(len(h), np.uint64)
        else:
            ctx = np.concatenate([[np.uint64(0)], before[:-1]])
            h = ctx * np.uint64(0xD6E8FEB86659FD93) + unit
            h ^= h >> np.uint64(31)
            sfx = before
        out.append((h[at], ctx[at], sfx[at], dist[at] >= k - 1, dist[at] == k - 1))
        before = h
    return word[at], out


def counted(lang: str, words: dict[bytes, int]):
    """n-gram counts of words as columns lang, n, hash, ctx, sfx, begins, count."""
    word, orders = grams(list(words))
    times = np.fromiter(words.values(), np.int64, len(words))[word]
    for k, (h, ctx, sfx, valid, begins) in enumerate(orders, 1):
        at = np.flatnonzero(valid)
        u, first, inverse = np.unique(h[at], return_index=True, return_inverse=True)
        count = np.bincount(inverse, weights=times[at], minlength=len(u)).astype(np.int64)
        at = at[first]
        yield [lang] * len(u), np.full(len(u), k, np.int32), u.view(np.int64), ctx[at].view(np.int64), sfx[at].view(np.int64), begins[at], count


def parted(words: dict[bytes, int], most: int | None = None):
    """The words in dictionaries of at most WORDS (or `most`)."""
    items = iter(words.items())
    while part := dict(itertools.islice(items, most or WORDS)):
        yield part


def gram_counts(rows: DataFrame) -> DataFrame:
    """n-gram counts by language of rows (text, lang)."""

    def work(parts):
        import gc
        from collections import Counter

        import pyarrow as pa

        gc.disable()
        held: dict[str, Counter] = {}

        def out(langs):
            for lang, words in ((x, part) for x in langs for part in parted(held.pop(x))):
                for cols in counted(lang, words):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["lang", "n", "hash", "ctx", "sfx", "begins", "count"])

        for texts, langs in parts:
            for text, lang in zip(texts, langs, strict=True):
                if words := words_of(text):
                    held.setdefault(lang, Counter()).update(words)
            for lang in [x for x, c in held.items() if len(c) > MAX_WORDS // len(held)]:
                yield from out([lang])
        yield from out(list(held))
        gc.enable()

    parts = common.map_rows(rows, ["text", "lang"], work, "lang string, n int, hash long, ctx long, sfx long, begins boolean, count long")
    return parts.groupBy("lang", "n", "hash").agg(F.sum("count").alias("count"), F.first("ctx").alias("ctx"), F.first("sfx").alias("sfx"), F.first("begins").alias("begins"))


def estimate(langs: list[str], table: dict[str, np.ndarray]) -> dict:
    """Interpolated Kneser-Ney models from columns of counts (lang: index into langs, n, hash, ctx, sfx, begins, count): for each order the sorted hashes, log probabilities and log back-off weights by language."""
    parts, orders, meta = {}, [], []
    for k in range(1, ORDER + 1):
        at = np.flatnonzero(table["n"] == k)
        own = {c: table[c][at] for c in ("lang", "hash", "ctx", "sfx", "begins", "count")}
        keys, first = np.unique(own["hash"], return_index=True)
        orders.append(keys)
        meta.append((own["ctx"][first], own["sfx"][first]))
        for j in range(len(langs)):
            mine = own["lang"] == j
            parts[j, k] = {c: own[c][mine] for c in ("hash", "sfx", "begins", "count")}
    size = len(orders[0]) + 1
    prob = [np.zeros((len(k), len(langs)), np.float32) for k in orders]
    back = [np.zeros((len(k), len(langs)), np.float32) for k in orders]
    none = np.zeros(len(langs), np.float32)
    for j in range(len(langs)):
        lower = None
        for k in range(1, ORDER + 1):
            keys, (ctx, sfx) = orders[k - 1], meta[k - 1]
            t = parts[j, k]
            amount = np.zeros(len(keys))
            at = np.searchsorted(keys, t["hash"])
            amount[at] = t["count"]
            if k < ORDER:  # in how many contexts it stands; what begins a word has none
                left = np.zeros(len(keys))
                up = parts[j, k + 1]["sfx"]
                if len(keys) and len(up):
                    s = np.searchsorted(keys, up)
                    s[s == len(keys)] = 0
                    left = np.bincount(s[keys[s] == up], minlength=len(keys)).astype(float)
                amount[at] = np.where(t["begins"], t["count"], np.maximum(left[at], 1))
            seen = amount > 0
            n1, n2 = (amount == 1).sum(), (amount == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            below = np.full(len(keys), 1 / size) if k == 1 else _at(orders[k - 2], sfx, lower, 1 / size)
            group, inverse = np.unique(ctx, return_inverse=True)
            total = np.bincount(inverse, weights=amount, minlength=len(group))
            kinds = np.bincount(inverse, weights=seen, minlength=len(group))
            weight = np.where(total > 0, d * kinds / np.maximum(total, 1e-300), 1.0)
            lower = np.where(total[inverse] > 0, np.maximum(amount - d * seen, 0) / np.maximum(total[inverse], 1e-300), 0) + weight[inverse] * below
            prob[k - 1][:, j] = np.log(np.maximum(lower, 1e-30))
            if k > 1 and len(group):
                c = np.searchsorted(orders[k - 2], group)
                c[c == len(orders[k - 2])] = 0
                good = orders[k - 2][c] == group
                back[k - 2][c[good], j] = np.log(np.maximum(weight[good], 1e-30))
            elif k == 1:
                none[j] = np.log((weight[0] if len(weight) else 1.0) / size)
    return {"langs": langs, "keys": orders, "prob": prob, "back": back, "none": none}


def _at(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray, other: float) -> np.ndarray:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, values[at], other)


def word_scores(m: dict, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each word by language, and its number of events."""
    word, orders = grams(words)
    n, held = len(word), len(m["langs"])
    score = np.zeros((n, held), np.float32)
    open_ = np.ones(n, bool)
    rows = []
    for k, (h, _, _, valid, _) in enumerate(orders):
        keys = m["keys"][k]
        at = np.searchsorted(keys, h) if len(keys) else np.zeros(n, np.int64)
        at[at == len(keys)] = 0
        rows.append(np.where(valid & (keys[at] == h), at, -1) if len(keys) else np.full(n, -1))
    # the context of an event is the n-gram one shorter that ends at the event before it (at a word's first letter: the boundary, whose hash is no event)
    for k in range(ORDER - 1, -1, -1):
        hit = open_ & (rows[k] >= 0)
        score[hit] += m["prob"][k][rows[k][hit]]
        open_ &= ~hit
        if k:
            c = np.searchsorted(m["keys"][k - 1], orders[k][1])
            c[c == len(m["keys"][k - 1])] = 0
            miss = open_ & orders[k][3] & (m["keys"][k - 1][c] == orders[k][1])
            score[miss] += m["back"][k - 1][c[miss]]
    score[open_] += m["none"]
    size = len(words)
    total = np.stack([np.bincount(word, weights=score[:, j], minlength=size) for j in range(held)], 1) if held else np.zeros((size, 0))
    return total, np.bincount(word, minlength=size)


def fit(rows: DataFrame) -> dict:
    """Models of all rows (text, lang) with text and language."""
    return models_of(common.cut(gram_counts(rows.where("text is not null and lang is not null")), "grams"))


def fit_calibrated(train: DataFrame, calibration: DataFrame, text_col: str = "text"):
    """Models of train and calibration rows together, sent to the executors, and limits of calibration rows by models of train alone."""
    usable = "text is not null and lang is not null"
    own = common.cut(gram_counts(train.where(usable)), "grams")
    model = send(train.sparkSession, models_of(own))
    limits = calibrate(common.cut(cross_entropies(calibration, model, text_col, text_col).drop(text_col), "calibration"))
    model.destroy()
    both = own.unionByName(gram_counts(calibration.where(usable))).groupBy("lang", "n", "hash")
    both = both.agg(F.sum("count").alias("count"), F.first("ctx").alias("ctx"), F.first("sfx").alias("sfx"), F.first("begins").alias("begins"))
    return send(train.sparkSession, models_of(common.cut(both, "grams"))), limits


def models_of(counts: DataFrame) -> dict:
    """Models of counts: arrays as estimate() gives them, or slices."""
    total = counts.count()
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if total > MAX_GRAMS:
        return sliced(counts, langs, -(-total // MAX_GRAMS))
    code = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1 if langs else F.lit(0)
    columns = {"lang": np.int16, "n": np.int8, "hash": np.uint64, "ctx": np.uint64, "sfx": np.uint64, "begins": bool, "count": np.float64}
    rows = counts.select(code.cast("short").alias("lang"), F.col("n").cast("byte").alias("n"), "hash", "ctx", "sfx", "begins", "count").toArrow()
    table = {c: (x.view(kind) if kind == np.uint64 else x.astype(kind)) for c, kind in columns.items() for x in [rows.column(c).to_numpy()]}
    del rows
    return estimate(langs, table)


def gains(counts: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """The models of estimate() by joins, as lang, n, hash and gain, and what an event has at least by language.

    A word's log probability is the sum of the gains of all its n-grams and of that for each event. The gain of an n-gram
    is what it has over backing off from it, and the back-off weight that it gives the event after it as a context.
    """
    left = counts.where("n > 1").groupBy("lang", (F.col("n") - 1).alias("n"), F.col("sfx").alias("hash")).agg(F.count("*").alias("left"))
    amount = F.when((F.col("n") == ORDER) | F.col("begins"), F.col("count")).otherwise(F.coalesce("left", F.lit(1)))
    rows = common.cut(counts.join(left, ["lang", "n", "hash"], "left").select("lang", "n", "hash", "ctx", "sfx", amount.cast("double").alias("amount")), "amounts")
    size = rows.where("n = 1").select("hash").distinct().count() + 1
    ones = rows.groupBy("lang", "n").agg(F.count_if(F.col("amount") == 1).alias("n1"), F.count_if(F.col("amount") == 2).alias("n2"))
    d = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    groups = rows.groupBy("lang", "n", "ctx").agg(F.sum("amount").alias("total"), F.count("*").alias("kinds"))
    groups = groups.join(F.broadcast(ones.select("lang", "n", d.alias("d"))), ["lang", "n"])
    groups = common.cut(groups.select("lang", "n", "ctx", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("weight")), "contexts")
    rows = rows.join(groups, ["lang", "n", "ctx"])
    log = lambda c: F.log(F.greatest(F.col(c), F.lit(1e-30)))
    lower, parts = None, []
    for k in range(1, ORDER + 1):
        own = rows.where(F.col("n") == k)
        own = own.withColumn("below", F.lit(1 / size)) if k == 1 else own.join(lower, ["lang", "sfx"])
        own = own.withColumn("p", F.greatest(F.col("amount") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("below"))
        own = common.cut(own.select("lang", "n", "hash", "p", (log("p") - log("weight") - log("below")).alias("own")), "order")
        lower = own.select("lang", F.col("hash").alias("sfx"), F.col("p").alias("below"))
        parts.append(own.drop("p"))
    back = groups.where("n > 1").select("lang", (F.col("n") - 1).alias("n"), F.col("ctx").alias("hash"), log("weight").alias("back"))
    found = functools.reduce(DataFrame.unionByName, parts).join(back, ["lang", "n", "hash"], "left")
    none = {r["lang"]: math.log(r["weight"] / size) for r in groups.where("n = 1").collect()}
    return found.select("lang", "n", "hash", (F.col("own") + F.coalesce("back", F.lit(0.0))).alias("gain")), none


def sliced(counts: DataFrame, langs: list[str], parts: int) -> dict:
    """A model in parts that are broadcast one by one: for each order the sorted hashes, where their rows begin, and languages and gains of the rows."""
    found, none = gains(counts)
    code = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1
    found = common.cut(found.select(code.cast("short").alias("lang"), F.col("n").cast("byte").alias("n"), "hash", "gain", F.pmod(F.xxhash64("hash"), F.lit(parts)).alias("slice")), "gains")
    sent = []
    for i in range(parts):
        rows = found.where(F.col("slice") == i).select("lang", "n", "hash", "gain").toArrow()
        lang, n, h, gain = (rows.column(c).to_numpy() for c in ("lang", "n", "hash", "gain"))
        h, orders = h.view(np.uint64), []
        for k in range(1, ORDER + 1):
            at = np.flatnonzero(n == k)
            at = at[np.argsort(h[at], kind="stable")]
            keys, first = np.unique(h[at], return_index=True)
            orders.append((keys, np.append(first, len(at)), lang[at], gain[at]))
        del rows
        sent.append(counts.sparkSession.sparkContext.broadcast(orders))
    return {"langs": langs, "none": np.array([none[x] for x in langs]), "slices": sent}


def sliced_scores(m: dict, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """word_scores() of a model in slices, of which one is held at a time."""
    word, orders = grams(words)
    size, held = len(words), len(m["langs"])
    events = np.bincount(word, minlength=size)
    total = np.zeros(size * held)
    for part in m["slices"]:
        for (keys, first, lang, gain), (h, _, _, valid, _) in zip(part.value, orders, strict=True):
            if not len(keys):
                continue
            at = np.searchsorted(keys, h)
            at[at == len(keys)] = 0
            hit = np.flatnonzero(valid & (keys[at] == h))
            at = at[hit]
            many = first[at + 1] - first[at]
            rows = np.repeat(first[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            total += np.bincount(np.repeat(word[hit], many) * held + lang[rows], weights=gain[rows], minlength=size * held)
        vars(part).pop("_value", None)
    return total.reshape(size, held) + events[:, None] * m["none"], events


class Held:
    """A model in slices in place of a broadcast one: the slices are broadcast already."""

    def __init__(self, value: dict):
        self.value = value

    def destroy(self) -> None:
        for part in self.value["slices"]:
            part.destroy()


def send(spark, m: dict):
    """A model for the executors."""
    return Held(m) if "slices" in m else spark.sparkContext.broadcast(m)


def scored_batches(parts, m: dict):
    """For each list of texts: best language, cross-entropy, events and share as arrays."""
    import gc

    import pyarrow as pa

    langs = m["langs"]
    held = gc.isenabled()
    gc.disable()
    for (texts,) in parts:
        split = list(map(words_of, texts))
        index = {w: i for i, w in enumerate(set().union(*split))}
        size = len(texts)
        best, h, n, share = [None] * size, [None] * size, np.zeros(size, np.int64), np.zeros(size)
        if index and langs:
            distinct = list(index)
            if "slices" in m:  # one pass over the slices for all words
                total, events = sliced_scores(m, distinct)
            else:
                told = [word_scores(m, distinct[lo : lo + WORDS]) for lo in range(0, len(distinct), WORDS)]
                total, events = np.concatenate([t for t, _ in told]), np.concatenate([e for _, e in told])
            sizes = np.fromiter(map(len, split), np.int64, size)
            ids = np.fromiter(map(index.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(sizes.sum()))
            has = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[has]
            n[has] = np.add.reduceat(events[ids], starts)
            sums = np.stack([np.add.reduceat(total[:, j][ids], starts) for j in range(len(langs))], 1)
            ok = n[has] > 0
            has, sums = has[ok], sums[ok]
            ent = -sums / n[has][:, None]
            top = ent.argmin(1)
            low = ent[np.arange(len(has)), top] if len(has) else np.zeros(0)
            share[has] = 1 / np.exp(-(ent - low[:, None]) * np.minimum(n[has], 100)[:, None]).sum(1)
            for d, j, x in zip(has.tolist(), top.tolist(), low.tolist(), strict=True):
                best[d], h[d] = langs[j], x
        yield [pa.array(best, pa.string()), pa.array(h, pa.float64()), pa.array(n), pa.array(share)]
    if held:
        gc.enable()


def cross_entropies(df: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Best language, its cross-entropy per character, the number of characters scored, and the share of it among all languages."""

    def work(parts):
        import pyarrow as pa

        for keys, texts in parts:
            for cols in scored_batches([(texts,)], model.value):
                yield pa.RecordBatch.from_arrays([pa.array(keys), *cols], names=["key", "lang_pred", "cross_entropy", "n_scored", "share"])

    rows = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return common.map_rows(rows, ["key", "text"], work, f"key {kind}, lang_pred string, cross_entropy double, n_scored long, share double").withColumnRenamed("key", id_col)


def length_class(n):
    """Power of two of the number of scored characters, CLASSES - 1 at most."""
    return F.least(F.floor(F.log2(F.greatest(n, F.lit(1)))), F.lit(CLASSES - 1)).cast("int")


def calibrate(scored: DataFrame) -> dict[str, list[float]]:
    """By language the greatest cross-entropy that is accepted for each length class.

    The limit is where a share of REJECT of the usual rows would lie above. It is carried on from two measured quantiles
    (shares of NEAR and FAR above them) by an exponential tail, so that garbled rows among the calibration rows, as long
    as they are fewer than FAR, hardly move it. A class with fewer than LEAST rows takes the limit of the nearest one that
    has enough (of two the longer), shorter ones with a distance from the median that grows as the root of the length
    ratio; a language without such a class takes the limit of all its rows. Only a few numbers for each language and
    class come to the driver.
    """
    rows = scored.where("cross_entropy is not null").select("lang_pred", "cross_entropy", length_class(F.col("n_scored")).alias("size"))
    told = F.percentile_approx("cross_entropy", F.array(F.lit(0.5), F.lit(1 - NEAR), F.lit(1 - FAR)), 10_000)
    found = rows.rollup("lang_pred", "size").agg(F.count("*").alias("n"), told.alias("q"), F.grouping_id().alias("level")).where("level < 2").collect()
    steps = math.log(NEAR / REJECT) / math.log(NEAR / FAR)
    measured: dict[str, dict[int | None, tuple[float, float]]] = {}
    for r in found:
        middle, near, far = r["q"]
        if r["level"] == 1 or r["n"] >= LEAST:
            measured.setdefault(r["lang_pred"], {})[None if r["level"] else r["size"]] = (middle, near + steps * (far - near))
    limits = {}
    for lang, by in measured.items():
        own = sorted(c for c in by if c is not None)
        limits[lang] = []
        for c in range(CLASSES):
            at = min(own, key=lambda x: (abs(x - c), -x)) if own else None
            middle, limit = by[at]
            limits[lang].append(middle + (limit - middle) * (2 ** ((at - c) / 2) if at is not None and c < at else 1.0))
    return limits


def identify(df: DataFrame, train: DataFrame, calibration: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every row of df from models of train and calibration rows (text, lang); the limits come from models of train alone.

    Returns id_col, lang_pred, score, cross_entropy, n_scored, accepted. A null text or one without letters is `und`
    with score 0 and rejected; so is every row if train has no language. Equal cross-entropies go to the first language
    in order. Languages, sources and ids are never read from df. Without calibration rows nothing with letters is
    rejected. Rejection: the cross-entropy lies above the limit of its language and length class (see calibrate).
    """
    if calibration is None:
        model, limits = send(df.sparkSession, fit(train)), {}
    else:
        model, limits = fit_calibrated(train, calibration, text_col)
    out = cross_entropies(df, model, id_col, text_col)
    return out.select(
        id_col,
        F.coalesce("lang_pred", F.lit(UNDETERMINED)).alias("lang_pred"),
        F.col("share").alias("score"),
        "cross_entropy",
        "n_scored",
        usual(limits).alias("accepted"),
    )


def usual(limits: dict[str, list[float]]):
    """Whether a row of cross_entropies() is accepted."""
    most = F.lit(None).cast("double")
    for lang, by in limits.items():
        most = F.when(F.col("lang_pred") == lang, F.array(*map(F.lit, by))[length_class(F.col("n_scored"))]).otherwise(most)
    return F.col("lang_pred").isNotNull() & F.coalesce(F.col("cross_entropy") <= most, F.lit(True))


def accept_rows(df: DataFrame, train: DataFrame, calibration: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of df, with all their columns, that identify() accepts."""
    model, limits = fit_calibrated(train, calibration, text_col)
    rows = df.select(F.struct("*").alias("row"))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for row, texts in common.whole_rows(batches, text_col):
            for told in scored_batches([(texts.to_pylist(),)], model.value):
                yield pa.RecordBatch.from_arrays([row, *told[:3]], names=["row", "lang_pred", "cross_entropy", "n_scored"])

    out = rows.mapInArrow(common.lean(run), f"row {kind}, lang_pred string, cross_entropy double, n_scored long")
    return out.where(usual(limits)).select("row.*")


def folds(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that train, and rows that calibrate before they train too: folds 2 to 4, and fold 1; fold 0 is held out."""
    rows = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    return rows.where(common.crc_fold() >= 2), rows.where(common.crc_fold() == 1)


def op5_languages(spark, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    docs = common.table(spark, sf_dir, "documents")
    train, calibration = folds(docs)
    out = identify(docs, train, calibration)
    return out.select("doc_id", F.coalesce(common.crc_fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")
