"""License scans with a generalised suffix automaton over the words of licence templates.

A text's words stream through the automaton, which gives for each place the longest run of words ending there that also
stands in some template (matching statistics). Base phrases are read off the automaton's states. Long maximal matches
that follow each other in the text and in a template are chained to spans; a span that covers enough of its template
gives the template's label.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseforge.llm import common

# Base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Public notices by which licences are named in files.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
]

#: Bytes that part words become blanks, A-Z become a-z; digits, letters and bytes from 0x80 stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


class Automaton:
    """Generalised suffix automaton of token sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for n, seq in enumerate(sequences):
            last = 0
            for at, c in enumerate(seq):
                last = self._extend(last, c)
                self.ends[last].add((n, at))
        for v in sorted(range(1, len(self.link)), key=lambda v: -self.length[v]):
            self.ends[self.link[v]] |= self.ends[v]
        self.ends[0] = set()

    def _new(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        twin = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        cur, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return cur


def build(base: dict[str, str], templates: list[tuple[str, str]]) -> dict:
    """The automaton of all templates and base phrases, as plain tables."""
    labels = [*base.values(), *(x for x, _ in templates)]
    texts = [words_of(x) for x in [*base, *(x for _, x in templates)]]
    ids: dict[bytes, int] = {}
    seqs = [[ids.setdefault(w, len(ids) + 1) for w in t] for t in texts]
    sa = Automaton(seqs)
    size = len(ids) + 1
    pairs = np.zeros(size * size, bool)
    for s in seqs:
        for a, b in itertools.pairwise(s):
            pairs[a * size + b] = True
    phrases: list[list[tuple[int, int]]] = [[] for _ in sa.link]
    for v in sorted(range(1, len(sa.link)), key=lambda v: sa.length[v]):
        up = sa.link[v]
        own = [(len(seqs[n]), n) for n, at in sa.ends[v] if n < len(base) and at == len(seqs[n]) - 1 and sa.length[up] < len(seqs[n]) <= sa.length[v]]
        phrases[v] = phrases[up] + own
    single = {s[0]: n for n, s in enumerate(seqs[: len(base)]) if len(s) == 1}
    return {
        "ids": ids, "size": size, "pairs": pairs, "next": sa.next, "link": sa.link, "length": sa.length, "labels": labels, "lengths": [len(s) for s in seqs],
        "phrases": phrases, "single": single, "n_base": len(base), "ends": [sorted(e) for e in sa.ends],
    }


def statistics(t: dict, run: list[int]):
    """(state, length) of the longest match that ends at each token of the run."""
    nxt, link, length, v, n = t["next"], t["link"], t["length"], 0, 0
    for c in run:
        while v and c not in nxt[v]:
            v = link[v]
            n = length[v]
        if c in nxt[v]:
            v, n = nxt[v][c], n + 1
        yield v, n


def chain(t: dict, matches: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int, int]]:
    """Spans (template, first word, last word, words covered) of matches (start, end, state) in the order of their ends."""
    open_: dict[int, list[int]] = {}
    done = []
    for start, end, v in matches:
        seen = set()
        for n, at in t["ends"][v]:
            if n in seen:
                continue
            c, size = open_.get(n), end - start + 1
            if c and start <= c[1] + gap:
                skip = max(0, c[1] + 1 - start)
                later = next((x for m, x in t["ends"][v] if m == n and x - size + 1 + skip > c[3]), None)
                if later is not None and skip < size and later - size + 1 + skip <= c[3] + 1 + gap:
                    c[1], c[2], c[3] = end, c[2] + size - skip, later
                    seen.add(n)
                    continue
                if skip >= size or c[2] >= size and skip:
                    seen.add(n)
                    continue
            if c:
                done.append((n, c[0], c[1], c[2]))
            open_[n] = [start, end, size, at]
            seen.add(n)
    return done + [(n, c[0], c[1], c[2]) for n, c in open_.items()]


def scan_texts(t: dict, texts: list[str], least: int, gap: int):
    """Per text: number of words, base places (template, start), spans of chain()."""
    get, size = t["ids"].get, t["size"]
    split = list(map(words_of, texts))
    counts = list(map(len, split))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    ids = np.fromiter(map(get, itertools.chain.from_iterable(split), itertools.repeat(0)), np.int32, int(bounds[-1]))
    places: list[list] = [[] for _ in texts]
    matches: list[list] = [[] for _ in texts]
    for token, n in t["single"].items():
        for at in np.flatnonzero(ids == token).tolist():
            d = int(np.searchsorted(bounds, at, "right")) - 1
            places[d].append((n, at - int(bounds[d])))
    if len(ids) > 1:
        joined = t["pairs"][ids[:-1].astype(np.int64) * size + ids[1:]]
        cuts = bounds[1:-1]
        joined[cuts[(cuts > 0) & (cuts < len(ids))] - 1] = False
        edge = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
        shortest = min([least, *t["lengths"][: t["n_base"]]])
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if hi - lo + 1 < shortest:
                continue
            d = int(np.searchsorted(bounds, lo, "right")) - 1
            at, before = lo - int(bounds[d]), (0, 0)
            for v, n in statistics(t, ids[lo : hi + 1].tolist()):
                places[d] += [(k, at - m + 1) for m, k in t["phrases"][v] if n >= m > 1]
                if before[1] >= least and n != before[1] + 1:
                    matches[d].append((at - before[1], at - 1, before[0]))
                before, at = (v, n), at + 1
            if before[1] >= least:
                matches[d].append((at - before[1], at - 1, before[0]))
    return counts, places, [chain(t, m, gap) if m else [] for m in matches]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, least: int = 4, gap: int = 16, cover: float = 0.5) -> DataFrame:
    """Licence places and spans of each text.

    Returns id_col, n_words, places array<struct<label, start>> of the base phrases (words from 0, by start) and spans
    array<struct<label, first, last, covered, share>>: chains of matches of at least `least` words with at most `gap`
    words between them; share is the part of the template that they cover, and spans of a share below `cover` are
    incidental (they lower no score and give no label). A null or empty text has no words, places or spans. Repeated
    rows and null ids stay; an empty table gives no rows; other columns are ignored; texts of any length are read whole.
    """
    tables = df.sparkSession.sparkContext.broadcast(build(BASE if base is None else base, TEMPLATES if templates is None else templates))

    def work(parts):
        import pyarrow as pa

        t = tables.value
        place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
        span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))
        for keys, texts in parts:
            counts, places, spans = scan_texts(t, [x or "" for x in texts], least, gap)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys),
                    pa.array(counts, pa.int64()),
                    pa.array([[{"label": t["labels"][n], "start": at} for n, at in sorted(set(p), key=lambda x: (x[1], x[0]))] for p in places], place),
                    pa.array([[{"label": t["labels"][n], "first": a, "last": b, "covered": c, "share": min(1.0, c / t["lengths"][n])} for n, a, b, c in sorted(s)] for s in spans], span),
                ],
                names=["key", "n_words", "places", "spans"],
            )

    rows = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = common.map_rows(rows, ["key", "text"], work, f"key {kind}, n_words long, places array<struct<label:string,start:bigint>>, spans array<struct<label:string,first:bigint,last:bigint,covered:bigint,share:double>>")
    strong = F.filter("spans", lambda s: s["share"] >= cover)
    return out.select(F.col("key").alias(id_col), "n_words", "places", "spans", F.transform(strong, lambda s: s["label"]).alias("span_labels"))


def op7_licences(spark, sf_dir: str) -> DataFrame:
    """Licence summary of all documents."""
    out = scan(common.table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"])
    base = F.transform("places", lambda p: p["label"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, "span_labels")).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))).alias("score"),
    )
