"""Licence scan with a generalised suffix automaton of licence tokens.

One automaton holds the word sequences of all templates. A text is streamed through it and yields, at each word, the
length of the longest word sequence ending there that occurs in any template (the matching statistic) and the state it
leads to. Base phrases are read off the states. Matches of at least ``min_match`` words are placed on the templates they
come from and chained in order of both text and template into covered template spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lossloom.llm.wordhash import WORDS

# The base phrases with their labels, and openings and later parts of well-known licence texts.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
TEMPLATES = (
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
                 "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
                 "merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
                   "you may obtain a copy of the license at"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
                "published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mit", "released under the mit license"),
    ("mit-text", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
                   "without warranties or conditions of any kind either express or implied see the license for the specific language governing "
                   "permissions and limitations under the license"),
    *((label, f"this {work} is free software you can redistribute it and or modify it under the terms of the {name} as published by the free "
              f"software foundation either version {version} of the license or at your option any later version")
      for label, work, name, version in (("gpl-2.0", "program", "gnu general public license", "2"), ("lgpl-2.1", "library", "gnu lesser general public license", "2 1"),
                                         ("lgpl-3.0", "program", "gnu lesser general public license", "3"), ("agpl-3.0", "program", "gnu affero general public license", "3"))),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 "
                "as published by the free software foundation"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions "
            "in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or "
            "other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
            "copyright notice and this permission notice appear in all copies"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
             "arising from the use of this software"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute "
             "it freely subject to the following restrictions"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
                  "distribute this software"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
                "documentation covered by this license to use reproduce display distribute execute and transmit the software"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
)
#: Words that tell near-identical notices apart: a chain gives the label only if one of these stands, unbroken, in each group within the chain.
DEMANDS = {
    "gpl-2.0": (("gnu general public license",), ("version 2",)), "gpl-3.0": (("gnu general public license",), ("version 3",)),
    "lgpl-2.1": (("gnu lesser general public license",), ("version 2 1",)), "lgpl-3.0": (("gnu lesser general public license",), ("version 3",)),
    "agpl-3.0": (("gnu affero general public license",), ("version 3",)),
    "cc-by-4.0": (("creative commons attribution 4 0", "cc by 4 0"),), "cc-by-sa-4.0": (("attribution sharealike 4 0",),),
    "cc-by-nc-4.0": (("attribution noncommercial 4 0", "cc by nc 4 0"),), "mpl-2.0": (("mozilla public license v 2 0",),), "mit": (("mit license",),),
}
MIN_MATCH = 4
MAX_GAP = 10
COVERED = 0.6
#: Words per block under which chains are looked up; any size gives the same result.
BLOCK = 256


class SuffixAutomaton:
    """Generalised suffix automaton over word ids (1..); state 0 is the start.

    ``ends[state]`` lists (template, position after the last word) of the places where the state's words end.
    """

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, seq in enumerate(sequences):
            state = 0
            for i, w in enumerate(seq):
                state = self._extend(state, w)
                self.ends[state].add((k, i + 1))
        for state in sorted(range(1, len(self.len)), key=lambda s: -self.len[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _add(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.len.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.len) - 1

    def _split(self, parent: int, child: int, w: int) -> int:
        """The part of ``child`` reached from ``parent`` in one step, cut off as a state of its own."""
        clone = self._add(self.len[parent] + 1, dict(self.next[child]), self.link[child])
        self.link[child] = clone
        while parent >= 0 and self.next[parent].get(w) == child:
            self.next[parent][w] = clone
            parent = self.link[parent]
        return clone

    def _extend(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None:
            return known if self.len[known] == self.len[last] + 1 else self._split(last, known, w)
        new = self._add(self.len[last] + 1, {}, 0)
        state = last
        while state >= 0 and w not in self.next[state]:
            self.next[state][w] = new
            state = self.link[state]
        if state >= 0:
            child = self.next[state][w]
            self.link[new] = child if self.len[child] == self.len[state] + 1 else self._split(state, child, w)
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """(state, matched length) after each word."""
        state = length = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            step = self.next[state].get(w)
            if step is not None:
                state, length = step, length + 1
            yield state, length


class Scanner:
    """Automaton, vocabulary and phrase marks for one set of phrases and templates."""

    def __init__(self, base=BASE, templates=TEMPLATES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, covered: float = COVERED):
        texts = [*base, *templates]
        words = [t.encode("utf-8").translate(WORDS).split() for t, _ in base] + [t.encode("utf-8").translate(WORDS).split() for _, t in templates]
        self.labels = [b for _, b in base] + [a for a, _ in templates]
        self.n_base, self.sizes = len(base), [len(w) for w in words]
        assert all(n > 1 for n in self.sizes) and len(texts) == len(words)
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.sam = SuffixAutomaton([[self.vocabulary[w] for w in ws] for ws in words])
        self.min_match, self.max_gap, self.covered = min_match, max_gap, covered
        #: For each state the base phrases that end it.
        self.marks = [[k for k, i in e if k < self.n_base and i == self.sizes[k]] for e in self.sam.ends]
        for state, marks in enumerate(self.marks):
            link = self.sam.link[state]
            while link > 0:
                marks += [k for k, i in self.sam.ends[link] if k < self.n_base and i == self.sizes[k] and self.sam.len[link] >= self.sizes[k]]
                link = self.sam.link[link]
            self.marks[state] = sorted(set(marks))

    def runs(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """Stretches of at least two template words: nothing else can match a phrase or a chain."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))
        at = np.flatnonzero(ids)
        if len(at) < 2:
            return
        cuts = np.flatnonzero(np.diff(at) != 1) + 1
        lo, hi = np.r_[0, cuts], np.r_[cuts, len(at)]
        for i in np.flatnonzero(hi - lo > 1).tolist():
            yield int(at[lo[i]]), ids[at[lo[i]]:at[hi[i] - 1] + 1].tolist()

    def scan(self, raw: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of one UTF-8 text.

        spans: (label, first word, end word, covered share of the template), one per chain that no better one of another label beats.
        """
        words = raw.translate(WORDS).split()
        hits: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []
        for start, run in self.runs(words):
            held = (0, 0, 0)
            for i, (state, length) in enumerate(self.sam.statistics(run), start + 1):
                hits += [(i - self.sizes[k], k) for k in self.marks[state] if length >= self.sizes[k]]
                if length <= held[2] and held[2] >= self.min_match:
                    matches.append(held)
                held = (i, state, length)
            if held[2] >= self.min_match:
                matches.append(held)
        good, spans = self._won(self._chains(matches), words)
        starts = [i for i, _ in hits]
        base = {self.labels[k] for _, k in hits}
        score = 1.0 if hits else max((s[3] for s in spans), default=0.0)
        return (len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                ",".join(sorted(base | {s[0] for s in good})), float(score), spans)

    def _won(self, spans: list[tuple[str, int, int, float]], words: list[bytes]) -> tuple[list, list]:
        """(chains that give a label, chains that stay): the best-covered wins over chains of other labels that share most of their words with it."""
        def told(label: str, first: int, end: int) -> bool:
            text = b" " + b" ".join(words[first:end]) + b" "
            return all(any(f" {p} ".encode() in text for p in group) for group in DEMANDS.get(label, ()))

        good: list[tuple[str, int, int, float]] = []
        near: dict[int, list[tuple[str, int, int, float]]] = {}  # good chains by the blocks of words they touch

        def blocks(s: tuple[str, int, int, float]) -> range:
            return range(s[1] // BLOCK, (s[2] - 1) // BLOCK + 1)

        def beaten(s: tuple[str, int, int, float]) -> bool:
            return any(g[0] != s[0] and 2 * (min(g[2], s[2]) - max(g[1], s[1])) > min(g[2] - g[1], s[2] - s[1]) for b in blocks(s) for g in near.get(b, ()))

        for s in sorted(spans, key=lambda s: (-s[3], s[1] - s[2], s)):
            if s[3] >= self.covered and not beaten(s) and told(*s[:3]):
                good.append(s)
                for b in blocks(s):
                    near.setdefault(b, []).append(s)
        return good, [s for s in spans if not beaten(s)]

    def _chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chain matches that lie in order on text and template with at most ``max_gap`` words between them on either side."""
        open_: dict[int, list[list[int]]] = {}
        done: list[tuple[str, int, int, float]] = []

        def closed(k: int, chains: list[list[int]]) -> None:
            done.extend((self.labels[k], c[0], c[1], min(1.0, c[3] / self.sizes[k])) for c in chains)

        for end, state, length in matches:
            for k, t_end in self.sam.ends[state]:
                if k < self.n_base or t_end < length:
                    continue
                start, t_start = end - length, t_end - length
                best, chains = None, open_.get(k, [])
                # The starts of matches never fall, so a chain that ends too far back takes no later match either.
                if any(start - c[1] > self.max_gap for c in chains):
                    closed(k, [c for c in chains if start - c[1] > self.max_gap])
                    chains = open_[k] = [c for c in chains if start - c[1] <= self.max_gap]
                for chain in chains:
                    gap, t_gap = start - chain[1], t_start - chain[2]
                    if -length < gap <= self.max_gap and -length < t_gap <= self.max_gap and (best is None or chain[3] > best[3]):
                        best = chain
                if best is None:
                    open_.setdefault(k, []).append([start, end, t_end, length])
                else:
                    best[3] += min(length, end - best[1], t_end - best[2]) if end > best[1] and t_end > best[2] else 0
                    best[1], best[2] = max(best[1], end), max(best[2], t_end)
        for k, chains in open_.items():
            closed(k, chains)
        return sorted(done)


@lru_cache(maxsize=4)
def scanner(base=BASE, templates=TEMPLATES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, covered: float = COVERED) -> Scanner:
    return Scanner(base, templates, min_match, max_gap, covered)


def scan(docs: DataFrame, id_col: str = "doc_id", base=BASE, templates=TEMPLATES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP,
         covered: float = COVERED) -> DataFrame:
    """One row per input row: the id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    n_base counts all places of all base phrases, first_word and last_word are the least and greatest word they start at
    (null without any). labels adds the labels of templates covered to ``covered`` or more by one chain that holds the
    words DEMANDS asks for and overlaps no better-covered chain of another label. score is 1 when
    a base phrase stands in the text, else the largest covered share. A null text is empty: no words, no labels, score 0.
    Only the id and the text are read; repeated rows answer alike; empty in, empty out.
    """
    span = T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("end", T.LongType()),
                         T.StructField("covered", T.DoubleType())])
    schema = T.StructType([docs.schema[id_col], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")],
                           T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    names = schema.names[1:]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct(
        [("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(base, templates, min_match, max_gap, covered)
        for batch in batches:
            found = [s.scan(t) if t else s.scan(b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = list(zip(*found, strict=True)) if found else [[] for _ in names]
            columns[-1] = [[dict(zip(("label", "first", "end", "covered"), x, strict=True)) for x in v] for v in columns[-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], [id_col, *names])

    return docs.select(id_col, "text").mapInArrow(run, schema)
