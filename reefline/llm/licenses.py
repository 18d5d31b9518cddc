"""License scan by template markup: optional and replaceable regions are compiled into token automata.

A template is wording with three kinds of markup, after which only words count (lower-case letters,
digits and characters beyond ASCII; everything else separates them):

* ``[[ ... ]]``: an optional region, which may hold markup of its own;
* ``{{name:2-9}}``: two to nine words of any kind;
* ``{{name:is|are not}}``: one of the wordings.

Everything outside of markup is mandatory and has to stand word by word. All templates become one
nondeterministic automaton over words, whose deterministic states are made as texts need them. It starts
at places whose first two words some template allows (a look-up on pairs of word numbers, in numpy), and
runs until no template can go on; a template's span is the longest it accepts from its first place on, and
spans of a template don't overlap. Plain phrases are templates without markup, of which every place counts.

Defined cases: null or empty text has no words and no matches; text of any length is scanned whole, in
blocks of texts, and its matches are as many as it holds; repeated rows are scanned each; a null
``doc_id`` stays null; extra columns are ignored, whatever their names; an empty table gives an empty
frame. A template of fewer than two mandatory words, or one that begins or ends with a free region, is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline.llm import _bytes
from reefline.llm._frames import map_text

#: The phrases of the contract, under their labels.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

_WORK = "[[this {{work:1-8}} is]] {{way:licensed|released|distributed|available|made available|published}} under"
_AS_IS = 'provided "as is"'
#: Templates of license notices and texts, by label.
TEMPLATES = (
    ("mit-notice", f"{_WORK} the {{{{name:MIT|Expat}}}} license"),
    ("apache-2.0", f"{_WORK} [[the terms of]] the Apache [[Software]] License, [[Version]] 2.0"),
    ("gpl-2.0", f"{_WORK} [[the terms of]] the GNU General Public License, [[as published by the Free Software Foundation;]] [[either]] version 2 [[of the License]]"),
    ("gpl-3.0", f"{_WORK} [[the terms of]] the GNU General Public License, [[as published by the Free Software Foundation;]] [[either]] version 3 [[of the License]]"),
    ("lgpl", f"{_WORK} [[the terms of]] the GNU Lesser General Public License"),
    ("agpl", f"{_WORK} [[the terms of]] the GNU Affero General Public License"),
    *((f"cc-{kind.replace(' ', '-')}-{version}", f"{_WORK} [[{{{{article:a|the}}}}]] [[Creative Commons]] CC {kind} {version} [[International]] [[license]]") for kind in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd") for version in ("3.0", "4.0")),
    ("mit", f"""[[The MIT License [[(MIT)]]]] [[Copyright [[(c)]] {{{{holder:1-40}}}}]] Permission is hereby granted, free of charge, to any person obtaining a copy of this
      software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
      merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
      conditions: The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the Software.
      The software is {_AS_IS}, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a
      particular purpose and noninfringement. In no event shall {{{{holder:1-20}}}} be liable for any claim, damages or other liability, whether in an action of contract, tort
      or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."""),
    ("isc", f"""[[ISC License]] [[Copyright [[(c)]] {{{{holder:1-40}}}}]] Permission to use, copy, modify, and {{{{join:or|and|and or}}}} distribute this software for any purpose with or without fee is
      hereby granted, provided that the above copyright notice and this permission notice appear in all copies. The software is {_AS_IS} and {{{{holder:1-12}}}} disclaims all
      warranties with regard to this software including all implied warranties of merchantability and fitness."""),
    ("bsd-2-clause", f"""[[Copyright [[(c)]] {{{{holder:1-40}}}}]] Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
      conditions are met: [[{{{{bullet:1|a}}}}]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
      [[{{{{bullet:2|b}}}}]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
      and/or other materials provided with the distribution. This software is provided by {{{{holder:1-20}}}} "as is" """),
    ("bsd-3-clause", f"""[[Copyright [[(c)]] {{{{holder:1-40}}}}]] Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
      conditions are met: [[{{{{bullet:1|a}}}}]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
      [[{{{{bullet:2|b}}}}]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
      and/or other materials provided with the distribution. [[{{{{bullet:3|c}}}}]] Neither the name of {{{{holder:1-20}}}} nor the names of {{{{owner:its|the}}}} contributors may be
      used to endorse or promote products derived from this software without specific prior written permission."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
      License at [[http://www.apache.org/licenses/LICENSE-2.0]] Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
      on an "AS IS" basis, without warranties or conditions of any kind, either express or implied."""),
    ("gpl-2.0-or-later", """{{work:This program|This file|This library}} is free software[[;]] you can redistribute it and/or modify it under the terms of the GNU General Public License as
      published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("gpl-3.0-or-later", """{{work:This program|This file|This library}} is free software[[:]] you can redistribute it and/or modify it under the terms of the GNU General Public License as
      published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


@dataclass
class Part:
    """A word, an optional sequence, a choice of sequences or a gap of ``least`` to ``most`` words."""

    kind: str
    word: str = ""
    options: list[list[Part]] = field(default_factory=list)
    least: int = 0
    most: int = 0


def parse(template: str) -> list[Part]:
    """The parts of a template, in order."""
    open_parts: list[list[Part]] = [[]]
    for mark, name, text in re.findall(r"(\[\[|\]\])|\{\{\w+:([^}]*)\}\}|((?:(?!\[\[|\]\]|\{\{).)+)", template, re.S):
        if mark == "[[":
            open_parts.append([])
        elif mark:
            inner = open_parts.pop()
            if not open_parts:
                raise ValueError(f"an optional region ends before it begins: {template[:60]}")
            if inner:
                open_parts[-1].append(Part("optional", options=[inner]))
        elif m := re.fullmatch(r"(\d+)-(\d+)", name):
            open_parts[-1].append(Part("gap", least=int(m[1]), most=int(m[2])))
        elif name:
            open_parts[-1].append(Part("choice", options=[[Part("word", w) for w in words_of(x)] for x in name.split("|")]))
        else:
            open_parts[-1].extend(Part("word", w) for w in words_of(text))
    if len(open_parts) > 1:
        raise ValueError(f"an optional region has no end: {template[:60]}")
    if sum(p.kind == "word" for p in open_parts[0]) < 2 or any(p.kind == "gap" for p in _edges(open_parts[0])):
        raise ValueError(f"too little mandatory wording, or a free region at an end: {template[:60]}")
    return open_parts[0]


def _edges(parts: list[Part]) -> Iterator[Part]:
    """Parts that a match may begin or end with."""
    for end, way in ((0, parts), (-1, reversed(parts))):
        for p in way:
            yield p
            for inner in p.options:
                if inner:
                    yield from _edges(inner if p.kind == "choice" else inner[:1] if end == 0 else inner[-1:])
            if p.kind != "optional":
                break


class Automaton:
    """All templates and phrases; symbols are places of the sorted vocabulary, 0 stands for any other word."""

    def __init__(self, templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]):
        self.labels = [label for label, _ in (*templates, *phrases)]
        self.plain = [False] * len(templates) + [True] * len(phrases)
        self.on: list[dict[str, list[int]]] = []  # word edges of a state
        self.any: list[list[int]] = []
        self.free: list[list[int]] = []
        self.accepts: dict[int, int] = {}
        start = self._state()
        for k, (_, text) in enumerate((*templates, *phrases)):
            own = self._state()
            self.free[start].append(own)
            self.accepts[self._add(parse(text), own)] = k
        vocabulary = sorted({w for edges in self.on for w in edges})
        self.symbol = {w: i + 1 for i, w in enumerate(vocabulary)}
        column = pa.array(vocabulary, pa.large_string())
        hashes = np.concatenate([w.hash for w in _bytes.words(column, _bytes.ALNUM)])
        self.order = np.argsort(hashes)
        self.hashes, self.vocabulary = hashes[self.order], vocabulary
        self.start = self._closed({start})
        self._pairs()
        self._clear()

    def _state(self) -> int:
        self.on.append({})
        self.any.append([])
        self.free.append([])
        return len(self.on) - 1

    def _add(self, parts: list[Part], at: int) -> int:
        """Appends the parts behind a state and returns the last state."""
        for p in parts:
            last = self._state()
            if p.kind == "word":
                self.on[at].setdefault(p.word, []).append(last)
            elif p.kind == "gap":
                for k in range(p.most):
                    if k >= p.least:
                        self.free[at].append(last)
                    after = self._state()
                    self.any[at].append(after)
                    at = after
                self.free[at].append(last)
            else:
                for inner in p.options:
                    self.free[self._add(inner, at)].append(last)
                if p.kind == "optional":
                    self.free[at].append(last)
            at = last
        return at

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, found = list(states), set(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)

    def _after(self, states: frozenset[int], word: str | None) -> frozenset[int]:
        return self._closed({x for s in states for x in (*self.any[s], *(self.on[s].get(word, ()) if word is not None else ()))})

    def _pairs(self) -> None:
        """Pairs of symbols that some template may begin with, and pairs of free first or second words."""
        n = len(self.vocabulary) + 1
        ok = np.zeros((n, n), bool)
        for i, first in ((0, None), *((i, w) for w, i in self.symbol.items())):
            states = self._after(self.start, first)
            if any(self.any[s] for s in states):
                ok[i] = True
            for w in {w for s in states for w in self.on[s]}:
                ok[i, self.symbol[w]] = True
        self.begins = ok

    def _clear(self) -> None:
        self.states: list[frozenset[int]] = [self.start]
        self.number = {self.start: 0}
        self.next: list[dict[int, int]] = [{}]
        self.ends: list[tuple[int, ...]] = [()]

    #: Deterministic states that are kept; beyond, they are made anew.
    MOST_STATES = 50_000

    def step(self, state: int, symbol: int) -> int:
        """The state after one more word; -1 if no template can go on."""
        new = self._after(self.states[state], self.vocabulary[symbol - 1] if symbol else None)
        if not new:
            got = -1
        else:
            got = self.number.setdefault(new, len(self.states))
            if got == len(self.states):
                self.states.append(new)
                self.next.append({})
                self.ends.append(tuple(sorted(self.accepts[s] for s in new if s in self.accepts)))
        self.next[state][symbol] = got
        return got

    def symbols(self, w: _bytes.Words) -> np.ndarray:
        """The symbol of each word: by hash, then letter by letter."""
        at = np.searchsorted(self.hashes, w.hash)
        at[at == len(self.hashes)] = 0
        known = np.flatnonzero(self.hashes[at] == w.hash)
        out = np.zeros(len(w.hash), np.int64)
        out[known] = self.order[at[known]] + 1
        lengths = np.array([0, *(len(x.encode()) for x in self.vocabulary)])
        letters = b"".join(x.encode() for x in self.vocabulary)
        starts = np.concatenate(([0, 0], np.cumsum(lengths[1:])))
        letters = np.frombuffer(letters, np.uint8)
        size = w.ends[known] - w.starts[known]
        same = size == lengths[out[known]]
        for k in range(int(size[same].max()) if same.any() else 0):
            on = np.flatnonzero(same & (size > k))
            same[on] = w.data[w.starts[known[on]] + k] == letters[starts[out[known[on]]] + k]
        out[known[~same]] = 0
        return out

    def run(self, symbols: list[int], i: int, n: int) -> dict[int, int]:
        """For each template that accepts from word i on: the longest match's end."""
        state, found = 0, {}
        while i < n:
            got = self.next[state].get(symbols[i])
            state = self.step(state, symbols[i]) if got is None else got
            if state < 0:
                break
            i += 1
            for k in self.ends[state]:
                found[k] = i
        if len(self.states) > self.MOST_STATES:
            self._clear()
        return found

    def scan(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[tuple[str, bool, int, int]]]:
        """Words and matches of each text, and all matches in order: label, whether a phrase, first word, word after the last."""
        n_words, n_found, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for w in _bytes.words(column, _bytes.ALNUM, _bytes.LOWER):
            counts = np.zeros(w.n, np.int64)
            symbols, doc = self.symbols(w), w.doc()
            pairs = np.flatnonzero(self.begins[symbols[:-1], symbols[1:]] & (doc[:-1] == doc[1:]))
            listed, past, of = symbols.tolist(), {}, -1
            for i in pairs.tolist():
                if doc[i] != of:
                    of, past = int(doc[i]), {}
                first, end = int(w.of[of]), int(w.of[of + 1])
                for k, stop in self.run(listed, i, end).items():
                    if self.plain[k] or past.get(k, 0) <= i:
                        past[k] = stop
                        counts[of] += 1
                        found.append((self.labels[k], self.plain[k], i - first, stop - first))
            n_words.append(np.diff(w.of))
            n_found.append(counts)
        return np.concatenate(n_words), np.concatenate(n_found), found


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (``doc_id``), ``n_words`` and ``matches``: label, phrase (or template), first word and the word
    after the last, by place.
    """
    made: list[Automaton] = []  # one for each Python worker
    kind = pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("first", pa.int64()), ("stop", pa.int64())])

    def run(texts: pa.Array) -> dict[str, pa.Array]:
        if not made:
            made.append(Automaton(templates, phrases))
        n_words, counts, found = made[0].scan(texts)
        columns = list(zip(*found, strict=True)) or [[], [], [], []]
        rows = pa.StructArray.from_arrays([pa.array(list(c), kind.field(i).type) for i, c in enumerate(columns)], fields=list(kind))
        return {"n_words": pa.array(n_words), "matches": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), rows)}

    Automaton(templates, phrases)  # refuses faulty templates before any job
    return map_text(docs, run, "n_words long, matches array<struct<label: string, phrase: boolean, first: long, stop: long>>", ["doc_id"] if keep is None else keep)


def verdicts(found: DataFrame) -> DataFrame:
    """The frame of ``scan`` with counts and labels: places of phrases, their first and last, labels of phrases and of all,
    and a score: 1 with a template's whole wording, a half with a phrase alone, else 0.
    """
    base = F.filter("matches", lambda m: m["phrase"])
    starts = F.transform(base, lambda m: m["first"])
    names = lambda m: F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))), ",")
    return found.select(
        "*", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("matches")).alias("labels"),
        F.when(F.exists("matches", lambda m: ~m["phrase"]), 1.0).when(F.size(base) > 0, 0.5).otherwise(0.0).alias("score"),
    )


def pattern(template: str) -> str:
    """The template as a regular expression over words that each end in a space (for comparison)."""

    def of(parts: list[Part]) -> str:
        out = ""
        for p in parts:
            if p.kind == "word":
                out += f"{p.word} "
            elif p.kind == "gap":
                out += f"(?:[^ ]+ ){{{p.least},{p.most}}}"
            elif p.kind == "optional":
                out += f"(?:{of(p.options[0])})?"
            else:
                out += "(?:" + "|".join(of(x) for x in p.options) + ")"
        return out

    return f"(?:^| ){of(parse(template))}"
