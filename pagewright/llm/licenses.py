"""License scans: templates with optional and replaceable regions, compiled into one token automaton.

A template is plain wording. ``[[ ... ]]`` is a part that may be missing, and ``{{a-b}}`` stands for
a to b words of any kind; all other words are mandatory and must stand there as they are, in order.
All templates together are one automaton over word classes (the words of the templates, and one class
for all others). It is made deterministic where texts need it, and started at each word that
begins a template, so it tells where a text that it accepts begins and ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.llm.resample import words
from pagewright.llm.tokens import rounds

#: Fixed phrases of the base rule and their labels.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: Fixed wording of public license texts, notices and tags, by label.
TEMPLATES = [
    ("agpl-3.0", "GNU Affero General Public License [[as published by the Free Software Foundation]] [[either]] version 3"),
    ("apache-2.0", "licensed under [[the terms of]] the Apache License [[,]] version 2.0"),
    ("apache-2.0", "Apache License version 2.0 January 2004 http://www.apache.org/licenses/"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
      [[1]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
      [[2]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
      documentation and/or other materials provided with the distribution. [[and]] THIS SOFTWARE IS PROVIDED BY {{1-20}} AS IS"""),
    ("bsd-2-clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
      [[1]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
      [[2]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
      documentation and/or other materials provided with the distribution. [[3]] Neither the name of {{1-20}} nor the names of {{1-6}} contributors may be used
      to endorse or promote products derived from this software without specific prior written permission"""),
    ("bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] CC BY 4.0"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] Creative Commons Attribution 4.0 [[International]] License"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] Creative Commons Attribution-NonCommercial 4.0 [[International]] License"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] CC BY-SA 4.0"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] Creative Commons Attribution-ShareAlike 4.0 [[International]] License"),
    ("cc0-1.0", "CC0 1.0 [[Universal]]"),
    ("gpl-2.0", "licensed under [[the terms of]] the [[GNU]] General Public License [[,]] version 2"),
    ("gpl-2.0-or-later", """free software [[:]] you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
      Free Software Foundation; either version 2 [[of the License]] or (at your option) any later version"""),
    ("gpl-3.0", "licensed under [[the terms of]] the [[GNU]] General Public License [[,]] version 3"),
    ("gpl-3.0-or-later", """free software [[:]] you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
      Free Software Foundation; either version 3 [[of the License]] or (at your option) any later version"""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
      above copyright notice and this permission notice appear in all copies"""),
    ("lgpl-2.1", "GNU Lesser General Public License [[as published by the Free Software Foundation]] [[either]] version 2.1"),
    ("lgpl-3.0", "GNU Lesser General Public License [[as published by the Free Software Foundation]] [[either]] version 3"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files [[(the "Software")]],
      to deal in {{1-3}} without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
      copies of {{1-3}}, and to permit persons to whom {{1-3}} is furnished to do so, subject to the following conditions:
      The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of {{1-3}}
      [[{{1-3}} is provided "as is", without warranty of any kind, express or implied]]"""),
    ("mit", "[[released]] [[licensed]] under [[the terms of]] the MIT License"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

_MARKUP = re.compile(r"(\[\[|\]\]|\{\{\d+-\d+\}\})")
#: States of the deterministic automaton that a worker remembers.
STATES_HELD = 50_000
OTHER = 0


def parts(template: str) -> list:
    """A template as a list of words (bytes), (a, b) for a to b words of any kind, and lists for optional parts."""
    out: list = []
    open_ = [out]
    for x in _MARKUP.split(template):
        if x == "[[":
            open_[-1].append([])
            open_.append(open_[-1][-1])
        elif x == "]]":
            if len(open_) == 1:
                raise ValueError(f"an optional part ends that did not begin: {template!r}")
            open_.pop()
        elif x.startswith("{{"):
            open_[-1].append(tuple(int(n) for n in x[2:-2].split("-")))
        else:
            open_[-1].extend(words(x))
    if len(open_) > 1:
        raise ValueError(f"an optional part does not end: {template!r}")
    return out


class Automaton:
    """The templates (label, wording) as one automaton. A template that accepts the empty text is an error."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.labels = [label for label, _ in templates]
        self.classes: dict[bytes, int] = {}
        #: For each place of a template: (class, next place), with None for a word of any kind, and places reached without a word.
        self.moves: list[list[tuple[int | None, int]]] = []
        self.free: list[list[int]] = []
        self.accepts: dict[int, int] = {}
        begins = []
        for i, (_, text) in enumerate(templates):
            begins.append(self._place())
            end = self._compiled(parts(text), begins[-1])
            self.accepts[end] = i
        start = self._closed(begins)
        if start & set(self.accepts):
            raise ValueError("a template needs a mandatory word")
        self._reset(start)
        any_ = any(c is None for p in start for c, _ in self.moves[p])
        #: Classes of words that begin a template.
        self.first = np.array([any_ or any(c == k for p in start for c, _ in self.moves[p]) for k in range(len(self.classes) + 1)])

    def _place(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def _compiled(self, items: list, at: int) -> int:
        for x in items:
            if isinstance(x, list):
                end, after = self._compiled(x, at), self._place()
                self.free[end].append(after)
                self.free[at].append(after)
                at = after
            elif isinstance(x, tuple):
                ahead = []
                for n in range(x[1]):
                    if n >= x[0]:
                        ahead.append(at)
                    to = self._place()
                    self.moves[at].append((None, to))
                    at = to
                for p in ahead:
                    self.free[p].append(at)
            else:
                to = self._place()
                self.moves[at].append((self.classes.setdefault(x, len(self.classes) + 1), to))
                at = to
        return at

    def _closed(self, places: list[int]) -> frozenset[int]:
        seen, todo = set(places), list(places)
        while todo:
            for q in self.free[todo.pop()]:
                if q not in seen:
                    seen.add(q)
                    todo.append(q)
        return frozenset(seen)

    def _reset(self, start: frozenset[int]) -> None:
        self.sets, self.number, self.step, self.done = [start], {start: 0}, [{}], [()]

    def _next(self, state: int, k: int) -> int:
        """The state after a word of class ``k``, -1 if no template goes on."""
        reached = [q for p in self.sets[state] for c, q in self.moves[p] if c is None or c == k]
        if not reached:
            to = -1
        else:
            places = self._closed(reached)
            to = self.number.get(places, len(self.sets))
            if to == len(self.sets):
                self.number[places] = to
                self.sets.append(places)
                self.step.append({})
                self.done.append(tuple(sorted({self.accepts[p] for p in places if p in self.accepts})))
        self.step[state][k] = to
        return to

    def found(self, tokens: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, start, end) of each place where a template begins, with its longest text, by start and template."""
        if len(self.sets) > STATES_HELD:
            self._reset(self.sets[0])
        get, step, done = self.classes.get, self.step, self.done
        kinds = [get(t, OTHER) for t in tokens]
        out = []
        for i in np.flatnonzero(self.first[np.array(kinds, dtype=np.int64)]).tolist() if kinds else []:
            state, ends = 0, None
            for at in range(i, len(kinds)):
                k = kinds[at]
                to = step[state].get(k)
                state = self._next(state, k) if to is None else to
                if state < 0:
                    break
                if done[state]:
                    ends = ends or {}
                    for t in done[state]:
                        ends[t] = at + 1
            if ends:
                out += [(t, i, e) for t, e in sorted(ends.items())]
        return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None, with_matches: bool = False) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each whole text of ``docs`` (doc_id, text, ...).

    Base labels are those of ``phrases`` whose words stand together somewhere; ``n_base`` counts all such places, and
    first_word and last_word are where the first and the last begin (null without any). ``labels`` has the labels of
    accepted templates too. Both are distinct, in order and joined by commas, empty strings without any. The score is 1
    where a template's whole wording is there, 0.5 for a phrase alone, else 0. Null and empty texts have no words. Repeated
    rows are scanned alike; extra columns are ignored, whatever their names; an empty table gives none. ``with_matches`` adds
    matches, array<struct<label, start, end>> in words, those of templates only: at each place the longest text of a template.
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
    if with_matches:
        schema += ", matches array<struct<label: string, start: long, end: long>>"
        types.append(pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
    names = [x.split()[0] for x in schema.split(", ")[: len(types)]]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, n = Automaton([*phrases, *templates]), len(phrases)
        for b in rounds(batches):
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                tokens = words(text or "")
                found = one.found(tokens)
                base = [(one.labels[t], s) for t, s, _ in found if t < n]
                own = [(one.labels[t], s, e) for t, s, e in found if t >= n]
                basic, more = {x[0] for x in base}, {x[0] for x in own}
                at = [s for _, s in base]
                row = (doc_id, len(tokens), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(basic)), ",".join(sorted(basic | more)), 1.0 if more else 0.5 if basic else 0.0)
                rows.append((*row, [{"label": x, "start": s, "end": e} for x, s, e in own]) if with_matches else row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(each, schema)


def pattern(template: str) -> str:
    """A regular expression for the same texts, over words that each have a blank behind them."""

    def said(items: list) -> str:
        return "".join(f"(?:{said(x)})?" if isinstance(x, list) else "(?:[^ ]+ ){%d,%d}" % x if isinstance(x, tuple) else x.decode() + " " for x in items)

    return said(parts(template))
