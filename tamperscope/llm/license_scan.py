"""License scan: marked-up templates as token automata over a text's words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperscope.llm.common import by_size

#: Base phrases and labels of the contract.
PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}

#: Template markup: <<opt>> ... <<end>> may be absent; <<var:a|b c>> stands for
#: one of its wordings; <<any:m,n>> stands for m to n words of any kind.
#: All other words are mandatory. The license wordings are fixed values.
_MIT_GRANT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
documentation files the software to deal in the software without restriction including without limitation the rights to use copy
modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
furnished to do so subject to the following conditions the above copyright notice and this permission notice
<<opt>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software"""
_BSD_START = """redistribution and use in source and binary forms with or without modification are permitted provided that the
following conditions are met <<opt>>1<<end>> redistributions of source code must retain the above copyright notice this list of
conditions and the following disclaimer <<opt>>2<<end>> redistributions in binary form must reproduce the above copyright notice
this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
_GRANTED = ("<<var:licensed|released|distributed|available|published|redistribute it|modify it>> under <<opt>>the<<end>> "
            "<<opt>>terms of the<<end>> <<opt>>a<<end>>")
_GPL = "gnu general public license <<opt>>as published by the free software foundation<<end>> <<opt>>either<<end>>"
_VERSION = "<<opt>><<var:version|v>><<end>>"
_TAG = "spdx license identifier"
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [f"{_GRANTED} apache <<opt>>software<<end>> license {_VERSION} 2 0", f"{_TAG} apache 2 0",
                   "apache license version 2 0 january 2004"],
    "bsd-2-clause": [f"{_GRANTED} bsd 2 clause <<opt>>simplified<<end>> license", f"{_TAG} bsd 2 clause",
                     "bsd 2 clause <<opt>>simplified<<end>> license copyright",
                     f"{_BSD_START} this software is provided by <<any:1,12>> as is"],
    "bsd-3-clause": [f"{_GRANTED} bsd 3 clause <<opt>>new<<end>> license", f"{_TAG} bsd 3 clause",
                     "bsd 3 clause <<opt>>new<<end>> license copyright",
                     f"{_BSD_START} <<opt>>3<<end>> neither the name of <<any:1,16>> may be used to endorse or promote products derived "
                     "from this software without specific prior written permission"],
    "cc-by-4.0": [f"{_GRANTED} <<opt>>creative commons<<end>> <<var:cc by|attribution>> 4 0", f"{_TAG} cc by 4 0"],
    "cc-by-nc-4.0": [f"{_GRANTED} <<opt>>creative commons<<end>> <<var:cc by nc|attribution noncommercial>> 4 0", f"{_TAG} cc by nc 4 0"],
    "cc-by-sa-4.0": [f"{_GRANTED} <<opt>>creative commons<<end>> <<var:cc by sa|attribution sharealike>> 4 0", f"{_TAG} cc by sa 4 0"],
    "gpl-2.0": [f"{_GRANTED} {_GPL} version 2", f"{_TAG} gpl 2 0", "gnu general public license version 2 june 1991"],
    "gpl-3.0": [f"{_GRANTED} {_GPL} version 3", f"{_TAG} gpl 3 0", "gnu general public license version 3 29 june 2007"],
    "isc": [f"{_GRANTED} isc license", f"{_TAG} isc",
            "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
            "provided that the above copyright notice and this permission notice appear in all copies"],
    "mit": [f"{_GRANTED} mit license", f"{_TAG} mit", "mit license copyright", _MIT_GRANT],
    "mpl-2.0": [f"{_GRANTED} mozilla public license {_VERSION} 2 0", f"{_TAG} mpl 2 0",
                f"subject to the terms of the mozilla public license {_VERSION} 2 0"],
    "proprietary": ["all rights reserved <<any:0,12>> no part of this <<var:publication|work|document|software>> may be reproduced"],
}


@dataclass(frozen=True)
class Part:
    """A word, an optional sequence, wordings to choose from, or any words."""

    kind: str
    word: str = ""
    inner: tuple = ()
    low: int = 0
    high: int = 0


def parse(markup: str) -> tuple[Part, ...]:
    stack: list[list[Part]] = [[]]
    for token in re.findall(r"<<[^>]*>>|[^\s<]+", markup):
        if token == "<<opt>>":
            stack.append([])
        elif token == "<<end>>":
            inner = tuple(stack.pop())
            stack[-1].append(Part("opt", inner=inner))
        elif token.startswith("<<var:"):
            stack[-1].append(Part("var", inner=tuple(tuple(Part("word", w) for w in x.split()) for x in token[6:-2].split("|"))))
        elif token.startswith("<<any:"):
            low, high = map(int, token[6:-2].split(","))
            stack[-1].append(Part("any", low=low, high=high))
        elif token.startswith("<<"):
            raise ValueError(f"unknown mark {token}")
        else:
            stack[-1].append(Part("word", token))
    if len(stack) != 1:
        raise ValueError("an optional region is not closed")
    return tuple(stack[0])


class Automaton:
    """All templates in one token automaton. Sets of positions are made into
    states when a text first reaches them, so a word costs one look-up."""

    def __init__(self, templates: dict[str, list[str]]) -> None:
        self.moves: list[dict[bytes | None, set[int]]] = []
        self.free: list[set[int]] = []
        self.ends: dict[int, str] = {}
        self.alphabet: set[bytes] = set()
        self.anchors: list[bytes] = []
        start = self._place()
        for label, markups in templates.items():
            for markup in markups:
                parts = parse(markup)
                # Wording that every accepted text has: its longest word.
                self.anchors.append(max((p.word for p in parts if p.kind == "word"), key=len).encode())
                at = self._place()
                self.free[start].add(at)
                self.ends[self._sequence(parts, at)] = label
        self.sets: dict[frozenset[int], int] = {}
        self.states: list[frozenset[int]] = []
        self.labels: list[frozenset[str]] = []
        self.next: dict[tuple[int, bytes | None], int] = {}
        self.start = self._state({start})
        self.first = {w for w in self.alphabet if self.step(self.start, w) >= 0}

    def _place(self) -> int:
        self.moves.append({})
        self.free.append(set())
        return len(self.moves) - 1

    def _sequence(self, parts: tuple, at: int) -> int:
        for part in parts:
            if part.kind == "word":
                word, to = part.word.encode(), self._place()
                self.alphabet.add(word)
                self.moves[at].setdefault(word, set()).add(to)
                at = to
            elif part.kind == "opt":
                to = self._sequence(part.inner, at)
                self.free[at].add(to)
                at = to
            elif part.kind == "var":
                to = self._place()
                for wording in part.inner:
                    self.free[self._sequence(wording, at)].add(to)
                at = to
            else:
                tail = []
                for i in range(part.high):
                    if i >= part.low:
                        tail.append(at)
                    to = self._place()
                    self.moves[at].setdefault(None, set()).add(to)
                    at = to
                for place in tail:
                    self.free[place].add(at)
        return at

    def _state(self, places: set[int]) -> int:
        todo = list(places)
        while todo:
            for place in self.free[todo.pop()] - places:
                places.add(place)
                todo.append(place)
        key = frozenset(places)
        if not key:
            return -1
        if key not in self.sets:
            self.sets[key] = len(self.states)
            self.states.append(key)
            self.labels.append(frozenset(self.ends[p] for p in key if p in self.ends))
        return self.sets[key]

    def step(self, state: int, word: bytes) -> int:
        """The state after a word, or -1 where no template goes on."""
        seen = word if word in self.alphabet else None
        if (state, seen) not in self.next:
            to: set[int] = set()
            for place in self.states[state]:
                to |= self.moves[place].get(None, set())
                if seen is not None:
                    to |= self.moves[place].get(seen, set())
            self.next[state, seen] = self._state(to)
        return self.next[state, seen]

    def accepted(self, words: list[bytes]) -> set[str]:
        """Labels of templates that accept some run of the words."""
        found: set[str] = set()
        for i, word in enumerate(words):
            if word not in self.first:
                continue
            state, at = self.start, i
            while state >= 0 and at < len(words):
                state = self.step(state, words[at])
                at += 1
                if state >= 0:
                    found |= self.labels[state]
        return found


_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def count_words(data: bytes) -> int:
    if not data:
        return 0
    inside = _WORD[np.frombuffer(data, np.uint8)]
    return int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(inside[0])


def find_phrases(words: list[bytes]) -> list[tuple[int, str]]:
    found = []
    for phrase, label in PHRASES.items():
        first, rest, at = phrase[0].encode(), [w.encode() for w in phrase[1:]], -1
        for _ in range(words.count(first)):
            at = words.index(first, at + 1)
            if words[at + 1:at + len(phrase)] == rest:
                found.append((at, label))
    return found


_SCANNED = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
            "base_labels string, labels string, score double")


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Licenses of every whole text of ``docs``.

    Words are runs of ASCII letters (A-Z in lower case), digits and non-ASCII
    characters. n_base, first_word and last_word tell the places of the base
    phrases (null where there are none); labels also has the label of each
    template that accepts a run of words: all of its mandatory words in order,
    optional regions whole or absent, replaceable regions within their bounds.
    score is 0 without a label; else half, plus half of the share of labels
    that a template supports. Null and empty texts have no words; a null
    doc_id and repeated rows are kept; other columns are not read.
    """
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(chosen)
        schema = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")],
                            ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
        for batch in by_size(batches, 1):
            out = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                data = (value.as_py() or b"").lower()
                base: list[tuple[int, str]] = []
                matched: set[str] = set()
                # A text without a phrase's or template's words holds neither.
                phrases = any(all(w.encode() in data for w in p) for p in PHRASES)
                marked = any(a in data for a in automaton.anchors)
                if phrases or marked:
                    words = _WORDS.findall(data)
                    base = find_phrases(words) if phrases else []
                    matched = automaton.accepted(words) if marked else set()
                places = [at for at, _ in base]
                base_labels = {label for _, label in base}
                labels = base_labels | matched
                backed = sum(x in matched or any(m.startswith(x) for m in matched) for x in labels)
                out.append((doc_id, count_words(data), len(base), min(places, default=None), max(places, default=None),
                            ",".join(sorted(base_labels)), ",".join(sorted(labels)),
                            0.5 + 0.5 * backed / len(labels) if labels else 0.0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCANNED)


def _pattern(parts: tuple) -> str:
    out = []
    for part in parts:
        if part.kind == "word":
            out.append(f"<{part.word}>")
        elif part.kind == "opt":
            out.append(f"(?:{_pattern(part.inner)})?")
        elif part.kind == "var":
            out.append("(?:" + "|".join(_pattern(x) for x in part.inner) + ")")
        else:
            out.append(f"(?:<[^>]*>){{{part.low},{part.high}}}")
    return "".join(out)


def scan_sql(table: str = "documents") -> str:
    """The scan as SQL: words in angle brackets, a template as an expression."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = {"<" + "><".join(p) + ">": label for p, label in PHRASES.items()}

    def before(expr: str) -> str:
        return f"(length({expr}) - length(replace({expr}, '<', '')))"

    def place(run: str, lazy: str) -> str:
        return f"CASE WHEN contains(s, '{run}') THEN {before(f"regexp_extract(s, '^(.*{lazy}){run}', 1)")} END"

    n_base = " + ".join(f"(length(s) - length(replace(s, '{r}', ''))) // {len(r)}" for r in runs)
    base = ", ".join(f"CASE WHEN contains(s, '{r}') THEN '{label}' END" for r, label in runs.items())
    matched = ", ".join(f"CASE WHEN regexp_matches(s, '{'|'.join(_pattern(parse(m)) for m in ms)}') THEN '{label}' END"
                        for label, ms in TEMPLATES.items())

    def present(values: str) -> str:
        return f"list_sort(list_distinct(list_filter([{values}], lambda x: x IS NOT NULL)))"

    return f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'),
  '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') ws FROM {table}),
j AS (SELECT doc_id, len(ws) n, CASE WHEN len(ws) = 0 THEN '' ELSE '<' || array_to_string(ws, '><') || '>' END s FROM w),
f AS (SELECT doc_id, n, {n_base} n_base, least({', '.join(place(r, '?') for r in runs)}) first_word,
  greatest({', '.join(place(r, '') for r in runs)}) last_word, {present(base)} b, {present(matched)} m FROM j),
g AS (SELECT *, list_sort(list_distinct(list_concat(b, m))) l FROM f)
SELECT doc_id, CAST(n AS BIGINT) n_words, CAST(n_base AS BIGINT) n_base, CAST(first_word AS BIGINT) first_word,
  CAST(last_word AS BIGINT) last_word, array_to_string(b, ',') base_labels, array_to_string(l, ',') labels,
  CASE WHEN len(l) = 0 THEN 0.0 ELSE 0.5 + 0.5 * len(list_filter(l, lambda x: len(list_filter(m, lambda y: starts_with(y, x))) > 0))
    / len(l) END score FROM g"""
