"""License scans: phrases, and templates with optional and replaceable regions compiled to token automata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.batches import sliced, texts
from quillspark.sources.tables import table

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# License wording. [[...]] is optional, {{n}} stands for up to n words of any kind.
TEMPLATES = {
    "all-rights-reserved": "all rights reserved",
    "apache-2.0": "licensed under the apache license version 2.0 [[the license]]",
    "apache-2.0-header": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license [[you may obtain a copy of the license at {{12}}]] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "bsd-clauses": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "licensed under [[a]] [[the]] cc by 4.0",
    "cc-by-nc-4.0": "licensed under [[a]] [[the]] cc by nc 4.0",
    "cc-by-sa-4.0": "licensed under [[a]] [[the]] cc by sa 4.0",
    "gpl-3.0": "licensed under the gnu general public license version 3 [[or [[at your option]] any later version]]",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {{1}} of the license or [[at your option]] any later version",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

_LOWERED = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits, A-Z lower-cased, and of characters beyond ASCII."""
    return text.encode().translate(_LOWERED).split()


@dataclass(frozen=True)
class Automaton:
    """A token automaton: from each state the words that lead on, a free step, and the states entered for nothing.

    ``read`` has the number of mandatory words that were read by the time a state is reached.
    """

    first: bytes
    steps: tuple[dict[bytes, int], ...]
    free: tuple[int | None, ...]
    empty: tuple[tuple[int, ...], ...]
    read: tuple[int, ...]
    accepting: int

    @classmethod
    def compiled(cls, template: str) -> Automaton:
        for mark in ("[[", "]]"):
            template = template.replace(mark, f" {mark} ")
        steps: list[dict[bytes, int]] = [{}]
        free: list[int | None] = [None]
        empty: list[list[int]] = [[]]
        read = [0]
        opened: list[int] = []
        mandatory: list[bytes] = []

        def state(words: int) -> int:
            steps.append({})
            free.append(None)
            empty.append([])
            read.append(words)
            return len(steps) - 1

        at = 0
        for part in template.split():
            if part == "[[":
                opened.append(at)
            elif part == "]]":
                after = state(read[at])
                empty[at].append(after)
                empty[opened.pop()].append(after)
                at = after
            elif part.startswith("{{"):
                inner = [at]
                for _ in range(int(part.strip("{}"))):
                    free[inner[-1]] = state(read[at])
                    inner.append(free[inner[-1]])
                after = state(read[at])
                for k in inner:
                    empty[k].append(after)
                at = after
            else:
                for word in words_of(part):
                    if not opened:
                        mandatory.append(word)
                    after = state(read[at] + (not opened))
                    steps[at][word] = after
                    at = after
        if opened or not mandatory or not words_of(template.split()[0]) or template.split()[0].startswith("{{"):
            raise ValueError("a template starts with a mandatory word and closes what it opens")
        return cls(mandatory[0], tuple(steps), tuple(free), tuple(map(tuple, empty)), tuple(read), at)

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for k in self.empty[todo.pop()]:
                if k not in states:
                    states.add(k)
                    todo.append(k)
        return states

    def share(self, words: list[bytes], start: int) -> float:
        """The share of the mandatory wording that is read from a place on; 1 if the text is accepted."""
        states, most = self._closed({0}), 0
        for k in range(start, len(words)):
            word = words[k]
            after = {s for q in states for s in (self.steps[q].get(word), self.free[q]) if s is not None}
            if not after:
                break
            states = self._closed(after)
            if self.accepting in states:
                return 1.0
            most = max(most, max(self.read[q] for q in states))
        return min(most / self.read[self.accepting], 0.99)


def scanned(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs (doc_id, text).

    n_base counts the places where a phrase's words stand in a row, first_word and last_word are the least and largest
    of their starts, in words from 0, null if there is none. labels adds those of the templates that accept a stretch
    of the text: all mandatory words in their order, with optional and replaceable regions as marked. score is 1 if a
    template accepts, or else the largest share of a template's mandatory words that the text has from its start on.

    Null and empty texts have no words, empty label lists and score 0. Rows are independent: repeats give repeats,
    and other columns, whatever their names, are ignored. Long texts are read whole, once. An empty table gives an empty
    one.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [(label, Automaton.compiled(t)) for label, t in sorted(templates.items())]
        starting: dict[bytes, list[tuple[str, Automaton]]] = {}
        for label, automaton in automata:
            starting.setdefault(automaton.first, []).append((label, automaton))
        phrases: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for phrase, label in PHRASES.items():
            wording = words_of(phrase)
            phrases.setdefault(wording[0], []).append((wording, label))
        for batch in sliced(batches):
            rows = []
            for text in texts(batch).to_pylist():
                words = words_of(text)
                places, base, labels, score = [], set(), set(), 0.0
                for k, word in enumerate(words):
                    for wording, label in phrases.get(word, ()):
                        if words[k : k + len(wording)] == wording:
                            places.append(k)
                            base.add(label)
                    for label, automaton in starting.get(word, ()):
                        share = automaton.share(words, k)
                        score = max(score, share)
                        if share == 1.0:
                            labels.add(label)
                labels |= base
                rows.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op10_licenses(spark, sf_dir):
    return scanned(table(spark, sf_dir, "documents"))


QUERIES = {"op10_licenses": op10_licenses}
ORACLE: dict[str, str] = {}
