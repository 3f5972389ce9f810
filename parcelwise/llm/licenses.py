"""License scans by diagonal voting.

1. Map tasks turn each whole text into all its rolling k-grams of words: (document, place, hash).
2. Spark joins them to the k-grams of the templates. A hit votes for a diagonal, the place
   in the text less the place in the template; votes are gathered as bits, so that repeated rows count once.
3. Diagonals that are no further apart than a template's edits are merged into bands. A band
   with too few different votes can't hold the template (a changed word spoils at most k of
   its k-grams) and goes.
4. What is left is verified on words: the least number of edits between the template and a
   run of words of the text.

So a template is found exactly if a run of the text lies within its edits, which are a fifth of
its words, and fewer for short templates: one for each k words after the first k.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small
from .textkernel import PUNCTUATION, Chunk, chunks, utf8

#: Words of a k-gram.
GRAM = 3
#: Edits allowed, as a share of a template's words.
EDITS = 0.2
#: Bits of a vote's mask.
_BITS = 64
#: Numbers that may be broadcast.
BROADCAST_LONGS = 2_000_000


class Template(NamedTuple):
    label: str
    text: str
    exact: bool = False


#: Phrases whose words must stand as they are.
PHRASES = (Template("mit", "under the mit license", True), Template("apache-2", "apache license version 2", True), Template("cc-by-nc", "cc by nc", True))
#: Public notices by which licenses are usually stated.
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    Template("mit", "released under the terms of the MIT license"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    Template("gpl-3", "licensed under the GNU General Public License, version 3"),
    Template("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Template("proprietary", "all rights reserved"),
)


def _words(text: str) -> tuple[list[bytes], Chunk]:
    c = Chunk(*utf8(pa.array([text])), lower=True, apart=PUNCTUATION)
    return [c.data[a:b].tobytes() for a, b in zip(c.start, c.end, strict=True)], c


def edits_of(n: int, exact: bool, k: int = GRAM) -> int:
    """Edits allowed in a template of n words, so that one k-gram stays whole at least."""
    return 0 if exact else min(int(n * EDITS + 1e-9), (n - k) // k)


def _costs(template: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Least edits between the whole template and a stretch of ``run`` that ends before each place."""
    step = np.arange(len(run) + 1)
    row = np.zeros(len(run) + 1, np.int64)
    for i, word in enumerate(template, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (run != word), row[1:] + 1)
        row = np.minimum.accumulate(new - step) + step
    return row


def best_run(template: list[bytes], words: list[bytes]) -> tuple[int, int, int]:
    """(edits, first word, word after the last) of the stretch of ``words`` nearest to the template, the first that ends."""
    code: dict[bytes, int] = {}
    t, w = (np.array([code.setdefault(x, len(code)) for x in xs], np.int64) for xs in (template, words))
    cost = _costs(t, w)
    stop = int(cost.argmin())
    back = _costs(t[::-1], w[:stop][::-1])
    return int(cost[stop]), stop - int(back.argmin()), stop


def _bands(votes: list[tuple[int, int, int]], edits: int) -> list[tuple[int, int, int]]:
    """(least diagonal, greatest, different votes) of diagonals merged over gaps of up to ``edits``; votes: (diagonal, block, mask)."""
    out: list[list] = []
    for diagonal, block, mask in sorted(votes):
        if not out or diagonal - out[-1][1] > edits:
            out.append([diagonal, diagonal, {}])
        out[-1][1] = diagonal
        out[-1][2][block] = out[-1][2].get(block, 0) | (mask & (1 << _BITS) - 1)
    return [(a, b, sum(m.bit_count() for m in masks.values())) for a, b, masks in out]


def _found(words, n_words: int, hits: Sequence[dict], templates: list[tuple[list[bytes], int]], k: int) -> list[dict]:
    by: dict[int, list] = {}
    for h in hits:
        by.setdefault(h["template"], []).append((h["diagonal"], h["block"], h["mask"]))
    out = []
    for t in sorted(by):
        template, edits = templates[t]
        need = len(template) - k + 1 - k * edits
        for low, high, votes in _bands(by[t], edits):
            if votes < need:
                continue
            begin, end = max(0, low - edits), min(n_words, high + len(template) + edits)
            run = words(begin, end)
            cost, start, stop = (0, 0, len(run)) if run == template else best_run(template, run)
            if cost <= edits:
                out.append({"template": t, "first_word": begin + start, "n_words": stop - start, "score": 1 - cost / len(template)})
    return out


def scanned(docs: DataFrame, templates: Sequence[Template] = PHRASES + NOTICES, k: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, found) for each row of ``docs``; found: array of (template, first_word, n_words, score).

    template is a number in ``templates`` and score the share of its words that are as they
    should be. Templates need k words at least. Exact templates give every place; of the
    others a band gives its nearest run. Words are runs of digits, letters and non-ASCII
    characters; A-Z count as a-z. Null and empty texts have no words. Rows equal in id and text
    give equal rows; ids may be null, and other columns aren't looked at.
    """
    spark = docs.sparkSession
    known = [_words(t.text) for t in templates]
    if any(len(words) < k for words, _ in known):
        raise ValueError(f"a template has fewer than {k} words")
    shapes = [(words, edits_of(len(words), t.exact, k)) for t, (words, _) in zip(templates, known, strict=True)]
    places = [(int(h.astype(np.int64)), t, int(at)) for t, (_, c) in enumerate(known) for at, h in zip(*c.grams(k), strict=True)]
    table = spark.createDataFrame(places, "hash long, template int, at int")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("body"))

    def grams(batches):
        for batch in batches:
            for a, b, c in chunks(batch.column(2), lower=True, apart=PUNCTUATION):
                at, h = c.grams(k)
                doc, first = c.doc[at], c.words_of()[0]
                own = pa.array(doc)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(own), batch.column(1).slice(a, b - a).take(own), pa.array(at - first[doc]), pa.array(h.view(np.int64))], ["id", "th", "place", "hash"])

    rolling = rows.where("body is not null").mapInArrow(grams, f"id {kind}, th long, place long, hash long")
    hits = rolling.join(small(table, BROADCAST_LONGS), "hash").select("id", "th", "template", (F.col("place") - F.col("at")).alias("diagonal"), F.floor(F.col("at") / _BITS).cast("int").alias("block"), (F.col("at") % _BITS).alias("bit"))
    votes = hits.groupBy("id", "th", "template", "diagonal", "block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    by_doc = saved(votes.groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_list(F.struct("template", "diagonal", "block", "mask")).alias("hits")))
    both = rows.join(small(by_doc, BROADCAST_LONGS, longs=4 * F.size("hits") + 4), F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")
    found = pa.list_(pa.struct([("template", pa.int32()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64())]))

    def verify(batches):
        for batch in batches:
            every = batch.column(2)
            for a, b, c in chunks(batch.column(1), lower=True, apart=PUNCTUATION, hashed=False):
                first, count = c.words_of()
                out = []
                for i, hits in enumerate(every.slice(a, b - a).to_pylist()):
                    words = lambda x, y, o=first[i], c=c: [c.data[s:e].tobytes() for s, e in zip(c.start[o + x : o + y], c.end[o + x : o + y], strict=True)]
                    out.append(_found(words, int(count[i]), hits, shapes, k) if hits else [])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(count.astype(np.int64)), pa.array(out, found)], ["id", "n_words", "found"])

    return both.select("id", "body", "hits").mapInArrow(verify, f"id {kind}, n_words long, found array<struct<template: int, first_word: long, n_words: long, score: double>>").withColumnRenamed("id", id_col)
