"""Quality rules: repetition coverage of n-grams and lines.

Rolling hashes of several n-gram lengths, in numpy inside map tasks. There is no
shuffle: each text is judged alone, and whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import Chunk, chunks

#: Most characters (as a share of those in words) that may stand in n-grams seen before, by n.
MAX_GRAM_SHARE = {5: 0.15, 6: 0.14, 8: 0.12, 10: 0.10}
MAX_DUP_LINE_SHARE = 0.30
MAX_DUP_LINE_CHAR_SHARE = 0.20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: equal to an earlier one of its text; found twice or more in its text."""
    key = h + doc.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    if len(key) > 1:
        same[1:] = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    later, often = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order] = same
    both = same.copy()
    both[:-1] |= same[1:]
    often[order] = both
    return later, often


def _covered(c: Chunk, at: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words that lie in one of the n-grams that begin at ``at``."""
    edge = np.zeros(len(c.hash) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge)[:-1] > 0


def measure(c: Chunk) -> dict[str, np.ndarray]:
    """Counts for each text of a chunk."""
    chars = (c.data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(chars & ~c.space, dtype=np.int64)])
    length = before[c.end] - before[c.start]
    _, n_words = c.words_of()
    per_text = lambda mask, w: np.bincount(c.doc[mask], weights=w[mask], minlength=c.n).astype(np.int64)
    out = {"n_words": n_words, "word_chars": before[c.offsets[1:]] - before[c.offsets[:-1]], "n_symbols": _sums(_SYMBOL[c.data], c.offsets)}

    feed = c.data == 10
    ends = feed.copy()
    start = np.unique(np.concatenate([c.offsets[:-1], np.flatnonzero(feed) + 1]))
    doc = np.searchsorted(c.offsets, start, side="right") - 1
    keep = (start < len(c.data)) & (doc < c.n)
    start, doc = start[keep], doc[keep]
    stop = np.flatnonzero(ends)
    where = np.searchsorted(stop, start)
    end = np.minimum(np.append(stop, len(c.data))[where], c.offsets[doc + 1])
    worded = before[end] > before[start]
    start, end, doc = start[worded], end[worded], doc[worded]
    again, _ = _repeats(doc, c.span(start, end))
    out["n_lines"] = np.bincount(doc, minlength=c.n)
    out["n_dup_lines"] = np.bincount(doc[again], minlength=c.n)
    out["dup_line_chars"] = np.bincount(doc[again], weights=(before[end] - before[start])[again], minlength=c.n).astype(np.int64)

    at, h = c.grams(3)
    _, often = _repeats(c.doc[at], h)
    out["n_repeat_words"] = per_text(_covered(c, at[often], 3), np.ones(len(length)))
    for n in MAX_GRAM_SHARE:
        at, h = c.grams(n)
        later, _ = _repeats(c.doc[at], h)
        out[f"dup_{n}gram_chars"] = per_text(_covered(c, at[later], n), length)
    return out


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts for each row of ``docs``: the id and the measures.

    Null text counts as empty: all zero. Equal rows give equal rows. Ids may be null.
    """
    names = [*COLUMNS, "n_lines", "dup_line_chars", *(f"dup_{n}gram_chars" for n in MAX_GRAM_SHARE)]

    def run(batches):
        for batch in batches:
            for a, b, c in chunks(batch.column(1), lower=False):
                m = measure(c)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(m[k].astype(np.int64)) for k in names)], ["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{k} long" for k in names)).withColumnRenamed("id", id_col)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``.

    Base: fewer than 50 words, or more than half of the words in 3-word windows found
    twice or more. Method: too many characters in repeated n-grams (MAX_GRAM_SHARE) or
    lines. Empty texts fail the base.
    """
    m = measured(docs, id_col, text_col)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    bad = F.lit(False)
    for n, share in MAX_GRAM_SHARE.items():
        bad = bad | (F.col(f"dup_{n}gram_chars") > share * F.col("word_chars"))
    bad = bad | (F.col("n_dup_lines") > MAX_DUP_LINE_SHARE * F.col("n_lines")) | (F.col("dup_line_chars") > MAX_DUP_LINE_CHAR_SHARE * F.col("word_chars"))
    return m.withColumns({"base_failed": base, "kept": ~base & ~bad})
