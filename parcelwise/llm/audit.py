"""Filter interaction audit: what each filter removes in every order of the filters.

Map tasks scan Arrow buffers: byte classes and prefix sums count words, capitals and symbols
of whole texts, and sorted word hashes, verified on the words' bytes, count distinct words.
A document is then five bits. Equal masks are counted together before anything is
ordered, so the 120 orders work on counts of at most 32 masks a part.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small, text_or_empty
from .textkernel import Chunk, chunks

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 3
SYMBOLS = b"#$%&*|"
#: Digests of repeated texts that may be broadcast.
BROADCAST_ROWS = 200_000
#: Bytes of a word that are compared at once, and the length from which on words are compared one by one.
_LANE, _LONG = 8, 64
_MARK = np.zeros(256, bool)
_MARK[list(SYMBOLS)] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _equal(c: Chunk, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether words i and j have the same bytes."""
    size = c.end[i] - c.start[i]
    same = size == c.end[j] - c.start[j]
    padded = np.concatenate([c.data, np.zeros(_LANE, np.uint8)])
    lanes = np.lib.stride_tricks.sliding_window_view(padded, _LANE)
    left = np.flatnonzero(same)
    for at in range(0, _LONG, _LANE):
        left = left[size[left] > at]
        if not len(left):
            return same
        over = np.maximum(0, _LANE - (size[left] - at))
        x, y = (lanes[c.start[w[left]] + at].view(">u8").ravel() >> (8 * over).astype(np.uint64) for w in (i, j))
        same[left[x != y]] = False
        left = left[x == y]
    for k in left[size[left] > _LONG]:
        same[k] = c.data[c.start[i[k]] : c.end[i[k]]].tobytes() == c.data[c.start[j[k]] : c.end[j[k]]].tobytes()
    return same


def distinct_words(c: Chunk) -> np.ndarray:
    """Number of different words of each text: runs of equal hashes, where each word equals the one before; else, by a set."""
    key = c.hash + c.doc.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    order = np.argsort(key)
    one, two = order[:-1], order[1:]
    twin = key[one] == key[two]
    one, two = one[twin], two[twin]
    sure = (c.doc[one] == c.doc[two]) & _equal(c, one, two)
    count = np.bincount(c.doc, minlength=c.n) - np.bincount(c.doc[two], minlength=c.n)
    for d in np.unique(c.doc[np.concatenate([one[~sure], two[~sure]])]):
        mine = np.flatnonzero(c.doc == d)
        count[d] = len({c.data[a:b].tobytes() for a, b in zip(c.start[mine], c.end[mine], strict=True)})
    return count


def measure(c: Chunk) -> dict[str, np.ndarray]:
    """Counts for each text of a chunk."""
    return {
        "n_words": np.bincount(c.doc, minlength=c.n),
        "n_distinct": distinct_words(c),
        "n_capitals": _sums(_CAPITAL[c.data], c.offsets),
        "n_points": _sums((c.data & 0xC0) != 0x80, c.offsets),
        "n_symbols": _sums(_MARK[c.data], c.offsets),
    }


def failures(m: dict[str, np.ndarray]) -> np.ndarray:
    """Bits 0 to 3: the text fails filter A to D."""
    bits = (m["n_words"] < MIN_WORDS, 100 * m["n_distinct"] < MIN_DISTINCT_PERCENT * m["n_words"], 100 * m["n_capitals"] > MAX_CAPITAL_PERCENT * m["n_points"], m["n_symbols"] > 0)
    return sum(b.astype(np.int64) << k for k, b in enumerate(bits))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask) of each row of ``docs``: bit k of the mask tells that the k-th filter fails.

    Null text counts as empty, and a null part as the empty string. The last filter fails
    for texts that a row of smaller id holds too (equal by their SHA-256); a null id is neither
    smaller nor greater than another, so its row passes, and so do all rows of the smallest id.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    body = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(body, 256)).alias("digest"), body.alias("body"))

    def scan(batches):
        for batch in batches:
            for a, b, c in chunks(batch.column(3), lower=False):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), pa.array(failures(measure(c)))], ["id", "part", "digest", "bits"])

    bits = saved(rows.mapInArrow(scan, f"id {kind}, part string, digest binary, bits long"))
    again = saved(bits.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("digest", "least"))
    both = bits.join(small(again, BROADCAST_ROWS), "digest", "left")
    return both.select("id", "part", (F.col("bits") + F.when(F.col("id") > F.col("least"), 1 << 4).otherwise(0)).cast("int").alias("mask"))


def counted(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask, and those among them labelled good and toxic.

    labels: doc_id, quality, toxic. Rows that repeat an id count once: any 1 among them holds.
    """
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    told = masks.join(known, F.col("id") == F.col("__id"), "left")
    return told.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def audited(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, with what that step does.

    counts: see ``counted``. Numbers are 0 where nothing falls; a table without rows gives none.
    """
    steps = [(("".join(o)), s + 1, 1 << filters.index(o[s]), sum(1 << filters.index(f) for f in o[:s])) for o in permutations(filters) for s in range(len(filters))]
    every = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(own).alias("own"), F.lit(before).alias("before")) for o, s, own, before in steps))
    at = counts.select("*", F.explode(every).alias("__s")).select("part", "mask", "n", "good", "toxic", "__s.*")
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0
    here = fails & ~gone
    total = lambda when, of: F.sum(F.when(when, F.col(of)).otherwise(0)).alias
    out = at.groupBy("part", "filter_order", "step", "own").agg(
        total(~fails & ~gone, "n")("kept"), total(here, "n")("removed"), total(fails & gone, "n")("redundant"), total(F.col("mask") == F.col("own"), "n")("unique_fails"), total(here, "good")("good_lost"), total(here, "toxic")("toxic_lost")
    )
    shapley = out.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return out.join(shapley, ["part", "own"]).drop("own")
