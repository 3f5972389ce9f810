"""Best-fit packing of token sequences by bin completion.

Lengths are whole numbers up to the capacity, so the histogram of lengths is bounded
by the capacity however many documents there are. The driver plans on the histogram
alone: runs of equal sequences (a pattern of lengths and how often it's used). Ranks
of documents within their length, dealt out by key, then map each to its place.
"""

from __future__ import annotations

import sys
import types
import unicodedata
import zlib
from bisect import bisect_right
from struct import pack as packed_ints

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

CAPACITY = 4096
END_ID = 1
#: Words whose ids a Python worker keeps (it starts anew beyond that): about 150 MB.
CACHED_WORDS = 600_000
#: Rows of one rank bucket, about.
BUCKET_ROWS = 20_000
#: Fillings that the search tries for each distinct length, and besides, before it keeps the
#: best solution so far: enough for a whole descent, and for going back from its end.
NODES_PER_LENGTH, NODES = 4, 1_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- tokens -----------------------------------------------------------------------


class WordIds:
    """Ids of whole texts, word by word with a cache.

    White space always parts tokens in this vocabulary, so a text's ids are those of
    its words in order. Texts with special tokens or characters on which Python and the
    tokenizer differ go through the tokenizer whole.
    """

    #: Separators that only Python counts as space, and the letter whose lower case depends on its place.
    ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "Σ", "<|")

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.byte = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, list[int]] = {}

    def piece(self, part: str) -> list[int]:
        if (ids := self.pieces.get(part)) is None:
            if len(self.pieces) >= CACHED_WORDS:
                self.pieces.clear()
            ids = self.pieces[part] = [t.id for t in self.model.tokenize("".join([self.byte[b] for b in part.encode()]))]
        return ids

    def __call__(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if any(c in text for c in self.ODD):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower().split()
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            known = self.words
            if len(known) > CACHED_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    if w.isascii() and w.isalpha():  # one part, and its bytes stand for themselves
                        ids = [t.id for t in self.model.tokenize(w)]
                    else:
                        ids = [i for p in self.parts(w) for i in self.piece(p)]
                    known[w] = packed_ints(f"<{len(ids)}I", *ids)
            return b"".join(map(known.__getitem__, words))


def word_ids(path: str) -> WordIds:
    """One per Python worker, kept between tasks."""
    shelf = sys.modules.setdefault("_parcelwise_shelf", types.ModuleType("_parcelwise_shelf"))
    kept = shelf.__dict__.setdefault("word_ids", {})
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): the token ids of each text, then end_id,
    cut only where longer than ``capacity``. Null text is empty: one piece of length 1."""
    path = tokenizer or default_tokenizer()
    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def run(batches):
        ids_of, last = word_ids(path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows, out = [], [[], [], [], [], []]
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = ids_of(text or "") + last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(i)
                    for column, v in zip(out, (k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        column.append(v)
            own = batch.column(0).take(pa.array(rows, pa.int64()))
            cols = [own, pa.array(out[0], pa.int32()), *(pa.array(v, pa.int64()) for v in out[1:4])]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols, names = [*cols, pa.array(out[4], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(run, fields)


# --- the plan ---------------------------------------------------------------------


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on the histogram: runs of (pattern, how many sequences)."""
    free: dict[int, list[list]] = {}
    order: list[int] = []  # residuals in use, ascending

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in free:
            free[room] = []
            order.insert(bisect_right(order, room), room)
        free[room].append([pattern, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_right(order, length - 1)
            if at == len(order):
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, (length,) * each, left // each)
                if left % each:
                    put(capacity - left % each * length, (length,) * (left % each), 1)
                break
            room = order[at]
            pattern, n = free[room].pop()
            if not free[room]:
                del free[room], order[at]
            take = min(n, left)
            if n > take:
                put(room, pattern, n - take)
            put(room - length, (*pattern, length), take)
            left -= take
    return [(p, n) for runs in free.values() for p, n in runs]


def dominates(f: tuple[int, ...], g: tuple[int, ...]) -> bool:
    """Can the items of g be shared out into the items of f? Then g is no better a filling."""
    rooms = list(f)
    for item in g:
        fits = [r for r in rooms if r >= item]
        if not fits:
            return False
        r = min(fits)
        rooms.remove(r)
        rooms.append(r - item)
    return True


def fillings(room: int, lengths: list[int], counts: dict[int, int], most: int = 3, tries: int = 150) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, least waste first. lengths: those in stock, ascending."""
    found: list[tuple[int, tuple[int, ...]]] = []
    budget = [tries]

    def grow(left: int, cap: int, chosen: tuple[int, ...]) -> None:
        budget[0] -= 1
        top = min(left, cap)
        if left == top and counts.get(left, 0) > chosen.count(left):
            found.append((0, (*chosen, left)))
            return
        at = bisect_right(lengths, top)
        leaf = True
        for a in lengths[max(0, at - 12) : at][::-1]:
            if counts[a] > chosen.count(a):
                leaf = False
                grow(left - a, a, (*chosen, a))
                if budget[0] <= 0 or sum(w == 0 for w, _ in found) >= most:
                    return
        if leaf:
            found.append((left, chosen))

    grow(room, room, ())
    out: list[tuple[int, ...]] = []
    for _, f in sorted(set(found), key=lambda x: (x[0], len(x[1]), tuple(-v for v in x[1]))):
        if not any(dominates(g, f) for g in out):
            out.append(f)
        if len(out) == most:
            break
    return out or [()]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int | None = None) -> list[tuple[tuple[int, ...], int]]:
    """Runs (pattern, number of sequences) that hold the histogram's lengths exactly.

    Bin completion: the largest length in stock opens a sequence, its undominated
    fillings are the branches, best first, and a filling is used as often as stock
    allows. A branch ends as soon as its waste rules out fewer sequences than the
    incumbent (at first best-fit decreasing). It ends at the lower bound, or after
    ``nodes`` fillings with the incumbent.
    """
    counts = {k: v for k, v in histogram.items() if v}
    nodes = NODES + NODES_PER_LENGTH * len(counts) if nodes is None else nodes
    if not counts:
        return []
    total = sum(k * v for k, v in counts.items())
    bound = -(-total // capacity)
    best = best_fit(counts, capacity)
    used = sum(n for _, n in best)
    if used == bound:
        return best
    lengths = sorted(counts)
    stack: list[list] = []  # [branches, waste before, applied (pattern, n) or None]
    waste = 0

    def take(pattern: tuple[int, ...], n: int) -> None:
        for a in pattern:
            counts[a] -= n
            if not counts[a]:
                del lengths[bisect_right(lengths, a) - 1]

    def give(pattern: tuple[int, ...], n: int) -> None:
        for a in pattern:
            if not counts[a]:
                lengths.insert(bisect_right(lengths, a), a)
            counts[a] += n

    descend = True
    while nodes > 0:
        if descend:
            if not lengths:
                best, used = [s[2] for s in stack], sum(s[2][1] for s in stack)
                if used == bound:
                    break
                descend = False
                continue
            top = lengths[-1]
            counts[top] -= 1
            options = fillings(capacity - top, lengths, counts)
            counts[top] += 1
            stack.append([[(top, *f) for f in options][::-1], waste, None])
        if not stack:
            break
        branches, before, applied = stack[-1]
        if applied:
            give(*applied)
            stack[-1][2] = None
        waste = before
        if not branches:
            stack.pop()
            descend = False
            continue
        nodes -= 1
        pattern = branches.pop()
        n = min(counts[a] // pattern.count(a) for a in set(pattern))
        waste = before + n * (capacity - sum(pattern))
        if waste > (used - 1) * capacity - total:
            waste, descend = before, False
            continue
        take(pattern, n)
        stack[-1][2] = (pattern, n)
        descend = True
    return best


def places(runs: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence, how many in a sequence, and first offset of each run that holds it."""
    at: dict[int, list] = {}
    seen: dict[int, int] = {}
    first = 0
    for pattern, n in runs:
        pattern = sorted(pattern, reverse=True)
        offset = 0
        for length in dict.fromkeys(pattern):
            each = pattern.count(length)
            at.setdefault(length, []).append((seen.get(length, 0), first, each, offset))
            seen[length] = seen.get(length, 0) + n * each
            offset += each * length
        first += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in at.items()}


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset. Other columns stay."""
    found = saved(found)
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    at = places(plan(histogram, capacity))
    buckets = max(1, sum(histogram.values()) // BUCKET_ROWS)
    key = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets))
    dealt = found.withColumn("bucket", key)
    before = F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    rank = F.row_number().over(W.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("rank", rank).join(starts, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("rank")).drop("base", "bucket")

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("length", "rank"))
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for v in np.unique(length):
                own = length == v
                start, first, each, base = at[int(v)]
                k = np.searchsorted(start, rank[own], side="right") - 1
                j = rank[own] - start[k]
                seq[own], offset[own] = first[k] + j // each[k], base[k] + j % each[k] * v
            keep = batch.select([n for n in batch.schema.names if n != "rank"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(seq), pa.array(offset)], [*keep.schema.names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("rank").schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, fields)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Packs all documents into few sequences of at most ``capacity`` tokens: one row per piece.

    Repeated rows are packed once each; null ids are kept. An empty table gives no rows.
    """
    return packed(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, keep_ids), capacity).withColumnRenamed("id", id_col)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence, from ``pack(..., keep_ids=True)``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(F.transform(parts, lambda p: p["ids"]), F.lit(b""), lambda a, b: F.concat(a, b))
    return placed.groupBy("sequence_id").agg(whole.alias("ids"))
