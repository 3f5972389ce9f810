"""MinHash near-duplicates by bottom-k sketches of one hash function.

1. Map tasks turn each whole text into its set of word shingles (64-bit hashes) and
   keep the k least: the sketch. Texts with equal sets are one class from here on.
2. Inverted lists of the retained values (and, where those are long, of full sets). If two sets have similarity s, the k least
   values of their union hold about s * k shared ones; a pair at the threshold falls
   under ``need`` only by a deviation of six standard deviations. So two such sets
   share one of the ``size - need + 1`` rarest retained values of either, and a list
   needs only those. Values that one class alone retains can't link and go.
3. The shared part of the k least values of both sketches' union estimates the
   similarity; pairs under ``need`` go. The others are verified on full sets.
4. Links make components (see ``components``).

Texts of fewer words than a shingle are one shingle; empty ones have none and link
with nothing. No step holds a group of copies in one task, or drops one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small
from .components import linked
from .textkernel import chunks, mix

#: Values that a sketch retains.
SKETCH = 64
#: Up to so many class ids are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_IDS = 400_000


def need_of(k: int, percent: int) -> int:
    s = percent / 100
    return max(1, math.floor(k * s - 6 * math.sqrt(k * s * (1 - s))))


def _sets(batch_column, n: int):
    """Sorted distinct shingle hashes of each text."""
    for _, _, c in chunks(batch_column, lower=True):
        first, count = c.words_of()
        at, h = c.grams(n)
        begin, end = np.searchsorted(at, first), np.searchsorted(at, first + count)
        for i in range(c.n):
            if count[i] >= n:
                yield np.unique(h[begin[i] : end[i]])
            elif count[i]:
                total = np.uint64(count[i])
                for w in c.hash[first[i] : first[i] + count[i]]:
                    total = mix(np.array([total]))[0] ^ w
                yield mix(np.array([total]))
            else:
                yield np.zeros(0, np.uint64)


def _hash_of(values: np.ndarray, seed: int) -> int:
    with np.errstate(over="ignore"):
        return int(mix(values ^ np.uint64(seed)).sum(dtype=np.uint64).astype(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array((np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)).view(np.int64)))


def sketches(docs: DataFrame, words: int, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, sig, sketch): size and hash of the shingle set, and its k least values."""

    def run(batches):
        for batch in batches:
            sets = _sets(batch.column(1), words)
            size, sig, kept = [], [], []
            for s in sets:
                size.append(len(s))
                sig.append(_hash_of(s, 0x5851F42D4C957F2D) if len(s) else None)
                kept.append(s[:k].copy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(sig, pa.int64()), _lists(kept)], ["id", "n", "sig", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body")).mapInArrow(run, "id long, n long, sig long, sketch array<long>")


def full_sets(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sig, shingles) of whole texts."""

    def run(batches):
        for batch in batches:
            out = [s for s in _sets(batch.column(0), words)]
            yield pa.RecordBatch.from_arrays([pa.array([_hash_of(s, 0x5851F42D4C957F2D) if len(s) else None for s in out], pa.int64()), _lists(out)], ["sig", "shingles"])

    return docs.select(F.col(text_col).alias("body")).mapInArrow(run, "sig long, shingles array<long>")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = SKETCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id, kept, class_sig.

    Documents are linked if ``100 * shared >= percent * union`` of their shingle sets.
    component_id is the least id reachable, kept tells whether it is the row's own.
    Rows that repeat an id are one node: what is linked with one is linked with all. A
    null id is never the least unless all ids of the component are null, and then kept
    is false but for empty texts' rows, which link with nothing.
    """
    need = need_of(k, percent)
    s = saved(sketches(docs, words, k, id_col, text_col))
    full = s.where("sig is not null")
    classes = saved(full.groupBy("sig").agg(F.min("id").alias("least"), F.min("n").alias("n"), F.first("sketch").alias("sketch")))

    # Rarest retained values: those of one class only come first and link with nothing.
    values = classes.select("sig", F.explode("sketch").alias("v"))
    common = values.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    ranked = values.join(common, "v").groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("found"))
    held = F.size("sketch")
    least = F.least(F.lit(need), F.ceil(F.col("n") * percent / 100).cast("int"))
    ranked = ranked.join(classes.select("sig", "n", held.alias("held"), least.alias("need")), "sig")
    alone = F.col("held") - F.size("found")
    prefix = F.col("held") - F.col("need") + 1 - alone
    info = F.struct((F.col("held") - alone - F.col("at")).alias("left"), F.col("need"), F.col("n"))
    lists = ranked.where(prefix > 0).select(F.posexplode(F.slice("found", 1, prefix)).alias("at", "f"), F.col("sig").alias("node"), "held", "need", "n", "found")
    lists = saved(lists.select(F.col("f.v").alias("key"), "node", info.alias("info")))

    def fits(x: Column, y: Column) -> Column:
        """Can values from this one on still be as many as needed? If none before is shared, no others can."""
        return (F.least(x["left"], y["left"]) >= F.greatest(x["need"], y["need"])) & (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"]))

    # Full sets of the classes that stand in a list, from one of their documents each.
    nodes = lists.select(F.col("node").alias("sig")).distinct()
    picked = small(saved(classes.join(nodes, "sig", "left_semi").select(F.col("least").alias("__pick")).distinct()), BROADCAST_IDS)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).join(picked, F.col("__id").eqNullSafe(F.col("__pick")), "left_semi")
    sets = saved(full_sets(texts, words, "__id", "__text").where("sig is not null").groupBy("sig").agg(F.first("shingles").alias("shingles")))
    drafts = classes.select("sig", "n", "sketch")

    def verify(pairs: DataFrame) -> DataFrame:
        a = drafts.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        b = drafts.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        likely = pairs.join(b, "b").join(a, "a").where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
        shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
        bar = F.least(F.lit(need), F.ceil(F.greatest("na", "nb") * percent / 100).cast("int"))
        likely = likely.where(shared >= bar).select("a", "b", "na", "nb")
        x = sets.select(F.col("sig").alias("a"), F.col("shingles").alias("fa"))
        y = sets.select(F.col("sig").alias("b"), F.col("shingles").alias("fb"))
        both = F.size(F.array_intersect("fa", "fb"))
        return likely.join(y, "b").join(x, "a").select("a", "b", "na", "nb", both.alias("both")).where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")

    def refine(long: DataFrame) -> DataFrame:
        """Lists of full sets: similar ones share one of each set's rarest ``n - ceil(s * n) + 1`` shingles."""
        rows = saved(sets.join(long.select(F.col("node").alias("sig")).distinct(), "sig", "left_semi").select("sig", F.size("shingles").alias("n"), F.explode("shingles").alias("v")))
        often = rows.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        order = rows.join(often, "v").groupBy("sig").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "v"))).alias("found"))
        rare = F.size("found") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
        after = F.size("found") - F.col("at")
        rows = order.where(rare > 0).select(F.posexplode(F.slice("found", 1, rare)).alias("at", "f"), F.col("sig").alias("node"), "n", "found")
        return rows.select(F.col("f.v").alias("key"), "node", F.struct(after.alias("left"), "n").alias("info"))

    def refined_fits(x: Column, y: Column) -> Column:
        return F.least(x["left"], y["left"]) * (100 + percent) >= percent * (x["n"] + y["n"])

    # A set with few values rarer than the shared one is close to what its group has in common.
    groups = linked(lists, verify, fits, refine, refined_fits, lambda info: -info["left"])
    # Ids that several classes share (repeated ids) tie those classes too.
    member = full.select("id", "sig").distinct().join(groups.select(F.col("node").alias("sig"), "comp"), "sig", "left").select("id", "sig", F.coalesce("comp", "sig").alias("comp"))
    of_class = saved(member.groupBy("sig").agg(F.first("comp").alias("comp"), F.min("id").alias("least")))
    twice = full.where("id is not null").groupBy("id").agg(F.min("sig").alias("a"), F.max("sig").alias("b")).where("a != b")
    if twice.limit(1).count():
        ids = twice.select("id")
        ties = member.join(ids, "id", "left_semi").groupBy("id").agg(F.min("comp").alias("hub"))
        tied = member.join(ties, "id").select(F.col("hub").alias("a"), F.col("comp").alias("b")).where("a != b")
        over = linked_edges(tied)
        of_class = saved(of_class.join(over.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("sig", F.coalesce("top", "comp").alias("comp"), "least"))
    of_comp = of_class.groupBy("comp").agg(F.min("least").alias("component_id"))
    label = of_class.join(of_comp, "comp").select("sig", "component_id")
    out = s.select("id", "n", "sig").join(label, "sig", "left")
    comp = F.when(F.col("sig").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("sig").isNull() | (F.col("id") == comp), F.lit(False)).alias("kept"), F.col("sig").alias("class_sig"))


def linked_edges(edges: DataFrame) -> DataFrame:
    from .components import components

    return components(edges)
