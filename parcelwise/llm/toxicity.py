"""Toxicity scores: averaged subword-bag embeddings under a linear softmax.

A word is the mean of the embeddings of itself and of its character n-grams; a text is
the mean of its words; a softmax over two classes reads the text's vector. Embeddings and
softmax are trained jointly, in numpy, on a bounded sample of labelled documents. Only
n-grams that toxic texts hold more often than chance allows are trained: tasks count them,
and each text of the sample then is a short row of their weights, which is all that the
fit sees. As the model is linear in the bag, a trained model gives every n-gram one
number, and map tasks score whole texts with it. There is no shuffle of texts.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkernel import mix, powers

#: Labelled documents that a fit uses at most: those of the least key hash.
SAMPLE_ROWS = 8_000
#: Tasks that count the sample's n-grams.
SAMPLE_TASKS = 4
#: Words and n-grams are hashed into so many bits.
BITS = 21
BUCKETS = 1 << BITS
GRAMS = (3, 4, 5, 6)
#: An n-gram is trained from so many toxic texts on, if its G statistic is large enough: about
#: one n-gram in two million has one of 25 by chance.
LEAST_TEXTS, LEAST_G = 4, 25.0
#: n-grams trained at most, those of the largest G.
MOST_FEATURES = 20_000
WIDTH = 3
EPOCHS = 300
RATE = 0.05
#: Text vectors are means, and small: this brings them into the softmax's range.
SCALE = 1000.0
DECAY = 1e-5
DROPOUT = 0.3
#: Weight of a toxic text in the loss; there are fewer of them.
TOXIC_WEIGHT = 2.0
#: Score of every text where nothing could be learned.
UNINFORMED = 0.1
#: Characters of a slice of text. A longer run without white space is read as several words, which
#: overlap, so that every character counts.
SLICE = 1 << 18
_STRIP = ".,;:!?\"'()[]{}<>|*#$%&-_"
_SEPARATES = np.array([chr(i).isspace() or chr(i) in _STRIP for i in range(0x3001)] + [False])


@dataclass(frozen=True)
class Model:
    """bucket and value: the trained n-grams; learned: whether there was anything to learn from."""

    bias: float
    learned: bool = True
    bucket: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def tag(self) -> int:
        return zlib.crc32(self.bucket.tobytes() + self.value.tobytes() + repr(self.bias).encode())


def _slices(texts: list[str | None]) -> Iterator[tuple[int, str]]:
    """(row, part): parts of at most SLICE characters, cut at white space where there is some."""
    for row, text in enumerate(texts):
        text, at = (text or "").lower(), 0
        while len(text) - at > SLICE:
            cut = max(text.rfind(" ", at + 1, at + SLICE), text.rfind("\n", at + 1, at + SLICE))
            yield row, text[at : cut if cut > 0 else at + SLICE]
            at = cut if cut > 0 else at + SLICE - max(GRAMS) + 1
        yield row, text[at:]


@dataclass(frozen=True)
class Bags:
    """n-grams of some texts: their bucket and the word they're in; per word its text and n-grams."""

    bucket: np.ndarray
    word: np.ndarray
    row: np.ndarray
    grams: np.ndarray


def _bags(part: list[tuple[int, str]]) -> Bags:
    code = np.frombuffer(("\n" + "\n".join(t for _, t in part) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    apart = _SEPARATES[np.minimum(code, 0x3001)]
    size, at = len(code), np.arange(len(code))
    up, down = powers(size)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(np.where(apart, np.uint64(1), mix(code.astype(np.uint64) + np.uint64(0x9E37)) | np.uint64(1)) * up[:size], out=total[1:])
    begins = ~apart
    begins[1:] &= apart[:-1]
    first = np.flatnonzero(begins)
    word_at = np.cumsum(begins) - 1
    stop = np.where(apart, at, size)
    stop = np.minimum.accumulate(stop[::-1])[::-1]  # the next separator from each place on

    def hashed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (mix((total[j] - total[i]) * down[i] + (j - i).astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int32)

    whole = stop[first] - first > max(GRAMS) - 2  # shorter words are n-grams with both their ends
    buckets, words = [hashed(first[whole] - 1, stop[first[whole]] + 1)], [np.flatnonzero(whole)]
    for n in GRAMS:
        i = at[: max(0, size - n + 1)]
        i = i[(stop[i + 1] >= i + n - 1) & ~apart[i + 1]]
        buckets.append(hashed(i, i + n))
        words.append(word_at[i + 1])
    word = np.concatenate(words)
    lengths = np.array([len(t) + 1 for _, t in part])
    rows = np.array([r for r, _ in part], np.int64)
    row = rows[np.searchsorted(np.cumsum(lengths), first - 1, side="right")] if len(first) else np.zeros(0, np.int64)
    return Bags(np.concatenate(buckets), word, row, np.bincount(word, minlength=len(first)))


def bags(texts: list[str | None]) -> Iterator[Bags]:
    """The n-grams of whole texts, in parts of about SLICE characters; rows are places in ``texts``."""
    part, size = [], 0
    for row, text in _slices(texts):
        part.append((row, text))
        size += len(text) + 1
        if size >= SLICE:
            yield _bags(part)
            part, size = [], 0
    if part:
        yield _bags(part)


def fit_rows(labels: np.ndarray, text: np.ndarray, feature: np.ndarray, weight: np.ndarray, bucket: np.ndarray, width: int = WIDTH, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Embeddings and softmax of the sample's sparse rows: ``weight`` of ``feature`` in ``text``.

    Full-batch Adam on the weighted mean cross-entropy; entries are left out at random, so
    that no single n-gram settles a text. The number of an n-gram is its embedding's product
    with the difference of the two softmax columns. Without both classes or without
    features nothing is learned, and every text gets UNINFORMED.
    """
    if not len(feature) or labels.min() == labels.max():
        return Model(float(np.log(UNINFORMED / (1 - UNINFORMED))), learned=False)
    n, k = len(labels), len(bucket)
    draw = np.random.default_rng(seed)
    table, column, bias = draw.normal(0, 0.01, (width, k)), draw.normal(0, 0.1, (width, 2)), np.zeros(2)
    one_hot = np.stack([1 - labels, labels], 1)
    cost = np.where(labels > 0, TOXIC_WEIGHT, 1.0)[:, None] / n
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (table, column, bias)]
    for step in range(1, epochs + 1):
        kept = (draw.random(len(weight)) >= DROPOUT) / (1 - DROPOUT) * weight * SCALE
        vector = np.stack([np.bincount(text, t[feature] * kept, n) for t in table])
        z = vector.T @ column + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - one_hot) * cost
        back = column @ d.T
        g_table = np.stack([np.bincount(feature, b[text] * kept, k) for b in back])
        for x, g, (m, v) in zip((table, column, bias), (g_table + DECAY * table, vector @ d, d.sum(0)), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-12)
    return Model(float(bias[1] - bias[0]), True, bucket.astype(np.int32), (SCALE * ((column[:, 1] - column[:, 0]) @ table)).astype(np.float32))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n1, n0) of a task's texts (text, y): toxic and clean texts that hold it.

    Texts are counted part by part; of a text that goes on in the next part the n-grams are carried over.
    """
    seen = np.zeros((2, BUCKETS), np.int32)
    for batch in batches:
        y = batch.column(1).to_numpy()
        carried = np.zeros(0, np.int64)

        def count(held: np.ndarray, y: np.ndarray = y) -> None:
            for c in (0, 1):
                bucket, n = np.unique(held[y[held // BUCKETS] == c] % BUCKETS, return_counts=True)
                seen[c][bucket] += n.astype(np.int32)

        for b in bags(batch.column(0).to_pylist()):
            held = np.unique(np.concatenate([carried, b.row[b.word] * BUCKETS + b.bucket]))
            last = len(held) and held[-1] // BUCKETS * BUCKETS
            count(held[held < last])
            carried = held[held >= last]
        count(carried)
    found = np.flatnonzero(seen[1])
    rest = np.flatnonzero((seen[1] == 0) & (seen[0] > 0))
    for some in (*np.array_split(found, 1 + len(found) // 100_000), *np.array_split(rest, 1 + len(rest) // 100_000)):
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[1][some].astype(np.int64)), pa.array(seen[0][some].astype(np.int64))], ["bucket", "n1", "n0"])


def g_statistic(n1: Column, n0: Column, toxic: int, clean: int) -> Column:
    """Twice the log-likelihood ratio of a bucket's counts against equal shares in both classes; 0 if rarer in toxic texts."""

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share = (n1 + n0) / F.lit(float(toxic + clean))
    g = part(n1, share * toxic) + part(n0, share * clean) + part(toxic - n1, (1 - share) * toxic) + part(clean - n0, (1 - share) * clean)
    return F.when(n1 / F.lit(float(toxic)) > n0 / F.lit(float(clean)), 2 * g).otherwise(0.0)


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, text, y): at most ``sample_rows`` labelled documents, those of the least id hash.

    An id with several labels counts as toxic if one says so. Null ids and labels other
    than 0 and 1 take no part; of rows that repeat an id one does.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null and __y in (0, 1)")
    picked = known.groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("__key"), F.col(text_col).alias("__text"))
    found = texts.join(F.broadcast(picked), F.col("__key") == F.col("__id"))
    return found.groupBy("__id").agg(F.min("__text").alias("text"), F.first("__y").alias("y")).withColumnRenamed("__id", "id")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of the labelled documents (see ``sample``).

    To the driver come the sample's labels and its rows of weights, at most SAMPLE_ROWS
    with MOST_FEATURES columns, and no text.
    """
    from .common import saved

    own = saved(sample(docs, labels, sample_rows, id_col, text_col, label_col))
    of = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = of.get(1, 0), of.get(0, 0)
    if not toxic or not clean:
        return Model(float(np.log(UNINFORMED / (1 - UNINFORMED))), learned=False)
    counts = own.select("text", "y").repartition(SAMPLE_TASKS).mapInArrow(_counts, "bucket int, n1 long, n0 long").groupBy("bucket").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    strong = counts.where(F.col("n1") >= LEAST_TEXTS).withColumn("g", g_statistic(F.col("n1"), F.col("n0"), toxic, clean)).where(F.col("g") >= LEAST_G)
    bucket = np.sort(strong.orderBy(F.desc("g"), "bucket").limit(MOST_FEATURES).select("bucket").toArrow().column(0).to_numpy())
    slot = np.full(BUCKETS, -1, np.int32)
    slot[bucket] = np.arange(len(bucket))

    def weights(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            n_words, keys, parts = np.zeros(len(texts)), [], []
            for b in bags(texts):
                n_words += np.bincount(b.row, minlength=len(texts))
                k = slot[b.bucket]
                own = k >= 0
                keys.append(b.row[b.word[own]] * len(bucket) + k[own])
                parts.append(1 / b.grams[b.word[own]])
            key, where = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            weight = np.bincount(where, np.concatenate(parts), len(key)) if len(key) else np.zeros(0)
            row = key // max(1, len(bucket))
            ends = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
            per_text = lambda v, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(v, kind))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), per_text(key % max(1, len(bucket)), pa.int32()), per_text(weight / np.maximum(n_words[row], 1), pa.float64())], ["id", "y", "k", "w"])

    kind = own.schema["id"].dataType.simpleString()
    rows = own.select("text", "id", "y").mapInArrow(weights, f"id {kind}, y int, k array<int>, w array<double>").orderBy("id").toArrow().combine_chunks()
    k = rows.column("k").combine_chunks()
    sizes = np.diff(np.asarray(k.offsets))
    return fit_rows(rows.column("y").to_numpy().astype(np.float64), np.repeat(np.arange(len(sizes)), sizes), k.flatten().to_numpy(), rows.column("w").combine_chunks().flatten().to_numpy(), bucket)


def text_scores(texts: list[str | None], table: np.ndarray, bias: float) -> np.ndarray:
    """Scores of whole texts; ``table`` has the number of each bucket."""
    total, n_words = np.zeros(len(texts)), np.zeros(len(texts))
    for b in bags(texts):
        word = np.bincount(b.word, table[b.bucket], len(b.row)) / np.maximum(b.grams, 1)
        total += np.bincount(b.row, word, len(texts))
        n_words += np.bincount(b.row, minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(bias + total / np.maximum(n_words, 1), -500, 500)))


def _table(model: Model) -> np.ndarray:
    """The model's numbers by bucket, kept with the Python worker between tasks."""
    shelf = sys.modules.setdefault("_parcelwise_shelf", types.ModuleType("_parcelwise_shelf"))
    if shelf.__dict__.get("toxic_tag") != (tag := model.tag()):
        table = np.zeros(BUCKETS, np.float32)
        table[model.bucket] = model.value
        shelf.toxic_tag, shelf.toxic_table = tag, table
    return shelf.toxic_table


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of each row; empty and null texts get the bias alone.

    The model is at most MOST_FEATURES numbers and goes with the task.
    """

    def run(batches):
        table = _table(model)
        for batch in batches:
            score = text_scores(batch.column(1).to_pylist(), table, model.bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def filtered(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without rows whose score reaches ``threshold``; all columns stay.

    Null ids and texts are judged like others. Where nothing was learned every row stays.
    """
    if not model.learned:
        return docs

    @F.pandas_udf("double")
    def score(text):
        return type(text)(text_scores(list(text), _table(model), model.bias))

    return docs.where(score(F.col(text_col)) < threshold)
