import itertools
import random
import re
import tracemalloc

import pyarrow as pa

from parcelwise.llm import components, minhash

SCHEMA = "doc_id long, text string, lang string, component_id string, score double"


def brute(rows, words, percent):
    sets = {}
    for i, text in rows:
        w = [m.lower() for m in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())]
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def corpus(seed=3):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = " ".join(draw.choices(vocabulary, k=70))
    base = draw.choices(vocabulary, k=160)
    texts = ["", "one", "one two", "One Two", "one two three", " ".join(base)]
    for n in range(60):  # a large group of near copies, some linked only through others
        w = list(base)
        for _ in range(draw.randint(0, 9)):
            w[draw.randrange(len(w))] = draw.choice(vocabulary)
        texts.append(" ".join(w))
    for n in range(40):  # a common passage with little around it, not similar as such
        texts.append(passage + " " + " ".join(draw.choices(vocabulary, k=draw.randint(0, 30))))
    for n in range(40):
        texts.append(" ".join(draw.choices(vocabulary, k=draw.randint(1, 300))))
    texts += [texts[7]] * 5 + [texts[-1].upper()]
    draw.shuffle(texts)
    return list(enumerate(texts))


def run(spark, rows, words, percent):
    df = spark.createDataFrame([(i, t, "en", "x", 0.5) for i, t in rows], SCHEMA)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, words, percent).collect()}


def test_against_all_pairs(spark):
    rows = corpus()
    assert run(spark, rows, 3, 85) == brute(rows, 3, 85)


def test_defaults_against_all_pairs(spark):
    rows = corpus(11)
    assert run(spark, rows, 5, 80) == brute(rows, 5, 80)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(empty).count() == 0
    rows = [(1, None, "", "", 0.0), (2, "", "", "", 0.0), (None, "a b c d e f", "", "", 0.0), (3, "a b c d e f", "", "", 0.0), (3, "a b c d e f", "", "", 0.0), (4, "q " * 200_000, "", "", 0.0)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    found = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in got)
    assert found == [(-1, 2, 3, False), (1, 0, 1, True), (2, 0, 2, True), (3, 2, 3, True), (3, 2, 3, True), (4, 1, 4, True)]


def test_repeated_id_ties_classes(spark):
    a, b = "a b c d e f g", "h i j k l m n"
    rows = [(5, a, "", "", 0.0), (5, b, "", "", 0.0), (2, b, "", "", 0.0), (9, a, "", "", 0.0)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component_id"] for r in got} == {2}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 60), (7, 7)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 50, 50: 50, 60: 50}


def test_sets_of_large_batches_take_bounded_memory():
    """Shingle sets of 8 MB of text, in a task's memory of 40 MB besides the text."""
    draw = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    texts = pa.array([" ".join(draw.choices(words, k=400)) for _ in range(3500)])
    tracemalloc.start()
    sizes = [len(s) for s in minhash._sets(texts, 5)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(sizes) == 3500 and min(sizes) > 300
    assert peak < 40e6, peak
