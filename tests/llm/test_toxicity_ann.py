import random
import zlib

import numpy as np

from parcelwise.llm import ann, queries, toxicity


def documents(n, seed):
    draw = random.Random(seed)
    syllables = ["ra", "lo", "mi", "sen", "tor", "ba", "ku", "del", "fin", "gor"]
    bad = ["idiot", "moron", "worthless", "disgusting"]
    out = []
    for i in range(n):
        w = ["".join(draw.choices(syllables, k=draw.randint(1, 3))) for _ in range(draw.randint(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w[draw.randrange(len(w))] = draw.choice(bad)
        out.append((i, " ".join(w), int(toxic)))
    return out


def plain_grams(text):
    """Words of a text by plain Python, each as its n-grams with boundaries."""
    out, word = [], ""
    for c in text.lower() + " ":
        if not c.isspace() and c not in toxicity._STRIP:
            word += c
        elif word:
            b, word = f"<{word}>", ""
            grams = [b[i : i + n] for n in toxicity.GRAMS for i in range(len(b) - n + 1)]
            out.append(grams + [b] * (len(b) > max(toxicity.GRAMS)))
    return out


def test_bags_against_plain_python():
    """Equal n-grams, and no others, share a bucket; counts by word and text are those of plain Python."""
    texts = ["Idiot! an IDIOT, (moron)", None, "", "a  bc\ndefghij  kl", "Größe\u3000naïve-été", "x" * 50, "&&& ***"]
    of, total = {}, 0
    parts = list(toxicity.bags(texts))
    assert len(parts) == 1
    got = parts[0]
    want = [(r, g) for r, t in enumerate(texts) for g in plain_grams(t or "")]
    assert got.row.tolist() == [r for r, _ in want] and got.grams.tolist() == [len(g) for _, g in want]
    order = np.argsort(got.word, kind="stable")
    by_word = np.split(got.bucket[order], np.cumsum(got.grams)[:-1])
    for (_, grams), buckets in zip(want, by_word, strict=True):
        assert len(set(grams)) == len(set(buckets.tolist()))
        total += len(grams)
        for g in [g for _, g in want for g in g]:
            of.setdefault(g, None)
    assert len(np.unique(got.bucket)) == len(of) and len(got.bucket) == total


def test_learns_and_generalises(spark):
    rows = documents(600, 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 4], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if i % 4 == 0]
    assert np.mean([p == y for p, y in held]) > 0.95
    odd = spark.createDataFrame([(1, "lo mi sen idi0t ra worthles ku bad1del lo mi"), (2, "lo mi sen ra tor ku del lo mi ba"), (3, None), (4, "")], "doc_id long, text string")
    r = {x["doc_id"]: x["score"] for x in toxicity.scored(odd, model).collect()}
    assert r[1] > r[2] and 0 <= r[3] <= 1 and r[3] == r[4]
    kept = toxicity.filtered(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(x["score"] < 0.5 for x in got.values())


def test_score_against_plain_python(spark):
    """A text's score is the softmax of the mean, over its words, of the mean number of their n-grams."""
    rows = documents(300, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    number, value = dict(zip(model.bucket.tolist(), model.value.tolist(), strict=True)), {}
    for w in {w for _, t, _ in rows for w in t.split()}:
        (b,) = toxicity.bags([w])
        value[tuple(plain_grams(w)[0])] = np.mean([number.get(x, 0.0) for x in b.bucket.tolist()])
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    for i, t, _ in rows:
        z = model.bias + np.mean([value[tuple(g)] for g in plain_grams(t)])
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-6


def test_held_out_accuracy_of_given_tables(spark):
    """At sf0.01 the rows that no label was learned from: few are wrong, and toxic ones of all kinds are found."""
    found = queries.op3_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    right = [r["predicted"] == r["toxic"] for r in found]
    assert len(right) > 50 and np.mean(right) > 0.9


def test_labels_of_held_out_rows_are_never_read(spark, tmp_path):
    rows = documents(300, 5)
    spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name, flip in (("a", 0), ("b", 1)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "documents.parquet").symlink_to(tmp_path / "documents.parquet")
        spark.createDataFrame([(i, y ^ (flip if zlib.crc32(str(i).encode()) % 5 == 0 else 0)) for i, _, y in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
    a, b = ({r["doc_id"]: r["score"] for r in queries.op3_toxicity(spark, str(tmp_path / n)).collect()} for n in "ab")
    assert a == b


def test_middle_of_long_runs_counts():
    """A run without spaces is scored whole, also where slices meet."""
    run = "abcd" * 150_000
    (b,) = toxicity.bags(["qxyzwq"])
    table = np.zeros(toxicity.BUCKETS, np.float32)
    inner = set(b.bucket.tolist())
    table[list(inner)] = 1e6
    plain = toxicity.text_scores([run], table, 0.0)[0]
    for at in (100, toxicity.SLICE - 3, toxicity.SLICE, 300_001):
        assert toxicity.text_scores([run[:at] + "qxyzwq" + run[at:]], table, 0.0)[0] > plain


def test_nothing_to_learn(spark):
    """Without both classes, or without words, nothing is learned: scores are under 0.5, and no row goes."""
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    some = spark.createDataFrame([(None, "x"), (1, None), (1, None), (2, "")], "doc_id long, text string")
    for d, known in ((docs, labels), (some, labels), (some, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))):
        model = toxicity.fit(d, known)
        assert not model.learned
        assert [r["score"] < 0.5 for r in toxicity.scored(some, model).collect()] == [True] * 4
        assert toxicity.filtered(some, model).count() == 4 and toxicity.scored(docs, model).count() == 0


def test_odd_rows_are_judged(spark):
    """Null ids, repeated rows, very long words and texts, and columns of the operator's own names."""
    rows = documents(300, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    bad = "you idiot moron worthless disgusting"
    odd = spark.createDataFrame([(None, bad, 1, "a"), (1, bad, 1, "b"), (1, bad, 1, "b"), (2, "lo " * 400_000, 1, "c"), (3, "z" * 1_000_000, 1, "d")], "doc_id long, text string, score int, body string")
    assert sorted((r["doc_id"] is None, r["predicted"]) for r in toxicity.scored(odd, model).collect()) == [(False, 0), (False, 0), (False, 1), (False, 1), (True, 1)]
    assert sorted(r["body"] for r in toxicity.filtered(odd, model).collect()) == ["c", "d"]


def exact(ids, x, queries, k):
    n = x / np.sqrt((x * x).sum(1, keepdims=True))
    out = {}
    for q in queries:
        s = n @ n[ids.index(q)]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))
        out[q] = [ids[i] for i in order[:k]]
    return out


def test_recall_against_brute_force(spark):
    x = np.random.default_rng(3).normal(size=(3000, 24)).astype(np.float32)
    ids = list(range(3000))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, rank int")
    q = df.where("vec_id % 50 = 0")
    got = {}
    for r in ann.search(df, q, sample_rows=1500).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    want = exact(ids, x.astype(float), range(0, 3000, 50), 5)
    hit = sum(len(set(want[i]) & set(got[i].values())) for i in want)
    assert hit / (5 * len(want)) > 0.95 and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())


def test_ties_and_bad_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(40)] + [(100, [3.0, 2.0, 1.0]), (101, None), (102, []), (103, [0.0, 0.0, 0.0]), (104, [float("nan"), 1.0, 1.0]), (105, [None, 1.0, 1.0]), (106, [float("inf"), 1.0, 0.0]), (107, [1.0]), (None, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, df.where("vec_id in (0, 3, 100, 103)")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [1, 2, 3, 4, 5], 3: [0, 1, 2, 4, 5], 100: [0, 1, 2, 3, 4]}
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id in (0, 100)")
    assert sorted((r["query_id"], r["vec_id"]) for r in ann.search(few, few).collect()) == [(0, 100), (100, 0)]


def test_huge_and_tiny_vectors_take_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e200, 2e200]), (2, [1e-200, 2e-200]), (3, [2e300, 1e300]), (4, [0.0, 0.0]), (5, [1e-320, 2e-320]), (5, [1e-320, 2e-320])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in ann.search(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert [i for i, _ in got][:2] == [1, 2] and {i for i, _ in got} == {1, 2, 3, 5}
    assert all(abs(s - 1) < 1e-3 for i, s in got if i != 3) and abs(dict(got)[3] - 0.8) < 1e-9
