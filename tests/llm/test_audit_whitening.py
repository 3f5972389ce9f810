"""Filter audit and whitening against plain Python."""

import math
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from parcelwise.llm import audit, queries, whitening
from parcelwise.llm.textkernel import Chunk, utf8

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    rows = []
    for i, text, lang in docs:
        text, words = text or "", WORD.findall(text or "")
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and text in least and least[text] < i}
        rows.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shapley = [], Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for s, f in enumerate(order):
                before = set(order[:s])
                here = [r for r in mine if f in r[1] and not before & r[1]]
                kept = sum(not (before | {f}) & r[1] for r in mine)
                shapley[part, f] += len(here)
                out.append((part, order, s + 1, kept, len(here), sum(f in r[1] and bool(before & r[1]) for r in mine), sum(r[1] == {f} for r in mine), sum(r[2] for r in here), sum(r[3] for r in here)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_plain_python(spark, tmp_path):
    base = " ".join(f"word{i}" for i in range(220))
    texts = [None, "", base, base, base + " #", "Same same " * 150, "LOUD " + base.upper(), "é" * 300 + " " + base, "one two", "one two", base + "\x0b\x0ctail\x00x", "a" * 200_000, ("long" * 40 + " ") * 3 + base, " " + base]
    docs = [(i, t, ["de", None, "", "en"][i % 4]) for i, t in enumerate(texts)] + [(None, base, "de"), (2, base, "en"), (50, base, None), (51, "", "en")]
    labels = [(i, i % 2, i % 3) for i in range(12)] + [(3, 0, 1), (3, None, None), (None, 1, 1), (999, 1, 1)]
    spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, lang string, mask string, part int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(*row, "x") for row in labels], "doc_id long, quality int, toxic int, part string").write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted(tuple(r) for r in queries.op12_filter_audit(spark, str(tmp_path)).select(*COLUMNS).collect())
    assert got == plain_audit(docs, labels)


def test_audit_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.oracle_sql()['op12_filter_audit']})").fetchall())
    assert sorted(tuple(r) for r in queries.op12_filter_audit(spark, folder).select(*COLUMNS).collect()) == want


def test_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audited(audit.counted(audit.masked(docs), labels)).count() == 0


def test_distinct_words_where_hashes_collide():
    texts = ["a b a c", "", "b b", "long" * 30 + " " + "long" * 30 + " " + "long" * 29 + "lonk", "é e é"]
    c = Chunk(*utf8(pa.array(texts)), lower=False)
    want = [len(set(WORD.findall(t))) for t in texts]
    assert audit.distinct_words(c).tolist() == want
    c.hash = np.zeros_like(c.hash)  # every word of a text collides
    assert audit.distinct_words(c).tolist() == want


def vectors_of(spark, rows, more=""):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<float>{more}")


def brute(rows):
    """(n, sums, eigenvalues, vectors, trace) of the distinct usable vectors, by numpy."""
    xs = [tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for _, v in rows]
    once = np.array(sorted(set(xs)), dtype=object)
    n, sums = len(once), once.sum(axis=0)
    c = (once - np.array([int(s) for s in sums], object) / n).astype(float)
    cov = c.T @ c / n
    e, v = np.linalg.eigh(cov)
    return xs, n, sums, e[::-1], v[:, ::-1], np.trace(cov)


def test_whitening_equals_numpy(spark, tmp_path):
    rng = np.random.default_rng(3)
    clean = [(i, (rng.normal(size=20) * np.linspace(3, 0.3, 20)).astype(np.float32).tolist()) for i in range(300)]
    clean += [(1000 + i, clean[0][1]) for i in range(150)] + [(7, clean[7][1]), (None, clean[8][1])]
    odd = [(2000, None), (2001, [None] * 20), (2002, [float("nan")] + [0.0] * 19), (2003, [float("inf")] + [0.0] * 19)]
    vectors_of(spark, [(*r, 1, "c") for r in clean + odd], ", n int, x string").repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = queries.op13_embedding_whitening(spark, str(tmp_path)).collect()
    xs, n, sums, e, vecs, trace = brute(clean)
    assert len(out) == len(clean) * 16
    got = {}
    for r in out:
        got.setdefault((r.vec_id, r.component), []).append(r)
    sign = {}
    for (key, _), x in zip(clean, xs, strict=True):
        exact = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
        for k in range(16):
            for r in got[key, k + 1]:
                assert (r.n, r.deviation) == (n, exact)
                want = sum((a - int(s) / n) * p for a, s, p in zip(x, sums, vecs[:, k], strict=True)) / math.sqrt(e[k])
                flip = sign.setdefault(k, 1 if r.whitened * want >= 0 else -1)
                assert r.whitened * flip == pytest.approx(want, abs=1e-6)
                assert r.explained == pytest.approx(e[k] / trace, rel=1e-9)
                assert r.identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    assert whitening.whitened(vectors_of(spark, [])).count() == 0
    assert whitening.whitened(vectors_of(spark, [(1, None), (2, [])])).count() == 0
    same = whitening.whitened(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same) == [(i, k, 1, 0, 0.0, 0.0, 0.0) for i in (1, 2) for k in (1, 2)]
    line = whitening.whitened(vectors_of(spark, [(i, [float(i), 0.0]) for i in range(4)])).collect()
    assert {r.component for r in line} == {1, 2} and all(r.whitened == 0.0 for r in line if r.component == 2)
    two = whitening.whitened(vectors_of(spark, [(i, [float(i % 3), 1.0, float(i)][: 2 + i % 2]) for i in range(12)]))
    assert {(r.vec_id % 2, r.n) for r in two.collect()} == {(0, 3), (1, 6)}
    far = whitening.whitened(vectors_of(spark, [(1, [3e38, 1.0]), (2, [-3e38, 0.0]), (3, [0.0, 2.0])])).collect()
    assert all(r.deviation is None and math.isfinite(r.whitened) for r in far if r.vec_id != 3)
