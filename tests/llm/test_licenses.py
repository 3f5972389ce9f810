"""License scans against plain Python over all places and stretches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parcelwise.llm import licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def nearest(template, text):
    """Least edits between the template and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, t in enumerate(template, 1):
        new = [i]
        for j, w in enumerate(text, 1):
            new.append(min(row[j - 1] + (t != w), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def expected(text):
    ws, labels, best = words(text), set(), 0.0
    places, base = [], set()
    for t in licenses.PHRASES:
        p = words(t.text)
        at = [i for i in range(len(ws)) if ws[i : i + len(p)] == p]
        places += at
        if at:
            base.add(t.label)
            best = 1.0
    for t in licenses.NOTICES:
        p = words(t.text)
        allowed = min(len(p) // 5, (len(p) - 3) // 3)
        if ws and (cost := nearest(p, ws)) <= allowed:
            labels.add(t.label)
            best = max(best, 1 - cost / len(p))
    return (len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), round(best, 9))


def texts():
    rng = random.Random(5)
    noise = [f"w{i}" for i in range(60)] + ["the", "license", "under", "cc", "by", "nc", "of"]
    out = [None, "", "   ", "cc by nc", "cc by nc cc by nc cc-by-nc", "Apache License, Version 2.0", "UNDER THE MIT LICENSE", "xunder the mit license", "cc by\x00nc", "Übercc by nc é", "all rights reserved all rights"]
    for t in licenses.PHRASES + licenses.NOTICES:
        p = t.text.split()
        for edits in range(5):
            q = list(p)
            for _ in range(edits):
                at = rng.randrange(len(q))
                kind = rng.randrange(3)
                q[at : at + 1] = [rng.choice(noise)] if kind == 0 else [] if kind == 1 and len(q) > 1 else [q[at], rng.choice(noise)]
            out.append(" ".join(rng.choices(noise, k=rng.randrange(30)) + q + rng.choices(noise, k=rng.randrange(30))))
    long = rng.choices(noise, k=30_000)
    long[20_000:20_000] = licenses.NOTICES[4].text.split()
    return [*out, " ".join(long), "cc by nc " * 5_000]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("licenses"))
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    rows += [(3, "cc by nc", "again"), (3, "cc by nc", "again"), (None, "under the mit license", "x"), (3, "other text of id 3", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, hits string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def test_query_equals_plain_python(spark, tables):
    folder, rows = tables
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in queries.op11_license_scans(spark, folder).collect()]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    want = [(i, *expected(t)) for i, t, _ in rows]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_spans_and_own_templates(spark):
    own = [licenses.Template("x", "one two three four five six seven eight nine ten")]
    docs = spark.createDataFrame([("a", "zero one two three FOUR 5 six seven eight nine ten eleven")], "name string, body string")
    row = licenses.scanned(docs, own, id_col="name", text_col="body").first()
    assert row.n_words == 12
    assert [(f.template, f.first_word, f.n_words, round(f.score, 6)) for f in row.found] == [(0, 1, 10, 0.9)]
    with pytest.raises(ValueError):
        licenses.scanned(docs, [licenses.Template("x", "one two")], id_col="name", text_col="body")


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, found string")
    assert licenses.scanned(docs).count() == 0


def test_sf_tables_find_all_notices(spark):
    found = queries.op11_license_scans(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wrong = [(r.doc_id, r) for r in docs.join(found, "doc_id").collect() if expected(r.text)[:6] != (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)]
    assert not wrong
    assert found.where(F.col("labels") != "").count() > 0
