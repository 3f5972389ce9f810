import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parcelwise.llm import packing, sharding

SCHEMA = "doc_id long, text string, length string"


def check_plan(histogram, runs, capacity):
    held = Counter()
    for pattern, n in runs:
        assert n > 0 and sum(pattern) <= capacity
        for a in pattern:
            held[a] += n
    assert held == {k: v for k, v in histogram.items() if v}


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), max_size=12))
def test_plan_holds_everything_and_beats_best_fit(histogram):
    runs = packing.plan(histogram, 60, nodes=400)
    check_plan(histogram, runs, 60)
    plain = packing.best_fit(histogram, 60)
    check_plan(histogram, plain, 60)
    assert sum(n for _, n in runs) <= sum(n for _, n in plain)


def test_plan_finds_what_best_fit_misses():
    histogram = {6: 2, 4: 2, 3: 4, 2: 4, 5: 2}
    runs = packing.plan(histogram, 10)
    assert sum(n for _, n in runs) == -(-sum(k * v for k, v in histogram.items()) // 10)


def test_dominance():
    assert packing.dominates((5, 5), (5, 3, 2)) and not packing.dominates((4, 4), (5, 1))


def test_ids_match_the_tokenizer(spark):
    draw = random.Random(2)
    odd = ["it's", "THE", "ÉTÉ", "ΟΔΟΣ", "ΟΔΟΣ x", "a\x1cb", "<|endoftext|>", "<|x", "ﬁ", "é", "İ", "12ab!!", "日本語", " ", "don't!!", "&&&###", "naïve", "²x", "_a_"]
    texts = [None, "", "  "] + [" ".join(draw.choices(odd, k=12)) for _ in range(40)] + ["word " * 9000]
    plain = Tokenizer.from_file(packing.default_tokenizer())
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    ids = defaultdict(dict)
    for r in packing.pack(df, capacity=4096, keep_ids=True).collect():
        ids[r["doc_id"]][r["piece"]] = r
    for i, t in enumerate(texts):
        want = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        got = [ids[i][k] for k in sorted(ids[i])]
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in got]).tolist() == want, repr(t)
        assert [r["length"] for r in got] == [4096] * (len(want) // 4096) + [len(want) % 4096] * bool(len(want) % 4096)
        assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in got)


def test_places_have_no_gaps(spark):
    rows = [(i % 50, " ".join(["a"] * (i % 37)), "") for i in range(400)] + [(None, None, None), (None, None, None)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), capacity=64).collect()
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(got) == len(rows)
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) == -(-sum(r["length"] for r in got) // 64)
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    placed = packing.pack(spark.createDataFrame(rows[:30], SCHEMA), capacity=64, keep_ids=True)
    assert sum(len(r["ids"]) for r in packing.sequences(placed).collect()) == 4 * sum(r["length"] for r in placed.collect())


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_against_scalar_and_growth():
    keys = np.random.default_rng(1).integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    for n in (1, 2, 8, 100):
        assert sharding.jump(keys, n).tolist() == [jump(int(k), n) for k in keys]
    a, b = sharding.jump(keys, 8), sharding.jump(keys, 9)
    assert ((a == b) | (b == 8)).all() and 0.06 < (b == 8).mean() < 0.16


def test_sharded(spark, tmp_path):
    rows = [(i % 300, f"text {i % 7} é", "") for i in range(900)] + [(None, None, None), (None, "x", None), (5, None, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sharding.sharded(df).collect()
    assert len(got) == len(rows)
    slots, place = defaultdict(list), {}
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert place.setdefault(r["doc_id"], r["shard"]) == r["shard"] or r["doc_id"] is None
        assert r["grown_shard"] in (r["shard"], 8) and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.sharded(spark.createDataFrame([], SCHEMA)).count() == 0
    sharding.write_shards(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows)
    with pytest.raises(Exception):
        sharding.write_shards(df, str(tmp_path / "out"))
