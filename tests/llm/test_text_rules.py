import random
import re
from collections import Counter

from parcelwise.llm import quality

SCHEMA = "doc_id long, text string, n_words string"


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    cover = {}
    for n in quality.MAX_GRAM_SHARE:
        seen, own = set(), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g in seen:
                own |= set(range(i, i + n))
            seen.add(g)
        cover[n] = sum(len(w[j]) for j in own)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), cover)


def test_against_plain_python(spark):
    draw = random.Random(5)
    alphabet = ["aé", "bö", "c", "#d", "e|", "Ünï", " x", "日本"]
    texts = [None, "", "   \n\n", "a", "a b", "a a a a a a", "x\nx\nx \n x", "\r\n\r\na\r\na"]
    for _ in range(60):
        texts.append("".join(draw.choice(alphabet) + draw.choice([" ", " ", "\n", "\t", "  "]) for _ in range(draw.randint(1, 400))))
    texts.append("word " * 300_000)
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in quality.judged(rows).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts[:-1]):
        r, e = got[i], brute(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == e[:5], repr(t)
        assert {n: r[f"dup_{n}gram_chars"] for n in e[5]} == e[5], repr(t)
        assert r["base_failed"] == (e[0] < 50 or 100 * e[4] > 50 * e[0])
        assert not (r["kept"] and r["base_failed"])
    assert got[len(texts) - 1]["n_repeat_words"] == 300_000


def test_empty_table_and_nulls(spark):
    assert quality.judged(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = quality.judged(spark.createDataFrame([(None, None, None), (None, "a b", None)], SCHEMA)).collect()
    assert [r["doc_id"] for r in rows] == [None, None] and not any(r["kept"] for r in rows)
