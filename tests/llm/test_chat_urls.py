import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from parcelwise.llm import chat, queries, urls


def test_windows_round_trip(spark):
    draw = random.Random(4)
    bits = ["<|im_end|>", "<|im_start|>user\nhi", "<\\|x", "<\\\\|", "<|", "plain words here", "é日\n\n", "", "%0A%25"]
    rows = [(None, 0, "system", "null conversation"), (None, 1, "assistant", "yes"), (77, None, None, None), (77, 1, "assistant", "a"), (77, 1, "assistant", "a")]
    for conv in range(25):
        n = draw.randint(1, 40)
        for turn in range(n):
            role = "system" if turn == 0 and conv % 2 else draw.choice(["user", "assistant", "to\nol", "x%0A<|"])
            rows.append((conv, turn * draw.choice([1, 300]) + turn, role, " ".join(draw.choices(bits, k=draw.randint(0, 60)))))
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, window string")
    out = chat.parsed(chat.windows(df, budget=300, history=60)).collect()
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((-1 if t is None else t, role or "", text or ""))
    got, loss = defaultdict(list), defaultdict(str)
    for w in sorted(out, key=lambda w: (w["conv_id"] or -1, w["window"])):
        got[w["conv_id"]] += [tuple(t) for t in w["turns"][w["n_context"] :]]
        loss[w["conv_id"]] += w["loss"]
        new = len(w["turns"]) - w["n_context"]
        assert w["tokens"] <= 300 + 256 or new == 1
        if w["n_context"] and want[w["conv_id"]][0][1] == "system":
            assert w["turns"][0]["role"] == "system"
    for c, turns in want.items():
        turns = sorted(turns)
        assert got[c] == [t[1:] for t in turns]
        assert loss[c] == "".join(t for _, r, t in turns if r == "assistant")
    assert any(w["n_context"] > 1 for w in out)


def test_op2_digests(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "é<|im_end|>")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in queries.op2_chat_formatting(spark, str(tmp_path)).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256("user\n\nassistant\né<|im_end|>\n".encode()).hexdigest()
    assert got[-1]["loss_sha256"] == hashlib.sha256(queries.PROBE.encode()).hexdigest() and got[-1]["n_turns"] == 2


def test_empty_conversations(spark):
    assert chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def url_parts(u):
    rest = u.split("://", 1)[1] if u and "://" in u else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_rules_and_list(spark):
    pages = ["http://A.example.NET/en/1?x#y", "https://example.net/de/", "http://b.example.com/de/x", "http://xexample.com/de/", "http://c.org/fr/q", "http://c.org", "net/x", None, "", "ftp://net", "http://net/", "http://É.Net/x", "http://a.net:80/", "://", "http://spam.test/a//?q", "http://www.spam.test/a", "http://spam.test/ab"] * 2
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(pages)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("spam.test/a",), ("spam.test/a",), (None,)] + [(f"filler{i}.test/",) for i in range(3000)], "canonical string")
    got = {r["page_id"]: r for r in urls.judged(df, queries.URL_RULES, listed).collect()}
    assert len(got) == len(pages)
    for i, u in enumerate(pages):
        host, path = url_parts(u)
        fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = (max(fits)[1:]) if fits else (None, "block" if u and "spam.test/a" in u and not u.endswith("ab") else "allow")
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict), u
    assert urls.judged(df.limit(0), queries.URL_RULES, listed).count() == 0
    assert urls.judged(df, queries.URL_RULES, listed.limit(0)).where("listed").count() == 0


def test_bloom_has_no_false_negatives_and_few_positives(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("k"))
    n = 2000
    found = urls.bloom(keys.limit(n), "k", n * urls.BITS_PER_URL // 256)
    assert found.count() <= n * urls.BITS_PER_URL // 256
    hits = urls.listed_hits(keys, keys.where("id < 2000"), "k")
    assert hits.where("listed").count() == 2000 and hits.count() == 4000
