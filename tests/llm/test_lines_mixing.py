import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from parcelwise.llm import components, lines, mixing, queries

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


def norm(line):
    return [w for w in re.split(r"[^\w]|_", line.lower()) if w]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_equal_and_fuzzy_lines(spark):
    draw = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "so", "tu") for c in ("", "x", "yz", "stone")]
    base = [" ".join(draw.choices(vocabulary, k=40)) + " extraordinary" + str(i) for i in range(6)]
    rows = []
    for i in range(30):
        own = " ".join(draw.choices(vocabulary, k=30)) + f" unmistakable{i}"
        line = base[i % 6]
        if i >= 12:
            w = line.split()
            w[i % 40] = w[i % 40] + "q"
            line = " ".join(w)
        rows.append((i, f"{own}\n{line.upper() if i % 2 else line}!\nshort one\n\n", "s", "en", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in lines.deduped(df).collect()}
    for i in range(30):
        assert got[i]["__n_lines"] == 5
        kept = got[i]["text"].split("\n")
        assert rows[i][1].split("\n")[0] in kept and "short one" in kept, "clean and short lines stay"
        if i < 6:
            assert got[i]["__dropped"] == []
        elif i < 12:
            assert got[i]["__dropped"] == [1]
    fuzzy = [i for i in range(12, 30) if got[i]["__dropped"] == [1]]
    assert len(fuzzy) >= 12, "most lines with one edited word are found"
    for i in fuzzy:
        a, b = (" ".join(norm(rows[j][1].split("\n")[1])) for j in (i, i % 6))
        assert distance(a, b) <= (1 - lines.SIMILARITY) * max(len(a), len(b)) * 2


def test_recall_against_all_pairs(spark):
    """Lines of 4 to 40 words with a typo, an edited longest word, another word or several typos."""
    draw = random.Random(3)
    syllables = ["ra", "lo", "mi", "sen", "tor", "ba", "ku", "del", "fin", "gor", "ment", "tion", "er", "an"]
    texts = []
    for n in (4, 6, 8, 12, 20, 40):
        for how in ("typo", "anchor", "word", "typos"):
            for _ in range(4):
                w = ["".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(n)]
                texts.append(" ".join(w))
                picked = [max(range(n), key=lambda k: len(w[k]))] if how == "anchor" else draw.sample(range(n), max(1, n // 8) if how == "typos" else 1)
                for k in picked:
                    at = draw.randrange(len(w[k]))
                    w[k] = "z" * min(len(w[k]), 3) if how == "word" else w[k][:at] + "z" + w[k][at + 1 :]
                texts.append(" ".join(w))
    want = {j for j in range(len(texts)) for i in range(j) if abs(len(texts[i]) - len(texts[j])) <= 0.15 * max(len(texts[i]), len(texts[j])) and distance(texts[i], texts[j]) <= int(max(len(texts[i]), len(texts[j])) * (1 - lines.SIMILARITY))}
    got = {r["id"] for r in lines.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got <= want, "only lines similar to an earlier one go"
    assert len(want) > 80 and len(got) >= 0.98 * len(want), (len(got), len(want))


def test_line_edges(spark):
    assert lines.deduped(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "ab cd " * 40_000
    rows = [(1, None, None, None, None), (2, "", "s", "l", 0), (None, "a b c d e\na b c d e", "s", "l", 3), (3, "a b c d e", "s", "l", 3), (4, long, "s", "l", 3), (5, long + "\nx", "s", "l", 3), (3, "a b c d e", "s", "l", 3)]
    got = defaultdict(list)
    for r in lines.deduped(spark.createDataFrame(rows, SCHEMA)).collect():
        got[r["doc_id"]].append((r["text"], r["__dropped"]))
    assert got[1] == [(None, [])] and got[2] == [("", [])]
    assert got[None] == [("a b c d e", [1])], "a null id comes first"
    assert got[3] == [("", [0])] * 2, "rows equal in id and text are one document"
    assert got[4] == [(long, [])] and got[5] == [("x", [0])]


def test_recall_by_length_and_edit(spark):
    """Lines of 5 to 250 words: one and two typos, other words, typos in a tenth and a fifth of the words, a word more or less."""
    draw = random.Random(11)
    syllables = ["ra", "lo", "mi", "sen", "tor", "ba", "ku", "del", "fin", "gor", "ment", "tion", "er", "an"]
    word = lambda: "".join(draw.choices(syllables, k=draw.randint(1, 4)))

    def typo(w):
        at, kind = draw.randrange(len(w)), draw.randrange(3)
        return w[:at] + ("z" if kind < 2 else "") + w[at + (kind != 1) :] or "z"

    pairs = []
    for n in (5, 7, 10, 12, 16, 24, 40, 100, 250):
        for how in ("typo", "typos", "word", "words", "tenth", "fifth", "more", "less"):
            for _ in range(8):
                w = [word() for _ in range(n)]
                v = list(w)
                k = {"typo": 1, "typos": 2, "word": 1, "words": 2, "tenth": max(1, n // 10), "fifth": max(1, n // 5)}.get(how, 0)
                for i in draw.sample(range(n), k):
                    v[i] = word() if how.startswith("word") else typo(v[i])
                if how == "more":
                    v.insert(draw.randrange(n + 1), word())
                elif how == "less":
                    v.pop(draw.randrange(n))
                pairs.append((n, how, " ".join(w), " ".join(v)))
    near = lambda x, y: x != y and abs(len(x) - len(y)) <= 0.15 * max(len(x), len(y))
    rows = spark.createDataFrame([(i, x, y) for i, (_, _, x, y) in enumerate(pairs) if near(x, y)], "i long, x string, y string")
    want = {r["i"] for r in rows.where(F.levenshtein("x", "y") <= F.floor(F.greatest(F.length("x"), F.length("y")) * (1 - lines.SIMILARITY) + 1e-9)).collect()}
    docs = spark.createDataFrame([(2 * i + k, t) for i, (_, _, *both) in enumerate(pairs) for k, t in enumerate(both)], "doc_id long, text string")
    got = {r["id"] // 2 for r in lines.groups(docs).collect() if r["id"] % 2}
    assert len(want) > 400 and len(got & want) >= 0.95 * len(want), (len(got & want), len(want))
    for n, how in {p[:2] for p in pairs}:
        mine = {i for i, p in enumerate(pairs) if p[:2] == (n, how)} & want
        assert len(got & mine) >= 0.6 * len(mine), (n, how)


def test_blocks_against_plain_python(spark):
    """A bit of a block is set if half of its run's words have it; runs begin at the long words of least hash."""
    draw = random.Random(2)
    line = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 9))) for _ in range(30)]
    hashed = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(line)], "i int, w string").orderBy("i").select(F.xxhash64("w")).collect()]
    place = sorted(range(30), key=lambda i: (len(line[i]) < lines.CONTENT, (hashed[i] & (1 << 63) - 1) >> 20))[: lines.ANCHORS]
    want = []
    for i in place:
        run = hashed[min(i, 26) : min(i, 26) + 4]
        x = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in run) >= 2)
        want.append((4, x - (1 << 64 if x >> 63 else 0)))
    keys = {r[0] for r in spark.createDataFrame(want, "kind int, bits long").select(F.xxhash64("kind", "bits")).collect()}
    got = spark.createDataFrame([(line,)], "w array<string>").select(F.explode(lines.blocks(F.col("w")))).collect()
    assert {r[0] for r in got} == keys and len(keys) > 3


def test_given_lines_against_all_pairs(spark):
    """sf0.001 against brute force: exact copies all, and at least 0.9 of the fuzzy ones; nothing else goes."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    place, first = {}, {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        for k, line in enumerate((r["text"] or "").split("\n")):
            w = norm(line)
            body = " ".join(w)
            if len(w) >= lines.MIN_WORDS or len(body) >= lines.MIN_CHARS:
                place[r["doc_id"], k] = body
                first.setdefault(body, (r["doc_id"], k))
    bodies = sorted(first, key=len)
    count = {b: Counter(b[i : i + 4] for i in range(len(b) - 3)) for b in bodies}
    root = {b: b for b in bodies}

    def top(b):
        while root[b] != b:
            b = root[b]
        return b

    for i, b in enumerate(bodies):
        for a in reversed(bodies[:i]):
            allowed = int(len(b) * (1 - lines.SIMILARITY) + 1e-9)
            if len(b) - len(a) > allowed:
                break
            # An edit changes four runs of four characters at most.
            if sum((count[a] & count[b]).values()) >= len(b) - 3 - 4 * allowed and distance(a, b) <= allowed:
                root[top(a)] = top(b)
    head = {}
    for b in bodies:
        head[top(b)] = min(head.get(top(b), first[b]), first[b])
    want = {p for p, b in place.items() if head[top(b)] != p}
    fuzzy = {p for p in want if first[place[p]] == p}
    got = {(r["doc_id"], k) for r in queries.op1_line_dedup(spark, "/root/testdata/sf0.001").collect() for k in r["dropped_lines"]}
    assert want - fuzzy <= got and len(fuzzy) > 20 and len(fuzzy & got) >= 0.9 * len(fuzzy), (len(want), len(fuzzy), len(fuzzy & got))
    assert len(got - want) <= len(want - got), "a lost link may leave another first occurrence, and no more"


def test_surplus_is_a_lower_bound(spark):
    """Characters of one line that another lacks, against plain counting; never more than the edit distance."""
    draw = random.Random(5)
    letters = lines.COUNTED + "jkqxz7é字"
    line = lambda: "".join(draw.choices(letters, weights=[draw.random() for _ in letters], k=draw.randint(1, 120)))
    pairs = [(line(), line()) for _ in range(200)] + [("a" * 300 + "b", "b" * 130), ("", "e"), ("k" * 200, "j" * 90)]
    for x in [line() for _ in range(100)]:
        at = draw.randrange(len(x))
        pairs.append((x, x[:at] + draw.choice(letters) + x[at + draw.randrange(2) :]))
    rows = spark.createDataFrame(pairs, "x string, y string").select("x", "y", *(lines.packed(F.array(*lines.counted(c))).alias("c" + c) for c in "xy"))
    counts = lambda s: {**{c: min(127, s.count(c)) for c in lines.COUNTED}, "": min(127, sum(c not in lines.COUNTED for c in s))}
    got = rows.select("x", "y", lines.surplus(F.col("cx"), F.col("cy")).alias("over"), F.levenshtein("x", "y").alias("distance")).collect()
    for r in got:
        x, y = counts(r["x"]), counts(r["y"])
        assert r["over"] == sum(max(0, x[c] - y[c]) for c in x) <= r["distance"], (r["x"], r["y"])


def test_one_way_is_an_upper_bound(spark):
    """The way from word to word is never shorter than the distance, and settles lines with words put in, taken out and misspelt."""
    draw = random.Random(6)
    word = lambda: "".join(draw.choices("abcdehiorst", k=draw.randint(1, 7)))
    pairs = [("a b", "b a"), ("a", "b"), ("a a a b a a", "a a b a a a"), (" ".join(["ab"] * 60), " ".join(["ab"] * 50 + ["cd"] * 10)), ("", "a")]
    for k in range(120):
        w = [word() for _ in range(draw.randint(1, 60))]
        v = [word() for _ in w] if k % 3 == 0 else list(w)
        for _ in range(len(w) // 15):
            v.insert(draw.randrange(len(v) + 1), word())
            v.pop(draw.randrange(len(v)))
            v[draw.randrange(len(v))] += "z"
        pairs.append((" ".join(w), " ".join(v)))
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, x string, y string")
    way = lambda allowed: lines.walked(F.split("x", " "), F.split("y", " "), F.lit(allowed))
    got = rows.select("i", "x", "y", way(10_000).alias("way"), way(20).alias("short"), F.levenshtein("x", "y").alias("distance")).collect()
    for r in got:
        assert r["distance"] <= r["way"] and (r["short"] == r["way"] if r["way"] <= 20 else r["short"] > 20), r
    near = [r for r in got if r["i"] >= 5 and (r["i"] - 5) % 3 and r["distance"] <= 0.15 * max(len(r["x"]), len(r["y"]))]
    assert len(near) > 50 and sum(r["way"] <= 0.15 * max(len(r["x"]), len(r["y"])) for r in near) >= 0.8 * len(near)
    want = {(r["i"], r["i"] + 1000) for r in got if r["distance"] <= int(max(len(r["x"]), len(r["y"])) * 0.15 + 1e-9)}
    assert {(r["a"], r["b"]) for r in lines.similar(rows.select(F.col("i").alias("a"), (F.col("i") + 1000).alias("b"), "x", "y"), 0.85).collect()} == want


def test_lines_of_other_letters_are_no_candidates(spark, monkeypatch):
    """Lines that share a passage, each with letters of its own besides, aren't compared; similar ones among them are found."""
    shared, kinds = "wonderful passages everybody repeats", ["abc", "def", "ghi", "lmn", "opr", "stu", "wab", "cgl"]
    draw = random.Random(9)
    rows = [f"{' '.join(''.join(draw.choices(k, k=6)) for _ in range(12))} {shared}" for k in kinds for _ in range(4)]
    rows += [r[1:] for r in rows[::4]]
    compared = []
    monkeypatch.setattr(lines, "similar", lambda pairs, similarity, f=lines.similar: compared.extend(pairs.select("x", "y").collect()) or f(pairs, similarity))
    got = {r["id"] for r in lines.groups(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == set(range(32, 40))
    for r in compared:
        x, y = Counter(r["x"]), Counter(r["y"])
        assert (x - y).total() <= 0.15 * max(len(r["x"]), len(r["y"])), "letters apart already tell these apart"


def test_copies_alone_make_no_lists(spark, monkeypatch):
    """Blocks that only copies of one line have aren't kept for the search of similar lines."""
    seen = []
    monkeypatch.setattr(lines, "linked", lambda lists, *rest, f=lines.linked: seen.append(lists.count()) or f(lists, *rest))
    one, two = ("every one of these words stands in a line of its own kind today", "altogether different things are said here in quite another manner by them")
    docs = spark.createDataFrame([(i, one if i % 2 else two) for i in range(6)], "doc_id long, text string")
    assert {r["id"] for r in lines.groups(docs).collect()} == {2, 3, 4, 5} and seen == [0]


def one_block_pairs(spark):
    """Lines that all have one passage, and two pairs of similar ones among them, each pair with one block in common: the passage's."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdefghilmnoprstu", k=draw.randint(3, 9)))
    # The passage begins with a word of very small hash, so that it is an anchor of every line.
    least = spark.range(2000).select(F.concat(F.lit("passage"), "id").alias("w")).orderBy(F.xxhash64("w").bitwiseAND(F.lit((1 << 63) - 1))).first()["w"]
    shared = f"{least} so it is"
    first = [[word() for _ in range(30)] for _ in range(80)]
    rows = []
    for w in first:
        v = list(w)
        for k in draw.sample(range(30), 12):
            v[k] = "z" + v[k][1:]
        at = draw.randrange(31)
        rows.append([" ".join([*x[:at], shared, *x[at:]]) for x in (w, v)])
    keys = lambda x: lines.blocks(F.split(x, " "))
    passed = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x string, y string").select("i", keys("x").alias("x"), keys("y").alias("y")).collect()
    held = Counter(k for r in passed for k in {*r["x"], *r["y"]})
    common = held.most_common(1)[0][0]
    lone = [r["i"] for r in passed if {*r["x"]} & {*r["y"]} == {common}][:2]
    assert len(lone) == 2 and held[common] > 40
    fill = [rows[r["i"]][0] for r in passed if common in r["x"] and r["i"] not in lone]
    return [*fill, *(rows[i][0] for i in lone)], [rows[i][1] for i in lone]


def test_one_block_that_many_lines_have_is_enough(spark):
    """Similar lines whose only common block is one of a long list are found."""
    given, copies = one_block_pairs(spark)
    assert len(given) > 2 * components.SHORT
    got = {r["id"] for r in lines.groups(spark.createDataFrame(list(enumerate([*given, *copies])), "doc_id long, text string")).collect()}
    assert got == {len(given), len(given) + 1}


def test_columns_of_the_operators_own_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e\na b c d e", 5, "x", 7), (2, "one\none", 5, "x", 7)], "doc_id long, text string, ln int, body string, h long")
    got = {r["doc_id"]: r for r in lines.deduped(docs).collect()}
    assert got[1]["text"] == "a b c d e" and got[2]["text"] == "one\none" and got[1]["body"] == "x"


def test_lines_without_spaces(spark):
    """A long line of one word is dropped if equal to an earlier one; a short one stays."""
    run = "字" * 40
    docs = spark.createDataFrame([(1, run + "\n" + run + "\n" + "字字\n字字")], "doc_id long, text string")
    assert lines.deduped(docs).first()["text"] == run + "\n字字\n字字"


def rake(cells, power, rounds):
    total = sum(cells.values())
    w = {k: v / total for k, v in cells.items()}
    targets = []
    for d, p in enumerate(power):
        m = defaultdict(float)
        for k, v in w.items():
            m[k[d]] += v
        s = sum(v**p for v in m.values())
        targets.append({k: v**p / s for k, v in m.items()})
    for _ in range(rounds):
        for d, t in enumerate(targets):
            m = defaultdict(float)
            for k, v in w.items():
                m[k[d]] += v
            w = {k: v * t[k[d]] / m[k[d]] for k, v in w.items()}
    return w, targets


def test_raking(spark):
    draw = random.Random(1)
    cells = {(f"s{a}", f"l{b}", f"t{c}"): draw.randint(1, 1000) for a in range(5) for b in range(3) for c in range(2)}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    got = {(r["source"], r["lang"], r["topic"]): r for r in mixing.probabilities(df).collect()}
    want, targets = rake(cells, (0.7, 0.7, 1.0), mixing.ROUNDS)
    assert all(abs(got[k]["weight"] - v) < 1e-9 for k, v in want.items())
    for d, t in enumerate(targets):
        for c, share in t.items():
            assert abs(sum(r["weight"] for k, r in got.items() if k[d] == c) - share) < 1e-4
    kept = sum(cells[k] * r["prob"] for k, r in got.items())
    assert abs(kept / sum(cells.values()) - mixing.KEEP) < 1e-4 and max(r["prob"] for r in got.values()) <= 1.0


def test_mixing_edges(spark):
    assert mixing.decided(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, None, None, None), (1, "", None, "en", 0), (2, "a b", "s", None, 3), (2, "a b", "s", None, 3)]
    got = mixing.decided(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4 and all(r["__kept"] for r in got if r["__tokens"] == 0)
    assert len({r["__kept"] for r in got if r["doc_id"] == 2}) == 1


def test_stated_targets(spark):
    """Stated shares hold for the weights, what is left out shares the rest, and raking ends."""
    cells = {(s, g, t): 100 * (i + 1) * (3 * j + 1) * (k + 2) for i, s in enumerate("abc") for j, g in enumerate(("en", "de")) for k, t in enumerate("xy")}
    df = spark.createDataFrame([(*c, n) for c, n in cells.items()], "source string, lang string, topic string, tokens long")
    stated = {"lang": {"en": 0.8, "de": 0.2}, "source": {"a": 0.5, "absent": 0.1}}
    got = mixing.raked(df, targets=stated).collect()
    share = lambda d, v: sum(r["weight"] for r in got if r[d] == v)
    total = sum(cells.values())
    left = {s: sum(n for c, n in cells.items() if c[0] == s) / total for s in "bc"}
    want = {"a": 0.5, **{s: 0.5 * m / sum(left.values()) for s, m in left.items()}}
    assert all(abs(share("source", s) - w) < 1e-5 for s, w in want.items())
    assert abs(share("lang", "en") - 0.8) < 1e-5
    assert all(abs(share("topic", t) - sum(n for c, n in cells.items() if c[2] == t) / total) < 1e-5 for t in "xy")


def test_targets_of_nothing(spark):
    """A category whose target is 0 goes, and documents without tokens stay."""
    rows = [(i, "word " * 10, "a" if i % 2 else "b", "en", 50) for i in range(200)] + [(900, "", "b", "en", 0), (901, None, "b", "en", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.decided(docs, targets={"source": {"a": 1.0}}, topic=F.lit("t"))
    assert {r["__source"] for r in got.where("__kept and __tokens > 0").collect()} == {"a"}
    assert got.where("doc_id >= 900 and __kept").count() == 2
