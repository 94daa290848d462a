"""Collocations, exact top-k and the prefix trie against brute force: nulls, empty and long texts, ties, repeated rows,
empty tables, columns with clashing names, hot groups cut over many partitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from attest.llm import collocation, topk, trie

DOCS = "key string, n long, text string, lang string, id int"


def cut(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split(r"[ \t]+", piece) if w] for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lowered)]


def brute_phrases(rows, least, top):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        for piece in cut(text):
            n[lang or "und"] += len(piece)
            for k in range(1, 6):
                for i in range(len(piece) - k + 1):
                    f[lang or "und"][tuple(piece[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if a >= least and len(p) >= 2}
        inside = {q for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if found.get(q := p[i : i + k]) == a}
        scored = []
        for p, a in found.items():
            if p not in inside:
                cuts = [(math.floor(Fraction(1000 * a * n[lang], counts[p[:k]] * counts[p[k:]])), k) for k in range(1, len(p))]
                s, k = min(cuts)
                scored.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def some_texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "The", "tab\there", "naïve", "ß", "日本", "a", "b", "x" * 40, "und"]
    draw = lambda: " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 30)))
    passage = "one passage of ten words that comes again and again"
    return [(rng.choice([None, "", draw(), draw() + rng.choice(".,\n!;") + draw(), passage, draw() + " " + passage]), rng.choice([None, "und", "en", "de"])) for _ in range(n)]


@pytest.mark.parametrize("how", [{}, {"bound": 0}, {"per_part": 50}, {"bound": 0, "per_part": 90}, {"top": 3}])
def test_collocations(spark, how):
    rows = some_texts(3, 300) + [("go go go go go go go go", "en")] * 9
    df = spark.createDataFrame([("k", 7, t, x, 1) for t, x in rows], DOCS).repartition(5)
    got = sorted(tuple(r) for r in collocation.collocations(df, least=8, **how).collect())
    assert got == brute_phrases(rows, 8, how.get("top", 2_000)) and got


def test_collocations_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert collocation.collocations(empty).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and collocation.collocations(empty).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3, DOCS)
    assert collocation.collocations(nulls, least=1).count() == 0
    long = [("w " * 200_000 + "z" * 300_000 + " end", "en")]
    got = {r["phrase"]: tuple(r)[3:] for r in collocation.collocations(spark.createDataFrame([("k", 7, t, x, 1) for t, x in long], DOCS), least=1).collect()}
    assert got["w w"][0] == 199_999 and got["w w w w w"][0] == 199_996 and got["w w"][3] == 200_002


def test_words_that_share_a_hash(spark, monkeypatch):
    """A seed under which all words look alike is told and left."""
    plain = collocation._words
    monkeypatch.setattr(collocation, "_words", lambda t, x, seed: (lambda d, s, e, h, p, at: (d, s, e, h if seed else h % 2, p, at))(*plain(t, x, seed)))
    rows = some_texts(4, 60)
    found = collocation.collocations(spark.createDataFrame([("k", 7, t, x, 1) for t, x in rows], DOCS), least=4)
    assert sorted(tuple(r) for r in found.collect()) == brute_phrases(rows, 4, 2_000)


def test_paths(spark):
    """A passage with its own words is one path, shared ends part paths, a ring begins at its smallest edge."""
    text = [" ".join(f"p{i}" for i in range(12))] * 6 + ["q1 q2 q3 q4 q5 q6 q7", "q1 q2 q3 q4 q5 z6 z7"] * 5 + ["ab cd " * 8] * 7
    g = collocation.graph(spark.createDataFrame([("k", 7, t, "en", 1) for t in text], DOCS), least=5)
    got = {(r["phrase"], r["words"], r["n"]) for r in collocation.paths(g).collect()}
    assert (" ".join(f"p{i}" for i in range(12)), 12, 6) in got
    assert ("q1 q2 q3 q4 q5", 5, 10) in got and ("q2 q3 q4 q5 q6 q7", 6, 5) in got and ("q2 q3 q4 q5 z6 z7", 6, 5) in got
    assert sum(n for p, _, n in got if p.startswith(("ab", "cd"))) >= 7


def test_a_ring_of_edges(spark):
    g = collocation.Graph(*[spark.createDataFrame(*x) for x in (
        ([(bytearray(b[i:] + b[:i])[:k], k, 9) for b in [b"\1\2\3\4\5\6"] for i in range(6) for k in (4, 5)], "key binary, words int, n long"),
        ([(bytearray([i]), "en", f"w{i}", 99) for i in range(1, 7)], "id binary, lang string, word string, total long"))], 1)
    assert [tuple(r) for r in collocation.paths(g).collect()] == [("en", "w1 w2 w3 w4 w5 w6 w1 w2 w3 w4", 10, 9)]


VECTORS = "row string, vec_id long, embedding array<double>, norm int"


def brute_top(rows, k=5):
    whole = [(i, vid, [math.floor(256 * x) for x in v]) for i, (vid, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, vid, v in whole:
        if vid is not None and vid % 50 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w)), math.inf if other is None else other) for j, other, w in whole if j != i and len(w) == len(v))
            out += [(vid, rank + 1, None if other == math.inf else other, -s) for rank, (s, other) in enumerate(near[:k])]
    return sorted(out, key=str)


def run_top(spark, rows, **how):
    df = spark.createDataFrame([("x", i, v, 3) for i, v in rows], VECTORS).repartition(3)
    every = trie.stored(topk.whole_numbers(df, "vec_id", "embedding"))
    return sorted(((r["vec_id"], r["rank"], r["found"], r["score"]) for r in topk.top_k(every.filter("vec_id % 50 = 0"), every, **how).collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"block": 40, "probes": 16}, {"block": 25, "probes": 0}])
def test_top_k(spark, how):
    rng = random.Random(2)
    vector = lambda scale: [rng.gauss(0, scale) for _ in range(6)]
    rows = [(i, vector(rng.choice([0.1, 1, 1, 5]))) for i in range(200)] + [(50 + i, [0.5] * 6) for i in range(60)]  # copies, and ids that repeat
    rows += [(300, None), (350, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (400, [float("nan")] * 6), (450, [float("inf")] * 6), (None, [9.0] * 6), (500, [0.0] * 6), (550, [1.0, 2.0]), (551, [1.0, 2.0]), (600, []), (601, []), (650, [1.0] * 3), (700, [-1.0] * 6)]
    assert run_top(spark, rows, **how) == brute_top(rows)


def test_top_k_wide_numbers(spark):
    rows = [(0, [3e9, -1.0]), (1, [2e4, 7.0]), (2, [-2e4, 9.0]), (3, [1.0, 5e12])]
    assert run_top(spark, rows) == brute_top(rows)
    with pytest.raises(Exception, match="64 bits"):
        run_top(spark, [(0, [1e13, 1.0]), (1, [1e13, 1.0])])
    assert run_top(spark, []) == [] and run_top(spark, [(50, [1.0])]) == []


def test_pruning_leaves_out_most_of_a_bucket():
    """Few products are computed where thresholds are high, and none that matters is missed."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(20, 16))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)  # a bucket's vectors are about as long
    v = np.floor(256 * (centre[rng.integers(0, 20, 4_000)] + 0.02 * rng.normal(size=(4_000, 16)))).astype(np.int64)
    bucket = topk.Bucket(np.arange(4_000), np.arange(4_000), v)
    q = v[:40]
    score = topk.products(q, v)
    score[np.arange(40), np.arange(40)] = np.iinfo(np.int64).min
    threshold = np.sort(score, axis=1)[:, -5]
    at, where, found, seen = topk.search(np.arange(40), q, threshold, bucket, 5)
    assert seen["verified"] < 0.25 * seen["pairs"]
    got = defaultdict(list)
    for i, p, s in zip(at, where, found):
        got[i].append((-s, bucket.ids[p]))
    for i in range(40):
        assert sorted(got[i]) == sorted((-s, j) for j, s in enumerate(score[i]) if s >= threshold[i])[:5]


TURNS = "band int, conv_id long, turn long, role string, text string, depth int, words string"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    made = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, s in made.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
    out = []
    for n, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(made[c]) == len(n))))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 2, 3, 32])
def test_prefix_trie(spark, height):
    rng = random.Random(6)
    rows = []
    for c in [*range(-25, 90), 200, 201, 207]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "user", None]), rng.choice(["hi", "hi there", "", None, "so\tit is"])))
    rows += [(1, 0, "user", "hi")] * 3 + [(None, 1, "user", "hi")] * 2
    df = spark.createDataFrame([(9, *r, 9, "w") for r in rows], TURNS).repartition(3)
    got = sorted((tuple(r) for r in trie.prefix_trie(df, height).collect()), key=str)
    assert got == brute_trie(rows)


def test_prefix_trie_edges(spark):
    """A hot conversation whose ids fill several pieces, one long path, an empty table, a conversation without turns."""
    rows = [(20 * i, t, "user", f"same {t}") for i in range(5_000) for t in range(2)] + [(7, t, "user", "long " * 2_000 if t == 5 else str(t)) for t in range(150)]
    df = spark.createDataFrame([(9, *r, 9, "w") for r in rows], TURNS)
    assert sorted((tuple(r) for r in trie.prefix_trie(df, 16).collect()), key=str) == brute_trie(rows)
    assert trie.prefix_trie(df.limit(0)).count() == 0
    short = next(c for c in range(1, 200) if zlib.crc32(str(c).encode()) % 4 and c % 20)
    alone = [(short, 0, "user", "gone")]
    assert [tuple(r) for r in trie.prefix_trie(spark.createDataFrame([(9, *r, 9, "w") for r in alone], TURNS)).collect()] == brute_trie(alone)
