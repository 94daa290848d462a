"""Operators of the llm subpackage on small fixtures: nulls, empty texts, ties, repeats, empty tables, extra
columns; against brute force, a library, an exact round trip or held-out labels."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from oracle import both
from pyspark.sql import functions as F

from attest.llm import chat, decontam, exactdedup, graph, jaccard, langid, mixing, queries, sharding, tokens, toxicity, urlfilter

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, id string, label string, key long, node string"
TEXTS = [None, "", " \t\n", "one", "A b C d e", "a B c d E", "straße ß İ", "<|endoftext|> x <|endoftext|>", "x" * 30_000, "wort " * 20_000, "日本語 🙂", "\x00 nul"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s2"][i % 3], None, 5, "clash", "clash", 1, "clash") for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[1], (None, "one", None, None, 1, 1, "x", "x", 1, "x")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (t or "")).split(" ") if w]


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, name):
    ours, theirs = both(spark, queries.QUERIES[name], queries.ORACLES[name], SMALL)
    assert ours == theirs


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op1_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.98 * len(out) and all(0 <= r["score"] <= 1 for r in out)


def test_language_edges(spark, odd, empty):
    model = langid.train(odd)
    out = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (0, 1, 2))
    assert langid.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.train(empty)).collect()} == {"und"}
    assert langid.keep_identified(odd, model).columns == odd.columns


def test_url_digests(spark):
    urls = spark.createDataFrame([(1, "HTTP://A.Example.NET/en/x?q"), (2, "http://b.net#f"), (3, "http://b.net/"), (4, None), (5, "no scheme"), (6, "x://org/fr/"), (7, "x://borg/fr/"), (8, "x://casino.x.com/"), (9, "a://b://c.net/")], "page_id long, url string")
    rules = spark.createDataFrame(queries.RULES, "rule string, verdict string")
    listed = spark.createDataFrame([("x.com/", "block")], "rule string, verdict string")
    for how in ({}, {"bound": 0}, {"most_lengths": 1}):  # the array, and the joins for longer lists
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(urls, rules, listed=listed, **how).collect()}
        assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("b.net", "", None, "allow") and got[3][2:] == ("net/", "block")
        assert got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow") and got[6][2:] == ("org/fr/", "allow") and got[7][2] is None
        assert got[8][2:] == (None, "block") and got[9] == ("b:", "//c.net/", None, "allow")


def test_url_edges(spark):
    """No rule, no url, repeated rows, columns named like the operator's own, and a long list against brute force."""
    schema = "page_id long, url string, id long, host string, rule string, verdict string"
    none = spark.createDataFrame([], "rule string, verdict string")
    clash = spark.createDataFrame([(1, "x://a.net/b", 5, "h", "r", "v"), (1, "x://a.net/b", 5, "h", "r", "v"), (None, None, None, None, None, None)], schema)
    rules = spark.createDataFrame([("net/", "block"), ("net/", "allow"), (None, "block")], "rule string, verdict string")
    assert {r["verdict"] for r in urlfilter.judge(clash, none).collect()} == {"allow"}
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in urlfilter.judge(clash, rules).collect()) == [(0, "allow"), (1, "block"), (1, "block")]
    assert urlfilter.judge(spark.createDataFrame([], schema), rules).count() == 0
    rng = random.Random(8)
    name = lambda: "".join(rng.choices("ab", k=rng.randint(1, 3)))
    many = {".".join(name() for _ in range(rng.randint(1, 3))) + "/" + "/".join(name() for _ in range(rng.randint(0, 2))): rng.choice(["block", "allow"]) for _ in range(400)}
    urls = [(i, "http://" + ".".join(name() for _ in range(3)) + "/" + "/".join(name() for _ in range(3))) for i in range(300)]

    def brute(url):
        host, _, path = url[7:].partition("/")
        fits = [r for r in many if ("." + host).endswith("." + r.split("/")[0]) and ("/" + path).startswith(r[r.index("/"):])]
        best = max(fits, key=len, default=None)
        return len(best or ""), best is None or {many[r] for r in fits if len(r) == len(best)}

    df = spark.createDataFrame(urls, "page_id long, url string")
    for how in ({}, {"bound": 0}):
        for r in urlfilter.judge(df, spark.createDataFrame(list(many.items()), "rule string, verdict string"), **how).collect():
            size, verdicts = brute(urls[r["page_id"]][1])
            assert len(r["rule"] or "") == size and (r["verdict"] == "allow" if verdicts is True else r["verdict"] in verdicts)


def test_digest_collisions(tmp_path):
    urlfilter.DigestArray.write(str(tmp_path / "a"), [("x/", 1), ("y/", 2)])
    array = urlfilter.DigestArray(str(tmp_path / "a"))
    assert [int(i) >= 0 for i in array.probe([b"x/", b"y/", b"z/"])] == [True, True, False]
    array.keys = np.sort(np.full(2, array.keys[0]))  # every key alike: the strings decide
    import xxhash

    want = next(w for w in (b"x/", b"y/") if xxhash.xxh64_intdigest(w) == int(array.keys[0]))
    assert array.probe([want])[0] >= 0
    urlfilter.DigestArray.write(str(tmp_path / "b"), [])
    assert urlfilter.DigestArray(str(tmp_path / "b")).probe([b"x/"])[0] == -1


def brute_targets(size_of):
    order = sorted(size_of, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(size_of.values()), {}, set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size_of[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * size_of[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_mixing(spark, odd, empty):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * (j % 3 + 1) for j in range(rng.randint(0, 60))), ["a", "b", "é", None, "c"][min(i % 9, 4)]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, group_rows=20).collect()
    sizes = defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(words(t))
    target = brute_targets(sizes)
    taken, source = defaultdict(int), {i: s for i, _, s in rows}
    for r in out:
        s = source[r["doc_id"]]
        assert r["size"] == len(words(rows[r["doc_id"]][1])) and r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 3 for s in sizes)
    assert sorted(out) == sorted(mixing.mix(docs.repartition(7), group_rows=20).collect())
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0
    cells = mixing.stored(docs.select(mixing.source_key(F.col("source")).alias("skey"), mixing.word_count(F.col("text")).alias("size")).groupBy("skey", "size").agg(F.count("*").alias("n")))
    solved = {r["skey"]: r for r in mixing.newton(cells, mixing.targets(cells, (3, 1, 2), 1.5, 2), 2).collect()}
    for s in sizes:  # lambda by bisection
        r, own = solved["~" if s is None else "=" + s], [len(words(t)) for _, t, x in rows if x == s]
        mass = lambda lam: sum(w * min(2, math.exp(min(50, lam * math.sqrt(w / r["mean"])))) for w in own)  # noqa: B023, E731
        lo, hi = -50.0, 50.0
        for _ in range(200):
            lo, hi = ((lo + hi) / 2, hi) if mass((lo + hi) / 2) < target[s] else (lo, (lo + hi) / 2)
        assert mass(r["lam"]) == pytest.approx(target[s], rel=1e-6) and (target[s] >= 2 * sizes[s] * (1 - 1e-9) or r["lam"] == pytest.approx(lo, abs=1e-6))
    mixed = mixing.take_copies(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in out)
    assert mixing.take_copies(odd).columns == odd.columns


def test_take_copies_of_repeats_and_clashes(spark):
    schema = "doc_id long, text string, source string, source_key int, mark int, id_key int, rows int, taken int, nth int, copies int"
    rows = [(None, "a b c", "s"), (None, "a b c", "s"), (None, "a b c", "s"), (None, "d e", None), (1, "f g h", "s"), (1, "i j", "s"), (1, "i j", "t"), (2, None, "s"), (3, "", "t")]
    docs = spark.createDataFrame([(*r, *range(7)) for r in rows], schema)
    counts = Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.take_copies(docs).collect())
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["mark"], r["skey"], r["doc_id"]] += r["copies"]
    marks = {r["text"]: r["mark"] for r in docs.select("text", F.xxhash64("text").alias("mark")).collect()}
    assert {(marks[t], "~" if s is None else "=" + s, i): n for (i, t, s), n in counts.items()} == {k: n for k, n in want.items() if n}
    assert mixing.take_copies(docs).columns == docs.columns and mixing.take_copies(docs.limit(0)).count() == 0


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        v = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        assert np.array_equal(exactdedup.golomb_decode(exactdedup.golomb_encode(v)), v)
    for v in ([0], [1 << 63, (1 << 64) - 1], [0, (1 << 64) - 1]):
        assert exactdedup.golomb_decode(exactdedup.golomb_encode(np.array(v, np.uint64))).tolist() == v


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_exact_dedup_edges(spark, odd, empty, few):
    rows = odd.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[ascii_lower(r["text"])].append(r["doc_id"])
    got = exactdedup.exact_dedup(odd, few=few, few_bytes=few, owners=3).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            own = next(g for t, g in groups.items() if r["doc_id"] in g and hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
            assert r["keep_id"] == max(x for x in own if x is not None) and r["group_size"] == len(own) and r["kept"] == (r["doc_id"] == r["keep_id"])
    assert exactdedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_exact_dedup_null_ids(spark, few):
    rows = [(None, "alone"), (None, "twice"), (None, "TWICE"), (3, "three"), (None, "three")]
    got = exactdedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), few=few, few_bytes=few, owners=3).collect()
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("alone", "twice", "three")}
    want = [(None, None, 1, True, sha["alone"])] + [(None, None, 2, True, sha["twice"])] * 2 + [(3, 3, 2, True, sha["three"]), (None, 3, 2, False, sha["three"])]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_chat_parts(spark):
    schema = f"conv_id long, turn long, role string, parts array<{chat.PART}>, text string"
    rows = [(1, 1, "assistant", [("text", "a<b [x] %3C 100%", None, None), ("image", None, "u1", 2), ("text", "<|end|>", None, None), ("audio", None, "u2", None)], "clash"), (1, 0, None, [("text", None, None, None)], ""), (2, 0, "user\n", None, None)]
    out = chat.format_chat(spark.createDataFrame(rows, schema)).withColumn("b", chat.blocks(F.col("formatted"))).withColumn("t", chat.read_back(F.col("b"))).withColumn("l", chat.loss_text(F.col("b"), F.col("loss_spans")))
    got = {r["conv_id"]: r for r in out.collect()}
    assert [(t["role"], t["text"]) for t in got[1]["t"]] == [("", ""), ("assistant", "a<b [x] %3C 100%<|image:1|><|end|><|audio:2|>")]
    assert got[1]["l"] == got[1]["t"][1]["text"] and [(a["ordinal"], a["type"], a["ref"], a["tokens"]) for a in got[1]["attachments"]] == [(1, "image", "u1", 512), (2, "audio", "u2", 25)]
    assert got[1]["expanded_tokens"] == 537 and [(t["role"], t["text"]) for t in got[2]["t"]] == [("user\n", "")]
    assert chat.format_chat(spark.createDataFrame([], schema)).count() == 0


def brute_leaks(docs, items):
    held = {i: decontam.grams(decontam.words(t)) for i, t in items if decontam.words(t)}
    out = set()
    for d, t in docs:
        own = decontam.grams(decontam.words(t))
        out |= {(d, i) for i, g in held.items() if len(g & own) >= 0.8 * len(g)}
    return out


def test_decontamination(spark, empty):
    d = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    want = brute_leaks([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items, part_words=300).collect()} == want
    assert decontam.clean(docs, items).count() == docs.count() - len({x for x, _ in want})
    assert decontam.leaks(empty, items).count() == 0 and decontam.leaks(docs, items.limit(0)).count() == 0


def test_decontamination_long_item_and_edges(spark, odd):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(5000)]
    item = " ".join(rng.choices(vocabulary, k=300)) + ". The answer is " + " ".join(rng.choices(vocabulary, k=4)) + "."
    filler = " ".join(rng.choices(vocabulary, k=500))
    docs = spark.createDataFrame([(1, f"{filler} {item.upper()} {filler}"), (2, filler), (3, None), (4, item[: len(item) // 2])], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect()} == {(1, 7)}
    assert decontam.clean(odd, items).count() == odd.count()


def test_decontamination_across_cells():
    """A copy cut short is found wherever cells part its common words, all optional, from its rare ones."""
    common = [f"c{k}" for k in range(24)]
    rare = lambda i, n: [f"r{i}x{k}" for k in range(n)]
    items = [(i, " ".join([*common, *rare(i, 15)] if i < 10 else rare(i, 39))) for i in range(20)]
    index = decontam.Index(items, 0.6)
    copy = " ".join(items[3][1].split()[:36])
    texts = [" ".join([*["filler"] * before, copy]) for before in range(130)]
    assert [p for p, n, *_ in index.search(texts, 0.8) if n == 3] == list(range(130))
    # Cells of one text are no windows of the text before.
    assert {p for p, *_ in index.search([" ".join(common), " ".join(rare(3, 12)), ""], 0.8)} == set()


def test_decontamination_partial_copies():
    """Every copy that meets the verification is found, wherever it begins, and whatever the punctuation."""
    rng = random.Random(1)
    common = [f"c{k}" for k in range(60)]
    items = [(i, " ".join([*rng.sample(common, 20), *(f"r{i}x{k}" for k in range(12))])) for i in range(40)]
    index = decontam.Index(items, 0.6)
    for i, text in items[::5]:
        w = text.split()
        for part in (w[:27], w[5:], w[2:29]):
            texts = [" ".join([*["filler"] * before, *part, *["more"] * 80]) for before in range(0, 140, 3)]
            assert {p for p, n, *_ in index.search(texts, 0.8) if n == i} == set(range(len(texts)))
    dressed = "“" + "—".join(items[3][1].split()).replace("c1", "C1") + "”…"
    assert [n for _, n, *_ in index.search([dressed], 0.8)] == [3]


def test_decontamination_repeats_and_clashes(spark):
    item = "the answer to all of these questions is hidden in a very small box. it is forty two"
    docs = spark.createDataFrame([(1, item, "x", 0.1), (1, item, "x", 0.1), (None, item, None, None), (2, "nothing here", None, None)], "doc_id long, text string, item_id string, score double")
    items = spark.createDataFrame([(7, item, "c"), (7, item, "c"), (None, None, None)], "item_id long, text string, doc_id string")
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in decontam.leaks(docs, items).collect()) == [(0, 7)] * 2 + [(1, 7)] * 4
    assert [tuple(r) for r in decontam.clean(docs, items).collect()] == [(2, "nothing here", None, None)]


def test_token_counts(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.TOKENIZER)
    library = Tokenizer.from_file(path)
    got = tokens.token_counts(odd, path).collect()
    rows = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in got:
        assert r["n_tokens"] == len(library.encode(rows[r["doc_id"]], add_special_tokens=False).ids) and r["n_bytes"] == len(rows[r["doc_id"]].encode()) and r["over_limit"] == (r["n_tokens"] > 1024)
    assert len(got) == odd.count() and tokens.token_counts(empty, path).count() == 0
    rng = random.Random(5)
    texts = ["".join(rng.choices("aab \n't're<|éß漢1 9_-.", k=rng.randint(0, 40))) for _ in range(3000)]
    assert tokens.Counter(tokens.Vocabulary(path), room=50).texts(texts, 500) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def brute_components(rows, n=4, percent=85):
    sets = []
    for i, t in rows:
        w = words(ascii_lower(t))
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(i, least.get(find(x), i))
    return sorted((i, len(s), least[find(x)]) for x, (i, s) in enumerate(sets))


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_jaccard_brute(spark, empty, n, percent):
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = rng.choices(vocabulary, k=30)
    rows = [(0, None), (1, ""), (2, "One two"), (3, "one TWO"), (4, "one two three")]
    while len(rows) < 400:
        base = rng.choices(vocabulary, k=rng.choice([4, 6, 9, 20, 60, 200]))
        if rng.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rng.choice([1, 1, 2, 8, 30])):
            copy = [w if rng.random() > rng.choice([0, 0.005, 0.02, 0.06]) else rng.choice(vocabulary) for w in base]
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_components(rows, n, percent)
    assert sorted(tuple(r) for r in jaccard.near_duplicates(docs, n=n, percent=percent).collect()) == want
    assert sorted(tuple(r) for r in jaccard.near_duplicates(docs, n=n, percent=percent, few=0, block=3).collect()) == want
    assert jaccard.near_duplicates(empty).count() == 0


def test_jaccard_edges(spark, odd):
    got = jaccard.near_duplicates(odd).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == odd.count() and by[4]["component_id"] == by[5]["component_id"] == 4 and by[0]["n_shingles"] == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11]


@pytest.mark.parametrize("few", [200_000, 0])
def test_keep_one_by_row(spark, few):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdefg"}
    near = {k: t + " more" for k, t in text.items()}
    rows = [(2, text["a"]), (7, near["a"]), (7, text["b"]), (7, text["b"]), (7, text["c"]), (None, text["d"]), (None, text["e"]), (None, text["e"]), (None, near["e"]), (None, near["c"])]
    rows += [(8, text["f"]), (9, near["f"]), (9, text["g"]), (10, text["g"]), (None, ""), (None, None), (11, ""), (11, " "), (12, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in jaccard.keep_one(docs, few=few).collect()]
    assert sum(1 for i, t in kept if i is None and not t) == 2 and sorted(i for i, t in kept if i and not (t or "").strip()) == [11, 12]
    filled = [(i, t) for i, t in kept if (t or "").strip()]
    one_of_e = [t for i, t in filled if i is None and t in (text["e"], near["e"])]
    assert len(one_of_e) == 1
    rest = sorted((i or 0, t) for i, t in filled if t not in (text["e"], near["e"]))
    assert rest == sorted([(2, text["a"]), (7, text["b"]), (7, text["c"]), (0, text["d"]), (8, text["f"]), (9, text["g"])])


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    import collections

    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for s in sorted(near):
        if s not in want and len(near[s] - {s}):
            todo = [s]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = s
                    todo += near[x]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_sharding(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hot = docs.limit(1).select(F.explode(F.sequence(F.lit(10_001).cast("long"), F.lit(10_600).cast("long"))).alias("doc_id"), "text")
    for rows in (docs.select("doc_id", "text"), docs.select("doc_id", "text").unionByName(hot)):
        out = sharding.shard(rows, per_shard=4, rows_per_range=10).collect()
        texts = {r["doc_id"]: r["text"] for r in rows.collect()}
        slots, size = defaultdict(list), Counter()
        for r in out:
            t = texts[r["doc_id"]].encode()
            assert r["size"] == len(t) + 16 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "bytes" and r["grown_shard"] is None
            slots[r["shard"]].append(r["slot"])
            size[r["shard"]] += r["size"]
        assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(out) == len(texts)
        largest = max(len(t.encode()) for t in texts.values()) + 16
        assert max(abs(v - sum(size.values()) / 40) for v in size.values()) <= largest
    assert sharding.shard(odd, keep=("lang", "key")).count() == odd.count() and sharding.shard(empty).count() == 0


def brute_edits(a, b):
    """Damerau-Levenshtein (neighbour swaps) distance at most one."""
    if a == b:
        return True
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
    s, t = sorted((a, b), key=len)
    return len(t) - len(s) == 1 and any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def test_automaton_brute():
    rng = random.Random(4)
    lexicon = ["".join(rng.choices("abc", k=rng.randint(3, 8))) for _ in range(40)]
    lexicon = sorted(set(lexicon))
    m = toxicity.Matcher(lexicon, ["aab"], room=60)
    for _ in range(4000):
        w = "".join(rng.choices("abcd", k=rng.randint(1, 9)))
        want = {i for i, x in enumerate(lexicon) if x == w or len(x) >= toxicity.FUZZY_LENGTH and brute_edits(x, w)}
        got = m.match(w)
        assert {e for e, _ in got if e < len(lexicon)} == want
        assert all((edits == 0) == (lexicon[e] == w) for e, edits in got if e < len(lexicon))
        assert (len(lexicon) in {e for e, _ in got}) == w.startswith("aab")


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    out = queries.op10_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in out)
    assert hit >= 0.8 * sum(r["toxic"] for r in out) and hit >= 0.85 * sum(r["predicted"] for r in out)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in out)


def test_toxicity_edges(spark, odd, empty):
    rows = [(i, f"you are such an {w} today {i}", y) for i in range(900) for w, y in [("idiot", 1) if i % 3 == 0 else ("expert", 0)]]
    scorer = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert scorer.score("an idiot") > 0.5 and scorer.score("an idoit") > scorer.score("an expert") and scorer.score("") == scorer.score(None) < 0.3
    assert scorer.features('"you idiot" is what they shouted')[2] > 0 and scorer.features('"well you idiot !!!')[2] == scorer.features("the dogs' idiot cats'")[2] == 0
    assert scorer.features('he said "idiot" to me')[2] > 0 and scorer.features("an idiot")[2] == 0
    assert toxicity.score(odd, scorer).count() == odd.count() and toxicity.score(empty, scorer).count() == 0
    nothing = toxicity.train(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert 0 <= nothing.score("x") <= 1


def test_toxicity_rare_terms(spark):
    rows = [(i, f"you are such an {'zonkhead' if i % 100 == 0 else 'expert'} today {i}", int(i % 100 == 0)) for i in range(6000)]
    scorer = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), bound=300)
    assert "zonkhead" in scorer.words and scorer.score("an zonkhead") > 0.5 and scorer.score("an expert") < 0.1
    assert toxicity.class_fractions(200, 100, 300) == (1, 1) and toxicity.class_fractions(5940, 60, 300) == (240 / 5940, 1) and toxicity.class_fractions(1000, 9000, 300) == (0.15, 150 / 9000)


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    d = SMALL
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, stage(spark, docs, d).cache()
        seen[name] = docs.count()
        if name != "shards":
            assert docs.columns == before.columns
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"] for r in docs.collect()} == {c for _, _, c in brute_components(rows, 5, 80)}
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
            bad = {x for x, _ in brute_leaks([(r["doc_id"], r["text"]) for r in before.collect()], items)}
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()} - bad
    assert seen["language"] == 200 and seen["shards"] == seen["mixture"]


@pytest.mark.parametrize("extra", ["node_", "id_", "gone"])
def test_pipeline_stages_on_odd_tables(spark, odd, empty, extra):
    """Nulls in any column, empty and very long texts, repeated rows, names that clash, and no rows at all."""
    import corpus_pipeline as pipeline

    docs, none = (t.withColumn(extra, F.lit("mine")) for t in (odd, empty))
    for name, stage in pipeline.STAGES[:-1] if extra == "node_" else pipeline.STAGES[1:2]:
        kept = stage(spark, docs, SMALL)
        assert kept.columns == docs.columns and stage(spark, none, SMALL).count() == 0, name
        rows = kept.collect()
        assert {r[extra] for r in rows} <= {"mine"} and {(r["doc_id"], r["text"]) for r in rows} <= {(r["doc_id"], r["text"]) for r in docs.collect()}
        if name == "near_duplicates":
            assert Counter(r["doc_id"] for r in rows if r["doc_id"] not in (1, None)) == Counter(i for i in range(len(TEXTS)) if i not in (1, 5))
    assert pipeline.STAGES[-1][1](spark, none, SMALL).count() == 0 and pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()


def test_jaccard_family_below_the_threshold(spark):
    """Two thousand documents that all are similar, few of them enough: links alone leave a meeting."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(2000):
        w = list(base)
        for k in rng.sample(range(60), 4):
            w[k] = f"x{i}y{k}"
        rows.append((i, " ".join(w)))
    rows += [(5000 + i, rows[i][1] + " end") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs, block=300).collect()}
    assert {i: c for i, c in got.items() if i != c} == {5000 + i: i for i in range(5)}


def test_overlaps_brute():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 5000, n).astype(np.uint64)) for n in (0, 1, 40, 900, 3000, 3000)]
    got = jaccard.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(len(sets)) for j in range(i))
