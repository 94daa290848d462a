"""Samples drawn by row whatever the ids, a dictionary naive Bayes, decontamination with all its conditions by brute force,
owners and bits of the fingerprint exchange."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from attest.llm import decontam, exactdedup, langid, toxicity

ROWS = "doc_id long, text string, lang string, toxic int"


@pytest.mark.parametrize("ids", ["one", "null"])
def test_samples_without_ids(spark, ids):
    """8,000 rows under one id, or none, are learned from as others are, and no more of them than the bound."""
    rng = random.Random(1)
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["quick", "brown", "foxes"]}
    rows = [(7 if ids == "one" else None, " ".join(rng.choices(words[x], k=8)) + f" {i}", x, int(x == "bb")) for i in range(8_000) for x in [rng.choice("ab") * 2]]
    df = spark.createDataFrame(rows, ROWS)
    model = langid.train(df, per_label=300)
    assert model.score(["lorem ipsum dolor", "quick brown foxes"])[0] == ["aa", "bb"]
    seen = df.filter(langid.hash_unit(df["doc_id"].cast("string"), df["text"]) < 300 / 4_000).count()
    assert 400 < seen < 800
    scorer = toxicity.train(df, bound=1_000)
    assert scorer.score("quick brown foxes") > scorer.score("lorem ipsum dolor")


def test_naive_bayes_of_a_dictionary(spark):
    """Scores are those of counts in a dictionary: n-grams by the operator's own buckets, everything else anew."""
    rng = random.Random(2)
    texts = [("".join(rng.choices("abcde éß ", k=rng.randint(1, 60))), rng.choice(["x", "y", "z"])) for _ in range(200)]
    df = spark.createDataFrame([(i, t, x, 0) for i, (t, x) in enumerate(texts)], ROWS)
    buckets = 1 << 10
    model = langid.train(df, buckets=buckets, per_label=10_000)

    def by_order(text):
        g = langid.Grams([text], buckets)
        out = []
        for n, bucket in zip(langid.ORDERS, g.by_order, strict=True):
            lo, hi = g.spans(n)
            inside = np.zeros(len(bucket) + 1, int)
            for a, b in zip(np.minimum(lo, len(bucket)), np.minimum(hi, len(bucket))):
                inside[a] += 1
                inside[b] -= 1
            out.append([int(b) for b, k in zip(bucket, np.cumsum(inside)) if k > 0 and b < buckets])
        return out

    counts = defaultdict(Counter)
    for t, x in texts:
        for grams in by_order(t):
            counts[x].update(grams)
    labels = sorted(counts)
    for t, _ in texts[:60]:
        if not any(c.isalpha() for c in t):
            continue
        logs = []
        for x in labels:
            total = sum(counts[x].values()) + 0.1 * buckets
            logs.append(sum(math.log((counts[x][g] + 0.1) / total) for grams in by_order(t) for g in grams) / len(langid.ORDERS))
        name, score = model.score([t])
        assert name[0] == labels[int(np.argmax(logs))] and abs(score[0] - 1 / sum(math.exp(v - max(logs)) for v in logs)) < 1e-3


def test_decontamination_by_brute_force(spark):
    """Question and answer conditions included: documents that hold an item's whole text, its question alone, its answer alone,
    or the item with words changed here and there."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 30))).capitalize() + ". " + " ".join(word() for _ in range(rng.randint(1, 6))) + ".") for i in range(40)]
    docs = []
    for i in range(300):
        item = rng.choice(items)[1]
        question, _, answer = item.partition(". ")
        changed = " ".join(w if rng.random() < rng.choice([0.95, 0.8]) else word() for w in item.split())
        docs.append((i, " ".join(word() for _ in range(rng.randint(0, 150))) + " " + rng.choice([item, item.upper(), question, answer, changed, ""]) + " " + " ".join(word() for _ in range(rng.randint(0, 90)))))

    def brute(text):
        held, vocabulary = decontam.grams(decontam.words(text)), set(decontam.words(text))
        for i, item in items:
            parts = decontam.sentences([item])[0]
            question, answer = decontam.parts_of(parts)
            whole = decontam.grams([w for s in parts for w in s])
            share = lambda g: len(g & held) / len(g) if len(next(iter(g))) == 5 else float(f" {' '.join(next(iter(g)))} " in f" {' '.join(decontam.words(text))} ")
            if share(whole) >= 0.8 and share(decontam.grams(question)) >= 0.8 and len(set(answer) & vocabulary) >= 0.5 * len(set(answer)):
                yield i

    want = {(d, i) for d, t in docs for i in brute(t)}
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 60


@pytest.mark.parametrize("owners,owned", [(None, 50), (3, 5_000_000), (None, 5_000_000)])
def test_exchange_over_any_owners(spark, monkeypatch, owners, owned):
    monkeypatch.setattr(exactdedup, "OWNED", owned)
    monkeypatch.setattr(exactdedup, "BITS", 20 if owned == 50 else 40)  # few bits: suspects by chance are told apart
    texts = [f"Text {i % 700}" if i % 3 else f"text {i}" for i in range(4_000)]
    out = exactdedup.exact_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), owners=owners).collect()
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t.lower()].append(i)
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in out} == {(i, max(g), len(g)) for g in groups.values() for i in g} and len(out) == len(texts)


def plain_quotations(tokens):
    """Every pair of an opening and the next closing mark of its kind with no other opening of that kind between."""
    pair = {'"': '"', "“": "”", "„": "“”", "«": "»", "‘": "’"}
    opens = lambda t: t[0] if t[0] in pair and len(t) > 1 else None
    closes = lambda t, kinds: len(t.rstrip(".,;:!?")) > 1 and t.rstrip(".,;:!?")[-1] in kinds
    out, i = [0] * len(tokens), 0
    while i < len(tokens):
        mark = opens(tokens[i])
        end = next((j for j in range(i, len(tokens)) if closes(tokens[j], pair[mark])), None) if mark else None
        if end is not None and any(opens(tokens[k]) and pair[tokens[k][0]] == pair[mark] for k in range(i + 1, end + 1)):
            end = None  # opened anew: the later one counts
        elif mark and end is None and not any(opens(tokens[k]) and pair[tokens[k][0]] == pair[mark] for k in range(i + 1, len(tokens))):
            break  # open to the end: nothing after it is read as a quotation of another kind
        if end is None:
            i += 1
            if mark:  # marks of other kinds inside an open quotation are its text
                i = next(k for k in range(i, len(tokens)) if opens(tokens[k]) and pair[tokens[k][0]] == pair[mark])
            continue
        out[i : end + 1] = [1] * (end + 1 - i)
        i = end + 1
    return out


def test_quotations():
    rng = random.Random(8)
    kinds = ["a", "b.", '"a', 'a"', '"a"', '"', "“a", "a”", "„a", "a“", "«a", "a»,", "‘a", "a’", "a’.", '"a".', ".", "”"]
    for _ in range(3_000):
        tokens = rng.choices(kinds, k=rng.randint(0, 14))
        assert list(toxicity.quotations(tokens)) == plain_quotations(tokens), tokens
    far = ['"so'] + ["word"] * 500 + ["it", 'is"', "after"]
    assert sum(toxicity.quotations(far)) == 503 and not toxicity.quotations(far)[-1]


def test_misspellings_and_known_words(spark):
    """A word of its own is no misspelling of a toxic one, a word nobody knows is, four letters suffice; nothing is cut."""
    rows = [(i, f"a {w} now", "en", y) for i in range(1_200) for w, y in [[("jerk", 1), ("perk", 0), ("clerk", 0), ("plain", 0)][i % 4]]]
    df = spark.createDataFrame(rows, ROWS)
    scorer = toxicity.train(df)
    assert "jerk" in scorer.words and "perk" in scorer.known and "plain" not in scorer.known
    jerk = scorer.words.index("jerk")
    assert (jerk, 1) in scorer.hits("jork") and (jerk, 1) in scorer.hits("jekr") and not scorer.hits("perk") and not scorer.hits("plain")
    assert scorer.features(" ".join(['"you', *["are"] * 30, "jerk", *["so"] * 30, 'there"']))[2] > 0
    with pytest.raises(ValueError, match="more than"):
        toxicity.train(df, entries=0)
