"""Golden rows and brute force for keyword evidence, review state, imports and plug-ins."""

import json
import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attest.operators import evidence as ev
from attest.operators import cells, plug, retrieve, review
from attest.operators.terms import find_terms
from attest.plans import evidence as plans
from attest.plans import extra, plugs
from attest.sources import layout, records
from attest.sources.shared import shared_dir

SMALL = "/root/testdata/sf0.001"
IMPLIED = [("python", "Flask", 0), ("python", "pandas", 1), ("aws", "eks", 0), ("leadership", "Led", 0), ("etl", "dbt", 0), ("sql", "postgresql", 0)]


@pytest.fixture(scope="module")
def implied(spark):
    return spark.createDataFrame(IMPLIED, "keyword string, term string, term_no int")


def supported(spark, implied, rows, strict=True, context=None):
    units = spark.createDataFrame([(i, i, 0, "SUMMARY" if context else "EXPERIENCE", t) for i, (_, t) in enumerate(rows)], "doc_id long, job_id int, unit_no int, section string, text string")
    keywords = spark.createDataFrame([(i, 0, k) for i, (k, _) in enumerate(rows)], "job_id int, ord int, keyword string")
    contexts = spark.createDataFrame([(i, i, context) for i in range(len(rows))], "doc_id long, job_id int, text string") if context else None
    return {r["doc_id"]: (r["via"], r["evidence"]) for r in ev.support(units, keywords, implied, contexts, strict).collect()}


def test_support(spark, implied):
    cases = [
        ("PostgreSQL", "Sent the reports to Postgres", ("alias", "Postgres")),
        ("Kubernetes", "Moved the test cluster to k8s", ("alias", "k8s")),
        ("Go", "Wrote the importer in Golang", ("alias", "Golang")),
        ("APIs", "Drew up the shipping API", ("alias", "API")),
        ("API", "Looked after nine APIs", ("alias", "APIs")),
        ("Machine Learning", "Served ML models", ("alias", "ML")),
        ("Machine Learning", "Poured 20 ml of it", None),
        ("Python experience", "Cleaned tables with pandas", ("implied", "pandas")),
        ("Python", "Broke a flask in the lab", None),
        ("AWS", "Put the jobs on EKS", ("implied", "EKS")),
        ("leadership", "Led five people", ("implied", "Led")),
        ("leadership", "Screwed in LED lamps", None),
        ("code review", "Reviewed code of two juniors", ("reworded", "reviewed code")),
        ("documentation", "Documented the release", ("reworded", "documented")),
        ("cross-functional collaboration", "Collaborated with cross-functional people", ("reworded", "collaborated cross functional")),
        ("stakeholder management", "Met stakeholders", None),
        ("Sketch", "Sketched screens", None),
        ("segment", "Segmented the users", None),
        ("go", "Goes live", None),
        ("Code Review", "Reviewed code", None),
    ]
    got = supported(spark, implied, [(k, t) for k, t, _ in cases])
    assert {i: got.get(i) for i in range(len(cases))} == {i: w for i, (_, _, w) in enumerate(cases)}
    assert supported(spark, implied, [("Code Review", "Reviewed code")], strict=False)[0] == ("reworded", "reviewed code")
    assert supported(spark, implied, [("Go", "Engineer for payments"), ("Kafka", "Engineer")], context="Engineer\nPython, Go, Flask") == {0: ("resume", "Go")}


def test_offers_against_a_greedy_loop(spark):
    units = plans._units(spark, SMALL).filter("doc_id < 300")
    keywords, contexts = plans._keywords(spark, SMALL), plans._contexts(units)
    found = defaultdict(dict)
    for r in ev.support(units, keywords, plans._implications(spark, SMALL), contexts).collect():
        found[r["doc_id"], r["unit_no"]][r["ord"]] = (r["keyword"], r["via"], r["evidence"])
    text = {r["doc_id"]: f" {r['text']} ".replace("\n", " ").lower() for r in contexts.collect()}
    want, given, seen = set(), defaultdict(int), set()
    for u in sorted(units.collect(), key=lambda u: (u["doc_id"], u["unit_no"])):
        if (u["doc_id"], u["text"]) in seen:
            continue
        seen.add((u["doc_id"], u["text"]))
        rows = sorted((f" {k.lower()} " in text[u["doc_id"]], o, k, v, e) for o, (k, v, e) in found[u["doc_id"], u["unit_no"]].items() if f" {k.lower()} " not in f" {u['text'].lower()} ")
        picked = 0
        for _, _, k, v, e in rows:
            if picked < 2 and given[u["doc_id"], k] < 2:
                picked += 1
                given[u["doc_id"], k] += 1
                want.add((u["doc_id"], u["unit_no"], k, v, e))
    assert {tuple(r) for r in ev.offers(units, keywords, plans._implications(spark, SMALL), contexts).collect()} == want and want


def test_terms_against_patterns(spark):
    """The automaton finds what a pattern per term finds, in one part or many; blanks and nulls are nowhere."""
    rng = random.Random(4)
    words = ["C++", "c", "C#", "node.js", "node", "LED", "led", "a b", "b", "İ", "straße", "K", "x+y", ".net", "ab", "AB"]
    texts = [(i, rng.choice([None, "", "".join(rng.choice([*words, " ", " ", "-", "1", "+"]) for _ in range(rng.randint(0, 12)))])) for i in range(400)]
    terms = [(w, w in ("LED", "AB", "led")) for w in words] + [("", False), (None, False), ("b", False)]
    want = set()
    for i, text in texts:
        for term, exact in terms:
            m = term and re.search(("" if exact else "(?i)") + "(?<![A-Za-z0-9])" + re.escape(term) + "(?![A-Za-z0-9+#])", text or "", re.ASCII)
            if m:
                want.add((i, term, m[0]))
    df, listed = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(terms, "term string, exact boolean")
    for bound in (100_000, 5, 1):
        got = [tuple(r) for r in find_terms(df, ["id"], listed, bound).collect()]
        assert set(got) == want and len(got) == len(want)
    assert find_terms(df, ["id"], listed.limit(0)).count() == 0


def test_reworded_by_the_rarest_word(spark):
    """Met by a broadcast or a shuffle, the rows are the same, and so are those of a loop over all pairs."""
    units, keywords = plans._units(spark, SMALL).filter("doc_id < 200"), plans._keywords(spark, SMALL)
    near = {tuple(r) for r in ev.reworded(units, ["doc_id", "unit_no"], keywords, True).collect()}
    assert {tuple(r) for r in ev.reworded(units, ["doc_id", "unit_no"], keywords, True, few=0).collect()} == near and near
    more = spark.createDataFrame([(1, 0, "tested tests of the cluster clusters"), (2, 0, None), (3, 0, "clusters")], "doc_id long, job_id int, text string")
    asked = spark.createDataFrame([(0, 0, "cluster testing"), (0, 1, "testing testing cluster"), (0, 2, "of the"), (0, 3, "unmet cluster")], "job_id int, ord int, keyword string")
    got = {tuple(r) for r in ev.reworded(more, ["doc_id"], asked, True).collect()}
    assert got == {(1, 0, 0, "cluster testing", "tested cluster"), (1, 0, 1, "testing testing cluster", "tested cluster")}


def test_check(spark, implied):
    pairs = spark.createDataFrame([(1, 0, 0, "Wrote it in Flask", "Wrote it in Python on AWS"), (2, 0, 0, "Ran Python", "Runs Python"), (3, 0, 0, None, "python")], "doc_id long, job_id int, unit_no int, original string, rewritten string")
    keywords = spark.createDataFrame([(0, 0, "Python"), (0, 1, "AWS")], "job_id int, ord int, keyword string")
    got = {(r["doc_id"], r["keyword"]): (r["supported"], r["via"]) for r in ev.check(pairs, keywords, implied).collect()}
    assert got == {(1, "Python"): (True, "implied"), (1, "AWS"): (False, None), (3, "Python"): (False, None)}


def test_resolve_passes_over_overlaps(spark):
    lines = spark.createDataFrame([(1, "S", i, f"l{i}") for i in range(6)], "doc_id long, section string, idx int, line string")
    suggestions = spark.createDataFrame([(1, "S", "a", 0, 2, "o", "A", "x"), (1, "S", "b", 1, 3, "o", "B", "x"), (1, "S", "c", 4, 4, "old", "C", "x"), (1, "S", "d", 5, 5, "o", "D", "none")], "doc_id long, section string, id string, first int, last int, original string, rewritten string, framework string")
    decisions = spark.createDataFrame([(1, "a", True), (1, "b", True), (1, "c", False), (1, "d", True)], "doc_id long, id string, accepted boolean")
    none = spark.createDataFrame([], "doc_id long, id string, text string")
    said = spark.createDataFrame([(1, "l3", "three")], "doc_id long, line string, text string")
    got = [(r["idx"], r["line"], r["via"]) for r in review.resolve_lines(lines, suggestions, decisions, none, said).orderBy("idx").collect()]
    assert got == [(0, "A", "accepted"), (3, "three", "as is"), (4, "old", "dismissed"), (5, "l5", "as is")]


def brute_feedback(content, events):
    kept = []
    for _, fid, status, kind, section, text in sorted(events):
        if status == "dismissed":
            kept = [k for k in kept if k[0] != fid]
            continue
        now = kept[-1][1] if kept else content
        if kind == "edit":
            kept.append((fid, text))
        elif (at := now.find(f"## {section}")) >= 0:
            after = at + len(f"## {section}")
            end = now.find("\n## ", after)
            kept.append((fid, now[:after] + "\n" + text + "\n" + (now[end:] if end >= 0 else "")))
    return kept


def test_apply_feedback(spark):
    rng = random.Random(3)
    base = "# CV\n## A\nalpha\n## B\nbeta"
    rows = [(u, t, rng.randint(1, 9), rng.choice(["accepted", "accepted", "dismissed"]), rng.choice(["edit", "section_edit", "section_edit"]), rng.choice("ABC"), f"## B\nnew {t}" if t % 2 else f"text {t}") for u in range(20) for t in range(15)]
    log = spark.createDataFrame(rows, "analysis_id long, ts int, feedback_id long, status string, feedback_type string, section string, text string")
    got = defaultdict(list)
    for r in review.apply_feedback(spark.createDataFrame([(u, base) for u in range(20)], "analysis_id long, content string"), log).orderBy("analysis_id", "revision").collect():
        got[r["analysis_id"]].append((r["feedback_id"], r["content"]))
    assert got == {u: k for u in range(20) if (k := brute_feedback(base, [r[1:] for r in rows if r[0] == u]))}
    assert extra.join_apply_feedback(spark, SMALL).count() > 0


def test_two_columns(spark):
    left = [(20, 60 + 20 * i, 200, 72 + 20 * i, f"left {i} words") for i in range(4)]
    right = [(330, 60 + 20 * i, 500, 72 + 20 * i, f"right {i} words") for i in range(4)]
    name, across = (200, 10, 420, 30, "Name of them"), (100, 99, 500, 100, "Across")
    boxes = [(1, i, *map(float, b[:4]), b[4]) for i, b in enumerate([name, *right, across, *left])]
    dates = [(2, i, float(x0), float(60 + 20 * (i % 5)), float(x0 + 100), float(72 + 20 * (i % 5)), t) for i, (x0, t) in enumerate([(20, "Engineer")] * 5 + [(400, "Jan 2020 - now")] * 5)]
    df = spark.createDataFrame(boxes + dates, "page long, box int, x0 double, y0 double, x1 double, y1 double, text string")
    got = defaultdict(list)
    for r in layout.layout_lines(df).orderBy("page", "line_no").collect():
        got[r["page"]].append(r["line"])
    assert got[1] == ["Name of them", "left 0 words", "left 1 words", "right 0 words", "right 1 words", "Across", "left 2 words", "left 3 words", "right 2 words", "right 3 words"]
    assert got[2] == ["Engineer", "Jan 2020 - now"] * 5


def test_evidence_without_a_shuffle(spark, implied):
    """Names are settled inside a text's row; both ways, by short and by long lists, agree."""
    units = spark.createDataFrame([(1, 0, 1, "SUMMARY", "Led teams"), (1, 1, 1, "EXPERIENCE", "Wrote Flask and pandas code"), (1, 2, 1, "EXPERIENCE", None), (2, 0, 2, "SUMMARY", "eks and pandas"), (2, 1, 2, "SUMMARY", "")], "doc_id long, unit_no int, job_id int, section string, text string")
    words = spark.createDataFrame([(1, 1, "Python"), (1, 2, "leadership"), (1, 3, "team leads"), (2, 1, "AWS"), (2, 2, "python"), (2, 3, "wrote")], "job_id int, ord int, keyword string")
    contexts = spark.createDataFrame([(1, 1, "Led teams\nWrote Flask and pandas code\nPython"), (2, 2, "eks and pandas\nwrote")], "doc_id long, job_id int, text string")
    short, long = ({tuple(r) for r in ev.support(units, words, implied, contexts, few=few).collect()} for few in (100_000, 0))
    assert short == long and (1, 0, 1, 1, "Python", "resume", "Python") in short and (1, 1, 1, 1, "Python", "implied", "Flask") in short
    assert len(ev.support(units, words, implied, contexts).collect()) == len(short)
    short, long = ({tuple(r) for r in ev.offers(units, words, implied, contexts, few=few).collect()} for few in (100_000, 0))
    assert short == long and short
    by_name = ev.named(units, words, implied)
    assert {tuple(r) for r in by_name.collect()} == {tuple(r) for r in ev.named(units, words, implied, few=0).collect()}
    assert "Exchange" not in by_name._jdf.queryExecution().executedPlan().toString()


def clustered(n, seed, width=24):
    """Vectors around centres, some of them copies, some zero."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(60, width))
    v = centre[rng.integers(0, 60, n)] + 0.15 * rng.normal(size=(n, width))
    v[rng.integers(0, n, n // 20)] = v[0]
    v[rng.integers(0, n, 3)] = 0
    return v


def as_table(spark, v):
    return spark.createDataFrame(pa.table({"vec_id": np.arange(len(v)), "embedding": v.tolist()}))


def unit(v):
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


@pytest.mark.parametrize("block", [4_096, 300])
def test_nearest_of_many_guides(spark, monkeypatch, block):
    """50,000 guides in cells give the rows of the whole product, from a small part of its comparisons."""
    monkeypatch.setattr(cells, "BLOCK", block)
    n = 50_000 if block == 4_096 else 4_000
    g, q = clustered(n, 1), clustered(500, 1)[:400]
    compared = spark.sparkContext.accumulator(0)
    got = defaultdict(list)
    for r in retrieve.topk(as_table(spark, q), as_table(spark, g), 3, few=1_000, compared=compared).collect():
        got[r["vec_id"]].append((r["rank"], r["guide_id"], r["score"]))
    score = unit(q) @ unit(g).T
    score = np.sign(score) * np.floor(np.abs(score) * 1000 + 0.5) / 1000
    for i in range(len(q)):
        order = np.lexsort((np.arange(n), -score[i]))[:3]
        assert sorted(got[i]) == [(k + 1, j, score[i, j]) for k, j in enumerate(order)]
    assert 0 < compared.value < (0.2 if n == 50_000 else 0.6) * len(q) * n


@pytest.mark.parametrize("block", [4_096, 100])
def test_near_vectors_in_cells(spark, monkeypatch, block):
    monkeypatch.setattr(cells, "BLOCK", block)
    v = clustered(3_000, 2)
    compared = spark.sparkContext.accumulator(0)
    got = {r["vec_id"]: (r["other_id"], r["score"]) for r in retrieve.near_duplicates(as_table(spark, v), 0.95, compared).collect()}
    u = unit(v)
    score = u @ u.T
    np.fill_diagonal(score, -2)
    top = score.max(axis=1)
    assert set(got) == set(np.flatnonzero(top >= 0.95))
    for i, (other, s) in got.items():
        assert abs(s - top[i]) < 1e-9 and abs(score[i, other] - top[i]) < 1e-9
    hot = np.flatnonzero((v == v[0]).all(axis=1))
    assert {got[i][0] for i in hot[1:]} == {hot[0]} and got[hot[0]][0] == hot[1]
    assert 0 < compared.value < 0.4 * len(v) ** 2


def test_cache_of_copies(spark):
    """Against a loop over the log, with many copies under keys of their own."""
    v = clustered(600, 3)
    v[::7] = v[0]
    u, keys = unit(v), [i % 400 for i in range(600)]
    entries, counts = {}, [0, 0, 0]
    for i, k in enumerate(keys):
        first = keys.index(k)
        if k in entries:
            counts[0] += 1
        elif any(u[first] @ u[e] >= 0.93 for e in entries.values()):
            counts[1] += 1
        else:
            entries[k] = first
            counts[2] += 1
    df = as_table(spark, v).join(spark.createDataFrame(list(enumerate(keys)), "vec_id long, key long"), "vec_id")
    assert tuple(retrieve.cache_profile(df).first()) == (*counts, len(entries))


def test_vectors_that_pivots_do_not_part(spark):
    """Every vector may be near any other: it is copied once a group of cells, never once a cell, and in small batches."""
    v = np.random.default_rng(4).normal(size=(5_000, 24))
    rows = as_table(spark, unit(v)).toDF("id", "v").withColumn("limit", F.lit(0.0))
    around = cells.draw(rows, len(v))
    cells.placed(rows, around)
    groups = len(around.groups[24])
    everywhere = lambda limits, angles, least, sizes: (np.isfinite(least), np.full(len(limits), np.pi))
    visits = cells._visits(rows, around, everywhere, {(24, g): 2 for g in range(groups)})
    assert len(around.pivots[24]) == 71 and groups <= 8 and visits.count() == groups * len(v)
    got = {r["vec_id"]: r["other_id"] for r in retrieve.near_duplicates(as_table(spark, v), 0.2).collect()}
    score = unit(v) @ unit(v).T
    np.fill_diagonal(score, -2)
    assert got == {i: j for i, j in enumerate(score.argmax(axis=1)) if score[i, j] >= 0.2}


@pytest.mark.parametrize(("first", "listed"), [(4_096, 64), (100, 3), (40, 1)])
def test_cache_in_stretches(spark, first, listed):
    """However the log is cut and however few close vectors are listed, entries are those of a loop over it."""
    v = np.vstack([clustered(400, 5, 6), np.random.default_rng(6).normal(size=(400, 6))])
    v[400:500] = v[400] + 0.01 * v[400:500]  # a new cluster, all in one stretch
    u = unit(v)
    entries, hits = [], 0
    for i in range(len(v)):
        if any(u[i] @ u[e] >= 0.8 for e in entries):
            hits += 1
        else:
            entries.append(i)
    log = as_table(spark, v).withColumn("key", F.col("vec_id"))
    assert tuple(retrieve.cache_profile(log, 0.8, first=first, listed=listed).first()) == (0, hits, len(entries), len(entries))


def test_odd_vectors(spark):
    v = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    few = {tuple(r) for r in retrieve.topk(v, v, 3).collect()}
    assert {tuple(r) for r in retrieve.topk(v, v, 3, few=0).collect()} == few and len(few) == 3 * v.count()
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, None)], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in retrieve.near_duplicates(odd).collect()} == {(1, 2, 1.0), (2, 1, 1.0)}
    assert retrieve.near_duplicates(odd.limit(0)).count() == 0 and retrieve.topk(v, v.limit(0)).count() == 0


def test_paired_boxes_stay_on_their_page(spark):
    """Against all pairs; nothing is moved by strip, and src_layout_lines moves lines by page alone."""
    rng = random.Random(4)
    rows = [(p, b, float(rng.randint(0, 60)), float(rng.randint(0, 200)), float(rng.randint(0, 60)), float(rng.randint(1, 90))) for p in range(20) for b in range(p)]
    rows = [(p, b, x, y, x + w, y + h) for p, b, x, y, w, h in rows] + [(30, 0, None, 1.0, 5.0, 9.0), (30, 1, 50.0, 1.0, 60.0, 9.0), (30, 2, 70.0, None, 80.0, 9.0), (30, 3, 80.0, 1.0, 80.0, 9.0), (31, 0, 5.0, 1.0, 5.0, 2.0)]
    meet = lambda a, b: None not in a + b and a[0] == b[0] and a[1] != b[1] and a[3] < b[5] and b[3] < a[5] and (a[4] <= b[2] or b[4] <= a[2])
    boxes = spark.createDataFrame(rows, "page int, box int, x0 double, y0 double, x1 double, y1 double")
    got = [tuple(r) for r in layout.paired(boxes.repartition(4, "page")).collect()]
    want = [a for a in rows if any(meet(a, b) for b in rows) or a[:2] in {(30, 0), (30, 1)}]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 50
    plan = extra.src_layout_lines(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\((\w+)#\w+, \d+\)", plan) == ["page"] * 3 and plan.count("Exchange hashpartitioning") == 3


def test_read_cases(spark, tmp_path):
    case = {"id": "a", "original": "o", "rewritten": "r", "labels": {"invented_metric": True, "role_escalation": False}, "note": ""}
    for name, value in (("list", [case, case]), ("object", {"cases": [case]}), ("none", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    assert [r["labels"]["invented_metric"] for r in records.read_cases(spark, f"{tmp_path}/list.json").collect()] == [True, True]
    assert records.read_cases(spark, f"{tmp_path}/object.json").count() == 1
    with pytest.raises(ValueError):
        records.read_cases(spark, f"{tmp_path}/none.json")


def test_cases_are_written_packed(spark):
    """src_cases writes fewer bytes than the texts of its cases have letters."""
    folder = Path(shared_dir(spark).removeprefix("file:"), f"attest-{spark.sparkContext.applicationId}")
    before = set(folder.rglob("part-*"))
    cases = plugs.src_cases(spark, "/root/testdata/sf0.001")
    size = sum(p.stat().st_size for p in set(folder.rglob("part-*")) - before)
    letters = cases.select(F.sum(F.length("original") + F.length("rewritten"))).first()[0]
    assert 0 < size < letters


def test_plug_ins(spark, tmp_path):
    texts = spark.createDataFrame([(1, "ab"), (2, None), (3, "abc")], "id long, text string")
    got = {r["id"]: r["embedding"] for r in plug.embed(texts, lambda ts: [[float(len(t))] for t in ts]).collect()}
    assert got == {1: [2.0], 2: None, 3: [3.0]} and plug.embed(texts, None).filter("embedding is not null").count() == 0
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.html").write_text("x")
    rows = plug.read_files(spark, str(tmp_path), {"text": lambda b: b.decode().split("\n")}).orderBy("path", "line_no").collect()
    assert [(r["reader"], r["line"], r["warning"]) for r in rows] == [("text", "one", None), ("text", "two", None), ("html", None, "no reader")]
    counted, seen = plug.observed(texts, "progress", named=F.col("text").isNotNull())
    counted.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 3, "named": 2}


def test_a_repeated_text_is_judged_once(spark, implied, monkeypatch):
    """Texts and lists sent to tasks or met in a shuffle, documents cut by small batches: the rows of a settling in a shuffle."""
    judged, found = [], ev.best_terms
    monkeypatch.setattr(ev, "best_terms", lambda texts, rules, **more: judged.append(texts.count()) or found(texts, rules, **more))
    rng = random.Random(5)
    said = ["Led teams", "Wrote Flask code", "pandas and eks", "Python", "wrote in flask", "", None, "É team lead", "Postgres"]
    rows = [(d if d else None, u, rng.choice([1, 2]) if d % 5 == 0 else d % 2 + 1, rng.choice(["SUMMARY", "EXPERIENCE", None]), rng.choice(said)) for d in range(60) for u in range(d % 9)]
    units = spark.createDataFrame(rows, "doc_id long, unit_no int, job_id int, section string, text string")
    words = [(1, 1, "Python"), (1, 2, "leadership"), (1, 3, "team leads"), (1, 4, "PYTHON "), (2, 1, "AWS"), (2, 2, "python"), (2, 3, "wrote"), (2, 4, "É"), (2, 5, "SQL")]
    words = spark.createDataFrame(words, "job_id int, ord int, keyword string")
    every, offered = (lambda few=100_000: sorted(map(str, ev.support(units, words, implied, within=True, few=few).collect()))), (lambda few=100_000: sorted(map(str, ev.offers(units, words, implied, few=few).collect())))
    wanted, taken = every(0), offered(0)
    assert "resume" in str(wanted) and taken
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert every() == wanted and judged == [2 * (len(said) - 1)] * 2
        monkeypatch.setattr(ev, "SENT", 0)
        assert offered() == taken
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
