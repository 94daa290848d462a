"""Golden rows for the rules: figures, roles, structure, headings, units."""

import pytest
from pyspark.sql import functions as F

from attest.functions import claims, score
from attest.functions import lexicon as lx
from attest.functions.text import opener, squeeze, word_count, words
from attest.operators import keywords as kw
from attest.operators import lines as ops
from attest.operators import pairs as pair_ops
from attest.operators import units as unit_ops
from attest.plans import registry, review  # noqa: F401
from attest.sources import pages


def value(spark, f, *texts):
    row = spark.createDataFrame([texts], ", ".join(f"c{i} string" for i in range(len(texts)))).select(f(*[F.col(f"c{i}") for i in range(len(texts))]).alias("v"))
    return row.first()["v"]


@pytest.mark.parametrize("text, tokens", [
    ("Cut costs by 30% for 10 users", ["10 users", "30%"]),
    ("Since 2019 grew revenue to $2.5m", ["$2.5m"]),
    ("Worked 2018 - 2020 on it", []),
    ("Wrote 2000 lines by March 2021", ["2000"]),
    ("Raised it by [X%] and 3x", ["3x"]),
    (None, []),
])
def test_claim_tokens(spark, text, tokens):
    assert value(spark, claims.claim_tokens, text) == tokens


def test_new_claims(spark):
    assert value(spark, claims.new_claims, "Led ten people", "Led 10 users and 4 teams") == ["4 teams"]
    assert value(spark, claims.new_claims, "Served 1,000 users", "Served 1000 people") == []


def test_escalation(spark):
    up = value(spark, claims.escalation, "Helped with the release", "Led the release")
    assert (up["from_verb"], up["to_verb"], up["to_tier"]) == ("helped with", "led", "ownership")
    assert value(spark, claims.escalation, "Supported the move I led", "Led the move") is None
    assert value(spark, claims.escalation, "Went there", "Led it") is None


@pytest.mark.parametrize("text, strength", [("Built a tool", 1.0), ("- Building a tool", 1.0), ("Contributed code", 0.5), ("Helped people", 0.0), ("Negotiated terms", 1.0), ("Agreed", 0.0), ("", 0.0)])
def test_verbs(spark, text, strength):
    assert value(spark, score.verb_strength, text) == strength


def test_signals(spark):
    s = value(spark, score.signals, "Built a search service that serves 200 users every single day")
    assert (s["quantified"], s["action_verb"], s["structure"], s["score"]) == (True, 1.0, 1.0, 100)
    assert value(spark, score.is_quantified, "Moved to Python 3 and React 18") is False


@pytest.mark.parametrize("line, section", [
    ("WORK EXPERIENCE", "EXPERIENCE"), ("Skills & Tools", "SKILLS"), ("**Education**", "EDUCATION"), ("S K I L L S", "SKILLS"), ("Selected Publications", "PUBLICATIONS"),
    ("WorkExperience", "EXPERIENCE"), ("Skills: Python", None), ("Head of Research", None), ("Research Assistant", None), ("", None),
])
def test_headings(spark, line, section):
    assert value(spark, ops.match_section, line) == section


def lines(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, line_no int, line string")


def test_sections_fold(spark):
    got = {r["line"]: r["section"] for r in ops.sections(lines(spark, "Ann", "EXPERIENCE", "did it", "Experience", "Technologies: Go", "SKILLS", "Languages: Python", "Interests: Chess", "Education: BSc")).collect()}
    assert got == {"Ann": "HEADER", "did it": "EXPERIENCE", "Experience": "EXPERIENCE", "Technologies: Go": "EXPERIENCE", "Languages: Python": "SKILLS", "Interests: Chess": "SKILLS", "BSc": "EDUCATION"}


def test_units_join_continuations(spark):
    content = ops.sections(lines(spark, "EXPERIENCE", "Engineer, Acme 2019 - 2021", "- Built the search service for many teams", "and kept it running all year.", "Reduced the bill of the whole cluster by a third."))
    got = [(r["text"], r["line_indices"], r["eligible"]) for r in ops.units(content).orderBy("unit_no").collect()]
    assert [g[1] for g in got] == [[0], [1, 2], [3]]
    assert [g[2] for g in got] == [False, True, True]


def test_align_modes(spark):
    requests = spark.createDataFrame([(b, p, f"o{p}") for b in range(4) for p in range(2)], "batch_id int, pos int, original string")
    answers = spark.createDataFrame([(0, 0, None, "a"), (0, 1, None, "b"), (1, 0, 2, "b"), (1, 1, 1, "a"), (2, 0, 0, "a"), (2, 1, None, "b"), (3, 0, 0, "a")], "batch_id int, pos int, idx int, rewritten string")
    got = {(r["batch_id"], r["pos"]): (r["mode"], r["rewritten"]) for r in unit_ops.align(requests, answers).collect()}
    assert got[0, 0] == ("position", "a") and got[1, 0] == ("index", "a") and got[2, 0] == ("partial", None) and got[3, 1] == ("length", None)


def test_align_odd_batches_meet_once(spark):
    """Against a loop: copies of places and indexes, gaps, nothing sent, nothing asked, null batches and places; one shuffle."""
    asked = [(b, p, f"o{b}{p}") for b in range(12) for p in range(3)] + [(0, 1, "again"), (12, None, "nowhere"), (None, 0, "none"), (13, 0, "unanswered")]
    came = {0: [(0, None), (1, None), (1, None), (2, None)], 1: [(0, 1), (1, 1), (2, 2)], 2: [(0, 0), (1, 2), (2, 4)], 3: [(0, 2), (1, 3), (2, 4)], 4: [(0, 3), (1, 2), (2, 1)], 5: [(0, 2), (1, 0), (2, 1)],
            6: [(0, None), (1, 0), (2, 1)], 7: [(0, 0), (1, 1)], 8: [(0, None), (None, None), (7, None)], 9: [(0, 0), (1, 0), (2, 2)], 10: [(0, None), (0, None), (0, None)], 11: [(0, -1), (1, 0), (2, 1)], 12: [(None, None)], None: [(0, None)], 99: [(0, None)]}
    answers = [(b, p, i, None if p == 2 and b == 5 else f"r{b}{p}{i}{k}") for b, rows in came.items() for k, (p, i) in enumerate(rows)]
    out = unit_ops.align(spark.createDataFrame(asked, "batch_id int, pos int, original string"), spark.createDataFrame(answers, "batch_id int, pos long, idx int, rewritten string"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = []
    for b, p, text in asked:
        sent = [a for a in answers if a[0] == b]
        known = [a[2] for a in sent if a[2] is not None]
        n = sum(x == b for x, *_ in asked)
        mode = "length" if len(sent) != n else "position" if not known else "partial" if len(known) < n else "index" if sorted(known) in (list(range(n)), list(range(1, n + 1))) else "not a permutation"
        place = lambda a: a[1] if mode == "position" else a[2] - min(known) if mode == "index" else None  # noqa: E731, B023
        if b is not None:
            want += [(b, p, text, mode, r) for r in [a[3] for a in sent if p is not None and place(a) == p] or [None]]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want)) and {w[3] for w in want} == {"length", "position", "partial", "index", "not a permutation"}


def test_lines_are_moved_once_by_order(spark):
    """rw_align's requests and answers are made of the same numbered lines, which lie by batch already."""
    from attest.plans import review

    plan = review.rw_align(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # one for each side, the same, so that Spark does it once


def test_public_url(spark):
    assert value(spark, pages.public_url, "https://example.org/a") is True
    assert not value(spark, pages.public_url, "https://192.168.0.1/") and not value(spark, pages.public_url, "http://example.org") and not value(spark, pages.public_url, None)


def test_native_plans(spark):
    from attest.plans import history, registry, review, sources, text  # noqa: F401  (they register the queries)

    for name in ("agg_doc_score", "claim_findings", "seg_sections", "kw_freqs", "join_asof"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def _once(df, mark):
    """How often the optimised plan works out ``mark``."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(mark)


def test_confusion_asks_a_detector_once(spark):
    cases = spark.createDataFrame([("a1", True), ("b", True), ("c2", False), (None, False)], "rewritten string, truth boolean")
    said = {"digit": F.soundex("rewritten") == "C000", "long": F.length("rewritten") > 1}
    out = pair_ops.confusion(cases, said, {"digit": F.col("truth"), "long": F.col("truth")})
    assert _once(out, "soundex(") == 1
    assert {r["detector"]: tuple(r)[1:5] for r in out.collect()} == {"digit": (0, 1, 2, 0), "long": (1, 1, 1, 0), "any": (1, 1, 1, 0)}
    assert pair_ops.confusion(cases.limit(0), said, {"digit": F.col("truth"), "long": F.col("truth")}).count() == 0


@pytest.mark.parametrize("text", ["- Led  the\tteam", "Led the team ", "led the team\n", "a) led the team", "É led the team", "Led", "L", "", None, " Led the team", "Led the team"])
def test_opener(spark, text):
    row = spark.createDataFrame([(text,)], "t string")
    plain = squeeze(F.lower(F.regexp_replace(F.trim(F.coalesce("t", F.lit(""))), lx.BULLET, "")))
    assert row.select(opener(F.col("t")) == plain).first()[0]


def test_sections_meet_lines_without_a_join(spark):
    rows = [(1, 0, "Jane Doe"), (1, 1, "Languages: Python"), (1, 2, "WORK"), (1, 3, "HISTORY"), (1, 4, "Built it"), (1, 5, "Skills: Go"), (1, 6, "Skills"), (1, 7, "Languages: Rust"), (2, 0, "Led it")]
    out = ops.sections(spark.createDataFrame(rows, "doc_id long, line_no int, line string"))
    assert _once(out, "Join") == 0
    assert sorted(map(tuple, out.collect())) == [
        (1, 0, "HEADER", "Jane Doe"), (1, 1, "LANGUAGES", "Python"), (1, 4, "EXPERIENCE", "Built it"), (1, 5, "EXPERIENCE", "Skills: Go"), (1, 7, "SKILLS", "Languages: Rust"), (2, 0, "HEADER", "Led it")]


@pytest.mark.parametrize("text", ["", "  ", "one", " two  words\t", "a\nb c", None, "word " * 50_000])
def test_word_count(spark, text):
    row = spark.createDataFrame([(text,)], "t string")
    assert row.select(word_count(F.col("t")), F.size(words(F.col("t")))).first() == (len((text or "").split()),) * 2
    assert row.select(opener(F.col("t"))).first()[0] == " ".join((text or "").split())


def test_units_are_scored_in_one_pass(spark):
    plan = registry.QUERIES["rw_assemble"](spark, "/root/testdata/sf0.001")
    assert _once(plan, "Join ") == 1  # the names of parts; no second copy of the units


def test_strong_is_what_the_signals_say(spark):
    texts = ["Built the API for 12 users, i.e. a service that answers quickly", "Built it for 12 users", "Helped with 3 reports for the whole team this month", "I built the API for 12 users at the new office", "Led nine people", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select(score.strong(F.col("t")), score.is_strong(score.signals(F.col("t")))).collect()
    assert [a for a, _ in found] == [b for _, b in found] and True in [a for a, _ in found]


def test_job_fit_searches_no_list_for_each_keyword(spark):
    texts = spark.createDataFrame([(1, "C++ and go, f#x; SQL sql"), (2, "none")], "doc_id long, text string")
    words_ = spark.createDataFrame([(7, 5, "SQL"), (7, 2, "c++"), (7, 9, "rust"), (7, 3, "—"), (8, 1, "x")], "job_id int, ord int, keyword string")
    fit = kw.job_fit(texts, words_)
    assert _once(fit, "array_contains") == 0
    assert sorted(map(tuple, fit.collect())) == [(1, 7, ["c++", "SQL"], ["—", "rust"], 50), (1, 8, ["x"], [], 100)]


def test_align_refuses_misplaced_answers(spark):
    """Swapped answers are told by their words, whatever their index; a share of 0.3 or of one's own request is no fault."""
    texts = ["Built the payment gateway", "Trained the support team", "Moved logs into Kafka"]
    requests = spark.createDataFrame([(b, p, t) for b in range(4) for p, t in enumerate(texts)], "batch_id int, pos int, original string")
    said = {0: ["Led the payment gateway", "Coached the support team", "Moved all logs"], 1: ["Coached the support team", "Led the payment gateway", "Moved all logs"], 2: ["", None, "that was for the"], 3: ["Built the payment gateway and trained the support team", "Team", "Kafka"]}
    answers = spark.createDataFrame([(b, p, p + 1 if b % 2 else None, t) for b, rows in said.items() for p, t in enumerate(rows)], "batch_id int, pos int, idx int, rewritten string")
    got = {(r["batch_id"], r["pos"]): (r["mode"], r["rewritten"]) for r in unit_ops.align(requests, answers).collect()}
    modes = ["position", "misplaced", "position", "index"]
    assert got == {(b, p): (modes[b], None if b == 1 else t) for b, rows in said.items() for p, t in enumerate(rows)}


def test_coverage_after_accepted_rewrites(spark):
    """Missing keywords that accepted rewrites work in, each once; dismissed and open ones, held and unlisted keywords don't count."""
    keywords = spark.createDataFrame([(0, i, k) for i, k in enumerate(["sql", "c++", "kafka", "go", "aws", "etl", "k8s", "dbt"])], "job_id int, ord int, keyword string")
    texts = spark.createDataFrame([(1, "SQL and C++ in Go"), (2, "none of them")], "doc_id long, text string")
    added = [(1, "a", "kafka"), (1, "b", "kafka"), (1, "a", "sql"), (1, "a", "rust"), (1, "c", "aws"), (1, "d", "etl"), (1, "b", "dbt"), (2, "a", "go")]
    added = spark.createDataFrame([(d, i, 0, k) for d, i, k in added], "doc_id long, item string, job_id int, keyword string")
    decisions = spark.createDataFrame([(1, "a", True), (1, "b", True), (1, "c", False), (1, "d", None), (2, "a", True), (2, "a", True)], "doc_id long, item string, accepted boolean")
    got = kw.coverage_after(kw.frequencies(texts, keywords), keywords, added, decisions)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 3, 2, 38, 63), (2, 0, 0, 1, 0, 13)]
