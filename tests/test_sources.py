"""Pages against a tree from an html parser, frames against a split of the whole stream, saved tables, ordered digests."""

import hashlib
import os
import random
from collections import defaultdict
from html.parser import HTMLParser
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from attest.operators import retrieve
from attest.sources import pages, records
from attest.sources.shared import shared_dir


class Tree(HTMLParser):
    """Nodes [name, children]; text is a string."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["", []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, []]
        self.open[-1][1].append(node)
        if tag not in pages.VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1][1].append([tag, []])

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1][1].append(data)


def everything(node):
    return " ".join(x if isinstance(x, str) else everything(x) if x[0] not in ("script", "style") else "" for x in node[1])


def walk(node, out):
    for x in node[1]:
        if isinstance(x, str):
            if x.split():
                out.append(" ".join(x.split()))
            continue
        name, text = x[0], " ".join(everything(x).split())
        if name in pages.SKIPPED:
            continue
        if name == "li":
            out += [f"- {text}"] if text else []
        elif name in pages.HEADINGS:
            out += ["", text.upper() if len(text) < 60 else text, ""] if text else []
        elif name in pages.LINES and not any(not isinstance(c, str) and c[0] in pages.STRUCTURED for c in x[1]):
            if text and pages._reads_like_heading(text):
                out += ["", text.rstrip(":").upper() if len(text) < 60 else text, ""]
            elif text:
                out.append(text)
        else:
            walk(x, out)


def by_tree(page):
    tree, out, kept = Tree(), [], [""]
    tree.feed(page)
    tree.close()
    walk(tree.root, out)
    for line in out:
        if line != kept[-1]:
            kept.append(line)
    return "\n".join(kept).strip()


def test_pages_as_trees(spark):
    rng = random.Random(7)
    tags = ["div", "p", "span", "b", "ul", "li", "h2", "section", "a", "nav", "br", "em", "table", "strong"]
    words = ["Perks:", "one line of text.", "LOUD", "a &amp; b", "Who you are", " ", "x &lt; y", "fish"]

    def page():
        out = []
        for _ in range(rng.randint(0, 40)):
            k = rng.random()
            out.append(rng.choice(words) if k < 0.4 else f'<{rng.choice(tags)} class="a>b">' if k < 0.5 else f"<{rng.choice(tags)}>" if k < 0.72 else f"</{rng.choice(tags)}>" if k < 0.95 else rng.choice(["<!-- <p>no -->", "<script>if (a<b) '</p>'</script>", "<br/>", "<hr>"]))
        return "".join(out)

    rows = [(i, page()) for i in range(400)] + [(1000, None), (1001, ""), (1002, "a < b and 3<4")]
    got = {r["id"]: r["text"] for r in pages.html_text(spark.createDataFrame(rows, "id long, html string"), ["id"]).collect()}
    assert got == {i: by_tree(h) if h else "" for i, h in rows}
    nested = "<div>beside <b>bold</b><ul><li>an <i>item</i><li>open</ul>tail</div></section><div><span>Who you are</span><br>one</div><p>never <b>closed"
    assert pages.page_lines(nested) == "beside\nbold\n- an item open\ntail\n\nWHO YOU ARE ONE\n\nnever closed"


def test_frames_cut_anywhere(spark):
    rng = random.Random(9)
    rows, want = [], set()
    for stream in range(30):
        text = "".join(rng.choice(['data: {"k": 1}', "data: 7", "event: x\n", "\n", "\n\n", "\n\n\n", "data: [1,\ndata: 2]", "data: bad {"]) for _ in range(rng.randint(0, 25)))
        at = 0
        while at < len(text):
            size = rng.choice([0, 1, 1, 2, 3, 9])
            rows.append((stream, len(rows), text[at : at + size]))
            at += size
        for i, frame in enumerate(text.split("\n\n")):
            data = "\n".join(x[5:].strip(" ") for x in frame.split("\n") if x.startswith("data:"))
            if data in ('{"k": 1}', "7", "[1,\n2]"):
                want.add((stream, i, data))
    got = [tuple(r) for r in pages.frames(spark.createDataFrame(rows, "stream_id long, chunk_no long, chunk string").repartition(4)).collect()]
    assert set(got) == want and len(got) == len(want) and want


def test_salvage_takes_nothing_besides(spark):
    rows = [('{"a": 1} - done', '{"a": 1}'), ("1 2", None), ('so: [1, 2] it is', "[1, 2]"), ("<think>{}</think>{", None), ("", None), (None, None), ("7", "7")]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "id int, t string").select("id", pages.salvage_json(F.col("t")).alias("j")).orderBy("id").collect()
    assert [r["j"] for r in got] == [w for _, w in rows]


def test_saving_twice(spark, tmp_path):
    path = str(tmp_path / "saved")
    rows = lambda *r: spark.createDataFrame(r, "analysis_id long, attempt_type string, results string")
    doc = '{"company": "c%d", "jd_keywords": ["a", "b"], "missing_keywords": ["a"]}'
    records.save_analyses(rows((1, "A", doc % 1), (2, "A", doc % 2), (3, "B", doc % 3)), path)
    stamp = {f: os.stat(f).st_mtime_ns for f in tmp_path.glob("saved/attempt_type=B/*.parquet")}
    for _ in range(2):
        records.save_analyses(rows((2, "A", doc % 9), (4, "A", doc % 4)), path)
    got = sorted((r["analysis_id"], r["attempt_type"], r["company"], r["match_pct"]) for r in spark.read.parquet(path).collect())
    assert got == [(1, "A", "c1", 50), (2, "A", "c9", 50), (3, "B", "c3", 50), (4, "A", "c4", 50)]
    assert {f: os.stat(f).st_mtime_ns for f in tmp_path.glob("saved/attempt_type=B/*.parquet")} == stamp  # left alone
    assert records.backfill_saved(spark, path) == 0


def test_references_end_with_a_semicolon():
    """As in the SQL: a text cut inside a reference keeps what is left of it."""
    assert pages.page_lines("<p>a &amp; b&amp</p>") == "a & b&amp"
    assert pages.page_lines("<p>x &lt y &euro;&#65;&#x42; &nosuch; &amp;lt;</p>") == "x &lt y €AB &nosuch; &lt;"


def test_ordered_digests(spark):
    rng = random.Random(2)
    entries = [(s, n, f"text {s} {n}") for s in range(12) for n in rng.sample(range(10_000), 3_000 if s == 5 else 7)] + [(3, 10_001, "one"), (3, 10_001, "two")]
    sets = defaultdict(dict)
    for s, n, t in entries:
        sets[s].setdefault(n, set()).add(hashlib.sha256(t.encode()).hexdigest()[:12])
    digests, conflicts = retrieve.registry(spark.createDataFrame(entries, "set_id long, name long, text string").repartition(5))
    want = {s: hashlib.sha256(",".join(f"{n}:{min(d)}" for n, d in sorted(v.items())).encode()).hexdigest() for s, v in sets.items()}
    assert {r["set_id"]: r["digest"] for r in digests.collect()} == want
    assert [tuple(r) for r in conflicts.collect()] == [(3, 10_001)]
    assert {r["set_id"]: r["names"] for r in digests.collect()} == {s: len(v) for s, v in sets.items()}


def test_shared_folder_of_a_cluster():
    """The folder that is named, else the warehouse if it isn't on a local disk."""
    cluster = lambda **conf: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d)), sparkContext=SimpleNamespace(master="spark://host:7077"))
    assert shared_dir(cluster(spark_checkpoint_dir="file:///shared/x/", spark_sql_warehouse_dir="file:/home/w")) == "file:///shared/x"
    assert shared_dir(cluster(spark_sql_warehouse_dir="hdfs://w/")) == "hdfs://w"
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(cluster(spark_sql_warehouse_dir="file:/home/w"))
