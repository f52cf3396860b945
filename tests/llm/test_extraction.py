import random
from dataclasses import replace

import numpy as np
import pytest

from galeframe.llm import extraction

FEW = replace(extraction.Settings(), pages=120)
SF = "/root/testdata/sf0.01"


def blocks(page):
    return [n.text for n in extraction.parse(page) if n.text is not None]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a &amp b<p>c<br>d <b>e", ["a & b", "c d e"]),
        ("<div>x &lt; 1 < 2</div><a href='x>y'>l</a>", ["x < 1 < 2", "l"]),
        ("a<b", ["a"]),
        ("a<!-- b", ["a"]),
        ("a<!-- b --><!DOCTYPE x>c", ["ac"]),
        ("<ul><li>1<li>2</ul>t", ["1", "2", "t"]),
        ("<scRipt>x</p></SCRIPT >y&nbsp;\n z", ["y z"]),
        ("<style>x", []),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<p>a</div>b</p></span></p>c", ["ab", "c"]),
        ("", []),
        ("plain", ["plain"]),
        ("<>x</>y", ["<>xy"]),
    ],
)
def test_parse(page, want):
    assert blocks(page) == want


def test_nodes_know_their_parents():
    nodes = extraction.parse('<div class="Main-Text x2" id=top><p>a<a href="/">link</a></p>b</div>')
    assert [(n.tag, n.parent, n.depth) for n in nodes] == [("html", -1, 0), ("div", 0, 1), ("p", 1, 2), ("#text", 2, 3), ("#text", 1, 2)]
    assert nodes[1].tokens == ("main", "text", "x", "top") and (nodes[3].text, nodes[3].links) == ("alink", 4)


def test_decoding_has_no_contradictions():
    """Best of all choices in which parents of chosen nodes are chosen and elements have a chosen child."""
    rng = np.random.default_rng(4)
    pages = ["<div><p>a</p><p>b</p></div><div>c<ul><li>d</li></ul></div><p></p>", "<div><div><p>x</p></div></div>y"]
    for page in pages * 40:
        nodes = extraction.parse(page)
        p = rng.random(len(nodes))
        best = None
        for choice in range(1 << len(nodes)):
            own = [choice >> k & 1 for k in range(len(nodes))]
            if any(own[k] and k and not own[n.parent] for k, n in enumerate(nodes)):
                continue
            if any(own[k] and n.text is None and not any(own[c] for c in n.children) for k, n in enumerate(nodes)):
                continue
            score = sum(np.log(q if o else 1 - q) for o, q in zip(own, p))
            if best is None or score > best[0]:
                best = (score, [k for k, n in enumerate(nodes) if own[k] and n.text is not None])
        assert extraction.decode(nodes, p) == best[1]


def test_trees_lower_the_loss_and_follow_their_arrays():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    trees, base = extraction.boosted(x, y, replace(FEW, trees=15, depth=3))
    p = extraction.Model({}, trees, base).probability(x)
    assert ((p > 0.5) == y).mean() > 0.97


@pytest.fixture(scope="module")
def model(spark):
    return extraction.fit(spark.read.parquet(f"{SF}/pages.parquet"), FEW)


def test_held_out_pages(spark, model):
    """On pages not learned from, the text of the element that says it is the article."""
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("page_id >= 1000")
    got = {r.page_id: r.text for r in extraction.extract(rows, model).collect()}
    wrong = 0
    for r in rows.collect():
        wrong += got[r.page_id] != "\n".join(t for _, t, main in extraction._semantic(r.html) if main)
    assert len(got) == rows.count() and wrong <= 0.01 * len(got)


def test_other_layouts(spark, model):
    """Other elements and names, ambiguous pages without any name among them."""
    told = [b for r in spark.read.parquet(f"{SF}/pages.parquet").collect() if (b := extraction._semantic(r.html))]
    spare = [t for b in told for _, t, main in b if not main] + [t.split(". ")[0] for b in told for _, t, main in b if main]
    found = wanted = right = 0
    for k, own in enumerate(told):
        nodes = extraction.parse(extraction._laid_out([b for b in own if b[2]], spare, random.Random(1000 + k)))
        got = set(extraction.decode(nodes, model.probability(extraction.features([nodes], model.weights))))
        want = {i for i, n in enumerate(nodes) if n.text is not None and n.main}
        found, wanted, right = found + len(got), wanted + len(want), right + len(got & want)
    assert right > 0.95 * found and right > 0.97 * wanted


def test_awkward_pages(spark, model):
    long = "<article>" + "<p>word " * 30_000
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<script>x"), (None, "u", "<article><p>Text here, as it is.</p></article>"), (5, "u", long), (5, "u", long)]
    frame = spark.createDataFrame([(*r, "clash") for r in pages], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.url, r.text) for r in extraction.extract(frame, model).collect()]
    assert {g[0]: g[2] for g in got} == {1: "", 2: "", 3: "", None: "Text here, as it is.", 5: "\n".join(["word"] * 30_000)} and len(got) == 6


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    model = extraction.fit(none)
    assert extraction.extract(none, model).count() == 0 and model.trees == []
    plain = spark.createDataFrame([(1, "u", "<p>a<p>b")], none.schema)
    assert extraction.extract(plain, model).first().text == "a\nb"
