"""Page columns and selectors against the tree of the whole page."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftwork.functions import pages, selectors
from weftwork.functions.pages import UNREAD, Node, Tree, clean, parse

PIECES = [
    "plain words", "a &amp; b", "&eacute;t&eacute; &mdash; &#39;x&#39; &#x41; &nbsp;y &lt;b&gt; &amp;lt; &bogus; &copy 5", "<p>para", "</p>", "<p class='x y' id=\"one\">p <b>bold</b> <i>it</i></p>", "<h1>Head <em>line</em></h1>", "<h2 class=a>two<b>b</b></h2>",
    "<h3>open", "</h3>", "<h1><h2>in</h2></h1>", "<b><h1>a</b>x", "<ul><li>one<li>two</ul>", "<ol><li>a<ul><li>b</li></ul></li></ol>", "<!-- said -->", "<!-- <p>no</p> -->", "<!-->", "<script>var a = '<h1>x</h1>' && b;</script>", "<style>p > b {}</style>",
    "<noscript>never <b>read</b></noscript>", "<template><p>hid</p></template>", "<textarea><p>raw</p></textarea>", "<a href='x>y'>quote</a>", "<a href=x title=\"a > b\">t</a>", "<img alt=\"pic\" src=/i.png>", "<br/>", "1 < 2", "x > y", "</div>", "<div>", "<body>", "</body>",
    "<body class=z>", "</html>", "<table><tr><th>H<td>d<tr><td>e</table>", "<title>second</title>", "<meta name=description content='d &amp; e'>", "<META NAME='Description' CONTENT=\"other\">", "</head>", "<svg><title>s</title></svg>", "<span>", "</span>", "   \x1c", "<![CDATA[x]]>", "<?php a ?>",
]


def _awkward(rng):
    head = rng.choice(["<head><title>A  title &amp; more</title></head>", "<head><meta name=\"description\" content=\" The  page \"><title>T</title>", "<title>T<b></title>", "", "<head><title>open"])
    body = "".join(rng.choices(PIECES, k=rng.randrange(0, 7)))
    begin, end = rng.choice([("<html>", "</html>"), ("<!DOCTYPE html><html>", ""), ("", "")])
    return begin + head + rng.choice([f"<body>{body}</body>", f"<body id=b>{body}", body, f"<body>{body}</body> after"]) + end


def test_page_heads_are_the_parsers(spark):
    rng = random.Random(11)
    made = ["", None, " ", "<", "&", "<body>", "x" * 50_000] + [_awkward(rng) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(made)), "id int, html string").repartition(8).select("id", pages.page_heads(F.col("html")).alias("p"), pages.is_plain(F.coalesce("html", F.lit(""))).alias("plain"))
    plain = 0
    for r in rows.collect():
        want = parse(made[r.id], None)
        got = (r.p.title, r.p.text, r.p.description, [(h.level, h.text) for h in r.p.headings])
        assert got == (want["title"], want["text"], want["metadata"]["description"], [(h["level"], h["text"]) for h in want["headings"]]), (made[r.id], r.plain)
        plain += r.plain
    assert plain > 60


def test_plain_pages_need_no_python(spark):
    heads = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(pages.is_plain(F.col("html")).alias("plain"))
    assert heads.where("not plain").isEmpty()


def _matches(node, parents, before, compound):
    """One compound by brute force: (tag, id, classes, has attribute, place)."""
    tag, id_, classes, attribute, place = compound
    return (
        (tag is None or node.tag == tag)
        and (id_ is None or node.attrs.get("id") == id_)
        and all(c in node.attrs.get("class", "").split() for c in classes)
        and (attribute is None or attribute in node.attrs)
        and (place is None or len(before) + 1 == place)
    )


def _ends(node, parents, before, steps):
    """Whether a chain of (combinator, compound) ends at a node; parents is a list of (node, elements before it)."""
    combinator, compound = steps[-1]
    if not _matches(node, parents, before, compound):
        return False
    rest = steps[:-1]
    if not rest:
        return True
    above = [(p, parents[:i], b) for i, (p, b) in enumerate(parents)]
    beside = [(s, parents, before[:i]) for i, s in enumerate(before)]
    pool = {">": above[-1:], " ": above, "+": beside[-1:], "~": beside}[combinator]
    return any(_ends(*x, rest) for x in pool)


def _first(root, steps):
    stack = [(root, [], [])]
    while stack:
        node, parents, before = stack.pop()
        if node.tag and _ends(node, parents, before, steps):
            return " ".join(y for parent, x in node.strings() if parent not in UNREAD and (y := clean(x)))
        children = [x for x in node.children if isinstance(x, Node)]
        below = [*parents, (node, before)] if node.tag else []
        stack.extend((x, below, children[:i]) for i, x in reversed(list(enumerate(children))))
    return ""


def test_selectors_against_brute_force():
    rng = random.Random(4)
    tags, names = ["div", "p", "ul", "li", "b", "span"], ["a", "b", "c"]

    def page(depth=0):
        out = ""
        for _ in range(rng.randrange(1, 4)):
            tag = rng.choice(tags)
            attributes = rng.choice(["", f" class='{rng.choice(names)} {rng.choice(names)}'", f" id={rng.choice(names)}", " data-x"])
            out += f"<{tag}{attributes}>{rng.choice(['w', 'x y', ''])}{page(depth + 1) if depth < 4 else ''}" + rng.choice([f"</{tag}>"] * 5 + [""])
        return out

    def compound():
        tag, id_ = rng.choice([None, *tags]), rng.choice([None, None, None, *names])
        classes = rng.sample(names, rng.choice([0, 0, 1, 2]))
        attribute, place = rng.choice([None, None, "data-x"]), rng.choice([None, None, 1, 2])
        text = (tag or "") + (f"#{id_}" if id_ else "") + "".join(f".{c}" for c in classes) + (f"[{attribute}]" if attribute else "") + (f":nth-child({place})" if place else "")
        return (tag, id_, classes, attribute, place), text or "*"

    found = 0
    for _ in range(1500):
        html = page()
        steps, text = [], ""
        for i in range(rng.randrange(1, 4)):
            made, part = compound()
            combinator = rng.choice([" ", ">", "+", "~"]) if i else None
            steps.append((combinator, made))
            text += (f" {combinator} " if i else "") + part
        want = _first(Tree(html).root, steps)
        got = selectors.Picked(html, selectors.compiled([text, "b, p"])).texts
        assert (got[0] or "") == want, (html, text)
        assert (got[1] or "") == _first_of(html, ("b", "p"))
        found += want != ""
    assert found > 150


def _first_of(html, tags):
    node = next((x for x in Tree(html).root.walk() if x.tag in tags), None)
    return "" if node is None else " ".join(y for parent, x in node.strings() if parent not in UNREAD and (y := clean(x)))


@pytest.mark.parametrize("text", ["", "div[", "div >", "> p", "p,,b", "p:last-child", "p:has(b)", "a:nth-child(x)", "p:first-child(2)", "#", ".", "p..a", "[=x]", "p & b", ",p"])
def test_selectors_that_are_not_valid(text):
    assert selectors.compiled([text]) == [None]
    assert selectors.Picked("<p>x</p>", selectors.compiled([text])).texts == [None]


def test_selectors_of_all_kinds():
    html = "<html><body><div class='md:flex Big' id='x.y' lang=en-GB data-K='Abc def'>one<p>two</p><!-- c --><script>no</script><p>three</p><p class=z>four</p></div><p>five</p></body></html>"
    pick = lambda *texts: selectors.Picked(html, selectors.compiled(texts)).texts
    whole = "one two c three four"
    assert pick(r".md\:flex", r"#x\.y", "[lang|=en]", "[data-k~=def]", "[data-k^='Ab']", "[data-k$=DEF i]", "[data-k*='c d']", "DIV", "*:not(html, body)", ":is(div, p)") == [whole] * 10
    assert pick("p:nth-child(2n+1)", "p:nth-of-type(odd)", "div p:nth-child(-n+2)", "div > p ~ p", "p + p + p", "body > p:not(.z)", "p.z, div", ".none", "p:nth-child(3n)", ":root > body > :first-of-type") == ["two", "two", "two", "three", None, "five", whole, None, "three", whole]


def test_selected_texts_of_a_table(spark):
    rows = spark.createDataFrame([(1, "<p>a</p>"), (2, None), (3, "")], "id int, html string").select("id", selectors.selected_texts(F.col("html"), ["p", "div[", "b"]).alias("t"))
    assert {r.id: r.t for r in rows.collect()} == {1: ["a", "", ""], 2: ["", "", ""], 3: ["", "", ""]}


def test_pages_of_a_batch_are_parsed_some_at_a_time():
    lengths = []

    def make(values, more):
        lengths.append(len(values))
        return [f"{a}{b}" for a, b in zip(values, more)]

    columns = [pa.array([str(i) for i in range(1000)]), pa.array([None, "x"] * 500)]
    whole = pages.in_slices(make, pa.string(), *columns)
    assert whole.to_pylist() == [f"{a}{b}" for a, b in zip(*(c.to_pylist() for c in columns))]
    assert max(lengths) == pages.TOGETHER and sum(lengths) == 1000
    assert pages.in_slices(make, pa.string(), *(c.slice(0, 0) for c in columns)).to_pylist() == []
