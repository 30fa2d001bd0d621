"""Main texts of forty written pages in ten layouts, the scan against brute force, and time on nested elements.

Words of the articles are prose; all that must not be returned is marked ``zz``.
"""

import random
import time
from collections import Counter

import pytest

from weftwork.llm import html_main

LINES = (
    "The harbour wall was rebuilt after the storm of that winter.", "Stone for it came from two quarries inland, and the work took nine months.", "Most of the men who built it had never worked by the sea before.", "It still stands, although the town behind it has changed.",
    "Visitors often ask why the wall bends near the lighthouse.", "An old chart gives the answer: a sandbank lay there until it was dredged.", "Fishermen call the bend the elbow.", "Repairs are paid for by a small tax on moorings.", "Nobody has proposed to straighten it.", "The end.",
)


def zz(n):
    return " ".join(["zz"] * n)


def links(n):
    return "".join(f"<li><a href='/{i}'>zz zz</a></li>" for i in range(n))


def prose(n, rng):
    return [rng.choice(LINES[:-1]) for _ in range(n - 1)] + [LINES[-1]]


def blog(v, p):
    comments = [f"<article class='comment' id='comment-{i}'><header><b>zz</b></header><p>{zz(40)}</p></article>" for i in range(2 + 3 * v)]
    if v % 2:
        comments = [f"<li id=c{i}><article><p>{zz(60)}</p></article></li>" for i in range(5)]
    return f"<div id=page class='hfeed site'><header class=site-header><h1>zz zz</h1><nav><ul>{links(5)}</ul></nav></header><main><article class='post type-post status-publish hentry category-news'><header class=entry-header><h1 class=entry-title>Headline here</h1></header><div class=entry-content>{''.join(f'<p>{x}</p>' for x in p)}</div><footer class=entry-footer>{zz(6)} <a>zz</a></footer></article><section id=comments class=comments-area><h2>zz {len(comments)}</h2>{''.join(comments)}<form id=commentform><label>zz</label><textarea>zz</textarea></form></section></main><aside class=widget-area><p>{zz(30)}</p></aside><footer>{zz(12)}</footer></div>"


def news(v, p):
    mid = "<aside class='related'><h3>zz</h3><ul>" + links(4) + "</ul></aside>"
    paragraphs = "".join(f"<p class=body-text>{x}</p>" + (mid if i == 1 else "") for i, x in enumerate(p))
    return f"<div class='cookie-notice'><p>{zz(25)}</p><button>zz</button></div><nav role=navigation>{links(9)}</nav><article><h1>Headline here</h1>{paragraphs}<form class=newsletter><p>{zz(15 + 20 * v)}</p><input></form></article><div class='recommended-stories'><h2>zz zz</h2><p>{zz(50)}</p></div><footer role=contentinfo><p>{zz(20)}</p></footer>"


def wiki(v, p):
    body = "".join(f"<h2>Section {i}</h2><p>{x} <a href=/x>as told elsewhere</a></p>" for i, x in enumerate(p))
    return f"<div id=sidebar class=left><div class=logo>zz</div><p>{zz(30 + 60 * v)}</p><ul>{links(12)}</ul></div><div id=content><h1>Headline here</h1>{body}</div><div id=footer><ul>{links(3)}</ul><p>{zz(10)}</p></div>"


def plain(v, p):
    names = ("content", "story-body", "page-with-sidebar", "x17")[v]
    return f"<div class=menu><ul>{links(6)}</ul></div><div class='{names}'><h1>Headline here</h1>{''.join(f'<p>{x}</p>' for x in p)}</div><div class=sidebar><h3>zz</h3><p>{zz(40)}</p></div><div class='site-footer'>{zz(15)}</div>"


def unclosed(v, p):
    items = "<ul><li>" + "<li>".join(p[1:3]) + "</ul>"
    nav = ("<nav><a>zz</a> <a>zz zz</a>", "<div class=menu><ul>" + links(3) + "</ul>", "<nav><ul><li><a>zz</a><li><a>zz</a></ul>", "<header><p><a>zz zz</a>")[v]
    end = ("<div class=comments><p>" + zz(80), "<section id=comments><p>" + zz(80) + "<p>" + zz(30), "<footer><p>" + zz(9), "</main><footer>" + zz(12))[v]
    return f"{nav}<main><h1>Headline here</h1><p>{p[0]}{items}<p>" + "<p>".join(p[3:]) + end


def wrapped(v, p):
    return f"<form id=aspnetForm action=/x><input type=hidden value='<p>zz</p>'><div class=navbar>{links(7)}</div><div class=body><h1>Headline here</h1>{''.join(f'<p>{x}</p>' for x in p)}</div><div class=login-box><form><p>{zz(12)}</p></form></div><div class='copyright'>{zz(14)}</div></form>"


def tables(v, p):
    return f"<table><tr><td colspan=2 class=banner>{zz(5)}</td></tr><tr><td class=menu><a>zz</a><br><a>zz zz</a></td><td class=content><h1>Headline here</h1>{'<br><br>'.join(p)}</td><td class=ads><p>{zz(20 + 30 * v)}</p></td></tr></table><div class=footer>{zz(8)}</div>"


def roles(v, p):
    return f"<div role=banner>{zz(10)}</div><div role=search><form>{zz(4)}</form></div><div role=navigation><ul>{links(8)}</ul></div><div role=main><h1>Headline here</h1>{''.join(f'<p>{x}</p>' for x in p)}</div><div role=complementary><p>{zz(30 + 100 * v)}</p></div><div role=alertdialog><p>{zz(30)}</p></div>"


def talked(v, p):
    box = ("<div class=comments>", "<section id=comments>", "<div id=disqus_thread class=discussion>", "<ol class=commentlist>")[v]
    return f"<nav>{links(4)}</nav><article><h1>Headline here</h1>{''.join(f'<p>{x}</p>' for x in p[:4])}</article>{box}<div><p>{zz(400)}</p></div></{box[1:].split()[0]}><footer>{zz(9)}</footer>"


def advertised(v, p):
    ad = ("<div class=ad-slot><p>zz zz zz zz zz zz</p></div>", "<span class=advert>zz zz zz</span>", "<div class='sponsored-content'><h4>zz</h4><p>" + zz(20) + "</p></div>", "<ins class=adsense>zz zz</ins>")[v]
    body = "".join(f"<p>{x}</p>{ad if i % 2 else ''}" for i, x in enumerate(p))
    return f"<script>var a = '<p>zz</p>' > 1;</script><style>p:after {{content: 'zz'}}</style><noscript><p>zz zz</p></noscript><div class=topbar>{links(4)}</div><article><h1>Headline here</h1><div class=share-buttons><a>zz</a></div>{body}</article><div class='modal popup'><p>{zz(40)}</p></div><!-- zz --><footer>{zz(6)}</footer>"


LAYOUTS = (blog, news, wiki, plain, unclosed, wrapped, tables, roles, talked, advertised)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_pages_of_a_layout(layout):
    both = got = want = 0
    for v in range(4):
        rng = random.Random(v)
        p = prose(5 + 3 * v, rng)
        html = f"<!DOCTYPE html><html><head><title>zz zz</title></head><body class='home page'>{layout(v, p)}</body></html>"
        text = html_main.main_text(html)
        words = [w for x in (p[:4] if layout is talked else p) for w in x.split()]
        expected = Counter(["Headline", "here", *words])
        if layout is wiki:
            expected += Counter([w for i in range(len(p)) for w in ["Section", str(i), *"as told elsewhere".split()]])
        found = Counter(text.split())
        assert not found["zz"], (layout.__name__, v, text)
        both, got, want = both + sum((expected & found).values()), got + sum(found.values()), want + sum(expected.values())
        lines = text.split("\n")
        assert all(x == " ".join(x.split()) and x for x in lines) and (layout in (tables, talked) or LINES[-1] in text)
    assert both / got == 1.0 and both / want > 0.99, (layout.__name__, both / got, both / want)


@pytest.mark.parametrize("box", ["<div class='comments'>", "<section id='comments'>", "<div class='sidebar'>", "<div class='cookie-notice'>", "<div role='complementary'>", "<div class='advert'>", "<form class='signup'>", "<div class='site-notice notice'>", "<aside>", "<footer>", "<header>", "<nav>"])
@pytest.mark.parametrize("n", [3, 300, 3000])
def test_boilerplate_stays_out_however_long(box, n):
    tag = box[1:].split()[0].rstrip(">")
    body = "<p>" + " ".join(["word"] * 100) + "</p>"
    for around in ("article", "div"):
        for inner in (zz(n), f"<article><p>{zz(n)}</p></article>", f"<div><div><p>{zz(n)}</p></div></div>"):
            for page in (f"<body><{around}>{body}</{around}>{box}{inner}</{tag}></body>", f"<body><{around}>{body}{box}{inner}</{tag}></{around}></body>", f"<body>{box}{inner}</{tag}><{around}>{body}</{around}></body>"):
                if box == "<header>" and f"<{around}>{body}{box}" in page:
                    continue  # a header within an article is the article's
                assert html_main.main_text(page) == " ".join(["word"] * 100), page[:200]


def test_a_page_of_boilerplate_alone_is_empty():
    for box in ("<div class=comments>", "<nav>", "<footer>", "<div class=ad>", "<div class='cookie-notice'>"):
        tag = box[1:].split()[0].rstrip(">")
        assert html_main.main_text(f"<body>{box}<p>{zz(200)}</p></{tag}></body>") == ""


def test_best_run_against_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        scores = [rng.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(rng.randrange(0, 14))]
        first, last = html_main.best_run(scores)
        sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
        best = max([0.0, *sums.values()])
        assert sum(scores[first:last]) == best and (first == last) == (best == 0)


def test_extents_against_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        page = html_main.tokens("".join(rng.choice(["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "x", "<br>"]) for _ in range(rng.randrange(1, 20))))
        until, closed, _ = html_main.extents(page)
        held, want = [], {}
        for i, (end, tag, _) in enumerate(page):
            if tag in (None, "br"):
                continue
            if not end:
                held.append(i)
            elif tag in [page[j][1] for j in held]:
                while held:
                    j = held.pop()
                    want[j] = i, page[j][1] == tag
                    if page[j][1] == tag:
                        break
        for i, (end, tag, _) in enumerate(page):
            if tag not in (None, "br") and not end:
                assert (until[i], closed[i]) == want.get(i, (len(page), False))


@pytest.mark.parametrize("page", ["<div class=sidebar>" * 50_000, "<div class=sidebar>" * 20_000 + "<p>a b</p>" + "</div>" * 20_000, "<div>" * 50_000 + "</p>" * 50_000, "<article>" * 50_000, "<form>" * 20_000 + "<h1>", "<a b='x\" " * 100_000 + ">", "<b c=\"'\" d='" * 50_000, "<title>" * 50_000 + "x", "&" * 500_000, "<textarea>" * 50_000 + ">", "=" * 500_000 + ">", "<a =" * 100_000 + ">"])
def test_time_is_linear(page):
    began = time.time()
    html_main.main_text(page)
    assert time.time() - began < 20


def test_quotes_and_raw_elements():
    main = html_main.main_text
    assert main("<p title='a > b' data-x=\"<i>no</i>\">one two three</p>") == "one two three"
    assert main("<p>it's <a href=o'neil>one</a> two</p><p>isn't three</p>") == "it's one two\nisn't three"
    assert main("<p>a b c <a href='x>d e</a> f</p>") == "a b c d e f"
    assert main("<p>a b c<script>if (x > '</p>') {}</script> d</p><style>p > b</style>") == "a b c d"
    assert main("<p>a b c</p><!-- x > y") == "a b c" and main("<p>a b</p><![CDATA[x]]><?php x ?>") == "a b"
    assert main("<p>a &lt;b&gt; &amp;amp; &eacute;</p>") == "a <b> &amp; é"
