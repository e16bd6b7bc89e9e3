"""Main texts against a slow version that works on the pages' trees and never sees their HTML."""

import math
import random
import time
from collections import defaultdict

import pytest

from tesserae.llm import html_text

# A tree is (tag, classes, children); a child is a tree or a block (text, in a link, first heading).


def render(tree):
    tag, classes, children = tree
    inner = []
    for c in children:
        if len(c[1:]) == 2 and isinstance(c[1], bool):
            body = f"<a href='/x'>{c[0]}</a>" if c[1] else c[0]
            inner.append(f"<h1>{body}</h1>" if c[2] else f"<p>{body}</p>")
        else:
            inner.append(render(c))
    return f"<{tag} class='{' '.join(classes)}'>{''.join(inner)}</{tag}>" if classes else f"<{tag}>{''.join(inner)}</{tag}>"


def is_block(c):
    return isinstance(c[1], bool)


def dropped(tree):
    return tree[0] in ("nav", "footer", "aside") or "sidebar" in tree[1]


def blocks(tree):
    return [b for c in tree[2] for b in ([c] if is_block(c) else [] if dropped(c) else blocks(c))]


def kinds(tree):
    """Kinds of the trees below that have text."""
    return [k for c in tree[2] if not is_block(c) and not dropped(c) and blocks(c) for k in [kind(c), *kinds(c)]]


def kind(tree):
    return 3 if tree[0] == "article" else 2 if tree[0] == "main" else 1 if {"content", "post"} & set(tree[1]) else 0


def slow_regions(tree, path=()):
    kids = [c for c in tree[2] if not is_block(c) and not dropped(c) and blocks(c)]
    own = any(not b[1] for b in tree[2] if is_block(b))
    if kind(tree) == 3 or own or not kids or kind(tree) > max(kinds(tree), default=0):
        return [(path, tree)]
    out = []
    for c in kids:
        out += slow_regions(c, (*path, ".".join([c[0], *sorted("".join("#" if x.isdigit() else x for x in w) for w in c[1])])))
    return out


def score(tree):
    return sum(len(t) * ((not linked) + 1e-3) for t, linked, _ in blocks(tree))


def slow_texts(pages):
    """(host, tree) -> text of each."""
    shares, cut = defaultdict(list), []
    for host, tree in pages:
        found = slow_regions(tree) if blocks(tree) else []
        by = defaultdict(float)
        for path, r in found:
            by[path] += score(r) / sum(score(x) for _, x in found)
        for path, share in by.items():
            shares[host, path].append(share)
        cut.append((host, found, by))
    out = []
    for host, found, by in cut:
        mean = {p: sum(shares[host, p]) / len(shares[host, p]) for p in by}
        best, top = None, -1.0
        for path, r in found:
            worth = mean[path] * math.sqrt(by[path]) * (2 if kind(r) >= 2 else 1)
            if worth > top * (1 + 1e-12):
                best, top = (path, r), worth
        kept, seen = [], False
        for path, r in found:
            mine, beside = path == best[0], path[:-1] == best[0][:-1]
            seen |= mine
            headed = any(b[2] for p, x in found if p == best[0] for b in blocks(x))
            prose = 2 * sum(len(t) for t, linked, _ in blocks(r) if not linked) > sum(len(t) for t, *_ in blocks(r))
            if mine or beside and (not headed and not seen and any(b[2] for b in blocks(r)) or kind(best[1]) < 3 and prose and mean[path] >= mean[best[0]] / 4 and math.sqrt(mean[path] * by[path]) >= 0.25 * math.sqrt(mean[best[0]] * by[best[0]])):
                kept += [t for t, *_ in blocks(r)]
        out.append("\n\n".join(kept))
    return out


def random_site(rng):
    """A few layouts of one host; a layout is a function to a tree."""
    words = lambda a, b: " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(rng.randrange(a, b)))
    para = lambda: (words(5, 60), False, False)
    title, link = lambda: (words(2, 8), False, True), lambda: (words(1, 9), True, False)
    story = lambda: [title(), *[para() for _ in range(rng.randrange(1, 5))]]
    nav = ("nav", (), [link(), link()])
    name = rng.choice(["text", "body-7", "col", "entry"])
    return [
        lambda: ("body", (), [nav, ("article", (), [title(), ("div", (name,), [para(), para()]), ("section", (), [para()]), para()]), ("footer", (), [para()])]),
        lambda: ("body", (), [("main", (), [para(), ("div", (name,), story()), para()]), ("div", ("sidebar",), [para()])]),
        lambda: ("body", (), [nav, ("div", ("wrap",), [("div", ("head",), [title()]), ("div", (name,), [para() for _ in range(rng.randrange(1, 6))]), ("div", ("more",), [link(), (words(1, 12), False, False)])])]),
        lambda: ("body", (), [("div", (f"p{rng.randrange(9)}", "post"), story()), ("div", ("right",), [para()] * rng.randrange(0, 2) + [link()]), ("div", ("links",), [link() for _ in range(5)])]),
        lambda: ("body", (), [("main", (), [("article", ("post",), story()), ("section", ("cards",), [("article", ("card",), [para()]), ("article", ("card",), [link()])])])]),
        lambda: ("body", (), [("div", ("content",), [("section", (), story()), ("section", (), [para()]), ("div", (name,), [para()])]), para() if rng.random() < 0.2 else nav]),
        lambda: ("body", (), [nav, ("div", (name,), [link(), link()])]),
        lambda: ("body", (), [nav, ("div", ("empty",), [])]),
    ]


def test_many_layouts_against_trees(spark):
    rng = random.Random(12)
    pages = []
    for h in range(8):
        layouts = rng.sample(random_site(rng), 5)
        weights = [rng.choice([1, 2, 20]) for _ in layouts]
        pages += [(f"h{h}.example", rng.choices(layouts, weights)[0]()) for _ in range(40)]
    df = spark.createDataFrame([(i, f"http://{h}/{i}", f"<!DOCTYPE html><html><head><title>t</title></head>{render(t)}</html>") for i, (h, t) in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.main_texts(df.repartition(5)).collect()}
    want = slow_texts(pages)
    assert len(got) == len(pages) and sum(not t for t in want) > 3
    for i, text in enumerate(want):
        assert got[i]["text"] == text and got[i]["n_chars"] == len(text), render(pages[i][1])


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><h1>Title</h1><div class=body>long text of it</div></article>", "Title\n\nlong text of it"),
        ("<article><section>intro</section><section>a long section of words</section>closing words</article>", "intro\n\na long section of words\n\nclosing words"),
        ("<main><p>lead</p><div>the text itself is here</div><p>last</p></main>", "lead\n\nthe text itself is here\n\nlast"),
        ("<article><p class='market-share'>share of it</p><p class=ad>buy</p><div class='social-share'>s</div></article>", "share of it"),
        ("<article><div class='share-bar'>s</div><div class='post-comments'>c</div><div class='site-header'>h</div><p>One <button>b</button> two</p></article>", "One two"),
        ("<div class=wrap><div class=top-box><h1>Title</h1></div><div class=text>some text that is long enough</div></div>", "Title\n\nsome text that is long enough"),
        ("<p title=it's>one</p><p title='a > b' class=x>two</p>1 < 2 &amp; 3<a href=\"unclosed>zz", "one\n\ntwo\n\n1 < 2 & 3"),
        ("<table><tr><td><p>a</b><td>b</table>c", "a\n\nb\n\nc"),
        ("<article>a&nbsp;&eacute;&#x41;\n\n b</article>", "a éA b"),
    ],
)
def test_nothing_of_the_article_is_lost(page, text):
    assert html_text.extract(page)[0] == text


_PROSE = "A sentence of the article with some words in it. " * 7


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><h1 class='header'>Title</h1><p>{}</p></article>", "Title\n\n{}"),
        ("<article><h2 class='header'>Title</h2><p>{}</p></article>", "Title\n\n{}"),
        ("<article><div class='header'><h1>Title</h1></div><p>{}</p></article>", "Title\n\n{}"),
        ("<article><h1>Baking</h1><section id='cookies'><p>{}</p></section></article>", "Baking\n\n{}"),
        ("<article><h1>Baking</h1><section id='cakes'><h2>Cakes</h2><p>{}</p></section><section id='cookies'><h2>Cookies</h2><p>{}</p></section></article>", "Baking\n\nCakes\n\n{}\n\nCookies\n\n{}"),
        ("<div class='form-and-function'><h1>Design</h1><p>{}</p></div>", "Design\n\n{}"),
        ("<body><main><form id='aspnetForm' action='x'><input type=hidden><h1>T</h1><p>{}</p><button>Go</button></form></main></body>", "T\n\n{}"),
        ("<body><form method=post><nav>m</nav><article><p>{}</p></article></form></body>", "{}"),
        ("<article><p>{}</p><div class='share-price'>It closed at 12.</div><p class='form'>On form.</p></article>", "{}\n\nIt closed at 12.\n\nOn form."),
        ("<article><p>The <span class='menu'>dinner</span> card. {}</p></article>", "The dinner card. {}"),
        ("<article><p>{}</p><section class='responses'><h3>Responses</h3><p>First, says one.</p><p>Second, says two.</p></section></article>", "{}"),
        ("<article><p>{}</p><div id='discussion'><p>I do not agree with any of it.</p></div></article>", "{}"),
        ("<article><p>{}</p><section id='discussion'><h2>Discussion of results</h2><p>{}</p></section></article>", "{}\n\nDiscussion of results\n\n{}"),
        ("<article><div class='flash'>Your settings were saved.</div><p>{}</p></article>", "{}"),
        ("<article><p>{}</p><div class='more-stories'><a href=1>Another story of the day</a><a href=2>And one more of it</a></div></article>", "{}"),
        ("<article><p>{}</p><div class='cookie-notice'><p>We use cookies. By going on you agree to that, as it says in our policy, which you may read.</p></div></article>", "{}"),
        ("<article><p>{}</p><form action=x><label>Name</label><input><p>Write to us</p></form><div class='comments'><p>{}</p></div></article>", "{}"),
        ("<body><div class='related-posts'><p>{}</p></div><article><p>{}</p><p>{}</p></article></body>", "{}\n\n{}"),
    ],
)
def test_text_outweighs_names(page, text):
    assert html_text.extract(page.replace("{}", _PROSE))[0] == text.replace("{}", _PROSE.strip())


def test_a_sidebar_on_the_winning_path_does_not_beat_another_layout(spark):
    usual = "<body><div class=text><p>{}</p></div></body>".format("words of an article " * 20)
    other = "<body><div class=story><p>{}</p></div><div class=text><p>short note</p></div></body>".format("another story told " * 30)
    df = spark.createDataFrame([(i, "http://a.example/", usual if i else other) for i in range(30)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(df).collect()}
    assert got[0].startswith("another story") and "short note" not in got[0] and all(got[i].startswith("words of") for i in range(1, 30))


@pytest.mark.parametrize("unit", ["<div>", "<a ", '<a b="', "<span></b>", "<!-- ", "<script>", "< ", "<div class='a b1'>t", "<table><tr><td>x", "&", "<p>x<b>", "<td></span></b>"])
def test_time_grows_with_the_length_only(unit):
    def took(n):
        page, began = "<article>" + "<span><b>" * 5000 + unit * (n // len(unit)), time.process_time()
        html_text.extract(page)
        return time.process_time() - began

    took(10_000)
    assert took(1_000_000) < 30 * (took(100_000) + 0.05)


def test_deep_and_long_pages(spark):
    deep = "<div>" * 100_000 + "found" + "</div>" * 100_000
    long = "<article>" + "<p>some words here</p>" * 50_000 + "</article>"
    df = spark.createDataFrame([(1, "http://a.example/", deep), (2, "http://a.example/", long), (3, None, "x" * 1_000_000), (None, "u", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.main_texts(df).collect()}
    assert got[1]["text"] == "found" and len(got[1]["path"]) < 200 and got[2]["n_chars"] == 50_000 * 17 - 2 and got[3]["n_chars"] == 1_000_000 and got[None]["text"] == ""
