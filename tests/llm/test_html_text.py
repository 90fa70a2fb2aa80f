import itertools
import random
import time

from aeroflow.llm import html_text as H

BODY = "The council met on Tuesday, and after a long debate it agreed to rebuild the old bridge over the river."
MORE = "Work begins in the spring; residents were told that the road would stay open for most of the year."


def page(inner, head=""):
    return f'<!DOCTYPE html><html lang="en"><head><title>T &amp; t</title><style>p{{margin:0}}</style><script>var t="</p>";</script>{head}</head><body>{inner}</body></html>'


def test_the_template():
    text = page(f'<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad 0 --><div class="ad">Buy now, friends. A long advert text that goes on, and on.</div><article><h1>Bridge &lt;news&gt;</h1><p><b>{BODY}<br><p>{MORE}\n  &amp;c.</p><p>No.</p></article><footer>&copy; site &middot; All rights reserved.</footer>')
    assert H.main_text(text) == f"Bridge <news> {BODY} {MORE} &c. No."
    assert H.main_text(text[: text.index("</article>")]) == f"Bridge <news> {BODY} {MORE} &c. No."


def test_other_boilerplate():
    parts = [
        f"<header><h2>Site name</h2><p>{MORE}</p></header>",
        f'<div id="cookie-notice"><p>{MORE}</p></div>',
        f"<main><h1>Title here</h1><p>{BODY}</p><aside><p>{MORE} aside</p></aside><p>{MORE}</p><form><p>Sign up here, please.</p><input><button>Go</button></form></main>",
        f'<section class="user-comments"><p>{BODY} I think.</p><p>{MORE} Me too.</p></section>',
        f'<div class="sidebar"><ul><li><a href="x">{BODY}</a></li></ul></div>',
        f"<noscript>{BODY}</noscript>",
        f'<ol class="commentlist"><li>{BODY}</li></ol>',
        "<div>&copy; 2024 Site. All rights reserved.</div>",
    ]
    assert H.main_text(page("".join(parts))) == f"Title here {BODY} {MORE}"


def test_plain_divs_without_an_article():
    inner = '<div class="menu"><a href="1">One</a> <a href="2">Two</a></div>' + "".join(f"<div>{BODY} {i}</div>" for i in range(4)) + '<div><a href="3">Imprint</a></div>'
    assert H.main_text(page(inner)) == " ".join(f"{BODY} {i}" for i in range(4))


def test_odd_input():
    assert H.main_text(None) == H.main_text("") == H.main_text("<p>") == ""
    assert H.main_text("<script>x") == ""
    assert isinstance(H.main_text("<" * 5000 + BODY), str)
    assert H.main_text(f"<article><p>{BODY}</p></article>" * 3) == " ".join([BODY] * 3)
    long = page("<article>" + f"<p>{BODY}</p>" * 3000 + "</article>")
    assert H.main_text(long) == " ".join([BODY] * 3000)


def test_truncated_tags_and_deep_trees():
    inner = f"<article><p>{BODY}</p>"
    for tail in ('<p title="abc', "<p title='a > b", "<p class=", "</artic", "<!-- x", '<img alt="x" src="'):
        assert H.main_text(page(inner)[: -len("</body></html>")] + tail) == BODY
    began = time.process_time()
    assert H.main_text("<div>x" * 40_000) is not None
    assert H.main_text(f"<article><p>{BODY}</p>" + "<div>" * 40_000 + "</b></i></span></section>" * 2000) == BODY
    assert time.process_time() - began < 10


def test_words_of_page_wide_wrappers_say_nothing():
    article = f"<article><h1>Bridge news here</h1><p>{BODY}</p><p>{MORE}</p></article>"
    for before, after in (('<form action="/">', "</form>"), ('<div class="header-fixed">', "</div>"), ('<div class="sidebar-right comments-open">', "</div>")):
        text = f'<body class="single no-sidebar comments-open">{before}<nav><a href="/">Home</a></nav>{article}<div class="comments"><p>Nice one, really.</p></div>{after}</body>'
        assert H.main_text(text) == f"Bridge news here {BODY} {MORE}"


def test_controls_take_nothing_else_along():
    ok = f"{BODY} {MORE}"
    for inner in (
        f"<p>{BODY}</p><datalist><option value=a>A<option value=b>B</datalist><p>{MORE}</p>",
        f"<p>{BODY}</p><select><option>One<option>Two<p>{MORE}</p>",
        f"<p>{BODY}</p><button>Menu<p>{MORE}</p>",
        f"<p>{BODY}</p><button>Menu<p>{MORE}</p><button>Close</button>",
        f"<p>{BODY}</p><button type=button><div>Menu</div><div>Open</div></button><p>{MORE}</p>",
        f"<p>{BODY} <button>Copy</button> {MORE}</p>",
        f"<p>{BODY}</p><option>stray<p>{MORE}</p></option>",
        f"<p>{BODY}</p></button></select><p>{MORE}</p>",
    ):
        assert H.main_text(page(f"<article>{inner}</article>")) == ok, inner


def test_optional_end_tags():
    for inner, want in (
        (f"<ul><li>{BODY}<li>{MORE}</ul>", f"{BODY} {MORE}"),
        (f"<dl><dt>{BODY}<dd>{MORE}</dl>", f"{BODY} {MORE}"),
        (f"<table><tr><td>{BODY}<td>{MORE}<tr><td>{BODY}</table>", f"{BODY} {MORE} {BODY}"),
        (f"<p>{BODY}<p>{MORE}<h2>Then and now</h2>{BODY}", f"{BODY} {MORE} Then and now {BODY}"),
    ):
        assert H.main_text(page(f"<article>{inner}</article>")) == want, inner


def test_a_block_of_links_is_no_content():
    links = "".join(f'<a href="/{i}">Page number {i}, read it</a> ' for i in range(2000))
    assert H.main_text(page(f"<p>{links}</p><main><h1>Title here</h1><p>{BODY}</p><p>{MORE}</p></main>")) == f"Title here {BODY} {MORE}"
    assert H.main_text(page(f"<p>{links}</p>")) == ""


#: Pages as sites write them, each block marked by hand: true if it is main text.
HAND_LABELLED = [
    [("<div class='topbar'>{}</div>", "Call us today for a quote", False), ("<h1>{}</h1>", "How bridges age", True), ("<div class='post-body'><p>{}</p>", BODY, True), ("<p>{}</p></div>", MORE, True), ("<div class='share-buttons'>{}</div>", "Share this on every site", False), ("<div id='comments'><p>{}</p></div>", BODY + " I agree.", False)],
    [("<nav><a href='/'>{}</a></nav>", "Home", False), ("<main><p>{}</p>", BODY, True), ("<ul><li>{}</li>", "First, check the bolts of the deck.", True), ("<li>{}</li></ul>", "Then, check the cables.", True), ("<blockquote>{}</blockquote></main>", MORE, True), ("<footer>{}</footer>", "Contact and imprint", False)],
    [("<aside class='promo'>{}</aside>", MORE, False), ("<article><header><h1>{}</h1></header>", "Old bridge, new road", True), ("<p>{}</p>", BODY, True), ("<figure><figcaption>{}</figcaption></figure>", "The bridge in 1920, seen from the south.", True), ("<p>{}</p></article>", MORE, True), ("<div class='related'><a href='/x'>{}</a></div>", "Ten more bridges to see", False)],
]


def test_hand_labelled_pages():
    for blocks in HAND_LABELLED:
        text = page("".join(tag.format(words) for tag, words, _ in blocks))
        assert H.main_text(text) == " ".join(words for _, words, main in blocks if main)


def test_labels_of_pages_are_the_cheapest():
    """What a page yields is the labelling of least cost of all there are."""
    rng = random.Random(8)
    tags = ["<p>{}</p>", "<div>{}</div>", "<nav>{}</nav>", "<li>{}</li>", "<h2>{}</h2>", "<div class='sidebar'>{}</div>", "<article><p>{}</p></article>", "<a href='/'>{}</a><br>", "<div class='comment'><p>{}</p></div>"]
    for _ in range(40):
        found = H.blocks(page("".join(rng.choice(tags).format(" ".join(rng.choice(["one", "two,", "three."]) for _ in range(rng.randrange(1, 40)))) for _ in range(rng.randrange(1, 9)))))
        costs, others = ([max(0.0, k * H.content_score(b)) for b in found] for k in (1, -1))
        edges = [(i, j, H.smoothness(found[i], found[j], j - i)) for j in range(len(found)) for i in range(max(0, j - H.REACH), j)]
        cost = lambda labels: sum(others[i] if x else costs[i] for i, x in enumerate(labels)) + sum(w for a, b, w in edges if labels[a] != labels[b])  # noqa: B023, E731
        best = min(map(cost, itertools.product([False, True], repeat=len(found))))
        labels = H.labels(found)
        assert len(labels) == len(found) and cost(labels) <= best + 1e-6


def test_formulas_stay():
    assert H.main_text(page(f"<article><p>{BODY} <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p></article>")) == f"{BODY} x=1"


def test_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randrange(1, 9)
        content = [round(max(0, rng.gauss(0, 2)), 3) for _ in range(n)]
        other = [round(max(0, rng.gauss(0, 2)), 3) for _ in range(n)]
        edges = [(i, j, round(rng.random(), 3)) for i in range(n) for j in range(i + 1, min(n, i + 3))]

        def cost(labels):
            return sum(other[i] if x else content[i] for i, x in enumerate(labels)) + sum(w for a, b, w in edges if labels[a] != labels[b])

        got = cost(H.minimum_cut(content, other, edges))
        assert abs(got - min(cost(x) for x in itertools.product([False, True], repeat=n))) < 1e-6


def test_rows(spark):
    rows = [(1, "u", page(f"<article><p>{BODY}</p></article>"), "x", 9), (1, "u", None, "x", 9), (None, None, "", "x", 9)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", BODY, len(BODY)), (1, "u", "", 0), (None, None, "", 0)], key=str)
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
