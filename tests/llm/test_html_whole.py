"""Nested layouts and ordinary html whose articles were lost."""

import html
import math
import random
import time

from pyspark.sql import functions as F

from tracemill.llm import html_text

f = html_text.main_blocks
A, B, C, H = "word " * 99 + "one", "word " * 99 + "two", "word " * 99 + "three", "A title of some sixty characters, as titles of articles have"
BODY = f"<p>{A}</p><p>{B}</p><p>{C}</p>"


def test_inner_containers_keep_the_rest_of_the_article():
    assert f(f"<article><h1>{H}</h1><div>{BODY}</div></article>") == [H, A, B, C]
    assert f(f"<body><div><h1>{H}</h1><div>{BODY}</div></div></body>") == [H, A, B, C]
    short = "<section><h2>More</h2><p>Short.</p><ul><li>one</li><li>two</li></ul></section>"
    for top in ("article", "main", "div"):
        assert f(f"<body><{top}><section>{BODY}</section>{short}</{top}></body>") == [A, B, C, "More", "Short.", "one", "two"]
    assert f(f"<main><h1>{H}</h1><article><div>{BODY}</div></article></main>") == [H, A, B, C]


def test_bare_text_beside_the_core_stays():
    assert f(f"<article>Bare <i>words</i> first<div>{BODY}</div>last ones</article>") == ["Bare words first", A, B, C, "last ones"]
    assert f(f"<body><div>Bare, see <a href=x>here</a>, first<div>{BODY}</div></div></body>") == ["Bare, see here, first", A, B, C]


def test_menus_beside_the_core_still_go():
    links = "<ul>" + "<li><a href=x>menu</a>" * 5 + "</ul>"
    assert f(f"<body><div>{links}<div>{BODY}</div><a href=x>home</a> | <a href=x>top</a></div></body>") == [A, B, C]
    assert f(f"<body><div><p>outside</p></div><article><div>{BODY}</div></article></body>") == [A, B, C]


def test_body_ends_an_open_head():
    for start in ("<html><head><meta charset=utf-8><title>t</title><body>", "<head><link rel=x href=y>", "<!DOCTYPE html><head><title>t</title></head><body class=x>", "<head>\n<style>p{}</style>\n<body>"):
        assert f(f"{start}<article><h1>{H}</h1>{BODY}</article>") == [H, A, B, C], start
    assert f("<html><head><title>t</title>Plain text of a page") == ["Plain text of a page"]


def test_marks_inside_names_do_not_drop_the_article():
    for name in ("content has-sidebar", "post tags-news", "page header-fixed", "no-comments"):
        assert f(f'<body><nav><a href=x>menu</a></nav><div class="{name}"><h1>{H}</h1>{BODY}</div></body>') == [H, A, B, C], name
    posts = "".join(f'<div class="post tags-news"><p>{x} {k}</p></div>' for k in range(3) for x in (A, B))
    assert len(f(f"<body>{posts}</body>")) == 6
    for name in ("sidebar-right", "site-header", "comments-area", "cookie-notice", "footer"):
        assert f(f'<body><div class="{name}"><p>Something short.</p></div><div>{BODY}</div></body>') == [A, B, C], name


def slow_numbers(node):
    """(characters, link characters, tags, link tags) of a node, straight from the definition."""
    chars = links = tags = link_tags = 0
    for k in node.kids:
        if isinstance(k, str):
            n = len(" ".join(html.unescape(k).split()))
            chars, links = chars + n, links + n * node.link
        elif not k.dropped:
            c, lc, t, lt = slow_numbers(k)
            chars, links, tags, link_tags = chars + c, links + lc, tags + t + 1, link_tags + lt + (k.tag == "a")
    return chars, links, tags, link_tags


def slow_density(node, body):
    c, lc, t, lt = slow_numbers(node)
    if not c:
        return 0.0
    bc, blc, _, _ = slow_numbers(body)
    base = math.log(c / max(1, c - lc) * max(1, lc) + blc / max(1, bc) * c + math.e)
    return c / max(1, t) * math.log(max(c / max(1, lc) * max(1, t) / max(1, lt), 1 + 1e-9)) / math.log(base)


def all_nodes(node):
    yield node
    for k in node.kids:
        if not isinstance(k, str) and not k.dropped:
            yield from all_nodes(k)


def test_density_by_definition():
    """Counts, densities and their sums on random trees, and the core against the greatest sum."""
    rng = random.Random(12)
    bits = ["<div>", "</div>", "<p>", "</p>", "<ul>", "<li>", "</ul>", "<a href=x>", "</a>", "<b>", "</b>", "<nav>", "</nav>", "words of a text ", "more &amp; more ", "x", "<br>", "<section>", "</section>"]
    seen = 0
    for _ in range(400):
        page = "<body>" + "".join(rng.choice(bits) for _ in range(rng.randint(1, 60)))
        root = html_text.parse(page)
        order = html_text._measure(root)
        nodes = list(all_nodes(root))
        assert {id(n) for n in nodes} == {id(n) for n in order}
        body = next((n for n in nodes if n.tag == "body"), root)
        for n in nodes:
            assert (n.chars, n.links, n.tags, n.link_tags) == slow_numbers(n)
            assert math.isclose(n.density, slow_density(n, body), rel_tol=1e-6, abs_tol=1e-6)
            kids = [k for k in n.kids if not isinstance(k, str) and not k.dropped and k.tag in html_text.BLOCK]
            assert math.isclose(n.total, sum(slow_density(k, body) for k in kids), rel_tol=1e-6, abs_tol=1e-6)
        blocks = [n for n in nodes if n.tag in html_text.BLOCK]
        core = max(blocks, key=lambda n: n.total)
        if core.total > 0:
            seen += 1
            inside = [" ".join(html.unescape(t).split()) for n in all_nodes(core) for t in n.kids if isinstance(t, str)]
            text = " ".join(html_text.main_text(page).split())
            assert all(t in text for t in inside)
    assert seen > 200


def test_hostile_pages():
    pages = ["<a " * 60_000, '<a "x>" ' * 30_000 + '"', "<div>" * 20_000 + "</b>" * 20_000, "<div>" * 8000 + "<li>" * 8000, "<p><div>" + "<b>" * 8000 + "<hr>" * 8000, "<!--" * 50_000, "<ul><li>" * 10_000, "<a '>" * 30_000, "<dl>" + "<dd><b>" * 10_000]
    for page in pages:
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 2, page[:20]


def test_frames(spark):
    rows = [(1, "<p>a &amp; b", 7), (1, "<p>a &amp; b", 7), (2, None, None), (None, "", 8), (3, "<nav>x</nav>", 9)]
    d = spark.createDataFrame(rows, "page_id long, html string, n_chars int").select("*", F.lit(1).alias("text"), F.lit(2).alias("work0"))
    out = html_text.extract_text(d, F.col("html"), page_id=F.col("page_id"), html=F.col("html"), text=F.col("text"), work0=F.col("work0"))
    assert out.columns == ["page_id", "html", "work0", "text"]
    assert sorted((r.page_id or 0, r.text) for r in out.collect()) == [(0, ""), (1, "a & b"), (1, "a & b"), (2, ""), (3, "")]
    assert html_text.extract_text(d.where("false"), F.col("html"), page_id=F.col("page_id")).count() == 0


def test_attributes_are_whole_names_with_values():
    for start, end in (("<div title='hidden gems'>", "</div>"), ("<div data-hidden='false'>", "</div>"), ("<section aria-labelledby='hidden-h'>", "</section>"), ('<div title="a class=ad b">', "</div>"), ("<div data-style=display:none>", "</div>")):
        assert f(f"<body>{start}{BODY}{end}</body>") == [A, B, C], start
    assert f(f"<article><p data-id='comment-3'>{A}</p><p data-valid='menu'>{B}</p><p>{C}</p></article>") == [A, B, C]
    for gone in ("hidden", "HIDDEN=''", "aria-hidden=true", "style='color:red; display: none'", "class='menu'", "id=x class=sidebar"):
        assert f(f"<article>{BODY}<div {gone}><p>{A} x</p></div></article>") == [A, B, C], gone
    began = time.process_time()
    f("<div " + "a='b \" " * 100_000 + ">" + "<p " + "x = " * 100_000 + ">" + "<p " + " " * 200_000 + "=>")
    assert time.process_time() - began < 3


def test_comments_are_known_by_their_form():
    remarks = "<div class='reader-remarks'>" + "".join(f"<div class='remark'><b>name {k}</b><p>{A[:300]} {k}</p></div>" for k in range(12)) + "</div>"
    for page in (f"<article>{BODY}{remarks}</article>", f"<div>{BODY}</div>{remarks}", f"<div>{BODY}{remarks}</div>"):
        assert f(f"<body>{page}</body>") == [A, B, C]
    # Parts with headings, and parts that nothing comes before, are the text itself.
    parts = "".join(f"<section class='part'><h2>Part {k}</h2><p>{A} {k}</p></section>" for k in range(6))
    assert len(f(f"<body><article>{BODY}<div>{parts}</div></article></body>")) == 15
    assert len(f("<body><div>" + "".join(f"<div class='part'><p>{A} {k}</p></div>" for k in range(6)) + "</div></body>")) == 6


def test_sibling_articles_belong_to_the_text():
    assert f(f"<body><article>{BODY}</article><article><p>{B} x</p><p>{C} x</p></article></body>") == [A, B, C, f"{B} x", f"{C} x"]
    assert f(f"<body><article>{BODY}</article><article><a href=x>{A}</a></article></body>") == [A, B, C]
