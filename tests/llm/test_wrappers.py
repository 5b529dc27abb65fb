"""Wrapper inference: planted sites with known main text, alignment properties, odd markup."""

import html
import random

import pytest

from channelspark.llm import wrappers as w

SCHEMA = "page_id bigint, url string, html string, host string, part int, shape string, wrapper string, row string, text string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "h", 1, "s", "w", "r", "t") for r in rows], SCHEMA).repartition(parts)


def result(spark, rows, parts=3):
    pages = frame(spark, rows, parts)
    return {r.page_id: r.text for r in w.extract(pages, w.infer(pages)).select("row.page_id", "text").collect()}


def sentences(words, rng, n):
    return [" ".join(rng.choices(words, k=rng.randint(6, 25))).capitalize() + "." for _ in range(n)]


def semantic(title, body, rng, words):
    return f"""<!doctype html><html><head><title>x</title><style>p{{}}</style></head><body class="post single"><header><h1>My site</h1></header>
    <nav class=menu><ul>{''.join(f'<li><a href="/{i}">{rng.choice(words)}</a>' for i in range(rng.randint(1, 5)))}</ul></nav>
    <main><article class="post"><header><h1>{title}</h1></header>{''.join(f'<p>{b}</p>' for b in body)}
    <div class="share-buttons">Share this</div><form><label>Mail</label><button>Go</button></form><script>var a = "<p>no</p>";</script></article>
    <aside><h2>Popular</h2><p>{rng.choice(words)}</p></aside></main>
    <section id="comments-{rng.randint(1, 99)}"><h2>Comments</h2><article class="comment"><p>{' '.join(rng.choices(words, k=30))}</p></article></section>
    <footer>&copy; me</footer></body></html>"""


def named(title, body, rng, words):
    return f"""<html><body><div id="header">Brand</div><div id="topNav"><a href=a>One</a></div><div class="cookie-notice">We use cookies</div>
    <div class="layout"><div class="postBody"><h2>{title}</h2>{''.join(f'<div>{b}</div>' for b in body)}<div class="ad-slot"><p>Buy now</p></div></div>
    <div class="sidebar-right"><p>{' '.join(rng.choices(words, k=20))}</p></div></div><div class="reader-comments"><p>Nice {rng.choice(words)}</p></div></body></html>"""


def nameless(title, body, rng, words):
    return f"""<body><table><tr><td>Welcome to the site</td></tr></table><div class="x1"><a href=1>{rng.choice(words)}</a> <a href=2>{rng.choice(words)}</a></div>
    <div class="x2"><h3>{title}</h3>{''.join(f'<p>{b}' for b in body)}</div><div class="x3">All rights reserved by this fine site</div></body>"""


@pytest.mark.parametrize("build", [semantic, named, nameless])
def test_planted_sites(spark, words, build):
    rng = random.Random(build.__name__)
    rows, want = [], {}
    for i in range(40):
        title, *body = sentences(words, rng, rng.randint(2, 9))
        body.append("Tom &amp; <b>Jer<i>ry</i></b>&nbsp; &lt;3\n end")
        rows.append((i, f"https://site.example/{i}", build(title, body, rng, words)))
        want[i] = "\n".join([title, *body[:-1], "Tom & Jerry <3 end"])
    assert result(spark, rows) == want


def test_two_builds_on_one_host_and_single_pages(spark, words):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(30):
        title, *body = sentences(words, rng, 5)
        url = "http://mixed.example/a" if i < 24 else f"//alone{i}.example"
        rows.append((i, url, (semantic, nameless, named)[i % 3](title, body, rng, words)))
        want[i] = "\n".join([title, *body])
    got = result(spark, rows, 5)
    assert {i: got[i] for i in want if i % 3 != 1} == {i: want[i] for i in want if i % 3 != 1}
    assert all(want[i] in got[i] for i in want)


def boxed(title, body, rng, words):
    return f"""<body class="no-comments"><form id=page><div class="layout sidebar-left menu"><div class="menu"><a href=1>{rng.choice(words)}</a></div>
    <article class="post has-sidebar"><h1>{title}</h1>{''.join(f'<p>{b}</p>' for b in body)}<div class="comments"><p>{rng.choice(words)}</p></div></article></div></form></body>"""


def test_article_in_boxes_with_misleading_names(spark, words):
    rng = random.Random(6)
    rows, want = [], {}
    for i in range(12):
        title, *body = sentences(words, rng, 4)
        rows.append((i, "http://boxed.example", boxed(title, body, rng, words)))
        want[i] = "\n".join([title, *body])
    assert result(spark, rows) == want


def test_partitioning_does_not_matter(spark, words):
    rng = random.Random(9)
    rows = [(i, "http://a.example/", nameless(*[s := sentences(words, rng, 4)][0][:1], s[1:], rng, words)) for i in range(50)]
    assert result(spark, rows, 1) == result(spark, rows, 7)


def test_defined_cases(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    long = "<article>" + "".join(f"<h2>H{i}</h2><p>a{i}</p><p>b</p>" for i in range(3000)) + "</article>"
    rows = [
        (1, None, None), (2, "", ""), (3, "http://x.example", "plain text"), (4, "x", "<p>unclosed <b>bold<p>next"), (5, "http://d.example", deep),
        (6, "http://l.example", long), (7, "http://q.example", '<article><p title="a > b">q</p><p a="unclosed>r</p></article>'),
        (8, "http://c.example", "<article><p>same</p></article>"), (8, "http://c.example", "<article><p>same</p></article>"),
        (9, "http://s.example", "<article>a<script>if (1 < 2) document.write('<p>x</p>')</script>b<!-- c --><br>d &eacute;&#x41;&bogus; 1 < 2</article>"),
        (10, "http://t.example", "<article><p>cut off <b"),
    ]
    got = result(spark, rows)
    assert got[1] == got[2] == "" and got[3] == "plain text" and got[4] == "unclosed bold\nnext" and got[5] == "deep"
    assert got[6] == "\n".join(f"H{i}\na{i}\nb" for i in range(3000))
    assert got[7].startswith("q") and got[8] == "same" and got[9] == "ab d éA&bogus; 1 < 2" and got[10].startswith("cut off")
    none = frame(spark, [])
    assert w.extract(none, w.infer(none)).count() == 0


def test_expressions_are_inferred():
    """Repeats become groups, missing parts optional, differing texts slots."""
    pages = ["<h1>A</h1><p>x<p>y", "<h1>B</h1><p>z<hr>", "<h1>C</h1><ul><li>1<li>2</ul><p>w"]
    wrapper = w.Page(pages[0]).root.items
    for page in pages[1:]:
        wrapper = w.aligned(wrapper, w.Page(page).root.items)
    assert w.shape(wrapper) == "<h1<#>><ul?<li+<#>>><p+<#>><hr?>"
    group = w.Page("".join(f"<h2>{i}</h2><p>{i}</p><p>b</p>" for i in range(4))).root.items
    assert w.shape(group) == "<()+<h2<#>><p+<#>>>"
    assert [s.slot[0] for s in w.slots(group)] == [[0, 3, 6, 9], [1, 2, 4, 5, 7, 8, 10, 11]]


def test_no_text_is_lost_by_alignment():
    rng = random.Random(2)

    def tree(depth):
        return "".join(rng.choice([f"<p>{html.escape(str(rng.random()))}</p>", f"<div class={rng.choice('abc')}>{tree(depth - 1) if depth else 't'}</div>", "<hr>"])
                       for _ in range(rng.randint(0, 5)))

    for _ in range(60):
        one, two = w.Page(tree(3)), w.Page(tree(3))
        both = w.aligned(one.root.items, two.root.items)
        seen = sorted(place for s in w.slots(both) for place in s.slot[0])
        assert seen == sorted([*range(len(one.texts)), *range(len(two.texts))])
        assert sum(s.slot[1] for s in w.slots(both)) == len(seen)
