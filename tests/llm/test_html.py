"""HTML extraction: parsing, tree matching against an exhaustive one, and what the wrapper decides."""

import functools
import random

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import html_extract as H

PAGE = '<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><div class="cookie-notice">Accept</div><%s><h1>Head &amp; %d</h1><p>One<b>two</b>%d x<br>y\n z<p>Last &eacute;&#233; %d<script>var a="</p>";</script></%s><aside>Side</aside><section id="comments"><p>Reader</p></section><form>Name</form><footer>&copy; %d</footer></body></html>'


def alone(page):
    """The text of a page that has no wrapper."""
    g = H.parse(page)
    paths = g.paths()
    return H.extracted(g.labels, g.parents, g.flags, g.owners, g.texts, [H.key_of(paths[o], t) for o, t in zip(g.owners, g.texts)], None, None, None, (None, None))


def extracted(spark, rows, parts=3):
    return {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).collect()}


def test_html(spark):
    rows = [(k, f"http://h{k % 3}.example.com/{k}", PAGE % (tag := "article" if k % 3 else "div", k, k, k, tag, k)) for k in range(9)]
    rows += [(20, "http://alone.example.com/", PAGE % ("main", 20, 20, 20, "main", 20)), (21, None, None), (22, "nothing", ""), (23, "http://h1.example.com/x", "<p>bare"), (24, "http://h1.example.com/c", PAGE[:60])]
    rows += [rows[1], rows[1]]
    given = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("path", F.lit("clash")).withColumn("host", F.lit("mine"))
    out = H.extract(given, ["page_id", "url", "text", "path", "host"]).collect()
    got = {r.page_id: (r.text, r.n_chars) for r in out}
    for k in [*range(9), 20]:
        want = f"Head & {k} Onetwo{k} x y z Last éé {k}"
        assert got[k] == (want, len(want)), k
    assert got[21] == ("", 0) and got[22] == ("", 0) and got[23][0] == "bare" and len(out) == len(rows)
    assert all(r.path == "clash" and r.host == "mine" for r in out)
    assert H.extract(given.limit(0)).count() == 0


def test_template_from_all_pages(spark):
    page = "<body><div class='c'><p>%s</p><p>story %d has words of its own</p><p>%s</p></div></body>"
    rows = [(k, "http://one.example.com/", page % ("Follow this site" if k != 7 else "Welcome", k, "Often said" if k % 2 else f"said {k}")) for k in range(40)]
    rows += [(100 + k, "http://two.example.com/", rows[0][2]) for k in range(5)]
    got = extracted(spark, rows, 5)
    for k in range(40):
        said = "Often said" if k % 2 else f"said {k}"
        assert got[k] == ("Welcome " if k == 7 else "") + f"story {k} has words of its own {said}", k
    assert got[100] == got[104] == "Follow this site story 0 has words of its own said 0"


def test_the_wrapper_decides_inside_articles(spark):
    """Constant texts, and named containers that recur, go from articles; a name on one page alone drops nothing. Two layouts of a host have a wrapper each."""
    words = lambda k: f"the story of page {k} in {k * k} words of its own"
    story = lambda k: f'<body><div class="top"></div><article><h1>Title {k}</h1><p>Read this free of charge</p><p>{words(k)}</p><div class="share-bar">shared {k} times</div>%s</article></body>'
    rows = [(k, "http://a.example.com/", story(k) % ('<div class="notice-text">a notice that is told of</div>' if k == 3 else "")) for k in range(12)]
    other = lambda k: f"<body><main><section><h2>List {k}</h2><p>All items of this list</p><p>{words(k)}</p></section></main></body>"
    rows += [(100 + k, "http://a.example.com/", other(k)) for k in range(6)]
    # Stories in a plain div beside teasers that are articles: the wrapper, not the tag, says where the content is.
    teaser = lambda k: f"<body><div class='story'><p>{words(k)} {words(k + 1)} {words(k + 2)} {words(k + 3)}</p></div><article>teaser {k}</article></body>"
    rows += [(200 + k, "http://b.example.com/", teaser(k)) for k in range(6)]
    got = extracted(spark, rows)
    for k in range(12):
        assert got[k] == f"Title {k} {words(k)}" + (" a notice that is told of" if k == 3 else ""), k
    for k in range(6):
        assert got[100 + k] == f"List {k} {words(k)}"
        assert got[200 + k] == " ".join(words(k + j) for j in range(4))
    without = {i: alone(page) for i, _, page in rows}
    assert all(got[i] != without[i] for i, _, _ in rows)


def test_copies_of_one_article_are_no_template(spark):
    page = lambda k: f"<body><nav>menu {k}</nav><article><h1>News</h1><p>The first half of the news is the same</p><p>and so is the second half</p><p>seen {k}</p></article></body>"
    got = extracted(spark, [(k, "http://c.example.com/", page(k)) for k in range(2)])
    assert got[0] == "News The first half of the news is the same and so is the second half seen 0"


def test_attributes_are_read_and_not_searched():
    assert alone('<article><div data-title="a hidden gem"><p>Text</p></div></article>') == "Text"
    assert alone('<article><p title="see class=comments here">abc</p></article>') == "abc"
    assert alone("<p class=x'y>Hello</p><p>World</p>") == "Hello World"
    assert alone("<article><header><h1>Title</h1></header><p>x</p></article>") == "Title x"
    assert alone('<article><h1 class="page-header">T</h1><p class="notice-board">N</p><ul class="menu-items"><li>a<li>b</ul></article>') == "T N a b"
    assert alone('<article><div class="ad">buy</div><p hidden>h</p><section ID=comments>c</section>x</article>') == "x"
    assert alone("<p title='>never closed") == "" and alone('<p a = "x>y" b=1/2>in</p>') == "in" and alone("<!--> a -->b") == "a -->b"
    assert H.attributes(" class = 'a b' ID=c hidden data-x='1\"2' ID=d") == {"class": "a b", "id": "c", "hidden": "", "data-x": '1"2'}


def test_odd_shape():
    assert alone("<article>" + "<div>a" * 3_000 + "</div>z" * 10).split() == ["a"] * 3_000 + ["z"] * 10
    assert alone("<article>" + "<p>x" * 20_000) == " ".join(["x"] * 20_000)
    assert alone("<article><nav>" + "<div>" * 400 + "menu</nav>text</article>") == "text"
    assert alone("<a <b <c") == "" and alone("<!-- open") == ""
    assert alone("<form id=page><nav>n</nav><article>whole page in a form</article></form>") == "whole page in a form"


def matched(a, b):
    shapes = H.Shapes()
    ka, kb = H.kids_of(a[1]), H.kids_of(b[1])
    return H.match(shapes, ka, shapes.of(a[0], ka), kb, shapes.of(b[0], kb))


def test_tree_matching_equals_exhaustive_matching():
    rng = random.Random(5)

    def tree():
        labels, parents = ["r"], [-1]
        path = [0]
        for _ in range(rng.randint(0, 9)):
            path = path[: rng.randint(1, len(path))]
            labels.append(rng.choice("ab"))
            parents.append(path[-1])
            path.append(len(labels) - 1)
        return labels, parents

    def best(a, b):
        ka, kb = H.kids_of(a[1]), H.kids_of(b[1])

        @functools.cache
        def nodes(x, y):
            return 1 + forests(tuple(ka[x]), tuple(kb[y])) if a[0][x] == b[0][y] else 0

        @functools.cache
        def forests(one, two):
            """The first of one is left out, or goes to any of two."""
            if not one or not two:
                return 0
            return max([forests(one[1:], two)] + [nodes(one[0], y) + forests(one[1:], two[k + 1 :]) for k, y in enumerate(two) if a[0][one[0]] == b[0][y]])

        return nodes(0, 0)

    for _ in range(400):
        a, b = tree(), tree()
        m = matched(a, b)
        pairs = [(x, int(y)) for x, y in enumerate(m) if y >= 0]
        assert len(pairs) == best(a, b)
        to = dict(pairs)
        assert all(a[0][x] == b[0][y] and (x == 0 or to[a[1][x]] == b[1][y]) for x, y in pairs)
        assert all((x < u) == (y < v) for x, y in pairs for u, v in pairs if a[1][x] == a[1][u])


def test_long_lists_are_matched_whole():
    a, b = H.parse("<article>" + "<p>x" * 3_000), H.parse("<article>" + "<p>x" * 500 + "<ul><li>y</ul>" + "<p>z" * 2_800)
    m = matched((a.labels, a.parents), (b.labels, b.parents))
    assert (m >= 0).all() and (np.diff(m) > 0).all()
