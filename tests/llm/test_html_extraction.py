"""Main-text extraction on hand-made sites, and its table contract."""

from collections import defaultdict

from pyspark.sql import functions as F

from siteward.llm import html_extraction

PAGE = """<!DOCTYPE html><html><head><title>T {n}</title><style>p {{ color: red }}</style><script>var x = "<p>no</p>";</script></head>
<body><header><a href="/">Home</a></header><nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav>
<div class="wrap"><article><h1>Title {n} &amp; more</h1><p>First   paragraph of {n},
with <b>bold</b> text.<p>Second &eacute;&#x41; of {n}.</article>
<div class="comments"><p>A reader's comment {n}</p></div><aside>Side {n}</aside></div>
<form><input name=q><p>Search</p></form><footer>Footer text</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_article_only(spark):
    rows = [(n, f"http://a.example/{n}", PAGE.format(n=n)) for n in range(6)]
    got = {r.page_id: r for r in html_extraction.main_text(pages(spark, rows)).collect()}
    for n in range(6):
        want = f"Title {n} & more\nFirst paragraph of {n}, with bold text.\nSecond éA of {n}."
        assert got[n].text == want and got[n].n_chars == len(want)


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "http://b.example/", "plain text only"), (3, "http://b.example/", "plain text only"), (4, "http://b.example/", "<p>" * 3000 + "deep"), (None, "http://c.example", "<div><p>a &lt; b")]
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extraction.main_text(pages(spark, rows).withColumnRenamed("url", "url")).collect())
    assert got == [(0, "a < b", 5), (1, "", 0), (2, "", 0), (3, "plain text only", 15), (3, "plain text only", 15), (4, "deep", 4)]
    assert html_extraction.main_text(pages(spark, [])).count() == 0


def test_every_page_of_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = html_extraction.main_text(table).collect()
    assert sorted(r.page_id for r in rows) == sorted(r.page_id for r in table.select("page_id").collect())
    assert sum(r.n_chars > 0 for r in rows) >= 0.9 * len(rows)
    for r in rows:
        assert r.n_chars == len(r.text)
        assert all(x == " ".join(x.split()) and x for x in r.text.split("\n")) or not r.text


NAMELESS = """<body><div class="x1"><p>Home of all<p>things {k}</div><div class="x2"><div class="x3"><h2>Title {n}</h2>{body}
<p>Read our fine print before you leave</p></div><div class="x4"><p>Odd note {n}</p></div></div><div class="x5">Printed by us</div></body>"""


def nameless(n):
    return NAMELESS.format(n=n, k=n % 2, body="".join(f"<p>Long paragraph {n} {k} " + "lorem ipsum dolor " * (4 + n % 3) + "</p>" for k in range(2 + n % 4)))


def test_no_names_are_needed(spark):
    """Without telling tags or classes: the region is the heavy element, fixed text is dropped, little slots beside it as well."""
    rows = [(n, f"http://a.example/{n}", nameless(n)) for n in range(8)]
    for r in html_extraction.main_text(pages(spark, rows)).collect():
        lines = r.text.split("\n")
        assert lines[0] == f"Title {r.page_id}" and len(lines) == 3 + r.page_id % 4
        assert all(x.startswith(f"Long paragraph {r.page_id} ") for x in lines[1:])
        assert r.text != html_extraction.slots(nameless(r.page_id), None, None, None)  # the template changes each page


def test_names_of_everyday_classes_hide_nothing(spark):
    article = "<article><p>Hello world text</p>{}</article>"
    sources = [
        '<div class="content has-sidebar">' + article.format("") + "</div>",
        '<div class="post no-comments">' + article.format("") + "</div>",
        '<div class="comments">' + article.format("") + "</div>",
        article.format('<p class="share price">Up by ten</p><div class="related-work">Others</div><section id="responses">Answers</section>'),
    ]
    want = ["Hello world text"] * 3 + ["Hello world text\nUp by ten\nOthers\nAnswers"]
    got = {r.page_id: r.text for r in html_extraction.main_text(pages(spark, [(n, f"http://s{n}.example/", x) for n, x in enumerate(sources)])).collect()}
    assert [got[n] for n in range(4)] == want


def test_names_in_articles_go_by_their_class(spark):
    """A section of responses inside the article is the host's template, whatever its text; a page of another host keeps one.
    Comments go everywhere."""
    page = '<article><h1>Title {n}</h1><p>Text {n} goes on.</p><section class="{name}"><div>Reader {n} says</div></section></article>'
    rows = [(n, f"http://a.example/{n}", page.format(n=n, name="responses")) for n in range(5)]
    rows += [(8, "http://b.example/", page.format(n=8, name="responses")), (9, "http://c.example/", page.format(n=9, name="comments box"))]
    got = {r.page_id: r.text for r in html_extraction.main_text(pages(spark, rows)).collect()}
    assert all(got[n] == f"Title {n}\nText {n} goes on." for n in (0, 1, 2, 3, 4, 9))
    assert got[8] == "Title 8\nText 8 goes on.\nReader 8 says"


def test_copies_are_no_template(spark):
    page = PAGE.format(n=7)
    rows = [(n, f"http://a.example/{n}", page) for n in range(5)]
    near = [(n, f"http://b.example/{n}", page.replace("Second", f"Second{n}")) for n in range(10, 15)]
    for r in html_extraction.main_text(pages(spark, rows + near)).collect():
        want = f"Title 7 & more\nFirst paragraph of 7, with bold text.\nSecond{r.page_id if r.page_id >= 10 else ''} éA of 7."
        assert r.text == want


def test_repeated_notices_in_articles_are_fixed_text(spark):
    page = PAGE.replace("</article>", "<p>Sign up for our letters</p></article>")
    rows = [(n, f"http://a.example/{n}", page.format(n=n)) for n in range(4)]
    assert all("Sign up" not in r.text and f"Second éA of {r.page_id}." in r.text for r in html_extraction.main_text(pages(spark, rows)).collect())


def test_classes_against_whole_vectors(spark):
    """The classes are those of grouping tokens by their counts in all pages."""
    rows = [(h, n, page.format(n=n) if page is PAGE else nameless(n)) for h, page in ((1, PAGE), (2, NAMELESS)) for n in range(7)] + [(1, 90, "<p>odd"), (3, 91, PAGE.format(n=1))]
    vectors, kinds, content = defaultdict(dict), {}, {}
    for host, n, source in rows:
        page = html_extraction.Page(source)
        content[host, n] = "\n".join(b[1] for b in page.blocks if b[3])
        for token, (_, kind, times, *_) in page.tokens().items():
            vectors[host, token][n] = times
            kinds[host, token] = kind
    want = defaultdict(set)
    for (host, token), v in vectors.items():
        if len(v) >= html_extraction.PAGES and len({content[host, n] for n in v}) > 1:
            want[host, tuple(sorted(v.items()))].add(token)
    want = {(k[0], frozenset(x)) for k, x in want.items() if any(kinds[k[0], t] < html_extraction.TEXT for t in x)}
    df = spark.createDataFrame(rows, "host long, page long, html string")
    got = {(r.host, frozenset(m.token for m in r.members)) for r in html_extraction.classes(df).collect()}
    assert got == want and len(want) > 3


def test_deep_pages_cost_their_length(spark):
    deep = "<div class=a>" * 50_000 + "deep text"
    rows = [(n, "http://d.example/x", deep) for n in range(3)] + [(9, "http://d.example/y", "<ul>" * 20_000 + "<li>x")]
    got = {r.page_id: r.text for r in html_extraction.main_text(pages(spark, rows)).collect()}
    assert got == {0: "deep text", 1: "deep text", 2: "deep text", 9: "x"}


def test_attributes_by_their_whole_names(spark):
    rows = [(1, "http://e.example/", '<div data-class="ad" title="hidden"><p>kept</p></div><div class="ad">no</div><p aria-hidden=true>no')]
    assert [r.text for r in html_extraction.main_text(pages(spark, rows).withColumn("host", F.lit(1))).collect()] == ["kept"]


def test_many_templates_are_joined_by_salted_hosts(spark):
    rows = [(n, f"http://a.example/{n}", nameless(n)) for n in range(8)]
    one, two = (sorted(map(tuple, html_extraction.main_text(pages(spark, rows), broadcast_bytes=b).collect())) for b in (10**9, 0))
    assert one == two
