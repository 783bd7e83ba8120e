import duckdb
import numpy as np

from graphlens.llm import html_text
from graphlens.llm.common import table

PAGE = """<!doctype html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script>
<body class="has-sidebar"><header class=site-header><h2>Site</h2></header><div id="top-menu"><a href=/>Home page link</a></div>
<div class="cookie-notice">We use cookies on this page and many others, please say yes to all of them now.</div>
<main><article><header><h1>The &quot;Title&quot; &amp; more</h1></header>
<p>First   para<b>graph</b> is long enough to be content, with a few words more&nbsp;here.<p><i>Second<br>one</i>
<aside>Side words that are long enough to look like content as well.</aside><div class="ad">Buy this now</div>
<p>ok<form><p>Your mail address please</form><ul><li>point one<li>point two</ul></article>
<section id=comments><p>A reader's comment that is rather long, longer than most of the paragraphs above are.</section></main>
<footer><p>Footer words</footer>"""


def test_article_only():
    assert html_text.main_text(PAGE) == (
        'The "Title" & more First paragraph is long enough to be content, with a few words more here.'
        " Second one ok point one point two"
    )


def test_pages_without_article():
    text = "words of the story that go on for a while " * 4
    page = (
        f'<div id="nav"><a href=1>one</a> <a href=2>two</a></div><div class="content"><h2>Head</h2><p>{text}</p><p>{text}</p>'
        '<p>Short.</p></div><div class="box"><p>Tiny</p></div>'
    )
    assert html_text.main_text(page) == " ".join(f"Head {text}{text}Short.".split())
    assert html_text.main_text("just text &lt;here&gt;") == "just text <here>"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p><script>x</script>") == ""


def test_lists_cells_and_nested_blocks_without_article():
    long = "words of the story that go on for a while " * 7
    items = [f"point number {i} of it" for i in range(8)]
    listed = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    cells = "<table><tr><td>one</td><td>two</td></tr><tr><td>three</td><td>four</td></tr></table>"
    nested = "<div><p>brief</p><div><p>deep</p></div></div>"
    box = '<div id="nav"><a href=1>one</a></div>', '<div class="box"><p>Some</p><p>small</p><p>words</p></div>'
    for inside, want in [(listed, " ".join(items)), (cells, "one two three four"), (nested, "brief deep")]:
        for content in (f"<p>{long}</p><p>{long}</p>{inside}", f"<p>{long}</p>{inside}<p>{long}</p>"):
            got = html_text.main_text(f'<body>{box[0]}<div class="content">{content}<p>End.</p></div>{box[1]}')
            order = (long, long, want) if content.endswith(inside) else (long, want, long)
            assert got in (" ".join(f"{' '.join(order)} End.".split()), " ".join(f"{' '.join(order)} End. Some small words".split()))
        assert got.count("story") == 14
    bare = html_text.main_text(f"<body><p>{long}</p><p>{long}</p>{listed}{box[1]}</body>")
    assert bare == " ".join(f"{long}{long}{' '.join(items)}".split())


def test_smoothing_keeps_order_of_size():
    chosen = html_text.regions(np.array([0, 3, 50, 60, 55, 2, 0, 0, 1.0]))
    assert chosen[2:5].all() and not chosen[[0, 6, 7, 8]].any()
    assert not html_text.regions(np.zeros(3)).any() and len(html_text.regions(np.zeros(0))) == 0


def test_equals_sql_on_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    got = html_text.extract(table(spark, folder, "pages")).toPandas().sort_values("page_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet'")
    want = con.execute(html_text.ORACLE_SQL).fetchdf().sort_values("page_id").reset_index(drop=True)
    assert (got.text == want.text).all() and (got.n_chars == want.n_chars).all()


def test_edges(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>" + "long " * 50_000, "x"), (2, "v", "<div>" * 3000 + "deep", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_text.extract(pages).collect()
    assert sorted(r.n_chars for r in out) == [0, 0, 4, 249_999]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_regions_decide_on_pages_without_helpful_tags(monkeypatch):
    say = lambda n, w: " ".join(f"{w}{i}" for i in range(n)) + "."
    one, two, three = say(60, "alpha"), say(40, "beta"), say(55, "gamma")
    page = f"""<html><body><div><span>Today</span> <b>is</b> <i>fine</i></div><div><a href=x>Home</a> <a href=y>News</a> <a href=z>Mail</a></div>
    <div><div><p>{one}</p></div><div><p>{two}</p></div><div><p>{three}</p></div></div>
    <div><span>Call</span> <em>us</em> <i>soon</i></div><div><b>All</b> <i>rights</i> <u>kept</u></div></body></html>"""
    # two articles: the regions tell which one is the page's
    both = f"<article><p>{one}</p><p>{two}</p><p>{three}</p></article><article><p><a href=x>Read</a> <i>more</i></p></article>"
    want = f"{one} {two} {three}"
    assert html_text.main_text(page) == want and html_text.main_text(both) == want
    every, largest = (lambda r: (r > 0).astype(int)), (lambda r: (np.arange(len(r)) == r.argmax()).astype(int))
    monkeypatch.setattr(html_text, "regions", every)
    assert html_text.main_text(page) != want and html_text.main_text(both) != want
    monkeypatch.setattr(html_text, "regions", largest)
    assert html_text.main_text(page) != want
