"""Main text: hand-made pages, and the given pages against their plain reading."""

import html
import re
import time

import pytest

from citeloom.llm import webpage

BODY = "A long paragraph about rivers and the people who live beside them, with commas, and more."


def text(source, winners=()):
    return webpage.extract(source, list(winners))[0]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<article><h1>T</h1><p>a<b>b</b> c<br>d</article>", "T\nab c d"),
        ("<article><p>a&nbsp; b &lt;p&gt; &#x41;&eacute;</p></article>", "a b <p> Aé"),
        ("<article><p>one<p>two<ul><li>x<li>y</ul>after</article>", "one\ntwo\nx\ny\nafter"),
        ("<article><p>a<!-- no --> b<script>var x='</p>';</script> c</p><style>p{}</style></article>", "a b c"),
        ("<article>a<nav>menu</nav>b<aside>side</aside><form>go</form>c</article>", "a\nb\nc"),
        ("<article><header><h1>Title</h1><p>by me</p></header><p>x</p><footer>f</footer></article>", "Title\nx"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1 2\n3"),
        ("<article><p>5 < 6 and 7 <8</p></article>", "5 < 6 and 7 <8"),
        ("<article><p title='a>b' class=\"x\">q</p></article>", "q"),
        ('<article><p title="never closed>q</p></article>', "q"),
        ("<article><p>tail", "tail"),
        ("<article><p>x</p><p>x</p></article><!-- open", "x\nx"),
        ("<nav>only a menu</nav><footer>foot</footer>", ""),
        ("<body class='has-sidebar'><div class='sidebar-right content'><main><p>in</p></main></div></body>", "in"),
        ("<article><p><b>bold<p>still</b> here</article>", "bold\nstill here"),
    ],
)
def test_small_pages(source, want):
    assert text(source) == want


def test_boilerplate_by_class_role_and_id():
    source = f"""<html><body><div id="top-nav"><a href=/>Home</a></div><div role="banner">Site</div>
    <div class="cookie-consent">{BODY} We use cookies.</div><div class="wrap"><div class="post-body"><h1>Head</h1><p>{BODY}</p>
    <div class="share-buttons">Share</div><p>{BODY} Two.</p></div><div class="sidebar">{BODY}</div>
    <section id="comments"><h2>Comments</h2><p>{BODY} {BODY} {BODY}</p></section></div>
    <div class="adBox ad">{BODY}</div><div class="siteFooter">&copy; us</div></body></html>"""
    assert text(source) == f"Head\n{BODY}\n{BODY} Two."


def template(kind, k):
    if kind == "a":
        return f'<body><div class="x1"><div class="p-{k}"><h1>H{k}</h1><p>{BODY}</p><p>{k}</p></div></div><div class="x2"><p>off</p></div></body>'
    # The article is short and an unnamed box is longer: only the host's other pages tell.
    return f'<body><div class="x1"><div class="p-{k}"><h1>H{k}</h1><p>{k}</p></div></div><div class="x2"><p>{BODY * 3}</p></div></body>'


def test_pages_of_a_host_agree(spark):
    rows = [(k, f"https://Site.test/{k}", template("a", k)) for k in range(20)]
    rows += [(100, "https://site.test/short", template("b", 100)), (101, "https://other.test/short", template("b", 101))]
    rows += [(102, None, None), (102, "no host", ""), (None, "https://site.test", template("a", 7))] + [rows[3]] * 2
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "page_id long, url string, html string, host string, winners string, text string")
    got = webpage.main_texts(df.repartition(4)).collect()
    assert len(got) == len(rows)
    by = {(r["page_id"], r["url"]): r for r in got}
    assert by[100, "https://site.test/short"]["text"] == "H100\n100" and by[100, "https://site.test/short"]["agreed"]
    assert BODY in by[101, "https://other.test/short"]["text"]
    for k in range(20):
        assert by[k, f"https://Site.test/{k}"]["text"] == f"H{k}\n{BODY}\n{k}"
    assert by[102, None]["text"] == "" and by[102, "no host"]["n_chars"] == 0
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert webpage.main_texts(df.filter("false")).count() == 0


def test_winners_joined_by_salt(spark, monkeypatch):
    rows = [(k, "https://site.test/", template("a", k)) for k in range(8)] + [(9, "https://site.test/", template("b", 9))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(webpage.main_texts(df).collect())
    monkeypatch.setattr(webpage, "row_bound", lambda df: None)
    assert sorted(webpage.main_texts(df).collect()) == want


@pytest.mark.parametrize(
    "source",
    [
        "<div>" * 100000 + "x",
        "<b>" * 100000 + "</i>" * 100000 + "x",
        '<a x="' * 50000,
        "<p>" + "&amp;" * 300000,
        "<" * 300000,
        "<i><div>" + "<b>" * 50000 + "</i>" * 50000,
        "<!-- " * 100000,
        "<script>" * 50000,
        "<li>" * 50000 + "<td>" * 50000,
        "</p" * 100000,
    ],
)
def test_long_and_broken_pages_end(source):
    start = time.time()
    text(source)
    assert time.time() - start < 6


def test_given_pages(spark, sf):
    """Their article element holds all of the main text, in paragraphs."""
    from citeloom.llm import queries

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.main_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"(?s)<article>(.*?)</article>", pages[r["page_id"]]["html"])[1]
        blocks = [re.sub(r"<br>", " ", b) for b in re.split(r"</?(?:p|h1)>", article)]
        lines = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks]
        assert r["text"] == "\n".join(x for x in lines if x)
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]
