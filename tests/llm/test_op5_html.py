import html as H
import re

from pyspark.sql import functions as F

from paxcast.llm.op5_html import extract, main_text

PROSE = "A long enough sentence, with commas, that reads like prose and goes on for a while to earn its points."


def expected(page):
    """The article's blocks by plain string cuts (the table's pages have one article each)."""
    body = page[page.index("<article>") + 9:page.index("</article>")]
    parts = re.split(r"</?(?:p|h1)>", body)
    out = [" ".join(H.unescape(re.sub(r"</?(?:b|br)>", " ", p)).split()) for p in parts]
    return "\n".join(t for t in out if t)


def test_pages_table(spark):
    for name in ("sf0.001", "sf0.01"):
        pages = spark.read.parquet(f"/root/testdata/{name}/pages.parquet")
        got = {r.page_id: r for r in extract(pages).collect()}
        for r in pages.collect():
            assert got[r.page_id].text == expected(r.html)
            assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_boilerplate_goes_and_blocks_stay():
    page = f"""<html><head><title>T</title><style>p {{}}</style></head><body>
    <header><h1>Site</h1><p>{PROSE}</p></header><nav><a href=x>Home</a></nav>
    <div class="cookie-notice"><p>{PROSE}</p></div>
    <div id=main><h2>Title &amp; more</h2><p>First&nbsp;one, {PROSE}<p>Second   <b>bold</b>\n<i>it</i>, {PROSE}
    <ul><li>Item one<li>Item two</ul><div class="ad">Buy, buy, buy</div><script>var x = "</p><p>no</p>";</script>
    <blockquote>Quoted &lt;words&gt;</blockquote></div>
    <aside><p>{PROSE}</p></aside><form><p>{PROSE}</p></form>
    <div class="comments"><p>{PROSE}, {PROSE}</p><p>{PROSE}, {PROSE}</p></div>
    <div><a href=1>{PROSE}</a> <a href=2>{PROSE}</a></div><footer><p>{PROSE}</p></footer></body></html>"""
    assert main_text(page) == f"Title & more\nFirst one, {PROSE}\nSecond bold it, {PROSE}\nItem one\nItem two\nQuoted <words>"


def test_sections_of_one_article_stay_together():
    page = f"<body><main><article><header><h1>H</h1></header><section><p>{PROSE * 5}</p></section><section><p>short</p></section></article></main></body>"
    assert main_text(page) == f"H\n{PROSE * 5}\nshort"


def test_siblings_that_score_are_kept():
    page = f"<body><div><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div><div><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div><div><p>x</p></div></body>"
    assert main_text(page) == "\n".join([PROSE] * 7)


def test_odd_pages():
    assert main_text("") == main_text("<p>") == main_text("<html><body></body></html>") == main_text("<!-- only -->") == ""
    assert main_text("just words") == "just words"
    assert main_text("<p>a < b &am &a; &#65;&#x42;") == "a < b &am &a; AB"
    assert main_text("<article><p>cut off <b>in a ta") == "cut off in a ta"
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert main_text("<article><p>" + "x, " * 100_000 + "</article>") == ("x, " * 100_000).strip()


def test_defined_cases(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "v", "<p>a</p>"), (3, "v", "<p>a</p>"), (None, "w", "<p>b</p>")],
                                  "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in extract(pages).collect())
    assert got == [(0, "b", 1), (1, "", 0), (2, "", 0), (3, "a", 1), (3, "a", 1)]
    assert extract(pages.limit(0)).count() == 0


def test_names_that_only_mention_other_parts():
    wanted = f"{PROSE}\n{PROSE}"
    body = f"<p>{PROSE}</p><p>{PROSE}</p>"
    for names in ("main-content has-sidebar", "post-body no-ads", "content wide", "entry-content sharing-on"):
        assert main_text(f'<body><div class="{names}">{body}</div><div class="post-comments"><p>{PROSE}</p></div></body>') == wanted
    for names in ("article-comments", "content-ad", "main-menu", "cookie-notice", "sidebar", "user-comments list"):
        assert main_text(f'<body><div>{body}</div><div class="{names}">{body}</div></body>') == wanted


def test_headings_beside_or_before_the_best_container_stay():
    body = f"<div><p>{PROSE}</p><p>{PROSE}</p></div>"
    wanted = f"Title\n{PROSE}\n{PROSE}"
    assert main_text(f"<body><h1>Title</h1>{body}</body>") == wanted
    assert main_text(f"<body><div><h1>Title</h1></div>{body}</body>") == wanted
    assert main_text(f"<body><header><h1>Site</h1></header><h1>Title</h1><article>{body}</article></body>") == wanted
    assert main_text(f"<body><h1><a href=/>Site name</a></h1>{body}</body>") == f"{PROSE}\n{PROSE}"


def test_short_paragraph_beside_the_best_container_stays():
    body = f"<div><p>{PROSE}</p><p>{PROSE}</p></div>"
    assert main_text(f"<body>{body}<p>It rained.</p></body>") == f"{PROSE}\n{PROSE}\nIt rained."
    assert main_text(f"<body>{body}<p><a href=x>Read more.</a></p></body>") == f"{PROSE}\n{PROSE}"


def test_words_of_names_inside_an_article_set_aside_only_links():
    links = "<a href=1>Home page</a> <a href=2>All news</a>"
    for part, text in (("<h2 class='skip-level'>Next</h2>", "Next"), ("<p class='storm-alert'>Stay in, all of you.</p>", "Stay in, all of you."),
                       ("<div class='menu'><p>Soup, bread</p></div>", "Soup, bread")):
        assert main_text(f"<body><article><p>{PROSE}</p>{part}<p>{PROSE}</p></article></body>") == f"{PROSE}\n{text}\n{PROSE}"
    for part in (f"<div class='menu'>{links}</div>", f"<p class='skip'>{links}</p>", "<div class='ad'>Buy, buy</div>", "<div class='alert'>Update your app.</div>", "<div class='share'>Share</div>",
                 f"<section class='comments'><p>{PROSE}</p></section>", "<div role='alert'>Alert, alert</div>"):
        assert main_text(f"<body><article><p>{PROSE}</p>{part}<p>{PROSE}</p></article></body>") == f"{PROSE}\n{PROSE}"


def test_articles_beside_the_best_stay_if_they_score():
    long, short = f"<p>{PROSE}</p>" * 5, f"<p>{PROSE}</p>" * 4
    page = f"<body><article>{long}</article><article>{short}</article><article><a href=x>{PROSE}</a></article></body>"
    assert main_text(page) == "\n".join([PROSE] * 9)
