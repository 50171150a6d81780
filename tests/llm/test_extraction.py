import re
from html import unescape

import pytest

from tmaps.llm import extraction as X

SF = "/root/testdata/sf0.01"


def test_article_of_every_page(spark):
    got = {r.page_id: r for r in X.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", p.html, re.S).group(1).replace("<br>", "")
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert (got[p.page_id].url, got[p.page_id].text, got[p.page_id].n_chars) == (p.url, want, len(want))


LONG = "This is a rather long sentence of the article, with many words that stand close together."
CASES = {
    "classes": (f'<body><div id="top-menu"><a href=x>A</a></div><div class="content"><h1>T</h1><p>{LONG}</p><p>a <b>b</b> &amp; &lt;c&gt;</p></div>'
                f'<div class="comments"><p>{LONG} {LONG} {LONG}</p></div><div id=footer>c</div>', f"T\n\n{LONG}\n\na b & <c>"),
    "sections": (f"<body><header><h1>Site</h1></header><div><section><h2>One</h2><p>{LONG}</p></section><section><h2>Two</h2><p>{LONG} {LONG}</p></section>"
                 f"</div><aside><p>{LONG * 9}</p></aside>", f"One\n\n{LONG}\n\nTwo\n\n{LONG} {LONG}"),
    "open tags": ("<p>Hello <b>world<p>Second<li>x</ul></b> tail", "Hello world\n\nSecond\n\nx tail"),
    "scripts": ('<script>if(a<b){"</p>"}</script><p>t</p><style>x', "t"),
    "lists": ("<main><form><input><label>N</label></form><p>Body.</p><div class='ad-box'>Buy</div><ul><li>one<li>two</ul><table><tr><td>1<td>2</table></main>",
              "Body.\n\none\n\ntwo\n\n1\n\n2"),
    "white space": ("<article><p> a\n\tb&nbsp;c <br> d</p>\n\n<p>\n</p></article>", "a b c d"),
    "short article": (f"<body><article><p>Hi.</p></article><footer>{LONG}</footer>", "Hi."),
    "cut tag": ("<p>text</p><foo", "text"), "less than": ("<p>1 < 2</p>", "1 < 2"), "plain": ("no tags", "no tags"),
    "empty": ("", ""), "blank": (" \n", ""), "comment": ("<!-- <p>a</p> --><p>b</p>", "b"),
    "notice": (f"<body><div class='cookie-notice' role=alert><p>{LONG}</p></div><div><p>{LONG}</p></div>", LONG),
}


NAMED = ("<h2 id='related-work'>{}</h2>", "<section id='discussion'><p>{}</p></section>", "<h2 id='search-algorithms'>{}</h2>", "<p class='notice-period'>{}</p>",
         "<section id='threads'><p>{}</p></section>", "<div class='downloads'><p>{}</p></div>", "<div id='commentary'><p>{}</p></div>",
         "<section class='promote'><p>{}</p></section>", "<section id='navigation'><p>{}</p></section>", "<h3 class='banner'>{}</h3>")


@pytest.mark.parametrize("part", NAMED)
def test_classes_and_ids_that_name_subjects_stay(part):
    assert X.main_text(f"<body><article><h1>T</h1><p>{LONG}</p>{part.format('Told here.')}</article>") == f"T\n\n{LONG}\n\nTold here."


def test_layout_classes_do_not_lose_the_text():
    for name in ("layout has-sidebar", "header", "page sidebar"):
        assert X.main_text(f"<body><div class='{name}'><p>{LONG}</p><p>{LONG}</p></div><p><a href=x>a</a>") == f"{LONG}\n\n{LONG}"
    for name in ("sidebar", "ad-box", "siteFooter", "ads2", "cookie-notice", "related"):
        assert X.main_text(f"<main><p>{LONG}</p><div class='{name}'><a href=x>A link</a></div></main>") == LONG


COMMENTS = f"<section class='comments'><h2>Comments</h2><article class='comment'><p>{LONG * 5}</p></article><article class='comment'><p>{LONG * 3}</p></article></section>"
PARTS = {
    "parts of main": (f"<body><main><article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article><article><p>Two. {LONG}</p></article><div><a href=x>More</a></div></main>",
                      f"{LONG}\n\n{LONG}\n\n{LONG}\n\nTwo. {LONG}"),
    "parts of div": (f"<body><div><article><p>{LONG} {LONG}</p></article><article><p>Two. {LONG}</p></article></div>", f"{LONG} {LONG}\n\nTwo. {LONG}"),
    "lead": (f"<body><p>Site</p><main><header><h1>T</h1></header><p>The lead.</p><article><p>{LONG}</p><p>{LONG}</p></article></main>",
             f"T\n\nThe lead.\n\n{LONG}\n\n{LONG}"),
    "title": (f"<main><div><h1>T</h1></div>Own <i>text</i> <a href=x>here</a>.<div class=x><article><p>{LONG}</p></article></div></main>", f"T\n\nOwn text here.\n\n{LONG}"),
    "comment articles": (f"<body><article><h1>T</h1><p>{LONG}</p></article>{COMMENTS}", f"T\n\n{LONG}"),
    "comments in main": (f"<body><main><article><h1>T</h1><p>{LONG}</p></article>{COMMENTS}</main>", f"T\n\n{LONG}"),
    "comments in article": (f"<body><article><h1>T</h1><p>{LONG}</p>{COMMENTS}</article>", f"T\n\n{LONG}"),
    "role": (f"<body><main><p>{LONG}</p><article role=comment><p>{LONG * 5}</p></article></main>", LONG),
    "plain articles in comments": (f"<body><main><p>{LONG}</p><div id=comments><article><p>{LONG * 5}</p></article></div></main>", LONG),
    "only a comment": (f"<body><article class=comment><p>{LONG}</p></article>", LONG),
}


@pytest.mark.parametrize("name", PARTS)
def test_parts_and_comments(name):
    html, want = PARTS[name]
    assert X.main_text(html) == want


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    html, want = CASES[name]
    assert X.main_text(html) == want


def test_null_long_and_odd_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, None, None, "x", 1), (None, "u", "<p>a</p>", "x", 1), (2, "u", "<div>" * 20000 + "deep", "x", 1), (2, "u", "<p>a " * 20000, "x", 1),
            (3, "u", '<a "' * 20000, "x", 1), (4, "u", "<b>" * 5000 + "<p>x</p>" * 500, "x", 1)]
    got = X.extract(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows) and got[0].text == "" and got[1].text == "a" and got[2].text == "deep"
    assert got[3].text == "\n\n".join(["a"] * 20000) and got[5].text == "\n\n".join(["x"] * 500)
    assert X.extract(spark.createDataFrame([], schema)).count() == 0


def test_density_is_lower_for_links():
    text = X.main_text(f"<body><div><p>{LONG}</p><p>{LONG}</p></div><div>" + "<p><a href=x>some linked words that go on</a></p>" * 30 + "</div>")
    assert text == f"{LONG}\n\n{LONG}"


MARKS = ["id=disqus_thread", "class=user-comments", "id=reader-comments", "class=fb-comments", "class=comment-thread", "class=notice", "class=site-notice",
         "class=gdpr-message", "class='share'", "class=alert-message"]
LINKED = ["class=related-posts", "class=share-buttons"]


@pytest.mark.parametrize("mark", MARKS + LINKED)
@pytest.mark.parametrize("inside", [True, False])
def test_boxes_of_comments_and_notices(mark, inside):
    words = "<a href=x>One more of our stories</a> <a href=y>and another</a>" if mark in LINKED else "Some words that are not of the article, by a reader."
    box = f"<div {mark}><p>{words}</p></div>"
    html = f"<body><article><h1>T</h1><p>{LONG}</p>{box if inside else ''}<p>{LONG}</p></article>{'' if inside else box}</body>"
    assert X.main_text(html) == f"T\n\n{LONG}\n\n{LONG}"


@pytest.mark.parametrize("kept", ["<section id=discussion>{}</section>", "<div class='comments-enabled body'><p>{}</p><p>{}</p><p>{}</p></div>", "<h2 id=notice>{}</h2>",
                                  "<section id=comment-on-results><p>{}</p></section>", "<p class=notice-period>{}</p>", "<div class=notice-period>{}</div>"])
def test_subjects_and_wrappers_stay(kept):
    html = "<body><article><h1>T</h1>" + kept.replace("{}", LONG) + f"<p>{LONG}</p></article></body>"
    assert X.main_text(html) == "T\n\n" + "\n\n".join([LONG] * (kept.count("{}") + 1))
