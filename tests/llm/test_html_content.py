import html as entities
import re
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from screenspark.llm import html_content
from screenspark.llm.html_content import blocks_of, main_text

FOLDER = "/root/testdata/sf0.01"
BODY = "<p>The first paragraph of the article, which is long enough.</p><p>Short.</p><p>And a third one; it has marks, too.</p>"
TEXT = "The first paragraph of the article, which is long enough.\n\nShort.\n\nAnd a third one; it has marks, too."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("   \n", ""),
        ("just text &amp; more", "just text & more"),
        (f"<article><h1>Title</h1>{BODY}</article>", "Title\n\n" + TEXT),
        (f"<nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><main>{BODY}</main><footer>&copy; us</footer>", TEXT),
        (f"<div class='cookie-notice'>We use cookies, you know.</div><div id=content>{BODY}</div><div class='comments'><p>Nice article, thank you so much.</p></div>", TEXT),
        (f"<header><h2>Site</h2></header><aside><p>Sidebar text, rather long, with marks.</p></aside><section>{BODY}</section><form><p>Name: <input></p></form>", TEXT),
        (f"<script>var t='<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><div>{BODY}</div><script>unclosed", TEXT),
        ("<div><p>One <b>bold</b>\n and <i>it<br>alic</i>&nbsp;end.<p>Two &lt;b&gt; &#233;.</div>", "One bold and it alic end.\n\nTwo <b> é."),
        (f"<div class=ad>Buy, now!</div><article class='post comments-open'>{BODY}</article>", TEXT),
        ("<table><tr><td>Cell one, long enough to be text.<td>Cell two, long enough to be text.</table>", "Cell one, long enough to be text.\n\nCell two, long enough to be text."),
        ("<p>a < b and c > d, as ever", "a < b and c > d, as ever"),
        (f"<html><head><title>T</title><body>{BODY}</html>", TEXT),
        (f"<div hidden><p>Secret text, quite long indeed.</p></div>{BODY}", TEXT),
    ],
)
def test_page(page, text):
    assert main_text(page) == text


PARAGRAPHS = ["One, two. " + f"paragraph {k} of the article, with words. " * 9 for k in range(10)]
INNER = [
    "<ul>" + "".join(f"<li>Item {k} of a short list" for k in range(8)) + "</ul>",
    "<table><caption>Caption</caption><tr><th>Head<th>Two<tr><td>1<td>2</table>",
    "<dl><dt>Term<dd>Its meaning</dl>",
    "<figure><img src=x><figcaption>A caption</figcaption></figure>",
    "<pre>x = 1</pre><blockquote><p>Quoted.</p></blockquote><div class=note><p>Short.</p></div>",
]


@pytest.mark.parametrize("opening, closing", [("<article>", "</article>"), ("<div id=text>", "</div>"), ("<article><h1>T</h1><div>", "</div></article>"), ("<main><section>", "</section></main>")])
@pytest.mark.parametrize("inner", INNER)
def test_short_blocks_in_an_article_stay(opening, closing, inner):
    half = ["".join(f"<p>{p}</p>" for p in PARAGRAPHS[a : a + 5]) for a in (0, 5)]
    page = f"<body><div id=outside>Some words</div>{opening}{half[0]}{inner}{half[1]}{closing}<ul><li>Outside too</ul></body>"
    blocks, _ = blocks_of(f"{half[0]}{inner}{half[1]}")
    assert main_text(page) == "\n\n".join((["T"] if "<h1>" in opening else []) + [text for _, text, _ in blocks])


@pytest.mark.parametrize("opening, closing", [("<body>", "</body>"), ("<div><div>", "</div></div>")])
def test_lists_between_paragraphs_stay(opening, closing):
    wrapped = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    if opening != "<body>":
        wrapped = f"<div>{wrapped}</div>"
    assert main_text(f"{opening}{wrapped}<ul><li>a</ul>{closing}").endswith("\n\na")


@pytest.mark.parametrize(
    "opening, closing",
    [
        ("<div class='content has-sidebar'>", "</div>"),
        ("<main class='no-sidebar'>", "</main>"),
        ("<main class='sidebar'>", "</main>"),
        ("<div id='content-sidebar-wrap'><div>", "</div></div>"),
        ("<form id=form1 action=x>", "</form>"),
        ("<form><div class='widget'><article>", "</article></div></form>"),
        ("<div class='search'>", "</div>"),
        ("<article><h1>T</h1><div class='side'>", "</div></article>"),
    ],
)
def test_wrappers_of_the_content_are_read(opening, closing):
    comments = "<div class='comments'><p>Nice, thanks.</p></div><form class=search><p>Search here</p></form>"
    page = f"<body><p>Tag line</p>{opening}<h1>Title</h1>{BODY}{BODY}{BODY}{comments}{closing}</body>"
    text = main_text(page)
    assert text.endswith("\n\n".join(["Title", TEXT, TEXT, TEXT]))


@pytest.mark.parametrize("name", ["comments", "post-comments", "comments-area", "cookie-notice", "site-footer", "ad-slot 2", "related"])
def test_named_parts_beside_the_content_are_left_out(name):
    other = f"<div class='{name}'>" + "<article><p>A long remark, with marks.</p></article>" * 90 + "</div>"
    assert main_text(f"<main><h1>Title</h1>{BODY}{other}</main>") == "Title\n\n" + TEXT
    assert main_text(f"<article>{BODY}</article>{other}") == TEXT


@given(st.lists(st.sampled_from(["<", ">", "<p>", "</p>", "<div class='", "\"", "'", "<a href=", "</a>", "x ", "&amp;", "<!--", "-->", "<script>", "</script>", "<b>", "<nav>", "</nav>", "/>", "<![CDATA[", "é", "<li>", "</ul>", "<body>", "<html>", "<td>"]), max_size=40).map("".join))
def test_any_markup_is_read(page):
    blocks, paths = blocks_of(page)
    assert all(text == " ".join(text.split()) and text for _, text, _ in blocks)
    main_text(page)


@pytest.mark.parametrize("part", ["<div>x", "<b>x", "<a \"", "<a", "<![CDATA[>", "<!--", "</p>", "<p>word ", "<li><a href='x'>y</a>", "<"])
def test_long_pages_take_linear_time(part):
    start = time.process_time()
    main_text(part * (400_000 // len(part)))
    assert time.process_time() - start < 30


def test_articles_of_the_given_pages(spark):
    from screenspark.llm import html_content

    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    sources = {r.page_id: r.html for r in pages.collect()}
    for r in html_content.page_texts(pages).collect():
        article = re.search(r"<article>(.*)</article>", sources[r.page_id], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article).replace("<br>", " "))
        expected = [t for t in (re.sub(r"\s+", " ", entities.unescape(p)).strip() for p in parts) if t]
        assert r.text == "\n\n".join(expected) and r.n_chars == len(r.text)


def test_rows_and_columns(spark):
    from screenspark.llm import html_content

    df = spark.createDataFrame([(1, "u", None, "old"), (1, "u", None, "old"), (None, None, f"<p>{BODY}", "x")], "page_id bigint, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_content.extracted(df).collect()) == [(0, TEXT, len(TEXT)), (1, "", 0), (1, "", 0)]
    assert html_content.page_texts(df.limit(0)).count() == 0


SENTENCES = "<p>" + "This is a sentence, and it goes on for quite a while. " * 5 + "</p>"


@pytest.mark.parametrize("inside", [
    "<script>var x = 'no';</script>", "<svg><path d='x'/><text>no</text></svg>", "<label>no</label>", "<button type=button>no <b>no</b></button>",
    "<select><option>no<option>no</select>", "<input value=no>", "<style>p { no }</style>", "<noscript>no</noscript>", "<video src=x>no <b>no</b></video>",
])
def test_left_out_parts_of_running_text_leave_it_whole(inside):
    found = main_text(f"<article><p>Hello {inside}world, it goes <b>on{inside}</b> here.</p>{SENTENCES}</article>")
    assert found.split("\n\n")[0] == "Hello world, it goes on here."


def test_unclosed_parts_end_with_the_element_around_them():
    found = main_text(f"<article><div>{SENTENCES}Before <label>no</div><p>After, it goes on.</p>{SENTENCES}</article>")
    assert "no" not in found.split() and "After, it goes on." in found.split("\n\n")


def test_article_header_with_the_only_main_heading_stays():
    page = "<body><header><h1>Site</h1><p>slogan</p></header><article><header>{}</header>" + SENTENCES * 3 + "<footer>foot</footer></article></body>"
    assert main_text(page.format("<h1>Title</h1>")).startswith("Title\n\nThis is")
    assert main_text(page.format("<p>By somebody</p>")).startswith("This is")
    assert main_text(page.format("<h1>One</h1>").replace("<footer>", "<h1>Two</h1><footer>")).startswith("This is")


def test_names_of_headings_and_topics_stay_in_an_article():
    for part in ("<h2 id='related-work'>Related work</h2>", "<h2 id='comments-on-method'>Comments</h2>"):
        assert part.split(">")[1].split("<")[0] in main_text(f"<article><h1>T</h1>{SENTENCES}{part}{SENTENCES}</article>").split("\n\n")
    prose = "<p>" + "Social history, as it was written then. " * 6 + "</p>"
    assert "as it was written" in main_text(f"<article>{SENTENCES * 3}<div class='social-history'>{prose}</div></article>")
    for name in ("social-links", "related-posts", "comments-area", "comment-thread", "share-buttons"):
        assert "as it was written" not in main_text(f"<article>{SENTENCES * 3}<div class='{name}'>{prose}</div></article>")
    links = "<ul><li><a href=x>One other story</a><li><a href=y>And another</a></ul>"
    assert "other story" not in main_text(f"<article>{SENTENCES * 3}<div class='related-reading'>{links}</div></article>")


def test_references_stay_and_menus_go():
    works = "<li><a href=x>A. Writer, Some paper, a journal, 1999.</a></li><li><a href=y>B. Writer, Another, 2001.</a></li>"
    menu = "<ul><li><a href=x>First page</a></li><li><a href=y>Next page</a></li></ul>"
    for form in ("ol", "ul"):
        found = main_text(f"<article>{SENTENCES * 3}<h2>References</h2><{form}>{works}</{form}></article>{menu}")
        assert found.endswith("References\n\nA. Writer, Some paper, a journal, 1999.\n\nB. Writer, Another, 2001.")
    assert "page" not in main_text(f"<article>{SENTENCES * 3}{menu}</article>")


def plain_kept(blocks):
    """Paths kept, computed from (path of tags, text) blocks under one div of the page, by the definition."""
    def ratio(path):
        own = [t for p, t in blocks if p == path]
        return sum(len(t) + 10 * sum(t.count(m) for m in ".,;:!?") for t in own) / len(own)

    paths = list(dict.fromkeys(p for p, _ in blocks))
    order = [p for k, (p, _) in enumerate(blocks) if not k or blocks[k - 1][0] != p]
    smooth = {}
    for p in paths:
        beside = [ratio(order[j]) for i, q in enumerate(order) if q == p for j in (i - 1, i + 1) if 0 <= j < len(order)]
        smooth[p] = 0.75 * ratio(p) + 0.25 * (sum(beside) / len(beside) if beside else ratio(p))
    fused = {p: 0.5 * smooth[p] / max(smooth.values()) + 0.5 for p in paths}  # one container: all have its share
    return {p for p in paths if fused[p] >= 0.25 * max(fused.values())}, fused


def test_ratios_against_the_definition(monkeypatch):
    blocks = [("h2", "A title"), *[("p", "A sentence, as long as others are. " * k) for k in (3, 5, 2)], ("h3", "Next"), ("p", "It ends here."), ("h2", "More"), ("p", "Last words, then.")]
    page = "<html><body><div>" + "".join(f"<{t}>{x}</{t}>" for t, x in blocks) + "</div></body></html>"
    blocks = [(t, x.strip()) for t, x in blocks]
    for least in (0.25, 0.6, 0.8, 0.95):
        monkeypatch.setattr(html_content, "LEAST_SCORE", least)
        _, fused = plain_kept(blocks)
        kept = {p for p, s in fused.items() if s >= least * max(fused.values())}
        assert main_text(page) == "\n\n".join(x for t, x in blocks if t in kept)
