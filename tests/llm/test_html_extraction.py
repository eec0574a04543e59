"""Extraction: planted articles come back whole, and paths of a host agree."""

from sheetmill.llm import html_extraction as H

P1 = "The first paragraph runs on for a while, so that it weighs enough to be an article."
P2 = "A second one with <b>bold</b> words &amp; an&nbsp;entity &lt;here&gt;, and\n  a line\tbreak."
WANT2 = "A second one with bold words & an entity <here>, and a line break."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>No title</title><style>p{{}}</style><script>var t='</p><p>no';</script>{head}</head><body class='has-sidebar'>{body}</body></html>"


NOISE = (
    "<nav><ul><li><a href='/'>Home</a></li></ul></nav><!-- <p>no comment</p> --><div class='ad'>Buy this now. It is a long advert, longer than you think, really.</div>"
    "<header><h1>Site</h1></header><form><p>Type here.</p></form><div class='cookie-notice'>We use cookies here on this site.</div>"
)
END = "<section class='comments'><article class='comment-12'><p>A reader wrote this comment, at some length, too.</p></article></section><footer>&copy; site</footer>"


def test_article_alone():
    got = H.text_at(page(f"{NOISE}<article><h1>Head</h1><p>{P1}</p><p>{P2}</p><ul><li>one<li>two</ul></article>{END}"), None)
    assert got == f"Head\n{P1}\n{WANT2}\none\ntwo"


def test_unclosed_and_broken_markup():
    got = H.text_at(f"<body><article><h1>T</h1><p><b>{P1}<br><p>{P1} 1 < 2 and 3 > 2.<p title=\"a>b\">x<br>y</article><footer>end", None)
    assert got == f"T\n{P1}\n{P1} 1 < 2 and 3 > 2.\nx y"
    assert H.text_at(f"<p>{P1}</p><p>cut <a href=\"/no", None) == f"{P1}\ncut"


def test_nothing():
    for raw in ("", "   ", "<html></html>", "<nav>menu</nav>", "<script>x", "<!-- open", "<p", "<"):
        assert H.text_at(raw, None) in ("", "<")
    assert H.text_at("plain text only", None) == "plain text only"


def test_very_long_page():
    body = "".join(f"<p>{P1}</p>" for _ in range(20_000))
    assert H.text_at(page(f"<article>{body}</article>"), None).count("\n") == 19_999
    assert H.text_at("<" * 100_000, None) is not None
    assert H.text_at("<a '" * 20_000, None) is not None


def test_parts_of_an_article_beside_its_largest_box():
    long = f"<p>{P1}</p>" * 9
    nested = f"<article class='w-1/2'><h1>Head</h1><p>Lead.</p><div class='body'>{long}</div><p>Last.</p></article>"
    listed = "<main><h1>Head</h1><p>Lead.</p><ul>" + f"<li>{P1}" * 9 + "</ul><p>Last.</p></main>"
    for story in (nested, listed):
        blocks, paths = H.read_blocks(page(f"{NOISE}<div>{story}</div>{END}"))
        assert paths[H.best_container(blocks, paths)[0]].rpartition("/div/")[2] in ("article.w-#/#", "main")
        assert H.text_at(page(f"{NOISE}<div>{story}</div>{END}"), None) == "\n".join(["Head", "Lead."] + [P1] * 9 + ["Last."])


def test_host_consensus(spark):
    story = f"<div class='post-7 story'><p>{P1}</p><p>{P1}</p></div>"
    rows = [(i, f"http://a.example/{i}", page(f"<div class='x'><p>Short.</p></div>{story.replace('7', str(i))}")) for i in range(9)]
    # Here another box is longer, but the host's pages agree on the story.
    rows.append((9, "http://A.example/9", page(f"<div class='x'><p>{P1}</p><p>{P1}</p><p>{P1}</p><p>{P1}</p><p>{P1}</p><p>{P1}</p><p>{P1}</p><p>{P1}</p><p>{P1}</p></div>{story}")))
    rows += [(10, None, f"<article><p>{P1}</p></article>"), (11, "http://b.example", None), (12, "http://b.example", ""), (12, "http://b.example", "")]
    df = spark.createDataFrame([(*r, "p") for r in rows], "page_id long, url string, html string, path string").repartition(3)
    got = {}
    for r in H.extract_main_text(df).collect():
        got.setdefault(r.page_id, []).append((r.url, r.text, r.n_chars))
    for i in range(10):
        assert got[i] == [(rows[i][1], f"{P1}\n{P1}", 2 * len(P1) + 1)]
    assert got[10] == [(None, P1, len(P1))] and got[11] == [("http://b.example", "", 0)] and len(got[12]) == 2
    assert H.extract_main_text(df.limit(0)).collect() == []


def test_articles_in_containers_with_doubtful_names():
    two = f"<p>{P1}</p><p>{P1}</p>"
    for box in ("div class='discussion'", "div id='search results'", "form id='page'", "section class='widget'", "div class='comments'", "article class='comment-1'"):
        tag = box.split()[0]
        assert H.text_at(f"<body><nav><a href='/'>Home</a></nav><{box}>{two}</{tag}></body>", None) == f"{P1}\n{P1}", box
        assert H.text_at(f"<body><h1>Head</h1><{box}>{two}</{tag}></body>", None).endswith(f"{P1}\n{P1}"), box
    # A short article beside a longer notice.
    assert H.text_at(f"<article><p>Short text</p></article><div class='cookie-notice'>{two}</div>", None) == "Short text"
    assert H.text_at(f"<article><p>Short text.</p></article><div class='cookie-notice'>{two}</div>", None) == "Short text."
    assert H.text_at("<article><p>Short text</p></article><div class='cookie-notice'>We use cookies here, on this site.</div>", None) == "Short text"
    # A form around the whole page, with a widget and comments inside.
    inner = f"<h1>Head</h1>{two}{two}{two}<div class='widget'><p>Seen also here.</p></div><div class='comments'>{two}</div>"
    assert H.text_at(page(f"<form id='all'><div>{inner}</div></form>"), None) == "\n".join(["Head"] + [P1] * 6)
    # Long comments under a short article stay out; so does a doubtful box that is not nearly all.
    assert H.text_at(page(f"<article><p>{P1}</p></article><div class='comments'>{two * 9}</div>"), None) == P1
    assert H.text_at(page(f"<article>{two}</article><div class='related'>{two}</div>"), None) == f"{P1}\n{P1}"


def test_end_tags_left_out_take_no_text_along():
    two = f"<p>{P1}</p><p>{P1}</p>"
    for odd in ("<button>", "<title>", "<select><option>", "<object>", "<iframe>", "<noscript>", "<svg>", "<textarea>", "<video>"):
        text = H.text_at(f"<body><article>{two}{odd}{two}<button>Send</button></article>", None)
        assert text == "\n".join([P1] * 4), odd
    closed = "<button>Send <b>now</b></button><select><option>one</option></select><svg><title>Icon</title><text>x</text></svg><object>old</object><noscript><p>No script.</p></noscript>"
    assert H.text_at(f"<body><article><p>{P1}</p>{closed}<p>{P1}</p></article>", None) == f"{P1}\n{P1}"


def test_formulas_stay():
    formula = "<math><mi>a</mi><mo>=</mo><mi>b</mi><annotation encoding='x'>a = b</annotation></math>"
    assert H.text_at(f"<article><p>{P1}</p><p>where {formula} holds.</p></article>", None) == f"{P1}\nwhere a=b holds."


def test_real_pages_against_another_parser(spark):
    """The test tables' articles, read by the standard library's parser, which shares no code with ours."""
    import os
    from html.parser import HTMLParser

    import pytest

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.runs = 0, [[]]

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            if tag == "br":
                self.runs[-1].append(" ")
            elif tag not in ("b", "i", "a", "em", "span"):
                self.runs.append([])

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            if tag not in ("b", "i", "a", "em", "span"):
                self.runs.append([])

        def handle_data(self, data):
            if self.inside:
                self.runs[-1].append(data)

    folder = "/root/testdata/sf0.01"
    if not os.path.exists(f"{folder}/pages.parquet"):
        pytest.skip("no test tables")
    rows = spark.read.parquet(f"{folder}/pages.parquet")
    want = {}
    for r in rows.collect():
        parser = Article()
        parser.feed(r.html or "")
        parser.close()
        want[r.page_id] = "\n".join(t for t in (" ".join("".join(run).split()) for run in parser.runs) if t)
    got = {r.page_id: r.text for r in H.extract_main_text(rows).collect()}
    assert got == want and all(want.values())


def test_links_and_inline_elements_with_listed_names():
    story = f"<article><h1>Head</h1><p>{P1}</p></article>"
    assert H.text_at(f"<body><a class='skip-nav' href='#m'>Skip</a>{story}</body>", None) == f"Head\n{P1}"
    assert H.text_at(f"<body>{story.replace('<h1>', '<a hidden>x</a><h1>')}</body>", None) == f"Head\n{P1}"
    assert H.text_at(f"<div><a class='social'>Tweet</a><p>{P1}</p><p>{P1}</p></div>", None) == f"{P1}\n{P1}"
    assert H.text_at(f"<p>See the <a class='related'>earlier study</a> for more. {P1}</p>", None) == f"See the earlier study for more. {P1}"
    assert H.text_at(f"<article><p>One <span hidden>x <span>y</span> z</span> two.</p><p>{P1}</p></article>", None) == f"One two.\n{P1}"
    assert H.text_at(f"<article><p>One <b hidden>x</p><p>{P1}</p></article>", None) == f"One\n{P1}"


def test_pages_without_an_article_keep_heading_and_lead():
    body = "".join(f"<p>{P1}</p>" for _ in range(6))
    want = "\n".join(["Head", "The lead."] + [P1] * 6)
    assert H.text_at(page(f"<div class=post><h1>Head</h1><p>The lead.</p><div class=body>{body}</div></div>{END}"), None) == want
    links = "<ul><li><a href='/1'>Some other story</a><li><a href='/2'>And one more story</a></ul>"
    assert H.text_at(page(f"<div class=page><div class=post><h1>Head</h1><p>The lead.</p><div class=body>{body}</div></div>{links}</div>{END}"), None) == want


def test_names_inside_an_article():
    parts = f"<div class='page-header'><h1>Head</h1></div><p>{P1}</p><section id='related-work'><p>{P1}</p><p>{P1}</p></section>"
    gone = "<div class='related'><a href='/1'>One more</a> <a href='/2'>Another</a></div><div class='ad'>Buy this now, at once.</div><form><p>Type here.</p></form><div class='comments'><p>I liked it.</p></div>"
    assert H.text_at(page(f"{NOISE}<article>{parts}{gone}</article>{END}"), None) == "\n".join(["Head"] + [P1] * 3)


def test_broken_and_deep_markup_takes_linear_time():
    import time
    import tracemalloc

    n = 1_000_000
    pages = ["<p " * (n // 3), '<a "' * (n // 4), '<a ">" ' * (n // 7), "<a '\">" * (n // 6), "<div>" * 100_000 + P1, "<form>" * 50_000 + P1, "<span hidden>" * 50_000 + "<div>x" * 20_000]
    pages += ["<li><ul>" + "<div>" * 30_000 + "<li>x</li>" * 30_000, "<title>" * 50_000, "<svg><button>" * 50_000, "<!-- " * 100_000, "</x>" * 200_000, "<div><p>x</x>" * 30_000, "<" * n]
    for raw in pages:
        if raw.startswith(("<div>", "<form>", "<span")):
            tracemalloc.start()
        began = time.process_time()
        H.text_at(raw, "/div/div")
        H.best_container(*H.read_blocks(raw))
        assert time.process_time() - began < 30, raw[:20]
        if tracemalloc.is_tracing():
            assert tracemalloc.get_traced_memory()[1] < 200e6, raw[:20]
            tracemalloc.stop()
