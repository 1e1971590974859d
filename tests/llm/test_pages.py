"""HTML text, URL lists, WARC bundles, token shards and the pipeline."""

from __future__ import annotations

import hashlib
import io
import os
import re
import time
import tracemalloc
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urlparse

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import catalog, common, html_text, token_shards, urls, warc


@pytest.fixture(scope="module")
def pages(spark, data):
    return spark.read.parquet(f"{data}/pages.parquet")


@pytest.fixture(scope="module")
def odd_pages(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "http://a.com/x", big), (2, "http://a.com/y", big), (2, "http://a.com/y", big), (None, None, big), (3, None, None), (4, "bad url\r\nX: y", ""), (5, "https://u@B.org:80/p?q", "<p>short"), (6, "http://b.org", "<p>short"), (7, "http://a.com/z", "é😀" * 600)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(3)


CHROME = "<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li>Home</ul></nav><div class='cookie-notice'>We use cookies</div>{}<div class='comments'><p>Reader says a lot of things here, more than enough words to score well.</p></div><aside>side</aside><form><input> Subscribe</form><footer>foot</footer></body></html>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (CHROME.format("<article><h1>Title</h1><p>One &amp; two<br>three</p><p>  Four\n five </p></article>"), "Title\n\nOne & two three\n\nFour five"),
        (CHROME.format("<div class='post-12 main'><p>Some text that is long enough to be the main part.<ul><li>a<li>b</ul><table><tr><td>c<td>d</table></div>"), "Some text that is long enough to be the main part.\n\na\n\nb\n\nc\n\nd"),
        ("plain &lt;text&gt; <b>bold</b><!-- <p>no --> x", "plain <text> bold x"),
        ("<p>a<script>var t='</p><p>';</script>b", "ab"),
        ("", ""), ("<nav>only a menu</nav>", ""), ("<p>" * 3000 + "deep", "deep"), ("<div>" * 2000 + "deep", "deep"),
    ],
)
def test_own_text(html, text):
    assert html_text.main_text(html, None) == text


@pytest.mark.parametrize("tag", ['<p title="a"">', "<p title=it's>", "<p 'x>", '<p title = "a>b">', "<p title='a>\"b' data-x==\"y>", '<p title="a>'])
def test_stray_quotes_in_tags(tag):
    end = "" if tag == '<p title="a>' else "<a href=\"x\" title='y'>link</a>"
    assert html_text.main_text(f"<div>{tag}text{end}</div>", None) == "text" + ("link" if end else "")


def test_consensus_overrules_a_page(spark):
    """A page whose loudest container is not the article still gives the article, by the vote of its host."""
    good = "<body><div class='a'><p>{}</p></div><div class='b'><p>{}</p></div></body>"
    rows = [(i, "http://h.com/1", good.format("long main text of the page " * 9, "noise here " * 4)) for i in range(5)] + [(9, "http://h.com/2", good.format("short main text " * 8, "loud noise of other things here " * 10))]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9].startswith("short main") and "noise" not in got[9]


WORDS = "many words of the article itself " * 12


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<article><h1>Title</h1><p>intro</p><div class=entry-content>{WORDS}</div></article>", f"Title\n\nintro\n\n{WORDS.strip()}"),
        (f"<div class=post><h1>Title</h1><p>intro</p><div class=entry-content>{WORDS}</div></div>", f"Title\n\nintro\n\n{WORDS.strip()}"),
        (f"<main><h1>Title</h1><div class=row><article><p>{WORDS}</article></div></main><div>beside</div>", f"Title\n\n{WORDS.strip()}"),
        (f"<article class=first><p>short one</article><article class=second><p>{WORDS}</article>", f"short one\n\n{WORDS.strip()}"),
        (f"<article><div class=a><p>{WORDS}</div><div class=b><p>end</div></article>", f"{WORDS.strip()}\n\nend"),
    ],
)
def test_whole_article(html, text):
    """No score keeps a title, an introduction or a shorter part from the article."""
    assert html_text.main_text(html, None) == text


REMARK, MENU, FOOT = "a shorter closing remark of the author.", "<nav><a href=/>Home</a><a href=/b>News</a></nav>", "<footer>Imprint and contact</footer>"
#: Pages with the text that a reader would call the article's.
HAND_MADE = [
    ("social-enabled", f"<body class='social-enabled'>{MENU}<article><h1>T</h1><p>{WORDS}</article>{FOOT}</body>", f"T\n\n{WORDS.strip()}"),
    ("wrapper social-enabled", f"<div class='page social-enabled'><article><h1>T</h1><p>{WORDS}</article></div>", f"T\n\n{WORDS.strip()}"),
    ("tags-explained", f"<article class='tags-explained'><h1>T</h1><p>{WORDS}</article>", f"T\n\n{WORDS.strip()}"),
    ("notice-of-motion", f"<div id=notice-of-motion><h1>T</h1><p>{WORDS}</div>", f"T\n\n{WORDS.strip()}"),
    ("form round the page", f"<form id=aspnetForm>{MENU}<article><h1>T</h1><p>{WORDS}</article><input><button>Go</button></form>", f"T\n\n{WORDS.strip()}"),
    ("data-class", f"<div data-class='sidebar'><p>{WORDS}</div>", WORDS.strip()),
    ("title with id", f"<div title='id=\"menu\"'><p>{WORDS}</div>", WORDS.strip()),
    ("post-header h1", f"<article><div class=post-header><h1>T</h1></div><p>{WORDS}</article>", f"T\n\n{WORDS.strip()}"),
    ("entry-header h1", f"<article><header class=entry-header><h1>T</h1></header><p>{WORDS}</article>", f"T\n\n{WORDS.strip()}"),
    ("two sections", f"<article><section><p>{WORDS}</section><section><p>{REMARK}</section></article>", f"{WORDS.strip()}\n\n{REMARK}"),
    ("alpha beta", f"<body><div class=alpha><p>{WORDS}</div><div class=beta><p>{WORDS}</div></body>", f"{WORDS.strip()}\n\n{WORDS.strip()}"),
    ("sidebar after", f"<div class=content><h1>T</h1><p>{WORDS}</div><div class=sidebar><p>{REMARK}</div>", f"T\n\n{WORDS.strip()}"),
    ("comments", f"<article><p>{WORDS}</article><div id=comments><p>{WORDS}{WORDS}</div>", WORDS.strip()),
    ("comment-list in article", f"<article><p>{WORDS}<div class=comment-list><p>{REMARK}</div></article>", WORDS.strip()),
    ("cookie", f"<div class=cookie-banner>{REMARK}</div><main><p>{WORDS}</main>", WORDS.strip()),
    ("ads in article", f"<article><p>{WORDS}<div class=advert>Buy now</div><p>{REMARK}</article>", f"{WORDS.strip()}\n\n{REMARK}"),
    ("related", f"<main><p>{WORDS}<section class=related><h2>More</h2><a href=x>one</a></section></main>", WORDS.strip()),
    ("list article", f"<article><h2>H</h2><ol><li>{WORDS}<li>{REMARK}</ol></article>", f"H\n\n{WORDS.strip()}\n\n{REMARK}"),
    ("table layout", f"<table><tr><td class=nav><a href=x>a</a><td class=content><p>{WORDS}</table>", WORDS.strip()),
    ("data table", f"<article><p>{WORDS}<table><tr><th>k<th>v<tr><td>1<td>2</table></article>", f"{WORDS.strip()}\n\nk\n\nv\n\n1\n\n2"),
    ("pre", f"<article><p>{WORDS}<pre>x = 1\n  y</pre></article>", f"{WORDS.strip()}\n\nx = 1 y"),
    ("quote", f"<article><blockquote>{REMARK}</blockquote><p>{WORDS}</article>", f"{REMARK}\n\n{WORDS.strip()}"),
    ("figure", f"<article><figure><img src=x><figcaption>{REMARK}</figcaption></figure><p>{WORDS}</article>", f"{REMARK}\n\n{WORDS.strip()}"),
    ("entities", f"<article><p>&lt;b&gt; &amp;amp; &#233;&#x1F600; {WORDS}</article>", f"<b> &amp; é😀 {WORDS.strip()}"),
    ("nested mains", f"<div class=wrapper><div class=inner><main id=content><p>{WORDS}</main></div></div>", WORDS.strip()),
    ("no class", f"<body>{MENU}<div><p>{WORDS}<p>{REMARK}</div>{FOOT}</body>", f"{WORDS.strip()}\n\n{REMARK}"),
    ("body text", f"<body>{MENU}{WORDS}<br>{REMARK}{FOOT}</body>", f"{WORDS.strip()} {REMARK}"),
    ("newsletter form", f"<article><p>{WORDS}<form><p>Subscribe<input></form><p>{REMARK}</article>", f"{WORDS.strip()}\n\n{REMARK}"),
    ("script in p", f"<article><p>{WORDS[:50]}<script>x()</script>{WORDS[50:]}</article>", WORDS.strip()),
    ("noscript", f"<article><p>{WORDS}<noscript>turn on</noscript></article>", WORDS.strip()),
    ("share bar", f"<article><div class=share-buttons><a href=x>Tweet</a></div><p>{WORDS}</article>", WORDS.strip()),
    ("breadcrumbs", f"<div class=breadcrumbs><a href=x>Home</a> &gt; x</div><div class=post><h1>T</h1><p>{WORDS}</div>", f"T\n\n{WORDS.strip()}"),
    ("pagination", f"<div class=post><p>{WORDS}</div><div class=pagination><a href=2>2</a></div>", WORDS.strip()),
    ("aside in article", f"<article><p>{WORDS}<aside>{REMARK}</aside></article>", WORDS.strip()),
    ("multi articles", f"<main><article><h2>A</h2><p>{WORDS}</article><article><h2>B</h2><p>{REMARK}</article></main>", f"A\n\n{WORDS.strip()}\n\nB\n\n{REMARK}"),
    ("uppercase tags", f"<BODY><NAV>x</NAV><ARTICLE><P>{WORDS}</P></ARTICLE></BODY>", WORDS.strip()),
    ("unquoted and broken", f"<article class=post id=a1><p>{WORDS}</div></section><p>{REMARK}", f"{WORDS.strip()}\n\n{REMARK}"),
    ("comment markup", f"<article><!-- <p>hidden --><p>{WORDS}<!-- unclosed", WORDS.strip()),
    ("header of page", f"<header><h1>Site</h1></header><article><h1>T</h1><p>{WORDS}</article>", f"T\n\n{WORDS.strip()}"),
    ("intro div", f"<div class=story><div class=lead>{REMARK}</div><div class=body>{WORDS}</div></div>", f"{REMARK}\n\n{WORDS.strip()}"),
    ("dl", f"<article><dl><dt>k<dd>{WORDS}<dt>l<dd>{REMARK}</dl></article>", f"k\n\n{WORDS.strip()}\n\nl\n\n{REMARK}"),
    ("details", f"<article><p>{WORDS}<details><summary>More</summary>{REMARK}</details></article>", f"{WORDS.strip()}\n\nMore\n\n{REMARK}"),
    ("select", f"<article><p>{WORDS}<select><option>a<option>b</select></article>", WORDS.strip()),
    ("login", f"<div class=login-box>Sign in</div><article><p>{WORDS}</article>", WORDS.strip()),
    ("consent modal", f"<article><p>{WORDS}</article><div class='modal consent'><p>{REMARK}</div>", WORDS.strip()),
]


@pytest.mark.parametrize(("name", "html", "text"), HAND_MADE, ids=[x[0] for x in HAND_MADE])
def test_hand_made_pages(name, html, text):
    assert html_text.main_text(html, None) == text


DEEP = {
    "divs": "<div class=a>" * 40_000 + "x", "marked": "<div class=sidebar>" * 40_000 + "<main>x y z</main>", "inline": "<b><p>t</p>" * 40_000, "stray ends": "<div>" * 40_000 + "</span>" * 40_000, "beside": "<div class=x><section>word word</section>" * 20_000,
    "marked beside": "<div class=nav-x><section class=post>word word</section>" * 20_000, "lists": "<ul><li>x" * 30_000, "paragraphs": "<b>" * 40_000 + "<p>x" * 40_000,
}


@pytest.mark.parametrize("name", sorted(DEEP))
def test_deep_pages_take_linear_time_and_memory(name):
    html = DEEP[name]
    started = time.process_time()
    page = html_text.parsed(html)
    top = html_text.region(html_text.best(page))
    passed = html_text.passed_over(page, top)
    assert time.process_time() - started < 3  # a third of a second where nothing else runs
    assert sum(map(len, passed)) + len(top.path) < 2 * html_text.LONGEST_PATH * (len(passed) + 1)
    tracemalloc.start()
    html_text.main_text(html, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000, peak


class Plainly(HTMLParser):
    """A second reading of simple pages: the text of the first article in blocks, by the standard library's parser."""

    BLOCK = {"article", "p", "h1", "h2", "h3", "ul", "ol", "li", "div", "section", "blockquote", "pre", "table", "tr", "td", "th", "aside", "nav", "form", "footer", "figure", "figcaption"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.held, self.depth, self.skip = [], "", 0, 0

    def cut(self):
        text = re.sub(r"[\s\x00]+", " ", self.held).strip()
        self.held = ""
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        marked = tag in ("script", "style", "aside", "nav", "form", "footer") or self.depth and any(w in html_text.MARKS - {"header"} for k, v in attrs if k in ("class", "id") for w in re.findall("[a-z]+", (v or "").lower()))
        if self.skip or self.depth and marked:
            self.skip += tag not in html_text.VOID
        if tag in self.BLOCK:
            self.cut()
        if tag == "br":
            self.held += " "
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        if tag in self.BLOCK:
            self.cut()
        self.depth -= tag == "article"
        self.skip -= bool(self.skip)

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.held += data


def test_pages_by_a_second_extractor(pages):
    """Well-formed pages with one article: the same text, block for block."""
    got, seen = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}, 0
    for r in pages.collect():
        html = r["html"] or ""
        if html.count("<article") == html.count("</article>") == 1 and all(html.count(f"<{t}>") + html.count(f"<{t} ") == html.count(f"</{t}>") for t in ("p", "li", "div", "section", "td", "aside", "form")):
            p = Plainly()
            p.feed(html)
            p.close()
            seen += 1
            assert got[r["page_id"]] == "\n\n".join(p.blocks), r["page_id"]
    assert seen >= 5


def test_more_hosts_than_are_broadcast(spark, pages, odd_pages, monkeypatch):
    """Each task reads the winners of its own files' hosts; a table that is no scan of files is written first."""
    for df in (pages, odd_pages):
        want = Counter(map(tuple, html_text.extract(df).collect()))
        with monkeypatch.context() as m:
            m.setattr(html_text, "BROADCAST_HOSTS", 0)
            m.setattr(html_text, "BUCKET_ROWS", 3)
            out = html_text.extract(df)
            assert Counter(map(tuple, out.collect())) == want
            assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("wrapper", ["div class='layout has-sidebar'", "div class=no-sidebar", "div class='content-with-header'", "div class=page-social", "section class='related-content main'"])
@pytest.mark.parametrize("inner", ["<article><h1>Title</h1><p>{}</article>", "<main><h1>Title</h1><p>{}</main>", "<div><h1>Title</h1><p>{}</div>"])
def test_marked_wrappers(wrapper, inner):
    """A word of boilerplate in the class of a layout element doesn't hide the article; within it, and beside an article, it hides."""
    chrome = "<div class=sidebar>aside <a href=x>more</a></div>"
    html = f"<body><{wrapper}>{inner.format(WORDS)}{chrome}</{wrapper.split()[0]}>{chrome}</body>"
    assert html_text.main_text(html, None) == f"Title\n\n{WORDS.strip()}"
    comments = "<div class=comments><article class=comment><p>Reader says a lot</article><article><p>so does another</article></div>"
    assert html_text.main_text(f"<article><p>{WORDS}</article>{comments}", None) == WORDS.strip()


def test_several_marked_wrappers_and_the_hosts_vote():
    assert html_text.main_text(f"<body><div class=social><article><p>{WORDS}</article></div><div class=social><article><p>two</article></div></body>", None) == f"{WORDS.strip()}\n\ntwo"
    html = f"<body><div class=social><div class=entry><p>short text</div></div><div class=story><p>{WORDS}</div></body>"
    assert "short text" not in html_text.main_text(html, None)
    assert html_text.main_text(html, "body/div.social/div.entry", ["body/div.story"]) == "short text"


def test_short_and_long_parts_on_the_hosts_path(spark):
    """Containers on the host's path are all given; an own region that the host does not know as noise comes too."""
    rows = [(i, "http://h.com/1", f"<div class=a><p>{WORDS}</div>") for i in range(3)]
    rows += [(7, "http://h.com/2", f"<div class=a><p>{WORDS}</div><div class=a><p>end</div>"), (8, "http://h.com/3", f"<div class=a><p>{WORDS}</div><div class=other><p>{WORDS * 3}</div>")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == f"{WORDS.strip()}\n\nend" and got[8] == f"{WORDS.strip()}\n\n{(WORDS * 3).strip()}"


def test_pages(pages, odd_pages, spark):
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
        if r["html"] and "<article>" in r["html"]:
            assert got[r["page_id"]]["text"] and "track(" not in got[r["page_id"]]["text"]
    assert html_text.extract(odd_pages).count() == odd_pages.count() and html_text.extract(odd_pages.limit(0)).count() == 0


def test_winners_by_brute_force(pages):
    votes = {}
    for r in html_text.votes(pages).collect():
        v = votes.setdefault(r["host"], {}).setdefault(r["path"], [0, 0])
        v[0] += 1
        v[1] += r["chars"]
    want = {h: min(v, key=lambda p: (-v[p][0], -v[p][1], p)) for h, v in votes.items()}
    assert {r["host"]: r["path"] for r in html_text.winners(pages).collect()} == want


# --- URL lists


def test_lists_by_brute_force(spark, odd_pages):
    log = [("a.com", 10, 1, "block"), ("a.com", 20, 1, "allow"), ("a.com", 30, 1, "off"), ("com", 0, 0, "block"), ("b.org", 5, 0, "block"), ("b.org", 5, 1, "allow"), ("x.b.org/p", 7, 0, "block"), (None, 1, 0, "block"), ("a.com", None, 0, "block")]
    rows = [(i, u, d) for i, u in enumerate(["http://a.com/1", "http://z.a.com", "http://x.b.org/p/q", "https://X.B.org:8080/r", None, "nonsense", "http://a.com/1"]) for d in (0, 5, 7, 10, 15, 20, 25, 30, 99)]
    entries = spark.createDataFrame(log, "key string, day long, seq int, action string")
    got = Counter((r["page_id"], r["day"], r["matched_key"], r["action"], r["kept"]) for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string, day long"), entries).collect())
    want = Counter()
    for i, u, d in rows:
        p = urlparse(u or "")
        labels = (p.hostname or "").split(".")
        keys = ([f"{p.hostname}/{p.path.split('/')[1]}"] if p.hostname and p.path.strip("/") else []) + ([".".join(labels[a:]) for a in range(len(labels)) if a == 0 or len(labels) - a > 1] if p.hostname else [])
        verdict = (None, "none")
        for k in keys:
            active = max(((day, seq, a) for key, day, seq, a in log if key == k and day is not None and day <= d), default=None)
            if active and active[2] != "off":
                verdict = (k, active[2])
                break
        want[i, d, *verdict, verdict[1] != "block"] += 1
    assert got == want
    assert urls.judged(urls.dated_captures(odd_pages), entries).count() == odd_pages.count()
    assert urls.judged(urls.dated_captures(odd_pages.limit(0)), entries.limit(0)).count() == 0


def test_a_popular_domain(spark, monkeypatch):
    """A third of all captures under one domain, on one day: its rows stay where they are, and the rest meets by shuffle."""
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    rows = [(i, f"http://h{i}.popular.org/a" if i % 3 == 0 else f"http://h{i % 40}.d{i % 7}.com/b{i % 5}", 7 if i % 3 == 0 else i % 30) for i in range(900)]
    log = [("popular.org", 5, 0, "block"), ("popular.org", 9, 0, "off"), *((f"d{k}.com", k, 0, "block") for k in range(7)), ("h3.d3.com", 10, 0, "allow"), ("h5.d5.com/b0", 12, 0, "allow")]
    got = {r["page_id"]: (r["matched_key"], r["action"]) for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string, day long"), spark.createDataFrame(log, "key string, day long, seq int, action string")).collect()}
    for i, u, d in rows:
        host, segment = urlparse(u).hostname, u.rsplit("/", 1)[1]
        keys = [f"{host}/{segment}", host, host.split(".", 1)[1]]
        active = [(k, max((day, a) for key, day, _, a in log if key == k and day <= d)[1]) for k in keys if any(key == k and day <= d for key, day, _, _ in log)]
        want = next(((k, a) for k, a in active if a != "off"), (None, "none"))
        assert got[i] == want, (u, d)


def test_hosts(spark):
    shown = {"http://[2001:db8::1]:80/x": "[2001:db8::1]", "https://A.b.ORG./p": "a.b.org", "http://u:p@c.com:8/": "c.com", "ftp://10.0.0.1/q": "10.0.0.1", "nonsense": "", "http://..": ""}
    df = spark.createDataFrame([(u,) for u in shown], "url string").select("url", urls.host_of(F.col("url")).alias("h"))
    assert {r["url"]: r["h"] for r in df.collect()} == shown
    entries = spark.createDataFrame([("0.0.1", 0, 0, "block"), ("10.0.0.1", 5, 0, "block"), ("[2001:db8::1]", 0, 0, "block")], "key string, day long, seq int, action string")
    rows = spark.createDataFrame([(i, u, d) for i, u in enumerate(shown) for d in (1, 6)], "page_id long, url string, day long")
    assert {(r["url"], r["day"]) for r in urls.judged(rows, entries).collect() if not r["kept"]} == {("http://[2001:db8::1]:80/x", 1), ("http://[2001:db8::1]:80/x", 6), ("ftp://10.0.0.1/q", 6)}


@pytest.mark.parametrize("name", ["op8_url_temporal_lists", "op9_warc_seekable"])
def test_oracles(spark, data, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    cur = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in cur.description]
    df = catalog.QUERIES[name](spark, data)
    assert sorted(map(str, (tuple(r[n] for n in sorted(names)) for r in df.collect()))) == sorted(map(str, (tuple(r[names.index(n)] for n in sorted(names)) for r in cur.fetchall())))


# --- WARC


def plain_records(rows) -> Counter:
    latest = {}
    for p, b in rows:
        latest[b] = max(latest.get(b, -1), -1 if p is None else p)
    want = Counter()
    for p, b in rows:
        top = latest[b]
        revisit = len(b) >= 1000 and top >= 0 and (p is None or p < top)
        want[p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None] += 1
    return want


@pytest.mark.parametrize("how", ["few", "many", "hot"])
def test_round_trip(odd_pages, monkeypatch, how):
    monkeypatch.setattr(warc, "FRAME_BYTES", 3000)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 600)
    if how != "few":
        monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(warc, "HOT_ROWS", 1 if how == "hot" else 100)
        monkeypatch.setattr(warc, "BUCKET_ROWS", 1)
    index = warc.write(odd_pages)
    got = Counter(map(tuple, warc.read(index).collect()))
    assert got == plain_records([(r["page_id"], (r["html"] or "").encode()) for r in odd_pages.collect()])
    # one record by its index entry, and a whole bundle by a reader that knows nothing of the seek table
    entries = {e["record_id"]: e for e in index.collect()}
    assert len(entries) == odd_pages.count(), "identifiers are unique"
    for e in entries.values():
        headers, _, payload, _ = warc.fetch(e["bundle"], e["frame_offset"], e["frame_bytes"], e["offset_in_frame"])
        assert headers["WARC-Record-ID"] == e["record_id"] and headers["WARC-Type"] == e["record_type"] and headers["WARC-Payload-Digest"][5:] == e["payload_digest"]
        if headers["WARC-Type"] == "response":
            assert hashlib.sha1(payload).hexdigest() == e["payload_digest"]
        else:
            named = entries[headers["WARC-Refers-To"]]
            assert named["record_type"] == "response" and named["payload_digest"] == e["payload_digest"]
    path = urlparse(index.first()["bundle"]).path
    with open(path, "rb") as f:
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read()), read_across_frames=True).read()
    assert plain.startswith(b"WARC/1.1\r\n") and plain.endswith(b"\r\n\r\n")
    assert warc.round_trip(odd_pages.limit(0)).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_a_popular_payload_and_tasks(spark, monkeypatch, tmp_path, few):
    """A third of all rows have one payload: no task gets them all, payloads aren't shuffled, and bundles are read by a task each."""
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 20_000)
    monkeypatch.setattr(warc, "FRAME_BYTES", 40_000)
    if not few:
        monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(warc, "HOT_ROWS", 50)
    html = lambda i: ("popular " * 200 if i % 3 == 0 else f"{i // 2} " + "".join(hashlib.sha256(f"{i // 2}:{k}".encode()).hexdigest() for k in range(30)))
    rows = [(i, f"http://a.com/{i}", html(i)) for i in range(600)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6).write.parquet(f"{tmp_path}/pages")
    pages = spark.read.parquet(f"{tmp_path}/pages")
    index = warc.write(pages)
    read = warc.read(index)
    assert Counter(map(tuple, read.collect())) == plain_records([(i, h.encode()) for i, _, h in rows])
    assert read.rdd.getNumPartitions() == index.select("bundle").distinct().count() > 8
    # no exchange carries a payload
    repeats = warc._repeats(pages)
    plan = warc._responses(pages, repeats, few)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


# --- token shards


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_slots_are_a_permutation(n):
    got = token_shards.permuted(np.arange(n), n)
    assert sorted(got.tolist()) == list(range(n))
    if n > 100:
        assert (got != np.arange(n)).mean() > 0.9 and (token_shards.permuted(np.arange(n), n, 7) != got).mean() > 0.9


@pytest.fixture(scope="module")
def small_vocabulary():
    import public_tokenizers

    return token_shards.Vocabulary(catalog.vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.mark.parametrize("tasks", [1, 3, 50_000])
def test_order_of_tokens_and_documents(spark, documents, odd, small_vocabulary, monkeypatch, tmp_path, tasks):
    """Against streams laid out by hand: partition by partition, each document and its end, cut into sequences, and each sequence in its slot."""
    monkeypatch.setattr(token_shards, "SHARD_ROWS", 16)
    monkeypatch.setattr(token_shards, "WRITE_TASKS", tasks)
    documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).repartition(5).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    encode, end, size = small_vocabulary.encoding().encode_ordinary, small_vocabulary.end, token_shards.SEQUENCE
    parts: dict[int, list] = {}
    for p, i, text in docs.select(F.spark_partition_id(), "doc_id", "text").collect():
        parts.setdefault(p, []).append((i, [*encode(text or ""), end]))
    plain = []
    for p in sorted(parts):
        stream, owners = [], []
        for k, (_, ids) in enumerate(parts[p]):
            stream += ids
            owners += [k] * len(ids)
        for a in range(0, len(stream), size):
            ids = stream[a : a + size]
            plain.append((ids + [end] * (size - len(ids)), len(ids), [parts[p][k][0] for k in sorted(set(owners[a : a + size]))]))
    slots = token_shards.permuted(np.arange(len(plain)), len(plain))
    rows = {r["slot"]: r for r in token_shards.materialised(docs, small_vocabulary).collect()}
    manifest = {r["shard"]: r["path"] for r in rows.values()}
    read = list(token_shards.read_from(manifest, 0, len(plain)))
    for slot, (ids, n, names) in zip(slots.tolist(), plain):
        assert read[slot].tolist() == ids and rows[slot]["n_tokens"] == n and rows[slot]["doc_ids"] == names


def test_shards(odd, none, documents, small_vocabulary, monkeypatch):
    monkeypatch.setattr(token_shards, "SHARD_ROWS", 64)
    for df in (odd, documents):
        rows = token_shards.materialised(df, small_vocabulary)
        held = sorted(rows.collect(), key=lambda r: r["slot"])
        total = len(held)
        assert [r["slot"] for r in held] == list(range(total))
        manifest = {r["shard"]: r["path"] for r in held}
        stride = token_shards.SEQUENCE * 2
        assert all(r["shard"] == r["slot"] // 64 and r["byte_offset"] == r["slot"] % 64 * stride for r in held)
        read = list(token_shards.read_from(manifest, 0, total))
        assert [hashlib.sha256(x.tobytes()).hexdigest() for x in read] == [r["ids_sha256"] for r in held]
        middle = total // 2
        assert all((a == b).all() for a, b in zip(token_shards.read_from(manifest, middle, total), read[middle:]))
        encode = small_vocabulary.encoding().encode_ordinary
        want = Counter(i for r in df.collect() for i in encode(r["text"] or ""))
        got = Counter(int(i) for r, x in zip(held, read) for i in x[: r["n_tokens"]])
        assert got.pop(small_vocabulary.end) == df.count() and got == want
        assert all(os.path.getsize(urlparse(p).path) % stride == 0 for p in manifest.values())
        assert {d for r in held for d in r["doc_ids"]} == {r["doc_id"] for r in df.collect()}
    assert token_shards.materialised(none, small_vocabulary).count() == 0


# --- the pipeline


def test_pipeline_stages(spark, data, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    n = docs.count()
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert sorted(out.columns) == sorted(docs.columns), name
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        assert 0 < docs.count() <= n
        n = docs.count()
    assert "@mail" not in "".join(r["text"] for r in docs.collect())
    last = p.STAGES[-1][1](spark, docs, data)
    assert last.count() == n
    assert sorted(map(tuple, p.run(spark, data).collect())) == sorted(map(tuple, last.collect()))


def test_pipeline_of_odd_and_no_rows(spark, odd, none, data):
    import corpus_pipeline as p

    for docs in (odd, none):
        for name, stage in p.STAGES:
            docs = stage(spark, docs, data)
            docs.count()
