"""HTML text, URL filters and WARC."""

import hashlib
import math
import random
import re
import time

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from marlstone.llm import html_text, url_filter, warc
from marlstone.llm.html_text import main_text

SCHEMA = "page_id long, url string, html string, host string, rule string, verdict string, file string, text string, n_chars string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "h", "r", "v", "f", "t", "n") for r in rows], SCHEMA)


PARTS = ["This is the first paragraph of the article, long enough to be dense with text.", "The second paragraph goes on at some length about the same matter & more.", "A third closes the piece with a few more words, and that is all there is."]


def page(body, head=""):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style>{head}</head><body>{body}</body></html>'


WANT = "\n".join(["Headline", *PARTS])
BODY = "<h1>Headline</h1>" + "".join(f"<p>{p.replace('&', '&amp;')}</p>" for p in PARTS)
MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
NOISE = '<header>Site</header><div class="cookie-notice">We use cookies, and this is a long notice about them, accept it.</div><aside>Side text of the page</aside><div id="ad-1">Buy this now, it is a very long advert with many words.</div><form><p>Name</p><input></form><script>var a="<p>no</p>";</script>'
COMMENTS = '<section class="comments"><p>Great article, I liked every word of it and more!</p><p>Me too, this is a long reader comment on it.</p></section>'


@pytest.mark.parametrize(
    "body",
    [
        f"{MENU}<article>{BODY}</article><footer>&copy; all</footer>",
        f"{MENU}{NOISE}<main>{BODY}</main>{COMMENTS}<footer>foot</footer>",
        f'{NOISE}<div id="content"><div class="text">{BODY}</div></div>{COMMENTS}<div class="footer"><a href="x">Imprint</a></div>',
        f'<div class="menu"><a href="1">One</a> <a href="2">Two</a></div><div class="wrap has-sidebar">{BODY}</div><div class="sidebar"><p>Other news with some text</p></div>',
        f"<article>{BODY}{COMMENTS}<aside>related</aside></article>",
    ],
)
def test_article(body):
    assert main_text(page(body)) == WANT


@pytest.mark.parametrize("n", [1, 5, 10, 20, 50, 200, 2000])
@pytest.mark.parametrize("menu", ["", MENU, '<div><a href="/a">Home</a> <a href="/b">News</a> <a href="/c">All</a></div>'])
def test_lead_and_closing_of_long_pages(n, menu):
    """Without article or main; however long the block between them is. Links beside it stay out."""
    lead, closing, short = "lead " * 250, "closing " * 140, '<p><a href="/x">Read more of this here</a></p>'
    body = f'{menu}<div id="content"><p>{lead}</p><div>{"".join(f"<p>{f'part {k} ' * 60}</p>" for k in range(n))}</div><p>{closing}</p></div>{short}'
    lines = main_text(page(body)).split("\n")
    assert lines[0] == lead.strip() and lines[-1] == closing.strip() and len(lines) == n + 2


SLUGS = '<section id="related-work"><h2 id="search-algorithms">Search algorithms</h2><p>{0}</p></section><h2 id="social-impact" class="widget-title">Social impact</h2><p id="notice-1">{1}</p><div id="skip-lists"><p class="share">{2}</p></div>'.format(*(p.replace("&", "&amp;") for p in PARTS))
SLUG_TEXT = "\n".join(["Headline", *PARTS, "Search algorithms", PARTS[0], "Social impact", *PARTS[1:]])


@pytest.mark.parametrize(
    "body",
    [
        f"{MENU}<article class='post tag-search'>{BODY}{SLUGS}{COMMENTS}</article>",
        f"{MENU}<main id='search'>{BODY}{SLUGS}</main>{NOISE}{COMMENTS}",
        f"{NOISE}<div id='content'><div class='text'>{BODY}{SLUGS}</div></div>{COMMENTS}<div class='related-stories'><p>{PARTS[0]}</p></div>",
        f"{MENU}<div class='content-with-sidebar'><div class='text'>{BODY}{SLUGS}</div><div class='sidebar'><p>Other news</p></div></div>{COMMENTS}",
        f"{MENU}<div id='social-page'><article>{BODY}{SLUGS}</article></div><div class='site-footer'>About this site</div>",
        f"{NOISE}{BODY}{SLUGS}{COMMENTS}",
    ],
)
def test_names_of_article_parts(body):
    """Slugs of headings and sections, tags of an article and names of a layout cut nothing of the article."""
    assert main_text(page(body)) == SLUG_TEXT


def test_all_set_aside():
    halves = [f"<div id='search-{k}'><p>{PARTS[0]}</p></div>" for k in range(2)]
    assert PARTS[0] in main_text(page("".join(halves)))


def test_markup():
    assert main_text(page("<article><p>a&nbsp;b &lt;c&gt; &#233;<br>d <b>e</b>f\n\n g<!-- no --></p><ul><li>x<li>y</ul></article>")) == "a b <c> é d ef g\nx\ny"
    assert main_text(page("<article><p><b>one.<br><p>two.</p></article>")) == "one.\ntwo."
    assert main_text("<p>just text") == "just text" and main_text("plain") == "plain"
    for empty in (None, "", "<html></html>", "<script>x", "<!-- open", "<div", "<a <a", "<!x", "</", page("")):
        assert main_text(empty) == ""
    assert main_text("<p>1 < 2 <3") == "1 < 2 <3" and main_text("<p>a<![CDATA[b<]]>c") == "ab<c"
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    assert main_text(deep) == "deep text"


def test_quotes_and_length():
    assert main_text('<article><p title="a > b">in</p><p class=x">broken</p></article>') == "in\nbroken"
    long = "<article>" + "<p>word word word</p>" * 20_000 + "</article>"
    assert main_text(long).count("\n") == 19_999


def test_nothing_else_is_dropped():
    """A form round the whole page, and elements that are rare in articles."""
    wrapped = f"<form><label>Name</label><input>{MENU}<div id='content'>{BODY}</div><select><option>no</select></form>"
    assert main_text(page(wrapped)).endswith(WANT)
    inner = "<p>We know <math><mi>e</mi><mo>=</mo><mn>2</mn></math> <label>holds</label> <canvas>here</canvas> <object>and</object> <noscript>there</noscript> <svg><text>too</text></svg> <audio>a</audio><video>v</video><meter>m</meter>.</p>"
    assert main_text(page(f"<article>{BODY}{inner}</article>")) == WANT + "\nWe know e=2 holds here and there too avm."
    quote = "<blockquote><p>Said so.</p><footer>A. Author</footer></blockquote>"
    assert main_text(page(f"<article>{BODY}{quote}<form><p>Mail <input></p></form></article>")) == WANT + "\nSaid so.\nA. Author"


def test_article_in_the_body_itself():
    """Paragraphs by line breaks; what is links alone stays out, wherever the article is no element of its own."""
    assert main_text(page(f"<div>{PARTS[0]}<br><br>{PARTS[2]}</div><div><a href=1>Home</a><a href=2>News</a></div>")) == f"{PARTS[0]} {PARTS[2]}"
    assert main_text(page("<div><a href=1>Only</a> <a href=2>links</a></div>")) == "Only links"


@pytest.mark.parametrize(
    "html",
    ["<a " * 330_000, '<a ">"' * 160_000, "<![CDATA[" * 110_000, "<b>" * 9000 + "</i>" * 200_000, "<i><div>" + "<b>" * 30_000 + "</i>" * 200_000, "<div>" * 50_000 + "<li></li>" * 80_000, "<p>" * 100_000, "<div class='ad'>x" * 60_000, "<a class='" * 100_000, "<a ='" * 200_001, "&#" + "9" * 1_000_000 + ";", "&#x" + "f" * 1_000_000, "<textarea>a</textarea" * 48_000, "<" * 1_000_000, "<h1><div>x" * 50_000],
    ids=range(15),
)
def test_hostile_pages(html):
    """About a megabyte each; a quadratic step would take minutes."""
    began = time.process_time()
    main_text(html)
    assert time.process_time() - began < 5


class Plain:
    """A tree for the brute-force version: tag, and either text or children."""

    def __init__(self, tag, inside):
        self.tag, self.inside = tag, inside

    def html(self):
        return f"<{self.tag}>{self.inside if isinstance(self.inside, str) else ''.join(x.html() for x in self.inside)}</{self.tag}>"

    def below(self):
        return [] if isinstance(self.inside, str) else [y for x in self.inside for y in (x, *x.below())]

    def chars(self):
        return len("".join(self.inside.split())) if isinstance(self.inside, str) else sum(x.chars() for x in self.inside)

    def link_chars(self):
        return self.chars() if self.tag == "a" else 0 if isinstance(self.inside, str) else sum(x.link_chars() for x in self.inside)

    def density(self, body):
        """The published formula, read anew for each node."""
        c, lc, t, lt = self.chars(), self.link_chars(), max(1, len(self.below())), max(1, sum(x.tag == "a" for x in self.below()))
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + body.link_chars() / body.chars() * c + math.e)
        return c / t * (math.log(c / max(1, lc) * t / lt, base) if base > 1.0000001 else math.log(c / max(1, lc) * t / lt))

    def leaves(self):
        return [" ".join(self.inside.split())] if isinstance(self.inside, str) else [y for x in self.inside for y in x.leaves()]


def brute_article(body):
    nodes = [body, *body.below()]
    of = {n: n.density(body) for n in nodes}
    up = {c: n for n in nodes if not isinstance(n.inside, str) for c in n.inside}
    gathered = {n: 0.0 if isinstance(n.inside, str) else sum(max(0.0, of[c]) for c in n.inside) for n in nodes}
    best = max((n for n in nodes if any(x.tag != "a" and x.chars() for x in n.below())), key=gathered.__getitem__)
    path = [best]
    while path[-1] in up:
        path.append(up[path[-1]])
    plain = {n: (n.chars() - n.link_chars()) / max(1, len(n.below())) for n in nodes}
    threshold, least = min(of[n] for n in path), min(plain[n] for n in path)
    kept = {best}
    if best is body:
        kept = {c for c in body.inside if of[c] > 0 or c.tag == "a"}
    for n in path[1:]:
        kept |= {c for c in n.inside if c not in path and c.chars() and (of[c] >= threshold or plain[c] >= least > 0)}
    return "\n".join(x for n in nodes if n in kept for x in n.leaves())


def planted(rng):
    """A page without an element or a name that says what is what: prose somewhere, links and short lines around it."""
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    links = lambda: Plain("div", [Plain("a", text(rng.randrange(1, 4))) for _ in range(rng.randrange(2, 9))])
    prose = Plain("div", [Plain("p", text(rng.randrange(15, 90))) for _ in range(rng.randrange(2, 12))])
    for _ in range(rng.randrange(0, 4)):
        around = [prose, *(rng.choice([links, lambda: Plain("div", [Plain("div", text(2)), links()]), lambda: Plain("p", text(rng.randrange(1, 60)))])() for _ in range(rng.randrange(1, 4)))]
        rng.shuffle(around)
        prose = Plain("div", around)
    return Plain("body", [links(), Plain("div", text(3)), prose, links()])


def test_density_against_brute_force():
    rng = random.Random(5)
    partial = 0
    for _ in range(150):
        body = planted(rng)
        want = "".join(brute_article(body).split())  # links stand in one line, so white space is left out
        assert "".join(main_text(f"<html>{body.html()}</html>").split()) == want
        partial += want != "".join("".join(body.leaves()).split())
    assert partial > 120


def test_whole_body_is_not_enough(sf, monkeypatch):
    """Elements and names alone do not make the result: densities decide."""
    pages = pq.read_table(f"{sf}/pages.parquet").column("html").to_pylist()
    right = [main_text(h) for h in pages]
    monkeypatch.setattr(html_text, "choose", lambda nodes: setattr(nodes[0], "keep", True))
    assert not any(main_text(h) == t for h, t in zip(pages, right, strict=True))
    monkeypatch.undo()
    # Nor need the article be named: the same pages with plain elements in its place.
    plain = [re.sub(r"(</?)article", r"\1div", h) for h in pages]
    same = sum(main_text(h) == t for h, t in zip(plain, right, strict=True))
    assert same >= 0.9 * len(pages)


def test_extract(spark, sf):
    got = html_text.extract(frame(spark, [(1, "u", page(f"<article>{BODY}</article>")), (2, None, None), (2, "", ""), (None, "u", "x")])).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got) == [("1", WANT, len(WANT)), ("2", "", 0), ("2", "", 0), ("None", "x", 1)]
    assert html_text.extract(frame(spark, [])).count() == 0
    pages = html_text.op3_html_text(spark, sf).collect()
    assert all(r["text"] and "<" not in r["text"] and "©" not in r["text"] for r in pages)


URLS = ["http://a.example.net/en/x", "https://example.net/de/", "http://example.net", "http://x.org/fr/a?b", "http://org/fr/", "http://x.org/fr", "http://EXAMPLE.com/de/q#f", "http://myexample.com/de/", "ftp://u:p@a.com:80/de/x", "no scheme", None, "", "http://", "http://spam-farm.example.org/x", "http://spam-farm.example.org/fr/x", "a://b://c/d", "http://net", "http://x.net/\n?", "http://é.net/É", "http://.net/"]




def test_urls_equal_sql(spark):
    rows = [(k, u, "") for k, u in enumerate(URLS)]
    got = url_filter.filter_urls(frame(spark, rows), url_filter.rules(spark, url_filter.RULES), url_filter.rules(spark, url_filter.LISTED))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [r[:2] for r in rows])
    want = sorted(map(repr, con.execute(url_filter.SQL).fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select("page_id", "host", "path", "rule", "verdict").collect()) == want
    assert got.columns.count("host") == 1 and "file" in got.columns


def test_every_junk_host_is_blocked(spark):
    """Under each domain, with or without a subdomain, wherever no rule decides."""
    junk = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
    urls = [f"http://{sub}{host}.example.{top}/x" for host in junk for top in ("com", "net", "org") for sub in ("", "www.", "m.", "blog.")]
    other = ["http://good.example.com/x", "http://notspam-farm.example.com/x", "http://spam-farm.example.org/fr/x"]
    rows = [(k, u, "") for k, u in enumerate(urls + other)]
    got = url_filter.filter_urls(frame(spark, rows), url_filter.rules(spark, url_filter.RULES), url_filter.rules(spark, url_filter.LISTED)).collect()
    verdict = {r["page_id"]: r["verdict"] for r in got}
    assert [u for k, u in enumerate(urls) if verdict[k] != "block"] == []
    assert [verdict[len(urls) + k] for k in range(3)] == ["allow"] * 3


@pytest.mark.parametrize("most", [url_filter.BROADCAST_BYTES, 1])
def test_long_urls_and_long_lists(spark, monkeypatch, most):
    """A host of very many labels, a long path, and a filter in segments with a list that is joined by a shuffle."""
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", most)
    listed = [(f"h{k}.com", "/", "block") for k in range(3000)] + [("a.h5.com", "/", "allow"), ("h5.com", "/xx", "block")]
    urls = ["http://" + "a." * 100_000 + "h7.com/x", "http://h8.com/" + "p" * 1_000_000, "http://b.a.h5.com/x", "http://a.h5.com/xx", "http://x.y/"]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(frame(spark, [(k, u, "") for k, u in enumerate(urls)]), url_filter.rules(spark, listed), url_filter.rules(spark, [])).collect()}
    assert got == {0: ("h7.com/", "block"), 1: ("h8.com/", "block"), 2: ("a.h5.com/", "allow"), 3: ("h5.com/xx", "block"), 4: (None, "allow")}


def test_url_lists(spark):
    """A longer list against plain Python; no false positive of the filter may stay."""
    listed = [(f"h{k}.com", f"/{'p' * (k % 5)}", "block" if k % 2 else "allow") for k in range(800)] + [("h1.com", "/p", "allow")]
    urls = [(k, f"http://www.h{k}.com/ppp", "") for k in range(0, 1600, 7)]
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(frame(spark, urls), url_filter.rules(spark, listed), url_filter.rules(spark, [])).collect()}
    for k, *_ in urls:
        fits = k < 800 and len(f"/{'p' * (k % 5)}") <= 4
        assert found[k] == ((f"h{k}.com/{'p' * (k % 5)}", "block" if k % 2 else "allow") if fits else (None, "allow"))
    none = url_filter.filter_urls(frame(spark, urls[:3]), url_filter.rules(spark, []), url_filter.rules(spark, []))
    assert {r["verdict"] for r in none.collect()} == {"allow"}
    assert url_filter.filter_urls(frame(spark, []), url_filter.rules(spark, listed), url_filter.rules(spark, [])).count() == 0


TRAP = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "y" * 100
PAYLOADS = [(1, "a", "p" * 100), (2, "b", "p" * 100), (3, "c", "p" * 99), (4, "d", "p" * 99), (5, "e", None), (6, "f", ""), (7, "g", TRAP), (8, "h", TRAP), (9, "i", "ends\r\n"), (10, None, "é" * 50), (11, "k\r\nX: y", "é" * 50), (12, "l", "z" * 200_000), (12, "l", "z" * 200_000), (None, "n", "p" * 100), (13, "o", "\r\n\r\n" * 40)]


def test_warc_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(frame(spark, PAYLOADS), path)
    own = {r["page_id"]: bytes(r["payload"]) for r in warc.read_archives(spark, path).where("record_type = 'response'").collect()}
    assert own == {i: (h or "").encode() for i, _, h in PAYLOADS if i in own} and 999 not in own
    got = sorted(repr(tuple(r)) for r in warc.records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = []
    for i, _, h in PAYLOADS:
        b = (h or "").encode()
        first = min(j for j, _, g in PAYLOADS if j is not None and (g or "") == (h or ""))
        again = len(b) >= 100 and i != first
        want.append(repr((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None)))
    assert got == sorted(want)


def test_warc_hostile_payloads(spark, tmp_path):
    """Magic lines by the thousand, feigned records that all end where the payload does, and magic right before the end."""
    fake = lambda left: f"\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: {left}\r\n\r\n"
    nested = ""
    for _ in range(3000):
        nested = fake(len(nested)) + nested
    payloads = ["WARC/1.1\r\n" * 100_000, nested, "x\r\n\r\nWARC/1.1", "x\r\n\r\nWARC/1.1\r\n", "\r\n\r\nWARC/1.1\r\n\r\nWARC/1.1", "\nWARC/1.1\r\n\r\n", "\r\n" * 50_000, "WARC/1.1\r\nContent-Length: 5\r\n\r\n"]
    rows = [(k, "http://a/WARC/1.1", p) for k, p in enumerate(payloads)]
    path = f"file://{tmp_path}/w"
    began = time.process_time()
    warc.write_archives(frame(spark, rows).coalesce(1), path)
    for most in ("128m", "100k"):  # the second cuts payloads into many ranges
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            got = {r["page_id"]: (bytes(r["payload"]).decode(), r["payload_bytes"], r["digest"]) for r in warc.read_archives(spark, path).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == {k: (p, len(p), hashlib.sha256(p.encode()).hexdigest()) for k, _, p in rows}
    assert time.process_time() - began < 20


def test_warc_empty(spark, tmp_path):
    warc.write_archives(frame(spark, []), f"file://{tmp_path}/w")
    assert warc.records(spark, f"file://{tmp_path}/w").count() == 0


def test_chain_stops_at_damage(spark, tmp_path):
    record = lambda k, body: (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nContent-Length: {len(body)}\r\n\r\n" + body + "\r\n\r\n").encode()
    (tmp_path / "a.warc").write_bytes(record(1, "one") + record(2, "two") + b"junk" + record(3, "three"))
    assert sorted(r["page_id"] for r in warc.read_archives(spark, f"file://{tmp_path}").collect()) == [1, 2]
    (tmp_path / "a.warc").write_bytes(b"junk" + record(1, "one"))
    assert warc.read_archives(spark, f"file://{tmp_path}").count() == 0
    (tmp_path / "a.warc").write_bytes(record(1, "one") + record(2, "two")[:-2])
    assert [r["page_id"] for r in warc.read_archives(spark, f"file://{tmp_path}").collect()] == [1]


def test_pointer_jumping():
    offset, successor = np.array([0, 10, 12, 30, 40, 55]), np.array([10, 30, 40, 55, 99, 80])
    assert warc.reached(offset, successor).tolist() == [True, True, False, True, False, True]
    assert warc.reached(offset[::-1], successor[::-1]).tolist() == [True, False, True, False, True, True]
    n = np.arange(5000)
    assert warc.reached(n, n + 1).all() and not warc.reached(n + 1, n + 2).any()
    assert len(warc.reached(np.empty(0, np.int64), np.empty(0, np.int64))) == 0
