"""Main text and archives: edge cases, formats, and whole small tables."""

import base64
import gzip
import hashlib
import html
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from echotrail.llm import archives, main_text
from echotrail.sources.files import scratch_path
from tests.llm.helpers import SF

SF = "/root/testdata/sf0.001"
CLASHING = ["row_key", "digest", "path", "host", "content", "payload", "k", "u", "b", "refers_to"]

PAGE = """<html><head><title>x</title><style>p{}</style></head><body><header class="top"><h1>Site</h1><p>Long header, with commas, that is no article.</p></header>
<div class="menu"><a href=1>Home</a></div><div id="wrap"><div class="content-%d"><h1>Real &amp; title</h1><p>First paragraph, with <b>bold</b>&nbsp;text
and <a href="#">a link</a> in it.</p>loose text<p>Second &lt;paragraph&gt;. It goes on,
 over lines.<div class="cookie-notice">We use cookies</div><ul><li>one point</li><li>two points</ul><form><label>mail</label><p>Sign up</p></form></div>
<div class="sidebar"><p>Sidebar text, which is long, and has commas, lots, of, them, all, over.</p></div><!-- <p>hidden</p> -->
<section id="comments"><p>Reader comment, long, long, long text, with many, many commas, many.</p></section></div><footer>foot</footer><script>if(a<b){"</p>"}</script></body></html>"""
TEXT = "Real & title\nFirst paragraph, with bold text and a link in it.\nloose text\nSecond <paragraph>. It goes on, over lines.\none point\ntwo points"


def edge_pages(spark, rows=None):
    rows = rows if rows is not None else [
        (1, "http://a.example/1", PAGE % 1), (2, "http://a.example/2", PAGE % 2), (2, "http://a.example/2", PAGE % 2), (3, None, None), (4, "http://a.example/4", ""),
        (5, "no url", "plain text only"), (None, "http://b.example/x y", "<p>a<p>b &lt;x&gt; <br>c"), (6, "http://b.example/\n", "<div><p>unclosed <b>bold"),
        (7, "http://c.example/", "<p>" + "long word, " * 50_000 + "</p>"), (8, "http://c.example/", "\U0001f600 \r\n\r\nWARC/1.0 &eacute;")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def test_main_text_of_edge_pages(spark):
    got = {(r.page_id, r.url): r for r in main_text.main_text(edge_pages(spark)).collect()}
    text = {k[0]: r.text for k, r in got.items()}
    assert text[1] == TEXT and text[2] == TEXT and text[3] == "" and text[4] == "" and text[5] == "plain text only"
    assert text[None] == "a\nb <x> c" and text[6] == "unclosed bold" and text[8] == "\U0001f600 WARC/1.0 é"
    assert len(text[7]) == len("long word, " * 50_000) - 1
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert main_text.main_text(edge_pages(spark)).count() == 10


def test_main_text_of_the_smallest_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in main_text.main_text(pages).collect():
        body = re.search(r"<article>(.*?)(</article>|<footer)", source[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1|article)[^>]*>", body)]
        assert r.text == "\n".join(x for x in parts if x)


def test_the_host_overrules_a_page(spark):
    """One page has more text beside its article; the other pages of the host know better."""
    usual = "<html><body><div class='story'><p>{}</p></div><div class='box'><p>{}</p></div></body></html>"
    article, extra = "The article is here, and it has its sentences. " * 6, "Other words, many of them. " * 2
    rows = [(i, "http://h.example/p", usual.format(article, extra)) for i in range(6)] + [(9, "http://h.example/odd", usual.format("Short article.", extra * 20))]
    got = {r.page_id: r.text for r in main_text.main_text(edge_pages(spark, rows)).collect()}
    assert got[9] == "Short article." and got[0] == article.strip()
    assert main_text.extract(usual.format("Short article.", extra * 20), None) != "Short article."


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_archives_round_trip(spark):
    pages = edge_pages(spark)
    rows = [(r.page_id, r.html) for r in pages.collect()]
    first = {}
    for i, h in rows:
        if i is not None:
            first[digest(h)] = min(i, first.get(digest(h), i))
    expected = Counter()
    for i, h in rows:
        answers = first.get(digest(h), i) == i
        expected[(i, len((h or "").encode()), digest(h), "response" if answers else "revisit", None if answers else first[digest(h)])] += 1
    got = archives.convert_pages(pages).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected
    assert all(r.problem is None for r in got)


def test_written_archives_are_warc_files(spark):
    records = archives.records_through_arc(edge_pages(spark))
    path = scratch_path(spark, "warc-test")
    archives.write_warc(records, spark.createDataFrame([], "row_key string, digest string, refers_to string"), path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").collect()
    body = b"".join(gzip.decompress(bytes(f.content)) for f in files)
    assert body.count(b"WARC/1.0\r\nWARC-Type: response\r\n") == 10 and body.endswith(b"\r\n\r\n")
    back = {r.row_key: bytes(r.payload).decode() for r in archives.read_warc(spark, path).collect()}
    assert back["1"] == PAGE % 1 and back["3"] == "" and back["~"].startswith("<p>a<p>b")


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    name = f"x{version}.arc"
    bodies = [b"first", b"", b"line\n\nWARC http://x 1.2.3.4 20010101000000 text/html 5\n", bytes(range(256))]
    content = archives.arc_head(name, version) + b"".join(archives.arc_record(version, name, 0, f"http://h/{i} é", str(i), b) for i, b in enumerate(bodies))
    for data in (content, gzip.compress(content), b"".join(gzip.compress(content[a:a + 50]) for a in range(0, len(content), 50))):
        got = list(archives.parse_arc(name, data))
        assert [(r[1], r[7], r[9]) for r in got] == [(version, str(i), b) for i, b in enumerate(bodies)]
        assert all(r[6] == 200 and r[8] is None for r in got)
    assert [r[8] for r in archives.parse_arc(name, content[:-100])][-1] == "short"
    assert [r[8] for r in archives.parse_arc(name, gzip.compress(content)[:-30])][-1] == "gzip"
    broken = archives.arc_head(name, version) + b"no header line\n" + archives.arc_record(version, name, 0, "http://h/", "7", b"ok")
    assert [(r[8], r[9]) for r in archives.parse_arc(name, broken)] == [("header", b"no header line\n"), (None, b"ok")]


def test_arc_records_that_are_no_http():
    head = archives.arc_head("a.arc", 1)
    got = list(archives.parse_arc("a.arc", head + b"ftp://h/f 1.2.3.4 19990101 text/plain 4\nabcd\n"))
    assert got[0][2:6] == ("ftp://h/f", "1.2.3.4", "19990101", "text/plain") and got[0][9] == b"abcd"
    assert archives.warc_date("19990203") == "1999-02-03T00:00:00Z" and archives.warc_date("junk") == archives.warc_date(None) == "2000-01-01T00:00:00Z"
    assert list(archives.parse_arc("a", b"")) == [] and list(archives.parse_warc("a", b"")) == []


def test_damaged_warc_records_are_reported():
    record = archives.warc_record("5", "http://h/", "20200101000000", "text/html", 200, b"body", archives.payload_digest(b"body"), None) + b"\r\n\r\n"
    good = list(archives.parse_warc("w", record))[0]
    assert good[1] == "response" and good[7] == "5" and good[8] == 4 and good[9] is None
    assert list(archives.parse_warc("w", record.replace(b"body", b"bodX")))[0][9] == "digest"
    assert list(archives.parse_warc("w", record + b"rubbish"))[-1][9] == "header"


@pytest.mark.parametrize("run", [main_text.main_text, archives.convert_pages])
def test_empty_tables(spark, run):
    assert run(edge_pages(spark, [])).collect() == []


SAY = [f"Sentence {i} of the article, which goes on for a while, and ends here at last." for i in range(12)]
PARTS = "".join(f"<p>{x}</p>" for x in SAY)


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class='post'>{}</div>"])
def test_main_text_keeps_what_stands_around_the_body(spark, wrap):
    inner = f"<h1>Heading</h1><p>The lead of the article, in one sentence.</p><div class='body'>{PARTS}</div><section class='end'><p>{SAY[0] * 4}</p></section><div class='links'><a href=1>More of this and of that on other pages</a></div>"
    page = "<html><body><nav><a href=1>Home</a></nav>" + wrap.format(inner) + "<div class='box'><p>Other words.</p></div></body></html>"
    got = main_text.main_text(edge_pages(spark, [(i, "http://w.example/p", page) for i in range(3)])).collect()
    assert {r.text for r in got} == {"\n".join(["Heading", "The lead of the article, in one sentence.", *SAY, SAY[0] * 4])}


def test_main_text_of_uneven_sections():
    page = f"<html><body><article><section class='a'><p>{SAY[0]}</p></section><section class='b'>{PARTS}</section><div class='c'><p>{SAY[1]}</p></div></article></body></html>"
    assert main_text.extract(page, None).split("\n") == [SAY[0], *SAY, SAY[1]]


@pytest.mark.parametrize("wrapper", ["div class='content-sidebar-wrap'", "div class='has-sidebar'", "div class='no-header'", "div class='elementor-widget-wrap'", "form id='aspnetForm'"])
def test_main_text_inside_marked_wrappers(spark, wrapper):
    beside = "<div class='sidebar'><p>Sidebar text, which is long, and has commas, lots, of, them.</p></div><div id='comments'><p>Reader comment, long, long, with commas, many.</p></div>"
    page = f"<html><body><{wrapper}><div class='story'>{PARTS}</div>{beside}</{wrapper.split()[0]}></body></html>"
    short = page.replace(PARTS, f"<p>{SAY[0]}</p>").replace("Reader comment", SAY[1] * 9)
    got = main_text.main_text(edge_pages(spark, [(i, "http://w.example/p", page) for i in range(3)] + [(9, "http://w.example/p", short)])).collect()
    assert {r.page_id: r.text for r in got} == {**{i: "\n".join(SAY) for i in range(3)}, 9: SAY[0]}


def test_marks_of_split_wrappers_and_of_readers():
    widgets = "".join(f"<div class='elementor-widget elementor-widget-{k}'><p>{x}</p></div>" for k, x in zip(("heading", "text", "text", "text"), SAY))
    page = f"<html><body><div class='page'>{widgets}<div class='elementor-widget elementor-widget-nav-menu'><p>{SAY[7]}</p></div></div></body></html>"
    assert main_text.extract(page, None).split("\n") == SAY[:4]
    page = f"<html><body><div class='text'><p>{SAY[0]}</p></div><div id='comments'><article>{PARTS}</article></div></body></html>"
    assert main_text.extract(page, None) == SAY[0]
    assert main_text.extract(f"<html><body><div class='cookie-notice'><p>{SAY[0]}</p></div></body></html>", None) == ""


def test_revisits_refer_to_records_of_the_archives(spark):
    rows = [(i, f"http://h{i}.example/p", "<p>same</p>" if i % 3 else f"<p>{i}</p>") for i in range(9)]
    records = archives.records_through_arc(edge_pages(spark, rows))
    path = scratch_path(spark, "warc-test")
    archives.write_warc(records, archives.first_of_equal(records, F.col("row_key").cast("long")), path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").collect()
    heads = [dict(x.split(": ", 1) for x in h.split("\r\n")[1:]) for h in re.findall(r"WARC/1\.0\r\n.*?(?=\r\n\r\n)", "".join(gzip.decompress(bytes(f.content)).decode() for f in files), re.S)]
    responses = {h["WARC-Record-ID"]: h["WARC-Target-URI"] for h in heads if h["WARC-Type"] == "response"}
    revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 5 and all(responses[h["WARC-Refers-To"]] == h["WARC-Refers-To-Target-URI"] == "http://h1.example/p" for h in revisits)


@pytest.mark.parametrize("version", [1, 2])
def test_legacy_records_keep_all_they_have(spark, version):
    name = f"old{version}.arc"
    middle = "" if version == 1 else "200 - - 0 old.arc "

    def record(url, mime, block, cut=0):
        return f"{url} 192.0.2.7 20010203040506 {mime} {middle}{len(block) + cut}\n".encode() + block + b"\n"

    moved = b"HTTP/1.1 302 Found\r\nLocation: http://h/b\r\nSet-Cookie: a=b\r\nContent-Type: text/html; charset=koi8-r\r\n\r\nmoved"
    old = b"HTTP/1.0 200 OK\nLast-Modified: then\n\nbody"
    content = archives.arc_head(name, version) + record("http://h/a", "text/html", moved) + record("http://h/b", "text/html", old) + record("dns:h", "text/dns", b"20010203 h 192.0.2.7\n")
    content += record("filedesc://page", "text/html", b"HTTP/1.0 200 OK\r\n\r\npage") + b"no header line\n" + record("http://h/c", "text/html", b"HTTP/1.0 200 OK\r\n\r\ncut", 50)
    records = archives.read_arc(spark.createDataFrame([(name, bytearray(content))], "path string, content binary"))
    path = scratch_path(spark, "warc-test")
    archives.write_warc(records, archives.first_of_equal(records, F.col("row_key")), path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").collect()
    data, found = b"".join(gzip.decompress(bytes(f.content)) for f in files), []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        found.append((fields, rest[:size]))
        assert rest[size:size + 4] == b"\r\n\r\n"
        data = rest[size + 4:]
    got = {f.get("WARC-Target-URI", f["WARC-Type"]): (f, b) for f, b in found}
    assert [f["WARC-Type"] for f, _ in found] == ["warcinfo", "metadata", "response", "response", "resource", "response", "metadata", "response"]
    assert got["http://h/a"][1] == moved and got["http://h/b"][1] == old and got["filedesc://page"][1].endswith(b"page")
    assert got["dns:h"][0]["Content-Type"] == "text/dns" and got["dns:h"][1] == b"20010203 h 192.0.2.7\n"
    assert got["metadata"][1] == b"no header line\n" and got["metadata"][0]["X-ARC-Problem"] == "header"
    assert got["http://h/c"][0]["WARC-Truncated"] == "unspecified" and got["http://h/c"][1].startswith(b"HTTP/1.0 200 OK\r\n\r\ncut")
    assert all(got[u][0]["WARC-IP-Address"] == "192.0.2.7" and got[u][0]["WARC-Warcinfo-ID"] == got["warcinfo"][0]["WARC-Record-ID"] for u in ("http://h/a", "dns:h"))
    assert len({f["WARC-Record-ID"] for f, _ in found}) == len(found)
    assert {r.url: r.problem for r in archives.read_warc(spark, path).collect()}["http://h/c"] == "short"


def test_a_page_at_a_filedesc_url_is_a_page(spark):
    rows = [(i, f"filedesc://{i}", f"<p>{i}</p>") for i in range(3)]
    assert sorted(r.page_id for r in archives.convert_pages(edge_pages(spark, rows)).collect()) == [0, 1, 2]


LONG = "Long running text that goes on and on, with commas, and so forth until it is long enough. " * 3


@pytest.mark.parametrize("inner, blocks", [
    (f'<section id="discussion"><h2>Discussion</h2><p>{LONG}</p></section>', 5), (f'<section class="related-work"><h2>Related</h2><p>{LONG}</p></section>', 5),
    (f'<p class="legal">{LONG}</p>', 4), (f'<p class="lead teaser">{LONG}</p>', 4), ('<h2 class="section-header">Head</h2>', 4),
    ('<div class="article-header"><h1>Top</h1></div>', 4), ('<h3 id="search">Head</h3>', 4),
    # What must stay out.
    (f'<div class="comments"><p>{LONG}</p></div>', 3), ('<p class="ad">Buy it now and here, it is cheap.</p>', 3), (f'<div class="newsletter"><p>{LONG}</p></div>', 3),
    ('<section class="related"><ul><li><a href="a">One other story</a></li><li><a href="b">Another one</a></li></ul></section>', 3),
    (f'<div class="sidebar"><p>{LONG}</p></div>', 3)])
def test_marked_parts_of_an_article(inner, blocks):
    page = f"<html><body><article><h1>T</h1><p>{LONG}</p>{inner}<p>{LONG}</p></article></body></html>"
    (path, whole, _), *_ = main_text.page_votes(page)
    assert len(main_text.extract(page, path, whole).split("\n")) == blocks
    assert len(main_text.extract(page, None).split("\n")) == blocks


def test_two_articles_without_a_host_path():
    page = "<body><nav><a href=x>menu</a></nav>" + "".join(f"<article><h2>T{i}</h2><p>{i} {LONG}</p></article>" for i in range(2)) + "</body>"
    assert len(main_text.extract(page, None).split("\n")) == 4


@pytest.mark.parametrize("page", [
    '<div class="a">' * 40_000 + f"<p>{LONG}", f'<div class="a">{LONG}' * 8_000, '<a "' * 60_000 + LONG, '<a "x" ' * 60_000 + '">"' + LONG,
    "<b>" * 30_000 + f"<p>{LONG}</p>" * 2_000, f'<div class="comment">{LONG}' * 8_000, "</i>" * 50_000 + f"<p>{LONG}</p>"])
def test_pages_are_read_in_linear_time(page):
    import time

    def seconds(text):
        start = time.process_time()
        votes = main_text.page_votes(text)
        main_text.extract(text, *(votes[0][:2] if votes else (None, None)))
        return time.process_time() - start

    # Eight times the page may not take much more than eight times as long.
    assert seconds(page) < 20 * seconds(page[:len(page) // 8]) + 0.5


def test_against_another_parser(spark):
    """Articles of all pages as the standard library's parser sees them."""
    from html.parser import HTMLParser

    skipped = {"script", "style", "nav", "aside", "header", "footer", "form"}

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.skip, self.blocks, self.articles = 0, 0, [[]], 0

        def handle_starttag(self, tag, attrs):
            self.articles += tag == "article"
            self.inside += tag == "article"
            self.skip += tag in skipped or dict(attrs).get("class") == "ad"
            if tag in main_text.BLOCKS:
                self.blocks.append([])
            if tag == "br":
                self.handle_data(" ")

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.skip -= bool(self.skip) and (tag in skipped or tag == "div")
            if tag in main_text.BLOCKS:
                self.blocks.append([])

        def handle_data(self, data):
            if self.inside and not self.skip:
                self.blocks[-1].append(data)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in main_text.main_text(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    compared = 0
    for page_id, source in pages.items():
        parser = Article()
        parser.feed(source or "")
        if parser.articles == 1:
            lines = (" ".join("".join(b).split()) for b in parser.blocks)
            assert got[page_id] == "\n".join(x for x in lines if x), page_id
            compared += 1
    assert compared >= 20


def test_record_identifiers_of_a_whole_folder_are_distinct(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").repartition(4, "page_id")
    records = archives.records_through_arc(pages)
    path = scratch_path(spark, "warc-test")
    archives.write_warc(records, archives.first_of_equal(records, F.col("row_key").cast("long")), path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").collect()
    data = b"".join(gzip.decompress(bytes(f.content)) for f in files)
    ids = re.findall(rb"WARC-Record-ID: (\S+)", data)
    kinds = Counter(re.findall(rb"WARC-Type: (\S+)", data))
    assert len(ids) == len(set(ids)) and kinds[b"warcinfo"] >= 4
    assert set(re.findall(rb"WARC-Warcinfo-ID: (\S+)", data)) <= set(ids)


def test_page_ids_may_be_any_text(spark):
    ids = ["~", "a\r\nb", " x ", "", "%7E", "é", None, "plain"]
    rows = spark.createDataFrame([(i, "http://h/p", f"<p>{n % 3}</p>") for n, i in enumerate(ids)], "page_id string, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in archives.convert_pages(rows).collect()}
    assert set(got) == set(ids)
    for rest in range(3):
        mine = [i for n, i in enumerate(ids) if n % 3 == rest]
        first = min(mine, key=lambda i: (i is None, (i or "").encode()))
        assert {i: got[i] for i in mine} == {i: ("response", None) if i == first else ("revisit", first) for i in mine}
