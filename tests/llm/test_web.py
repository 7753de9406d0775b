import base64
import hashlib
import random
import time
from html.parser import HTMLParser

import pytest

from factlake.llm import extract, warc

SCHEMA = "page_id long, url string, html string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], SCHEMA)


def test_records_round_trip():
    payloads = [b"", b"\r\n\r\n", "é<p>".encode() * 30_000, bytes(range(256))]
    import zlib

    data = b""
    for k, p in enumerate(payloads):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        data += z.compress(warc.record(k, "http://x/a%20b\n: y", p, warc.digest_of(p), None, "2026-01-01T00:00:00Z")) + z.flush()
    found = list(warc.records(data))
    assert [p for _, p in found] == payloads
    assert found[0][0]["WARC-Target-URI"] == "http://x/a%20b%0A: y"


@pytest.mark.parametrize("list_bytes", [16 << 20, 0])
def test_archives(spark, tmp_path, monkeypatch, list_bytes):
    monkeypatch.setattr(warc, "LIST_BYTES", list_bytes)
    rng = random.Random(1)
    rows = [(i, f"http://h/{i}", rng.choice([None, "", "<p>a</p>", "é" * 9, "x" * 100_000])) for i in range(40)] + [(40, None, "only"), (None, "http://n", "only"), (None, None, "nothing else")]
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages(spark, rows), path)
    read = warc.read_archives(spark, path)
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, u, h in rows:
        p, top = (h or "").encode(), largest[h or ""]
        again = top != (-1 if i is None else i)
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", top if again else None, u))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url) for r in warc.with_originals(read).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    whole = {r.page_id: bytes(r.payload).decode() for r in read.where("record_type = 'response'").collect()}
    assert whole == {i: h or "" for (i, _, h), w in zip(rows, want, strict=True) if w[3] == "response"}


def test_revisits_are_standard(spark, tmp_path):
    """A reader that knows WARC only finds a revisit's response by its headers; ids are unique."""
    path = f"file://{tmp_path}/w"
    rows = [("a", "http://h/a%20b", "same"), ("b", "http://h/a%20b", "same"), ("b", "http://h/2", "same"), ("b", "http://h/2", "other"), ("c", None, "other"), ("c", None, "")]
    warc.write_archives(spark.createDataFrame(rows, "page_id string, url string, html string"), path)
    found = []
    for f in (tmp_path / "w" / "archives").iterdir():
        found += list(warc.records(f.read_bytes()))
    assert len({h["WARC-Record-ID"] for h, _ in found}) == len(rows) == len(found)
    by_id = {h["WARC-Record-ID"]: (h, p) for h, p in found}
    revisits = [h for h, _ in found if h["WARC-Type"] == "revisit"]
    assert sorted(h["WARC-Page"] for h in revisits) == ["a", "b"]
    for h in revisits:
        original, payload = by_id[h["WARC-Refers-To"]]
        assert original["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] == f"sha1:{warc.digest_of(payload)}"
        assert original.get("WARC-Target-URI") == h.get("WARC-Refers-To-Target-URI") and original["WARC-Date"] == h["WARC-Refers-To-Date"]
    assert {h["WARC-Target-URI"] for h, _ in found if "WARC-Target-URI" in h} == {"http://h/a%20b", "http://h/2"}
    got = warc.with_originals(warc.read_archives(spark, path, "string")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.refers_to) for r in got if r.record_type == "revisit") == [("a", 4, "b"), ("b", 5, "c")]


def test_damaged_archives(spark, tmp_path):
    import zlib

    import pyarrow as pa
    from pyarrow import parquet

    (tmp_path / "archives").mkdir()
    (tmp_path / "manifest").mkdir()
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    (tmp_path / "archives" / "x").write_bytes(z.compress(warc.record(1, "u", b"abc", warc.digest_of(b"abd"), None, "now")) + z.flush())
    parquet.write_table(pa.table({"file": ["x"], "n_records": [1]}), tmp_path / "manifest" / "p.parquet")
    with pytest.raises(Exception, match="not what its digest says"):
        warc.read_archives(spark, f"file://{tmp_path}").count()


def test_least_bytes_ties_and_empty(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages(spark, [(1, "u", "abc"), (2, "u", "abc"), (2, "u", "abc"), (3, "u", "long text"), (4, "u", "long text")]), path, 5)
    kinds = sorted((r.page_id, r.record_type) for r in warc.read_archives(spark, path).collect())
    assert kinds == [(1, "response"), (2, "response"), (2, "response"), (3, "revisit"), (4, "response")]
    warc.write_archives(pages(spark, []), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0


CHROME = '<header class="site">Site</header><nav><ul><li><a href="/">Home</a></ul></nav><div class="sidebar-left">Side</div><div id="cookie-notice">Cookies</div>'
TAIL = '<section class="comments"><p>Nice post, thanks a lot for all of it</p></section><aside>More</aside><footer>End</footer><script>var x = "<p>no</p>";</script>'


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{CHROME}<!-- <p>gone</p> -->{body}{TAIL}</body></html>"


def test_extract(spark):
    rows = [
        (0, "http://a.com/1", page('<article><h1>Head &amp; more</h1><p>One\n two<b>three</b>.<p>Four<br>five<ul><li>six<li>seven</ul></article>')),
        (1, "http://a.com/2", page("<article><p>&lt;x&gt; &eacute; &#8211; end</article>")),
        (2, "https://b.org/x", page('<div class="post-12"><p>Body text of the page that is long enough.</p><form>Mail <input></form><p>Second one.</p></div>')),
        (3, "https://b.org/y", page('<div class="post-77"><p>Short.</p></div>')),
        (4, None, None),
        (5, "nothing", ""),
        (6, "http://c.de", "plain text only"),
        (7, "http://c.de", "<p>unclosed <b>bold<p>next"),
        (8, "http://d.de", page('<main><article><p>' + "word " * 5000 + '</p></article><article class="comment"><p>I do not agree</p></article></main>')),
    ]
    rows.append((9, *rows[0][1:]))
    got = {r.page_id: (r.text, r.n_chars) for r in extract.extract(pages(spark, rows)).collect()}
    want = {0: "Head & more One twothree. Four five six seven", 1: "<x> é – end", 2: "Body text of the page that is long enough. Second one.", 3: "Short.", 4: "", 5: "", 6: "plain text only", 7: "unclosed bold next", 8: ("word " * 5000).strip(), 9: "Head & more One twothree. Four five six seven"}
    assert got == {k: (t, len(t)) for k, t in want.items()}
    assert extract.extract(pages(spark, [])).count() == 0


def test_hosts_vote(spark):
    """A page whose own best container is another one follows its host."""
    odd = '<div class="box">' + "<p>Some other long text here.</p>" * 3 + '</div><div class="story"><p>The story of this page is a bit shorter.</p></div>'
    rows = [(i, f"http://h.com/{i}", page(f'<div class="story"><p>{"Long story text. " * 20}</p></div>')) for i in range(5)] + [(5, "http://h.com/5", page(odd))]
    paths = {r.host: bytes(r.path) for r in extract.host_paths(pages(spark, rows)).collect()}
    assert paths["h.com"] == next(path for path, _, tag in extract.Page(rows[0][2]).boxes if tag == "div" and extract.Page(rows[0][2]).text(path).startswith("Long story"))
    assert extract.extract(pages(spark, rows)).where("page_id = 5").first().text == "The story of this page is a bit shorter."


def test_long_paths_are_kept_apart(spark):
    """Boxes whose paths differ after many characters only don't share votes or texts."""
    wide = " ".join(f"utility-z{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60))
    body = f'<div class="{wide}"><div class="story"><p>{"Story text. " * 20}</p></div><div class="column"><p>{"Column text. " * 9}</p></div></div>'
    got = extract.extract(pages(spark, [(i, "http://w.com/", page(body)) for i in range(2)])).collect()
    assert [r.text for r in got] == [("Story text. " * 20).strip()] * 2
    deep = "".join(f'<div class="level-of-the-page-{k}">' for k in "abcdefghijklmn")
    body = f'{deep}<div class="story"><p>{"Story text. " * 20}</p></div><div class="junkbox"><p>{"Junk text. " * 9}</p></div>' + "</div>" * 14
    got = extract.extract(pages(spark, [(i, "http://w.com/", page(body)) for i in range(2)])).collect()
    assert [r.text for r in got] == [("Story text. " * 20).strip()] * 2


ARTICLE = "<article><h1>Head</h1><p>" + "Text of the article. " * 9 + "</p></article>"
WANT = ("Head " + "Text of the article. " * 9).strip()


@pytest.mark.parametrize("wrapper", ["div class='content with-sidebar'", "div class='layout no-sidebar'", "div id=top", "div class=login-enabled", "form id=aspnetForm", "div class='widget'", "div class=comments-open", "div class='search header'"])
def test_wrappers_with_names_of_side_parts(wrapper):
    side = '<div class="sidebar"><p>Side text that is here.</p></div><div class="comments"><p>I think so too, and more.</p></div>'
    own = extract.Page(f"<body><div class='ad'>Buy it.</div><{wrapper}>{ARTICLE}{side}</{wrapper.split()[0]}><footer>End of it.</footer></body>")
    assert own.main_text(None) == WANT


def test_text_that_only_asides_have():
    assert extract.Page('<div class="widget"><div class="promo"><p>All there is.</p></div></div><div class="ad">Ad</div>').main_text(None) == "All there is."
    assert extract.Page('<nav>Menu</nav><div class="comments">Nothing to read</div>').main_text(None) == ""


def test_attributes():
    text = '<p data-x="display:none ok">One</p><p style="display: none">two</p><p hidden>three</p><p title="a > b \'c\'">four</p><p title=\'x"y\'>five</p><a href=x>six</a><p class="don\'t">seven</p>'
    assert extract.Page(text).main_text(None) == "One four five six seven"
    assert extract.Page("a < b <3 c<d></d> <p>x</p").main_text(None) == "a < b <3 c x"


@pytest.mark.parametrize("part", ["<script ", '<a "', "<i>", "</b>", "<i></b>", "<div>", "<p>", "<td>", "<!--", "<![CDATA[", "<svg>", '<p class="x', "<x y=' >", "<div class=ad>", "<li>", "<tr><td>", "<b><p></b>", "<title>", "< ", "&amp", "</", "<a href='", "\n\t"])
def test_long_malformed_pages(part):
    """Time is linear: eight times the length takes well under the 64 times that a quadratic reader would."""

    def seconds(n):
        html = ARTICLE + part * (n // len(part))
        t = time.thread_time()
        assert extract.Page(html).main_text(None).startswith("Head Text")
        return time.thread_time() - t

    assert seconds(800_000) < 24 * max(seconds(100_000), 0.05)


def plain_text(html):
    """Main text of well-formed pages by the standard library's parser: the text of their article, less what is left out."""

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.out = [], []

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.out.append(" ")
            elif tag not in ("img", "meta"):
                self.stack.append((tag, dict(attrs).get("class") or ""))
                self.out.append("" if tag in ("a", "b", "i", "span") else "\0")

        def handle_endtag(self, tag):
            self.stack.pop()
            self.out.append("" if tag in ("a", "b", "i", "span") else "\0")

        def handle_data(self, data):
            if any(t == "article" for t, _ in self.stack) and not any(t in ("nav", "script", "style", "aside", "footer") or k in ("ad", "comments", "share") for t, k in self.stack):
                self.out.append(data)

    r = Reader()
    r.feed(html)
    return " ".join(x for x in (" ".join(x.split()) for x in "".join(r.out).split("\0")) if x)


def test_against_a_plain_parser():
    rng = random.Random(3)

    def inline():
        words = " ".join(rng.choice(["lorem", "x &lt; y", "&eacute;t&#233;", "a\n b", "7 &amp; 8"]) for _ in range(rng.randint(3, 12)))
        return rng.choice(["{}", "<b>{}</b>", "{}<br>more", "<span class=s>{}</span> on", "<i><b>{}</b></i>"]).format(words)

    def block(depth):
        kind = rng.choice(["p", "p", "p", "ul", "div", "h2", "skip"])
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{inline()}</li>" for _ in range(3)) + "</ul>"
        if kind == "div" and depth < 3:
            return f"<div>{''.join(block(depth + 1) for _ in range(2))}</div>"
        if kind == "skip":
            return rng.choice(['<div class="ad">{}</div>', "<aside>{}</aside>", "<script>var a = '<p>';</script>", '<div class="share">{}</div>', "<!-- <p>{}</p> -->"]).format(inline())
        return f"<h2>{inline()}</h2>" if kind == "h2" else f"<p>{inline()}</p>"

    for _ in range(300):
        body = f'<nav><ul><li><a href="/">Menu</a></li></ul></nav><article><h1>{inline()}</h1><p>{"long text " * 40}</p>{"".join(block(0) for _ in range(8))}</article><div class="comments"><p>{inline()}</p></div><footer>{inline()}</footer>'
        html = f"<html><head><title>t</title></head><body>{body}</body></html>"
        assert extract.Page(html).main_text(None) == plain_text(html)


def test_salted_join_is_the_same(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.com/", page(f"<article><p>Text {i}</p></article>")) for i in range(12)]
    one = sorted(extract.extract(pages(spark, rows)).collect())
    monkeypatch.setattr(extract, "BROADCAST_HOSTS", 0)
    monkeypatch.setattr(extract, "SALT_ROWS", 3)
    assert sorted(extract.extract(pages(spark, rows)).collect()) == one
