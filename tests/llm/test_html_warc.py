import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from tributary.llm import warc
from tributary.llm.html_text import extract_text, main_text

LONG = "Here is a paragraph of the article that goes on for long enough to be told from its surroundings, which it should."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="with-sidebar"><header class="top"><a href="/">Site</a> slogan</header>
<div id="cookie-notice"><p>{LONG}</p></div><div class="layout"><div class="sidebar"><ul><li><a href=1>one</a></li></ul></div>
<div class="content"><h1>Title &eacute;&nbsp;x</h1><section><p>{LONG} With <a href=x>a link</a> and <em>em</em>phasis.</p><p>Second<br>line &lt;b&gt; &amp;amp; more.</p></section>
<section><h2>Sub</h2><p>{LONG}</p><ul><li>item one<li>item two</ul></section><form><p>Subscribe now!</p></form></div></div>
<div id="comments"><div><p>{LONG} I enjoyed it!</p></div></div><script>var a = "</p>" + '<p>no</p>';</script><footer><p>{LONG}</p></footer></body></html>"""
TEXT = f"Title é x\n{LONG} With a link and emphasis.\nSecond line <b> &amp; more.\nSub\n{LONG}\nitem one\nitem two"

CASES = {
    PAGE: TEXT, None: "", "": "", "   ": "", "plain text": "plain text", "<p>only</p>": "only", "<div class=ad>x</div>": "", "<!-- c --><p>a<p>b": "a\nb",
    '<body><p>a</p><script>var x="</p><p>no"</script></body>': "a", "<p>a &am &amp &notanentity; &#65;&#x42;</p>": "a &am & ¬anentity; AB", "<nav><a>x</a></nav><article><h1>T</h1><p><b>one<br><p>two</article><footer>f": "T\none\ntwo",
    f"<article><header><h1>H</h1></header><p>{LONG}</p><aside>side</aside><footer>by</footer></article>": f"H\n{LONG}", "<p>unclosed <b>bold <i>both</p><p>next": "unclosed bold both\nnext", "<table><tr><td>a<td>b<tr><td>c</table>": "a\nb\nc", "<p>x < y</p>": "x < y",
}


@pytest.mark.parametrize("html", CASES, ids=lambda h: str(h)[:20])
def test_text(html):
    assert main_text(html) == CASES[html]


@pytest.mark.parametrize("raw", ["<script>for(i=0;i<n;i++){f(i)} // don't stop</script>", "<script>var s = '<!--';</script>", "<style>a:after{content:\"<b 'x\"}</style>", '<script>if(a<b){t="</p>"}</script>'])
def test_markup_after_raw_text(raw):
    assert main_text(f"{raw}<nav><a href=x>site</a></nav><article><p>It's an article.</p><p>{LONG}</p></article>") == f"It's an article.\n{LONG}"


def test_very_long_and_deep():
    assert main_text("<p>" + "word " * 200_000 + "</p>") == ("word " * 200_000).strip()
    assert main_text("<div>" * 5000 + f"<p>{LONG}</p>") == LONG


def pages(spark):
    rows = [(1, "u1", PAGE), (2, None, None), (3, "u3", ""), (4, "u4", PAGE), (9, "u9", PAGE), (5, "u5", "é" * 400_000), (6, "u6", "é" * 400_000), (None, "n", "x"), (None, "n", "x"), (7, "a b", "x"), (8, "u", "one"), (8, "u", "one")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("chunk", F.lit(1)).repartition(3)


def test_pages(spark):
    rows, df = pages(spark)
    got = sorted(((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in extract_text(df).collect()))
    assert got == sorted((i or 0, u or "", main_text(h), len(main_text(h))) for i, u, h in rows)
    assert extract_text(df.limit(0)).count() == 0


def test_archives(spark):
    rows, df = pages(spark)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = first[h or ""] if i is not None and i > first[h or ""] else None
        want.append((i or 0, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if to else "response", to or 0))
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.archive_round_trip(df).collect())
    assert got == sorted(want)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_revisits_of_repeated_ids(spark):
    """Rows that share an id are told apart by their payloads."""
    rows = [(1, "u", "one"), (2, "u", "two"), (5, "u", "one"), (5, "u", "other"), (6, "u", "one"), (6, "u", "two")]
    got = sorted((r.page_id, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    first = {"one": 1, "two": 2, "other": 5}
    assert got == sorted((i, base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if i > first[h] else "response", first[h] if i > first[h] else 0) for i, _, h in rows)


def test_a_payload_of_many_pages(spark, monkeypatch):
    """Dealt to several tasks, whose number is looked up or joined."""
    rows = [(i, "u", "same" if i % 3 else f"own {i % 9}") for i in range(60)] + [(None, "u", "same"), (None, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(str, warc.archive_round_trip(df).collect()))
    monkeypatch.setattr(warc, "PART", 7)
    for lookups in (100, 0):
        monkeypatch.setattr(warc, "LOOKUPS", lookups)
        assert sorted(map(str, warc.archive_round_trip(df).collect())) == want


def test_chunks(spark, tmp_path):
    rows, df = pages(spark)
    files = warc.write_archives(warc.chunk_table(df), f"file://{tmp_path}")
    got = [r for r in warc.read_archives(spark, files).collect() if r.record_id == "<urn:page:5>"]
    got.sort(key=lambda r: r.chunk)
    data = ("é" * 400_000).encode()
    assert len(got) == 4 and b"".join(bytes(r.data) for r in got) == data and [r.last for r in got] == [False] * 3 + [True]
    for r in got:
        assert r.digest_so_far == base64.b32encode(hashlib.sha1(data[: r.start + len(r.data)]).digest()).decode()
