import os
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import html, media


def text_of(page, low=None):
    return html.main_text(page, low)


def test_declared_parts_go():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header>top</header><nav><a>menu</a></nav><div class="cookie-notice">ok?</div>
    <main><article><h1>Title &amp; more</h1><p>One <b>two</b>three<br>four&nbsp;five<p>Six<script>var a = "</p>";</script><div class="ad">buy</div><form><input>send</form></p>
    <section id="comments"><p>first!</p></section></article></main><aside>side</aside><footer>&copy; x</footer></body></html>"""
    assert text_of(page) == "Title & more One twothree four five Six"


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a b"), ("<article><p>cut off <b>here", "cut off here"), ("<p>1 < 2 &lt; 3</p>", "1 < 2 < 3"), ("<p>a<!-- b --", "a"), ("<ul><li>x<li>y</ul>z", "x y z"), ("<script>never closed", ""), ("<p title='a>b'>c</p>", "c")])
def test_odd_markup(page, text):
    assert text_of(page) == text


@settings(max_examples=200, deadline=None)
@given(page=st.text(st.sampled_from("<>/!-\"'= abpdiv&;#1"), max_size=80))
def test_any_text_parses(page):
    blocks, nodes = html.parse(page)
    assert all(b.text == " ".join(b.text.split()) for b in blocks) and nodes


def test_low_importance_branches_are_those_that_repeat():
    m = 20
    pages = [f'<div class="frame"><div class="strip">Same words on each page</div><div class="story">Story number {i} with text of its own</div></div>' for i in range(m)]
    rows = {}
    for p in pages:
        for path, kind, item in html.evidence(p):
            rows[path, kind, item] = rows.get((path, kind, item), 0) + 1
    tree = pd.DataFrame(
        [
            {
                "path": path,
                "m": sum(c for (p, k, _), c in rows.items() if p == path and k == 0),
                "shown_log": sum(c * np.log(c) for (p, k, _), c in rows.items() if p == path and k == 0),
                "texts": sum(1 for (p, k, _) in rows if p == path and k == 1),
                "text_log": sum(np.log(c) for (p, k, _), c in rows.items() if p == path and k == 1),
            }
            for path in {p for p, _, _ in rows}
        ]
    )
    assert html.low_paths(tree, html.Settings()) == ["/div.frame/div.strip"]


def test_extraction_uses_trees_by_host_and_keeps_rows(spark):
    page = lambda i, host: (i, f"http://{host}/{i}", f'<div class="strip">Same words</div><div class="story">Own text {i}</div>', "x")
    rows = [page(i, "a.example") for i in range(30)] + [page(100, "b.example"), (200, None, None, "x"), (None, "http://a.example/z", "", "x"), (201, "http://a.example/dup", "<article>same</article>", "x"), (201, "http://a.example/dup", "<article>same</article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, low string")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got[5] == "Own text 5" and got[100] == "Same words Own text 100" and got[200] == "" and got[None] == "" and got[201] == "same"
    assert html.extract(pages).count() == len(rows) and html.extract(pages.limit(0)).count() == 0
    joined = {r.page_id: r.text for r in html.extract(pages, settings=html.Settings(broadcast_bytes=0)).collect()}
    assert joined == got


def test_long_pages_and_repeated_article_texts(spark):
    long = "<article><p>" + "word " * 100_000 + "</p></article>"
    pages = spark.createDataFrame([(i, "http://c.example/", long if i == 0 else "<article><p>copied</p></article>") for i in range(12)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert len(got[0]) == 5 * 100_000 - 1 and {got[i] for i in range(1, 12)} == {"copied"}


def test_trees_prune_articles_and_teasers_do_not_hide_bodies(spark):
    page = lambda i: (i, f"http://d.example/{i}", f'<main><div class="strip">Same words on each page</div><div class="story">Own text {i} of this page</div></main>')
    teaser = (99, "http://e.example/", "<article>Short teaser</article><div><p>The body in plain divs is longer.</p><p>It goes on.</p></div>")
    pages = spark.createDataFrame([*map(page, range(20)), teaser], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got[7] == "Own text 7 of this page"
    assert got[99] == "Short teaser The body in plain divs is longer. It goes on."


@pytest.mark.parametrize("open_, close", [('<div class="layout has-sidebar">', "</div>"), ('<div id="page" class="no-sidebar">', "</div>"), ('<div class="comments-open">', "</div>"), ("<form>", "</form>")])
def test_wrappers_of_the_text_stay(open_, close):
    nav, ad = "<nav>menu</nav>", '<div class="ad">buy this and more of it</div>'
    assert text_of(f"{open_}{nav}<article>The body</article>{ad}{close}") == "The body"
    assert text_of(f"<article>{open_}{nav}<p>The body</p>{close}</article>{ad}") == "The body"
    assert text_of(f"{nav}{open_}<p>The body of a page without any article</p>{close}") == "The body of a page without any article"
    if "comments" not in open_:
        assert text_of(f"<article>Teaser</article>{open_}{'<p>The body</p>' * 20}{close}") == " ".join(["Teaser", *["The body"] * 20])


def test_named_parts_next_to_the_text_go():
    comments = '<div id="comments"><p>A comment that is longer than all the article</p></div>'
    related = '<div class="related"><article>One more</article><article>Two more</article><article>Three more</article></div>'
    form = "<form>Send us a letter of many words</form>"
    for part in (comments, related, form):
        assert text_of(f"<article>The body here</article>{part}") == text_of(f"<main><article>The body here</article></main>{part}") == "The body here"
    assert text_of(f"<article>The body here{comments}</article>") == text_of(f"<main><article>The body here</article>{comments}</main>") == "The body here"
    assert text_of(f"<div>The body here, in plain elements, is long</div>{form}") == "The body here, in plain elements, is long"


def test_elements_of_any_depth():
    deep, up = "<div>" * 250, "</div>" * 250
    assert text_of(f"{deep}<p>body</p><nav>menu</nav><footer>foot</footer>") == "body"
    assert text_of(f"{'<font>' * 300}<p>body</p><nav>menu</nav>") == "body"
    assert text_of(f"<div><article>{deep}first{up}<p>rest</p></article></div>") == "first rest"
    assert text_of(f"<main>{'<div>x' * 20_000}<aside>y") == " ".join("x" * 20_000)


def test_long_paths_are_told_apart_and_linked(spark):
    names = "".join(f'<div class="part{chr(97 + k % 26)}">' for k in range(60))
    page = lambda i: f'<div class="left">{names}Own text {i} of this page{"</div>" * 61}<div class="right">{names}<div>Same words</div><div>on each page</div>{"</div>" * 61}'
    blocks, nodes = html.parse(page(0))
    assert len({b.path for b in blocks}) == 2 and all(len(n.path) <= 300 for n in nodes)
    rows = [(i, "http://f.example/", page(i)) for i in range(20)]
    found = html.style_trees(spark.createDataFrame(rows, "page_id long, url string, html string"), "url", "html", html.Settings()).collect()
    assert "/div.right" in found[0].low and "/div.left" not in found[0].low
    assert html.main_text(page(3), ["/div.right"]) == "Own text 3 of this page"


# -- media ------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(data=st.binary(max_size=700))
def test_images_round_trip(data):
    payload = media.padded(data)
    assert len(payload) % 192 == 0 and len(payload) > 0
    image = media.to_png(payload, len(data))
    samples, n = media.from_png(image)
    assert samples.tobytes() == payload and n == len(data) and image == media.to_png(payload, len(data))
    assert media.feature(samples) == media.feature(samples)


def test_damaged_images_are_told():
    image = bytearray(media.to_png(media.padded(b"abc"), 3))
    image[60] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(image))


DOCS = [(1, "hello", 1), (2, None, 2), (3, "", 3), (None, "né" * 400, 4), (5, "hello", 5), (5, "hello", 6), (6, "x" * 300_000, 7)]


def test_media_columns(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, media int")
    rows = media.media_columns(docs).collect()
    want = {str(i): len((t or "").encode()) for i, t, _ in DOCS}
    assert sorted((str(r.doc_id), r.n_bytes) for r in rows) == sorted((str(i), len((t or "").encode())) for i, t, _ in DOCS) and want
    same = [(r.media_sha256, r.payload_sha256, r.feature, r.tail_crc32) for r in rows if r.n_bytes == 5]
    assert len(same) == 3 and len(set(same)) == 1
    assert media.media_columns(docs.limit(0)).count() == 0


def test_text_ids_come_back(spark):
    ids = ["", None, "a/b c", "é=1", "/="]
    docs = spark.createDataFrame([(i, "x") for i in ids], "doc_id string, text string")
    assert sorted(str(r.doc_id) for r in media.media_columns(docs).collect()) == sorted(map(str, ids))


def archive(spark, tmp_path, n=50):
    docs = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(n)], "doc_id long, text string").coalesce(1)
    folder = f"{tmp_path}/archives"
    assert media.write_archives(docs, folder)["members"] == n
    return folder


def test_byte_ranges_cover_each_member_once(spark, tmp_path):
    folder = archive(spark, tmp_path)
    for split in (64, 1000, 1 << 20):
        got = media.read_archives(spark, folder, splitBytes=str(split)).collect()
        assert len({(r.archive, r.offset) for r in got}) == len(got) == 50


def test_members_are_tried_again_by_offset(spark, tmp_path, monkeypatch):
    folder = archive(spark, tmp_path)
    reader = media.ArchiveReader({"path": folder, "waitseconds": "0"})
    real, seen = media.member_at, {}

    def flaky(f, info):
        seen[info.filename] = seen.get(info.filename, 0) + 1
        if info.filename.startswith("0000007") and seen[info.filename] < 3:
            raise OSError("lost")
        return real(f, info)

    monkeypatch.setattr(media, "member_at", flaky)
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert rows == 50 and sorted(seen.values()) == [1] * 49 + [3]


def test_damaged_members_fail_or_are_kept_with_their_error(spark, tmp_path):
    folder = archive(spark, tmp_path)
    file = os.path.join(folder, os.listdir(folder)[0])
    info = zipfile.ZipFile(file).infolist()[7]
    with open(file, "r+b") as f:
        f.seek(info.header_offset + 60)
        f.write(b"\x00\x01\x02")
    with pytest.raises(Exception, match="damaged"):
        media.read_archives(spark, folder, waitSeconds="0").collect()
    rows = media.read_archives(spark, folder, waitSeconds="0", errors="keep").collect()
    assert len(rows) == 50 and [r.member for r in rows if r.error] == [info.filename]
