import hashlib
import struct
import zlib

import numpy as np
import pytest

from gridlens.llm import html_extract as H
from gridlens.llm import media as M
from gridlens.llm import queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a < b) { x = "</p>"; }</script></head>
<body class="page"><header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li><li>B</li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>One <b>bo</b>ld&nbsp;word<br>next<p title="a>b">2 &lt; 3 and 1 < 2</p>%s<div class="ad">buy</div><aside>side</aside><form><p>mail</p></form><p>end &am</p></article>
<div id="comments"><p>nice!</p></div><footer>&copy; me</footer></body></html>"""


def test_main_text_of_a_full_page(spark):
    rows = [(k, f"http://h{k % 2}.org/{k}", PAGE % "".join(f"<p>par {i}</p>" for i in range(k)), "x", "y") for k in range(6)]
    rows += [(10, None, None, "x", None), (11, "http://h0.org/", "", "x", None), (12, "nourl", "just text", None, None), (13, "http://h1.org/z", "<article><p>open <b>end", None, None), (1, "http://h1.org/1", PAGE % "<p>par 0</p>", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, wrapper string")
    got = {}
    for r in H.extract(df, H.infer_wrappers(df)).collect():
        got.setdefault(r.page_id, []).append(r.text)
    for k in range(6):
        middle = "".join(f" par {i}" for i in range(k))
        want = f"Title & more One bold word next 2 < 3 and 1 < 2{middle} end &am"
        assert set(got[k]) == {want}
    assert len(got[1]) == 2
    assert (got[10], got[11], got[12], got[13]) == ([""], [""], ["just text"], ["open end"])
    none = df.where("page_id = 99")
    assert H.extract(none, H.infer_wrappers(none)).count() == 0


NOISY = {
    '<p class="ad">buy</p>': "",
    '<p class="ad">buy': "",
    '<ul><li class="related">buy<li>item</ul>': " item",
    '<ul><li class="related"><ul><li>buy</li><li>buy</ul></li><li>item</li></ul>': " item",
    '<table><tr class="header"><td>buy<tr><td>cell</table>': " cell",
    '<table><tr><td class="ad">buy<td>cell</table>': " cell",
    '<p>in <span class="alert">buy <span>buy</span> buy</span>side</p>': " in side",
    '<p>in <i aria-hidden="true"></i>side</p>': " in side",
    '<p>in <a class="social-link">buy</p>': " in",
    '<p>in <a class="social-link">buy<p>side': " in side",
    '<p>x<img class="banner">y</p>': " xy",
    '<div class="ad">buy<p>buy</div>': "",
}


@pytest.mark.parametrize("middle", NOISY)
def test_noise_ends_where_its_element_ends(middle):
    for page in (f"<body><article><p>first</p>{middle}<p>last</p></article></body>", f"<body><div><p>first</p>{middle}<p>last</p></div></body>"):
        assert " ".join(c for b in H._alone(list(H.tokens(page))) if (c := H._clean(b))) == f"first{NOISY[middle]} last"


def test_noise_ends_on_the_wrapper_path(spark):
    rows = [(k, f"http://h.org/{k}", f"<body><article><p>first {k}</p>{m}<p>last {k}</p></article></body>") for k, m in enumerate(NOISY)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(df, H.infer_wrappers(df)).collect()}
    assert got == {k: f"first {k}{NOISY[m]} last {k}" for k, m in enumerate(NOISY)}


def template_page(k, tail=""):
    paragraphs = "".join(f"<p>sentence {k} number {i}</p>" for i in range(2 + k % 4))
    return f"<body><div><p>Welcome to our place</p></div><div><h2>title {k}</h2>{paragraphs}<p>Call us any time</p></div>{tail}<div>All rights lie with us</div></body>"


def test_template_texts_go_by_comparing_pages(spark):
    """Nothing but the other pages of the host tells the template of these from their content."""
    want = lambda k: " ".join([f"title {k}", *[f"sentence {k} number {i}" for i in range(2 + k % 4)]])
    rows = [(k, f"http://h.org/{k}", template_page(k)) for k in range(40)] + [(100, "http://alone.org/", template_page(100)), (101, None, template_page(101))]
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(df, H.infer_wrappers(df, group=3)).collect()}
    assert {k: t for k, t in got.items() if k < 100} == {k: want(k) for k in range(40)}
    for k in (100, 101):
        assert got[k] == f"Welcome to our place {want(k)} Call us any time All rights lie with us"


def test_copies_of_one_article_keep_their_text(spark):
    rows = [(k, f"http://h.org/{k}", f"<body><article><h1>one title</h1><p>the same long paragraph on every page of this host</p><p>tail {k}</p></article></body>") for k in range(30)]
    rows += [(100 + k, f"http://i.org/{k}", f"<body><article><h1>title {k}</h1>{'<p>licence line</p>' * (k % 2)}<p>text {k} of its own</p></article></body>") for k in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(df, H.infer_wrappers(df)).collect()}
    for k in range(30):
        assert got[k] == f"one title the same long paragraph on every page of this host tail {k}"
        assert got[100 + k] == f"title {k}{' licence line' * (k % 2)} text {k} of its own"


def test_long_pages_are_aligned_as_well(spark):
    """Pages of over 4,000 tags and texts after folding, each with an element of its own, and so many of them that their wrapper is long."""
    kinds = ["section", "blockquote", "figure"]
    ones = [k for k in range(2300) if not bin(k).count("1") % 2]
    order = [b - a - 1 for a, b in zip(ones, ones[1:], strict=False)][:1100]  # no stretch of it is repeated at once

    def page(k, n):
        middle = "".join(f"<{kinds[o]}><div>part {k} {i}</div></{kinds[o]}>" for i, o in enumerate(order[:n]))
        own = "".join(f"<x-{k}-{i}><div>aside {k} {i}</div></x-{k}-{i}>" for i in range(60))
        return f"<body><h1>Welcome to our place</h1>{own}{middle}<h6>Call us any time</h6></body>"

    want = lambda k, n: " ".join([*[f"aside {k} {i}" for i in range(60)], *[f"part {k} {i}" for i in range(n)]])
    rows = [(k, f"http://{h}.org/{k}", page(k, n)) for h, n, at in (("long", 1100, 0), ("many", 40, 100)) for k in range(at, at + (12 if n > 40 else 30))]
    assert len(H.fold([t for t, _, _ in H.placed(rows[0][2])])) > 4000
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    wrappers = H.infer_wrappers(df)
    got = {r.page_id: r.text for r in H.extract(df, wrappers).collect()}
    for k in got:
        assert got[k] == want(k, 1100 if k < 100 else 40)


def test_streams_cut_for_alignment_are_all_read():
    rng = np.random.default_rng(5)
    for n in range(60):
        names = [f"<{i}>" for i in range(int(rng.choice([2, 5, 400])))]
        one = [str(x) for x in rng.choice(names, rng.integers(0, 120))]
        two = [x for x in one if rng.random() < 0.8] + [str(x) for x in rng.choice(names, rng.integers(0, 40))]
        for whole in (1, 50, 1 << 20):
            found = H.equal_blocks(one, two, whole)
            assert all(one[i : i + k] == two[j : j + k] for i, j, k in found)
            assert all(a + k <= c and b + k <= d for (a, b, k), (c, d, _) in zip(found, found[1:], strict=False))
        wide, again = H.equal_blocks(one, one, 1), H.equal_blocks(one, two, 50)
        assert sum(k for *_, k in wide) == len(one)
        assert len(one) < 100 or len(names) < 400 or sum(k for *_, k in again) > 0.7 * len(one)


def test_blocks_of_the_other_side_are_grouped_everywhere():
    g = ("+", ("<p>", "#"))
    side = [(x, x == "<q>") for x in ["<q>", "<p>", "#", g, "<p>", "<p>", "#", "<b>", g, g]]
    assert H._grouped(side, [g, ("+", ("<z>",)), g]) == [("<q>", True), (g, False), ("<p>", False), (g, False), ("<b>", False), (g, False)]


def extracted(spark, pages):
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(df, H.infer_wrappers(df)).collect()}
    return [got[k] for k in range(len(pages))]


def test_other_pages_take_no_text_away(spark):
    """Half of a host's pages have an element before their text that is noise, the others have text there."""
    for noise, main in (("aside", "article"), ("nav", "main")):
        pages = [(f"http://{noise}.org/a{k}", f"<{main}><{noise}>side note {k}</{noise}><p>para {k}</p></{main}>") for k in range(6)]
        pages += [(f"http://{noise}.org/b{k}", f"<{main}>lead text {k} right there<p>para {k}</p></{main}>") for k in range(6)]
        pages += [(f"http://{noise}.org/c{k}", f"<{noise}>menu {k}</{noise}><{main}>lead {k}</{main}>") for k in range(3)]
        assert extracted(spark, pages) == [f"para {k}" for k in range(6)] + [f"lead text {k} right there para {k}" for k in range(6)] + [f"lead {k}" for k in range(3)]


def test_pages_without_host_are_not_compared(spark):
    pages = [(None, "<article><aside>x</aside><p>one</p></article>"), (None, "<article>lead<p>two</p></article>"), ("", "<p>same</p>")] + [(None, f"<div>same</div><p>p {k}</p>") for k in range(8)]
    assert extracted(spark, pages) == ["one", "lead two", "same"] + [f"same p {k}" for k in range(8)]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<body class="single-post has-sidebar"><p>a</p><div class="sidebar">no</div></body>', "a"),
        ('<html class="sticky-header"><body class="sidebar"><article>a</article></body></html>', "a"),
        ('<article class="post comments-open">a<article class="comment">no</article></article>', "a"),
        ('<article>a<section id="related-work">b</section><section id="related-posts">no</section></article>', "a b"),
        ('<article><div class="article-header"><h1>t</h1></div>a<div class="site-header">no</div></article>', "t a"),
        ('<div class="ad-box">no</div><main class="no-sidebar">a<p class="cookie_notice">no</p></main>', "a"),
        ('<main class="sidebar">long text of the page<p>more</p></main><div>x</div>', "long text of the page more"),
        ('<div>the text of the page</div><article class="comment">no</article><article class="comment">no</article>', "the text of the page"),
        ('<div>the text of the page itself</div><article class="comment">no</article>', "the text of the page itself"),
    ],
)
def test_class_words_of_real_pages(page, text):
    assert " ".join(c for b in H._alone(list(H.tokens(page))) if (c := H._clean(b))) == text
    assert " ".join(c for _, b, main in H.placed(page) if main and (c := H._clean(b))) == text


def test_no_article_text_is_lost_beside_others(spark):
    """Random pages of a few hosts: as each is read by itself."""
    import random

    rng = random.Random(12)
    count = iter(range(10**6))

    def element(depth):
        kind = rng.choice(["#", "#", "p", "div", "ul", "aside", "nav", "section", "b", "ad"])
        if kind == "#":
            return f"text {next(count)} "
        inner = "".join(element(depth + 1) for _ in range(rng.randrange(0, 4 - depth))) if depth < 3 else f"deep {next(count)}"
        if kind == "ad":
            return f'<div class="ad">{inner}</div>'
        return f"<ul><li>{inner}</ul>" if kind == "ul" else f"<{kind}>{inner}</{kind}>"

    body = lambda: "".join(element(0) for _ in range(rng.randrange(1, 6)))
    pages = [(f"http://h{k % 5}.org/{k}", rng.choice(["<body><article>%s</article></body>", "<main>%s</main>", "<body>%s</body>", "<nav>m</nav><article>%s</article><footer>f</footer>"]) % body()) for k in range(200)]
    want = [" ".join(c for b in H._alone(list(H.tokens(p))) if (c := H._clean(b))) for _, p in pages]
    assert extracted(spark, pages) == want and sum(map(bool, want)) > 150


def test_wrapper_is_generalised(spark):
    streams = [["<a1>", "#", "</a1>"], ["<a1>", ("+", ("<p>", "#")), "</a1>"], ["<a1>", "<p>", "#", "<x>", "</a1>"]]
    w = [(i, False) for i in streams[0]]
    for s in streams[1:]:
        w = H.align(w, s)
    assert H.show(w) == "<a1>(#)?((<p>#)+)?(<x>)?</a1>"
    assert H.fold(["<p>", "#", "<p>", "#", "<p>", "#"]) == [("+", ("<p>", "#"))]


def test_given_pages(spark, data):
    import html
    import re

    pages = {p.page_id: p for p in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in queries.QUERIES["op3_html_extraction"](spark, data).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner)]
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_media_round_trip(spark, odd_docs, no_docs):
    got = M.png_features(M.to_png(odd_docs)).collect()
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r.doc_id, r.text)
    assert len(got) == odd_docs.count()
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert len(r.hash) == 8
    assert M.png_features(M.to_png(no_docs)).count() == 0


def plain_filter(pixels, kinds):
    """Each row filtered by its kind, byte by byte."""
    h, w = pixels.shape
    out = []
    for y in range(h):
        line = []
        for x in range(w):
            a = int(pixels[y, x - 1]) if x else 0
            b = int(pixels[y - 1, x]) if y else 0
            c = int(pixels[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            near = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            line.append((int(pixels[y, x]) - (0, a, b, (a + b) // 2, near)[kinds[y]]) % 256)
        out.append(bytes([kinds[y], *line]))
    return b"".join(out)


def test_every_png_filter():
    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 256, (12, 17), dtype=np.uint8)
    kinds = [0, 1, 2, 3, 4, 4, 3, 2, 1, 0, 4, 3]
    header = struct.pack(">IIBBBBB", 17, 12, 8, 0, 0, 0, 0)
    body = zlib.compress(plain_filter(pixels, kinds))
    png = M._SIGNATURE + M._chunk(b"IHDR", header) + M._chunk(b"tEXt", b"k\0v") + M._chunk(b"IDAT", body[:20]) + M._chunk(b"IDAT", body[20:]) + M._chunk(b"IEND", b"")
    assert (M.read_png(png) == pixels).all()
    assert (M.read_png(M.write_png(pixels)) == pixels).all()
    for at in (0, 20, 45, len(png) - 2):
        with pytest.raises((ValueError, zlib.error)):
            M.read_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    with pytest.raises(ValueError):
        M.read_png(png[:-12])


def test_hash_follows_low_frequencies():
    y, x = np.mgrid[0:64, 0:192]
    rng = np.random.default_rng(0)
    waves = sum(rng.normal() * np.cos(np.pi * (2 * y + 1) * v / 128) * np.cos(np.pi * (2 * x + 1) * u / 384) for v in range(8) for u in range(8))
    smooth = (127 + waves * 100 / np.abs(waves).max()).astype(np.uint8)
    noisy = np.clip(smooth + np.random.default_rng(1).integers(-9, 10, smooth.shape), 0, 255).astype(np.uint8)
    bits = lambda a, b: sum(bin(p ^ q).count("1") for p, q in zip(M.cosine_hash(a), M.cosine_hash(b), strict=True))
    assert bits(smooth, noisy) < 14 < bits(smooth, np.random.default_rng(2).integers(0, 256, smooth.shape).astype(np.uint8))
