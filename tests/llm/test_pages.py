import gzip
import hashlib
import os

import pytest

from kinweave.llm.html_text import blocks, common_lines, extract_text
from kinweave.llm.url_filter import judge_urls
from kinweave.llm.warc import header_fields, parse_warc, read_records, read_warc, reconstruct, write_archive, write_warc

BIG = "<p>" + "é big page " * 200
PAGES = [
    (1, "http://a.com/x", BIG), (2, "http://a.com/y", BIG), (9, "http://b.net/z", BIG), (3, None, None), (4, "http://c.org/", ""), (5, "u", "small"),
    (6, "v", "small"), (None, "w", "lone"), (None, "http://a.com/n", BIG), (7, "http://d.org/\r\nInjected: 1", "a\r\n\r\nb"), (7, "http://d.org/", "a\r\n\r\nb"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS digest", "1 AS copy", "'y' AS body")


def test_archive(spark):
    archive = write_archive(pages(spark))
    got = {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read_records(archive).collect()}
    want = set()
    for i, _, html in PAGES:
        body = (html or "").encode()
        revisit = html == BIG and i != 9
        want.add((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    assert got == want
    assert archive.payloads.select("digest").distinct().count() == archive.payloads.count() == 5
    assert reconstruct(archive).count() == len(PAGES)
    empty = write_archive(pages(spark).limit(0))
    assert read_records(empty).count() == 0


def test_warc_files_round_trip(spark, tmp_path):
    write_warc(write_archive(pages(spark)), str(tmp_path / "w"), records_per_file=3)
    got = sorted((r["record_type"], r["url"], r["body"].decode()) for r in read_warc(spark, str(tmp_path / "w")).collect())
    want = sorted(
        ("revisit" if h == BIG and i != 9 else "response", (u or "").replace("\r\n", ""), "" if h == BIG and i != 9 else h or "") for i, u, h in PAGES
    )
    assert got == want


def test_binary_and_long_payloads(spark, tmp_path):
    odd = [b"\xff\xfe\x00\r\n\r\n" * 300, "é".encode() * 3_000_000, b"", None, b"\x80", b"\xff\xfe\x00\r\n\r\n" * 300]
    df = spark.createDataFrame([(i, f"http://a.com/{i}", bytearray(b) if b is not None else None) for i, b in enumerate(odd)], "page_id bigint, url string, html binary")
    archive = write_archive(df)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read_records(archive).collect()}
    assert got == {
        i: (len(b or b""), hashlib.sha1(b or b"").hexdigest(), "revisit" if i == 0 else "response", 5 if i == 0 else None) for i, b in enumerate(odd)
    }
    write_warc(archive, str(tmp_path / "w"))
    back = {r["url"][-1]: bytes(r["body"]) for r in read_warc(spark, str(tmp_path / "w")).collect()}
    assert back == {str(i): b"" if i == 0 else b or b"" for i, b in enumerate(odd)}
    write_warc(write_archive(df.limit(0)), str(tmp_path / "none"))
    assert read_warc(spark, str(tmp_path / "none")).count() == 0
    for bad in (b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab", b"WARC/1.1\r\nContent-Length: 5\r\n"):
        with pytest.raises(ValueError):
            list(parse_warc(bad))


def test_many_records_of_one_payload(spark, monkeypatch):
    from kinweave.llm import warc

    monkeypatch.setattr(warc, "ROWS_PER_COPY", 10)
    archive = write_archive(pages(spark, [(i, "u", BIG) for i in range(95)]))
    assert archive.payloads.count() == 10
    got = read_records(archive).collect()
    assert len(got) == 95 and sum(r["record_type"] == "response" for r in got) == 1 and {r["refers_to"] for r in got} == {None, 94}


def test_urls(spark):
    rows = [
        (1, "http://a.com/x", "allow", "com/"), (2, "https://www.example.com/en/1?q#f", "allow", "www.example.com/en/"),
        (3, "https://blog.EXAMPLE.com/en/", "block", "example.com/en/"), (4, "http://x.net/fr/a", "block", "net/fr/"),
        (5, "http://com/", "allow", "com/"), (6, None, "block", None), (7, "no scheme", "block", None), (8, "http://a.com", None, None),
        (9, "http://notexample.com/en/", "allow", "com/"), (10, "http://é.org/x?http://y.com/", None, None), (10, "http://é.org/x?http://y.com/", None, None),
    ]
    df = spark.createDataFrame([(i, u) for i, u, *_ in rows], "page_id bigint, url string").selectExpr("*", "1 AS rule", "2 AS host", "3 AS path")
    got = judge_urls(df).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    for i, _, verdict, rule in rows:
        assert by[i]["rule"] == rule and (verdict is None or by[i]["verdict"] == verdict) and by[i]["verdict"] in ("allow", "block")
    assert (by[10]["host"], by[10]["path"]) == ("é.org", "/x") and (by[8]["host"], by[8]["path"], by[6]["host"]) == ("a.com", "", "")
    assert judge_urls(df.limit(0)).count() == 0


def test_long_urls_and_plans(spark):
    rows = [(i, f"http://a{i}.com/library/{i}") for i in range(5)] + [(9, "http://q.org/" + "ab/" * 300_000), (10, "http://" + "x" * 100_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    judged = judge_urls(df)
    got = {r["page_id"]: (len(r["host"]), len(r["path"]), r["verdict"]) for r in judged.collect()}
    assert got[9][:2] == (5, 900_001) and got[10][:2] == (100_000, 0) and got[0][2] == "allow"


def test_url_model_tells_what_rules_taught(spark):
    good = [(i, f"http://good{i}.com/library/books/{i}") for i in range(40)]
    bad = [(100 + i, f"http://xx{i}.net/fr/win-cash-{i}") for i in range(40)]
    asked = [(500, "http://q.org/library/books/7"), (501, "http://q.org/fr/win-cash-7")]
    df = spark.createDataFrame(good + bad + asked, "page_id bigint, url string")
    got = {r["page_id"]: r["verdict"] for r in judge_urls(df).collect()}
    assert got[500] == "allow" and got[501] == "block"


ARTICLE = """<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li>Menu</ul></nav>
<div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>One
  two&nbsp;three.<br>four<p>Five &lt;x&gt;<ul><li>six<li>seven</ul><form>Name</form><div class="related posts">more</div>
<section id="comments"><article>first!</article></section><p>Last</article><aside>Side</aside><footer>&copy; us</footer></body></html>"""


def test_article():
    assert blocks(ARTICLE) == (["Head & line", "One two three. four", "Five <x>", "six", "seven", "Last"], True)


def test_marks_are_whole_tokens_of_named_attributes():
    kept = (
        '<article style="overflow:hidden">', '<article class="post comments-open">', '<main class="content has-sidebar">', '<article class="share-this">',
        '<article aria-hidden="false" data-id="comments">', "<article data-state='a hidden thing' title=hidden>", '<div role="main" class="page no-sidebar">',
    )
    for tag in kept:
        end = f"</{tag[1:].split()[0]}>"
        assert blocks(f"<body><nav>Menu</nav>{tag}<p>Text</p>{end}<p>rest</p></body>") == (["Text"], True), tag
    for outer in ('<body class="no-sidebar login">', '<html class="search"><body>', '<div class="comments-open no-sidebar">'):
        assert blocks(f"{outer}<p>Text</p>") == (["Text"], False), outer
        assert blocks(f"{outer}<article><p>Text</p></article>") == (["Text"], True), outer
    gone = (
        "<article class=comment>", '<article class="big ad">', "<article hidden>", '<div class="site-header">', '<div id="comment-list">', "<div class='related-posts'>",
        '<div aria-hidden="true">', '<p HIDDEN="">', '<div class="x sidebar">', '<div role=navigation>',
    )
    for tag in gone:
        end = f"</{tag[1:-1].split()[0]}>"
        assert blocks(f"<body>{tag}gone{end}<p>rest</p></body>") == (["rest"], False), tag


def test_open_pages_lose_what_they_share_with_their_neighbour(spark):
    def page(own):
        return f"<body><div>Welcome to the site</div><p>{own}</p><div>Common</div><p>{own} too</p><div>All rights reserved</div></body>"

    rows = [(i, f"http://h.com/p/{i}", page(f"own text {i}")) for i in range(5)]
    rows += [(20, "http://h.com/p/2b", page("own text 2")), (30, "http://lone.com/", page("alone")), (31, None, "<p>no url</p>"), (32, "http://h.com/z", None)]
    rows += [(40, "http://h.com/q", ARTICLE), (41, "http://h.com/r", ARTICLE)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS text", "1 AS lines")
    found = extract_text(df).collect()
    got = {r["page_id"]: r["text"] for r in found}
    assert len(found) == len(rows)
    for i in range(5):
        assert got[i] == f"own text {i}\nown text {i} too"
    assert got[20] == got[2] and got[30].startswith("Welcome") and got[31] == "no url" and got[32] == ""
    assert got[40] == got[41] == "Head & line\nOne two three. four\nFive <x>\nsix\nseven\nLast"
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert extract_text(df.limit(0)).count() == 0


def test_the_nearest_page_shares_the_longest_beginning(spark):
    paths = ["/a/x", "/b/1", "/b/2", "/b/20/z", "/b/21", "/c", "/c/d/1", "/c/d/1?x", "/d", ""]
    rows = [(i, f"http://h.com{p}", "\n".join(f"<p>{r}</p>" for r in ["all", f"part {p[:3]}", f"deep {p[:5]}", f"own {i}", f"end {p[:2]}"])) for i, p in enumerate(paths)]
    rows += [(50 + i, f"http://{'abcdefgh'[i]}.org/b/1", "<p>all<p>of each host") for i in range(8)]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    lists = {i: [x[3:-4].strip() for x in page.split("\n")] for i, _, page in rows if i < 50}
    path = lambda i: paths[i].split("?")[0]
    for i in range(len(paths)):
        order = sorted((j for j in lists if j != i), key=lambda j: (len(os.path.commonprefix([path(i), path(j)])), path(j) < path(i)))
        far = len(os.path.commonprefix([path(i), path(order[-1])]))
        nearest = [j for j in order if len(os.path.commonprefix([path(i), path(j)])) == far]
        wanted = {"\n".join(x for k, x in enumerate(lists[i]) if k not in common_lines(lists[i], lists[j])) for j in nearest}
        assert got[i] in wanted, (paths[i], got[i], wanted)
    assert all(got[50 + i] == "all\nof each host" for i in range(8))
    # The page before in the order of paths is /a/x here, the nearest is /b/2, with which more lines are shared.
    assert got[1] == "deep /b/1\nown 1"


def test_a_page_that_very_many_copies_share(spark):
    rows = [(i, f"http://h.com/{i % 7}", "<p>menu<p>copied text") for i in range(900)] + [(1000, "http://h.com/x", "<p>menu<p>other text")]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert len(got) == 901 and {got[i] for i in range(900)} == {"copied text"} and got[1000] == "other text"


def test_adverts_of_vendors_and_what_is_not_shown():
    inner = "".join(
        f"<div {a}>gone</div>"
        for a in (
            'class="adsbygoogle"', 'class="ad-banner-300x250"', 'class="user-comments"', 'style="display:none"', "style='color:red; DISPLAY : none'", 'class="google-ads"',
        )
    )
    assert blocks(f"<article><p>one</p>{inner}<div class='address adoption' style='display:block'>two</div></article>") == (["one", "two"], True)


def test_teasers_are_the_article_only_if_most_text_is_theirs():
    teaser = '<article class="teaser"><p>{}</p></article>'
    assert blocks('<div id="content"><p>Long real text</p></div>' + teaser.format("next")) == (["Long real text", "next"], False)
    assert blocks("<p>short</p>" + teaser.format("most of the text")) == (["most of the text"], True)
    assert blocks("<article><p>story</p></article>" + teaser.format("another story, a long one")) == (["story"], True)
    assert blocks(f"<aside>{teaser.format('next')}</aside><p>text</p>") == (["text"], False)


def test_a_quote_that_is_never_closed():
    assert blocks('<article><p title="abc>text</p></article>') == (["text"], True)
    assert blocks("<article><p>a</p><script src='x>var y = 1</script><p>it</p></article>") == (["a", "it"], True)
    assert blocks('<article><p data-x="1 > 0">a < b, "c"</p></article>') == (['a < b, "c"'], True)


def test_neighbours_across_partitions(spark):
    """Each list of a partition's edge meets the one before or after it, however small the partitions."""
    rows = [(i, f"http://h/{i:04d}", f"<p>menu</p><p>text {i}</p>") for i in range(60)] + [(99, "http://other/", "<p>menu</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in ("1", "7", "40"):
        with_parts(spark, parts)
        try:
            found = {r.page_id: r.text for r in extract_text(pages).collect()}
        finally:
            with_parts(spark, None)
        assert found == {i: f"text {i}" for i in range(60)} | {99: "menu"}


def with_parts(spark, parts):
    for key, value in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.shuffle.partitions", parts)):
        KEPT.setdefault(key, spark.conf.get(key))
        spark.conf.set(key, value if parts else KEPT[key])


KEPT: dict[str, str] = {}


def test_elements_that_hold_text():
    math = "<article><p>If <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then</p><p class='search-term'>Term</p><p class=related>Also</p><p class=cookie-notice>No</p></article>"
    assert blocks(math) == (["If x=1 then", "Term", "Also"], True)
    page = "<body><nav>Menu</nav><article><p>Text</p></article><footer>Foot</footer></body>"
    assert blocks(page, structure=False) == (["Menu", "Text", "Foot"], False)
    assert blocks("<p>word " * 20_000) == (["word"] * 20_000, False)


def test_large_alignments_are_halved(monkeypatch):
    import random

    from kinweave.llm import html_text

    r = random.Random(3)
    pairs = [([r.randrange(6) for _ in range(r.randrange(40))], [r.randrange(6) for _ in range(r.randrange(40))]) for _ in range(200)]
    whole = [len(common_lines(a, b)) for a, b in pairs]
    monkeypatch.setattr(html_text, "CELLS", 8)
    for (a, b), n in zip(pairs, whole, strict=True):
        kept = common_lines(a, b)
        rest = iter(b)
        assert len(kept) == n and kept == sorted(set(kept)) and all(any(x == y for y in rest) for x in (a[i] for i in kept))
    monkeypatch.setattr(html_text, "CELLS", 1 << 20)
    a, b = ([r.randrange(3000) for _ in range(6000)] for _ in "ab")
    assert len(common_lines(a, b)) > 0


def test_common_lines_equal_a_table():
    import random

    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.randrange(4) for _ in range(r.randrange(12))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        kept = common_lines(a, b)
        assert len(kept) == best[-1][-1] and kept == sorted(set(kept))
        rest = iter(b)
        assert all(any(x == y for y in rest) for x in (a[i] for i in kept))


def test_warc_headers_of_other_writers():
    def record(head, body=b"hello", end=b"\r\n\r\n"):
        return b"WARC/1.0\r\n" + head + b"\r\n\r\n" + body + end

    good = [b"content-length: 5", b"Content-Length:5", b"CONTENT-LENGTH:   5  ", b"WARC-Type: a\r\n folded\r\nContent-Length: 5\r\nContent-Length: 9"]
    assert [body for _, body in parse_warc(b"".join(map(record, good)))] == [b"hello"] * 4
    joined = b"".join(gzip.compress(record(h)) for h in good)
    assert [body for _, body in parse_warc(joined)] == [b"hello"] * 4
    assert header_fields("WARC/1.0\r\nA: x\r\n  y\r\nb:z") == {"a": "x y", "b": "z"}
    for bad in (b"WARC-Type: response", b"Content-Length: x", b"Content-Length: -5", b"Content-Length: 4", b"Content-Length: 6", b"Content-Length: 500"):
        with pytest.raises(ValueError, match="record"):
            list(parse_warc(record(bad) + record(b"Content-Length: 5")[:30]))
    with pytest.raises(ValueError, match="not a record"):
        list(parse_warc(b"HTTP/1.1 200\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))
