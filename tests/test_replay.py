"""Addresses, page regions, canonical JSON and the audit's strip."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import classify, keys, text, urls
from shelfmark.functions.canonical import canonical
from shelfmark.functions.regions import html_regions

BEACONS = """https://n.clarity.ms/collect
http://alpha.getbackstory.com/gbs_setup_1_2.js
http://pixel.advertising.com/ups/254/occ
http://c1.microsoft.com//c.gif?DI=10139
http://mob.adnxs.com/seg?t=2
https://r5---sn-t0a7ln7d.googlevideo.com/generate_204
https://i.ytimg.com/generate_204
http://maps.googleapis.com/maps/gen_204?ev=api_viewport
https://www.youtube-nocookie.com/gen_204?attributionpartner=x
https://www.youtube.com/annotations_invideo
http://b.scorecardresearch.com/b?c1=2&c2=6035486
http://tacoda.at.atwola.com/atx/cc?apid=x
http://ib.3lift.com/ttj
http://domdex.com/con?image=true
https://www.bizographics.com/collect/?pid=3520&fmt=gif
https://api-gateway.umami.dev/api/send
http://ad.doubleclick.net/x;ord=[timestamp]?
http://ad.doubleclick.net/x?v=1|2
http://ad.doubleclick.net/x?c7=a b
http://ad.doubleclick.net/x%
http://ad.doubleclick.net/?id={x}
http://my_site.2o7.net/b/ss
http:\\\\my_site.2o7.net\\b""".split("\n")
OTHERS = """http://r13.googlevideo.com/videoplayback?id=abc
https://i.ytimg.com/vi/abc/hqdefault.jpg
https://umami.dev/docs
https://www.microsoft.com/en-us/
https://c1.microsoft.com/download/setup.exe
https://fonts.googleapis.com/css?family=Bitter
https://www.gravatar.com/avatar/abc
http://doubleclick.net.example.com/
http://ad doubleclick.net/
not a url""".split("\n")


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", make(F.col("v")).alias("r"))
    return [r["r"] for r in rows.orderBy("i").collect()]


def test_beacons_at_any_address(spark):
    assert column(spark, BEACONS + OTHERS, classify.is_beacon) == [True] * len(BEACONS) + [False] * len(OTHERS)
    assert column(spark, BEACONS + OTHERS, classify.is_unmirrorable)[: len(BEACONS)] == [True] * len(BEACONS)


PARSED = {
    "HTTP://EX.com:80/a/../b/./c/%2e%2E/d": ("http", "ex.com", None, "/b/d"),
    " \thttp://e\nx.com/ ": ("http", "ex.com", None, "/"),
    "http://0x7f.1/": ("http", "127.0.0.1", None, "/"),
    "http://a.09/": None,
    "http://a.0x/": None,
    "http://[::1]:8080/a": ("http", "[::1]", 8080, "/a"),
    "http://[::1": None,
    "http://[::1%25eth0]/": None,
    "http://faß.example/ü": ("http", "xn--fa-hia.example", None, "/%C3%BC"),
    "http://\u00ad/": None,
    "http://user:pa@ss@h.com:0080/x": ("http", "h.com", None, "/x"),
    "http://@/x": None,
    "http://h.com:99999/": None,
    "http://a.com:b/": None,
    "http:h.com": ("http", "h.com", None, "/"),
    "mailto:a@b.c?x": ("mailto", "", None, "a@b.c"),
    "foo://Bar/x/../y": ("foo", "Bar", None, "/y"),
    "file:///C:/x": ("file", "", None, "/C:/x"),
    "//x.com/a": None,
    "http://": None,
    "": None,
}


def test_parsed_addresses(spark):
    assert {u: urls.parse_url(u) for u in PARSED} == PARSED
    assert urls.parse_url(None) is None
    found = column(spark, [*PARSED, None], urls.parts)
    assert [tuple(r) if r else None for r in found] == [*PARSED.values(), None]


def test_plain_addresses_are_read_alike(spark):
    plain = ["http://a.com", "https://A-b.c.com./x;y=[1]|(2)'$&+,:@%zz?q#f", "http://a.com#f", "http://1a.2b/", "http://a..b/", "http://a.com/.../..x", "http://a.b-/"]
    odd = ["http://a.com/x/..", "http://a.com/.", "http://a.1/", "http://a.com/x y", "http://xn--a.com/", "http://a.com/x\n"]
    found = column(spark, plain + odd, urls.parts)
    assert [tuple(r) if r else None for r in found] == [urls.parse_url(u) for u in plain + odd]


def test_long_addresses_do_not_overflow(spark):
    labels = "a." * 100_000 + "b/x"
    assert column(spark, [labels, "a..b/", "a./", ".a.b", "ab", "a.b-c", "a_b.c:8"], keys.repair_url) == [
        "http://" + labels, None, None, None, None, "http://a.b-c", "http://a_b.c:8"
    ]
    assert column(spark, ["http://" + labels, "http://a.com/" + "x/" * 100_000, "http://a.com/" + "../" * 100_000], keys.hostname) == [
        "a." * 100_000 + "b", "a.com", "a.com"
    ]
    comment = "<!--" + "x-" * 200_000 + "FILE ARCHIVED ON" + "- " * 200_000 + "-->y"
    assert column(spark, [comment], text.audit_strip) == ["y"]


REF = "https://web.archive.org/web/2014/http://example.com/endpoint?a=1&amp;b=2"
RAW, DECODED = "2014/http://example.com/endpoint?a=1&amp;b=2", "2014/http://example.com/endpoint?a=1&b=2"


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ('<svg><script>u="@"</script></svg>', [DECODED]),
        ("<math><style>u=@ </style></math>", [DECODED]),
        ('<svg><title><script>u="@"</script></title></svg>', [RAW]),
        ('<svg><foreignObject><script>u="@"</script></foreignObject><script>u="@"</script></svg>', [RAW, DECODED]),
        ('<math><annotation-xml encoding="text/html"><script>u="@"</script></annotation-xml></math>', [RAW]),
        ('<math><annotation-xml><script>u="@"</script></annotation-xml></math>', [DECODED]),
        ('<svg><div><script>u="@"</script></div></svg>', [RAW]),
        ('<svg/><script>u="@"</script>', [RAW]),
        ('<svg><script>u="@"</script></svg><script>u="@"</script>', [DECODED, RAW]),
        ("<textarea>@ </textarea>", [DECODED]),
        ("<xmp>@ </xmp><p>@ </p>", [RAW, DECODED]),
        ("<plaintext>@ </plaintext><p>@ </p>", [RAW, RAW]),
        ("<noscript><noscript><a href='@'>", [DECODED]),
        ("<__proto__ constructor='@'>", [DECODED]),
    ],
)
def test_keys_by_region(page, wanted):
    assert [e["key"] for e in text.escapes_of("html", page.replace("@", REF))] == wanted


DECOYS = ["", "<!-- <script> -->", '<div title="<script>"></div>', '<!DOCTYPE html><?xml version="1.0"?>', "<p>a < b</p>"]
DECOYS += [f"<{tag}><script></{tag}>" for tag in ("title", "textarea", "xmp", "iframe", "noembed", "noframes")] + ["<noscript><style></noscript>"]


@pytest.mark.parametrize("decoy", DECOYS)
def test_decoys_open_no_script(decoy):
    found = text.escapes_of("html", decoy + f'<img data-note="a > b" src="{REF}">')
    assert [(e["key"], e["resource"], e["region"]) for e in found] == [(DECODED, True, "attribute")]


def test_escapes_of_other_bodies():
    body = f"/web/2014/http://here.com/ {REF}#top see archive.org http://m.example.com/web/20140101/x //web.archive.org/web/2014cs_/???"
    kinds = [(e["kind"], e["key"], e["flag"], e["resource"]) for e in text.escapes_of("css", body)]
    assert kinds == [
        ("archive-org", RAW, None, True),
        ("archive-org-bare", None, None, False),
        ("absolute-web-escape", None, None, False),
        ("archive-org", None, "cs_", True),
    ]
    assert text.escapes_of(None, None) == [] and text.escapes_of("html", "") == []


@pytest.mark.parametrize("page", ["<" * 50_000, "<a " * 50_000, "<script>" * 50_000, "<svg>" * 50_000, "<noscript>" * 50_000, "<a " + "x='1' " * 50_000, "<!--" * 50_000])
def test_regions_of_long_odd_pages(page):
    found = html_regions(page)
    assert all(a.end <= b.start for a, b in zip(found, found[1:], strict=False))


def test_canonical_json():
    assert canonical('{"b": 1, "a": {"d": [2, {"z": 1.0, "y": 2e3}], "c": 3}}') == '{"a":{"c":3,"d":[2,{"y":2000,"z":1}]},"b":1}'
    numbers = "[1e21, 1e-7, 0.000001, 123456789012345680000, -0, 0.1, 1.5e300, 1e16, 9007199254740993]"
    assert canonical(numbers) == "[1e+21,1e-7,0.000001,123456789012345680000,0,0.1,1.5e+300,10000000000000000,9007199254740992]"
    assert canonical('{"é": "\\u0001\\n\\ud800", "10": 1, "9": 2, "\\ud83d\\ude00": 3, "\\uffff": 4, "a": 1, "a": 2}') == (
        '{"9":2,"10":1,"a":2,"é":"\\u0001\\n\\ud800","😀":3,"\uffff":4}'
    )
    assert canonical('{"contentHash": "x", "z": 1}', contentHash="y", contentLength=3.0) == '{"contentHash":"y","contentLength":3,"z":1}'
    assert [canonical(x) for x in (None, "", "{", "NaN", "null", " [ ] ")] == [None, None, None, None, "null", "[]"]
    assert canonical("[" * 100_000) is None


def test_audit_strip_takes_the_head_span_and_all_provenance(spark):
    head = '<script src="/_static/js/a.js"></script><title>Wayback</title><!-- End Wayback Rewrite JS Include -->'
    note = "<!--\n FILE ARCHIVED ON 1 - - -->"
    page = f"a{head}b{note}c{note}d<!-- playback timings -->e<script>__wm.bt(1)</script>f<!-- own -->"
    assert column(spark, [page, None, ""], text.audit_strip) == ["abcdef<!-- own -->", None, ""]


def test_no_break_spaces_are_spaces(spark):
    shell = "<title>a\u00a0\ufeff b</title>" + "\u00a0" * 60
    assert column(spark, [shell], classify.title_of) == ["a b"]
    assert column(spark, [shell], lambda h: classify.replay_verdict(classify.title_of(h), classify.text_of(h))["reason"]) == ["near-empty body"]
