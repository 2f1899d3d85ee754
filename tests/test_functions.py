"""Column functions and scanners on pinned cases."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import classify, keys, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_pinned_hash(spark):
    key = F.lit("20140403040000/http://example.com/")
    assert one(spark, keys.capture_hash(key)) == "77c4b856ffc51a15b686125ca9ce901456eee045e9639b95fbcd8ae3970dd1ac"
    assert one(spark, keys.sri(F.lit("abc"))) == "sha256-ungWv48Bz+pBQUDeXa4iI7ADYaOWF3qctBD/YfIAFa0="
    assert one(spark, keys.body_path(F.lit("sha256-short"))) is None


@pytest.mark.parametrize(
    "rest, repaired",
    [
        ("http:/a.com/x", "http://a.com/x"),
        ("//a.com", "https://a.com"),
        ("a.com:80/x", "http://a.com:80/x"),
        ("javascript", None),
        ("HTTPS:/a.com", "HTTPS://a.com"),
        ("", None),
    ],
)
def test_repair(spark, rest, repaired):
    assert one(spark, keys.repair_url(F.lit(rest))) == repaired
    assert text._repaired(rest) == repaired


def test_parsers_differ_in_flags(spark):
    url = F.lit("https://web.archive.org/web/20120101000000///cdn.example.com/x.js")
    assert one(spark, keys.parse_replay(url))["original"] == "https://cdn.example.com/x.js"
    three = F.lit("https://web.archive.org/web/2012abc_/http://a.com/")
    assert one(spark, keys.parse_replay(three)) is None
    assert one(spark, keys.parse_archive_url(three))["flag"] == "abc_"


def test_match_key(spark):
    same = ["http://www.A.com:80/", "https://a.com", "HTTP://a.com./", "https://a.com:443//"]
    assert {one(spark, keys.match_key(F.lit(u))) for u in same} == {"a.com"}


def test_nulls_and_empties(spark):
    none = F.lit(None).cast("string")
    for function in (keys.repair_url, keys.match_key, keys.parse_path, keys.body_path, keys.format_path, keys.decode_path):
        assert one(spark, function(none)) is None
    assert one(spark, classify.is_beacon(none)) is False
    assert one(spark, classify.is_fetchable(F.lit(""))) is False
    assert one(spark, classify.is_htmlish(none)) is True
    assert text.links_of(None) == [] and text.archive_urls_of("") == []
    assert one(spark, classify.text_of(none)) is None


def test_path_codec(spark):
    key = "2014/http://a.com/é %20#x'"
    path = one(spark, keys.format_path(F.lit(key)))
    assert path == "/2014/http://a.com/%C3%A9%20%2520%23x%27"
    assert one(spark, keys.decode_path(F.lit(path))) == "/" + key
    assert one(spark, keys.decode_path(F.lit("/a%2Fb%zz"))) == "/a%2Fb%zz"


def test_links_in_order():
    found = text.links_of("[a](http://a.com/x(1)) ![i](http://i.com) <http://b.com>\n[r]: http://c.com\nhttp://d.com/y). <a href='http://e.com'>e</a>")
    assert [(x["form"], x["url"]) for x in found] == [
        ("inline", "http://a.com/x(1)"),
        ("image", "http://i.com"),
        ("autolink", "http://b.com"),
        ("reference", "http://c.com"),
        ("bare", "http://d.com/y"),
        ("html", "http://e.com"),
    ]


def test_requisites(spark):
    html = (
        '<img src="/web/2014im_/http:/a.com/x.png?a&amp;b"><link href="/web/2014cs_/http://a.com/(1).css">'
        "<p style=\"background:url(/web/2014im_/http://a.com/b(2).gif)\"><img src='/web/2014im_/data:image/png'>"
        '<a href="/web/2014/http://a.com/page"><img src="/web/2014oe_/http://a.com/x.png?a&b">'
    )
    found = one(spark, text.requisites(F.lit(html)))
    assert [(x["flag"], x["key"]) for x in found] == [
        ("im_", "2014/http://a.com/x.png?a&b"),
        ("cs_", "2014/http://a.com/(1).css"),
        ("im_", "2014/http://a.com/b(2).gif"),
    ]


def test_rewriting():
    held = ["2014/http://a.com/x.png", "2014/http://a.com/s.css"]
    page = (
        '<a href="https://web.archive.org/web/2014/http://gone.com/">g</a><img src="https://web.archive.org/web/2014im_/http://a.com/x.png">'
        '<img src="https://web.archive.org/web/2014im_/http://a.com/none.png"><script>f("https://web.archive.org/web/2014/http://a.com/s.css")</script>'
    )
    out = text.rewrite_body("html", page, held)
    assert out["count"] == 3
    assert '<a href="/web/2014/http://gone.com/">' in out["text"] and 'src="/web/2014im_/http://a.com/x.png"' in out["text"]
    assert "https://web.archive.org/web/2014im_/http://a.com/none.png" in out["text"] and 'f("/web/2014/http://a.com/s.css")' in out["text"]
    again = text.rewrite_body("html", out["text"], held)
    assert again["text"] == out["text"] and again["count"] == 0
    assert text.rewrite_body(None, "x", held) == {"text": "x", "count": 0} and text.rewrite_body("html", None, None) is None


def test_dynamic_errors(spark):
    entry = lambda **x: F.struct(*[F.lit(v).cast("string").alias(k) for k, v in x.items()])
    good = dict(key="2014/http://a.com", flag="im_", via="manual", firstSeen="2024-01-02T03:04:05Z")
    assert one(spark, classify.dynamic_error(entry(**good))) is None
    for field, value in (("key", "x"), ("flag", "zz_"), ("via", "me"), ("firstSeen", "yesterday")):
        assert one(spark, classify.dynamic_error(entry(**good | {field: value})))


def test_scan_by_region():
    ref = "https://web.archive.org/web/2014{}/http://a.com/{}"
    page = (
        f'<a href="{ref.format("", "p.png")}">x</a><link rel="canonical" href="{ref.format("", "c")}"><link rel="icon" href="{ref.format("", "i?a&amp;b")}">'
        f'<!-- {ref.format("", "n?a&amp;b")} --><script>"{ref.format("", "s.js")}"</script>{ref.format("im_", "t?a&amp;b")}<img src=\'{ref.format("", "g")}\'>'
    )
    found = [(x["region"], x["key"].rsplit("/", 1)[1], x["resource"]) for x in text.scan_body("html", page)]
    assert found == [
        ("attribute", "p.png", False),
        ("attribute", "c", False),
        ("attribute", "i?a&b", True),
        ("comment", "n?a&amp;b", False),
        ("script", "s.js", True),
        ("text", "t?a&b", True),
        ("attribute", "g", True),
    ]
    assert text.scan_body("html", None) == [] and text.scan_body("css", "url(/web/2014cs_/http://a.com/x)")[0]["resource"]


def test_excerpts():
    line = "x" * 50 + " see \t(archive.org/a) " + "y" * 50
    at = line.index("archive.org")
    assert text.excerpt(line, at, at + 11) == "…" + line[at - 40 : at + 51].replace("\t", "·") + "…"
    assert text.token_around(line, at, at + 11) == "archive.org/a"
    assert text.token_around("a" * 900, 400, 410) == "a" * 610
    hits = text.bare_hits_of('https://web.archive.org/web/2014/http://a.com/ and http://Archive.org/x"')
    assert [(h["token"], h["excerpt"][-5:]) for h in hits] == [("http://Archive.org/x", 'rg/x"')]
    assert text.bare_hits_of(None) == []


def test_entities_in_two_orders(spark):
    assert one(spark, keys.decode_xml(F.lit("&amp;lt;&lt;"))) == "&lt;<"
    assert one(spark, classify.decode_entities(F.lit("&amp;lt;&nbsp;"))) == "< "


def test_addresses(spark):
    assert one(spark, keys.to_doc(F.lit("2014/http://a.com/")))["url"] == "https://web.archive.org/web/2014/http://a.com/"
    for other in ("201/http://a.com/", "http://a.com/", "2014/", ""):
        assert one(spark, keys.to_doc(F.lit(other))) is None
    assert one(spark, keys.chrome_host(F.lit("http://a.com/?u=https://web.archive.org/web/2014/x"), "c")) == "http://a.com/?u=https://web.archive.org/web/2014/x"
    assert one(spark, keys.header_safe(F.lit("a%20b日\r"))) == "a%20b%E6%97%A5%0D"
    assert one(spark, keys.host_of(F.lit("http://GitHub.com./x"))) == "github.com"
    assert [one(spark, keys.backoff(F.lit(n), 400)) for n in (1, 2, 3)] == [400, 800, 1600] and one(spark, keys.backoff(F.lit(9), 500, 2_000)) == 2_000
    assert one(spark, keys.metadata_safe(F.lit(None).cast("string"))) is True and one(spark, keys.metadata_safe(F.lit("a\rb"))) is False


def test_evidence(spark):
    said = classify.replay_evidence(F.lit("Oops"), F.lit("HTTP Error 404 - not here, sorry about that, dear reader"))
    assert one(spark, said) == "matched: HTTP Error 404 | title: Oops | text: HTTP Error 404 - not here, sorry about that, dear reader"
    assert one(spark, classify.replay_evidence(F.lit(""), F.lit(""))) == "text: (empty)"


def test_rewriting_inside_comments_and_styles():
    held = ["2014/http://a.com/x.png"]
    ref = "https://web.archive.org/web/2014im_/http://a.com/x.png"
    page = f"<!-- <img src='{ref}'> --><style>b{{background:url({ref})}}</style><script src='{ref}'>f('{ref}')</script><p style=\"background:url({ref})\">{ref}"
    out = text.rewrite_body("html", page, held)
    assert out["count"] == 4 and out["text"].count("https://web.archive.org") == 2
    assert text.rewrite_body("js", f"f('{ref}', \"{ref} x\", '{ref}' + y)", held)["count"] == 2
    assert text.reference_keys("\"https://web.archive.org/web/2014/http://a.com/b c\"")[-1] == "2014/http://a.com/b c"


def test_audit_strip_drops_the_first_toolbar(spark):
    bar = "<!-- BEGIN WAYBACK TOOLBAR INSERT -->t<!-- END WAYBACK TOOLBAR INSERT -->"
    assert one(spark, text.audit_strip(F.lit(f"a{bar}b{bar}c"))) == f"ab{bar}c"
