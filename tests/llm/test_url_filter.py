"""Rules by hand, aliases through links, odd rows."""

from clickloom.llm import url_filter

SCHEMA = "page_id long, url string, html string, rule string, node string"


def judge(spark, pages, **options):
    table = spark.createDataFrame([(i, u, h, "x", "x") for i, (u, h) in enumerate(pages)], SCHEMA)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(table, **options).collect()}


def test_rules(spark):
    pages = [
        ("http://A.Example.NET/en/x?q#f", None),
        ("https://example.net/fr/", ""),
        ("https://example.net", ""),
        ("https://example.com/de/1", ""),
        ("https://badexample.com/de/1", ""),
        ("x://y.org/fr/#t", ""),
        ("no scheme.net/", ""),
        (None, None),
        ("a://b://c.net/", ""),
        ("http://ÄÖ.net/é", ""),
        ("http:///p", ""),
    ]
    assert list(judge(spark, pages).values()) == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"),
        ("example.net", "/fr/", "net/", "block"),
        ("example.net", "", None, "allow"),
        ("example.com", "/de/1", "example.com/de/", "block"),
        ("badexample.com", "/de/1", None, "allow"),
        ("y.org", "/fr/", "org/fr/", "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("b:", "//c.net/", None, "allow"),
        ("ÄÖ.net", "/é", "net/", "block"),
        ("", "/p", None, "allow"),
    ]


def test_aliases_take_decisions_and_allow_comes_first(spark):
    def canonical(url):
        return f'<html><LINK href="{url}" rel=canonical><p>x</p>'

    pages = [
        ("http://a.info/1", canonical("http://bad.net/1")),
        ("http://b.info/1", '<meta http-equiv="refresh" content="0; url=http://a.info/1">'),
        ("http://c.info/1", canonical("http://d.info/2")),
        ("http://c.info/3", canonical("/1")),
        ("http://bad.net/9", canonical("http://c.info/1")),
        ("http://e.info/1", canonical("//good.org/fr/1")),
        ("http://e.info/1#x", ""),
        ("http://f.info/a/1", canonical("2?x=1&amp;y=2")),
        ("http://f.info/a/2?x=1&y=2", canonical("http://bad.net/1")),
        ("http://g.info/", canonical("#here")),
        ("http://h.info/", "<link rel=stylesheet href=http://bad.net/>"),
        ("http://i.info/", ""),
        ("http://j.info/", canonical("http://bad.net/7") + canonical("http://ok.org/fr/")),
    ]
    redirects = spark.createDataFrame([("http://i.info/", "http://a.info/1"), (None, "x"), ("http://z.org/fr/", "http://g.info/")], "source string, target string")
    verdicts = [v[3] for v in judge(spark, pages, redirects=redirects).values()]
    assert verdicts == ["block", "block", "block", "block", "block", "allow", "allow", "block", "block", "allow", "allow", "block", "allow"]


def test_empty_and_repeated(spark):
    assert judge(spark, []) == {}
    assert judge(spark, [("http://a.net/", "")], rules=())[0][3] == "allow"
    twice = spark.createDataFrame([(1, "http://a.net/", None, "", "")] * 2, SCHEMA)
    assert [r["verdict"] for r in url_filter.judge(twice).collect()] == ["block"] * 2
