import duckdb
import pytest
from compare import connect
from conftest_llm import same

from clipquarry.llm import oracles, urls
from clipquarry.llm.queries import URL_RULES

PAGES = [
    (1, "http://a.example.com/en/5", ""),
    (2, "HTTPS://WWW.Example.COM/en/7x?b=1#c", ""),
    (3, "https://m.example.net/de/81", ""),
    (4, "https://net/de/81", ""),
    (5, "ftp://example.org", None),
    (6, "no address", ""),
    (7, None, "<link rel=canonical href=http://x.org/es/1>"),
    (8, "http://plain.test/a", '<html><LINK REL="canonical" HREF="http://b.com/en/1">'),
    (9, "http://plain.test/b", "<meta content='0; URL=/a' http-equiv='refresh'>"),
    (10, "https://plain.test/b/?utm_source=x#top", ""),
    (11, "http://other.test/z?q=1", "<link href='//ok.example.com/en/7' rel='canonical'>"),
    (12, "http://other.test/z?q=1", "<link rel='canonical' href='http://b.com/en/2'>"),
    (13, "http://free.test/", "<link rel='canonical' href='?p=2'><link rel='stylesheet' href='http://b.com/en/3'>"),
    (14, "http://rel.test/dir/page?x=2&ref=9", "<link rel='canonical' href='main'>"),
    (15, "http://rel.test/dir/main", "<link rel='alternate canonical' href='#top'>"),
    (16, "http://late.test/", "<meta http-equiv='refresh' content='30; url=http://b.com/en/4'>"),
    (17, "://", ""),
    (18, "x://HÖST/p", ""),
]


@pytest.fixture()
def rules(spark):
    return spark.createDataFrame(URL_RULES, "host string, path string, verdict string")


def judged(spark, rules, pages, redirects=None):
    rows = [(*p, "clash", "clash") for p in pages]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, rule string")
    return {r.page_id: r for r in urls.judged(df, rules, redirects).collect()}


def test_hosts_paths_and_rules(spark, rules):
    found = judged(spark, rules, PAGES)
    assert len(found) == len(PAGES)
    look = {i: (r.host, r.path, r.rule, r.verdict) for i, r in found.items()}
    assert look[1] == ("a.example.com", "/en/5", "com/en/", "block")
    assert look[2] == ("www.example.com", "/en/7x", "example.com/en/7", "allow")
    assert look[3] == ("m.example.net", "/de/81", "example.net/de/8", "block")
    assert look[4] == ("net", "/de/81", "net/de/", "allow")
    assert look[5] == ("example.org", "", None, "allow")
    assert look[6] == look[7] == look[17] == ("", "", None, "allow")
    assert look[18][:2] == ("hÖst", "/p")


def test_decisions_reach_aliases(spark, rules):
    found = judged(spark, rules, PAGES)
    assert [found[i].verdict for i in (8, 9, 10)] == ["block"] * 3 and len({found[i].alias_group for i in (8, 9, 10)}) == 1
    assert found[11].verdict == found[12].verdict == "allow"  # an explicit allow among the aliases comes first
    assert found[13].verdict == "allow" and found[16].verdict == "allow"
    assert found[14].alias_group == found[15].alias_group


def test_redirect_tables(spark, rules):
    chain = [(f"http://hop{i}.test/", f"http://hop{i + 1}.test/") for i in range(40)] + [("http://hop40.test/", "http://b.com/en/9"), (None, "x")]
    redirects = spark.createDataFrame(chain, "from_url string, to_url string")
    found = judged(spark, rules, [(i, f"http://hop{i}.test/", "") for i in range(41)], redirects)
    assert {r.verdict for r in found.values()} == {"block"}


def test_hubs_and_repeated_pages(spark, rules):
    pages = [(i, f"http://copy{i % 300}.test/", "<link rel='canonical' href='http://b.com/en/1'>") for i in range(900)]
    found = judged(spark, rules, pages)
    assert len(found) == 900 and {r.verdict for r in found.values()} == {"block"}


def test_empty_tables(spark, rules):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert urls.judged(empty, rules).count() == 0
    pages = spark.createDataFrame(PAGES[:3], "page_id bigint, url string, html string")
    assert {r.verdict for r in urls.judged(pages, rules.limit(0)).collect()} == {"allow"}


def test_only_dataframe_operations(spark, rules, data):
    plan = urls.judged(spark.read.parquet(f"{data}/pages.parquet"), rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("pages", [PAGES, None])
def test_like_the_sql(spark, rules, data, pages):
    sql = oracles.oracle_sql()["op9_urls"]
    if pages is None:
        df, duck = spark.read.parquet(f"{data}/pages.parquet"), connect(data)
    else:
        df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
        duck = duckdb.connect()
        duck.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
        duck.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    names = ["page_id", "host", "path", "rule", "verdict", "alias_group"]
    same(urls.judged(df, rules).select(*names).collect(), duck.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())
