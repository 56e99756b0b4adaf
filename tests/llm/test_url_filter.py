"""URL filtering: rules in plain Python, and accuracy of the trees on URLs held out."""

import random

import pytest

from gridframe.llm import queries, url_filter


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i, c in enumerate(rest) if c in "/?#"] + [len(rest)]
    host, rest = rest[: ends[0]], rest[ends[0] :]
    ends = [i for i, c in enumerate(rest) if c in "?#"] + [len(rest)]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[: ends[0]]


def rule(host, path):
    fits = [r for r, _ in queries.URL_RULES if (host == (name := r.split("/", 1)[0]) or host.endswith("." + name)) and path.startswith(r[len(name) :])]
    return max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme", "http://", "http://a.com/en/x", "https://A.COM/en/", "https://a.com/EN/", "http://example.com/en/7", "http://www.example.com/en/77?q", "http://example.com/en/8", "http://badexample.com/en/7",
    "x://com/en/", "x://.com/en/#", "http://example.net/de/8/9", "http://q.net/de/8", "http://q.org/es/a://b", "http://q.org?x=/es/", "http://q.org#://z", "://q.org/es/", "a\nb://c.net/de/\nq", "http://É.net/de/ß", "http://net/de/" + "x" * 50_000,
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash", 1.0) for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, rule string, suffix double")
    verdicts = dict(queries.URL_RULES)
    rows = url_filter.judge(pages, queries.URL_RULES).collect()
    assert len(rows) == len(URLS) + 3
    for r in rows:
        host, path = parts(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule(host, path)), r["url"]
        assert r["verdict"] == verdicts[r["rule"]] if r["rule"] else r["verdict"] in ("allow", "block")


def test_empty_table_and_one_class(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert url_filter.judge(pages.limit(0), queries.URL_RULES).count() == 0
    assert url_filter.judge(pages, queries.URL_RULES).first()["verdict"] == "allow"
    assert url_filter.judge(pages, [("b/", "block")]).first()["verdict"] == "block"
    assert url_filter.judge(pages, [], labelled=spark.createDataFrame([("x://y", 1), (None, 0)], "url string, label int")).first()["verdict"] == "block"


def test_trees_on_held_out_urls(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("news garden music travel school river price health".split())

    def url(bad):
        if bad:
            return f"http://{word()}-{rng.randrange(9999)}.{rng.choice(['top', 'xyz', 'com'])}/{'%x' % rng.getrandbits(90)}?a={rng.randrange(999)}&b={'%x' % rng.getrandbits(40)}"
        return f"https://www.{word()}.{rng.choice(['com', 'org'])}/{word()}/{word()}-{word()}.html"

    rows = [(url(i % 2), i % 2) for i in range(800)]
    trees = url_filter.Trees(spark.createDataFrame(rows[:500], "url string, label int"), trees=8)
    found = trees.score(spark.createDataFrame(rows[500:], "url string, label int")).collect()
    assert sum((r["block_score"] >= 0.5) == bool(r["label"]) for r in found) / len(found) >= 0.95


def test_features_stay_in_the_jvm(spark, sf):
    plan = queries.op8_url_filter(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("least", [0.9])
def test_query(spark, sf, least):
    rows = queries.op8_url_filter(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    for r in rows:
        assert (r["host"], r["path"]) == parts(urls[r["page_id"]]) and r["rule"] == rule(r["host"], r["path"])
