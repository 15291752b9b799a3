import re

import pytest

from docnest.llm import url_rules as u
from tests.llm.texts import CLASHING, bag

URLS = [
    "http://example.com/", "http://example.com", "https://www.EXAMPLE.com/en/1?x#y", "http://a.www.example.com/en/", "http://m.example.com/en/5",
    "http://myexample.com/en/1", "http://example.com/EN/1", "http://x.net/es/1", "http://net/fr/", "http://x.net/fr", "http://x.net/?/fr/", "no scheme.com/en/",
    None, "", "://", "http:///en/", "http://casino-win.example.org/en/1", "http://free-bets.example.net/es/", "http://alphabet.example.org/", "http://x.org://y.com/en/",
    "http://com/", "ftp://user@example.com:80/en/", "http://com.example.org/x", "http://é.com/ü?#", "http://x.com/" + "a/" * 20_000, "http://x.com\n/en/\nz", "http://ADS.org",
]


def expected(url, rules):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", after)[0]
    path = re.match(r"[^?#]*", after[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fitting = []
    for verdict, rule, rank in rules:
        if rule is None:
            continue
        name, slash, rest = rule.partition("/")
        border = r"(?:(?<![A-Za-z0-9])|(?![A-Za-z0-9]))"
        as_regex = lambda part, any_run: "".join(any_run if c == "*" else border if c == "^" else re.escape(c) for c in part)
        regex = r"(?:[^/]*\.)?" + as_regex(name.lower(), "[^/]*") + (as_regex(slash + rest, ".*") if slash else r"(?=/|\Z)")
        if re.match(regex, host + path, re.S):
            fitting.append((rank, len(rule), len(name), verdict, rule))
    best = max(fitting, default=(None, 0, 0, "allow", None))
    return host, path, best[4], best[0], best[3]


def run(spark, urls, rules, clashing=False):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    if clashing:
        pages = pages.select("*", *[F.lit("x").alias(c) for c in (*CLASHING, "host", "path", "rule", "verdict", "token", "salt", "held", "n")])
    table = spark.createDataFrame(rules, "verdict string, rule string, rank int")
    return u.judge(pages, table)


RULES = [
    *[(v, r, 1) for v, r in u.RULES], ("block", "*^casino^*", 0), ("block", "*^ads^*", 0), ("block", "*^bet*", 0), ("allow", "org", 0), ("block", None, 2),
    ("block", "com/*/5", 1), ("block", "x.net/f", 1), ("allow", "x.net/f", 1), ("block", "EXAMPLE.org/x", 2), ("allow", "*/a/a", 0), ("block", "é.com/ü", 2), ("block", "(.com/[", 3),
]


def test_equals_every_rule_tried_on_every_url(spark):
    got = sorted(map(tuple, run(spark, URLS, RULES, clashing=True).collect()))
    assert got == [(i, *expected(url, RULES)) for i, url in enumerate(URLS)]


def test_without_rules_and_without_urls(spark):
    assert {r.verdict for r in run(spark, URLS, []).collect()} == {"allow"}
    assert run(spark, [], RULES).collect() == []


def test_repeated_rows_and_null_ids_stay(spark):
    rows = [(1, URLS[2])] * 3 + [(None, URLS[4]), (None, None)]
    table = spark.createDataFrame(RULES, "verdict string, rule string, rank int")
    got = u.judge(spark.createDataFrame(rows, "page_id long, url string"), table)
    assert got.count() == 5 and bag(got) == bag(got)


def test_rules_are_filed_under_the_rarest_token(spark):
    rules = u.compiled(spark.createDataFrame([("block", "example.com/en/", 0), ("block", "net/f", 0), ("block", "*ab*", 0)], "verdict string, rule string, rank int"))
    counts = spark.createDataFrame([("example", 50), ("com", 30), ("en", 7), ("net", 3)], "token string, n long")
    assert {r.rule: r.token for r in u.indexed(rules, counts).collect()} == {"example.com/en/": "en", "net/f": "net", "*ab*": ""}


def test_only_fetched_rules_run_and_hot_tokens_are_dealt_out(spark):
    many = [("block", f"host{i}.com/", 0) for i in range(3000)]
    urls = [f"http://host{i % 40}.com/{i}" for i in range(4000)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = run(spark, urls, many)
        assert got.where("verdict = 'block'").count() == 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("rule", ["\\Q", "[a", "a{2", "$", "a|b", "(?i)x"])
def test_rules_are_text_not_expressions(spark, rule):
    got = run(spark, ["http://x.com/", f"http://{rule}/"], [("block", rule + "/", 0)]).orderBy("page_id").collect()
    assert got[0].verdict == "allow"
    assert got[1].verdict == expected(f"http://{rule}/", [("block", rule + "/", 0)])[4]
