from __future__ import annotations

import random

from llm_rows import rows_of  # noqa: F401

from panelcast.llm.queries import URL_RULES
from panelcast.llm.url_filter import Rule, UrlTrie, judge_urls

URLS = [
    "http://a.EXAMPLE.org/es/x?y=1",
    "http://example.org/en/12#f",
    "http://example.org/en/2",
    "http://example.org",
    "http://example.org/",
    "http://notexample.org/es/",
    "ftp://x.com/fr/",
    "ftp://x.com/fr",
    "ftp://x.com/de/1/2",
    "http://com/de/",
    "x.com/de/",
    "http://?a://b.org/",
    "",
    None,
    "http://" + "a." * 400 + "org/" + "p/" * 400,
]


def brute(rules, url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for stop in "/?#":
        host = host.split(stop)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    best = max(fits, key=lambda r: r.rank, default=None)
    return host, path, best.text if best else None, best.verdict if best else "allow"


def frame(spark, urls):
    rows = [(i, u, "h", "r") for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, rule string")


def test_contract_rules(spark):
    got = judge_urls(frame(spark, URLS), URL_RULES)
    expected = [(i, *brute(URL_RULES, u)) for i, u in enumerate(URLS)]
    assert rows_of(got, "page_id", "host", "path", "rule", "verdict") == expected
    assert judge_urls(frame(spark, []), URL_RULES).count() == 0


def random_rules(rng):
    labels, segments = ["a", "b", "c"], ["", "x", "xy", "y", "z"]
    return {
        Rule(
            ".".join(rng.choices(labels, k=rng.randint(1, 3))),
            "/".join(rng.choices(segments, k=rng.randint(1, 4))),
            rng.choice(["allow", "block"]),
        )
        for _ in range(60)
    }


def test_trie_and_join_equal_brute_force(spark):
    rng = random.Random(3)
    rules = random_rules(rng)
    urls = [
        "s://" + ".".join(rng.choices("abc", k=rng.randint(1, 4))) + "/"
        + "/".join(rng.choices(["x", "xy", "y", "z", ""], k=rng.randint(0, 4)))
        for _ in range(400)
    ]
    expected = [(i, *brute(rules, u)) for i, u in enumerate(urls)]
    table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules] + [(None, "x", "block")],
                                  "host string, path string, verdict string")
    columns = ("page_id", "host", "path", "rule", "verdict")
    assert rows_of(judge_urls(frame(spark, urls), table), *columns) == expected
    assert rows_of(judge_urls(frame(spark, urls), table, max_trie_rules=3), *columns) == expected
    assert UrlTrie([]).match("a", "/") is None


def test_a_long_list_is_joined_and_repeated_rows_stay(spark):
    rng = random.Random(4)
    rules = random_rules(rng)
    urls = ["s://a.b/x/y", "s://a.b/x/y", None, None, "s://c/", "", "s://a.b/x/y", "x" * 100_000, "s://b." + "a." * 300 + "c/x"]
    expected = [(i, *brute(rules, u)) for i, u in enumerate(urls)]
    columns = ("page_id", "host", "path", "rule", "verdict")
    for most in (1000, 3):
        assert rows_of(judge_urls(frame(spark, urls), rules, max_trie_rules=most), *columns) == expected
    twice = frame(spark, urls).unionByName(frame(spark, urls))
    assert rows_of(judge_urls(twice, rules), *columns) == sorted(expected * 2)
