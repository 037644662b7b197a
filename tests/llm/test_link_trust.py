from collections import Counter

import duckdb
import pandas as pd
import pytest

from tallyfield.llm import link_trust, sql
from tallyfield.llm.link_trust import Rule
from tallyfield.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string"


def page(host, path="/en/1", links=()):
    return f"https://{host}{path}", "".join(f'<p><a class="x" href="{x}">y</a>' for x in links)


def table(spark, rows, more=()):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], PAGES)
    return df.withColumns({c: F.lit(1) for c in more}) if more else df


def judged(df):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in link_trust.judge_urls(df, URL_RULES).collect()}


URLS = [
    ("http://A.B.example.NET/en/1?x=/fr/", ("a.b.example.net", "/en/1", "example.net/en/", "allow")),
    ("http://example.net/en", ("example.net", "/en", "net/", "block")),
    ("http://myexample.net/en/", ("myexample.net", "/en/", "net/", "block")),
    ("http://x.net", ("x.net", "", None, "allow")),
    ("http://x.net?q", ("x.net", "", None, "allow")),
    ("net/en/", ("", "", None, "allow")),
    (None, ("", "", None, "allow")),
    ("", ("", "", None, "allow")),
    ("x://y://z/#a", ("y:", "//z/", None, "allow")),
    ("https://www.example.org/fr/#t", ("www.example.org", "/fr/", "org/fr/", "allow")),
    ("https://u.org/FR/", ("u.org", "/FR/", None, "allow")),
    ("https://ÄB.org:80/fr/", ("Äb.org:80", "/fr/", None, "allow")),
    ("//a.net/", ("", "", None, "allow")),
    ("http:///en/", ("", "/en/", None, "allow")),
]


def test_hosts_paths_and_longest_rule(spark):
    clashing = ("id", "host", "path", "rule", "verdict", "fit", "fits", "bad", "src", "dst", "n", "link", "trust")
    got = judged(table(spark, [(u, None) for u, _ in URLS], clashing))
    assert got == {i: want for i, (_, want) in enumerate(URLS)}
    assert judged(table(spark, [])) == {}


def walks(edges, trusted, blocked, rounds=20, damping=0.85):
    hosts = {h for e in edges for h in e} | trusted | blocked
    out, into = Counter(), Counter()
    for (s, d), n in edges.items():
        out[s] += n
        into[d] += n
    t = {h: (1 - damping) * (h in trusted) for h in hosts}
    x = {h: (1 - damping) * (h in blocked) for h in hosts}
    for _ in range(rounds):
        t, x = (
            {h: (1 - damping) * (h in trusted) + damping * sum(t[s] * n / out[s] for (s, d), n in edges.items() if d == h) for h in hosts},
            {h: (1 - damping) * (h in blocked) + damping * sum(x[d] * n / into[d] for (s, d), n in edges.items() if s == h) for h in hosts},
        )
    return {h: (t[h], x[h]) for h in hosts}


def test_walks_equal_written_out_rounds(spark):
    edges = {("a", "b"): 3, ("b", "a"): 1, ("b", "c"): 2, ("c", "d"): 5, ("e", "d"): 1, ("d", "e"): 1, ("f", "a"): 4, ("g", "g"): 9}
    want = walks({e: n for e, n in edges.items() if e[0] != e[1]}, {"a", "h"}, {"d"})
    rows = spark.createDataFrame([(s, d, n) for (s, d), n in edges.items()], "src string, dst string, n long")
    seeds = spark.createDataFrame([("a", 1, 0), ("d", 0, 1), ("h", 1, 0), ("z", 0, 0)], "host string, trusted int, blocked int")
    got = {r.host: (r.trust, r.distrust) for r in link_trust.rank_hosts(rows, seeds).collect()}
    assert got.keys() == want.keys() | {"z"} and got.pop("z") == (0, 0)
    for host, scores in want.items():
        assert got[host] == pytest.approx(scores, abs=1e-9)


LINKED = [
    page("spam.net", "/de/1", ["https://spam.net/2"]),
    page("friend.com", "/en/1", ["https://spam.net/1", "HTTP://SPAM.NET?x", "/own", "#a", "mailto:a@spam.net"]),
    page("good.org", "/fr/1", ["//shop.com/x", "https://shop.com", "https://both.com/"]),
    page("shop.com", "/en/1", ["https://good.org/"]),
    page("both.com", "/en/1", ["https://spam.net/", "https://good.org/", "https://good.org/x", "https://good.org/y"]),
    page("far.com", "/en/1", ["https://friend.com/"]),
    page("alone.com", "/en/1"),
    ("https://odd.com/en/", "<a href='https://spam.net/'>x</a><A\nTitle=\"b\" HREF = https://spam.net>y</a><area href=\" https://spam.net/ \"><abbr href='https://good.org'>"),
    page("more.example.com", "/de/1"),
    page("more.example.com", "/de/2"),
    page("more.example.com", "/en/2"),
]


def test_linkers_of_blocked_hosts_are_blocked(spark):
    got = judged(table(spark, LINKED))
    verdicts = {got[i][0]: got[i][3] for i in got if got[i][2] is None}
    # a host that is mostly blocked by a rule is blocked; one that good hosts link to stays
    assert verdicts == {"friend.com": "block", "far.com": "block", "odd.com": "block", "shop.com": "allow", "both.com": "allow", "alone.com": "allow", "more.example.com": "block"}


def test_sql_says_the_same_over_linked_pages(spark):
    rows = [(i, *r) for i, r in enumerate(LINKED + [(u, None) for u, _ in URLS])]
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    got = {r[0]: tuple(r[1:]) for r in con.execute(sql.URL_FILTER).fetchall()}
    assert got == judged(table(spark, [r[1:] for r in rows]))


def test_links_are_counted_by_pair_of_hosts(spark):
    got = {(r.src, r.dst): r.n for r in link_trust.host_links(table(spark, LINKED)).collect()}
    assert got[("friend.com", "spam.net")] == 2 and got[("good.org", "shop.com")] == 2 and got[("odd.com", "spam.net")] == 3
    assert ("friend.com", "friend.com") not in got and ("odd.com", "good.org") not in got


def test_rules_of_equal_length_prefer_the_longer_host(spark):
    rules = [Rule("block", "b.com", "/aa"), Rule("allow", "a.b.com", "/"), Rule("block", "com", "/")]
    got = link_trust.judge_urls(table(spark, [("http://a.b.com/aab", None), ("http://com/", None)]), rules)
    assert {r.page_id: (r.rule, r.verdict) for r in got.collect()} == {0: ("a.b.com/", "allow"), 1: ("com/", "block")}
