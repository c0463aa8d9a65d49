from collections import defaultdict

import duckdb
import pytest

from palimpsa.llm import linkgraph
from palimpsa.llm.linkgraph import OWN, UNIT, Rule

PAGES = [
    (1, "http://a.Example.COM/en/x?y", "<a href='http://Bad.net/'>"),
    (2, "https://www.example.com/en/", '<A HREF = "//b.org/q">'),
    (3, "http://x.net/es/1", None),
    (4, "http://x.net/de/1", ""),
    (5, "http://x.net#top", "text"),
    (6, "http://friend.org/p", '<a href="http://x.net/es/">' * 3),
    (7, "http://b.org:80/", '<a href=https://b.org/>'),
    (8, "http://b.org", ""),
    (9, "no host", '<a href="http://x.net/">'),
    (10, None, None),
    (11, "://", ""),
    (12, "http:///only/path", ""),
    (None, "http://x.net/fr/", "x" * 300_000 + '<a href="http://y.x.net/">'),
    (13, "http://y.x.net/en/", ""),
    (14, "http://" + ".".join("abcdef" for _ in range(60)) + "/p", ""),
    (4, "http://x.net/de/1", ""),
    (16, "http://only.net/fr/", ""),
    (17, "http://fan.org/", '<a href="http://only.net/">'),
    (15, "http://deep.er.x.net\n/fr/", ""),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "mine", 7) for r in rows], "page_id long, url string, html string, host string, bad int")


def test_equals_sql_on_odd_rows(spark):
    pages = frame(spark, PAGES)
    out = linkgraph.verdicts(pages)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    rows = [tuple(r) for r in out.collect()]
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url", "html").toArrow())
    assert sorted(rows, key=repr) == sorted(con.execute(linkgraph.SQL).fetchall(), key=repr)
    by_id = {r[0]: r[1:] for r in rows}
    assert by_id[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert by_id[2][2:] == ("www.example.com/en/", "allow")
    assert by_id[4][2:] == (None, "block")  # half of the host's pages are blocked
    assert by_id[17][2:] == (None, "block")  # its only link is to a host with blocked pages alone
    assert by_id[6][2:] == (None, "allow")  # its link is one of several to a host that is blocked in part
    assert by_id[8][2:] == (None, "allow")  # trusted by a link
    assert by_id[10] == by_id[9] == by_id[11] == ("", "", None, "allow")
    assert by_id[12] == ("", "/only/path", None, "allow")


def test_empty_table(spark):
    assert linkgraph.verdicts(frame(spark, PAGES).limit(0)).count() == 0


def test_scores_equal_plain_rounds(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("hub", "a")] + [("hub", f"h{i}") for i in range(40)] + [(f"h{i}", "bad") for i in range(40)]
    seeds = [("a", UNIT, 0), ("d", UNIT // 2, UNIT // 2), ("bad", 0, UNIT), ("alone", 0, UNIT)]
    got = linkgraph.propagate(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "host string, trusted long, blocked long"), 7)
    want = []
    for kind, turned in ((1, False), (2, True)):
        out = defaultdict(list)
        for u, v in edges:
            (out[v].append(u) if turned else out[u].append(v))
        seed = {s[0]: s[kind] for s in seeds}
        score = dict(seed)
        for _ in range(7):
            new = defaultdict(int, {h: OWN * x // 20 for h, x in seed.items()})
            for h, x in score.items():
                for to in out[h]:
                    new[to] += 17 * x // (20 * len(out[h]))
            score = new
        want.append(score)
    found = {r.host: (r.trust, r.distrust) for r in got.collect()}
    for host in {h for w in want for h, x in w.items() if x}:
        assert found[host] == (want[0].get(host, 0), want[1].get(host, 0))
    assert found["hub"][1] > 0 and found["alone"] == (0, OWN * UNIT // 20)


def test_rules_are_few():
    with pytest.raises(ValueError):
        linkgraph.rule_of(None, None, tuple(Rule("block", f"h{i}") for i in range(1001)))
