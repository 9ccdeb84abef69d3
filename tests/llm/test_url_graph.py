"""URL filters against a plain walk over the same graph."""

from collections import defaultdict

from pyspark.sql import functions as F

from riskweave.llm import url_graph
from riskweave.llm.queries import URL_RULES

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LOC = {
    None: ("", ""), "": ("", ""), "example.org/es/": ("", ""), "http://": ("", ""), "HTTP://A.Example.ORG": ("a.example.org", ""),
    "http://x.example.org/es/1?a=://b/c": ("x.example.org", "/es/1"), "://q?z": ("q", ""), "a://b#c/d": ("b", ""), "a://b/c://d": ("b", "/c://d"),
    "http://u@h:8/é\n/x#y": ("u@h:8", "/é\n/x"), "http://İX.org/": ("İx.org", "/"),
}
RULED = {
    "http://example.org/es/": "example.org/es/", "http://a.b.example.org/es/9": "example.org/es/", "http://myexample.org/es/9": "org/", "http://example.org/en/17": "example.org/en/1",
    "http://example.org/en/2": "org/", "http://example.org": None, "http://example.com/fr/1": "com/fr/", "http://com/fr/": "com/fr/", "http://example.com/fr": None, "http://orgs/": None, "http://x.com/de/": "com/de/",
}


def walk(pages, rules, rounds=url_graph.ROUNDS):
    """Verdicts of hosts by the same whole-number steps, host by host."""
    edges, votes = set(), defaultdict(int)
    hosts = set()
    for host, links, verdict in pages:
        if host and len(host) <= 253:
            hosts.add(host)
            for other in links:
                hosts.add(other)
                edges.add((host, other))
        if verdict and host:
            votes[host] += 1 if verdict == "allow" else -1
    for host in list(hosts):
        parts = host.split(".")
        for i in range(len(parts) - 2):
            low, high = ".".join(parts[i:]), ".".join(parts[i + 1 :])
            edges |= {(low, high), (high, low)}
    edges = {(a, b) for a, b in edges if a != b}
    out = {}
    for sign in (1, -1):
        arcs = defaultdict(list)
        for a, b in edges:
            if sign > 0:
                arcs[a].append(b)
            else:
                arcs[b].append(a)
        sown = [h for h, n in votes.items() if n * sign > 0]
        start = {h: url_graph.MASS // len(sown) for h in sown}
        mass = dict(start)
        for _ in range(rounds):
            new = defaultdict(int, {h: m * 15 // 100 for h, m in start.items()})
            for a, m in mass.items():
                for b in arcs[a]:
                    new[b] += m * 85 // (len(arcs[a]) * 100)
            mass = new
        out[sign] = mass
    return {h for h in out[-1] if out[-1][h] > out[1].get(h, 0)}


def test_location_and_longest_rule(spark):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(list(LOC) + list(RULED))], "page_id bigint, url string")
    got = {r.url: r for r in url_graph.located(rows, URL_RULES, "url", F.col("url")).collect()}
    assert {u: (got[u].host, got[u].path) for u in LOC} == LOC
    assert {u: got[u].rule for u in RULED} == RULED
    assert got["http://example.org/en/17"].verdict == "block" and got["http://example.org/en/2"].verdict == "allow" and got["http://example.org"].verdict is None
    twice = url_graph.located(rows, [("allow", "org", "/"), ("block", "org", "/")])
    assert {r.verdict for r in twice.where("rule is not null").collect()} == {"block"}
    assert url_graph.located(rows, []).where("rule is not null").count() == 0


def link(*hosts):
    return "".join(f'<a HREF = "http://{h}/x">a</a>' for h in hosts)


PAGES = [
    (1, "http://good.example.org/en/2", link("friend.net", "Shop.net:80")), (2, "http://bad.example.com/de/1", link("friend.net")),
    (3, "http://friend.net/", "<a href='//next.net/q'>"), (4, "http://next.net/", None), (5, "http://farm.net/a", link("bad.example.com", "farm.net")),
    (6, "http://deep.farm.net/a", ""), (7, "http://alone.net/", link("alone.net")), (8, None, link("friend.net")), (9, "no url", ""),
    (None, "http://farm.net/b", ""), (5, "http://farm.net/a", link("bad.example.com")), (10, f"http://{'a.' * 200}net/", link("bad.example.com")),
    (11, "http://mixed.org/", ""), (12, "http://both.com/fr/", ""), (13, "http://both.com/de/", ""), (14, "http://both.com/es/", ""),
]


def found_links(html):
    import re

    return {m.translate(FOLD) for m in re.findall(url_graph.LINK, html or "")}


def test_trust_and_distrust(spark):
    rows = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "row", "graph", "src", "mass")})
    plain = {(r.page_id, r.host): r for r in url_graph.located(rows, URL_RULES, "url", F.col("page_id")).collect()}
    html = {(p, u): h for p, u, h in PAGES}
    facts = [(r.host, found_links(h), r.verdict) for (p, u), h in html.items() for r in [next(x for k, x in plain.items() if k[0] == p and (u or "").find(x.host) >= 0)]]
    facts.append(("farm.net", {"bad.example.com"}, None))
    bad = walk(facts, URL_RULES)
    assert "farm.net" in bad and "deep.farm.net" in bad and "friend.net" not in bad and "next.net" not in bad
    got = url_graph.judge(rows, URL_RULES).collect()
    assert len(got) == len(PAGES)
    for r in got:
        ruled = plain[(r.page_id, r.host)].verdict
        assert r.verdict == (ruled or ("block" if r.host in bad else "allow")), r
    kept = url_graph.allowed(rows, URL_RULES)
    assert kept.columns == rows.columns and kept.count() == sum(r.verdict == "allow" for r in got)
    assert {r.host for r in kept.collect()} == {"x"}


def test_no_pages_no_seeds_and_a_star(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert url_graph.judge(empty, URL_RULES).count() == 0
    bare = spark.createDataFrame([(1, "http://a.b/", None), (1, "http://a.b/", None)], "page_id bigint, url string, html string")
    assert [r.verdict for r in url_graph.judge(bare, []).collect()] == ["allow"] * 2
    # one hub linked from many hosts: masses are those of the plain walk
    star = [(i, f"http://h{i}.net/", link("hub.net")) for i in range(300)] + [(999, "http://hub.net/", link("x.com")), (1000, "http://x.com/de/", "")]
    rows = spark.createDataFrame(star, "page_id bigint, url string, html string")
    edges = url_graph.host_edges(rows)
    assert edges.count() == 301
    masses = {r.host: (r.trust, r.distrust) for r in url_graph.propagate(edges, url_graph.seeds(url_graph.located(rows, URL_RULES))).collect()}
    bad = walk([(f"h{i}.net", {"hub.net"}, None) for i in range(300)] + [("hub.net", {"x.com"}, None), ("x.com", set(), "block")], URL_RULES)
    assert {h for h, (t, d) in masses.items() if d > t} == bad and len(bad) == 302
