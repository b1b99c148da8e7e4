import random
import re

from lodestone.llm import urls

PAGES = "page_id long, url string, html string"


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


URLS = [
    "http://a.example.com/en/5", "http://a.example.com/en/7x", "https://B.Example.NET/de/8?x=/en/", "x://n.net/de/81", "ftp://org/es/", "http://o.org/ES/", "http://com/en/#t", "http://notcom/en/",
    None, "", "no scheme/en/", "http://", "http://h.com?q", "http://h.com#f", "http://a://b/c", "HTTP://É.com/en/é", "http://example.com:80/en/7", "http://x.example.com/en",
]


def test_host_path_and_rule(spark):
    rows = [(k, u, None) for k, u in enumerate(URLS)]
    got = urls.judge(spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES + ", host string, trust int")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = parts(URLS[r["page_id"]])
        name, verdict = rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, name)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def link(*hosts):
    return "".join(f'<a href="http://{h}/">' for h in hosts)


def test_standing_follows_links(spark):
    rows = [
        (1, "http://bad.com/en/1", ""), (2, "http://good.net/de/1", link("friend.info")), (3, "http://farm.info/", link("bad.com", "bad.com")),
        (4, "http://friend.info/x", ""), (5, "http://mixed.info/", link("good.net")), (6, "http://alone.info/", None), (7, "http://farm.info/", link("bad.com", "bad.com")),
    ]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block"}
    assert got[4]["trust"] > 0 == got[4]["distrust"] and got[3]["distrust"] > 0 == got[3]["trust"]


def power(edges, seeds, rounds, damping=0.85):
    """Personalised PageRank by plain iteration; rank at hosts without links goes back to the seeds."""
    leaves = {s for s, _, _ in edges}
    rank = dict(seeds)
    for _ in range(rounds):
        lost = sum(r for h, r in rank.items() if h not in leaves)
        new = {h: v * (1 - damping + damping * lost) for h, v in seeds.items()}
        for s, d, w in edges:
            new[d] = new.get(d, 0) + rank.get(s, 0) * w * damping
        rank = new
    return rank


def test_flow_matches_power_iteration(spark):
    edges = [("a", "b", 0.5), ("a", "c", 0.5), ("b", "c", 0.5), ("b", "end", 0.5), ("c", "a", 1.0), ("d", "a", 1.0)]
    seeds = {"x": {"a": 0.75, "d": 0.25}, "y": {"b": 1.0}}
    got = urls.flow(
        spark.createDataFrame([(k, *e) for k in seeds for e in edges], "kind string, src string, dst string, weight double"),
        spark.createDataFrame([(k, *h) for k, v in seeds.items() for h in v.items()], "kind string, host string, seed double"), 0.85, 60,
    ).collect()
    for kind, own in seeds.items():
        want = power(edges, own, 200)
        found = {r["host"]: r["rank"] for r in got if r["kind"] == kind}
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-4 for k in want)


def test_verdicts_match_power_iteration_end_to_end(spark):
    """A random web: edges, seeds, both flows and verdicts worked out from the rows alone."""
    draw = random.Random(5)
    hosts = ["bad.com", "worse.com", "good.net", "fine.net"] + [f"h{k}.info" for k in range(12)] + ["a.h1.info"]
    rows = []
    for k in range(80):
        host = draw.choice(hosts)
        path = {"com": "/en/1", "net": "/de/1"}.get(host.rsplit(".", 1)[1], "/x")
        rows.append((k, f"http://{host}{path}", link(*draw.sample(hosts, draw.randint(0, 4))) if draw.random() < 0.8 else None))
    rows += rows[:3]
    counts = {}
    for _, u, html in rows:
        src = parts(u)[0]
        for d in re.findall('href="http://([^/]*)/', html or ""):
            if d != src:
                counts[src, d] = counts.get((src, d), 0) + 1
    seen = {parts(u)[0] for _, u, _ in rows}
    for child, parent in (("a.h1.info", "h1.info"),):
        if child in seen and parent in seen:
            counts[child, parent] = counts.get((child, parent), 0) + 1
            counts[parent, child] = counts.get((parent, child), 0) + 1
    total = lambda of, at, h: sum(w for e, w in of.items() if e[at] == h)
    share = {e: w / total(counts, 0, e[0]) for e, w in counts.items()}
    forward = [(s, d, w) for (s, d), w in share.items()]
    back = [(d, s, w / total(share, 1, d)) for (s, d), w in share.items()]
    votes = {v: {h: 1.0 for h in seen if rule(h, {"com": "/en/1", "net": "/de/1"}.get(h.rsplit(".", 1)[1], "/x"))[1] == v} for v in ("allow", "block")}
    trust, distrust = (power(e, {h: 1 / len(votes[v]) for h in votes[v]}, 300) for e, v in ((forward, "allow"), (back, "block")))
    got = urls.judge(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    for r in got:
        t, d = trust.get(r["host"], 0), distrust.get(r["host"], 0)
        assert abs(r["trust"] - t) < 0.01 and abs(r["distrust"] - d) < 0.01
        if r["rule"] is None and abs(d - 0.5 * (t + d)) > 0.02:
            assert r["verdict"] == ("block" if d > 0.5 * (t + d) else "allow")


def test_equal_rules_and_long_pages(spark):
    tied = (("a.org", "/x", "block"), ("org", "/x/yz", "allow"))
    page = spark.createDataFrame([(1, "http://a.org/x/yz", link("b.org") * 20000), (1, "http://a.org/x/yz", None)], PAGES)
    for rules, verdict in ((tied, "allow"), ((("a.org", "/x", "block"), ("org", "/x/y", "allow")), "block"), ((("org", "/x/y", "allow"), ("a.org", "/x", "block")), "allow")):
        assert {r["verdict"] for r in urls.judge(page, rules).collect()} == {verdict}


def test_subdomains_link_to_the_nearest_parent(spark):
    rows = [(1, "http://a.b.c.org/", None), (2, "http://c.org/", None), (3, "http://b.c.org/", None)]
    got = {(r["src"], r["dst"]) for r in urls.host_edges(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {("a.b.c.org", "b.c.org"), ("b.c.org", "a.b.c.org"), ("b.c.org", "c.org"), ("c.org", "b.c.org")}


def test_empty(spark):
    assert urls.judge(spark.createDataFrame([], PAGES)).count() == 0
