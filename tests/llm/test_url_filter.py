import random
import re

import pytest

from palisade.llm.url_filter import RULES, host_edges, judge, propagate
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string"


def split(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def brute(rows, links):
    """Power iteration to a fixed point with dictionaries."""
    named = [(p, *split(u)) for p, u, _ in rows]
    ruled = [rule(h, p) for _, h, p in named]
    seeds = {}
    for (_, h, _), r in zip(named, ruled):
        if h:
            n = seeds.setdefault(h, [0, 0, 0])
            n[0] += 1
            n[1] += r is not None and r.verdict == "allow"
            n[2] += r is not None and r.verdict == "block"
    scores = []
    for kind in (1, 2):
        total = sum(n[kind] / n[0] for n in seeds.values()) or 1
        start = {h: n[kind] / n[0] / total for h, n in seeds.items() if n[kind]}
        move = {}
        for (a, b), w in links.items():
            a, b = (a, b) if kind == 1 else (b, a)
            move.setdefault(a, {})[b] = w
        now = dict(start)
        for _ in range(200):
            after = {h: 0.3 * s for h, s in start.items()}
            for a, s in now.items():
                for b, w in move.get(a, {}).items():
                    after[b] = after.get(b, 0) + 0.7 * s * w / sum(move[a].values())
            now = after
        scores.append(now)
    out = {}
    for (p, h, path), r in zip(named, ruled):
        t, d = (s.get(h, 0.0) for s in scores)
        out[p] = (h, path, r and r.name, r.verdict if r else "block" if d > 0.5 * (t + d) else "allow", t, d)
    return out


def edges_of(rows):
    links, hosts = {}, set()
    for _, u, html in rows:
        h = split(u)[0]
        if h:
            hosts.add(h)
            for x in re.findall(r"//([^/?#\"'\s<>]+)", html or ""):
                hosts.add(x.lower())
                if x.lower() != h:
                    links[h, x.lower()] = links.get((h, x.lower()), 0) + 1
    pairs = set()
    for h in hosts:
        names = h.split(".")
        for i in range(len(names) - 2):
            a, b = ".".join(names[i:]), ".".join(names[i + 1:])
            pairs |= {(a, b), (b, a)}
    for e in pairs:
        links[e] = links.get(e, 0) + 1
    return links


def pages(seed):
    rng = random.Random(seed)
    hosts = ["a.example.com", "b.a.example.com", "x.example.net", "spam.net", "good.org", "sub.good.org", "plain.io", "lone.dev", "Up.Example.NET"]
    out = []
    for i in range(300):
        h = "hot.io" if i % 3 == 0 else rng.choice(hosts)
        refs = "".join(f'<a href="{rng.choice(("http:", "HTTPS:", ""))}//{rng.choice(hosts[:-1])}/p{rng.random()}">x</a> <a href=/rel>' for _ in range(rng.randrange(3)))
        out.append((i, f"https://{h}/{rng.choice(['en', 'de', 'fr', ''])}/{i}{rng.choice(['', '?q=://z', '#f/de/'])}", f"<html>{refs}</html>"))
    return out


def test_equals_brute_force(spark):
    rows = pages(4) + [(1000, None, "x"), (1001, "no scheme", None), (1002, "://", ""), (1003, "http://net", None), (1004, "http://net/", None), (1005, "a://b://c/d", None),
                       (1006, "http://plain.io?x", None), (1007, "http://EXAMPLE.net/en/a", None), (1008, "http://example.net/en", None), (None, "http://x.org/fr/", None)]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"host": F.lit("x"), "rule": F.lit("y"), "kind": F.lit("z")})
    got = {r.page_id: tuple(r)[1:] for r in judge(table).collect()}
    want = brute(rows, edges_of(rows))
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items()}
    for k, (*_, verdict, trust, distrust) in want.items():
        assert got[k][4:] == pytest.approx((trust, distrust), abs=4e-3)
        if abs(trust - distrust) > 1e-2 or trust == distrust == 0:
            assert got[k][3] == verdict, k
    assert {"allow", "block"} == {v[3] for v in got.values() if v[2] is None}


def test_repeated_rows_and_empty_table(spark):
    table = spark.createDataFrame([(1, "http://a.net/x", "")] * 3 + [(1, "http://b.io/", None)], SCHEMA)
    assert judge(table).filter("rule = 'net/'").count() == 3
    assert judge(table.limit(0)).count() == 0


def test_edges(spark):
    rows = [(1, "http://w.x.example.com/", '<a href="//y.org/a"><img src=\'http://Y.org/b\'><a href="/local">'), (2, "http://q.io/", None)]
    named = spark.createDataFrame(rows, SCHEMA).selectExpr("regexp_extract(url, '://([^/]*)', 1) AS host", "coalesce(html, '') AS html")
    got = {(r.src, r.dst): r.weight for r in host_edges(named).collect()}
    assert got == {("w.x.example.com", "y.org"): 2.0, ("w.x.example.com", "x.example.com"): 1.0, ("x.example.com", "w.x.example.com"): 1.0,
                   ("x.example.com", "example.com"): 1.0, ("example.com", "x.example.com"): 1.0}


def test_no_seeds(spark):
    edges = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([], "host string, trust double, distrust double")
    assert propagate(edges, seeds).count() == 0
