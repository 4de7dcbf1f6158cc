from __future__ import annotations

import re

import pytest

from siloforge.llm import urls

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


def brute(pages):
    """The same ranks with dictionaries."""
    rows = [(*parts(u), h or "") for _, u, h in pages]
    edges, seeds = {}, {"trust": {}, "distrust": {}}
    for host, path, html in rows:
        r = rule_of(host, path)
        if r and host:
            s = seeds["trust" if RULES[r] == "allow" else "distrust"]
            s[host] = s.get(host, 0) + 1
        links = re.findall(r"""(?i)<[a-z][^>]*?\s(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"'>]+)""", html)
        for t in {parts(re.sub("^//", "x://", x))[0] for x in links}:
            if host and t and t != host:
                edges[host, t] = edges.get((host, t), 0) + 1
    whole = sum(sum(s.values()) for s in seeds.values()) or 1
    out = {}
    for kind, s in seeds.items():
        e = edges if kind == "trust" else {(b, a): n for (a, b), n in edges.items()}
        seed = {h: n / whole for h, n in s.items()}
        rank, total = dict(seed), {}
        for (a, _), n in e.items():
            total[a] = total.get(a, 0) + n
        for _ in range(urls.ITERATIONS if e else 0):
            moved = {}
            for (a, b), n in e.items():
                if a in rank:
                    moved[b] = moved.get(b, 0) + n / total[a] * rank[a]
            left = 1 - 0.85 * sum(moved.values()) / (sum(seed.values()) or 1)
            new = {h: 0.85 * moved.get(h, 0) + seed.get(h, 0) * left for h in {*rank, *moved}}
            shift = max(abs(new[h] - rank.get(h, 0)) for h in new) if new else 0
            rank = new
            if shift < 1e-12:
                break
        out[kind] = rank
    return rows, out


PAGES = [
    (1, "http://good.org/a", '<a href="http://b.net/x"><a class=q href=\'//c.net\'>'), (2, "HTTP://B.net", '<a href="https://c.net/">'), (3, "http://z.com/de/1", '<img src="http://good.org/i">'),
    (4, "http://bad.net/#x://y", '<a href="http://Z.com/de"> <a href="http://bad.net/">'), (5, None, None), (6, "nourl", '<a href="http://b.net">'), (7, "http://c.net?x", '<a href="http://bad.net">'), (8, "http://EXAMPLE.org/en/19?", ""),
    (9, "http://w.example.org/es/", ""), (9, "http://w.example.org/es/", ""), (10, "http://notexample.org/es/", ""), (11, "http://org/", ""), (12, "http://org", ""), (13, "://", ""), (14, "http://a.com/fr/", '<a href="http://bad.net">' * 5),
    (15, "http://loop.net/", '<a href="http://bad.net">'), (16, "http://a://b/c", ""), (None, "http://x\n.org/\ny", "<a\nhref=//b.net>"),
]


def test_against_dictionaries(spark, wide):
    got = sorted(map(tuple, urls.judged(wide(PAGES, "page_id long, url string, html string")).collect()), key=str)
    rows, ranks = brute(PAGES)
    want = []
    for (i, _, _), (host, path, _) in zip(PAGES, rows, strict=True):
        t, d = (ranks[k].get(host, 0.0) for k in ("trust", "distrust"))
        r = rule_of(host, path)
        want.append((i, host, path, r, RULES[r] if r else ("block" if d > 0.6 * (t + d) else "allow"), t, d))
    want.sort(key=str)
    by = lambda x: [r[:5] for r in sorted(x, key=lambda r: str(r[:5]))]
    assert by(got) == by(want)
    for a, b in zip(sorted(got, key=lambda r: str(r[:5])), sorted(want, key=lambda r: str(r[:5])), strict=True):
        assert a[5:] == pytest.approx(b[5:], abs=1e-6)


def test_against_sql(spark, wide, tmp_path):
    import duckdb
    from harness import duck_table, spark_table

    wide(PAGES, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert spark_table(urls.op2(spark, str(tmp_path))) == duck_table(con, urls.ORACLE)


def test_far_hosts(spark, wide, tmp_path):
    import duckdb
    from harness import duck_table, spark_table

    n = 60
    rows = [(i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">' if i + 1 < n else '<a href="http://z.com/de/">') for i in range(n)] + [(900, "http://z.com/de/x", ""), (901, "http://else.net", "")]
    wide(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = urls.op2(spark, str(tmp_path))
    assert got.filter("verdict = 'block'").count() == n + 1
    assert spark_table(got) == duck_table(con, urls.ORACLE)


def test_too_few_iterations_are_an_error(spark):
    edges = spark.createDataFrame([("trust", f"h{i}", f"h{i + 1}", 1.0) for i in range(9)], "kind string, a string, b string, n double")
    with pytest.raises(RuntimeError):
        urls.propagated(edges, spark.createDataFrame([("trust", "h0", 1.0)], "kind string, host string, seed double"), most=4)


def test_given_pages(spark, sf_dir):
    rows = urls.op2(spark, sf_dir).collect()
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert (r["host"], r["path"]) == parts(pages[r["page_id"]])
        assert r["rule"] == rule_of(r["host"], r["path"]) and (r["rule"] is None or r["verdict"] == RULES[r["rule"]])


def test_empty(spark, wide):
    assert urls.judged(wide([], "page_id long, url string, html string")).count() == 0
