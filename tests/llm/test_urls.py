import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import urls

RULES = urls.RULES


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    name, rest = rest[:at], rest[at:]
    end = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in name), rest[:end]


def brute(rows, links, rounds=10, damping=0.85):
    parsed = {i: parse(u) for i, u, _ in rows}
    rule = {}
    for i, (h, p) in parsed.items():
        fit = [(len(n) + len(x), n + x, a) for a, n, x in RULES if (h == n or h.endswith("." + n)) and p.startswith(x)]
        rule[i] = max(fit)[1:] if fit else (None, None)
    count = {}
    for i, (h, _) in parsed.items():
        if h:
            c = count.setdefault(h, [0, 0, 0])
            c[0] += 1
            c[1] += rule[i][1] == "allow"
            c[2] += rule[i][1] == "block"
    def rank(seed, edges):
        total = sum(seed.values())
        seed = {h: w / total * (1 - damping) for h, w in seed.items()}
        out = {}
        for s, _ in edges:
            out[s] = out.get(s, 0) + 1
        r = dict(seed)
        for _ in range(rounds):
            new = dict(seed)
            for s, d in edges:
                if s in r:
                    new[d] = new.get(d, 0) + r[s] / out[s] * damping
            r = new
        return r
    trust = rank({h: c[1] for h, c in count.items() if c[1] > c[2]}, links)
    distrust = rank({h: c[2] for h, c in count.items() if 2 * c[2] > c[0]}, [(d, s) for s, d in links])
    bad = {h for h, x in distrust.items() if x > 0 and round(x, 12) >= round((x + trust.get(h, 0)) / 2, 12)}
    return {i: (*parsed[i], rule[i][0], rule[i][1] or ("block" if parsed[i][0] in bad else "allow")) for i in parsed}


def made():
    rng = random.Random(6)
    names = [f"h{i}.{tail}" for i in range(9) for tail in ("net", "org", "info", "example.net", "example.com")]
    rows, links = [], []
    for i in range(400):
        name = rng.choice(names)
        url = f"http{'s' * (i % 2)}://{name.upper() if i % 5 == 0 else name}/{rng.choice(['en', 'fr', 'de', 'x'])}/{i}?q=://a/"
        html = ""
        for _ in range(rng.randint(0, 3)):
            other = rng.choice(names[:30])
            html += rng.choice([f'<a href="https://{other}/x">', f"<a HREF = '//{other}?y'>", f"<a class=b Href=https://{other} id=c>", f'<a data-href="https://no.where/x" href=" //{other}">']) + '<a href="/local">'
            if other != name:
                links.append((name, other))
        rows.append((i, url, html))
    rows += [(900, None, None), (901, "no scheme", "x"), (902, "x://ÄB.net", None), (903, "a://h#f/", ""), (904, "net://", "")]
    rows += [(905, "http://net/en/", ""), (906, "http://anet/x", ""), (907, "http://q.example.net/en", ""), (908, "http://x.example.net?/en/", "")]
    return rows, links


def test_judge_is_brute_force(spark):
    rows, links = made()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.id: tuple(r)[1:] for r in urls.judge(df.repartition(3)).collect()}
    want = brute(rows, links)
    assert got == want
    assert {"allow", "block"} == {v[3] for v in want.values() if v[2] is None}


def test_sql_agrees_on_linked_pages(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from millrace.llm.queries import oracle_sql, queries

    rows, _ = made()
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = sorted(tuple(r) for r in queries()["op4_url_filter"](spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect())
    want = con.execute("select page_id, host, path, rule, verdict from (" + oracle_sql()["op4_url_filter"] + ")").fetchall()
    assert got == sorted(want, key=lambda r: r[0])


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.net/", "x"), (1, "http://a.net/", "x"), (None, "http://b.org/en/", None)], "page_id long, url string, html string")
    assert sorted((r.id or 0, r.verdict) for r in urls.judge(df).collect()) == [(0, "allow"), (1, "block"), (1, "block")]
    assert urls.judge(df.where(F.lit(False))).count() == 0
    dotted = df.toDF("page.id", "u.rl", "h.tml")
    assert sorted((r.id or 0, r.verdict) for r in urls.judge(dotted, "page.id", "u.rl", "h.tml").collect()) == [(0, "allow"), (1, "block"), (1, "block")]
