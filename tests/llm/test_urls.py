import re

import pytest

from clickfeat.llm import urls as U
from clickfeat.llm.queries import RULES, SPAM_HOSTS


def brute(url, rules, blocked, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.split("[/?#]", rest, maxsplit=1)[0])
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    under = lambda h: host == h or host.endswith("." + h)
    fit = max(((len(h + p), v == "block", h + p, v) for v, h, p in rules if host and under(h) and path.startswith(p)), default=None)
    if fit:
        return host, path, fit[2], fit[3]
    return host, path, None, "block" if any(under(h) for h in blocked) else default


def judged(spark, pages, rules=RULES, blocked=SPAM_HOSTS):
    return sorted((tuple(r) for r in U.judge(pages, rules, blocked).collect()), key=str)


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    want = sorted(((r.page_id, *brute(r.url, RULES, SPAM_HOSTS)) for r in pages.collect()), key=str)
    assert judged(spark, pages) == want
    assert {w[4] for w in want} == {"allow", "block"} and len({w[3] for w in want}) == 6


EDGES = [None, "", "no scheme", "://", "://EXAMPLE.org/es/x", "http://example.org", "http://example.org/", "http://Example.ORG/en/1?x=/es/",
         "http://a.b.example.org/en/12#z", "http://badexample.org/es/", "http://org/es/", "http://x.com/fr/y", "http://x.com/de", "http://x.com/de/",
         "http://spam-farm.example.com", "http://www.spam-farm.example.com/x", "http://spam-farm.example.com.evil.net/", "http://.org/",
         "a://b://example.org/es/", "http://İ.org/é", "http://h/" + "x" * 100_000, "http://" + "a." * 20_000 + "org/x", "http://x.com:80/fr/",
         "http://u@x.com/fr/", "http://x.com/fr/\n/q", "http://x.com?/fr/", "HTTP://X.COM/FR/"]


def test_edges(spark):
    rows = [(i, u) for i, u in enumerate(EDGES)] + [(2, "http://x.org/"), (None, "http://x.com/de/")]
    pages = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, host string, rule int")
    assert judged(spark, pages) == sorted(((i, *brute(u, RULES, SPAM_HOSTS)) for i, u in rows), key=str)
    assert judged(spark, pages.limit(0)) == []
    assert judged(spark, pages, [], []) == sorted(((i, *brute(u, [], [])) for i, u in rows), key=str)


@pytest.mark.parametrize("share", [2, 40])
def test_cascade_is_exact_over_its_universe(spark, share):
    import numpy as np
    keys = spark.range(20_000).selectExpr("cast(id as string) key")
    universe = keys.select(*U._hashes("key"))
    listed = [str(i) for i in range(0, 20_000, share)] + ["absent"]
    levels = U.cascade(universe, listed)
    rows = keys.select("key", *U._hashes("key")).toArrow()
    got = U.member(levels, *(U._longs(rows[c].combine_chunks()) for c in "ab"))
    assert set(np.array(rows["key"].to_pylist())[got]) == set(listed) - {"absent"}
    assert len(levels) > 2 and sum(x.bits for x in levels) < 64 * 20_000
