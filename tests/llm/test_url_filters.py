import random

from hearken.llm import url_filters as U
from hearken.llm.queries import URL_RULES

RULES = [U.parse_rule(r) for r in URL_RULES]


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[0] == "block"), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else default


def test_trie_and_join_match_brute_force(spark):
    rng = random.Random(2)
    hosts = ["example.com", "WWW.Example.com", "a.b.net", "net", "xnet", "com", "deep.www.example.com", "é.org", ""]
    paths = ["", "/", "/en", "/en/", "/en/x/y", "/es/1", "/fr", "/fr/", "/enx/"]
    urls = [None, "", "no-scheme/en/", "http://", "x://y://net/es/"] + [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#f'])}" for _ in range(200)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*urls, urls[-1]])], "page_id long, url string, rule string")
    rules = [*RULES, ("block", "a.b.net", "/e"), ("allow", "net", "/e"), ("allow", "com", "/en/x"), ("block", "com", "/en/x")]
    for options in ({}, {"most_rules": 0}):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(pages, rules, **options).collect()}
        assert len(got) == len(urls) + 1
        for i, u in enumerate(urls):
            assert got[i] == brute(u, rules), u
    assert U.judge(pages.limit(0), rules).count() == 0
