import math
from collections import Counter

from inkgraph.llm import url_filter as u


def parts(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
    path = rest[len(host):]
    path = next((path[:i] for i, c in enumerate(path) if c in "?#"), path)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    best = None
    for action, rule in u.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = action, rule
    return best


def grams(host, path, buckets):
    out = []
    for text, seed in ((host, 1), (path, 101)):
        codes = [ord(c.lower() if "A" <= c <= "Z" else c) for c in f"^{text}$"]
        for n in u.SIZES:
            for i in range(len(codes) - n + 1):
                key = seed + n
                for c in codes[i:i + n]:
                    key = (key * 131 + c) % 2**31
                out.append(key * 2654435761 % 2**32 * buckets // 2**32)
    return out


def fitted(rows, buckets):
    """Plain gradient steps on the weights themselves."""
    x = [Counter([*grams(*parts(url), buckets), buckets]) for url, _ in rows]
    rate = 4 / max(sum(sum(n * b[k] for k, n in a.items()) for b in x) for a in x)
    w = [0.0] * (buckets + 1)
    for _ in range(u.STEPS):
        errors = [y - 1 / (1 + math.exp(-sum(w[k] * n for k, n in a.items()))) for a, (_, y) in zip(x, rows)]
        w = [v * (1 - u.DECAY) for v in w]
        for a, e in zip(x, errors):
            for k, n in a.items():
                w[k] += rate * n * e
    return w


URLS = [
    "http://a.example.com/en/1", "http://WWW.Example.COM/en/1?x=/en/", "https://example.com/de/1", "http://x.net/es/1", "http://x.net/es", "http://net/fr/", "http://notnet/fr/1", "http://x.org/en/", "http://com", "http://com?/", "http://xcom/",
    "http://casino-x.example.org/q", "no scheme", "", None, "://", "a://b://c/d", "http://É.com/ü#z", "http://x.net/es/" + "y" * 5000, "http://x.org/\U0001f600\n/z", "http://x.org/en/", "http://" + ".".join("a" * 400) + ".com/",
]


def test_against_plain_version(spark):
    pages = spark.createDataFrame([(i, url, "q", 3) for i, url in enumerate(URLS)], "page_id long, url string, host string, rule int")
    got = {r.page_id: r for r in u.filter_urls(pages, u.rule_table(spark), u.labelled_table(spark)).collect()}
    w = fitted(u.LABELLED, u.BUCKETS)
    for i, url in enumerate(URLS):
        host, path = parts(url)
        rule = ruled(host, path)
        margin = w[u.BUCKETS] + sum(w[k] for k in grams(host, path, u.BUCKETS))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule[1]), url
        assert got[i].verdict == (rule[0] if rule else "block" if margin > 0 else "allow"), (url, margin)
    assert got[11].verdict == "block" and got[14].verdict == "allow"


def test_long_rule_lists_are_joined_and_give_the_same(spark):
    pages = spark.createDataFrame([(i, url) for i, url in enumerate(URLS)], "page_id long, url string")
    rules = spark.createDataFrame([*u.RULES, ("allow", "x.org/en/"), ("block", "x.org/en/"), (None, "org/"), ("block", None), ("other", "org/")], "action string, rule string")
    a, b = (sorted(map(tuple, u.filter_urls(pages, rules, u.labelled_table(spark), inline=k).collect())) for k in (0, 200))
    assert a == b
    assert {r[4] for r in a if r[3] == "x.org/en/"} == {"block"}


def test_unseen_hosts(spark):
    pages = spark.createDataFrame([(i, f"http://{h}.example.org/en/{i}") for i, h in enumerate(("casino-gold", "my-bets", "pills-best", "adult-z", "spam-net", "ads-tracker", "www.thandre", "m.thewhst", "blog.listen", "forest"))], "page_id long, url string")
    rows = u.filter_urls(pages, u.rule_table(spark), u.labelled_table(spark)).orderBy("page_id").collect()
    assert [r.verdict for r in rows] == ["block"] * 6 + ["allow"] * 4


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert u.filter_urls(none, u.rule_table(spark), u.labelled_table(spark)).count() == 0
    pages = spark.createDataFrame([(1, "http://casino.org/"), (1, "http://casino.org/"), (None, None)], "page_id long, url string")
    for rules in (u.rule_table(spark).limit(0), u.rule_table(spark)):
        rows = u.filter_urls(pages, rules, u.labelled_table(spark).limit(0)).collect()
        assert [(r.rule, r.verdict) for r in rows] == [(None, "allow")] * 3
