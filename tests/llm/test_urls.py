from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from slopeweave.llm import urls
from slopeweave.llm.queries import RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    lower = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    return lower(rest[:end]), tail[:stop]


def given(host, path):
    best = None
    for rule in RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best)):
            best = rule
    return best


def mined(rows, support, confidence):
    """All frequent combinations, by counting every one."""
    n = len(rows)
    counts = Counter()
    single = Counter(t for ts, _ in rows for t in set(ts))
    often = {t for t, c in single.items() if c >= support * n}
    for ts, v in rows:
        own = sorted(set(ts) & often)
        for k in range(1, len(own) + 1):
            for c in combinations(own, k):
                counts[c] += 1
                counts[c, v] += 1
    rules = {}
    for key, c in counts.items():
        if len(key) == 2 and isinstance(key[0], tuple) and c >= support * n and c / counts[key[0]] >= confidence:
            rules[key] = (c / counts[key[0]], c / n)
    return {k: s for k, s in rules.items() if not any(len(k[0]) > 1 and rules.get((tuple(t for t in k[0] if t != x), k[1]), (0, 0))[0] >= s[0] for x in k[0])}


def test_hosts_paths_and_rules(spark):
    rows = ["http://EXAMPLE.com/en/1", "https://www.example.com/en/?q", "http://a.www.example.com/en/x#y", "http://b.net/es/", "http://b.net/es", "net/fr/", None, "", "x://",
            "ftp://com", "http://notexample.com/en/", "http://É.COM/A?b=://c/d", "http://h?x/y", "http://h#/y", "a://b://c/d", "http://x.com\n/en/", "http://net/fr/1"] * 2
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(rows)], "page_id long, url string, host string").select("page_id", "url", F.col("host").alias("tokens"))
    got = {r.page_id: r for r in urls.judge(df, RULES).collect()}
    assert len(got) == len(rows)
    for i, u in enumerate(rows):
        host, path = split(u)
        rule = given(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict in ("allow", "block") and (rule is None or got[i].verdict == RULES[rule])
    assert urls.judge(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in urls.judge(df, {}).collect()} == {"allow"}


def test_mined_rules_and_verdicts_against_counting(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    named = pages.withColumns({"host": urls.host(F.col("url")), "path": urls.path(F.col("url"))})
    rows = [(r.page_id, r.tokens, given(r.host, r.path)) for r in named.select(
        "page_id", "host", "path", urls.tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")).collect()]
    labelled = [(t, RULES[g]) for _, t, g in rows if g]
    want = mined(labelled, 0.05, 0.8)
    got = urls.mine(spark.createDataFrame(labelled, "tokens array<string>, verdict string"), 0.05, 0.8).collect()
    assert {(tuple(r.antecedent), r.verdict): (r.confidence, r.support) for r in got} == want and len(want) > 3
    common = Counter(v for _, v in labelled).most_common(1)[0][0]
    for r in urls.judge(pages, RULES, 0.05, 0.8).collect():
        tokens, rule = next((t, g) for i, t, g in rows if i == r.page_id)
        fit = [(-c, -s, list(a), v) for (a, v), (c, s) in want.items() if set(a) <= set(tokens)]
        assert r.verdict == (RULES[rule] if rule else min(fit)[3] if fit else common)
