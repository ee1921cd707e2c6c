import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from slopeweave.llm import phrases, queries

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(rows, support=10, most=3, cover=50, reported=2000):
    """Every phrase is counted in one dictionary."""
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        total[lang] += 0
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(str.maketrans(UP, LOW))):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, most + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    f = {p: n for p, n in f.items() if n >= support}
    out = []
    for lang in total:
        found = []
        for (of, p), a in f.items():
            if of != lang or len(p) < 2:
                continue
            if any(g == lang and len(q) > len(p) and 100 * n >= cover * a and any(q[i:i + len(p)] == p for i in range(len(q))) for (g, q), n in f.items()):
                continue
            score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:reported], 1)]
    return sorted(out)


def test_whole_table_equals_its_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = con.execute(queries.ORACLES["op12_phrases"]).fetchall()
    got = queries.op12_phrases(spark, data).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert len(want) > 100 and sorted(map(tuple, got)) == sorted(want)


def rows_of(n, seed=3):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "The", "é", "new", "york", "city", f"w{rnd.randrange(40)}"])
    return [("".join(word() + rnd.choice([" ", " ", "  ", "\t", ", ", ". ", "\n", " new york city "]) for _ in range(rnd.randint(0, 40))), rnd.choice(["en", "en", "de", None])) for _ in range(n)]


@pytest.mark.parametrize("shard, support, most", [(300, 10, 3), (4 << 20, 10, 3), (2_000, 4, 4), (900, 23, 2)])
def test_against_one_dictionary(spark, documents, monkeypatch, shard, support, most):
    """Many small shards (support 1 in each) and few large ones (a share of the support) give the same."""
    monkeypatch.setattr(phrases, "SHARD_TEXT", shard)
    rows = rows_of(250) + [(None, "en"), ("", "xx"), (None, None), ("tie tie tie " * 40, "fr"), ("a" * 5_000 + " b " * 3_000, "fr"), ("x. y! z", "und")]
    docs = documents([(i, t, g) for i, (t, g) in enumerate(rows)], 4)
    got = phrases.collocations(docs, support, most, reported=30).collect()
    assert sorted(map(tuple, got)) == plain(rows, support, most, reported=30)


def test_a_full_filter_loses_nothing(spark, documents, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_BITS", 6)
    rows = rows_of(200, 5)
    got = phrases.collocations(documents([(i, t, g) for i, (t, g) in enumerate(rows)])).collect()
    assert sorted(map(tuple, got)) == plain(rows)


def test_local_support_loses_no_phrase():
    rnd = random.Random(1)
    for _ in range(2_000):
        sizes = [rnd.randint(0, 50) for _ in range(rnd.randint(1, 12))]
        least = [phrases.local_support(s, sum(sizes), 10) for s in sizes]
        assert sum(n - 1 for n in least) < 10


def test_exact_scores_of_large_counts(spark):
    big = 3_000_000_000
    rows = [("en", "a", 1, big + 1), ("en", "b", 1, big + 7), ("en", "a b", 2, big)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, n long")).first()
    assert (got.l, got.r, got.score) == (big + 1, big + 7, 1_000_000 * big * big // ((big + 1) * (big + 7)))


def test_no_rows_and_bytes_that_are_not_utf8(spark, documents):
    assert phrases.collocations(documents([])).count() == 0
    docs = spark.range(12).select(F.expr("cast(X'61FF2062' AS STRING)").alias("text"), F.lit(None).cast("string").alias("lang"))
    assert [(r.lang, r.phrase, r.a, r.n) for r in phrases.collocations(docs).collect()] == [("und", "a� b", 12, 24)]
