import math
import random
import re
from collections import Counter

import pytest

from slopeweave.llm import crossentropy, resampling, shards

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(rows, good, prior=crossentropy.PRIOR):
    """Models of the words themselves, counted anew without each document."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(UP, LOW)))
    texts = [cut(t) for _, t in rows]
    side = [0 if i in good else 1 for i, _ in rows]
    size = [sum(len(w) for w, s in zip(texts, side) if s == k) for k in (0, 1)]
    out = []
    for row, ((i, _), mine) in enumerate(zip(rows, texts)):
        loss = []
        for k in (0, 1):
            scale = min(size) / max(size[k], 1)
            both, own, before = Counter(), Counter(), Counter()
            for other, (w, s) in enumerate(zip(texts, side)):
                if s == k and other != row:
                    both.update(zip([None, *w], w)), own.update(w), before.update([None, *w[:-1]] if w else [])
            n = sum(own.values())
            p = lambda b, o: (scale * both[b, o] + prior * (scale * own[o] + 1) / (scale * n + 65_536)) / (scale * before[b] + prior)
            loss.append(-sum(math.log(p(b, o)) for b, o in zip([None, *mine], mine)) / max(len(mine), 1))
        out.append((str(i), len(mine), *loss, loss[0] - loss[1]))
    return sorted(out)


def close(got, want):
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(g[2:] == pytest.approx(w[2:], abs=1e-4) for g, w in zip(got, want))


def scores(df):
    return sorted((str(r.doc_id), r.n_words, r.loss_target, r.loss_background, r.difference) for r in df.collect())


def table(seed, words=14):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(["the", "of", "The", f"w{rnd.randrange(words)}", "é,"]) for _ in range(rnd.randint(1, 60)))) for i in range(90)]


@pytest.mark.parametrize("threshold, bits", [("10m", 27), ("-1", 6)])
def test_against_models_of_the_words_themselves(spark, documents, monkeypatch, threshold, bits):
    """Also with a table of bits so full that every row passes it, and nothing broadcast by Spark itself."""
    monkeypatch.setattr(shards, "ID_BITS", bits)
    rows = table(1) + [(None, "the of"), (500, None), (501, ""), (502, "..."), (503, "tie tie"), (503, "tie tie"), (504, "the of " * 3_000)]
    good = {i for i in range(0, 90, 3)} | {503}
    target = spark.createDataFrame([(i,) for i in good] + [(None,), (3,)], "doc_id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        close(scores(crossentropy.differences(documents(rows), target)), plain(rows, good))
        picked = resampling.resample(documents(rows), target).collect()
        assert len(picked) == len(rows) and sum(r.selected for r in picked) == math.ceil(len(rows) / 4)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_documents_like_the_target_score_lower(spark, documents):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("abcdefgh" if i % 2 else "efghijkl") for _ in range(40))) for i in range(200)]
    good = spark.createDataFrame([(i,) for i in range(1, 200, 4)], "doc_id long")
    got = {r.doc_id: r.difference for r in crossentropy.differences(documents(rows), good).collect()}
    odd, even = [got[i] for i in range(3, 200, 4)], [got[i] for i in range(0, 200, 2)]
    assert max(odd) < min(even)


def test_nothing(spark, documents):
    none = spark.createDataFrame([], "doc_id long")
    assert crossentropy.differences(documents([]), none).count() == 0
    only = crossentropy.differences(documents([(1, "a b")]), none).first()
    assert only.loss_target == pytest.approx(math.log(1 << crossentropy.WORD_BITS), abs=1e-4) and only.n_words == 2 and only.difference == 0
