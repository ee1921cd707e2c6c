import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopeweave.llm import egojoin, queries


def plain(rows, similarity=0.95):
    """Every vector against every other."""
    width = max((len(v) for _, v in rows if v), default=0)
    good = [i for i, (_, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    m = np.array([list(rows[i][1]) + [0.0] * (width - len(rows[i][1])) for i in good], float).reshape(len(good), width)
    m = m / np.abs(m).max(axis=1, initial=1e-300)[:, None]
    n = np.sqrt((m * m).sum(axis=1))
    near = (m @ m.T) / (n[:, None] * n[None, :]) >= similarity
    np.fill_diagonal(near, False)
    label = np.arange(len(good))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(good)).min(axis=1, initial=len(good)))
        if (new == label).all():
            break
        label = new
    keys = [rows[i][0] for i in good]
    least = {}
    for k, g in zip(keys, label.tolist()):
        least[g] = min([x for x in (least.get(g), k) if x is not None], default=None)
    found = {i: (0, k) for i, (k, _) in enumerate(rows)}
    found |= {i: (int(near[j].sum()), least[int(label[j])]) for j, i in enumerate(good)}
    return sorted((str(k), *found[i], k is not None and k == found[i][1]) for i, (k, _) in enumerate(rows))


def run(df):
    return sorted((str(r[0]), r.n_links, r.component_id, r.kept) for r in egojoin.near_duplicates(df).collect())


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(k, v, "x", 1) for k, v in rows], f"vec_id long, embedding array<{kind}>, vector string, no int").repartition(3)


def groups(seed, n=500, width=12):
    """Loose vectors, chains of near ones, one large group of near copies and one of equal rows."""
    rnd = np.random.default_rng(seed)
    chain = np.cumsum(rnd.normal(0, 0.09, (80, width)), axis=0) + rnd.normal(0, 1, width)
    middle = rnd.normal(0, 1, width)
    parts = [rnd.normal(0, 1, (n // 3, width)), chain, middle + rnd.normal(0, 0.02, (n // 3, width)), np.repeat(rnd.normal(0, 1, (1, width)), n // 3, axis=0)]
    m = np.concatenate(parts).astype(np.float32)
    return [(int(i), [float(x) for x in v]) for i, v in zip(rnd.permutation(len(m)), m)]


@pytest.mark.parametrize("block, fan", [(16, 2), (64, 8), (2_048, 8)])
def test_against_all_pairs(spark, monkeypatch, block, fan):
    monkeypatch.setattr(egojoin, "BLOCK", block)
    monkeypatch.setattr(egojoin, "FAN", fan)
    monkeypatch.setattr(egojoin, "AT_ONCE", 7)
    rows = groups(block)
    assert run(frame(spark, rows)) == plain(rows)


def test_whole_intervals_and_skipped_ones_occur(spark, monkeypatch):
    monkeypatch.setattr(egojoin, "BLOCK", 16)
    monkeypatch.setattr(egojoin, "FAN", 2)
    seen = []
    pairs = egojoin.interval_pairs
    monkeypatch.setattr(egojoin, "interval_pairs", lambda *a: seen.append(pairs(*a)) or seen[0])
    rows = groups(9)
    assert run(frame(spark, rows)) == plain(rows)
    blocks = -(-len({tuple(v) for _, v in rows}) // 16)
    assert seen[0].filter("within AND level > 0").count() > 0 and seen[0].filter("level = 0").count() < blocks * (blocks + 1) // 2 * 0.7


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0, 0.0]), (8, [1.0]), (9, [2e30, 1e28]), (10, [1e-40, 0.0]),
            (None, [1.0, 0.01]), (None, None), (11, [-1.0, 0.0]), (12, [-1.0, -0.0]), (12, [-1.0, 0.0]), (12, [0.0, 1.0])]
    assert run(frame(spark, rows)) == plain(rows)
    big = [(1, [1e300, 1e300]), (2, [1e-300, 1e-300]), (3, [1e300, -1e300])]
    assert run(frame(spark, big, "double")) == plain(big)


def test_no_rows(spark):
    assert run(frame(spark, [])) == []
    assert run(frame(spark, [(3, None)])) == [("3", 0, 3, True)]


def test_the_whole_table(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in queries.op13_embeddings(spark, data).collect())
    assert got == plain(rows)


def test_blocks_are_not_sent_pair_by_pair(spark, monkeypatch):
    """Each pass sends every block once and those of its stripe once for each chunk, not both blocks of each pair."""
    for name, value in (("BLOCK", 16), ("FAN", 2), ("STRIPES", 3), ("CHUNKS", 4)):
        monkeypatch.setattr(egojoin, name, value)
    sent, by_group = [], egojoin.by_group
    monkeypatch.setattr(egojoin, "by_group", lambda df, *a: sent.append(df.agg(F.count_if(F.col("b").isNull()), F.count("b")).first()) or by_group(df, *a))
    rows = groups(3, 900)
    assert run(frame(spark, rows)) == plain(rows)
    blocks = -(-len({tuple(v) for _, v in rows}) // 16)
    assert len(sent) in (3, 4) and sum(moved for moved, _ in sent) <= min(blocks * (4 + len(sent)), 2 * sum(pairs for _, pairs in sent) - 1), (blocks, sent)
