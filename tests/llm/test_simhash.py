import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from slopeweave.llm import simhash
from slopeweave.llm.linked import components

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UP, LOW)))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain(rows, bits=3):
    fps = [plain_fingerprint(t) for _, t in rows]
    arr = np.array(fps, np.uint64)
    near = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= bits
    of = plain_components([(int(i), int(j)) for i, j in zip(*np.nonzero(near)) if i < j], range(len(rows)))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[of[i]] = min(least.get(of[i], d), d)
    return sorted(((d, f"{fps[i]:016x}", least.get(of[i])) for i, (d, _) in enumerate(rows)), key=str)


def test_documents_against_all_pairs(spark, data, documents):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rnd = random.Random(3)
    for i in range(60):  # near copies of one document
        words = rows[5][1].split()
        words[rnd.randrange(len(words))] = f"new{i}"
        rows.append((10_000 + i, " ".join(words)))
    rows += [(None, "no id"), (20_000, None), (20_001, ""), (20_002, " \n\t"), (20_003, "One"), (20_004, "one"), (20_005, "one two"), (20_005, "one two"),
             (20_006, "a\x0bb  c\n d e"), (20_007, "é É x y z"), (20_008, "w " * 70_000)]
    got = simhash.grouped(documents(rows)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id").collect()
    assert sorted(((r.doc_id, r.f, r.component_id) for r in got), key=str) == plain(rows)
    kept = simhash.keep_one(documents(rows))
    want = {c for _, _, c in plain(rows)}
    assert kept.columns == documents(rows).columns
    assert sorted(((r.doc_id) for r in kept.collect()), key=str) == sorted(want, key=str)


def linked(spark, fps, bits=3):
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    got = {r.node & (2**64 - 1): r.root for r in components(simhash.links(df, bits)).collect()}
    arr = np.array(fps, np.uint64)
    pairs = [(int(i), int(j)) for i, j in zip(*np.nonzero(np.bitwise_count(arr[:, None] ^ arr[None, :]) <= bits)) if i < j]
    want = plain_components(pairs, range(len(fps)))
    groups = lambda name: sorted(sorted(g) for g in {k: [i for i in range(len(fps)) if name(i) == k] for k in {name(i) for i in range(len(fps))}}.values())
    assert groups(lambda i: got.get(fps[i], f"alone{i}")) == groups(lambda i: want[i])


def test_links_at_every_distance(spark):
    rnd = random.Random(1)
    fps = set()
    for _ in range(120):
        f = rnd.getrandbits(64)
        fps |= {f, *(f ^ sum(1 << b for b in rnd.sample(range(64), k)) for k in (1, 2, 3, 3, 3, 4, 5))}
    linked(spark, sorted(fps))
    linked(spark, sorted(fps)[:300], bits=5)
    linked(spark, sorted(fps)[:300], bits=0)


def test_one_anchor_with_many_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOMES_PER_PIECE", 16)
    rnd = random.Random(2)
    base = rnd.getrandbits(64)
    fps = {base ^ (rnd.getrandbits(31) << 32) for _ in range(500)} | {base ^ (1 << a) ^ (1 << b) for a in range(40, 60) for b in range(30)}
    linked(spark, sorted(fps))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(2, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1400)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(documents):
    assert simhash.grouped(documents([])).count() == 0 and simhash.keep_one(documents([])).count() == 0
