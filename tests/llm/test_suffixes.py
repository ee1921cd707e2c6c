import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from slopeweave.llm import suffixes

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UP, LOW)))


def plain(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = cut(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if w else []:
            windows.setdefault(tuple(w[k:k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[p:p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    found |= got
        ids = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def check(spark, documents, rows, items, **how):
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(rows)
    got = suffixes.contamination(docs, bench).drop("spans").collect()
    want = plain(rows, items)
    assert sorted(map(tuple, got), key=str) == want
    clean = suffixes.keep_clean(docs, bench)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((w[0] for w in want if not w[5]), key=str)


def test_planted_passages(spark, documents):
    rnd = random.Random(1)
    vocabulary = ["w%d" % i for i in range(30)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(40)) for i in range(8)] + [(8, "short One, two"), (9, "single"), (10, ""), (11, None), (None, text(25)), (0, text(15)), (3, "ÉÀ é " * 6)]
    words = [cut(t) for _, t in items]
    rows = [(i, text(300)) for i in range(40)]
    for i in range(40, 90):
        w = words[rnd.choice([0, 1, 2, 3, 12, 14])]
        a = rnd.randrange(len(w))
        rows.append((i, text(20) + ", " + "\n".join(w[a:a + rnd.randint(1, 20)]).upper().replace("É", "é") + "; " + text(20)))
    rows += [(90, None), (91, ""), (92, "..."), (93, "one SHORT one two! short one two"), (94, "single"), (94, "single"), (None, "Single"), (95, items[0][1] + " " + items[0][1]),
             (96, " ".join(vocabulary) * 20_000)]
    check(spark, documents, rows, items)
    check(spark, documents, rows, [])
    check(spark, documents, [], items)


def test_blocks_of_items_give_the_same(spark, documents):
    rnd = random.Random(2)
    text = lambda n: " ".join(rnd.choice("abcdefgh") for _ in range(n))
    items = [(i, text(12)) for i in range(30)]
    rows = [(i, text(60) + " " + items[i % 30][1]) for i in range(40)]
    docs, bench = documents(rows), spark.createDataFrame(items, "item_id long, text string")
    one = suffixes.find(docs, bench).select("row.doc_id", "n_hit", "n_words").collect()
    many = suffixes.find(docs, bench, block_bytes=200).select("row.doc_id", "n_hit", "n_words").collect()
    assert sorted(one) == sorted(many) and sum(r.n_hit for r in one) > 0


def test_spans_are_the_longest_matches(spark, documents):
    item = " ".join(f"t{i}" for i in range(30))
    docs = documents([(1, "a b " + " ".join(f"t{i}" for i in range(3, 20)) + " c")])
    got = suffixes.contamination(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert [tuple(s) for s in got.spans] == [("7", 2, 17)] and got.n_hit == 17


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=12), min_size=1, max_size=6))
def test_suffix_array_is_sorted(docs):
    symbols = np.array([s for d in docs for s in d], np.uint64)
    left = np.array([len(d) - i for d in docs for i in range(len(d))])
    order = suffixes.suffix_array(symbols, left, 12)
    tails = [symbols[i:i + left[i]].tolist() for i in order]
    assert tails == sorted(tails) and sorted(order) == list(range(len(symbols)))
