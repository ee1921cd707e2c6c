import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from slopeweave.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_the_tokenizer(spark, data):
    whole, own = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    texts += ["", " ", "  ", "a  b", "a   b", "a \n b", "\n\n x", "x \n", "don't we'll", "1 22  3", " lead", "trail ", "a b  c", "é ü\t\tz", "a \x1c b",
              "<|endoftext|> a", "日本 語 。 a", "x\u0085 y", " a  b"]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t[:80])


@settings(max_examples=200, deadline=None)
@given(st.text(" \n\tab1é.' ", max_size=40))
def test_ids_of_any_spacing(text):
    own = packing._encoders.setdefault("test", packing.Encoder(PATH)) if "test" not in packing._encoders else packing._encoders["test"]
    assert np.frombuffer(own.encode(text), "<u4").tolist() == own.whole.encode(text, add_special_tokens=False).ids


def check(rows, placed, capacity=2048):
    """Pieces restore the documents, sequences are gapless and within the capacity; the number of sequences."""
    whole = Tokenizer.from_file(PATH)
    want = Counter()
    for d, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        n = len(ids)
        cuts = [0, n] if n <= capacity else [0, *([n % capacity] if n % capacity else []), *range(n % capacity + capacity, n + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed) == want
    by = defaultdict(list)
    for r in placed:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_documents_are_packed_tightly(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    placed = packing.packed(docs, PATH).collect()
    used = check([(r.doc_id, r.text) for r in docs.collect()], placed)
    assert used <= -(-sum(r.length for r in placed) // 2048) + 1


def test_nulls_ties_repeats_and_a_long_text(documents):
    rows = [(1, None), (1, None), (None, "a b"), (2, ""), (3, "word " * 9000), (3, "word " * 9000), (4, "x y z")] + [(i, "tie tie") for i in range(10, 60)]
    check(rows, packing.packed(documents(rows), PATH).collect())
    assert packing.packed(documents([]), PATH).count() == 0


def test_a_common_length_is_numbered_in_parts(documents, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    rows = [(i, "one two three") for i in range(200)] + [(1000 + i, "w " * i) for i in range(40)]
    check(rows, packing.packed(documents(rows), PATH, 16).collect(), 16)


def test_sequences_hold_the_ids(documents):
    rows = [(i, "some words here " * i) for i in range(30)]
    got = packing.sequences(documents(rows), PATH, 64).collect()
    assert all(0 < len(r.ids) <= 64 for r in got)
    whole = Tokenizer.from_file(PATH)
    assert sum(len(r.ids) for r in got) == sum(len(whole.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)


def least_bins(sizes, capacity):
    """Branch and bound over all packings."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        bins.append(sizes[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_fixed_sets_never_cost_a_sequence():
    rnd = random.Random(5)
    for _ in range(300):
        capacity = rnd.randint(8, 30)
        sizes = sorted((rnd.randint(1, capacity) for _ in range(rnd.randint(1, 9))), reverse=True)
        instance = packing.Instance(capacity, dict(Counter(sizes)))
        fixed = packing.reduce(instance)
        left = [k for k, n in instance.left.items() for _ in range(n)]
        assert sum(p.count for p in fixed) + least_bins(sorted(left, reverse=True), capacity) == least_bins(sizes, capacity), (capacity, sizes)
        patterns = fixed + packing.best_fit(instance)
        assert Counter(k for p in patterns for k in p.lengths for _ in range(p.count)) == Counter(sizes)
        assert all(sum(p.lengths) <= capacity and p.count > 0 for p in patterns)
