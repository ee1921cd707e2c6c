import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from slopeweave.llm import alignment, queries

A, B = (public_tokenizers.path(n) for n in (queries.TOKENIZER, queries.PIECES))
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum"]


def plain(rows):
    """Every offset is looked at, and every link is counted by itself."""
    whole, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    whole.encode_special_tokens = True
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    found = []
    for doc, text in rows:
        enc = whole.encode(" " + (text or ""), add_special_tokens=False)
        a = [(i, bytes(byte[c] for c in t)) for i, t in zip(enc.ids, enc.tokens)]
        b = [(i, bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()) for i in model.encode(text or "")]
        want = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            found.append((doc, 0, 0, [], []))
            continue
        groups, links, ia, ib, ea, eb, sa, sb = [], [], 0, 0, 0, 0, [], []
        for end in range(1, len(want) + 1):
            done_a = ea + len(a[ia][1]) == end
            done_b = eb + len(b[ib][1]) == end
            if done_a:
                sa.append(a[ia][0]); ia += 1; ea = end
            if done_b:
                sb.append(b[ib][0]); ib += 1; eb = end
            if done_a and done_b:
                links.append((sa[-1], sb[-1]))
                groups.append(",".join(map(str, sa)) + "|" + ",".join(map(str, sb)))
                sa, sb = [], []
        found.append((doc, len(a), len(b), groups, links))
    counts = Counter(p for *_, links in found for p in links)
    most = Counter()
    for (x, y), n in counts.items():
        most[y] = max(most[y], n)
    return Counter((doc, na, nb, len(g), ";".join(g), len(ls), sum(counts[p] == most[p[1]] for p in ls), sum(counts[p] for p in ls)) for doc, na, nb, g, ls in found)


def test_the_whole_table_against_every_offset(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = alignment.with_counts(alignment.align(docs, A, B)).select(*COLUMNS).collect()
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert Counter(map(tuple, got)) == want
    out = queries.op11_alignment(spark, data).collect()
    sha = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    assert {(r.doc_id, r.groups_sha256, r.count_sum) for r in out} == {(w[0], sha(w[4]), w[7]) for w in want}


@pytest.mark.parametrize("shard", [200, alignment.SHARD_TEXT])
def test_odd_texts(spark, documents, monkeypatch, shard):
    monkeypatch.setattr(alignment, "SHARD_TEXT", shard)
    texts = [None, "", " ", "  two  spaces ", "tab\tand\nline\r\n", "a<|endoftext|>b <s> </s> <unk> <0x41>", "x▁y", "é ü ﬁ Ａ 日本語 🎉🎉", "\x00nul", "tie", "tie",
             "word " * 30_000, "a" * 50_000, "  x", "don't we'll 1234 ...", " lead"]
    rows = list(enumerate(texts)) + [(3, "tie"), (None, "no id")]
    got = alignment.with_counts(alignment.align(documents(rows), A, B)).select(*COLUMNS).collect()
    assert Counter(map(tuple, got)) == plain(rows)


def test_text_that_is_not_utf8_has_no_tokens(spark):
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("cast(X'61FF62' AS STRING)").alias("text"))
    got = alignment.with_counts(alignment.align(docs, A, B)).first()
    assert (got.n_a, got.n_b, got.n_groups, got.n_links, got.count_sum, got.groups) == (0, 0, 0, 0, 0, "")


def test_no_rows_and_other_columns(spark, documents):
    assert alignment.with_counts(alignment.align(documents([]), A, B)).count() == 0
    kept = alignment.with_counts(alignment.align(documents([(1, "a b")]), A, B).withColumn("note", F.lit("n"))).first()
    assert kept.note == "n" and kept.n_links == 2
