"""Toxicity, language identification and resampling: held-out accuracy and plain recounts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopeweave.llm import language, queries, resampling, toxicity
from slopeweave.llm.shards import char_grams

DATA = "/root/testdata/sf0.1"
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@pytest.fixture(scope="module")
def model(spark):
    return queries.toxicity_model(spark, DATA)


def test_toxicity_on_held_out_labels(spark, model):
    docs = queries.table(spark, DATA, "documents")
    got = (toxicity.score(docs, model).join(queries.table(spark, DATA, "labels"), "doc_id")
           .filter("crc32(cast(doc_id as string)) % 4 = 2").select("score", "toxic").toPandas())
    said = got["score"] >= toxicity.THRESHOLD
    right = said == (got["toxic"] == 1)
    order = got["score"].rank()
    ones = got["toxic"] == 1
    auc = (order[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    print("accuracy", right.mean(), "auc", auc, "precision", ones[said].mean(), "recall", said[ones].mean())
    assert right.mean() > 0.93 and auc > 0.78 and ones[said].mean() > 0.85


def test_toxicity_ratios_and_scores_recounted(spark, documents):
    """Ratios and scores from the n-grams themselves, as strings, and the fit against a plain descent."""
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["ab", "Ba", "ü", "日本", "cd" if i % 3 else "bad"]) for _ in range(rnd.randint(0, 9)))) for i in range(90)] + [(90, ""), (91, "x")]
    toxic = {i: int(i % 3 == 0) for i, _ in rows}
    model_ = toxicity.train(documents(rows), spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int"))
    grams = lambda t: {f" {t.lower()} "[i:i + n] for n in (3, 4, 5) for i in range(len(t) + 3 - n)}
    bucket = lambda g: int(char_grams(g[1:-1].encode(), range(len(g), len(g) + 1), toxicity.BITS)[0]) if g[0] == g[-1] == " " else None
    at = {}
    for _, t in rows:
        for n in (3, 4, 5):
            padded = f" {t.lower()} "
            for i, b in enumerate(char_grams(t.encode(), range(n, n + 1), toxicity.BITS).tolist()):
                assert at.setdefault(padded[i:i + n], b) == b
    assert len(set(at.values())) == len(at) and all(bucket(g) in (None, b) for g, b in at.items())
    n1, n0 = sum(toxic.values()), len(toxic) - sum(toxic.values())
    seen = {g: Counter(toxic[i] for i, t in rows if g in grams(t)) for g in at}
    ratio = {g: math.log((c[1] + 1) / (n1 + 2)) - math.log((c[0] + 1) / (n0 + 2)) for g, c in seen.items()}
    assert all(model_.ratios[b] == pytest.approx(ratio[g], abs=1e-5) for g, b in at.items())
    got = {r.doc_id: r.score for r in toxicity.score(documents(rows), model_).collect()}
    for i, t in rows:
        margin = sum(float(model_.weights[at[g]]) for g in grams(t)) + model_.intercept
        assert got[i] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-5)
    names = sorted(at)
    x = np.array([[ratio[g] * (g in grams(t)) for g in names] for _, t in rows])
    y = np.array([toxic[i] for i, _ in rows], float)
    loss = lambda w, b: np.logaddexp(0, (1 - 2 * y) * (x @ w + b)).mean() + toxicity.PENALTY * np.abs(w).sum()
    w, b, step = np.zeros(len(names)), 0.0, 4 * len(y) / (np.linalg.norm(x, 2) ** 2 + len(y))
    for _ in range(30_000):
        e = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        w, b = w - step * (x.T @ e), b - step * e.sum()
        w = np.sign(w) * np.maximum(np.abs(w) - step * toxicity.PENALTY, 0)
    fitted = np.array([float(model_.weights[at[g]]) / ratio[g] for g in names])
    assert loss(fitted, model_.intercept) < loss(w, b) + 2e-3


def test_toxic_words_are_caught_and_clean_texts_kept(spark, model, documents):
    labelled = queries.table(spark, DATA, "documents").join(queries.table(spark, DATA, "labels").filter("toxic = 0"), "doc_id")
    clean = [(r.doc_id, r.text) for r in labelled.orderBy("doc_id").limit(400).collect()]
    dirty = [(10_000 + i, t + " You stupid IDIOT, pathetic worthless scum.") for i, t in clean]
    docs = documents(clean + dirty + [(1, None), (None, ""), (3, "idiot " * 200_000)])
    got = toxicity.keep_harmless(docs, model)
    assert got.columns == docs.columns
    kept = [r.doc_id for r in got.select("doc_id").collect()]
    assert sum(k is not None and k >= 10_000 for k in kept) <= 0.02 * len(dirty)
    assert len({k for k in kept if k is not None and k < 10_000}) >= 0.97 * len({i for i, _ in clean}) and None in kept
    assert toxicity.score(documents([]), model).count() == 0


def test_toxicity_of_one_class_and_of_nothing(spark, documents):
    docs = documents([(1, "a b c"), (2, "d")])
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    for rows, share in (([], 0), ([(1, 0), (None, 1), (2, None)], 0), ([(1, 1)], 1)):
        assert {round(r.score, 6) for r in toxicity.score(docs, toxicity.train(docs, labels(rows))).collect()} == {share}
    two = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels([(1, 0), (2, 1)]))).collect()}
    assert two[1] < 0.1 and two[2] > 0.9


def test_language_on_held_out_documents(spark):
    got = queries.op5_language(spark, DATA).join(queries.table(spark, DATA, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.98 and got["score"].between(0, 1).all() and len(got) == 10_000
    assert 0 < got["rejected"].mean() < 0.05


def test_language_of_odd_rows(documents):
    learn = [(i, t, lang) for i in range(40) for t, lang in ((f"the and of with {i}", "en"), (f"der die das und {i}", "de"))] + [(None, "the", "en"), (1, None, "en"), (1, "x", None)]
    found = language.train(documents(learn))
    assert sorted(set(found.languages)) == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "123 !"), (4, "und das"), (4, "und das"), (None, "with the"), (5, "of " * 400_000), (6, "Ж")]
    got = {(r.doc_id, r.lang_pred) for r in language.identify(documents(rows), found).collect()}
    assert got >= {(1, "und"), (2, "und"), (3, "und"), (4, "de"), (None, "en"), (5, "en")} and ("und" not in {l for d, l in got if d == 6})
    nothing = language.train(documents([]))
    assert {r.lang_pred for r in language.identify(documents(rows), nothing).collect()} == {"und"}
    far = language.identify(documents([(1, "zzqqxx jjkkyy")]), found).first()
    assert far.rejected


def test_resampling_against_a_recount(spark, documents):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(UP, LOW)))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [
        (None, "good words"), (5000, None), (5001, ""), (5002, "Tie"), (5002, "Tie")]
    good = {i for i, _ in rows if i is not None and i % 3 == 0}
    raw, wanted = Counter(), Counter()
    grams = lambda t: [*((w,) for w in cut(t)), *zip(cut(t), cut(t)[1:])]
    bucket = {}

    def of(gram):  # the operator's bucket of a word or a pair
        if gram not in bucket:
            at, _ = resampling._buckets([" ".join(gram).encode()])
            bucket[gram] = int(at[-1])
        return bucket[gram]

    for i, t in rows:
        for g in grams(t):
            raw[of(g)] += 1
            wanted[of(g)] += i in good
    n = 1 << resampling.BITS
    ratio = {b: math.log((wanted[b] + 1) / (sum(wanted.values()) + n)) - math.log((raw[b] + 1) / (sum(raw.values()) + n)) for b in raw}
    want = sorted((str(i), round(sum(ratio[of(g)] for g in grams(t)), 6)) for i, t in rows)
    docs = documents(rows)
    got = resampling.resample(docs, spark.createDataFrame([(i,) for i in good], "doc_id long"), share=0.3).toPandas()
    assert [(i, pytest.approx(w, abs=1e-5)) for i, w in want] == sorted((str(None if np.isnan(i) else int(i)), round(w, 6)) for i, w in zip(got["doc_id"], got["log_weight"]))
    assert got["selected"].sum() == math.ceil(0.3 * len(rows))
    assert got[got["selected"]]["key"].min() >= got[~got["selected"]]["key"].max()
    assert set(np.round(got["key"] - got["log_weight"], 9)) and resampling.resample(documents([]), spark.createDataFrame([], "doc_id long")).count() == 0


def test_gumbel_keys_follow_the_weights(spark, documents):
    """Twice the weight, some twice as often first."""
    ids = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit(math.log(4.0))).otherwise(0.0).alias("log_weight"))
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(42)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    top = ids.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))).orderBy(F.desc("key")).limit(400).toPandas()
    assert 0.74 < (top["doc_id"] % 2 == 0).mean() < 0.84


def test_toxicity_sends_few_gradients(spark, monkeypatch):
    """However small the pieces that Spark reads the rows of the fit in, a step sends a row for each of FIT_PARTS tasks at most."""
    rows = [([i % 7, 7 + i % 5], int(i % 3 == 0)) for i in range(60)]
    seen = spark.createDataFrame(rows, "grams array<int>, toxic int").repartition(40)
    sent, whole = [], type(seen).toArrow
    monkeypatch.setattr(type(seen), "toArrow", lambda df: sent.append(whole(df)) or sent[-1])
    loss, gradient, by_intercept = toxicity._loss(seen, np.zeros(12, np.float32), 0.0)
    assert seen.rdd.getNumPartitions() == 40 and sent[0].num_rows <= toxicity.FIT_PARTS
    want = np.zeros(12)
    for grams, toxic in rows:
        want[grams] += (0.5 - toxic) / len(rows)
    assert loss == pytest.approx(math.log(2)) and gradient == pytest.approx(want, abs=1e-6) and by_intercept == pytest.approx(0.5 - 20 / 60)
