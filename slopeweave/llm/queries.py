"""The operators applied to the tables, with the SQL that checks them where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from slopeweave.llm import alignment, crossentropy, egojoin, exact, language, licenses, packing, phrases, resampling, simhash, suffixes, toxicity, urls
from slopeweave.llm.shards import crc_mod

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
# The given rules and their verdicts.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    """Learned from the labelled documents outside the fold that is held out."""
    learn = table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 4) != 2)
    return toxicity.train(table(spark, sf_dir, "documents"), learn)


@query()
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (F.coalesce(crc_mod("doc_id", 4), F.lit(0)) == 2).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query()
def op2_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query()
def op3_lm_scoring(spark, sf_dir):
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return crossentropy.differences(table(spark, sf_dir, "documents"), good)


@query()
def op4_licenses(spark, sf_dir):
    """The documents as files: a directory of each source holds a hundred of them, every tenth of which is a license file."""
    place = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000), F.pmod(F.floor(F.col("doc_id") / 100), F.lit(10)))
    name = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs.select("doc_id", F.concat(place, F.lit("/"), name).alias("path"), "text"))


@query()
def op5_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.filter(crc_mod("doc_id", 3) != 1))
    return language.identify(docs, model).select(
        "doc_id", (F.coalesce(crc_mod("doc_id", 3), F.lit(0)) == 1).alias("held_out"), "lang_pred", "score", "rejected")


# A window of an item is its word list joined by single spaces, and so are the documents; with a space at either end, windows are found as text.
@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     win AS (SELECT DISTINCT item_id, w[i:i + least(10, len(w)) - 1] AS win
             FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT len(win) AS n FROM win),
     dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
     occ AS (SELECT dp.doc_id, dp.i, sizes.n, win.item_id FROM dp, sizes, win
             WHERE dp.i + sizes.n - 1 <= len(dp.w) AND dp.w[dp.i:dp.i + sizes.n - 1] = win.win),
     hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
     its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
             FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""")
def op6_decontamination(spark, sf_dir):
    found = suffixes.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


@query()
def op7_urls(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


@query("""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""")
def op8_exact_dedup(spark, sf_dir):
    return exact.groups(table(spark, sf_dir, "documents"))


@query()
def op9_simhash(spark, sf_dir):
    rows = simhash.grouped(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op10_resampling(spark, sf_dir):
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return resampling.resample(table(spark, sf_dir, "documents"), good)


@query()
def op11_alignment(spark, sf_dir):
    aligned = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    return alignment.with_counts(aligned.withColumn("groups_sha256", digest).drop("groups"))


@query(r"""
WITH w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
             SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                          '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
     totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
     spans AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) s(k)),
     f AS (SELECT lang, phrase, k, count(*) AS a FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM spans) GROUP BY ALL HAVING count(*) >= 10),
     c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
     cuts AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, cut.k, (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.a AS HUGEINT) * y.a) AS score
              FROM c JOIN (VALUES (1), (2)) cut(k) ON cut.k < c.k
              JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut.k], ' ')
              JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut.k + 1:], ' ')),
     scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
     longer AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
     kept AS (SELECT s.* FROM scored s LEFT JOIN longer g USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000""")
def op12_phrases(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query()
def op13_embeddings(spark, sf_dir):
    return egojoin.near_duplicates(table(spark, sf_dir, "embeddings"))
