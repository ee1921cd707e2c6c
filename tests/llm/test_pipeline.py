import subprocess
import sys

import corpus_pipeline
from pyspark.sql import functions as F

import test_packing
import test_simhash
import test_suffixes
from slopeweave.llm import toxicity
from slopeweave.llm.queries import table, toxicity_model

ROOT = __file__.rsplit("/tests/", 1)[0]


def test_stages_against_plain_versions(spark, data, tmp_path):
    """Each stage on its own input: what the plain version of its rule keeps, whole rows and no others."""
    docs = table(spark, data, "documents")
    columns = docs.columns
    model = toxicity_model(spark, data)
    items = [(r.item_id, r.text) for r in table(spark, data, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "toxicity":
            want = {r.doc_id for r in toxicity.score(docs, model).filter(F.col("score") < 0.3).collect()}
        elif name == "exact dedup":
            lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
            want = set({lower(t): d for d, t in sorted(rows)}.values())
        elif name == "SimHash near-dedup":
            want = {c for _, _, c in test_simhash.plain(rows)}
        elif name == "benchmark decontamination":
            want = {d for d, *_, bad in test_suffixes.plain(rows, items) if not bad}
        else:
            test_packing.check(rows, out.collect())
            break
        assert out.columns == columns and sorted(r.doc_id for r in out.collect()) == sorted(want)
        assert out.join(docs, columns, "left_anti").count() == 0
        docs = out
    assert corpus_pipeline.run(spark, data).count() == out.count()


def test_the_rest_imports_without_this_part(tmp_path):
    for name in ("slopeweave", "checks", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{ROOT}/{name}", str(tmp_path)], check=True)
    subprocess.run(["mv", f"{tmp_path}/slopeweave/llm", f"{tmp_path}/away"], check=True)
    got = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"],
                         cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, capture_output=True, text=True, check=True).stdout.split()
    assert int(got[0]) > 70 and got[1:] == ["False", "True"]
