import hashlib

from hypothesis import HealthCheck, given, settings, strategies as st

from slopeweave.llm import exact

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def expected(rows):
    norm = [(i, (t or "").translate(str.maketrans(UP, LOW))) for i, t in rows]
    by = {}
    for i, t in norm:
        by.setdefault(t, []).append(i)
    best = {t: max([i for i in ids if i is not None], default=None) for t, ids in by.items()}
    return sorted(((i, best[t], len(by[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm), key=str), len(by)


def check(df, rows):
    got = exact.groups(df).collect()
    want, n = expected(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == n and all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact.distinct_texts(df)
    assert kept.columns == df.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) != [] or not rows
    assert kept.count() == n


def test_case_nulls_empty_and_accents(documents):
    rows = [(1, "Abc"), (2, "aBC"), (3, "ÀB"), (4, "àb"), (5, None), (6, ""), (None, "abc"), (7, "x"), (7, "x"), (None, "q"), (None, "q"), (8, "É a"), (9, "É A")]
    check(documents(rows), rows)


def test_empty_table(documents):
    assert exact.groups(documents([])).count() == 0 and exact.distinct_texts(documents([])).count() == 0


def test_one_group_of_most_rows_is_split(documents):
    """A third of all rows share one text, others only its start and length."""
    rows = [(i, "same text " * 30) for i in range(400)] + [(400 + i, "same text " * 29 + f"{i:010d}") for i in range(300)] + [
        (1000 + i, f"text {i}") for i in range(500)]
    check(documents(rows, 7), rows)


def test_very_long_texts(documents):
    long = "wörd " * 300_000
    rows = [(1, long), (2, long.upper().replace("Ö", "ö")), (3, long + "x")]
    check(documents(rows), rows)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 9)), st.one_of(st.none(), st.text("aAbBéÉ", max_size=2))), max_size=30))
def test_random_rows(documents, rows):
    check(documents(rows), rows)


def test_copies_that_make_a_small_file_are_not_broadcast(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "CASE WHEN id % 4 > 0 THEN repeat('Copy ', 500) ELSE concat('one ', id) END AS text")
    found = exact.groups(docs)
    rows = found.collect()
    assert len(rows) == 2000 and sum(r["kept"] for r in rows) == 501 and max(r["group_size"] for r in rows) == 1500
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "salt#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
