"""The registered queries against SQL, and the pipeline stage by stage."""

from __future__ import annotations

import pytest

import corpus_pipeline
from measurelake.llm import queries, sql
from verify_oracle import compare, connect, run_spark, run_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(sql.all_sql()))
def test_equals_sql(spark, con, name):
    ours = run_spark(queries.all_queries()[name](spark, SF))
    problem = compare(ours, run_sql(con, sql.all_sql()[name]))
    assert problem is None, problem


def test_entry_has_all_queries():
    from __spark_entry__ import oracle_sql, queries as registered

    found = set(registered())
    assert {n.split("_")[0] for n in found if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in found and set(oracle_sql()) <= found


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(number)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(number)))
        if number < 4:
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert docs.select("doc_id").distinct().count() == before.count()
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_rows_with_null_and_equal_ids_are_judged_one_by_one(spark):
    words = [" ".join(f"{w}{i}" for i in range(70)) for w in ("apple", "brick", "cloud", "drift", "ember")]
    a, b, c, d, e = words
    schema = "doc_id long, text string, source string, lang string"

    def stage(run, rows):
        docs = spark.createDataFrame([(*r, "s", "en") for r in rows], schema)
        out = run(spark, docs, SF)
        assert out.columns == docs.columns
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)

    # Rejected rows go, null id or not; a sound row of the same id stays.
    got = stage(corpus_pipeline.reject_low_quality, [(None, "few"), (None, a), (-5, "few words"), (-5, b), (-6, c)])
    assert (None, "few") not in got and (-5, "few words") not in got
    assert {(None, a), (-5, b), (-6, c)} <= set(got)
    # A repeated line of one row takes no line of another with its id.
    got = stage(corpus_pipeline.drop_repeated_lines,
                [(None, f"{a}\n{b}"), (None, f"{c}\n{b}"), (None, f"{d}\n{e}"), (7, "x1\nlong tail of seven"), (7, f"{a}\nsome other tail"), (7, a)])
    texts = [t for _, t in got]
    assert f"{d}\n{e}" in texts and (7, "x1\nlong tail of seven") in got and (7, "some other tail") in got
    assert sum(t.count(b) for t in texts) == 1 and sum(t.count(a) for t in texts) == 1 and len(got) == 5
    # Equal rows leave one, near copies too; different texts of one id all stay.
    near = b.replace("brick30", "other")
    got = stage(corpus_pipeline.drop_near_duplicates,
                [(3, a), (3, a), (None, a), (None, b), (None, b), (None, near), (9, c), (9, d), (5, d), (None, e), (None, None)])
    assert sum(t in (b, near) for _, t in got) == 1 and (None, None) in got
    assert [x for x in got if x[1] not in (b, near)] == sorted([(3, a), (9, c), (5, d), (None, e), (None, None)], key=str)
