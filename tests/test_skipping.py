"""Row groups and files that a question does not touch are not read."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from measurelake.model import ColumnMap, FilterState
from measurelake.operators import cleanup, filters
from measurelake.sources import readers, skipping, writers

PLAIN = ColumnMap(**{n: n for n in ColumnMap().pairs()})


@pytest.fixture(scope="module")
def cleaned(spark):
    """60,000 readings; one state has a third of them, and one has no name."""
    i = F.col("id")
    raw = spark.range(60_000).select(
        F.when(i % 3 == 0, "Hot").when(i % 29 == 1, None).otherwise(F.concat(F.lit("S"), (i % 10).cast("string"))).alias("state_name"),
        F.concat(F.lit("County "), (i % 40).cast("string")).alias("county_name"),
        F.date_add(F.lit(date(2024, 1, 1)), (i % 365).cast("int")).alias("date_local"),
        F.concat(F.lit("Site#"), F.lpad((i % 500).cast("string"), 5, "0")).alias("site_name"),
        F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), F.lit("24 HOUR").alias("sample_duration"),
        F.lit("P").alias("pollutant_standard"), F.lit(99.0).alias("observation_percent"),
        (i % 200 * 0.25).alias("pm25_raw"), (i % 300).alias("aqi_raw"))
    return writers.settle(cleanup.clean(raw), "cleaned")


def scanned(df):
    """Rows that the scan has given on, after row groups and pages were left out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    return plan.metrics().apply("numOutputRows").value()


def plain(df):
    return sorted(map(str, df.collect()))


def test_a_state_and_a_period_read_a_fraction(spark, cleaned, tmp_path):
    path = skipping.write_clustered(cleaned, str(tmp_path / "c"), row_group_bytes=64 << 10)
    stored = readers.read_parquet(spark, path)
    assert stored.count() == 60_000
    for state, share in (("S5", 0.2), ("Hot", 0.2)):
        selection = FilterState((state,), date(2024, 3, 1), date(2024, 3, 31))
        found = filters.apply_filter(stored, selection)
        assert plain(found) == plain(filters.apply_filter(cleaned, selection))
        assert scanned(found) < share * 60_000
    plain_path = writers.write_parquet(cleaned, str(tmp_path / "p"))
    selection = FilterState(("S5",), date(2024, 3, 1), date(2024, 3, 31))
    assert scanned(filters.apply_filter(spark.read.parquet(plain_path), selection)) > 0.5 * 60_000


def test_names_in_no_order_have_bloom_filters(spark, cleaned, tmp_path):
    path = skipping.write_clustered(cleaned, str(tmp_path / "c"), PLAIN, row_group_bytes=64 << 10)
    assert scanned(spark.read.parquet(path).where("site_name = 'Site#00123x'")) == 0
    assert spark.read.parquet(path).where("site_name = 'Site#00123'").count() == 120


def test_equal_rows_are_dealt_out(spark, cleaned, tmp_path):
    same = cleaned.withColumns({"state_name": F.lit("A"), "date_local": F.lit(date(2024, 1, 1)), "site_name": F.lit("s")})
    path = skipping.write_clustered(same, str(tmp_path / "c"))
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 60_000 and (len(sizes) == 1 or max(sizes) < 45_000)


@pytest.fixture(scope="module")
def words(spark, tmp_path_factory):
    """A table of four files with odd spellings, and its index."""
    folder = tmp_path_factory.mktemp("words")
    cells = ["Near Road", "near  road", "ROAD", "straße", "ΟΔΟΣ", "K", "ſhip", "a\tb", None, "", "x.y", "100.0", "Roadside near"]
    rows = [(i, c, c if i % 2 else None) for i, c in enumerate(cells)]
    for i in range(4):
        spark.createDataFrame(rows[i::4], "n int, a string, b string").coalesce(1).write.mode("append").parquet(str(folder / "t"))
    index = skipping.write_token_index(spark, str(folder / "t"), str(folder / "i"))
    return str(folder / "t"), index


@pytest.mark.parametrize("term", [
    "road", "ROAD", "near road", "r r", "STRASSE", "straße", "οδος", "σ", "k", "ship", "S", "a\tb", " ", "", ".", "x.y",
    "0.0", "12", "nothing", "(", "near  road"])
def test_the_same_rows_as_a_full_search(spark, words, term):
    table, index = words
    want = plain(filters.search(spark.read.parquet(table), term, literal=True))
    assert plain(skipping.search_indexed(spark, table, index, term)) == want


def test_the_index_folds_distinct_values_only(spark, cleaned, tmp_path, monkeypatch):
    path = writers.write_parquet(cleaned, str(tmp_path / "t"))
    written, real = [], skipping.write_parquet
    monkeypatch.setattr(skipping, "write_parquet", lambda df, *a, **k: written.append(df) or real(df, *a, **k))
    skipping.write_token_index(spark, path, str(tmp_path / "i"))
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    branches = plan.split("Generate explode")[1:]
    assert len(branches) == len(cleaned.columns) and all("Aggregate" in b for b in branches)


def test_the_index_has_the_words_of_every_type(spark, tmp_path):
    rows = spark.sql("""
        SELECT -0D AS a, float('nan') AS b, 1.50BD AS c, true AS d, date'2024-01-02' AS e, ' Zwei  Worte' AS f,
               array(1, 2) AS g, 7Y AS h, binary('q r') AS i, timestamp'2024-01-02 03:04:05' AS j
        UNION ALL SELECT 0D, null, null, false, null, 'zwei', null, null, null, null""")
    path = writers.write_parquet(rows.coalesce(1), str(tmp_path / "t"))
    told = spark.read.parquet(skipping.write_token_index(spark, path, str(tmp_path / "i")))
    words = sorted(r.token for r in told.collect())
    assert words == sorted(["-0.0", "0.0", "nan", "1.50", "true", "false", "2024-01-02", "", "zwei", "worte", "[1,", "2]",
                            "7", "q", "r", "03:04:05"])


def test_files_without_the_word_are_not_read(spark, words):
    table, index = words
    assert len(skipping.search_indexed(spark, table, index, "x.y").inputFiles()) == 1
    assert skipping.search_indexed(spark, table, index, "nothing").count() == 0
    assert skipping.files_with(spark.read.parquet(index), "nothing").count() == 0


def test_files_that_the_index_does_not_know_are_searched(spark, words, tmp_path):
    table, _ = words
    rows = spark.read.parquet(table)
    rows.write.parquet(str(tmp_path / "t"))
    index = skipping.write_token_index(spark, str(tmp_path / "t"), str(tmp_path / "i"))
    spark.createDataFrame([(99, "late word", None)], rows.schema).write.mode("append").parquet(str(tmp_path / "t"))
    assert [r.n for r in skipping.search_indexed(spark, str(tmp_path / "t"), index, "late word").collect()] == [99]


def test_month_folders_are_searched(spark, cleaned, tmp_path):
    few = cleaned.where((F.dayofmonth("date_local") == 3) & (F.col("date_local") < date(2024, 4, 1) + timedelta(0)))
    path = writers.write_parquet(few, str(tmp_path / "t"), "date_local")
    index = skipping.write_token_index(spark, path, str(tmp_path / "i"))
    found = skipping.search_indexed(spark, path, index, "2024-02")
    assert plain(found) == plain(filters.search(spark.read.parquet(path), "2024-02", literal=True)) and found.count()
