import io
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldlark.operators import filters, mutate, ranking, results
from fieldlark.plans.spec import QuerySpec, SpecError
from fieldlark.sources import files
from fieldlark.sources.tables import Store
from fieldlark.streaming import ingest


def test_points(spark, tmp_path):
    (tmp_path / "p.csv").write_text("﻿Latitude, Longitude ,Year,Site\n 1.5 ,2,2000,a\n3,4,2001,b\n")
    df = files.read_points(spark, str(tmp_path / "p.csv"))
    assert df.where("Latitude = 1.5 and Year = 2000").count() == 1 and "Site" in df.columns
    assert files.read_points(spark, str(tmp_path / "p.csv"), 1).count() == 1
    (tmp_path / "q.csv").write_text("Latitude,Year\n1,2\n")
    with pytest.raises(files.SourceError, match="Longitude"):
        files.read_points(spark, str(tmp_path / "q.csv"))


def test_dataset_table(spark, tmp_path):
    head = "Dataset ID,Band Name,Spatiotemporal Aggregation Function,Pixel Value Transform\n"
    (tmp_path / "d.csv").write_text(head + 'A,b,"spatial_mean(0;years_mean(-1,0))",n/a\n')
    assert files.read_dataset_table(spark, str(tmp_path / "d.csv")).count() == 1
    (tmp_path / "e.csv").write_text(head + "A,b,nothing(1),n/a\n")
    with pytest.raises(ValueError):
        files.read_dataset_table(spark, str(tmp_path / "e.csv"))


def test_lists(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# c\n\n a \nb:c\nd,e\n")
    assert [r.value for r in files.read_list(spark, str(tmp_path / "l.txt")).collect()] == ["a", "b:c", "d,e"]
    with pytest.raises(PySparkException):
        files.read_corrections(spark, str(tmp_path / "l.txt")).collect()


def test_csv_and_zip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b,c', None)], "id int, t string, m string")
    out = io.StringIO()
    assert files.stream_csv(df, out, "None", bom=True) == 1
    assert out.getvalue() == '﻿id,t,m\r\n1,"a""b,c",None\r\n'
    files.write_zip({"samples.csv": df, "studies.csv": df.limit(0)}, str(tmp_path / "x.zip"))
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        assert z.read("studies.csv").decode() == "id,t,m\r\n"
    files.write_csv(df, str(tmp_path / "csv"), quote_all=True)
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').first().t == 'a"b,c'


def test_numeric_if_all(spark):
    df = spark.createDataFrame([("1", "1"), (" 2 ", "x")], "a string, b string")
    kinds = dict(files.numeric_if_all(files.numeric_if_all(df, "a"), "b").dtypes)
    assert kinds == {"a": "double", "b": "string"}


def test_unknown_covariate(spark, sf_dir):
    store = Store(spark, sf_dir)
    spec = QuerySpec(covariates=(("Nope", ("x",)),))
    assert filters.apply_spec(store, spec).count() == filters.base_fact(store).count()
    with pytest.raises(SpecError):
        filters.apply_spec(store, spec, strict=True)


def test_thresholds_are_semi_joins(spark, sf_dir):
    plan = filters.apply_spec(Store(spark, sf_dir), QuerySpec(min_years=2, country="NATION_3"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 3


def test_last_duplicate_wins(spark, sf_dir):
    value = spark.createDataFrame([(3, "F", None, 1, 1), (3, "P", None, 1, 2)], "covariate_defn_id int, value string, study_id long, sample_id long, id_key long")
    store = Store(spark, sf_dir, {"covariate_value": value})
    assert results.pivot_covariates(store, "sample_id", ["Status"]).first().Status == "P"


def test_columns_in_order():
    got = results.column_order(["b", "a"], {"a": 1.0, "b": 0.5}, results.SAMPLE_COLUMNS)
    assert got == ["row_number", "study_id", "observation", "latitude", "longitude", "b", "a"]


def test_votes(spark):
    rows = spark.createDataFrame([(1, "Larvae, adults"), (1, "larvae!"), (1, "UNKNOWN"), (2, "UNKNOWN"), (2, "FAILED")], "q int, answer string")
    both = ranking.consolidate(rows, ["q"])
    ranked = {r.q: r.ranked for r in ranking.vote_rank(both, rows, ["q"]).collect()}
    assert ranked[1].startswith("larvae (2)") and ranked[2] == "unknown (1)"


def test_purge_keeps_others(spark, sf_dir):
    store = Store(spark, sf_dir)
    left, counts = mutate.purge(store, spark.createDataFrame([("NATION_1",)], "name string"))
    assert {r.table_name: r.deleted for r in counts.collect()}["species"] == 1
    assert left["species"].count() == store.species.count() - 1


def test_appended_answers(spark):
    schema = "id long, question_link_id long, answer_text string, context string"
    have = spark.createDataFrame([(7, 1, "a", "c")], schema)
    got = mutate.append_answers(have, spark.createDataFrame([(2, "b", None), (3, "d", "e")], "question_link_id long, answer_text string, context string")).collect()
    assert len({r.id for r in got}) == 3 and min(r.id for r in got if r.id != 7) > 7 and {r.context for r in got} == {"c", "", "e"}


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, text string").write.parquet(src)
    for _ in range(2):  # the second run finds nothing new
        ingest.run_ingest(ingest.read_pages(spark, src, "id long, text string"), out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([(4, "b"), (5, "c")], "id long, text string").write.mode("append").parquet(src)
    ingest.run_ingest(ingest.read_pages(spark, src, "id long, text string"), out, str(tmp_path / "cp")).awaitTermination()
    assert {r.text for r in spark.read.parquet(out).select("text").collect()} == {"a", "b", "c"}


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    write, out = ingest.append_batch(str(tmp_path / "t")), str(tmp_path / "t")
    first, second = spark.range(3), spark.range(3, 5)
    for batch, number in ((first, 0), (second, 1), (second, 1), (first, 0)):
        write(batch, number)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "v")
    assert files.versions(spark, folder) == []
    assert [files.write_version(spark.range(n), folder) for n in (1, 2)] == [1, 2]
    (tmp_path / "v" / "v=3").mkdir()  # a write that broke off
    assert files.read_version(spark, folder).count() == 2 and files.read_version(spark, folder, 1).count() == 1


def test_organic(spark):
    rows = [(1, "organic", i, f"u{i}") for i in range(12)] + [(1, "ad", 0, "x")]
    df = files.organic(spark.createDataFrame(rows, "question_id long, type string, position int, url string"))
    assert df.count() == 10 and df.where(F.col("type") == "ad").count() == 0
