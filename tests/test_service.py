import random
import zipfile

import pytest

from fieldlark import cli
from fieldlark.plans.expr import ExprError
from fieldlark.plans import raster
from fieldlark.plans.expr import parse
from fieldlark.plans.extract import Extraction, check_form, check_stat, extract
from fieldlark.service import ObservationService, missing_point_columns, query_id
from fieldlark.sources.tables import Store

FORM = {"covariate": ["Status"], "values": ["F"], "valueCounts": ["1"], "yearRange": "1995-1999"}


@pytest.fixture
def service(spark, sf_dir):
    return ObservationService(Store(spark, sf_dir))


def test_counts_and_pages(service):
    n = service.n_samples(FORM)
    assert n["filter_text"] == "Status(1) = F\nyears in {1995-1999}\n"
    key = service.process_query(FORM)
    assert key == query_id(dict(reversed(FORM.items())))
    seen = 0
    while True:
        page = service.get_data(key, seen, 150)
        assert [r["row_number"] for r in page["samples"]] == list(range(seen + 1, seen + 1 + len(page["samples"])))
        assert {r["Status"] for r in page["samples"]} == {"F"} and page["sample_columns"][:2] == ["row_number", "study_id"]
        seen += len(page["samples"])
        if not page["has_more"]:
            break
    assert seen == n["sample_count"]


def test_download(service, tmp_path):
    key = service.process_query(FORM)
    service.download(key, tmp_path / "d.zip")
    with zipfile.ZipFile(tmp_path / "d.zip") as z:
        lines = z.read("samples.csv").decode().splitlines()
    assert len(lines) == service.n_samples(FORM)["sample_count"] + 1 and any(",None" in x for x in lines)
    empty = service.process_query(FORM | {"yearRange": "1900"})
    service.download(empty, tmp_path / "e.zip")
    with zipfile.ZipFile(tmp_path / "e.zip") as z:
        assert len(z.read("samples.csv").decode().splitlines()) == 1


def test_fields(service, tmp_path):
    fields = service.search_fields()
    assert fields["covariates"]["Status"] == ["F", "O", "P"] and fields["covariates"]["Acctbal"] == "FLOAT" and "ASIA" in fields["continents"]
    saved = service.save_fields(str(tmp_path / "f"))
    assert saved.count() == service.save_fields(str(tmp_path / "f")).count() == service.save_fields(str(tmp_path / "f"), clear=True).count()
    listing = service.update_covariate([(2, "Balance")], "id_key int, name string")
    assert "Balance" in {r["name"] for r in listing.collect()}
    assert missing_point_columns(["﻿Latitude", " Year "]) == ["Longitude"]


def test_extract(spark):
    px = [("D", "b", f"200{y}-0{m}-01 00:00:00", p, float(10 * y + m + p)) for y in range(3) for m in (1, 6) for p in (0, 1)]
    pixels = spark.createDataFrame(px, "dataset_id string, band string, ts string, pixel_id long, value double").selectExpr("dataset_id", "band", "timestamp(ts) AS ts", "pixel_id", "value")
    places = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.001)], "pixel_id long, lat double, lon double")
    points = spark.createDataFrame([(0, 0.0, 0.0, 2001, "x"), (1, 5.0, 5.0, 2001, "y"), (2, 0.0, 0.0, 2002, "z")], "row_id long, latitude double, longitude double, year int, note string")
    e = "spatial_mean({});years_max(-1,0;julian_min(1,365))"
    got = {r.row_id: r for r in extract(points, pixels, places, [Extraction("D", "b", "spatial_mean(0;years_max(-1,0;julian_min(1,365)))"), Extraction("D", "b", "spatial_max(500;years_mean(0,0))", "mult[2]", years=(2000, 2002))]).collect()}
    first, second = "D:b_spatial_mean(0;years_max(-1,0;julian_min(1,365)))", "D:b_spatial_max(500;years_mean(0,0))"
    assert got[0][first] == 11.0 and got[1][first] is None and got[0][second] == "29.0" and got[2][second] == "Outside 2000-2002: (2002, 2003)"
    masked = extract(points, pixels, places, [Extraction("D", "b", "years_mean(0,0)", mask=("D", "b", (11.0, 16.0)))]).where("row_id = 0").first()
    assert masked["D:b_years_mean(0,0)"] == 13.5


def test_extract_takes_the_smallest_pixel_of_a_place(spark):
    """Several pixels at one place: always the same, whatever the order of the locations; points of one place and year share it."""
    px = [("D", "b", "2001-03-01 00:00:00", p, float(p)) for p in range(40)]
    pixels = spark.createDataFrame(px, "dataset_id string, band string, ts string, pixel_id long, value double").selectExpr("dataset_id", "band", "timestamp(ts) AS ts", "pixel_id", "value")
    points = [(i, (0.0, 5.0, None)[i % 3], 0.0, 2001) for i in range(9)]
    for order in (1, -1):
        places = spark.createDataFrame([(p, 0.0, 0.0) for p in range(3, 40)][::order], "pixel_id long, lat double, lon double")
        got = extract(spark.createDataFrame(points, "row_id long, latitude double, longitude double, year int"), pixels, places, [Extraction("D", "b", "years_mean(0,0)"), Extraction("D", "b", "years_mean(0,0)", "mult[2]", years=(2005, 2006))], cli=True)
        rows = {r[0]: tuple(r[4:]) for r in got.collect()}
        assert rows == {i: (3.0 if i % 3 == 0 else None, "Outside 2005-2006: (2001, 2002)") for i in range(9)}


def test_form(spark):
    one = spark.range(1)
    check_form(one, [Extraction("ECMWF/ERA5/MONTHLY", "total_precipitation", "spatial_max(100;years_mean(0,0))", mask=("GOOGLE/DYNAMICWORLD/V1", "label", (1.0,)))])
    for wrong in (
        Extraction("A", "b", "years_mean(0,0)"), Extraction("GOOGLE/DYNAMICWORLD/V1", "crops", "spatial_sd(0;years_mean(0,0))"),
        Extraction("ECMWF/ERA5/MONTHLY", "total_precipitation", "years_mean(0,0)", mask=("A", "b", (1.0,))),
    ):
        with pytest.raises(ExprError):
            check_form(one, [wrong])
    with pytest.raises(ExprError, match="5000 points"):
        check_form(spark.range(5001), [])


def test_only_reachable_pixels_are_read(spark):
    pixels = spark.range(1000).selectExpr("timestamp'2001-05-01 00:00:00' AS ts", "id AS pixel_id", "double(id) AS value")
    request = spark.createDataFrame([(0, 0.0, 0.0, 2001, 7), (1, 0.0, 0.0, 2001, None)], "row_id long, latitude double, longitude double, year int, pixel_id long")
    df = raster.evaluate(request, pixels, parse("years_max(0,0)"))
    assert {r.row_id: r.value for r in df.collect()} == {0: 7.0, 1: None}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 2 and ">= 7" in plan and "<= 7" in plan


@pytest.mark.parametrize("bracket", [1e-4, 0.02])
def test_exact_percentiles(spark, bracket, monkeypatch):
    monkeypatch.setattr(raster, "_BRACKET", bracket)
    rng = random.Random(3)
    rows = [("a", rng.gauss(0, 1)) for _ in range(400)] + [("b", float(rng.randrange(4))) for _ in range(300)] + [("c", 1.0), ("d", None)] + [("e", float(x)) for x in (1, 2)]
    got = {r.k: (r.p0, r.p1) for r in raster.exact_percentiles(spark.createDataFrame(rows, "k string, value double"), ["k"], (0.1, 0.9)).collect()}
    assert set(got) == {"a", "b", "c", "e"}
    for k, (low, high) in got.items():
        values = sorted(v for x, v in rows if x == k)
        for p, mine in ((0.1, low), (0.9, high)):
            at = p * (len(values) - 1)
            i = int(at)
            assert abs(mine - (values[i] + (values[min(i + 1, len(values) - 1)] - values[i]) * (at - i))) < 1e-9


def test_sources():
    check_stat("ECMWF/ERA5/MONTHLY:total_precipitation", "max")
    with pytest.raises(ExprError):
        check_stat("*MODIS/061/MCD12Q1 landcover table", "max")


def test_cli(spark, sf_dir, tmp_path):
    (tmp_path / "t.txt").write_text('"[pest_list]" pest | Is [pest_list] a pest?\n')
    (tmp_path / "l.txt").write_text("Aphis\nBombus\n")
    (tmp_path / "c.txt").write_text("Aphis,Aphis fabae\n")
    cli.run(spark, ["expand", str(tmp_path / "t.txt"), str(tmp_path / "e"), "--pest_list", str(tmp_path / "l.txt")])
    assert {r.value for r in spark.read.text(str(tmp_path / "e")).collect()} == {'Aphis:"Aphis" pest:Is Aphis a pest?', 'Bombus:"Bombus" pest:Is Bombus a pest?'}
    (tmp_path / "n.txt").write_text("# names\n Aphis \n\nBombus\n")
    cli.run(spark, ["spell", str(tmp_path / "n.txt"), str(tmp_path / "c.txt"), str(tmp_path / "s")])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "s")).collect()) == ["", "# names", "Aphis fabae", "Bombus"]
    assert cli.run(spark, ["dry-run", sf_dir, str(tmp_path / "e")]).first().new_pairs == 2
    cli.run(spark, ["report", sf_dir, str(tmp_path / "r")])
    cli.run(spark, ["missing-answers", sf_dir, str(tmp_path / "m")])
    assert cli.run(spark, ["missing-links", sf_dir]).count() > 0
    (tmp_path / "p.txt").write_text("NATION_1\n")
    assert cli.run(spark, ["purge", sf_dir, str(tmp_path / "p.txt"), "--out", str(tmp_path / "v2")]).count() == 5
    assert spark.read.parquet(str(tmp_path / "v2" / "species.parquet")).where("name = 'NATION_1'").count() == 0
    assert cli.run(spark, ["ask", "--context", "A bee  can fly.", "--query", "Can it?"]).first().answer == "yes"
    (tmp_path / "pt.csv").write_text("Latitude,Longitude,Year\n-89.63,-100.81,1996\n")
    (tmp_path / "ds.csv").write_text('Dataset ID,Band Name,Spatiotemporal Aggregation Function,Pixel Value Transform\nDS_R,value,"spatial_mean(0;years_mean(-1,0))",n/a\n')
    cli.run(spark, ["eo", sf_dir, str(tmp_path / "pt.csv"), str(tmp_path / "ds.csv"), str(tmp_path / "eo")])
    assert len(spark.read.csv(str(tmp_path / "eo"), header=True).columns) == 5
    with pytest.raises(ExprError, match="unknown source"):
        cli.run(spark, ["eo", sf_dir, str(tmp_path / "pt.csv"), str(tmp_path / "ds.csv"), str(tmp_path / "eo2"), "--form"])
