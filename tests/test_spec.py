import pytest

from fieldlark.plans.spec import Box, QuerySpec, SpecError, box_of, extract_years, filter_text, spec_from_form


@pytest.mark.parametrize("text,years", [("1990", [1990]), ("1990, 1992 1995-1997", [1990, 1992, 1995, 1996, 1997]), ("1990-1992, 1991-1993", [1990, 1991, 1992, 1993]), ("2000-1990", []), ("1990 ,1991,\t1993", [1990, 1991, 1993])])
def test_years(text, years):
    assert extract_years(text) == years


@pytest.mark.parametrize("text", ["1990 - 1995", "1990,", "x", ""])
def test_bad_years(text):
    with pytest.raises(SpecError):
        extract_years(text)


def test_center_box_is_a_quarter_to_each_side():
    assert box_of(QuerySpec(center_point="(1.5, -2)", center_buffer="0.25")) == Box(1.5625, -2.0625, 1.4375, -1.9375)
    assert box_of(QuerySpec(center_point="1.5\t-2", center_buffer="0.25", legacy_buffer=False)) == Box(1.625, -2.125, 1.375, -1.875)


def test_corners_win_over_the_center():
    box = box_of(QuerySpec(center_point="1 1", center_buffer="1", upper_left="(10, -20)", lower_right="-10 20"))
    assert (box.top, box.left, box.bottom, box.right) == (10, -20, -10, 20)


@pytest.mark.parametrize("spec", [QuerySpec(center_point="1 1"), QuerySpec(center_point="nowhere", center_buffer="1"), QuerySpec(upper_left="1 1")])
def test_bad_boxes(spec):
    with pytest.raises(SpecError):
        box_of(spec)


def test_blank_parts_are_inactive():
    assert box_of(QuerySpec(center_point=" ", upper_left="")) is None


def test_form():
    spec = spec_from_form({"covariate": ["A", "B"], "values": ["x", "y", "z"], "valueCounts": ["2", "1"], "minSitesPerStudy": "3", "sampleSizeMinYears": "0", "sampleSizeMinObservationsPerYear": "0", "yearRange": "1990", "countrySelect": ""})
    assert spec.covariates == (("A", ("x", "y")), ("B", ("z",))) and spec.min_sites == 3 and spec.country is None


def test_text():
    spec = QuerySpec(covariates=(("A", ("x", "y")), ("Q", ("z",))), country="Peru", min_years=2, years="1990")
    assert filter_text(spec, {"A": 1}) == "A(1) = x|y\nQ(None) = z\ncountry is Peru\nmin sample size min years 2\nyears in {1990}\n"
