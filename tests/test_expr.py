import pytest

from fieldlark.plans.expr import ExprError, Step, Transform, compose, parse, parse_transform, with_default_space


def test_innermost_first():
    assert parse(" spatial_mean(100; years_mean(-2, 0; julian_max(100,200))) ") == [Step("julian", "max", (100, 200)), Step("years", "mean", (-2, 0)), Step("spatial", "mean", (100,))]
    assert parse(compose("sd", 30, 3, "min", 1, 90))[0] == Step("julian", "min", (1, 90))


def test_top():
    step = parse("years_mean_n_max(3,-1,0)")[0]
    assert step.top == 3 and step.span == (-1, 0)


@pytest.mark.parametrize("text", ["mode(1)", "spatial_mean(1;spatial_max(2))", "julian_mean(1,2)", "years_mean(1)", "spatial_mean(1,2)", "SPATIAL_MEAN(1)", "spatial_mean()", "spatial_mean(+)", "spatial_mean(1", "spatial_mean_n_max(5)", ""])
def test_errors(text):
    with pytest.raises(ExprError):
        parse(text)


def test_default_space_leaves_the_list():
    steps = parse("years_mean(0,0)")
    assert len(with_default_space(steps)) == 2 and len(steps) == 1


@pytest.mark.parametrize("text,want", [("mask[1, 2]", Transform("mask", (1, 2))), ("mult[0.5]", Transform("mult", (0.5,))), ("add[-3]", Transform("add", (-3,))), ("N/A", None), (None, None), ("none", None)])
def test_transform(text, want):
    assert parse_transform(text) == want


@pytest.mark.parametrize("text", ["mask[1", "power[2]", "mult[1,2]", "mult[__import__('os')]"])
def test_bad_transform(text):
    with pytest.raises(ExprError):
        parse_transform(text)
