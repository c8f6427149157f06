import json
import random
import re
from types import SimpleNamespace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldlark.functions import text as T
from fieldlark.functions import binary, urls, windows
from fieldlark.functions.replies import UNREADABLE, first_object, repair
from fieldlark.functions.windows import merge_intervals, windows_column
from fieldlark.operators.traits import expand_templates, get_or_create, new_contents, parse_expanded, snippet, upsert_links
from fieldlark.plans import raster
from fieldlark.providers import PagedSearch, search_links, with_retries
from fieldlark.sources import datasets


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("text,want", [(None, True), ("", True), (" \n\t", True), ("x" * 39, True), ("x" * 40, None), ("y" * 50 + " 403 Forbidden", True), ("a  \n" * 15, True)])
def test_error_text(spark, text, want):
    assert one(spark, T.is_error_text(F.col("t")), t=text) is want


def test_html(spark):
    page = '<html><script>var a="</p>";</script><p>One &amp; <b>two</b></p><div>three</div><style>x</style></html>'
    got = one(spark, T.html_to_text(F.col("t")), t=page)
    assert got.split() == ["One", "&", "two", "three"] and "\n" in got


def test_urls(spark):
    u = "https://user@a.org:80/x/y/z.html?q=/1#f"
    assert one(spark, urls.host(F.col("t")), t=u) == "user@a.org:80"
    assert one(spark, urls.origin(F.col("t")), t=u) == "https://user@a.org:80"
    assert one(spark, urls.parent(F.col("t")), t=u) == "https://user@a.org:80/x/y/"
    assert one(spark, urls.host(F.col("t")), t="nothing") == ""


def test_words(spark):
    assert one(spark, T.valid_words(F.col("t")), t=" (Hello), w0rld it's fine. ") == "Hello its fine"
    assert one(spark, T.printable(F.col("t")), t="a\u00a0b\x07 c\n") == "ab c\n"
    assert one(spark, T.ascii_only(F.col("t")), t="naïve ñ") == "nave "
    assert one(spark, T.chunks(F.col("t"), 2), t="abcde") == ["ab", "cd", "e"]
    assert one(spark, T.chunks(F.col("t"), 2), t="") == []
    assert one(spark, T.phrase_of(F.col("t")), t='"Bombus Terrestris" can fly') == "terrestris"
    assert one(spark, T.safe_filename(F.col("t")), t='a/b:c*."') == "a_b_c_._"


def test_snippet(spark):
    text = "a" * 100 + " Aphis " + "b" * 100
    got = one(spark, snippet(F.col("t"), F.col("n")), t=text, n="aphis")
    assert got.startswith("... ") and got.endswith(" ...") and "Aphis" in got
    assert one(spark, snippet(F.col("t"), F.col("n")), t=text, n="zzz") == "a" * 80


def test_context_windows(spark):
    def windows(text, phrase, buffer=1500, separation=100, limit=None):
        df = spark.createDataFrame([(text, phrase)], "t string, p string")
        return df.select(windows_column(F.col("t"), F.col("p"), buffer, separation, limit)).first()[0]

    text = "x " * 100 + "can fly" + " y" * 100
    assert windows(text, "") == [] and windows(None, "a") == [] and windows("abc", "zzz") == [] and windows("abc", None) == [] and windows("", "a") == []
    assert windows("can fly", "can fly") == ["can fly"] and windows("cannot", "can") == [] and windows("ñcan", "can") == []
    got = windows(text, " CAN  fly", 20)
    assert len(got) == 1 and got[0].startswith("... ") and got[0].endswith(" ...") and "can fly" in got[0]
    two = "fly" + " z" * 300 + " fly"
    assert len(windows(two, "fly", 20)) == 2 and len(windows(two, "fly", 20, limit=1)) == 1
    assert len(windows(two, "fly", 300)) == 1 and len(windows(two, "fly", 20, separation=600)) == 1
    assert windows("can\n fly é", "can fly") == ["can\n fly é"] and windows("a (b) c", "(b)") == []
    long = "q" * 300 + " fly " + "r" * 300  # words longer than the near part of the search
    assert windows(long, "fly", 20) == [long] and windows("a " + long + " b", "fly", 20) == ["... " + long + " ..."]


def brute_windows(text, phrase, buffer, separation):
    """Cuts found with the positions of all white space instead."""
    blanks, size = [i for i, c in enumerate(text) if c.isspace()], len(text)
    out = []
    for m in re.finditer(r"(?i)\b" + r"\s+".join(map(re.escape, phrase.split())) + r"\b", text):
        s, e = max(0, m.start() - buffer), min(size, m.end() + buffer)
        s = max((i for i in blanks if i <= s), default=0)
        e = min((i + 1 for i in blanks if i >= e - 1), default=size) if e < size else size
        if out and s - out[-1][1] <= separation:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [("... " if s else "") + text[s:e].strip() + (" ..." if e < size else "") for s, e in out]


def test_context_windows_equal_brute_force(spark):
    rng = random.Random(8)
    words = ["fly", "Fly", "can", "é", "x" * 70, "y", "z-z", "fly,"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t "]) for _ in range(rng.randrange(60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for buffer, separation in ((0, 0), (10, 5), (40, 100)):
        got = {r.i: r.w for r in df.select("i", windows_column(F.col("t"), F.lit("can  FLY"), buffer, separation).alias("w")).collect()}
        assert all(got[i] == brute_windows(t, "can FLY", buffer, separation) for i, t in enumerate(texts))


def brute_islands(spans, separation):
    out = {}
    for key, start, end in sorted(spans):
        found = out.setdefault(key, [])
        if found and start - found[-1][1] <= separation:
            found[-1][1] = max(end, found[-1][1])
        else:
            found.append([start, end])
    return sorted((key, *span) for key, found in out.items() for span in found)


@pytest.mark.parametrize("loose", [False, True])
def test_merge_intervals_whatever_the_order_of_ties(spark, monkeypatch, loose):
    rng = random.Random(3)
    spans = [(rng.randrange(20), start, start + rng.choice([0, 10, 40])) for start in (rng.randrange(2000) for _ in range(400))] * 6
    if loose:  # each window orders ties for itself
        by = lambda key: SimpleNamespace(orderBy=lambda *columns: Window.partitionBy(key).orderBy(*columns, F.rand(5)))
        monkeypatch.setattr(windows, "Window", SimpleNamespace(partitionBy=by, unboundedPreceding=Window.unboundedPreceding))
    got = merge_intervals(spark.createDataFrame(spans, "k long, start long, end long"), "k", 20)
    assert sorted(map(tuple, got.collect())) == brute_islands(spans, 20)


def test_merge_intervals_without_bounds(spark):
    spans = [(1, None, None)] * 3 + [(1, 5, 9)] * 2 + [(None, 5, 9), (None, 30, 40)]
    got = merge_intervals(spark.createDataFrame(spans, "k long, start long, end long"), "k", 20)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(["(1, None, None)"] * 3 + ["(1, 5, 9)", "(None, 5, 9)", "(None, 30, 40)"])


@pytest.mark.parametrize("text,want", [('{"a": 1}', {"a": 1}), ('```json\n{"a": 1}\n```', {"a": 1}), ("{“a”: “b”}", {"a": "b"}), ('{"a": "\\q"}', {"a": "\\q"}), ('{"a": "x\ny"}', {"a": "x y"}), ("hopeless", None)])
def test_repair(text, want):
    got = repair(text)
    assert got == want if want else got["answer_text"] == UNREADABLE and got["evidence"] == [text]


@given(st.dictionaries(st.text(max_size=5), st.one_of(st.text(max_size=10), st.integers(), st.dictionaries(st.text(max_size=3), st.text(max_size=3), max_size=2)), max_size=3), st.text(alphabet="ab c", max_size=5))
@settings(max_examples=60, deadline=None)
def test_first_object(value, before):
    text = json.dumps(value)
    assert first_object(before + text + " tail}") == text


def test_first_object_unbalanced():
    assert first_object('{"a": {') is None and first_object("none") is None and first_object('{"a": "}"}') == '{"a": "}"}'


def test_templates(spark):
    lines = spark.createDataFrame([('"[pest_list]" eats [predator_list] | Does [pest_list] eat [predator_list]?',), ("# c",), ("x | no placeholder",)], "value string")
    names = {"pest_list": spark.createDataFrame([("P",), ("Q",)], "name string"), "predator_list": spark.createDataFrame([("R",)], "name string")}
    got = {tuple(r) for r in expand_templates(lines, names).collect()}
    assert got == {("P & R", '"P" eats R', "Does P eat R?"), ("Q & R", '"Q" eats R', "Does Q eat R?")}
    none = {"pest_list": names["pest_list"], "predator_list": names["predator_list"].limit(0)}
    assert expand_templates(lines, none).count() == 0


def test_names_with_colons(spark):
    rows = parse_expanded(spark.createDataFrame([('rogadinae: aleoides:"rogadinae: aleoides" pest:Is it: a pest?',)], "value string")).collect()
    assert rows[0].species == "rogadinae: aleoides" and rows[0].question == "Is it: a pest?"


def test_upserts(spark):
    links = spark.createDataFrame([("a", 1), ("b", None)], "url string, content_id long")
    new = spark.createDataFrame([("a", 5, 1), ("a", 6, 2), ("c", 7, 1)], "url string, content_id long, seq int")
    assert {tuple(r) for r in upsert_links(links, new).collect()} == {("a", 6), ("b", None), ("c", 7)}
    texts = spark.createDataFrame([("x",), ("x",), ("y",)], "text string")
    first = new_contents(texts)
    assert first.count() == 2 and new_contents(texts, first).count() == 0
    have = spark.createDataFrame([(3, "a", "old")], "id long, text string, keyword_phrase string")
    wanted = spark.createDataFrame([("a", "new"), ("b", "k")], "text string, keyword_phrase string")
    assert {tuple(r) for r in get_or_create(have, wanted, "text", "keyword_phrase").collect()} == {(3, "a", "new"), (4, "b", "k")}


@pytest.mark.parametrize("year,days,want", [(2000, (1, 365), ("2000-01-01", "2000-12-31")), (2000, (0, 10), ("1999-12-31", "2000-01-11")), (2000, (-1, 10), ("1999-12-31", "2000-01-11")), (2000, (-31, 10), ("1999-12-01", "2000-01-11")), (2001, (300, 396), ("2001-10-27", "2002-02-01"))])
def test_day_window(spark, year, days, want):
    start, end = raster.day_window(F.lit(year), *days)
    row = spark.range(1).select(start.cast("string"), end.cast("string")).first()
    assert tuple(row) == want


def test_radius_join_equals_all_pairs(spark):
    import random

    rng = random.Random(3)
    pts = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)] + [(1000, 89.99, 0.0), (1001, 89.99, 179.0), (1002, 10.0, 179.99), (1003, 10.0, -179.99)]
    points = spark.createDataFrame(pts, "row_id long, latitude double, longitude double")
    pixels = points.selectExpr("row_id AS pixel_id", "latitude AS lat", "longitude AS lon")
    for radius in (5_000.0, 800_000.0, 6_000_000.0):
        got = {tuple(r) for r in raster.within_radius(points, pixels, radius).collect()}
        every = points.crossJoin(pixels).where(raster.haversine(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon")) <= radius)
        assert got == {tuple(r) for r in every.select("row_id", "pixel_id").collect()}


def test_focal_mean_pairs_places(spark, monkeypatch):
    rng = random.Random(4)
    places = [(10.0, 20.0), (10.0, 20.5), (-0.0, 179.99), (0.0, -179.99), (60.0, 0.0)]
    pts = [(i, *places[i % 5]) for i in range(400)] + [(400, None, 1.0)]
    values = [(i, None if i % 7 == 0 or i % 5 == 4 else rng.random()) for i in range(401) if i % 3]
    locations, known = spark.createDataFrame(pts, "pixel_id long, lat double, lon double"), spark.createDataFrame(values, "pixel_id long, value double")
    pairs, join = [], raster.within_radius
    monkeypatch.setattr(raster, "within_radius", lambda *a: pairs.append(join(*a)) or pairs[-1])
    got = {r.pixel_id: r.value for r in raster.focal_mean(known, locations, 100_000.0).collect()}
    near = {0: (0, 1), 1: (0, 1), 2: (2, 3), 3: (2, 3), 4: (4,)}
    means = {k: [v for i, v in values if v is not None and i < 400 and i % 5 in p] for k, p in near.items()}
    assert set(got) == set(range(400)) and all(got[i] == (pytest.approx(sum(m) / len(m)) if (m := means[i % 5]) else None) for i in got)
    assert pairs[0].count() == 9  # of places, however many pixels are there


def test_mask_classes(spark):
    rows = spark.createDataFrame([(211,), (244,), (311,), (500,)], "c int").select(datasets.mask_class(F.col("c"), "corine")).collect()
    assert [r[0] for r in rows] == ["cultivated", "cultivated", "natural", None]
    ini = "[corine]\ngee_dataset=X/{year}\nband_name=b\nvalid_years=list(range(1990, 1993))\nfilter_by=date\n[mask_types]\ncultivated=[(1, 2)]\nnatural=[3]\n"
    row = datasets.read_definitions(spark, [ini]).first()
    assert row.valid_years == [1990, 1991, 1992] and row.cultivated == "[[1, 2]]" and not row.disabled


def test_paged_search():
    pages = {1: [{"url": str(i)} for i in range(10)], 11: [{"url": "x"}]}
    search = PagedSearch(lambda q, start: pages.get(start, []))
    assert len(search("q", 30)) == 11 and len(search("q", 4)) == 4


def test_retries(spark):
    calls, waits = [], []

    def flaky(q):
        calls.append(q)
        if len(calls) < 3:
            raise OSError
        return [{"url": "u"}]

    assert with_retries(flaky, sleep=waits.append)("q") == [{"url": "u"}] and len(waits) == 2 and waits[1] >= 2
    with pytest.raises(OSError):
        with_retries(open, tries=1)("/nowhere")
    asked = spark.createDataFrame([(1, "a"), (2, "fail")], "question_id long, keyword_phrase string")

    def search(k):
        if k == "fail":
            raise OSError
        return [{"url": f"http://{k}", "title": None}]

    assert [tuple(r) for r in search_links(asked, search).collect()] == [(1, "http://a", None)]


def test_binary_documents():
    def pdf(data):
        return {b"long": ["x"] * 3, b"blank": ["", " "], b"two": [" a ", "b"]}[data]

    read = binary.paged_reader(pdf)
    assert [read(d, 2) for d in (b"long", b"blank", b"two", b"bad")] == ["[[PDF_SKIPPED_TOO_LONG:3]]", "[[PDF_EMPTY_TEXT]]", "a\n\nb", "[[PDF_PARSE_ERROR]]"]
    assert binary.read_first(b"plain \xff text", [binary.word_text]) == "plain  text"


def test_main_text(spark):
    link = '<p><a href="x">' + "go " * 30 + "</a></p>"
    good = "<p>" + "words " * 10 + "</p>"
    pages = [f"<nav>n</nav>{link}<article><p>a</p></article>", f"<nav>n</nav>{link}{good}<main></main>", f"<nav>n</nav>{link}", None, ""]
    got = [one(spark, T.extract_text(F.col("t"), entities=False), t=p) for p in pages]
    assert got[:2] == ["a", ("words " * 10).strip()] and "go go" in got[2] and got[3:] == [None, ""]
