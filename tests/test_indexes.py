import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tesserae.catalog import Catalog
from tesserae.errors import CatalogError
from tesserae.functions import dates
from tesserae.plans.specs import CatalogSpec


def ids(catalog, **request):
    return sorted(r[0] for r in catalog.search(request).df.select("data_record_id_").collect())


def make(spark, rows, schema, kind, *sources, **options):
    spec = CatalogSpec("id").add_column("id").add_index("foo", kind, *sources, **options)
    return Catalog.of(spark.createDataFrame(rows, schema), spec)


FRUIT = ["fig", "plum", None, "pear", "quince", "plum", "apple", "medlar", "pear", "", "zwetschge", "fig"]


@pytest.fixture(scope="module")
def field(spark):
    return make(spark, list(enumerate(FRUIT)), "id int, foo string", "field")


def rows_with(test):
    return [i for i, x in enumerate(FRUIT) if x is not None and test(x)]


@pytest.mark.parametrize("q, want", [
    ("plum", rows_with(lambda x: x == "plum")), (["fig", "pear", "nothing"], rows_with(lambda x: x in ("fig", "pear"))), (None, []), ([], []), ({"query": ["fig", None]}, rows_with(lambda x: x == "fig")),
    ({"query": "medlar", "range": "min"}, rows_with(lambda x: x >= "medlar")), ({"query": ("quince", "medlar"), "range": "min"}, rows_with(lambda x: x >= "medlar")),
    ({"query": "medlar", "range": "max"}, rows_with(lambda x: x <= "medlar")), ({"query": ("fig", "plum", "pear"), "range": "min:max"}, rows_with(lambda x: "fig" <= x <= "plum")),
    ({"query": ("fig", "plum"), "range": "min:max", "not": ["pear", "fig"]}, rows_with(lambda x: "fig" <= x <= "plum" and x not in ("pear", "fig"))),
    ({"query": "medlar", "range": "max", "not": "apple"}, rows_with(lambda x: x <= "medlar" and x != "apple")), ({"query": ["fig", "plum"], "not": "plum"}, rows_with(lambda x: x == "fig")),
    ({"query": "fig", "not": "fig"}, []), ({"range": "min:max", "not": ["", "zwetschge"]}, rows_with(lambda x: x not in ("", "zwetschge"))),
    ({"not": ["plum", "nothing"]}, [i for i, x in enumerate(FRUIT) if x != "plum"]), ({"not": ["nothing", "nowhere"]}, rows_with(lambda x: True))])
def test_field(field, q, want):
    assert ids(field, foo=q) == want


def test_field_takes_no_operator(field):
    with pytest.raises(ValueError):
        ids(field, foo={"query": "a", "operator": "and"})


def test_falsy_upper_bound(spark):
    numbers = make(spark, [(i, i - 5) for i in range(10)], "id int, foo int", "field")
    assert ids(numbers, foo={"query": 0, "range": "max"}) == list(range(10))
    assert ids(numbers, foo={"query": (-99, 1), "range": "min:max"}) == list(range(7))


TAGS = [["red"], ["red", "round"], ["blue", None, "blue"], [], None, ["round", "blue", "wooden"], ["wooden", "red", "round", "blue"], ["steel"]]
SETS = [set(x or ()) - {None} for x in TAGS]


@pytest.fixture(scope="module")
def keyword(spark):
    return make(spark, list(enumerate(TAGS)), "id int, foo array<string>", "keyword")


def sets_with(test):
    return [i for i, x in enumerate(SETS) if test(x)]


@pytest.mark.parametrize("q, want", [
    ("red", sets_with(lambda x: "red" in x)), (["steel", "blue"], sets_with(lambda x: x & {"steel", "blue"})), ({"query": ["red", "round"], "operator": "and"}, sets_with(lambda x: x >= {"red", "round"})),
    ({"query": ["red", "glass"], "operator": "and"}, []), ({"query": ["red", "blue"], "not": "round"}, sets_with(lambda x: x & {"red", "blue"} and "round" not in x)),
    ({"query": ("s", "t"), "range": "min:max"}, sets_with(lambda x: any("s" <= y <= "t" for y in x))), ({"query": ("red", "round"), "range": "min:max", "operator": "and"}, sets_with(lambda x: x >= {"red", "round"})),
    ({"not": ["red", "steel"]}, sets_with(lambda x: not x & {"red", "steel"})), ({"not": "glass"}, sets_with(bool))])
def test_keyword(keyword, q, want):
    assert ids(keyword, foo=q) == want


def test_pure_not_keeps_rows_without_values(spark):
    spec = CatalogSpec("id").add_index("words", "keyword").add_index("field", "field")
    c = Catalog.of(spark.createDataFrame([(1, [10, 11, 12], "foo"), (2, [11, 12], "foo"), (3, None, "foo"), (4, [], "foo")], "id int, words array<int>, field string"), spec)
    assert ids(c, words={"not": [10]}, field="foo") == [2, 3, 4]
    assert ids(c, words={"not": [99]}, field="foo") == [1, 2]


def test_keyword_of_single_values(spark):
    c = make(spark, [(1, "x"), (2, ""), (3, None)], "id int, foo string", "keyword")
    assert ids(c, foo="x") == [1] and [r.n for r in c.num_objects("foo").collect()] == [1]


def test_uuid(spark):
    rows = [(i, f"key{i * i % 11}" if i % 6 else None) for i in range(1, 40)]
    first = {}
    for i, x in rows:
        first.setdefault(x, i)
    first.pop(None)
    c = make(spark, rows, "id int, foo string", "uuid")
    for x, i in first.items():
        assert ids(c, foo=x) == [i]
    assert ids(c, foo=list(first)) == sorted(first.values()) and sorted(map(tuple, c.unique_values("foo", True).collect())) == sorted((x, 1) for x in first)
    assert ids(c, foo={"query": ("key1", "key4"), "range": "min:max"}) == sorted(i for x, i in first.items() if "key1" <= x <= "key4")


def test_boolean(spark):
    c = make(spark, [(1, True), (2, False), (3, None)], "id int, foo boolean", "boolean")
    assert ids(c, foo=True) == [1] and ids(c, foo=False) == [2] and ids(c, foo=[False, True]) == [2]
    assert sorted(map(tuple, c.unique_values("foo", True).collect())) == [(False, 1), (True, 1)]
    present = make(spark, [(1, True), (3, None)], "id int, foo boolean", "boolean", "foo", present=lambda: F.lit(True))
    assert ids(present, foo=False) == [3]
    assert ids(make(spark, [(1, "x"), (2, "")], "id int, foo string", "boolean"), foo=False) == [2]


def code(t):
    return (((t.year * 12 + t.month) * 31 + t.day) * 24 + t.hour) * 60 + t.minute


def test_minute_codes():
    t = dt.datetime(2019, 11, 3, 21, 47, 30)
    assert dates.minute_code(t) == code(t) == dates.minute_code("2019-11-03T23:47:01+02:00")
    assert dates.minute_code(0) == dates.minute_code(dt.date(1970, 1, 1)) and dates.minute_code(object()) is None
    assert dates.minute_code(t, 15) == code(t) - code(t) % 15
    assert dates.epoch_minutes(-1.5) == -1 and dates.epoch_minutes(17, 6) == 12 and dates.epoch_minutes(dt.datetime(1970, 1, 1, 2)) == 120
    with pytest.raises(OverflowError):
        dates.epoch_minutes(2**31)


def test_date(spark):
    rows = [(i, dt.datetime(1970, 1, 1) + dt.timedelta(seconds=i * 104_729_111 % 2_000_000_000) if i % 9 else None) for i in range(40)]
    c = make(spark, rows, "id int, foo timestamp", "date")
    held = {i: code(t) for i, t in rows if t}
    for t in (rows[4][1], rows[17][1], rows[32][1]):
        k = code(t)
        assert ids(c, foo=t) == [i for i, x in held.items() if x == k]
        assert ids(c, foo={"query": t, "range": "min"}) == [i for i, x in held.items() if x >= k] and ids(c, foo={"query": t, "range": "max"}) == [i for i, x in held.items() if x <= k]
        assert ids(c, foo={"not": t}) == [i for i, _ in rows if held.get(i) != k]
    assert ids(c, foo={"not": dt.datetime(1969, 5, 5)}) == sorted(held)
    for kind, values in (("double", [0.0, 1_572_817_650.0]), ("string", ["1970-01-01T00:00:00", "2019-11-03T21:47:30"]), ("date", [dt.date(1970, 1, 1), dt.date(2019, 11, 3)])):
        c = make(spark, list(enumerate(values)), f"id int, foo {kind}", "date")
        assert ids(c, foo=0) == [0] and ids(c, foo={"query": "2019-11-03", "range": "min"}) == [1]


@pytest.mark.parametrize("precision", [1, 7])
def test_daterange(spark, precision):
    rng = random.Random(precision)
    end = lambda: rng.choice([None, rng.randrange(0, 60)])
    rows = [(i, end(), end()) for i in range(60)]
    c = make(spark, rows, "id int, start long, stop long", "daterange", "start", "stop", precision=precision)
    cut = lambda x: x if x is None else x - x % precision
    for v in (-3, 0, 6, 13, 29, 44, 59, 80):
        assert ids(c, foo=v) == [i for i, a, b in rows if (a is None or cut(a) <= cut(v)) and (b is None or cut(b) >= cut(v))]
    low, high = 10, 50
    limited = make(spark, rows, "id int, start long, stop long", "daterange", "start", "stop", floor=low, ceiling=high)
    inside = lambda x: x if x is not None and low <= x <= high else None
    assert ids(limited, foo=30) == [i for i, a, b in rows if (inside(a) is None or a <= 30) and (inside(b) is None or b >= 30)]
    assert ids(limited, foo=99) == list(range(60))


PATHS = [f"/{'/'.join(random.Random(i).choices(['lib', 'src', 'doc'], k=1 + i % 4))}/f{i}" for i in range(40)]


@pytest.fixture(scope="module")
def path(spark):
    return make(spark, list(enumerate(PATHS)), "id int, foo string", "path")


def paths_with(p, level):
    wanted = [x for x in p.split("/") if x]
    parts = [x.split("/")[1:] for x in PATHS]
    at = lambda own, k: own[k : k + len(wanted)] == wanted
    return [i for i, own in enumerate(parts) if (at(own, level) if level >= 0 else any(at(own, k) for k in range(len(own))))]


@pytest.mark.parametrize("p, level", [("lib", 0), ("src", 1), ("doc", 2), ("lib/src", 0), ("src/doc", 1), ("doc/doc", -1), ("lib", -1), ("f17", -1), ("f3", 4), ("nowhere", 0), ("", 0)])
def test_path(path, p, level):
    want = paths_with(p, level)
    for spelled in (p, f"/{p}", f"/{p}/"):
        assert ids(path, foo={"query": spelled, "level": level}) == want
    assert ids(path, foo={"query": [(p, level)]}) == want


def test_path_operators(path):
    lib, src = set(paths_with("lib", 0)), set(paths_with("src", 1))
    assert ids(path, foo={"query": [("lib", 0), ("src", 1)]}) == sorted(lib | src)
    assert ids(path, foo={"query": [("lib", 0), ("src", 1)], "operator": "and"}) == sorted(lib & src)
    assert ids(path, foo={"query": ["lib", "src"], "level": 1}) == sorted({*paths_with("lib", 1), *paths_with("src", 1)})


def test_topic(spark):
    rows = [(i, i % 7 if i % 5 else None) for i in range(30)]
    sets = {"low": "n < 3", "odd": "n % 2 = 1", "none": "n > 99"}
    c = make(spark, rows, "id int, n int", "topic", sets=sets)
    low, odd = ([i for i, n in rows if n is not None and t(n)] for t in (lambda n: n < 3, lambda n: n % 2 == 1))
    assert ids(c, foo="low") == low and ids(c, foo=["low", "odd"]) == sorted({*low, *odd}) and ids(c, foo=["none", "nope"]) == [] == ids(c, foo="nope")
    assert ids(c, foo={"query": ["low", "odd"], "operator": "and"}) == sorted({*low} & {*odd})
    assert [r.n for r in c.num_objects("foo").collect()] == [len({*low, *odd})]
    assert sorted(map(tuple, c.unique_values("foo", True).collect())) == [("low", len(low)), ("none", 0), ("odd", len(odd))]


def test_composite_equals_conjunction(spark):
    rows = [(i, f"t{i % 3}", f"s{i % 4}", [f"k{i % 5}", f"k{i % 7}"]) for i in range(200)]
    spec = CatalogSpec("id").add_index("type", "field").add_index("state", "field").add_index("words", "keyword").add_index("all", "composite", "type", "state", "words")
    c = Catalog.of(spark.createDataFrame(rows, "id int, type string, state string, words array<string>"), spec)
    for q in ({"type": "t1", "state": ["s0", "s2"]}, {"type": ["t0", "t1"], "words": {"query": ["k1", "k6"], "not": "k3"}}, {"type": "t1", "state": "s1", "words": "k2"}):
        assert ids(c, all=q) == ids(c, **q)
    with pytest.raises(CatalogError):
        ids(c, all={"nope": 1})
