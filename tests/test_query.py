import pytest

from tesserae.errors import CatalogError, ParseError
from tesserae.operators.parser import And, Glob, Not, Or, Phrase, Word, parse, terms
from tesserae.functions.text import DEFAULT, Pipeline, StopWordRemover, element_groups, element_names, register
from tesserae.plans.query import IndexQuery, SortOrder, Window, canonical, merged
from tesserae.plans.report import QueryReport
from tesserae.plans.specs import CatalogSpec

ALLOWED = ("query", "range", "not", "operator")


def of(request, name="foo", operators=("or", "and")):
    return IndexQuery.of(request, name, ALLOWED, operators)


@pytest.mark.parametrize("request_, keys", [({"foo": "x"}, ("x",)), ({"foo": ["x", "y"]}, ("x", "y")), ({"foo": {"query": 1}}, (1,)), ({"foo": {"query": (1, 2)}}, (1, 2)), ({"foo": {}}, ()), ({"foo": None}, (None,))])
def test_keys(request_, keys):
    assert of(request_).keys == keys


def test_absent_index():
    assert of({"bar": 1}) is None


def test_options():
    q = of({"foo": {"query": [1, 2], "range": "min:max", "not": 3, "operator": "AND"}})
    assert q.range == {"min", "max"} and q.nots == (3,) and q.operator == "and"


def test_old_style_options_belong_to_the_index():
    q = of({"foo": [1, 2], "foo_range": "min", "foo_operator": "and"})
    assert q.range == {"min"} and q.operator == "and"
    with pytest.raises(ValueError, match="option 'sort'"):
        of({"foo": 1, "foo_sort": 2})


def test_usage_is_only_for_kinds_that_allow_it():
    with pytest.raises(ValueError):
        of({"foo": {"query": 1, "usage": "range:min"}})
    assert IndexQuery.of({"foo": {"query": 1, "usage": "range:min:max"}}, "foo", (*ALLOWED, "usage")).range == {"min", "max"}


def test_invalid_option_and_operator():
    with pytest.raises(ValueError):
        of({"foo": {"query": 1, "nope": 1}})
    with pytest.raises(ValueError):
        of({"foo": {"query": 1, "operator": "xor"}})


def test_merge_and_canonical():
    assert merged({"a": 1, "b": 2}, {"b": 3}) == {"a": 1, "b": 3}
    assert canonical({"a": (3, 1, 2), "b": {"query": (2, 1)}}) == {"a": [1, 2, 3], "b": {"query": (2, 1)}}


@pytest.mark.parametrize("request_, names, down", [
    ({"sort_on": "a"}, ("a",), (False,)), ({"sort-on": "a", "sort_on": "b"}, ("a",), (False,)), ({"sort_on": "a", "sort_order": "Descending"}, ("a",), (True,)),
    ({"sort_on": ("a", "b"), "sort_order": "reverse"}, ("a", "b"), (True, True)), ({"sort_on": ("a", "b"), "sort_order": ("", "reverse")}, ("a", "b"), (False, True)),
    ({"sort_on": ("a", "b"), "sort_order": ("reverse", "", "reverse")}, ("a", "b"), (True, False))])
def test_sort_order(request_, names, down):
    order = SortOrder.of(request_)
    assert order.names == names and order.descending == down


def test_no_sort_order():
    assert SortOrder.of({}) is None


@pytest.mark.parametrize("request_, start, stop", [({}, 0, None), ({"b_start": 11, "b_size": 17}, 11, 28), ({"b_start": -5, "b_size": 8}, 0, 3), ({"b_size": 5}, 0, 5), ({"sort_limit": 10}, 0, 10), ({"b_start": 4}, 4, None)])
def test_window(request_, start, stop):
    assert Window.of(request_) == Window(start, stop)


def tree(text):
    return parse(text, DEFAULT.query_words).tree


A, B, C = Word("foo"), Word("bar"), Word("ham")


@pytest.mark.parametrize("text, want", [
    ("foo", A), ("Foo BAR", And((A, B))), ("foo and bar", And((A, B))), ("foo or bar", Or((A, B))), ("foo AND bar OR ham", Or((And((A, B)), C))),
    ("foo AND (bar OR ham)", And((A, Or((B, C))))), ("foo AND NOT bar", And((A, Not(B)))), ("foo -bar", And((A, Not(B)))), ("-foo bar", And((B, Not(A)))),
    ('"foo bar"', Phrase(("foo", "bar"))), ("foo-bar", Phrase(("foo", "bar"))), ('foo -"bar ham"', And((A, Not(Phrase(("bar", "ham")))))),
    ("foo -bar-ham", And((A, Not(Phrase(("bar", "ham")))))), ("foo*", Glob("foo*")), ("fo?", Glob("fo?")), ("foo the", A), ("the OR foo", A),
    ("foo AND NOT the", A), ("((foo))", A), ('""foo', A), ("foo　bar", And((A, B)))])
def test_trees(text, want):
    assert tree(text) == want


@pytest.mark.parametrize("text", ["", "the", "the and a", "-foo", "NOT foo", "foo AND", "foo OR", "(foo", "foo)", "foo NOT bar", "()", "(foo) bar", "OR foo", "foo AND AND bar", "-foo -bar", '""'])
def test_rejected(text):
    with pytest.raises(ParseError):
        tree(text)


def test_ignored_and_terms():
    found = parse("foo the a bar", DEFAULT.query_words)
    assert found.ignored == ("the", "a") and terms(found.tree) == ["foo", "bar"]
    assert terms(tree('foo AND NOT bar AND "ham foo"')) == ["foo", "ham", "foo"]


def test_pipeline_registry():
    assert "Word Splitter" in element_groups() and "Case Normalizer" in element_names("Case Normalizer")
    with pytest.raises(ValueError):
        register("Case Normalizer", "Case Normalizer", StopWordRemover)
    made = Pipeline.of([("Case Normalizer", "Case Normalizer"), ("Word Splitter", "Whitespace splitter"), ("Stop Words", "Remove listed and single char words")])
    assert made.query_words("The Big x é Δ") == ["big", "δ"]


def test_specs():
    spec = CatalogSpec("id").add_column(" a ").add_index("b", "field")
    assert list(spec.columns) == ["a"] and spec.named() == ["b"]
    for bad in ("", "_x", "a"):
        with pytest.raises(CatalogError):
            spec.add_column(bad)
    with pytest.raises(CatalogError):
        spec.add_index("b", "field")
    with pytest.raises(CatalogError):
        spec.add_index("c", "nope")
    assert spec.del_column("a").del_index("b") == CatalogSpec("id")
    with pytest.raises(CatalogError):
        spec.del_index("nope")


def test_report():
    r = QueryReport(threshold=0.5)
    key = r.shape({"b": 1, "a": {"not": 2}, "c": True}, ["c"])
    assert key == ("b", ("a", "not"), ("c", "True"))
    r.record(key, 0.2)
    r.record(key, 1.0)
    assert [x["counter"] for x in r.report()] == [1] and r.plan[key].hits == 2
    again = QueryReport()
    again.load(r.dump())
    assert again.plan[key].mean == pytest.approx(0.6)
    with pytest.raises(ValueError):
        again.load("__import__('os')")
    r.reset()
    assert r.report() == []
