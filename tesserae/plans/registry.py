"""Registered queries of the catalog engine with the SQL that must give the same rows.

Keys are the operators of the inventory; each query runs over whole tables.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.catalog import Catalog
from tesserae.functions import text as pipelines
from tesserae.operators import merging, textsearch
from tesserae.plans.specs import CatalogSpec
from tesserae.sources import find as finding
from tesserae.sources import maintenance

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return put


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# -- catalogs over the driver's tables

#: Catalogs whose tables ``prepare`` has stored, by function, folder and options.
_PREPARED: dict[tuple, Catalog] = {}


def _catalogued(make: Callable) -> Callable:
    @functools.wraps(make)
    def catalog(spark, d, **how):
        held = _PREPARED.get((make.__name__, d, *sorted((k, repr(v)) for k, v in how.items())))
        return held or make(spark, d, **how)

    return catalog


def prepare(spark: SparkSession, d: str, path: str) -> None:
    """Store every catalog's table, as a catalog that serves many queries would be kept."""
    for name, make, how in [(n, c, {}) for n, c in CATALOGS.items()] + [("supplier", suppliers, {}), ("cosine", documents, {"scorer": "cosine"})]:
        stored = maintenance.save(make(spark, d, **how), f"{path}/{name}")
        _PREPARED[(make.__name__, d, *sorted((k, repr(v)) for k, v in how.items()))] = stored


@_catalogued
def orders(spark, d) -> Catalog:
    spec = CatalogSpec("o_orderkey")
    for c in ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"):
        spec = spec.add_column(c)
    for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"):
        spec = spec.add_index(c, "field")
    spec = spec.add_index("status_or_none", "field", lambda: F.nullif(F.col("o_orderstatus"), F.lit("P")))
    spec = spec.add_index("priority_or_none", "field", lambda: F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")))
    spec = spec.add_index("placed", "date", "o_orderdate").add_index("placed_hours", "date", "o_orderdate", precision=60)
    spec = spec.add_index("both", "composite", "o_orderstatus", "o_orderpriority")
    return Catalog.of(_read(spark, d, "orders"), spec)


@_catalogued
def parts(spark, d) -> Catalog:
    spec = CatalogSpec("p_partkey").add_column("p_partkey").add_column("p_name")
    words = lambda: F.split("p_name", " ")
    spec = spec.add_index("words", "keyword", words).add_index("brand", "field", "p_brand").add_index("size", "field", "p_size")
    spec = spec.add_index("some_words", "keyword", lambda: F.when(F.col("p_size") > 10, F.split("p_name", " ")))
    spec = spec.add_index("brand_words", "composite", "brand", "words")
    return Catalog.of(_read(spark, d, "part"), spec)


@_catalogued
def labels(spark, d) -> Catalog:
    spec = CatalogSpec("doc_id").add_column("doc_id").add_column("toxic").add_index("toxic", "boolean").add_index("quality", "boolean")
    spec = spec.add_index("good", "boolean", lambda: F.nullif(F.col("quality"), F.lit(0)), present=lambda: F.col("toxic") == 0)
    return Catalog.of(_read(spark, d, "labels"), spec)


@_catalogued
def events(spark, d) -> Catalog:
    spec = CatalogSpec("event_id").add_column("event_id").add_column("event_type").add_index("value", "field").add_index("type", "field", "event_type")
    spec = spec.add_index("ts", "date").add_index("ts10", "date", "ts", precision=10).add_index("user", "uuid", "user_id")
    sets = {"click": "event_type = 'click'", "big": "value > 50", "early": "ts < timestamp_ntz '2024-01-10'", "both": "event_type = 'purchase' and value > 50"}
    spec = spec.add_index("topics", "topic", sets=sets)
    return Catalog.of(_read(spark, d, "events"), spec)


@_catalogued
def lines(spark, d) -> Catalog:
    rid = lambda: F.col("l_orderkey") * 10 + F.col("l_linenumber")
    open_until = lambda: F.when(F.col("l_linestatus") == "F", F.expr("l_shipdate + interval 30 days"))
    open_since = lambda: F.when(F.col("l_returnflag") != "R", F.col("l_shipdate"))
    spec = CatalogSpec(rid).add_column("l_orderkey").add_column("l_linenumber").add_index("l_quantity", "field").add_index("l_discount", "field")
    spec = spec.add_index("active", "daterange", open_since, open_until)
    spec = spec.add_index("active_floor", "daterange", "l_shipdate", open_until, floor=12_700_000, ceiling=13_800_000, precision=1440)
    return Catalog.of(_read(spark, d, "lineitem"), spec)


@_catalogued
def pages(spark, d) -> Catalog:
    path = lambda: F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    spec = CatalogSpec("page_id", path).add_column("page_id").add_index("path", "path", path)
    spec = spec.add_index("html", "text", pipeline=pipelines.HTML)
    return Catalog.of(_read(spark, d, "pages"), spec)


@_catalogued
def documents(spark, d, scorer="okapi", pipeline=pipelines.PLAIN) -> Catalog:
    spec = CatalogSpec("doc_id").add_column("doc_id").add_column("lang").add_index("lang", "field").add_index("n_chars", "field")
    spec = spec.add_index("text", "text", pipeline=pipeline, scorer=scorer).add_index("source", "field")
    return Catalog.of(_read(spark, d, "documents"), spec)


@_catalogued
def customers(spark, d) -> Catalog:
    spec = CatalogSpec("c_custkey", "c_name").add_column("name", "c_name").add_column("balance", "c_acctbal")
    spec = spec.add_index("name", "uuid", "c_name").add_index("nation", "field", "c_nationkey").add_index("balance", "field", "c_acctbal")
    return Catalog.of(_read(spark, d, "customer"), spec)


@_catalogued
def suppliers(spark, d) -> Catalog:
    spec = CatalogSpec("s_suppkey", "s_name").add_column("name", "s_name").add_column("balance", "s_acctbal")
    spec = spec.add_index("name", "uuid", "s_name").add_index("nation", "field", "s_nationkey").add_index("balance", "field", "s_acctbal")
    return Catalog.of(_read(spark, d, "supplier"), spec)


@_catalogued
def nations(spark, d) -> Catalog:
    regions = _read(spark, d, "region")
    rows = _read(spark, d, "nation").join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey"))
    path = lambda: F.concat(F.lit("/"), F.col("r_name"), F.lit("/"), F.col("n_name"))
    return Catalog.of(rows, CatalogSpec("n_nationkey", path).add_column("n_name").add_index("path", "path", path))


CATALOGS = {"orders": orders, "part": parts, "labels": labels, "events": events, "lineitem": lines, "pages": pages, "documents": documents, "customer": customers, "nation": nations}


def search(name: str, catalog: Callable, request: dict, column: str, condition: str) -> None:
    """A search whose selected ids must be those of a SQL condition."""
    table = {v: k for k, v in CATALOGS.items()}[catalog]
    rid = {"lineitem": "l_orderkey * 10 + l_linenumber"}.get(table, column)

    def run(spark, d):
        return catalog(spark, d).search(request).df.select(F.col("data_record_id_").alias("rid"))

    query(f"SELECT ({rid})::BIGINT AS rid FROM {table} WHERE {condition}", name)(run)


O, P, L, E = "o_orderkey", "p_partkey", "doc_id", "event_id"
W = "string_split(p_name, ' ')"
SOME = f"CASE WHEN p_size > 10 THEN {W} END"
S0, P0 = "nullif(o_orderstatus, 'P')", "nullif(o_orderpriority, '5-LOW')"
BIGINT = "::BIGINT"

# P1-P15
search("field_eq", orders, {"o_orderstatus": "F"}, O, "o_orderstatus = 'F'")
search("field_in", orders, {"o_orderpriority": ["1-URGENT", "5-LOW"]}, O, "o_orderpriority IN ('1-URGENT', '5-LOW')")
search("field_and_fields", orders, {"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "2-HIGH"], "o_custkey": {"query": 500, "range": "max"}}, O, "o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey <= 500")
search("range_min", orders, {"o_totalprice": {"query": 200000.0, "range": "min"}}, O, "o_totalprice >= 200000")
search("range_max", orders, {"o_totalprice": {"query": (50000.0, 20000.0), "range": "max"}}, O, "o_totalprice <= 50000")
search("range_minmax", orders, {"o_totalprice": {"query": (100000.0, 120000.0, 150000.0), "range": "min:max"}}, O, "o_totalprice BETWEEN 100000 AND 150000")
search("range_old_style", orders, {"o_totalprice": (100000.0, 150000.0), "o_totalprice_range": "min:max"}, O, "o_totalprice BETWEEN 100000 AND 150000")
search("range_max_zero_quirk", events, {"value": {"query": 0, "range": "max"}}, E, "value IS NOT NULL")
search("range_min_zero_max_quirk", events, {"value": {"query": (-1.0, 0.0), "range": "min:max"}}, E, "value >= -1")
search("range_not", orders, {"o_custkey": {"query": (10, 40), "range": "min:max", "not": [20, 30]}}, O, "o_custkey BETWEEN 10 AND 40 AND o_custkey NOT IN (20, 30)")
search("range_pure_not", orders, {"status_or_none": {"range": "min:max", "not": "F"}}, O, f"{S0} BETWEEN (SELECT min({S0}) FROM orders WHERE {S0} <> 'F') AND (SELECT max({S0}) FROM orders WHERE {S0} <> 'F') AND {S0} <> 'F'")
search("not_with_query", orders, {"o_orderstatus": {"query": ["F", "O"], "not": "O"}}, O, "o_orderstatus = 'F'")
_NOT = "CASE WHEN EXISTS (SELECT 1 FROM orders WHERE {x} IN ({k})) THEN coalesce({x} NOT IN ({k}), true) ELSE {x} IS NOT NULL END"
search("not_pure", orders, {"status_or_none": {"not": "F"}}, O, _NOT.format(x=S0, k="'F'"))
search("not_pure_absent_value", orders, {"status_or_none": {"not": ["X", "Y"]}}, O, _NOT.format(x=S0, k="'X', 'Y'"))
search("not_pure_and_field", orders, {"status_or_none": {"not": ["F", "X"]}, "o_orderpriority": "5-LOW"}, O, _NOT.format(x=S0, k="'F', 'X'") + " AND o_orderpriority = '5-LOW'")
search("null_key", orders, {"o_orderstatus": None}, O, "false")
search("null_among_keys", orders, {"o_orderstatus": {"query": [None, "P"]}}, O, "o_orderstatus = 'P'")
search("empty_keys", orders, {"o_orderstatus": []}, O, "false")
search("empty_query", orders, {}, O, "false")
search("unknown_key", orders, {"nope": 1, "o_orderstatus": "P"}, O, "o_orderstatus = 'P'")
search("only_unknown_keys", orders, {"nope": 1}, O, "false")
search("sort_on_alone", orders, {"sort_on": "o_totalprice"}, O, "false")

# I2, P3, P7
search("keyword_or", parts, {"words": ["red", "blue"]}, P, f"list_has_any({W}, ['red', 'blue'])")
search("keyword_one", parts, {"words": "green"}, P, f"list_contains({W}, 'green')")
search("keyword_and", parts, {"words": {"query": ["red", "widget"], "operator": "and"}}, P, f"list_has_all({W}, ['red', 'widget'])")
search("keyword_and_missing", parts, {"words": {"query": ["red", "no-such-word"], "operator": "and"}}, P, "false")
search("keyword_range", parts, {"words": {"query": ("b", "c"), "range": "min:max"}}, P, f"len(list_filter({W}, lambda x: x BETWEEN 'b' AND 'c')) > 0")
search("keyword_range_and", parts, {"words": {"query": ("a", "c"), "range": "min:max", "operator": "and"}}, P, f"len(list_filter(list_distinct({W}), lambda x: x BETWEEN 'a' AND 'c')) = (SELECT count(DISTINCT w) FROM (SELECT unnest({W}) AS w FROM part) WHERE w BETWEEN 'a' AND 'c') AND len(list_filter({W}, lambda x: x BETWEEN 'a' AND 'c')) > 0")
search("keyword_not_with_query", parts, {"words": {"query": ["red", "blue"], "not": "widget"}}, P, f"list_has_any({W}, ['red', 'blue']) AND NOT list_contains({W}, 'widget')")
search("keyword_not", parts, {"some_words": {"not": ["red", "blue"]}}, P, f"coalesce(NOT list_has_any({SOME}, ['red', 'blue']), true)")
search("keyword_not_absent", parts, {"some_words": {"not": "no-such-word"}}, P, "p_size > 10")

# I3
search("bool_true", labels, {"toxic": True}, L, "toxic = 1")
search("bool_false", labels, {"toxic": 0}, L, "toxic = 0")
search("bool_first_key", labels, {"toxic": [False, True]}, L, "toxic = 0")
search("bool_null_is_false", labels, {"good": False}, L, "toxic = 0 AND quality = 0")

# I4, F1
_CODE = "(((year({t}) * 12 + month({t})) * 31 + day({t})) * 24 + hour({t})) * 60 + minute({t})"
_TS, _OD = _CODE.format(t="ts"), _CODE.format(t="o_orderdate")
search("date_eq_minute", events, {"ts": {"query": ["2024-01-05T10:11:00", "2024-01-07T00:30:59"]}}, E, "date_trunc('minute', ts) IN (TIMESTAMP '2024-01-05 10:11:00', TIMESTAMP '2024-01-07 00:30:00')")
search("date_range", events, {"ts": {"query": ("2024-01-05", "2024-01-09T12:00:00"), "range": "min:max"}}, E, "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09 12:01:00'")
search("date_precision", events, {"ts10": "2024-01-05T10:17:00"}, E, f"({_TS}) - ({_TS}) % 10 = (((2024 * 12 + 1) * 31 + 5) * 24 + 10) * 60 + 10")
search("date_epoch_seconds", events, {"ts": {"query": 1704500000, "range": "min"}}, E, "ts >= TIMESTAMP '2024-01-06 00:13:00'")
search("date_not", orders, {"placed_hours": {"query": ("1995-01-01", "1995-03-01"), "range": "min:max", "not": "1995-02-01"}}, O, "date_trunc('hour', o_orderdate) BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-01' AND date_trunc('hour', o_orderdate) <> TIMESTAMP '1995-02-01'")

# I5, F2, F4
_SINCE, _UNTIL = "CASE WHEN l_returnflag <> 'R' THEN l_shipdate END", "CASE WHEN l_linestatus = 'F' THEN l_shipdate + INTERVAL 30 DAY END"
_MIN = "(epoch({x}) // 60)::BIGINT"
_STAB = "({s} IS NULL OR {s} <= {t}) AND ({u} IS NULL OR {u} >= {t})"
search("daterange_stab", lines, {"active": "1995-06-17"}, "", _STAB.format(s=_SINCE, u=_UNTIL, t="TIMESTAMP '1995-06-17'"))
search("daterange_open", lines, {"active": 13_500_000}, "", _STAB.format(s=_MIN.format(x=f"({_SINCE})"), u=_MIN.format(x=f"({_UNTIL})"), t="13500000"))
_FLOOR = "CASE WHEN {m} - {m} % 1440 BETWEEN 12700000 AND 13800000 THEN {m} - {m} % 1440 END"
search("daterange_floor_ceiling", lines, {"active_floor": 13_000_000}, "", _STAB.format(s=_FLOOR.format(m=_MIN.format(x="l_shipdate")), u=_FLOOR.format(m=_MIN.format(x=f"({_UNTIL})")), t=str(13_000_000 - 13_000_000 % 1440)))
search("daterange_outside", lines, {"active_floor": 99_000_000}, "", "true")
search("daterange_and_range", lines, {"active": "1997-01-01", "l_quantity": {"query": 45.0, "range": "min"}}, "", _STAB.format(s=_SINCE, u=_UNTIL, t="TIMESTAMP '1997-01-01'") + " AND l_quantity >= 45")

# I6, F5
_PATH = "list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/'), lambda x: x <> '')"
_AT = "coalesce(list_slice({p}, {l} + 1, {l} + {n}) = {k}, false)"
search("path_level0", pages, {"path": {"query": "tionsh.example.net", "level": 0}}, "page_id", _AT.format(p=_PATH, l=0, n=1, k="['tionsh.example.net']"))
search("path_level1", pages, {"path": {"query": "/en/", "level": 1}}, "page_id", _AT.format(p=_PATH, l=1, n=1, k="['en']"))
search("path_run", pages, {"path": ("tionsh.example.net/fr",)}, "page_id", _AT.format(p=_PATH, l=0, n=2, k="['tionsh.example.net', 'fr']"))
search("path_any", pages, {"path": {"query": "de", "level": -1}}, "page_id", f"list_contains({_PATH}, 'de')")
search("path_any_run", pages, {"path": {"query": "tionsh.example.net/es", "level": -1}}, "page_id", f"contains('/' || array_to_string({_PATH}, '/') || '/', '/tionsh.example.net/es/')")
search("path_or", pages, {"path": {"query": ["de", ("tionsh.example.net", 0)], "level": 1}}, "page_id", _AT.format(p=_PATH, l=1, n=1, k="['de']") + " OR " + _AT.format(p=_PATH, l=0, n=1, k="['tionsh.example.net']"))
search("path_and", pages, {"path": {"query": [("tionsh.example.net", 0), ("en", 1)], "operator": "and"}}, "page_id", _AT.format(p=_PATH, l=1, n=1, k="['en']") + " AND " + _AT.format(p=_PATH, l=0, n=1, k="['tionsh.example.net']"))
search("path_root", pages, {"path": "/"}, "page_id", "url IS NOT NULL")
search("path_too_deep", pages, {"path": {"query": "en", "level": 9}}, "page_id", "false")

# I7
_T = {"click": "event_type = 'click'", "big": "value > 50", "early": "ts < TIMESTAMP '2024-01-10'"}
search("topic_or", events, {"topics": ["click", "early"]}, E, f"{_T['click']} OR {_T['early']}")
search("topic_and", events, {"topics": {"query": ["click", "big", "early"], "operator": "and"}}, E, f"{_T['click']} AND {_T['big']} AND {_T['early']}")
search("topic_unknown", events, {"topics": {"query": ["click", "nope"], "operator": "and"}}, E, _T["click"])
search("topic_only_unknown", events, {"topics": "nope"}, E, "false")

# I8
search("uuid_lookup", customers, {"name": ["Customer#000000007", "Customer#000000042"]}, "c_custkey", "c_name IN ('Customer#000000007', 'Customer#000000042')")
_FIRST = "event_id = (SELECT min(e.event_id) FROM events e WHERE e.user_id = events.user_id)"
search("uuid_duplicate", events, {"user": [3, 5]}, E, f"user_id IN (3, 5) AND {_FIRST}")
search("uuid_range", events, {"user": {"query": (10, 20), "range": "min:max"}}, E, f"user_id BETWEEN 10 AND 20 AND {_FIRST}")

# I9, Q1
search("composite_equiv", orders, {"both": {"o_orderstatus": ["F", "P"], "o_orderpriority": "1-URGENT"}}, O, "o_orderstatus IN ('F', 'P') AND o_orderpriority = '1-URGENT'")
search("composite_not", orders, {"both": {"o_orderstatus": ["F", "P"], "o_orderpriority": {"query": ["1-URGENT", "2-HIGH"], "not": "2-HIGH"}}}, O, "o_orderstatus IN ('F', 'P') AND o_orderpriority = '1-URGENT'")
search("composite_keyword", parts, {"brand_words": {"brand": "Brand#13", "words": ["red", "green"]}}, P, f"p_brand = 'Brand#13' AND list_has_any({W}, ['red', 'green'])")


# -- text: T1-T30

_WORDS = r"list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: lower(w))"
_STOPPED = f"list_filter({_WORDS}, lambda w: w NOT IN ({', '.join(repr(w) for w in pipelines.STOP_WORDS)}))"
_HTML = r"list_filter(regexp_extract_all(regexp_replace(regexp_replace(lower(html), '<[^<>]*>', ' ', 'g'), '&[A-Za-z]+;', ' ', 'g'), '[\p{L}\p{N}_]+'), lambda w: w NOT IN (" + ", ".join(repr(w) for w in pipelines.STOP_WORDS) + "))"
_OKAPI = "floor(f * 2.2e0 / (f + 1.2e0 * (0.25e0 + 0.75e0 * len / mean)) * ln(1e0 + n / df) * 1024e0 + 0.5e0)::BIGINT"
_COSINE = "floor((1e0 + ln(f)) / wt * 1024e0 + 0.5e0)::BIGINT * floor(ln(1e0 + n / df) * 1024e0 + 0.5e0)::BIGINT"


def postings_sql(words: str = _WORDS, table: str = "documents", rid: str = "doc_id", text: str = "text", formula: str = _OKAPI) -> str:
    weight = "sqrt(sum((1e0 + ln(f)) * (1e0 + ln(f))) OVER (PARTITION BY rid))" if formula == _COSINE else "1e0"
    return f"""WITH tok AS (SELECT {rid} AS rid, {words} AS ws FROM {table} WHERE {text} IS NOT NULL),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(ws)) AS mean FROM tok),
occ AS (SELECT rid, len(ws)::DOUBLE AS len, unnest(ws) AS w FROM tok),
post0 AS (SELECT rid, len, w, count(*)::DOUBLE AS f FROM occ GROUP BY ALL),
post AS (SELECT *, {weight} AS wt, count(*) OVER (PARTITION BY w)::DOUBLE AS df FROM post0),
sc AS (SELECT rid, w, {formula} AS s FROM post, st)"""


def text_sql(terms: list[str], score: str, where: str, phrases: tuple[str, ...] = (), last: str = "SELECT rid, score FROM r", **how) -> str:
    """``terms`` are conditions on w, giving t0, t1 ... (null if none matches); phrases give p0, p1 ..."""
    columns = "".join(f", sum(s) FILTER (WHERE {c})::BIGINT AS t{i}" for i, c in enumerate(terms))
    flags = "".join(f", contains(' ' || array_to_string(ws, ' ') || ' ', ' {p} ') AS p{i}" for i, p in enumerate(phrases))
    return postings_sql(**how) + f""",
t AS (SELECT rid{columns} FROM sc GROUP BY rid), b AS (SELECT t.*{flags} FROM t JOIN tok USING (rid)),
r AS (SELECT rid, {score} AS score FROM b WHERE {where}) {last}"""


def text(name: str, q: str, sql: str, catalog: Callable = documents, index: str = "text", **more) -> None:
    def run(spark, d):
        return catalog(spark, d).search({index: q, **more}).df.select(F.col("data_record_id_").alias("rid"), F.col("data_record_score_").alias("score"))

    query(sql, name)(run)


def cosine(spark, d):
    return documents(spark, d, scorer="cosine")


def stopped(spark, d):
    return documents(spark, d, pipeline=pipelines.DEFAULT)


T2, ALL2 = ["w = 'the'", "w = 'ening'"], "t0 IS NOT NULL AND t1 IS NOT NULL"
SOME2, SUM2 = "t0 IS NOT NULL OR t1 IS NOT NULL", "coalesce(t0, 0) + coalesce(t1, 0)"
text("text_term", "the", text_sql(T2[:1], "t0", "t0 IS NOT NULL"))
text("text_and", "the AND ening", text_sql(T2, "t0 + t1", ALL2))
text("text_implied_and", "the ening", text_sql(T2, "t0 + t1", ALL2))
text("text_or", "the or ening", text_sql(T2, SUM2, SOME2))
text("text_not", "the AND NOT ening", text_sql(T2, "t0", "t0 IS NOT NULL AND t1 IS NULL"))
text("text_hyphen_not", "the -ening", text_sql(T2, "t0", "t0 IS NOT NULL AND t1 IS NULL"))
text("text_or_dup", "ening OR ening OR ening", text_sql(T2[1:], "3 * t0", "t0 IS NOT NULL"))
text("text_nested", "(the OR la) AND NOT (ening OR token)", text_sql(["w = 'the'", "w = 'la'", "w = 'ening'", "w = 'token'"], SUM2, f"({SOME2}) AND t2 IS NULL AND t3 IS NULL"))
text("text_phrase", '"of the"', text_sql(["w = 'of'", "w = 'the'"], "t0 + t1", ALL2 + " AND p0", ("of the",)))
text("text_phrase_by_punctuation", "in-the", text_sql(["w = 'in'", "w = 'the'"], "t0 + t1", ALL2 + " AND p0", ("in the",)))
text("text_phrase_not", 'the -"of the"', text_sql(["w = 'the'"], "t0", "t0 IS NOT NULL AND NOT p0", ("of the",)))
text("text_glob", "token*", text_sql(["w LIKE 'token%'"], "t0", "t0 IS NOT NULL"))
text("text_glob_one_char", "th?", text_sql(["regexp_full_match(w, 'th.')"], "t0", "t0 IS NOT NULL"))
text("text_glob_and", "lic* AND the", text_sql(["w LIKE 'lic%'", "w = 'the'"], "t0 + t1", ALL2))
text("text_oov_and", "the nosuchword", text_sql(T2[:1], "t0", "false"))
text("text_oov_or", "nosuchword OR ening", text_sql(T2[1:], "t0", "t0 IS NOT NULL"))
text("text_oov_phrase", '"the nosuchword"', text_sql(T2[:1], "t0", "false"))
text("text_empty", "", text_sql(T2[:1], "t0", "false"))
text("text_stop_words", "the ening of", text_sql(["w = 'ening'"], "t0", "t0 IS NOT NULL", words=_STOPPED), stopped)
text("text_html", "onnt OR heed", text_sql(["w = 'onnt'", "w = 'heed'"], SUM2, SOME2, words=_HTML, table="pages", rid="page_id", text="html"), pages, "html")
text("cosine_or", "the OR ening", text_sql(T2, SUM2, SOME2, formula=_COSINE), cosine)
text("text_and_field", "the AND ening", text_sql(T2, "t0 + t1", ALL2 + " AND rid IN (SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars >= 2000)"), lang="en", n_chars={"query": 2000, "range": "min"})
text("text_topk", "the OR ening", text_sql(T2, SUM2, SOME2, last="SELECT rid, score FROM r ORDER BY score DESC, rid DESC LIMIT 10"), sort_limit=10)
text("text_batch", "the OR ening", text_sql(T2, SUM2, SOME2, last="SELECT rid, score FROM r ORDER BY score DESC, rid DESC LIMIT 7 OFFSET 5"), b_start=5, b_size=7)
text("text_sorted", "the AND ening", text_sql(T2, "1::BIGINT", ALL2), sort_on="n_chars")


@query(text_sql(T2, SUM2, SOME2, last="SELECT rid, score, floor(100e0 * score / (SELECT max(score) FROM r))::BIGINT AS norm FROM r ORDER BY score DESC, rid DESC LIMIT 20"))
def norm_score(spark, d):
    found = documents(spark, d).search({"text": "the OR ening", "sort_limit": 20}).df
    return found.select(F.col("data_record_id_").alias("rid"), F.col("data_record_score_").alias("score"), F.col("data_record_normalized_score_").alias("norm"))


@query(postings_sql() + ", q(w) AS (VALUES ('the'), ('ening'), ('the')) SELECT sum(floor(ln(1e0 + n / df) * 2.2e0 * 1024e0 + 0.5e0))::BIGINT AS weight FROM q JOIN (SELECT DISTINCT w, df FROM post) USING (w), st")
def query_weight_okapi(spark, d):
    return documents(spark, d).query_weight("text", "the OR ening OR the")


@query(postings_sql() + ", q(w) AS (VALUES ('the'), ('ening')) SELECT floor(sqrt(sum(pow(ln(1e0 + n / df), 2))) * 1024e0 + 0.5e0)::BIGINT AS weight FROM q JOIN (SELECT DISTINCT w, df FROM post) USING (w), st")
def query_weight_cosine(spark, d):
    return cosine(spark, d).query_weight("text", "the OR ening -token")


@query(postings_sql() + " SELECT w AS word, max(df)::BIGINT AS df FROM post WHERE w LIKE 'th%' GROUP BY w ORDER BY w LIMIT 50 OFFSET 20")
def lexicon_page(spark, d):
    return documents(spark, d).lexicon("text", "th*", 20, 50)


@query(postings_sql() + " SELECT w AS word, rid, f::BIGINT AS f, len::INT AS length, round(sqrt(sum((1e0 + ln(f)) * (1e0 + ln(f))) OVER (PARTITION BY rid)), 6) AS weight FROM post")
def postings_table(spark, d):
    c = documents(spark, d)
    return c.kind("text").postings(c.rows).withColumn("weight", F.round("weight", 6))


@query(f"SELECT (i - 1)::INT AS position, ws[i] AS word FROM (SELECT {_WORDS} AS ws FROM documents WHERE doc_id = 7), range(1, 100000) r(i) WHERE i <= len(ws)")
def document_words(spark, d):
    return documents(spark, d).document_words("text", 7)


@query(postings_sql() + " SELECT count(DISTINCT w) AS words, (SELECT count(*) FROM tok) AS docs FROM post")
def text_index_stats(spark, d):
    c = documents(spark, d)
    return c.num_objects("text").withColumnRenamed("n", "words").join(F.broadcast(c.index_size("text").withColumnRenamed("n", "docs")))


@query(text_sql(T2, "coalesce(t0, 0) * 2 + coalesce(t1, 0) * 3", SOME2))
def weighted_union(spark, d):
    return _weighted(spark, d, "union")


@query(text_sql(T2, "coalesce(t0, 0) * 2 + coalesce(t1, 0) * 3", ALL2))
def weighted_intersection(spark, d):
    return _weighted(spark, d, "intersection")


def _weighted(spark, d, how):
    c = documents(spark, d)
    kind = c.kind("text")
    one = lambda w: kind.matches(textsearch.Word(w), c.rows)
    return textsearch.weighted([(one("the"), 2), (one("ening"), 3)], how)


# -- sorting, limits, batches: O1-O19


def _placed(found: DataFrame, columns: str) -> DataFrame:
    """``found`` with each row's place in its order; no row leaves the executors.

    ``columns`` names and types those of ``found``. Spark sorts into ranges; a row's place is
    that in its range and the sizes of the ranges before.
    """
    placed = found.rdd.zipWithIndex().map(lambda x: (x[1], *x[0]))
    return found.sparkSession.createDataFrame(placed, f"position long, {columns}")


def ordered(name: str, request: dict, sql: str, catalog: Callable = orders) -> None:
    """The order counts: ``position`` is each row's place. All rows that the request gives are returned."""

    def run(spark, d):
        found = catalog(spark, d).search(request).df.select(F.col("data_record_id_").alias("rid"))
        if " LIMIT " in sql:
            # The first rows of an order come in one partition, where ids count up from 0.
            return found.coalesce(1).select(F.monotonically_increasing_id().alias("position"), "rid")
        return _placed(found, "rid long")

    query(f"SELECT (row_number() OVER () - 1)::BIGINT AS position, rid FROM ({sql})", name)(run)


ANY = {"o_totalprice": {"query": 0.5, "range": "min"}}
_O = "SELECT o_orderkey AS rid FROM orders WHERE o_totalprice >= 0.5 "
ordered("sort_one", {**ANY, "sort_on": "o_totalprice"}, _O + "ORDER BY o_totalprice, o_orderkey")
ordered("sort_reverse", {**ANY, "sort_on": "o_totalprice", "sort_order": "Descending"}, _O + "ORDER BY o_totalprice DESC, o_orderkey DESC")
ordered("sort_two_mixed", {**ANY, "sort_on": ("o_orderpriority", "o_totalprice"), "sort_order": ("", "reverse"), "b_start": 20, "b_size": 10}, _O + "ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey DESC LIMIT 10 OFFSET 20")
ordered("sort_minimum_slice", {"o_orderstatus": ["F", "O"], "o_totalprice": {"query": (1e5, 2e5), "range": "min:max"}, "sort_on": ("o_orderpriority", "o_totalprice"), "sort_order": ("", "reverse"), "b_start": 20, "b_size": 10}, "SELECT o_orderkey AS rid FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1e5 AND 2e5 ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey DESC LIMIT 10 OFFSET 20")
ordered("sort_two_reverse", {**ANY, "sort_on": ("o_orderpriority", "o_custkey"), "sort_order": "reverse", "sort_limit": 40}, _O + "ORDER BY o_orderpriority DESC, o_custkey DESC, o_orderkey DESC LIMIT 40")
ordered("sort_missing_dropped", {**ANY, "sort_on": "priority_or_none", "sort_limit": 30}, _O + f"AND {P0} IS NOT NULL ORDER BY {P0}, o_orderkey LIMIT 30")
ordered("sort_missing_secondary", {**ANY, "sort_on": ("o_orderstatus", "priority_or_none"), "sort_limit": 30}, _O + f"AND {P0} IS NOT NULL ORDER BY o_orderstatus, {P0}, o_orderkey LIMIT 30")
ordered("sort_date", {**ANY, "sort_on": "placed", "sort_limit": 30}, _O + "ORDER BY date_trunc('minute', o_orderdate), o_orderkey LIMIT 30")
ordered("sort_path", {"path": "/", "sort_on": "path", "sort_limit": 30}, "SELECT page_id AS rid FROM pages ORDER BY regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), page_id LIMIT 30", pages)
ordered("sort_daterange", {"active": 13_500_000, "sort_on": "active", "sort_limit": 30}, "SELECT rid FROM (SELECT l_orderkey * 10 + l_linenumber AS rid, " + _MIN.format(x=f"({_SINCE})") + " AS s, " + _MIN.format(x=f"({_UNTIL})") + " AS u FROM lineitem) WHERE (s IS NULL OR s <= 13500000) AND (u IS NULL OR u >= 13500000) ORDER BY s NULLS FIRST, u NULLS FIRST, rid LIMIT 30", lines)
ordered("sort_boolean", {"toxic": True, "sort_on": "quality", "sort_order": "reverse", "sort_limit": 25}, "SELECT doc_id AS rid FROM labels WHERE toxic = 1 AND quality IS NOT NULL ORDER BY quality DESC, doc_id DESC LIMIT 25", labels)
ordered("sort_uuid", {"nation": {"query": 3, "range": "min"}, "sort_on": "name", "sort_limit": 25}, "SELECT c_custkey AS rid FROM customer WHERE c_nationkey >= 3 ORDER BY c_name, c_custkey LIMIT 25", customers)
ordered("limit", {**ANY, "sort_on": "o_custkey", "sort_limit": 15}, _O + "ORDER BY o_custkey, o_orderkey LIMIT 15")
ordered("batch_mid", {**ANY, "sort_on": "o_custkey", "b_start": 500, "b_size": 25}, _O + "ORDER BY o_custkey, o_orderkey LIMIT 25 OFFSET 500")
ordered("batch_past_end", {**ANY, "sort_on": "o_custkey", "b_start": 10_000_000, "b_size": 25}, _O + "ORDER BY o_custkey, o_orderkey LIMIT 25 OFFSET 10000000")
ordered("batch_negative", {**ANY, "sort_on": "o_custkey", "b_start": -5, "b_size": 8}, _O + "ORDER BY o_custkey, o_orderkey LIMIT 3")
ordered("batch_unsorted", {"o_orderstatus": "F", "b_start": 5, "b_size": 8}, "SELECT o_orderkey AS rid FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 8 OFFSET 5")
ordered("text_relevance_order", {"text": "the OR ening", "sort_limit": 50}, text_sql(T2, SUM2, SOME2, last="SELECT rid FROM r ORDER BY score DESC, rid DESC LIMIT 50"), documents)


@query(f"SELECT count({P0}) AS n FROM orders WHERE o_totalprice >= 0.5")
def actual_result_count(spark, d):
    found = orders(spark, d).search({**ANY, "sort_on": "priority_or_none", "sort_limit": 3})
    return spark.createDataFrame([(found.actual_result_count(),)], "n long")


# -- facets: G1-G20


def facet(name: str, catalog: Callable, how: Callable[[Catalog], DataFrame], sql: str) -> None:
    query(sql, name)(lambda spark, d: how(catalog(spark, d)))


_COUNT = "count(*) AS count"
facet("uniq_field", orders, lambda c: c.unique_values("status_or_none"), f"SELECT DISTINCT {S0} AS value FROM orders WHERE {S0} IS NOT NULL")
facet("uniq_field_lengths", orders, lambda c: c.unique_values("o_orderpriority", True), f"SELECT o_orderpriority AS value, {_COUNT} FROM orders GROUP BY 1")
facet("uniq_date_lengths", orders, lambda c: c.unique_values("placed", True), f"SELECT ({_OD})::INT AS value, {_COUNT} FROM orders GROUP BY 1")
facet("uniq_keyword", parts, lambda c: c.unique_values("words", True), f"SELECT w AS value, {_COUNT} FROM (SELECT unnest(list_distinct({W})) AS w FROM part) GROUP BY 1")
facet("uniq_bool", labels, lambda c: c.unique_values("toxic", True), "SELECT v AS value, (SELECT count(*) FROM labels WHERE (toxic = 1) = v) AS count FROM (VALUES (true), (false)) t(v)")
facet("uniq_daterange", lines, lambda c: c.unique_values("active", True, "since"), f"SELECT s AS value, {_COUNT} FROM (SELECT {_MIN.format(x=f'({_SINCE})')} AS s, {_MIN.format(x=f'({_UNTIL})')} AS u FROM lineitem) WHERE s IS NOT NULL GROUP BY s, u IS NULL")
facet("uniq_path", pages, lambda c: c.unique_values("path", True), f"SELECT w AS value, {_COUNT} FROM (SELECT unnest(list_distinct({_PATH})) AS w FROM pages) GROUP BY 1")
facet("uniq_topic", events, lambda c: c.unique_values("topics", True), " UNION ALL ".join(f"SELECT '{n}' AS value, count(*) AS count FROM events WHERE {e}" for n, e in {**_T, "both": "event_type = 'purchase' AND value > 50"}.items()))
facet("uniq_uuid", events, lambda c: c.unique_values("user", True), "SELECT DISTINCT user_id AS value, 1::BIGINT AS count FROM events WHERE user_id IS NOT NULL")
facet("histogram", orders, lambda c: c.histogram("o_custkey"), "SELECT n AS size, count(*) AS n_values FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
facet("histogram_keyword", parts, lambda c: c.histogram("words"), f"SELECT n AS size, count(*) AS n_values FROM (SELECT w, count(*) AS n FROM (SELECT unnest(list_distinct({W})) AS w FROM part) GROUP BY 1) GROUP BY 1")
facet("histogram_bool", labels, lambda c: c.histogram("quality"), "SELECT v AS value, (SELECT count(*) FROM labels WHERE (quality = 1) = v) AS count FROM (VALUES (true), (false)) t(v)")
facet("num_objects", orders, lambda c: c.num_objects("priority_or_none"), f"SELECT count({P0}) AS n FROM orders")
facet("num_objects_topic", events, lambda c: c.num_objects("topics"), f"SELECT count(*) AS n FROM events WHERE {' OR '.join(_T.values())}")
facet("index_size", orders, lambda c: c.index_size("o_custkey"), "SELECT count(DISTINCT o_custkey) AS n FROM orders")
facet("index_size_path", pages, lambda c: c.index_size("path"), f"SELECT count(DISTINCT w) AS n FROM (SELECT unnest({_PATH}) AS w FROM pages)")
facet("value_to_rids", customers, lambda c: c.value_to_rids("nation"), "SELECT c_nationkey AS value, c_custkey AS rid FROM customer")
facet("indexed_rids", orders, lambda c: c.indexed_rids("status_or_none"), f"SELECT o_orderkey AS rid FROM orders WHERE {S0} IS NOT NULL")
facet("catalog_length", orders, lambda c: c.rows.agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM orders")
facet("key_for_document", orders, lambda c: c.key_for_document("o_totalprice", 7), "SELECT o_totalprice AS key FROM orders WHERE o_orderkey = 7")

# -- set operations and merging: U1-U7


def _both(spark, d, **request):
    more = {"nation": {"query": 10, "range": "max"}, **request}
    return [c(spark, d).search(more, merge=False) for c in (customers, suppliers)]


_ROWS = "SELECT c_custkey AS rid, c_name AS name, c_acctbal AS bal FROM customer WHERE c_nationkey <= 10 UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_nationkey <= 10"


@query(f"SELECT rid, name FROM ({_ROWS})")
def merge_concat(spark, d):
    return merging.merged(_both(spark, d), False).select(F.col("data_record_id_").alias("rid"), "name")


@query(f"SELECT (row_number() OVER () - 1)::BIGINT AS position, rid, name FROM (SELECT * FROM ({_ROWS}) ORDER BY bal DESC, rid DESC)")
def merge_sorted(spark, d):
    out = merging.merged(_both(spark, d, sort_on="balance"), True, reverse=True)
    return _placed(out.select(F.col("data_record_id_").alias("rid"), "name"), "rid long, name string")


@query("SELECT (row_number() OVER () - 1)::BIGINT AS position, rid, score, 1::BIGINT AS norm FROM (SELECT * FROM (SELECT * FROM (" + text_sql(["w = 'onnt'"], "t0", "t0 IS NOT NULL") + ") UNION ALL SELECT * FROM (" + text_sql(["w = 'onnt'"], "t0", "t0 IS NOT NULL", words=_HTML, table="pages", rid="page_id", text="html") + ")) ORDER BY score, rid)")
def merge_scored(spark, d):
    parts_ = [documents(spark, d).search({"text": "onnt"}, merge=False), pages(spark, d).search({"html": "onnt"}, merge=False)]
    out = merging.merged(parts_, True)
    return _placed(out.select(F.col("data_record_id_").alias("rid"), F.col("data_record_score_").alias("score"), F.col("data_record_normalized_score_").alias("norm")), "rid long, score long, norm long")


# -- ingest and maintenance: S1-S19, A1, A2


def _changed(spark, d):
    """Customers of nations under 5 with a changed balance, and new ones."""
    c = _read(spark, d, "customer")
    new = c.where("c_custkey <= 20").withColumn("c_custkey", F.col("c_custkey") + 1_000_000).withColumn("c_name", F.concat(F.lit("New#"), "c_name"))
    return c.where("c_nationkey < 5").withColumn("c_acctbal", F.col("c_acctbal") + 1000).unionByName(new)


def _state(c: Catalog) -> DataFrame:
    return c.rows.select("rid", "uid", F.col("m__balance").alias("balance"), F.col("i__balance").alias("indexed"))


_NEW = "SELECT c_custkey + 1000000, 'New#' || c_name, c_acctbal, c_acctbal FROM customer WHERE c_custkey <= 20"
_UP = "SELECT c_custkey AS rid, c_name AS uid, {m} AS balance, {i} AS indexed FROM customer"
_PLUS = "CASE WHEN c_nationkey < 5 THEN c_acctbal + 1000 ELSE c_acctbal END"


@query(_UP.format(m=_PLUS, i=_PLUS) + " UNION ALL " + _NEW)
def upsert(spark, d):
    return _state(maintenance.upsert(customers(spark, d), _changed(spark, d)))


@query(_UP.format(m="c_acctbal", i=_PLUS) + " UNION ALL " + _NEW)
def upsert_some_indexes(spark, d):
    return _state(maintenance.upsert(customers(spark, d), _changed(spark, d), ["balance"], update_metadata=False))


@query(_UP.format(m=_PLUS, i="c_acctbal") + " UNION ALL " + _NEW)
def upsert_metadata_only(spark, d):
    return _state(maintenance.upsert(customers(spark, d), _changed(spark, d), [], update_metadata=True))


def _repeated(spark, d):
    """Customers of nation 3 twice, the later one with more balance and a rid of its own; new ones whose rids are in use."""
    c = _read(spark, d, "customer").where("c_nationkey = 3")
    later = c.withColumns({"c_custkey": F.col("c_custkey") + 500_000, "c_acctbal": F.col("c_acctbal") + 7})
    return c.unionByName(later).unionByName(c.withColumn("c_name", F.concat(F.lit("Clash#"), "c_name")))


@query("SELECT c_custkey AS rid, c_name AS uid, CASE WHEN c_nationkey = 3 THEN c_acctbal + 7 ELSE c_acctbal END AS balance FROM customer UNION ALL SELECT NULL, 'Clash#' || c_name, c_acctbal FROM customer WHERE c_nationkey = 3")
def upsert_repeated_uids(spark, d):
    """One record a uid, and no rid of another: those that are given anew are negative, and shown as null."""
    rows = maintenance.upsert(customers(spark, d), _repeated(spark, d)).rows
    return rows.select(F.when(F.col("rid") >= 0, F.col("rid")).alias("rid"), "uid", F.col("m__balance").alias("balance"))


@query("SELECT count(*) AS n, count(*) AS rids, count(*) AS uids FROM (SELECT c_name FROM customer UNION ALL SELECT c_name FROM customer WHERE c_nationkey = 3)")
def upsert_ids_are_unique(spark, d):
    rows = maintenance.upsert(customers(spark, d), _repeated(spark, d)).rows
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rid").alias("rids"), F.count_distinct("uid").alias("uids"))


@query("SELECT c_custkey AS rid FROM customer WHERE c_nationkey < 5")
def uuid_after_upsert(spark, d):
    """Of a unique value that later records repeat, the record that had it first goes on being found, though their rids are smaller."""
    c = _read(spark, d, "customer").where("c_nationkey < 5")
    spec = CatalogSpec("c_custkey", lambda: F.concat("c_name", F.lit("/"), F.col("c_custkey").cast("string"))).add_index("name", "uuid", "c_name")
    again = maintenance.upsert(Catalog.of(c, spec), c.withColumn("c_custkey", -F.col("c_custkey")))
    return again.rows.where(again.kind("name").indexed).select("rid")


@query("SELECT c_name AS uid FROM customer WHERE c_nationkey < 5")
def metadata_changes(spark, d):
    return maintenance.metadata_changes(customers(spark, d), _changed(spark, d))


@query(_UP.format(m="c_acctbal", i="c_acctbal") + " WHERE c_name NOT IN ('Customer#000000003', 'nobody')")
def delete(spark, d):
    return _state(maintenance.delete(customers(spark, d), ["Customer#000000003", "nobody"]))


@query(_UP.format(m="c_acctbal", i=_PLUS))
def partial_reindex(spark, d):
    return _state(maintenance.reindex(customers(spark, d), _changed(spark, d), ["balance"]))


@query(_UP.format(m=_PLUS, i=_PLUS))
def refresh(spark, d):
    return _state(maintenance.refresh(customers(spark, d), _changed(spark, d)))


@query(_UP.format(m=_PLUS, i=_PLUS) + " WHERE c_nationkey < 5")
def refresh_cleared(spark, d):
    return _state(maintenance.refresh(customers(spark, d), _changed(spark, d), clear=True))


@query(_UP.format(m="c_acctbal", i="c_acctbal") + " WHERE false")
def clear(spark, d):
    return _state(maintenance.clear(customers(spark, d)))


@query("SELECT c_custkey AS rid, c_name AS uid, c_acctbal AS balance, NULL::DOUBLE AS indexed FROM customer")
def clear_index(spark, d):
    return _state(maintenance.clear_index(customers(spark, d), "balance"))


@query("SELECT c_custkey AS rid, c_name AS name, c_acctbal AS balance, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment FROM customer")
def add_column_default(spark, d):
    source = _read(spark, d, "customer")
    c = customers(spark, d).add_column(source, "segment", lambda: F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), "none")
    return c.search_all().select(F.col("data_record_id_").alias("rid"), "name", "balance", "segment")


@query("SELECT c_custkey AS rid FROM customer WHERE c_mktsegment = 'BUILDING'")
def add_index(spark, d):
    c = customers(spark, d).add_index(_read(spark, d, "customer"), "segment", "field", "c_mktsegment")
    return c.search({"segment": "BUILDING"}).df.select(F.col("data_record_id_").alias("rid"))


@query("SELECT c_custkey AS rid, c_name AS uid, c_acctbal AS balance FROM customer WHERE c_name = 'Customer#000000009'")
def lookup_uid(spark, d):
    c = customers(spark, d)
    return c.rid_of("Customer#000000009").join(c.path_of(9), F.lit(True)).join(c.metadata(uid="Customer#000000009").select("balance"), F.lit(True))


@query("SELECT n_name AS value, '/' || r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 7")
def index_data(spark, d):
    c = nations(spark, d)
    return c.metadata(rid=7).select(F.col("n_name").alias("value")).join(c.index_data(rid=7), F.lit(True))


@query("SELECT c_custkey AS rid, c_name AS name, c_acctbal AS balance FROM customer")
def search_all(spark, d):
    return customers(spark, d).search_all().select(F.col("data_record_id_").alias("rid"), "name", "balance")


@query("SELECT n_nationkey AS rid, '/' || r_name || '/' || n_name AS uid FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def normalize_paths(spark, d):
    c = nations(spark, d)
    messy = c.with_rows(c.rows.withColumn("uid", F.concat(F.lit("/"), F.replace("uid", F.lit("/"), F.lit("//")), F.lit("/"))))
    return maintenance.normalize_paths(messy, c.rows.where("uid not like '/ASIA/%'").select("uid")).rows.select("rid", "uid")


@query("SELECT o.o_orderkey, o.o_custkey FROM orders o WHERE o.o_orderstatus = 'P'")
def result_objects(spark, d):
    source = _read(spark, d, "orders")
    return orders(spark, d).search({"o_orderstatus": "P"}).objects(source, "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND contains(text, 'the of') AND n_chars > 1000 AND source = 'src0'")
def find_and_apply(spark, d):
    docs = _read(spark, d, "documents")
    return finding.find(docs, types=["en", "de"], term="the of", expr="n_chars > 1000", ids=["src0"], id_col="source", type_col="lang").select("doc_id")


FLAGSHIP = {"text": "the OR ening", "lang": "en", "sort_limit": 20}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over documents AND lang = 'en', the 20 best with normalised scores."""
    return documents(spark, d).search(FLAGSHIP).df


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
