"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = entry.SMOKE_DIR
#: One query of each sort; the driver runs them all.
CHOSEN = "field_eq not_pure keyword_range_and bool_null_is_false date_precision daterange_stab path_any_run topic_and uuid_duplicate composite_keyword text_phrase cosine_or norm_score sort_two_mixed batch_negative uniq_daterange merge_scored upsert_some_indexes upsert_repeated_uids upsert_ids_are_unique uuid_after_upsert value_to_rids postings_table limit batch_unsorted lookup_uid find_and_apply".split()


def rows(table, names):
    return sorted(map(repr, ([round(v, 9) if isinstance(v, float) else v for v in (r[n] for n in names)] for r in table)))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", CHOSEN)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, DIR)
    names = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == names
    assert rows([r.asDict() for r in df.collect()], names) == rows([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], names)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name, least", [("sort_one", 501), ("sort_reverse", 501), ("merge_sorted", 41), ("merge_scored", 2)])
def test_whole_sorts_against_sql(spark, name, least):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, DIR)
    want = con.sql(entry.oracle_sql()[name]).fetchall()
    assert len(want) >= least and sorted(map(tuple, df.collect())) == sorted(want)


@pytest.fixture(scope="module")
def prepared(spark, tmp_path_factory):
    from tesserae.plans import registry

    registry.prepare(spark, DIR, str(tmp_path_factory.mktemp("stored")))
    yield
    registry._PREPARED.clear()


#: What the benchmark runs: searches of stored catalogs, with their inverted indexes.
STORED = "field_and_fields uuid_duplicate text_term text_and text_not text_or_dup text_phrase text_phrase_not text_oov_phrase text_glob text_glob_and text_nested text_html text_and_field text_topk text_batch cosine_or norm_score upsert".split()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", STORED)
def test_stored_catalogs_against_sql(spark, prepared, name):
    test_against_sql(spark, name)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_stored_index_prunes_by_word(spark, prepared):
    from tesserae.plans import registry

    plan = registry.documents(spark, DIR).search({"text": "the AND ening", "lang": "en"}).df._jdf.queryExecution().toString()
    assert "In(word, [ening,the])" in plan and "words" not in plan.split("== Physical Plan ==")[1]
