"""The registered queries on the smallest tables: exact columns, and what must hold whatever the data."""

import os

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import queries as Q
from tallyloom.llm.unify import find_disguised, kana_runs
from tallyloom.tables import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")

COLUMNS = {
    "p1_found": "store_name:string,name_a:string,name_b:string",
    "p2_found": "table_name:string,row_id:bigint,field:string",
    "p4_found": "reading_id:bigint,record_id:bigint",
    "p6_ids": "doc_id:bigint,ids:array<int>",
    "p7_found": "doc_id:bigint,item_id:bigint",
    "p8_found": "doc_id:bigint",
}


@pytest.fixture(scope="module")
def found(spark):
    return {name: Q.QUERIES[name](spark, DATA).cache() for name in COLUMNS}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(found, name):
    assert ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in found[name].schema.fields) == COLUMNS[name]
    assert found[name].count() > 0


def test_p1_pairs_are_whole_groups(spark, found):
    """Pairs are ordered, of one store each, and closed: a-b and b-c bring a-c."""
    rows = {(r.store_name, r.name_a, r.name_b) for r in found["p1_found"].collect()}
    assert all(a < b for _, a, b in rows)
    stores = {r.store_name for r in table(spark, DATA, "stores").collect()}
    assert {s for s, _, _ in rows} <= stores
    for s, a, b in list(rows)[:300]:
        for t, c, d in rows:
            if s == t and b == c:
                assert (s, a, d) in rows


def test_p2_store_names_end_up_clean(spark):
    """Whatever is unified becomes its own canonical form, and no registered name is a case."""
    stores = table(spark, DATA, "stores")
    words = kana_runs(stores, "store_name")
    lexicon = table(spark, DATA, "name_lexicon")
    assert find_disguised(stores, "store_id", ["store_name"], lexicon, "stores", words).count() == 0
    cases = find_disguised(table(spark, DATA, "form_readings"), "reading_id", ["store_name"], lexicon, "form_readings", words)
    again = find_disguised(cases.select("row_id", F.col("canonical").alias("store_name")), "row_id", ["store_name"], lexicon, "x", words)
    assert cases.count() > 0 and again.count() == 0


def test_p4_links_only_readings_without_a_number(spark, found):
    known = {r[0] for r in table(spark, DATA, "ledger_records").select("daily_report_no").collect() if r[0]}
    numbers = {r.reading_id: (r.daily_report_no or "").strip(" ") for r in table(spark, DATA, "form_readings").collect()}
    rows = found["p4_found"].collect()
    assert len({r.reading_id for r in rows}) == len(rows)
    assert all(not numbers[r.reading_id] or numbers[r.reading_id] not in known for r in rows)


def test_p6_covers_every_document(spark, found):
    docs = table(spark, DATA, "documents")
    empty = docs.where("text IS NULL OR text = ''").count()
    assert found["p6_ids"].count() == docs.count() and found["p6_ids"].where("size(ids) = 0").count() == empty


def test_p8_restores_what_it_finds(spark, found):
    restored = Q.p8_restored(spark, DATA)
    assert {r.doc_id for r in restored.collect()} == {r.doc_id for r in found["p8_found"].collect()}
