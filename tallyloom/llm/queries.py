"""Queries of the operators for text and names, with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.encode import encode_texts
from tallyloom.llm.garbled import find_garbled
from tallyloom.llm.leaks import find_leaks
from tallyloom.llm.linkage import link_records
from tallyloom.llm.people import link_spellings, spelling_classes, spelling_pairs
from tallyloom.llm.places import resolve_places
from tallyloom.llm.unify import find_disguised, kana_runs
from tallyloom.tables import table


def p1_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person behind each staff name of both tables, store by store: ``place, written, person``."""
    lexicon = table(spark, sf_dir, "name_lexicon").collect()  # a table of fixed size
    forms = table(spark, sf_dir, "form_readings").where("store_name IS NOT NULL AND staff_name IS NOT NULL").select("store_name", "staff_name").distinct()
    ledger = table(spark, sf_dir, "ledger_records").select(F.col("store_name").alias("place"), "staff_name").distinct()
    means = resolve_places(forms, "store_name", table(spark, sf_dir, "stores"), "store_name", lexicon)
    read = forms.join(means, forms["store_name"] == means["written"]).select("place", "staff_name")
    return link_spellings(ledger.unionByName(read), "place", "staff_name", lexicon)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two spellings that stand for one person of a store."""
    return spelling_pairs(p1_people(spark, sf_dir)).withColumnRenamed("place", "store_name")


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling of a store with the class of its person and the number of the other spellings."""
    return spelling_classes(p1_people(spark, sf_dir)).withColumnRenamed("place", "store_name")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields whose value looks clean but consists of other characters."""
    lexicon = table(spark, sf_dir, "name_lexicon")
    forms = find_disguised(table(spark, sf_dir, "form_readings"), "reading_id", ["store_name", "staff_name"], lexicon, "form_readings", kana_runs(table(spark, sf_dir, "stores"), "store_name"), repeats=True)
    ledger = find_disguised(table(spark, sf_dir, "ledger_records"), "record_id", ["tablet_no"], lexicon, "ledger_records", repeats=True)
    return forms.unionByName(ledger).select("table_name", "row_id", "field").distinct()


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings without a usable number with their ledger record and the confidence of the match."""
    lexicon = table(spark, sf_dir, "name_lexicon").collect()  # a table of fixed size
    return link_records(table(spark, sf_dir, "form_readings"), table(spark, sf_dir, "ledger_records"), table(spark, sf_dir, "stores"), lexicon)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger record of each reading without a usable number, where the ledger has one."""
    return p4_links(spark, sf_dir).select("reading_id", "record_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the evaluation items whose passage they hold by half or more, and in which way."""
    return find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "passage")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the way."""
    return p7_matches(spark, sf_dir).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a stretch that was decoded with the wrong encoding."""
    return find_garbled(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").select("doc_id")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents with their text restored and the chain that garbled it."""
    return find_garbled(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").select("doc_id", "restored", "steps")


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p2_found": p2_found, "p4_found": p4_found, "p4_links": p4_links, "p6_ids": p6_ids, "p7_found": p7_found, "p7_matches": p7_matches, "p8_found": p8_found, "p8_restored": p8_restored}
SQL: dict[str, str] = {}
