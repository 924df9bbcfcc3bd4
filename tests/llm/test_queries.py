"""Queries against their SQL, and the columns every query returns."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect
from clipledger.llm import queries as Q

COLUMNS = {
    "op1": "doc_id n_bytes n_removed n_spans kept_sha256", "op2": "doc_id source block slot place", "op3": "query_id rank vec_id score",
    "op4": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5": "page_id payload_bytes payload_digest record_type refers_to", "op6": "doc_id n_shingles component_id kept",
    "op7": "doc_id start n_tokens ids_crc32", "op8": "doc_id piece start length ids_crc32 sequence_id offset",
    "op9": "doc_id n_assign n_access n_hex base_sha256 spans", "op10": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op11": "item_id rank doc_id score",
    "op12": "doc_id n_lines n_dropped kept_sha256",
    "op13": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches(spark, small, name):
    duck = connect(small)
    got = compare(spark, duck, entry.queries()[name], entry.oracle_sql()[name], small)
    assert got["ok"], got


def test_all_are_registered(spark, small):
    own = {name.split("_")[0]: name for name in Q.queries()}
    assert set(own) == set(COLUMNS) and {*Q.queries(), "pipeline"} <= set(entry.queries())
    for op in ("op2", "op7"):
        assert set(COLUMNS[op].split()) <= set(Q.queries()[own[op]](spark, small).columns)
