"""Queries with SQL against DuckDB, and what holds for all of them."""

import re
from pathlib import Path

import pytest
from oracle import connection, rows_of, rows_of_sql

from spindrift.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, small, name):
    names, rows = rows_of(QUERIES[name](spark, small))
    assert (names, rows) == rows_of_sql(connection(small), ORACLES[name])


def test_one_query_for_each_operator():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 13))


def test_nothing_else_imports_this_folder():
    root = Path(__file__).resolve().parents[2]
    for p in (root / "spindrift").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text()


def test_native_plans_have_no_python(spark, small, capsys):
    for name in ("op1_document_fingerprints", "op4_line_dedup"):
        QUERIES[name](spark, small).explain("formatted")
        assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


def test_mapped_plans_read_two_columns(spark, small, capsys):
    for name in ("op6_sentencepiece", "op9_toxicity", "op10_token_packing", "op11_line_quality"):
        QUERIES[name](spark, small).explain("formatted")
        assert set(re.findall(r"ReadSchema: struct<([^>]*)>", capsys.readouterr().out)) <= {"doc_id:bigint,text:string", "text:string,doc_id:bigint"}
