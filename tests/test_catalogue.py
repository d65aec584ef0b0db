"""Every query of the catalogue against its SQL on the smallest tables."""

import pytest
from oracle import connection, rows_of, rows_of_sql

from spindrift.plans.catalogue import load

CATALOGUE = load()


@pytest.mark.parametrize("name", [n for n, q in CATALOGUE.items() if q.sql])
def test_sql(spark, small, name):
    q = CATALOGUE[name]
    names, rows = rows_of(q.run(spark, small))
    assert (names, rows) == rows_of_sql(connection(small), q.sql)


@pytest.mark.parametrize("name", [n for n, q in CATALOGUE.items() if not q.sql])
def test_rows_only(spark, small, name):
    assert CATALOGUE[name].run(spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark, small, capsys):
    for name in ("scan_project_filter", "date_range_filter", "optional_filter"):
        CATALOGUE[name].run(spark, small).explain("formatted")
        assert "PushedFilters: []" not in capsys.readouterr().out.split("customer.parquet")[-1].split("ReadSchema")[0]


def test_the_queue_holds_every_open_chunk(spark, small):
    from spindrift.plans.queries_maintenance import _lines

    got = [(r["prioritaet"], r["chunk_id"]) for r in CATALOGUE["embed_priority_queue"].run(spark, small).collect()]
    assert len(got) == _lines(spark, small).where("position % 4 <> 0").count() > 500 and got == sorted(got)
