"""Every registered query of the engine against its DuckDB twin, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidepool.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def norm(rows):
    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "~"
        return f"{x:.8g}" if isinstance(x, float) else str(x)

    return sorted(tuple(one(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_twin(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert norm(got.select(*columns).collect()) == norm(duck.sql(f"SELECT {quoted} FROM ({catalog.ORACLES[name]})").fetchall())


def test_queries_without_twins_are_tested_elsewhere():
    from . import test_plain

    assert set(catalog.QUERIES) - set(catalog.ORACLES) == test_plain.TESTED


#: Right answers that are empty on the smallest tables.
EMPTY = {"hamming_pairs", "funder_fanout", "cohort_except", "reputation_veto"}


def test_twins_give_rows(duck):
    empty = {n for n, sql in catalog.ORACLES.items() if not duck.sql(f"SELECT count(*) FROM ({sql})").fetchall()[0][0]}
    assert empty <= EMPTY
