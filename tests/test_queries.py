"""Every registered query of the signal operators against its SQL, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from tonegrid.plans import GROUPS

SF = "/root/testdata/sf0.001"
NAMES = [(g, name) for g in GROUPS for name in g.QUERIES if name in g.ORACLE]


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for t in os.listdir(SF):
        db.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return db


def plain(rows):
    return Counter(tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.parametrize(("group", "name"), NAMES, ids=[n for _, n in NAMES])
def test_query(spark, db, group, name):
    got = group.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({group.ORACLE[name]})").fetchall()
    assert plain(map(tuple, got.select(*columns).collect())) == plain(want) and want


def test_every_query_has_sql():
    assert all(name in g.ORACLE for g in GROUPS for name in g.QUERIES)
