"""Every query with a DuckDB oracle gives its rows at sf0.001."""

import os

import duckdb
import pytest

from fotolith import registry, registry_edits, registry_learn, registry_more, registry_reports, registry_state  # noqa: F401  the others add to the first

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in os.listdir(SF):
        path = f"{SF}/{t}"
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(rows):
    def one(x):
        if isinstance(x, bool) or x is None:
            return str(x)
        return repr(round(float(x), 5) + 0.0) if isinstance(x, float) else str(x)

    return sorted(tuple(one(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    assert plain(tuple(r) for r in df.select(*cols).collect()) == plain(tuple(r[names.index(c)] for c in cols) for r in got.fetchall())
