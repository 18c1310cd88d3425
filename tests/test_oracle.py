"""Every query that has SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from moderix.plans import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():  # noqa: ANN201
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):  # noqa: ANN001, ANN201
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return repr(float(v)) if not isinstance(v, (str, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name: str) -> None:
    got = registry.QUERIES[name](spark, str(DATA))
    cols = sorted(got.columns)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert cols == sorted(want.columns)
    order = [want.columns.index(c) for c in cols]
    theirs = sorted([plain(r[i]) for i in order] for r in want.fetchall())
    ours = sorted([plain(r[c]) for c in cols] for r in got.collect())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name: str) -> None:
    assert registry.QUERIES[name](spark, str(DATA)).count() >= 0


def test_tckn_check_beyond_the_small_tables(spark, tmp_path) -> None:
    """A negative difference of the sums, twelve digits, a negative number, no number."""
    (tmp_path / "d").mkdir()
    c = duckdb.connect()
    ids = "(214670), (304060), (520362), (8899701), (9500000), (9500017), (-1), (-1100000), (-2000000), (null)"
    more = "union all select range from range(0, 30000) union all select 9100000 + range from range(0, 30000)"
    c.sql(f"create table events as select event_id::bigint as event_id, timestamp '2024-01-01' as ts, 1::bigint as user_id, 'view' as event_type, 1.0::double as value, '{{\"k\": 1}}' as props from (select * from (values {ids}) x(event_id) {more})")
    c.sql(f"copy events to '{tmp_path}/d/events.parquet'")
    for name in ("documents", "labels", "customer"):
        c.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted((tuple(r) for r in c.sql(registry.ORACLE_SQL["tckn_check"]).fetchall()), key=key)
    got = sorted((tuple(r) for r in registry.QUERIES["tckn_check"](spark, str(tmp_path / "d")).select("n", "valid").collect()), key=key)
    assert got == want
    assert (12140904056, False) in got and any(v for n, v in got if n is not None and n >= 10**11)
