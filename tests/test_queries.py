"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from lightsieve.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).map(lambda v: float(v) if hasattr(v, "dtype") and v.dtype.kind == "f" else str(v) if not isinstance(v, (bool, int, float, str, type(None))) else v).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def sql(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, sql, sf_small, name):
    found = registry.QUERIES[name](spark, sf_small).toPandas()
    if name in registry.ORACLE_SQL:
        expected = sql.sql(registry.ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert canonical(found) == canonical(expected)
    else:
        assert len(found)
