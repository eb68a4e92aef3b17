"""Every query with an oracle against DuckDB, as sorted full results."""

from __future__ import annotations

import pytest

from framelake.registry import oracle_sql, queries

Q, O = queries(), oracle_sql()


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("float"):
            df[c] = df[c].round(6) + 0.0
    df = df.astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


#: Not expressible in SQL; tests/test_rasters.py holds them against plain loops.
PLAIN = {"floyd_steinberg", "median_cut", "shared_palette", "movelock", "subject_rescue"}
PLAIN |= {"quantise_look", "cel_look", "match_look", "key_look"}  # held by tests/test_composites.py


def test_every_query_has_an_oracle_or_a_plain_test():
    assert set(Q) == set(O) | PLAIN
    assert len(O) > 140


@pytest.mark.parametrize("name", sorted(O))
def test_query(name, spark, sf, duck):
    got, want = plain(Q[name](spark, sf).toPandas()), plain(duck.execute(O[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert (got.values == want.values).all()
