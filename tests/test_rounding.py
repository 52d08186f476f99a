"""Scores whose exact value ends in a half, against the SQL twin."""

from __future__ import annotations

import pandas as pd

from recallforge import catalog
from tests.compare import same


def test_compliance_score_halves(spark, tmp_path):
    lines = [(i % 4, 29.0 if i < 23 else 28.0, "N" if i < 12 else "A") for i in range(48)]
    pd.DataFrame(lines, columns=["l_orderkey", "l_quantity", "l_returnflag"]).to_parquet(tmp_path / "lineitem.parquet")
    orders = [(i, 7, "F", "1-URGENT" if i % 2 else "2-HIGH") for i in range(4)]
    pd.DataFrame(orders, columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]).to_parquet(tmp_path / "orders.parquet")
    got = catalog.queries()["compliance_score"](spark, str(tmp_path))
    assert got.first().score == 59.5
    same(got, catalog.oracle_sql()["compliance_score"], str(tmp_path))
