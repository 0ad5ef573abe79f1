from __future__ import annotations

import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from checks.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture
def fact(spark):
    """Build order lines from (order, product, customer, 'YYYY-MM-DD' or None, amount, quantity) tuples."""

    def build(rows):
        data = [
            (o, p, c, dt.date.fromisoformat(d) if d else None, None if a is None else Decimal(str(a)), q)
            for o, p, c, d, a, q in rows
        ]
        return spark.createDataFrame(
            data,
            "order_number string, product_key long, customer_key long, order_date date, "
            "sales_amount decimal(18,2), quantity int",
        )

    return build


@pytest.fixture
def customers(spark):
    """Build customers from (key, first, last, birth year or None) tuples."""

    def build(rows):
        data = [
            (k, k and k * 10, f"C{k}", f, l, "Here", "n/a", dt.date(y, 6, 1) if y else None) for k, f, l, y in rows
        ]
        return spark.createDataFrame(
            data,
            "customer_key long, customer_id long, customer_number string, first_name string, last_name string, "
            "country string, gender string, birthdate date",
        )

    return build


@pytest.fixture
def products(spark):
    """Build products from (key, name, category, cost or None) tuples."""

    def build(rows):
        data = [(k, k, n, c, "sub", None if v is None else Decimal(str(v))) for k, n, c, v in rows]
        return spark.createDataFrame(
            data,
            "product_key long, product_id long, product_name string, category string, subcategory string, "
            "cost decimal(18,2)",
        )

    return build


def rows(df, *columns):
    """Rows as tuples, decimals and all."""
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
