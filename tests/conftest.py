import os
import sys
from datetime import date

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '4')}]")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def day(text):
    return None if text is None else date.fromisoformat(text)


@pytest.fixture
def make(spark):
    """Small domain tables from short rows."""
    from voucherflow import schemas

    class Make:
        def receipts(self, *rows):
            """(user, coupon, receive, start, end[, amount, limit]); keys 1, 2, ..."""
            full = [(u, c, *(r[0:1] or [100]), day(a), day(b), day(e), *(r[1:2] or [1000]), 1, i) for i, (u, c, a, b, e, *r) in enumerate(rows, 1)]
            return spark.createDataFrame(full, schemas.RECEIPT)

        def txns(self, *rows):
            """(user, coupon, pay[, paid, reduced, order]); keys 1, 2, ..."""
            full = [(u, 1, *(r[2:3] or [i]), c, 1, "A", day(p), *(r[0:1] or [500]), *(r[1:2] or [0]), i) for i, (u, c, p, *r) in enumerate(rows, 1)]
            return spark.createDataFrame(full, schemas.TXN)

        def labelled(self, *rows):
            """(user, coupon, amount, limit, receive, start, end, valid, fh, st)"""
            full = [(u, c, a, p, day(r), day(s), day(e), v, f, t, i) for i, (u, c, a, p, r, s, e, v, f, t) in enumerate(rows, 1)]
            return spark.createDataFrame(full, schemas.LABELLED)

        def visits(self, *rows):
            return spark.createDataFrame([(u, day(d)) for u, d in rows], schemas.VISIT)

    return Make()


@pytest.fixture
def by_key():
    def rows(df, key="receipt_key"):
        return {r[key]: r for r in df.collect()}

    return rows
