import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from riskloom.session import build_session, checkpoint_dir
    s = build_session("local[4]", 8)
    checkpoint_dir(s)
    yield s
    s.stop()


T0 = dt.datetime(2024, 1, 15, 12, 0, 0)

TXN_DDL = ("transaction_id string, user_id string, timestamp timestamp, amount double, "
           "merchant_category string, country string, device_id string, "
           "is_new_device boolean, device_age_days int, is_foreign boolean, latency_ms double, "
           "is_fraud int")


def txn_rows(spark, rows):
    """rows: dicts with at least transaction_id, user_id, timestamp; defaults fill the rest."""
    dflt = dict(amount=10.0, merchant_category="grocery", country="US", device_id="d1",
                is_new_device=False, device_age_days=365, is_foreign=None, latency_ms=20.0,
                is_fraud=0)
    cols = [c.split()[0] for c in TXN_DDL.split(", ")]
    data = [tuple({**dflt, **r}.get(c) for c in cols) for r in rows]
    return spark.createDataFrame(data, TXN_DDL)


def profile_rows(spark, rows):
    from riskloom import schema as S
    cols = [f.name for f in S.PROFILE.fields]
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], S.PROFILE)
