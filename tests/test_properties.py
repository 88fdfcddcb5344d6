"""Property tests: Spark operators against plain pandas statements on random events."""

import datetime as dt

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from eventscope.operators import metrics as M
from eventscope.operators import timeseries as TS
from eventscope.operators.normalize import prepare

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)
TYPES = ["login", "logout", "purchase", "add_to_cart", "view_product"]
EVENTS = st.lists(st.tuples(st.sampled_from(["U1", "U2", "U3", "U4"]), st.sampled_from(TYPES),
                            st.integers(min_value=0, max_value=600)), min_size=1, max_size=40)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _frame(spark, rows):
    data = [(u, t, T0 + dt.timedelta(seconds=s)) for u, t, s in rows]
    return prepare(spark.createDataFrame(data, "event_id string, event_type string, ts timestamp_ntz")), data


@SETTINGS
@given(rows=EVENTS)
def test_journeys_equal_pandas(spark, rows):
    df, data = _frame(spark, rows)
    got = {r.event_id: r.journey_type for r in M.journeys(df).collect()}
    pdf = pd.DataFrame(data, columns=["event_id", "event_type", "ts"])

    def classify(s):
        s = set(s)
        if "login" in s and "purchase" in s:
            return "Completed Purchase"
        if "login" in s and "add_to_cart" in s:
            return "Abandoned Cart"
        return "Browsing Only" if "login" in s else "Other"

    assert got == pdf.groupby("event_id")["event_type"].apply(classify).to_dict()


@SETTINGS
@given(rows=EVENTS, bucket=st.sampled_from(["5s", "30s", "1min"]))
def test_dense_series_equals_resample(spark, rows, bucket):
    df, data = _frame(spark, rows)
    got = {r.timestamp: r.event_count for r in TS.dense_counts(df, bucket).collect()}
    pdf = pd.DataFrame(data, columns=["event_id", "event_type", "ts"]).set_index("ts")
    freq = {"5s": "5s", "30s": "30s", "1min": "1min"}[bucket]
    want = {k.to_pydatetime(): int(v) for k, v in pdf.resample(freq).size().items()}
    assert got == want


@SETTINGS
@given(rows=EVENTS)
def test_user_steps_equal_rank(spark, rows):
    df, data = _frame(spark, rows)
    from pyspark.sql import functions as F
    df = df.withColumn("row_id", F.monotonically_increasing_id())
    got = sorted((r.event_id, r.step, r.ts, r.row_id) for r in M.ordered_steps(df, chunk_us=60_000_000).collect())
    by_user = {}
    for r in sorted(df.select("event_id", "ts", "row_id").collect(), key=lambda r: (r.event_id, r.ts, r.row_id)):
        by_user.setdefault(r.event_id, []).append(r)
    want = sorted((u, i + 1, r.ts, r.row_id) for u, rs in by_user.items() for i, r in enumerate(rs))
    assert got == want
