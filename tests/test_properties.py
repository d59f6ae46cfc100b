"""Property-based check of the feature bundle against the Python oracle."""

import math

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from hostscope.operators.features import FEATURE_COLUMNS, with_host_features

import pyref

PIECES = ["a", "b", "x", "g", "o", "-", ".", "1", "9", "²", "о", "я", "é", " ", "/", ":", "@", "?",
          "#", "www.", "http://", "https://", "xn--", "co.uk", "com", "kawasaki.jp", "ck", "bd",
          "login", "paypal", "google", "sch.uk", "github.io", "рф", "255", "300", "0"]

hosts = st.lists(st.sampled_from(PIECES), min_size=0, max_size=12).map("".join)


# no shrinking: one batch is one Spark job, and a failing batch is printed whole
@settings(max_examples=4, deadline=None, derandomize=True, phases=[Phase.explicit, Phase.reuse, Phase.generate],
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(batch=st.lists(hosts, min_size=50, max_size=120))
def test_features_match_oracle(spark, batch):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(batch)], "i int, domain string")
    rows = {r["i"]: r for r in with_host_features(df, "domain").collect()}
    for i, raw in enumerate(batch):
        exp = pyref.features(raw)
        for c in FEATURE_COLUMNS:
            got = rows[i][c]
            if c == "entropy":
                assert math.isclose(got, exp[c], abs_tol=1e-9), (raw, c)
            else:
                assert got == exp[c], (raw, c, got, exp[c])
