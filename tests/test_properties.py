"""Property-based checks of the column builders against plain-Python
statements of the same rules (many generated values per Spark job)."""

import bisect
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from callgauge.constants import LATENCY_BOUNDS
from callgauge.functions.histogram import bucket_index
from callgauge.functions.pricing import normalise_model

ms_values = st.lists(st.one_of(st.none(), st.integers(min_value=0, max_value=2_147_483_647)),
                     min_size=1, max_size=200)


@settings(max_examples=6, deadline=None)
@given(ms_values)
def test_bucket_index_is_first_bound_strictly_above(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, ms int")
    got = [r.b for r in df.select("i", bucket_index("ms").alias("b")).orderBy("i").collect()]
    exp = [None if v is None else min(bisect.bisect_right(LATENCY_BOUNDS, v) + 1, len(LATENCY_BOUNDS))
           for v in values]
    assert got == exp


names = st.lists(st.builds(lambda p, base, d: p + base + d,
                           st.sampled_from(["", "anthropic.", "openai.", "us.", "eu.", "us.anthropic.", "x."]),
                           st.sampled_from(["claude-opus-5", "gpt-4.1", "claude-haiku-4-5", "m"]),
                           st.sampled_from(["", "-20251001", "-2025100", "-20251001-20251002"])),
                 min_size=1, max_size=60)


@settings(max_examples=6, deadline=None)
@given(names)
def test_normalise_model_strips_one_prefix_then_date(spark, models):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(models)], "i int, model string")
    got = [r.n for r in df.select("i", normalise_model("model").alias("n")).orderBy("i").collect()]
    exp = [re.sub(r"-\d{8}$", "", re.sub(r"^(anthropic|openai|us|eu)\.", "", m)) for m in models]
    assert got == exp
