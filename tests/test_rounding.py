import math

import numpy as np
from pyspark.sql import functions as F

from vantage.functions.rounding import rounded


def test_arrays_are_rounded_as_columns_are(spark):
    rng = np.random.default_rng(5)
    x = [0.0, -0.0, 5e-7, -5e-7, 4.9999999999999e-7, 1.0000005, -1.0000005, 2.5e-6, 0.1234565, 1e-300, -1e-300, 1.0, 4.5e9 + 0.1234565, 2.0**60, -1e25, math.inf, -math.inf, math.nan]
    x += (rng.integers(-(10**8), 10**8, 4000) / 1e7).tolist()  # one in ten lies half way
    x += (rng.integers(-(10**8), 10**8, 1000) / 1e7 * (1 + 2.0**-52)).tolist() + (rng.normal(size=4000) * 10.0 ** rng.integers(-8, 12, 4000)).tolist()
    want = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i long, x double").withColumn("x", F.round("x", 6)).orderBy("i").collect()
    found = rounded(np.array(x), 6).tolist()
    assert [(repr(f), v) for f, v, r in zip(found, x, want) if repr(f) != repr(r.x)] == []
