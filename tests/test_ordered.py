"""Running values in stretches of several levels against plain windows."""

import random

import pytest
from pyspark.sql import Window, functions as F

from egresslens.operators.ordered import running


@pytest.mark.parametrize("levels", [1, 2, 3])
@pytest.mark.parametrize("inclusive", [True, False])
def test_levels_equal_the_plain_window(spark, levels, inclusive):
    """One key with almost all rows and a null key, at width 10 and a fan of 4; sums and last values with gaps."""
    draw = random.Random(levels)
    rows = [(draw.choice(["hot"] * 9 + ["x", None]), i * draw.choice([1, 3]), i, draw.randint(0, 9),
             draw.choice([None, None, i])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, at long, tie int, n int, v int")
    got = running(df, ["k"], ["at", "tie"], {"total": F.col("n").cast("bigint")}, {"seen": F.col("v")}, 10, inclusive, levels, 4)
    upto = Window.partitionBy("k").orderBy("at", "tie").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = df.withColumns({"total": F.coalesce(F.sum("n").over(upto), F.lit(0)), "seen": F.last("v", ignorenulls=True).over(upto)})
    key = lambda d: sorted((tuple(r) for r in d.select("k", "at", "tie", "n", "v", "total", "seen").collect()), key=repr)
    assert key(got) == key(want)
