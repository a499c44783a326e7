"""Running values inside groups that may hold any share of the rows.

A plain window sorts a whole group in one task. Here a group is cut into stretches of the order
column (``width`` wide); windows run inside the stretches, each stretch is reduced to one summary
row, and the summaries of the earlier stretches are added. With more ``levels`` the summaries are cut into
stretches of ``FAN`` again, level by level, so that no window holds more. The cut depends on the data alone, so
a recomputed task gives the same result.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

DEFAULT_WIDTH = 100_000
#: Stretches of one level that make a stretch of the next.
FAN = 10_000
_CUT = "__stretch"


def left_join_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that treats NULL keys as equal."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, same, "left").drop(*[f"__r_{k}" for k in keys])


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None,
            lasts: dict[str, Column] | None = None, width: int = DEFAULT_WIDTH,
            inclusive: bool = True, levels: int = 1, fan: int = FAN) -> DataFrame:
    """Add running sums and last non-NULL values per group, up to or before each row.

    ``order`` starts with an integer column; together with the keys it must identify a row. One level is enough
    while a key has fewer than ``fan`` stretches or so; each further one allows ``fan`` times as many.
    """
    sums, lasts = sums or {}, lasts or {}
    cut = df.withColumn(_CUT, F.floor(F.col(order[0]) / width))
    parts = keys + [_CUT]
    upto = Window.partitionBy(*parts).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    local = cut.withColumns(
        {n: F.sum(c).over(upto) for n, c in sums.items()}
        | {n: F.last(c, ignorenulls=True).over(upto) for n, c in lasts.items()})
    position = F.struct(*order)
    summary = cut.groupBy(*parts).agg(
        *[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()],
        *[F.max_by(c, F.when(c.isNotNull(), position)).alias(f"__s_{n}") for n, c in lasts.items()])
    if levels > 1:
        held = f"__stretch{levels}"
        carried = running(
            summary.withColumnRenamed(_CUT, held), keys, [held], {f"__c_{n}": F.col(f"__s_{n}") for n in sums},
            {f"__c_{n}": F.col(f"__s_{n}") for n in lasts}, fan, False, levels - 1, fan,
        ).withColumnRenamed(held, _CUT).drop(*[f"__s_{n}" for n in [*sums, *lasts]])
    else:
        before = Window.partitionBy(*keys).orderBy(_CUT).rowsBetween(Window.unboundedPreceding, -1)
        carried = summary.select(
            *parts,
            *[F.sum(f"__s_{n}").over(before).alias(f"__c_{n}") for n in sums],
            *[F.last(f"__s_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in lasts])
    joined = left_join_on(local, carried, parts)
    combined = (
        {n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"__c_{n}"), F.lit(0)) for n in sums}
        | {n: F.coalesce(F.col(n), F.col(f"__c_{n}")) for n in lasts})
    return joined.withColumns(combined).drop(_CUT, *[f"__c_{n}" for n in combined])


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "row_no",
             width: int = DEFAULT_WIDTH, levels: int = 1) -> DataFrame:
    """Number the rows of each group from 1 in order."""
    return running(df, keys, order, sums={name: F.lit(1).cast("bigint")}, width=width, levels=levels)
