"""Ordered scans over each key that also work where one key has most of the rows.

A window partitioned by the key alone sorts all rows of a key in one task. So the rows
of the largest key are counted first; beyond ``WHOLE_KEY`` rows are dealt in ranges of
(key, order), and a large key lies in several slices one after the other. Each slice is
scanned by itself; what the next slice needs to go on (the last row, sums, the last
values that are not null) is one summary row per slice and key, and only keys that reach
over the end of a slice have more than one. The summaries of such keys are at most two
a slice; their running state is handed back to the rows as a table of that size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.runtime import materialize

#: Rows of a key up to which it is scanned in one piece.
WHOLE_KEY = 1_000_000
SLICE = "_slice"


@dataclass(frozen=True)
class Sliced:
    """Rows that can be scanned by ``scan``; ``split`` says whether keys lie in several slices (column ``_slice``)."""

    rows: DataFrame
    split: bool

    def add(self, columns: Mapping[str, Column]) -> Sliced:
        return Sliced(self.rows.withColumns(dict(columns)), self.split)

    def scan(
        self,
        keys: Sequence[str],
        order: Sequence[Column],
        previous: Mapping[str, Sequence[str]] | None = None,
        running: Mapping[str, Column] | None = None,
        latest: Mapping[str, Column] | None = None,
        before: Mapping[str, Column] | None = None,
        first: Mapping[str, Column] | None = None,
    ) -> Sliced:
        """Add columns, each over the rows of the same keys in ``order`` (which must be total).

        ``previous``: a struct of the named columns of the row before, null on the first. ``running``: the sum up to and
        with the row. ``latest`` / ``before``: the last value that is not null up to and with / before the row. ``first``:
        the value of the first row. Rows may be scanned again by more keys than they were sliced by.
        """
        previous, running, latest, before, first = (x or {} for x in (previous, running, latest, before, first))
        rows, pieces = self.rows, ([SLICE] if self.split else [])
        by = Window.partitionBy(*pieces, *keys).orderBy(*order)
        upto, behind = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
        local = {n: F.lag(F.struct(*cols)).over(by) for n, cols in previous.items()}
        local |= {n: F.sum(c).over(upto) for n, c in running.items()}
        local |= {n: F.last(c, ignorenulls=True).over(upto) for n, c in latest.items()}
        local |= {n: F.last(c, ignorenulls=True).over(behind) for n, c in before.items()}
        local |= {n: F.first(c).over(upto) for n, c in first.items()}
        if not self.split:
            return Sliced(rows.withColumns(local), False)

        # what a slice hands on: a row per slice and key, from the last row of each
        known = {**latest, **before}
        whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ends = {f"_scan_p_{n}": F.last(F.struct(*cols)).over(whole) for n, cols in previous.items()}
        ends |= {f"_scan_r_{n}": F.sum(c).over(whole) for n, c in running.items()}
        ends |= {f"_scan_l_{n}": F.last(c, ignorenulls=True).over(whole) for n, c in known.items()}
        ends |= {f"_scan_f_{n}": F.first(F.struct(c.alias("v"))).over(whole) for n, c in first.items()}
        summary = rows.withColumns(ends).withColumn("_scan_row", F.row_number().over(by)).filter("_scan_row = 1").select(SLICE, *keys, *ends)
        more = summary.withColumn("_scan_slices", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("_scan_slices > 1")
        past = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        carry = more.select(
            F.col(SLICE).alias("_scan_s"),
            *[F.col(k).alias(f"_scan_k{i}") for i, k in enumerate(keys)],
            *[F.last(f"_scan_p_{n}", ignorenulls=True).over(past).alias(f"_scan_p_{n}") for n in previous],
            *[F.sum(f"_scan_r_{n}").over(past).alias(f"_scan_r_{n}") for n in running],
            *[F.last(f"_scan_l_{n}", ignorenulls=True).over(past).alias(f"_scan_l_{n}") for n in known],
            *[F.first(f"_scan_f_{n}").over(past).alias(f"_scan_f_{n}") for n in first],
        )
        here = F.col(SLICE) == F.col("_scan_s")
        for i, k in enumerate(keys):
            here = here & F.col(k).eqNullSafe(F.col(f"_scan_k{i}"))
        joined = rows.withColumns({f"_scan_c_{n}": c for n, c in local.items()}).join(F.broadcast(carry), here, "left")  # at most two rows a slice
        out = {n: F.coalesce(f"_scan_c_{n}", f"_scan_p_{n}") for n in previous}
        out |= {n: F.col(f"_scan_c_{n}") + F.coalesce(f"_scan_r_{n}", F.lit(0)) for n in running}
        out |= {n: F.coalesce(f"_scan_c_{n}", f"_scan_l_{n}") for n in known}
        out |= {n: F.when(F.col(f"_scan_f_{n}").isNull(), F.col(f"_scan_c_{n}")).otherwise(F.col(f"_scan_f_{n}")["v"]) for n in first}
        return Sliced(joined.withColumns(out).select(*rows.columns, *out), True)


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> Sliced:
    """``df`` ready to be scanned by ``keys`` in ``order``; where a key is large, in ranges of both, written."""
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= WHOLE_KEY:
        return Sliced(df, False)
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return Sliced(materialize(ranged.withColumn(SLICE, F.spark_partition_id()), "sliced").repartition(SLICE), True)
