"""Gold tables kept up to date by group: after a batch, only groups of changed rows are computed again.

For each input, a table says by which expressions its rows belong to groups (or, where that takes another input, how to
find the groups of changed rows). Changed rows are those of folders that the last build did not read, and of folders that
are gone; rows that stand in both cancel out. Groups of changed rows are semi-joined to the inputs before the builder
sees them, and their new rows take the place of the old ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.evolution import evolved_union
from quern.operators.rows import business_columns, row_hash

Finder = Callable[[DataFrame, dict[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class Groups:
    """columns: of the result, whose values make a group (they may be coarser than its rows). by: for an input, a SQL expression
    for each column. through: for an input without these, a function of its changed rows and all inputs that gives groups.
    finish: what is computed over all groups (a share of the total), from the rows of the result."""

    columns: tuple[str, ...]
    by: dict[str, tuple[str, ...]]
    through: dict[str, Finder] = field(default_factory=dict)
    finish: Callable[[DataFrame], DataFrame] | None = None

    def of(self, name: str, rows: DataFrame, inputs: dict[str, DataFrame]) -> DataFrame | None:
        """The groups that rows of an input belong to; None if that input has none of its own."""
        if name in self.by:
            return rows.select(*(F.expr(e).alias(c) for e, c in zip(self.by[name], self.columns, strict=True))).distinct()
        return self.through[name](rows, inputs).select(*self.columns).distinct() if name in self.through else None


def net_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of either side that the other has not, as often as it has not; technical columns do not count.

    Rows without a match in kind are told by a hash of their values, one aggregate for both sides. Columns that only one
    side has are null on the other.
    """
    columns = business_columns(new) + [c for c in business_columns(old) if c not in new.columns]
    own = [c for c in old.columns if c in columns], [c for c in new.columns if c in columns]
    both = evolved_union([old.select(*own[0]).withColumn("_sign", F.lit(-1)), new.select(*own[1]).withColumn("_sign", F.lit(1))])
    both = both.withColumn("_hash", row_hash(both.select(*columns)))
    sums = both.groupBy("_hash").agg(F.sum("_sign").alias("_net"), *(F.first(c).alias(c) for c in columns))
    return sums.where("_net <> 0").select(*columns)


def within(rows: DataFrame, exprs: tuple[str, ...], groups: DataFrame, columns: tuple[str, ...], how: str = "left_semi") -> DataFrame:
    """The rows of some groups (or, with left_anti, of all others); null is a value of a group."""
    names = [f"_group_{k}" for k in range(len(columns))]
    marked = rows.withColumns({n: F.expr(e) for n, e in zip(names, exprs, strict=True)})
    keys = groups.select(*(F.col(c).alias(f"{n}_of") for c, n in zip(columns, names, strict=True)))
    on = [F.col(n).eqNullSafe(F.col(f"{n}_of")) for n in names]
    return marked.join(keys, on, how).drop(*names)


def kept_up(name: str, build: Callable[[dict[str, DataFrame]], DataFrame], groups: Groups, inputs: dict[str, DataFrame], changes: dict[str, tuple[DataFrame, DataFrame]], before: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table after a batch. before: as it was; changes: old and new rows of the inputs that have any; keep writes and rereads."""
    found = [g for i, (old, new) in changes.items() if (g := groups.of(i, net_changes(old, new), inputs)) is not None]
    if not found:
        return before
    touched = keep(evolved_union(found).distinct())
    fresh = build({i: within(df, groups.by[i], touched, groups.columns) if i in groups.by else df for i, df in inputs.items()})
    # a builder may give rows of other groups, as an input that is no part of them was not reduced
    fresh = within(fresh, groups.columns, touched, groups.columns)
    rest = within(before.select(*fresh.columns), groups.columns, touched, groups.columns, "left_anti")
    out = evolved_union([rest, fresh])
    return groups.finish(out) if groups.finish else out
