"""Specification-driven cleaning: trim, casing, lenient casts, checks on the values before repair, repair, one row for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scalars import normalize_nulls, to_bool, to_date, to_double, to_int
from quern.operators.rows import business_columns, latest, row_hash
from quern.schema import Rule, TableSpec

CASTS = {"int": to_int, "double": to_double, "date": to_date, "boolean": to_bool}
"""Lenient casts by name; any other type of a specification is a try_cast (money: a decimal, so that sums are exact)."""


def cast_as(c: Column, kind: str) -> Column:
    return CASTS[kind](c) if kind in CASTS else c.try_cast(kind)


def trim_strings(df: DataFrame) -> DataFrame:
    return df.select(*(F.trim(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def failed(rule: Rule, as_of: str | None = None) -> Column:
    """Whether a value fails a rule; a null never does."""
    c = F.col(rule.column)
    if rule.kind == "regex":
        bad = ~c.cast("string").rlike(rule.value)
    elif rule.kind == "range":
        bad = ~c.between(rule.value, rule.high)
    elif rule.kind == "after_today":
        bad = c > (F.lit(as_of).cast("date") if as_of else F.current_date())
    elif rule.kind == "swapped":
        bad = F.col(rule.value) < c
    else:
        bad = {"negative": c < 0, "not_positive": c <= 0, "less_than": c < F.lit(rule.value)}[rule.kind]
    return F.coalesce(bad, F.lit(False))


def flagged(df: DataFrame, rules: list[Rule], as_of: str | None = None) -> DataFrame:
    """Adds _dq_issues (labels of the failed rules in order, joined by ", ", or null) and _dq_flag, in one projection."""
    issues = F.array_compact(F.array(*(F.when(failed(r, as_of), F.lit(r.label)) for r in rules))) if rules else F.array().cast("array<string>")
    return df.withColumns({"_dq_issues": F.nullif(F.array_join(issues, ", "), F.lit("")), "_dq_flag": F.size(issues) > 0})


def repaired(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Values that failed become null, or start and end trade places. Labels were taken before."""
    new: dict[str, Column] = {}
    for r in rules:
        if r.repair == "null":
            new[r.column] = F.when(~failed(r), F.col(r.column))
        elif r.repair == "swap":
            start, end = F.col(r.column), F.col(r.value)
            both = start.isNotNull() & end.isNotNull()
            new[r.column], new[r.value] = F.when(both, F.least(start, end)).otherwise(start), F.when(both, F.greatest(start, end)).otherwise(end)
    return df.withColumns(new) if new else df


def typed(spec: TableSpec, c: str, kind: str) -> Column:
    """A column of all-string bronze: trimmed, null where it stands for one, cased, cast."""
    value = normalize_nulls(F.trim(c)) if kind == "string" and not c.startswith("_") else F.col(c)
    for case, columns in ((F.initcap, spec.initcap), (F.upper, spec.upper), (F.lower, spec.lower)):
        value = case(value) if c in columns else value
    return cast_as(value, spec.casts[c]) if c in spec.casts else value


def repeated_keys(df: DataFrame, spec: TableSpec) -> DataFrame:
    """_key: hashes of the keys of more than one row, for clean_table. Keys that only share a hash may be among them."""
    key = df.select(typed(spec, spec.key, dict(df.dtypes)[spec.key]).alias("_key")).where("_key is not null")
    return key.groupBy(F.xxhash64("_key").alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1").select("_key")


def clean_table(df: DataFrame, spec: TableSpec, as_of: str | None = None, strict: bool = True, repeated: DataFrame | None = None) -> DataFrame:
    """A silver table from all-string bronze, with one shuffle (by the key).

    strict: a column that the specification casts, cases or checks and the data lacks is an error, not passed over.
    Among rows with one key the latest by watermark stays, then clean before dirty source, then by hash, so reruns agree.
    repeated: repeated_keys() of the same rows, few enough to be broadcast; then only rows of these keys are shuffled.
    """
    needed = {spec.key, *spec.initcap, *spec.upper, *spec.lower, *spec.casts, *(r.column for r in spec.rules)}
    if strict and (lost := needed - {*df.columns}):
        raise ValueError(f"{spec.name} lacks {sorted(lost)}")

    def cleaned(rows: DataFrame) -> DataFrame:
        out = rows.select(*(typed(spec, c, t).alias(c) for c, t in rows.dtypes))
        rules = [r for r in spec.rules if r.column in out.columns]
        return repaired(flagged(out, rules, as_of), rules).where(F.col(spec.key).isNotNull())

    def one_each(out: DataFrame) -> DataFrame:
        order = [F.desc_nulls_last(spec.watermark)] if spec.watermark in out.columns else []
        order += [F.asc_nulls_last("_source")] if "_source" in out.columns else []
        return latest(out, [spec.key], [*order, row_hash(out, business_columns(out))])

    if repeated is None or repairs_key(spec):
        return one_each(cleaned(df))
    of = F.xxhash64(typed(spec, spec.key, dict(df.dtypes)[spec.key])) == F.col("_repeated")
    keys = F.broadcast(repeated.select(F.col("_key").alias("_repeated")))
    return cleaned(df.join(keys, of, "left_anti")).unionByName(one_each(cleaned(df.join(keys, of, "left_semi"))))


def repairs_key(spec: TableSpec) -> bool:
    return any(r.repair and spec.key in (r.column, r.value) for r in spec.rules)
