"""Cleaning rules and data-quality checks of the subscriber profile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions import vocabulary as V
from tideline.functions.numeric import blank, round_dp, strip
from tideline.sources.checks import WriteChecks


def trim_headers(df: DataFrame) -> DataFrame:
    """Strip whitespace from column names; two names may not become one."""
    names = [c.strip() for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"column names collide after trimming: {names}")
    return df.toDF(*names)


def expect_shape(
    df: DataFrame, rows: int, columns: int, *, checks: WriteChecks | None = None
) -> DataFrame:
    """Return the table unchanged, or raise if its shape is not the expected one.

    With ``checks`` the rows are counted by the job that writes the table.
    """
    if checks is not None:
        if len(df.columns) != columns:
            raise ValueError(f"unexpected number of columns {len(df.columns)}, expected {columns}")
        wrong = f"unexpected number of rows {{found}}, expected {rows}"
        return checks.expect(df, {"rows": (F.lit(True), rows, wrong)})
    found = (df.count(), len(df.columns))
    if found != (rows, columns):
        raise ValueError(f"unexpected shape {found}, expected {(rows, columns)}")
    return df


def drop_identifier(df: DataFrame, key: str = V.ROW_KEY) -> DataFrame:
    """Drop the row key; a table without one is refused."""
    if key not in df.columns:
        raise ValueError(f"missing required column {key!r}")
    return df.drop(key)


def trim_strings(df: DataFrame) -> DataFrame:
    """Strip all outer whitespace, tabs and line ends too, from string columns."""
    return df.select(
        *[
            strip(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema
        ]
    )


def flag_to_bool(df: DataFrame, column: str = V.FLAG) -> DataFrame:
    """Cast a 0/1 column (number or text) to boolean."""
    return df.withColumn(column, F.col(column).cast("int").cast("boolean"))


def count_blank(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Rows that are null or whitespace only, per column."""
    return df.groupBy(*groups).agg(
        *[F.count_if(blank(F.col(c))).alias(f"blank_{c}") for c in columns]
    )


def rule_violations(
    df: DataFrame, column: str, guard: Column, groups: Sequence[str] = ()
) -> DataFrame:
    """Blank rows, and blank rows for which the guard does not hold."""
    empty = blank(F.col(column))
    return df.groupBy(*groups).agg(
        F.count_if(empty).alias("blanks"),
        F.count_if(empty & ~F.coalesce(guard, F.lit(False))).alias("violations"),
    )


def coerce_numeric_with_rule(
    df: DataFrame, column: str, guard: Column, *, check: bool = True, checks: WriteChecks | None = None
) -> DataFrame:
    """Blank becomes 0.0 where the guard holds; anything else must be a number.

    A blank row outside the guard raises. With ``check`` the violations are
    counted first; without it the same row raises while the job runs, which
    saves the extra pass. Text that is no number raises either way. With
    ``checks`` the job that writes the table counts such rows and texts and
    lets them through as null, so that all of them are reported.
    """
    if checks is not None:
        empty, text = blank(F.col(column)), strip(F.col(column).cast("string"))
        number = text.try_cast("double")
        broken = empty & ~F.coalesce(guard, F.lit(False))
        rule = f"{{found}} blank {column} row(s) violate the blank-row rule"
        counts = {
            f"{column} blank": (broken, 0, rule),
            f"{column} text": (~empty & number.isNull(), 0, f"{{found}} {column} text(s) are no number"),
        }
        return checks.expect(df, counts).withColumn(
            column, F.when(~empty, number).when(guard, F.lit(0.0))
        )
    if check:
        broken = rule_violations(df, column, guard).first()["violations"]
        if broken:
            raise ValueError(f"{broken} blank {column} row(s) violate the blank-row rule")
    text = strip(F.col(column).cast("string"))
    number = text.try_cast("double")
    unreadable = F.raise_error(F.concat(F.lit(f"{column} is no number: "), text)).cast("double")
    return df.withColumn(
        column,
        F.when(~blank(F.col(column)), F.coalesce(number, unreadable))
        .when(guard, F.lit(0.0))
        .otherwise(
            F.raise_error(F.lit(f"blank {column} row violates the blank-row rule")).cast("double")
        ),
    )


def ratio_expr(total: Column, periods: Column) -> Column:
    """total / periods to 4 decimals, null where there is no full period."""
    return F.when(periods > 0, round_dp(total / periods, 4))


def ratio_feature(
    df: DataFrame, total: str = "Total_Charges", periods: str = "tenure", name: str = V.RATIO
) -> DataFrame:
    """Add the ratio of two columns."""
    return df.withColumn(name, ratio_expr(F.col(total), F.col(periods)))


def clean(df: DataFrame, *, check: bool = True, checks: WriteChecks | None = None) -> DataFrame:
    """Trim, flag, coerce, add the ratio: one narrow stage over the raw table."""
    return (
        df.transform(trim_strings)
        .transform(flag_to_bool)
        .withColumn("tenure", F.col("tenure").cast("int"))
        .withColumn("Monthly_Charges", F.col("Monthly_Charges").cast("double"))
        .transform(
            coerce_numeric_with_rule,
            "Total_Charges",
            F.col("tenure") == 0,
            check=check,
            checks=checks,
        )
        .transform(ratio_feature)
    )


def menu_violations(
    df: DataFrame,
    key: str,
    menus: Mapping[str, Sequence[str]] = V.MENUS,
    flag: str = V.FLAG,
) -> DataFrame:
    """Values outside the closed menu of their feature, one row each.

    Menus are short constants, so each check is an IN list and only the
    offending cells are exploded; the table itself is never multiplied.
    """
    bad = []
    for feature, menu in menus.items():
        if feature not in df.columns:
            continue
        value = F.col(feature)
        if feature == flag and dict(df.dtypes)[feature] == "boolean":
            value = F.when(value, "Yes").when(~value, "No")
        text = value.cast("string")
        outside = text.isNotNull() & ~text.isin(*menu)
        bad.append(
            F.when(outside, F.struct(F.lit(feature).alias("feature"), text.alias("value")))
        )
    return df.select(key, F.inline(F.array_compact(F.array(*bad))))


def binarize_label(df: DataFrame, column: str = V.LABEL, name: str = "label") -> DataFrame:
    """1 for the positive class, 0 otherwise (a missing label counts as 0)."""
    positive = F.coalesce(F.col(column) == V.POSITIVE, F.lit(False))
    return df.withColumn(name, positive.cast("int"))


def map_schema(
    df: DataFrame,
    mapping: Mapping[str, str],
    features: Sequence[str],
    label: str = V.LABEL,
) -> tuple[DataFrame, list[str]]:
    """Rename mapped columns, drop the others, report features without a source."""
    if label not in mapping.values():
        raise ValueError(f"the mapping must name a source for {label!r}")
    wanted = [*features, label]
    source = {canonical: external for external, canonical in mapping.items()}
    renamed = df.select(*[F.col(source[c]).alias(c) for c in wanted if c in source])
    return renamed, [f for f in features if f not in source]
