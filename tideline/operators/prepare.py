"""Feature preparation, fitted on training rows only.

Statistics are tables: one row per (group, feature), so all folds are fitted
in one aggregation. Only these few rows ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Transformer
from pyspark.ml.feature import (
    ElementwiseProduct,
    OneHotEncoder,
    SQLTransformer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions import vocabulary as V
from tideline.operators.prefix import value_cells
from tideline.operators.quantiles import fold_medians, medians, unpivot
from tideline.session import materialize


def feature_groups(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns by type; a boolean counts as numeric.

    Columns of any other type are dropped, as are the row key, the label and
    ``exclude``.
    """
    skip = {V.ROW_KEY, V.LABEL, "label", *exclude}
    fields = [f for f in df.schema if f.name not in skip]
    numeric = [
        f.name for f in fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]
    return numeric, [f.name for f in fields if isinstance(f.dataType, T.StringType)]


def train_copies(df: DataFrame, fold: str = "fold", folds: int = V.FOLDS) -> DataFrame:
    """Each row once for every fold it helps to train, as column ``trains``.

    Only followed by aggregations, which combine the copies before the shuffle.
    """
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col(fold))
    return df.withColumn("trains", F.explode(others))


def fit_numeric(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Median, and mean and population deviation after filling nulls with it.

    The moments of the filled column follow from those of the non-null values
    and the null count, so the fill needs no second pass.
    """
    long = unpivot(df, groups, columns, "double")
    moments = long.groupBy(*groups, "feature").agg(
        F.count("*").alias("n"),
        F.count("value").alias("known"),
        F.avg("value").alias("m"),
        F.var_pop("value").alias("v"),
    )
    return _filled(moments.join(medians(df, columns, groups), [*groups, "feature"]), groups)


def _filled(joined: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Mean and deviation once nulls are filled with the median."""
    known, missing, n = F.col("known"), F.col("n") - F.col("known"), F.col("n")
    total = F.col("total") if "total" in joined.columns else known * F.col("m")
    mean = (F.coalesce(total, F.lit(0.0)) + F.when(missing > 0, missing * F.col("median")).otherwise(0.0)) / n
    variance = (
        known * (F.col("v") + F.pow(F.col("m") - F.col("mean"), F.lit(2.0)))
        + missing * F.pow(F.col("median") - F.col("mean"), F.lit(2.0))
    ) / n
    return (
        joined.withColumn("mean", mean)
        .withColumn("std", F.sqrt(variance))
        .select(*groups, "feature", "n", (n - known).alias("nulls"), "median", "mean", "std")
    )


def fit_fold_numeric(
    df: DataFrame, columns: Sequence[str], fold: str = "fold", folds: int = V.FOLDS
) -> DataFrame:
    """What ``fit_numeric`` gives for the rows outside each fold, by ``trains``; no row is copied.

    One pass counts rows per (fold, feature, value cell) with their moments.
    What a fold's training side holds of a cell is what the other folds hold,
    so moments and the cell of the median follow from these counts. A second
    pass reads the values of the median's cells alone.
    """
    long = unpivot(df, [fold], columns, "double")
    coarse, fine = value_cells(F.col("value"))
    celled = long.withColumn("_c", F.when(F.col("value").isNotNull(), coarse))
    cells = materialize(
        celled.groupBy(fold, "feature", "_c").agg(
            F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
        ),
        "fold-cells",
    )
    # Copies of counts: a few thousand rows a feature and fold.
    sides = train_copies(cells, fold, folds)
    known = F.when(F.col("_c").isNotNull(), F.col("n"))
    side = Window.partitionBy("trains", "feature")
    centred = sides.withColumn("mean", F.sum("total").over(side) / F.sum(known).over(side))
    spread = known * (F.col("v") + F.pow(F.col("m") - F.col("mean"), F.lit(2.0)))
    moments = centred.groupBy("trains", "feature").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(known), F.lit(0)).alias("known"),
        F.max("mean").alias("m"), F.sum("total").alias("total"), (F.sum(spread) / F.sum(known)).alias("v"),
    )
    counts = sides.where(F.col("_c").isNotNull()).groupBy("trains", "feature", "_c").agg(F.sum("n").alias("n"))
    middle = fold_medians(celled.where(F.col("_c").isNotNull()), counts, fold, fine)
    return _filled(moments.join(middle, ["trains", "feature"], "left"), ["trains"])


def fit_fold_categories(
    df: DataFrame, columns: Sequence[str], fold: str = "fold", folds: int = V.FOLDS
) -> DataFrame:
    """Categories seen outside each fold, by ``trains``, from one count of the rows."""
    counted = fit_categories(df, columns, [fold])
    return train_copies(counted, fold, folds).groupBy("trains", "feature", "value").agg(F.sum("n").alias("n"))


def median_impute(value: Column, median: Column) -> Column:
    return F.coalesce(value.cast("double"), median)


def standard_scale(value: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std; a constant column scales to zero."""
    return (value - mean) / F.when(std > 0, std).otherwise(1.0)


def stats_row(stats: DataFrame) -> Column:
    """All statistics as one scalar map: feature -> (median, mean, std)."""
    entry = F.struct("feature", F.struct("median", "mean", "std"))
    return stats.agg(F.map_from_entries(F.collect_list(entry)).alias("stats")).scalar()


def scale_columns(df: DataFrame, columns: Sequence[str], stats: DataFrame) -> DataFrame:
    """Impute and scale with fitted statistics; one narrow projection."""
    row = F.col("_stats")
    return df.withColumn("_stats", stats_row(stats)).withColumns(
        {
            f"{c}_scaled": standard_scale(
                median_impute(F.col(c), row[c]["median"]), row[c]["mean"], row[c]["std"]
            )
            for c in columns
        }
    ).drop("_stats")


def fit_categories(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Categories seen in training, per (group, feature), with their count."""
    return (
        unpivot(df, groups, columns, "string")
        .where(F.col("value").isNotNull())
        .groupBy(*groups, "feature", "value")
        .agg(F.count("*").alias("n"))
    )


def one_hot_long(
    df: DataFrame, key: str, columns: Sequence[str], categories: DataFrame
) -> DataFrame:
    """(key, feature, category, hot): unseen and missing values are all zeros."""
    listed = categories.groupBy("feature").agg(F.array_sort(F.collect_list("value")).alias("c"))
    known = listed.agg(F.map_from_entries(F.collect_list(F.struct("feature", "c")))).scalar()

    def cells_of(column: str) -> Column:
        value = F.col(column).cast("string")
        return F.transform(
            F.col("_known")[column],
            lambda category: F.struct(
                F.lit(column).alias("feature"),
                category.alias("category"),
                F.coalesce(value == category, F.lit(False)).cast("int").alias("hot"),
            ),
        )

    cells = F.array(*[cells_of(c) for c in columns])
    rows = df.select(key, *columns).withColumn("_known", known)
    return rows.select(key, F.inline(F.flatten(cells)))


def imbalance_weights(df: DataFrame, label: str = "label", groups: Sequence[str] = ()) -> DataFrame:
    """Class counts of the training rows and the weights that follow from them."""
    pos, neg = F.col("positives"), F.col("negatives")
    n = (pos + neg).cast("double")
    spw = F.when(pos > 0, neg.cast("double") / pos).otherwise(1.0)
    return (
        df.groupBy(*groups)
        .agg(
            F.count_if(F.col(label) == 1).alias("positives"),
            F.count_if(F.col(label) == 0).alias("negatives"),
        )
        .withColumns(
            {
                "scale_pos_weight": spw,
                "balanced_positive": F.when(pos > 0, n / (2 * pos)).otherwise(1.0),
                "balanced_negative": F.when(neg > 0, n / (2 * neg)).otherwise(1.0),
                "fitted_on": F.lit("fold-train labels only"),
            }
        )
    )


@dataclass(frozen=True)
class Preparer:
    """Fitted statistics of one training set, small enough for literals."""

    numeric: dict[str, tuple[float, float, float]]
    categories: dict[str, list[tuple[str, float]]]
    positives: int
    negatives: int
    names: list[str] = field(default_factory=list)

    @property
    def scale_pos_weight(self) -> float:
        return self.negatives / self.positives if self.positives else 1.0

    def columns(self) -> dict[str, Column]:
        """Prepared columns by name, numeric ones first."""
        out = {}
        for c, (median, mean, std) in self.numeric.items():
            filled = median_impute(F.col(c), F.lit(median))
            out[f"num__{c}"] = standard_scale(filled, F.lit(mean), F.lit(std))
        for c, seen in self.categories.items():
            for category, _ in seen:
                hot = F.coalesce(F.col(c) == F.lit(category), F.lit(False))
                out[f"cat__{c}_{category}"] = hot.cast("double")
        return out

    def feature_names(self) -> list[str]:
        return [f"num__{c}" for c in self.numeric] + [
            f"cat__{c}_{category}" for c, seen in self.categories.items() for category, _ in seen
        ]

    def raw_names(self) -> list[str]:
        """Raw column of every prepared column, in the same order."""
        return list(self.numeric) + [c for c, seen in self.categories.items() for _ in seen]

    def background(self) -> list[float]:
        """Training mean of every prepared column."""
        rows = max(self.positives + self.negatives, 1)
        return [0.0] * len(self.numeric) + [
            n / rows for seen in self.categories.values() for _, n in seen
        ]

    def stages(self) -> list[Transformer]:
        """The same preparation as ML stages, which save and load natively.

        Categories become positions in a sparse vector; one that training has
        not seen, or a missing one, is all zeros.
        """
        parts = []
        for c, (median, mean, std) in self.numeric.items():
            name = c.replace("`", "``")
            parts.append(
                f"(coalesce(double(`{name}`), double({median!r})) - double({mean!r})) "
                f"/ double({std if std > 0 else 1.0!r}) AS `num__{name}`"
            )
        out: list[Transformer] = []
        made = [f"num__{c}" for c in self.numeric]
        if parts:
            out.append(SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__"))
        inputs = list(made)
        seen = {c: [category for category, _ in v] for c, v in self.categories.items() if v}
        if seen:
            index = [f"index__{c}" for c in seen]
            hot = [f"cat__{c}" for c in seen]
            indexers = [
                StringIndexerModel.from_labels(labels, inputCol=c, outputCol=i, handleInvalid="keep")
                for (c, labels), i in zip(seen.items(), index)
            ]
            columns = ", ".join("`" + c.replace("`", "``") + "` string" for c in seen)
            indexed = SparkSession.active().createDataFrame([], columns)
            for indexer in indexers:
                indexed = indexer.transform(indexed)
            # The sizes come from the labels; no row is read.
            encoder = OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True)
            out += [*indexers, encoder.fit(indexed)]
            inputs += hot
            made += [*index, *hot]
        width = len(self.feature_names())
        out += [
            VectorAssembler(inputCols=inputs, outputCol="assembled"),
            # Leaves the notes on 0/1 columns behind: trees see plain numbers.
            ElementwiseProduct(
                scalingVec=Vectors.dense([1.0] * width), inputCol="assembled", outputCol="features"
            ),
        ]
        made.append("assembled")
        dropped = ", ".join("`" + n.replace("`", "``") + "`" for n in made)
        out.append(SQLTransformer(statement=f"SELECT * EXCEPT ({dropped}) FROM __THIS__"))
        return out


def fit_preparers(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    *,
    label: str = "label",
    group: str,
) -> dict[int, Preparer]:
    """One preparer per value of ``group``, all fitted in the same few jobs."""
    return _preparers(
        imbalance_weights(df, label, [group]),
        fit_numeric(df, numeric, [group]) if numeric else None,
        fit_categories(df, categorical, [group]) if categorical else None,
        numeric, categorical, group,
    )


def fit_fold_preparers(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    *,
    label: str = "label",
    fold: str = "fold",
    folds: int = V.FOLDS,
) -> dict[int, Preparer]:
    """One preparer per fold, fitted on the other folds' rows."""
    labels = df.groupBy(fold, F.col(label).alias("label")).agg(F.count("*").alias("n"))
    sides = train_copies(labels, fold, folds).groupBy("trains").agg(
        F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("n"))), F.lit(0)).alias("positives"),
        F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("n"))), F.lit(0)).alias("negatives"),
    )
    return _preparers(
        sides,
        fit_fold_numeric(df, numeric, fold, folds) if numeric else None,
        fit_fold_categories(df, categorical, fold, folds) if categorical else None,
        numeric, categorical, "trains",
    )


def _preparers(
    counts: DataFrame, numbers: DataFrame | None, words: DataFrame | None,
    numeric: Sequence[str], categorical: Sequence[str], group: str,
) -> dict[int, Preparer]:
    weights = counts.collect()
    stats_of = numbers.collect() if numbers is not None else []
    # What the fitted model itself holds: the categories of the training rows.
    seen_by = words.collect() if words is not None else []
    out = {}
    for w in weights:
        g = w[group]
        stats = {r["feature"]: r for r in stats_of if r[group] == g}
        seen: dict[str, list] = {c: [] for c in categorical}
        for r in seen_by:
            if r[group] == g:
                seen[r["feature"]].append((r["value"], r["n"]))
        out[g] = Preparer(
            numeric={
                c: (stats[c]["median"] or 0.0, stats[c]["mean"] or 0.0, stats[c]["std"] or 0.0)
                for c in numeric
                if c in stats
            },
            categories={c: sorted(v) for c, v in seen.items()},
            positives=w["positives"],
            negatives=w["negatives"],
        )
    return out
