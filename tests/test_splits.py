import pytest
from pyspark.sql import functions as F

from tideline.operators import splits as S


def people(spark, n, positives):
    return spark.range(n).select(
        F.concat(F.lit("c"), "id").alias("key"), (F.col("id") < positives).cast("int").alias("label")
    )


@pytest.mark.parametrize(("n", "positives", "test"), [(7043, 1869, 1409), (10, 3, 2), (101, 50, 21)])
def test_split_is_exact_and_stratified(spark, n, positives, test):
    df = S.stratified_split(people(spark, n, positives), key="key", label="label", seed=42)
    rows = df.collect()
    assert len(rows) == len({r.key for r in rows}) == n
    held = [r for r in rows if r.part == "test"]
    assert len(held) == test
    share = sum(r.label for r in held) / test
    assert abs(share - positives / n) <= 1 / test


def test_split_depends_on_the_seed_alone(spark):
    df = people(spark, 500, 100)
    one = set(S.stratified_split(df, key="key", label="label", seed=1).collect())
    again = set(S.stratified_split(df.repartition(7), key="key", label="label", seed=1).collect())
    other = set(S.stratified_split(df, key="key", label="label", seed=2).collect())
    assert one == again != other


def test_one_class_only(spark):
    df = S.stratified_split(people(spark, 20, 0), key="key", label="label", seed=3)
    assert df.where("part = 'test'").count() == 4


@pytest.mark.parametrize(("n", "positives"), [(5634, 1495), (23, 7)])
def test_folds_differ_by_one_row_at_most(spark, n, positives):
    df = S.stratified_folds(people(spark, n, positives), key="key", label="label", seed=42)
    sizes = [r["count"] for r in df.groupBy("fold").count().collect()]
    per_label = df.groupBy("label", "fold").count().collect()
    assert sum(sizes) == n and len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    for label in (0, 1):
        mine = [r["count"] for r in per_label if r.label == label]
        assert max(mine) - min(mine) <= 1


def test_bootstrap_draws_with_replacement(spark):
    df = people(spark, 50, 10)
    rows = S.bootstrap_sample(df, key="key", seed=9, n=200).collect()
    assert len(rows) == 200 and all(r.synthetic for r in rows)
    assert 1 < len({r.key for r in rows}) <= 50
    assert rows and set(rows) == set(S.bootstrap_sample(df, key="key", seed=9, n=200).collect())


def test_parts_do_not_overlap(spark):
    df = S.stratified_split(people(spark, 300, 90), key="key", label="label", seed=5)
    assert S.overlap(df, key="key").isEmpty()
    audit = S.split_audit(df, group="part", label="label").collect()
    assert {r.member: r.n for r in audit} == {"train": 240, "test": 60}
    assert all(r.within_tolerance for r in audit)
