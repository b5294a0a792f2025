"""Passes over few rows use few tasks and no shuffle; both ways of adding up give the same trees."""

from pyspark.sql import functions as F

from regionlens.operators import boosting


def test_few_rows_few_tasks_same_trees(spark, monkeypatch):
    df = spark.range(300).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") * 7 % 23).cast("double").alias("b"),
                                 (F.col("id") * 31 % 101).cast("double").alias("y"), (F.col("id") % 3).alias("fold")).repartition(12)
    tasks = []
    plain = boosting._histogram

    def spy(margins, *args):
        tasks.append((margins.rdd.getNumPartitions(), args[-1]))
        return plain(margins, *args)

    monkeypatch.setattr(boosting, "_histogram", spy)

    def run():
        out = boosting.fit(df, ["a", "b"], "y", rounds=3, depth=3, fold="fold", folds=3)[1]
        return sorted(map(tuple, out.select("id", "prediction").collect()))

    few = run()
    assert tasks and set(tasks) == {(1, True)}
    tasks.clear()
    monkeypatch.setattr(boosting, "TASK_ROWS", 30)
    monkeypatch.setattr(boosting, "DIRECT", 4)
    assert run() == few and all(not direct for _, direct in tasks)
