import os

from pyspark.sql import functions as F

from tiersight.operators import staging


def test_settled_leaves_only_its_result(spark):
    made = []

    def make():
        made.append(staging.stage(spark.range(10)))
        made.append(staging.settled(lambda: staging.stage(made[0].where("id < 5")).withColumn("x", F.col("id") * 2)))
        return made[1].where("id > 2")

    out = staging.settled(make)
    place = lambda table: table.staged_at.removeprefix("file:")
    assert sorted(out.collect()) == [(3, 6), (4, 8)] and os.path.isdir(place(out))
    assert not any(os.path.exists(place(table)) for table in made)
