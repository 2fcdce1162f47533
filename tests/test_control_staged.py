"""The loop's rounds read staged ticks, not what they are made from."""

from pyspark.sql import functions as F

from gaugeworks.operators import control as C
from gaugeworks.plans.loop_queries import VARIANTS


def test_ticks_are_computed_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        made.add(1)
        return x

    ticks = spark.range(1, 13).select("id", counted.asNondeterministic()("id").alias("tick"))
    rows = ticks.selectExpr("tick", "tick * 4 as n", "cast(tick as double) as d", "tick as odd_wins", "tick as even_wins", "tick as odd_fa", "tick as even_fa")
    assert C.control(rows, spark.sql(VARIANTS)).count() == 12 * 32
    assert made.value == 12
