from pyspark.sql import functions as F

from spanloom.functions.generate import cards_and_devices


def test_values_are_valid_and_repeatable(spark):
    a = cards_and_devices(spark, 300, 5)
    rows = a.select("*", F.call_function("luhn_check", F.col("card")).alias("c"), F.call_function("luhn_check", F.col("imei")).alias("i")).collect()
    assert all(r.c and r.i and len(r.card) == 16 and len(r.imei) == 15 for r in rows)
    assert len({r.card for r in rows}) > 290 and all(len(r.mac) == 17 and r.ipv4.count(".") == 3 for r in rows)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, cards_and_devices(spark, 300, 5).repartition(3).collect()))
