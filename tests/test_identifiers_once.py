from pyspark.sql import functions as F

from tessera.functions import cases as K


def test_a_text_is_searched_once_and_cases_fold(spark):
    row = spark.createDataFrame([("srv-1.lan SRV-1.lan a@b.org x11 x12 x13 x14 x15 x16 x17 ASAP -v1.- ab-", ), (None,)], "t string").select(K.identifiers(F.col("t")).alias("ids"))
    assert row._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
    assert [r["ids"] for r in row.collect()] == [["srv-1.lan", "a@b.org", "x11", "x12", "x13", "x14", "x15", "x16"], None]
