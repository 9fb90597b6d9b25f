"""Which entities may become identities."""

from pyspark.sql import functions as F

from tessera.functions.identity import name_shaped, rejection_reason


def test_shapes_of_names(spark):
    names = {
        "NewWorkflowQueue": True, "BROKER1": True, "MFA": True, "Quartz": True, "Ana Silva": True, "ws-federation": True, "support.example.org": True, "x_ae_500": True, "orders/db": True,
        "screenshot": False, "the project": False, "query timeout": False, "8.2.5": False, "5360": False, "A": False, " B ": False, "": False, None: False,
        "Click 'View' now": False, "plugin’s Handler": False, "One two three four": True, "One two three four five": False, "a - b": False, "- x": False, "Über": True, "ação": False,
        "  Padded \n Name\t": True, "8.4 upgrade": False, "v8.4 upgrade": True, "9" * 5000: False, "a" * 200000: False,
    }
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string")
    assert [r.s for r in df.select("k", name_shaped(F.col("n")).alias("s")).orderBy("k").collect()] == list(names.values())


def test_reasons_and_what_settles_them(spark):
    rows = [
        ("person", "Ana", [], None), ("service", "query timeout", [], "not_a_name"), ("version", "MFA", [], "facet_type"), ("process", "MFA", [], "unsupported_type"), (None, "MFA", None, "unsupported_type"),
        ("version", "8.2.5", ["email"], None), ("version", "8.2.5", ["external_id"], "facet_type"), ("process", "x", ["external_id", None, "fqdn"], None), ("service", None, [None], "not_a_name"),
    ]
    df = spark.createDataFrame([(k, *r[:3]) for k, r in enumerate(rows)], "k int, t string, n string, i array<string>")
    assert [r.s for r in df.select("k", rejection_reason(F.col("t"), F.col("n"), F.col("i")).alias("s")).orderBy("k").collect()] == [r[3] for r in rows]
