"""Cases of every message: what it names, inherits, denies and corrects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import bridging as B
from tessera.plans.mail import mail
from tessera.plans.registry import load, query


def bridged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The mails with reply structure, bots and labels by fixed rules, and a ticket for each supplier, every tenth number twice."""
    number = lambda turn: F.col("conv_id").cast("long") * 100000 + turn
    turn = F.col("turn").cast("long")
    label = F.when((F.col("conv_id") % 8 == 3) & (turn == 3), "correction").when(F.col("conv_id") % 10 != 6, "update")
    messages = mail(spark, sf_dir).select(
        number(turn).alias("message"), F.col("conv_id").cast("long").alias("thread"), turn.alias("at"), F.when((turn > 0) & (turn % 5 != 0), number(turn - 1)).alias("reply_to"), F.col("subject").alias("title"), "body",
        F.when(F.col("conv_id") % 12 == 7, F.array(F.concat(F.lit('{"number": "INC'), (100000 + F.col("conv_id") % 30).cast("string"), F.lit('"}')))).alias("cards"), (F.col("conv_id") % 12 == 7).alias("is_bot"), label.alias("function"), F.when(label.isNotNull(), 0.9).alias("function_confidence"),
    )
    suppliers = load(spark, sf_dir, "supplier").select(F.concat(F.lit("INC"), (100000 + F.col("s_suppkey")).cast("string")).alias("token"), F.col("s_suppkey").cast("long").alias("case_id"))
    return messages, suppliers.unionByName(suppliers.where("case_id % 10 = 0").select("token", (-F.col("case_id") - 1).alias("case_id")))


@query("g31_membership_ledger")
def membership_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message and case with relationship, place, confidence and status; tests compare it with a pass one by one."""
    return B.ledger(*bridged(spark, sf_dir))


@query("g31_pending_mentions")
def pending_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of mails that no ticket has."""
    return B.pending(*bridged(spark, sf_dir))
