"""Exports of ticket, chat, mail and alert systems as one shape of evidence rows.

Each kind has a declared schema, so no file is read to infer it; the same
function reads a folder once or as a stream of new files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "ticket": "source string, ticket_id string, created_at string, updated_at string, status string, priority string, user struct<id:string,name:string,department:string>, issue string, description string, resolution string, tags array<string>",
    "chat": "source string, channel string, thread_id string, messages array<struct<user:string,timestamp:string,text:string>>",
    "mail": "source string, mailbox string, thread_id string, emails array<struct<from:string,to:string,timestamp:string,subject:string,body:string>>",
    "alert": "source string, alert_id string, timestamp string, service string, metric string, value string, threshold string, severity string, message string",
}


def _row(kind: str, external_id: Column, at: Column, sender: Column, text: Column) -> list[Column]:
    return [F.lit(kind).alias("kind"), F.col("source"), external_id.alias("external_id"), at.try_cast("timestamp_ntz").alias("occurred_at"), sender.alias("sender"), text.alias("text"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("content_hash")]


def read_exports(spark: SparkSession, path: str, kind: str, stream: bool = False) -> DataFrame:
    """``kind, source, external_id, occurred_at, sender, text, content_hash`` of every message or record.

    Threads give a row for each message.  Unreadable files give rows of nulls
    and are dropped; a number inside text ("12 crashes/min") stays text.
    """
    reader = (spark.readStream if stream else spark.read).schema(SCHEMAS[kind]).option("multiLine", True).option("mode", "PERMISSIVE")
    return evidence(reader.json(path), kind)


def evidence(raw: DataFrame, kind: str) -> DataFrame:
    """The rows of parsed exports of one kind."""
    if kind == "ticket":
        rows = raw.where("ticket_id IS NOT NULL").select(*_row(kind, F.col("ticket_id"), F.col("created_at"), F.col("user.name"), F.concat_ws("\n", "issue", "description", "resolution")))
    elif kind == "chat":
        rows = raw.select("source", "thread_id", F.posexplode("messages").alias("n", "m")).select(*_row(kind, F.concat_ws(":", "thread_id", "n"), F.col("m.timestamp"), F.col("m.user"), F.col("m.text")))
    elif kind == "mail":
        rows = raw.select("source", "thread_id", F.posexplode("emails").alias("n", "m")).select(*_row(kind, F.concat_ws(":", "thread_id", "n"), F.col("m.timestamp"), F.col("m.from"), F.concat_ws("\n", "m.subject", "m.body")))
    else:
        rows = raw.where("alert_id IS NOT NULL").select(*_row(kind, F.col("alert_id"), F.col("timestamp"), F.col("service"), F.concat_ws(" ", "severity", "metric", "value", "message")))
    return rows


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``at, level, service, message`` of ``yyyy-MM-dd HH:mm:ss LEVEL service message`` lines; others keep the whole line as message."""
    line = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\s+([A-Z]+)\s+(\S+)\s+(.*)$"
    part = lambda k: F.nullif(F.regexp_extract("value", line, k), F.lit(""))
    return spark.read.text(path).select(part(1).try_cast("timestamp_ntz").alias("at"), part(2).alias("level"), part(3).alias("service"), F.coalesce(part(4), F.col("value")).alias("message"))
