"""Chat topic: parse, route, format, keep the last lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from worldstate.functions.text import format_chat_line
from worldstate.operators.feeds import route_topics
from worldstate.streaming.state_table import UNTIL_READ, LastMessages

LINES_SCHEMA = "channel int, author string, content string, ts timestamp, seq bigint, line string"


def chat_lines(messages: DataFrame) -> DataFrame:
    """Lines of the one routed chat topic, from messages ``{pseudo, msg}``; stream or table."""
    routed = route_topics(messages).filter(F.col("handler") == "chat")
    body = F.from_json("payload", "pseudo string, msg string")
    rows = routed.withColumn("_m", body).filter(F.col("_m.msg").isNotNull())
    rows = rows.select(
        F.lit(0).alias("channel"), F.col("_m.pseudo").alias("author"), F.col("_m.msg").alias("content"), "ts", "seq"
    )
    return format_chat_line(rows)


def chat_stream(messages: DataFrame, history: LastMessages, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep ``history`` up to date from a stream of topic messages."""
    return (
        chat_lines(messages)
        .writeStream.foreachBatch(lambda batch, batch_id: history.write(batch, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or UNTIL_READ))
        .start()
    )
