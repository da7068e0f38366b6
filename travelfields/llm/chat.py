"""Multi-party perspective rotation of dialogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from travelfields.shared import write_shared


def rotate_perspectives(conversations: DataFrame, block_turns: int | None = None) -> DataFrame:
    """Render each conversation once for each participant, who becomes the assistant.

    conversations: conv_id, turn, role, text. A participant is any role but `system`; a null
    role is the participant `unknown`. All others become `user` messages that carry their
    name, system messages stay as they are. Only what the assistant says (with its end
    marker) is trained on.

    Returns one row per (conv_id, perspective, block), with first_message, n_messages, rendered, mask (a 1 for
    each message trained on, else a 0, in order) and train_spans (array of start and end, code points of rendered, end
    excluded). A dialogue is one row, block 0, unless block_turns is given: then its messages are cut by their place in it
    into blocks of that many, and first_message is the place, from 0, of a block's first one.

    Messages are ordered by turn (null first), then role, then text. An identical repeated row is one
    message. A null text is an empty message. A null conv_id is one conversation. A conversation with only system messages has no
    participant and gives no row. Other columns are ignored. Empty input: no rows."""
    speaker = F.coalesce(F.col("role"), F.lit("unknown"))
    text = F.coalesce(F.col("text"), F.lit(""))
    said = conversations.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), speaker.alias("speaker"), text.alias("text")).alias("m"))
    if block_turns is None:
        said = said.withColumn("block", F.lit(0).cast("long"))
    else:
        place = F.row_number().over(W.partitionBy("conv_id").orderBy("m")) - 1
        said = said.distinct().withColumn("block", F.floor(place / F.lit(block_turns)).cast("long"))
    blocks = said.groupBy("conv_id", "block").agg(F.sort_array(F.collect_set("m")).alias("messages"))
    people = write_shared(
        conversations.select("conv_id", speaker.alias("perspective")).where("perspective <> 'system'").distinct(), "chat-people"
    ).select(F.col("conv_id").alias("with_id"), "perspective")
    views = blocks.join(people, F.col("conv_id").eqNullSafe(F.col("with_id")))

    own = lambda m: m["speaker"] == F.col("perspective")
    head = lambda m: (
        F.when(own(m), F.lit("<|assistant|>\n"))
        .when(m["speaker"] == "system", F.lit("<|system|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), m["speaker"], F.lit("|>\n")))
    )
    body = lambda m: F.concat(m["text"], F.lit("<|end|>\n"))
    parts = F.transform("messages", lambda m: F.struct(own(m).alias("own"), head(m).alias("head"), body(m).alias("body")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, p):
        after = acc["at"] + F.length(p["head"])
        end = after + F.length(p["body"])
        span = F.array(F.struct(after.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return views.withColumn("parts", parts).select(
        "conv_id", "perspective", "block", (F.col("block") * (block_turns or 0)).alias("first_message"),
        F.size("parts").cast("long").alias("n_messages"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        F.array_join(F.transform("parts", lambda p: F.when(p["own"], F.lit("1")).otherwise(F.lit("0"))), "").alias("mask"),
        F.aggregate("parts", start, step, lambda acc: acc["spans"]).alias("train_spans"),
    )
