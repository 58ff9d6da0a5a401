"""Chat formatting by multi-party perspective rotation, with DataFrame functions alone.

Every speaker of a conversation gets the dialogue rendered from its own side: its turns are the assistant's, those of
the others are a user's under the speaker's name, and the loss mask covers its own turns only. Turns of narrator roles
(system) stay system turns in every rendering and are no participants.

The result has one row per conversation, participant and turn: the text of that turn in the rendering, its place in the
order of turns (ordinal, from 0), where its text begins in the whole rendered dialogue (start), and where its content
lies (content_start within the row's text, content_length). A dialogue is its rows' texts in the order of ordinal; its
mask is the content of the rows with mask 1. So no dialogue is ever gathered into one row or task, however long it is.

Turns are ordered by turn, role and md5 of the text, nulls first, so ties have an order, too; rows that repeat a turn
follow each other. Order and places come from two-level sums over rows without texts: within ranges of the order, and
over the ranges. The texts go through one shuffle, whose key is the turn's own, and a turn's repeated rows are counted
before it. The ordered keys are written to the shared folder, since ranges dealt anew after a loss could differ.

Null roles speak under the name "unknown" but are no participants, since there is no one to train as. Null texts are
empty turns. Null conv_ids are one conversation. Rows that repeat a turn are all rendered. A conversation of narrators
alone has no rendering. An empty table gives an empty table; columns besides the four are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import persisted

NARRATORS = ("system",)
END = "<|end|>\n"
KEY = ("conv_id", "turn", "role", "digest")
STEP = 1024  # turns of a dialogue whose lengths are summed at a time


def ordered(turns: DataFrame) -> DataFrame:
    """Distinct (conv_id, turn, role, digest) with length and number of rows, and the ordinal of the first of these."""
    keys = turns.groupBy("turn_id", *KEY).agg(F.max(F.char_length("text")).cast("long").alias("length"), F.count(F.lit(1)).alias("copies"))
    ranged = persisted(keys.repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()), "turns")
    inside = Window.partitionBy("part", "conv_id").orderBy("turn", "role", "digest")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # only where a conversation goes on from an earlier range: one row a range at most, so it is small enough to send
    late = ranged.groupBy("part", "conv_id").agg(F.sum("copies").alias("n")).withColumn("earlier", F.sum("n").over(before)).where("earlier > 0")
    late = F.broadcast(late.select(F.col("part").alias("_part"), F.col("conv_id").alias("_conv"), "earlier"))
    here = ranged.withColumn("here", F.sum("copies").over(inside) - F.col("copies"))
    joined = here.join(late, (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return joined.select("turn_id", *KEY, "length", "copies", (F.col("here") + F.coalesce("earlier", F.lit(0))).alias("ordinal"))


def rotate(turns: DataFrame, narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """Renderings of turns(conv_id, turn, role, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    t = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("text"),
    ).withColumn("digest", F.unhex(F.md5("text")))
    # one key for a turn's four parts, nulls told apart from values; joins on it keep the grouping's partitions
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    t = t.withColumn("turn_id", F.unhex(F.md5(F.concat(part("conv_id"), F.lit("/"), part("turn"), F.lit("/"), part("role"), F.lit("/"), F.hex("digest")))))
    order = ordered(t)
    who = (
        turns.select(F.col("conv_id").cast("long").alias("_conv"), F.col("role").cast("string").alias("participant"))
        .where(F.col("participant").isNotNull() & ~F.col("participant").isin(*narrators))
        .distinct()
    )
    own = F.col("role").eqNullSafe(F.col("participant"))
    name = F.coalesce("role", F.lit("unknown"))
    said = F.when(F.col("role").isin(*narrators), "system").when(own, "assistant").otherwise("user")
    head = F.when(F.col("said") == "user", F.concat(F.lit("<|user name="), name, F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), F.col("said"), F.lit("|>\n")))
    seen = order.join(who, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv").withColumn("said", said).withColumn("head", head)
    seen = seen.withColumn("size", F.char_length("head") + F.col("length") + len(END)).withColumn("step", F.floor(F.col("ordinal") / STEP))
    one = ("conv_id", "participant", "step")
    upto = Window.partitionBy("conv_id", "participant").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = seen.groupBy(*one).agg(F.sum(F.col("size") * F.col("copies")).alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    steps = steps.select(*(F.col(c).alias(f"_{c}") for c in one), "earlier")
    inside = Window.partitionBy(*one).orderBy("ordinal")
    placed = (
        seen.withColumn("here", F.sum(F.col("size") * F.col("copies")).over(inside) - F.col("size") * F.col("copies"))
        .join(steps, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("participant") == F.col("_participant")) & (F.col("step") == F.col("_step")))
        .select("turn_id", "conv_id", "turn", "role", "participant", "said", "head", "length", "copies", "size", "ordinal", (F.col("here") + F.col("earlier")).alias("start"))
    )
    lines = t.groupBy("turn_id").agg(F.max("text").alias("text"))
    return (
        placed.join(lines, "turn_id")
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .select(
            "conv_id",
            "participant",
            "turn",
            (F.col("ordinal") + F.col("copy")).alias("ordinal"),
            F.col("said").alias("rendered_role"),
            F.when(F.col("said") == "user", name).alias("name"),
            F.concat("head", "text", F.lit(END)).alias("rendered"),
            own.cast("int").alias("mask"),
            (F.col("start") + F.col("copy") * F.col("size")).alias("start"),
            F.char_length("head").cast("long").alias("content_start"),
            F.col("length").alias("content_length"),
        )
    )


def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP9_SQL = r"""
with t as (
  select conv_id, turn, role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, role nulls first, md5(coalesce(text, ''))) - 1 as ordinal
  from conversations
),
who as (select distinct conv_id as c, role as participant from t where role is not null and role <> 'system'),
r as (
  select t.*, who.participant,
         case when role = 'system' then 'system' when role is not distinct from participant then 'assistant' else 'user' end as said
  from t join who on t.conv_id is not distinct from who.c
),
h as (
  select *, case when said = 'user' then '<|user name=' || coalesce(role, 'unknown') || '|>' || chr(10)
                 else '<|' || said || '|>' || chr(10) end as head
  from r
),
d as (select *, head || text || '<|end|>' || chr(10) as rendered from h)
select conv_id, participant, turn, ordinal, said as rendered_role,
       case when said = 'user' then coalesce(role, 'unknown') end as name, rendered,
       cast(role is not distinct from participant as int) as mask,
       cast(coalesce(sum(length(rendered)) over (partition by conv_id, participant order by ordinal rows between unbounded preceding and 1 preceding), 0) as bigint) as start,
       cast(length(head) as bigint) as content_start, cast(length(text) as bigint) as content_length
from d
"""
