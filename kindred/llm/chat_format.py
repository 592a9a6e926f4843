"""Multi-party perspective rotation of conversations.

For every participant the dialogue is rendered with that speaker as the assistant and all others as
named users; system messages keep their role. The mask covers what the assistant says, with its end
marker: `loss_spans` are the character ranges [start, end) to train on.

DataFrame functions only. A rendering is cut into parts of at most `part_turns` consecutive turn
numbers, so a conversation of any length is rendered in groups of bounded size; a shorter
conversation is one part, number 0. A part whose messages are more than `part_rows` (many messages
with the same turn numbers) is cut on, in the order of the dialogue, into slices of at most so many,
numbered by `slice`: the parts and slices of a perspective, joined in their order, are the whole dialogue.
None cuts no part. Messages of over-full parts are numbered over sorted ranges, in many tasks.
Participants meet the parts in a join on conv_id that Spark can split where it is skewed; no group is
joined with itself.

Defined results: exact repeats of a message (equal conversation, turn, role and text) count once.
Ties in the turn are ordered by role, then text; a null turn comes first and makes a part of number
-1; a null role is 'unknown'; a null text is empty; null conv_ids are one conversation. A
conversation of system messages alone has no participants and no rows. Markers within texts and names get
a space after their `<`, so that no message ends another, and line breaks within names become spaces. An
empty table gives no row. Other columns of the table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.shared import cut

START, END = "<|im_start|>", "<|im_end|>\n"


def _harmless(text: Column) -> Column:
    return F.regexp_replace(text, "<(?=[|]im_(start|end)[|]>)", "< ")


def _header(role: Column, perspective: Column) -> Column:
    name = F.regexp_replace(_harmless(role), "[\\r\\n]", " ")
    return F.when(role == perspective, F.lit(f"{START}assistant\n")).when(role == "system", F.lit(f"{START}system\n")).otherwise(F.concat(F.lit(f"{START}user name="), name, F.lit("\n")))


def _sliced(messages: DataFrame, part_rows: int) -> DataFrame:
    """Adds slice: the place of a message in its part, in the order of the dialogue, divided by part_rows."""
    sizes = messages.groupBy("conv_id", "part").count().where(F.col("count") > part_rows)
    full = cut(sizes.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part")))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))
    whole = messages.withColumn("slice", F.lit(0))
    if full.isEmpty():
        return whole
    # sorted by ranges: a message's place is its place in the range and what earlier ranges hold of its part
    rows = messages.join(full, same, "left_semi").orderBy("conv_id", "part", F.col("turn").asc_nulls_first(), "role", "text")
    rows = cut(rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_id", 33)))
    held = rows.groupBy("conv_id", "part", "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("conv_id", "part").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.col("_range").alias("_r"), "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = rows.join(held, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")) & (F.col("_range") == F.col("_r")))
    placed = placed.withColumn("slice", F.floor((F.col("_id") - F.col("_first") + F.col("_before")) / part_rows).cast("int"))
    return whole.join(full, same, "left_anti").unionByName(placed.select(*whole.columns))


def rotate(df: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = 512, part_rows: int | None = 4096) -> DataFrame:
    """One row per conversation, perspective and part: conv_id, perspective, part, slice, n_turns,
    rendered, loss_spans (array of start, end), loss_chars."""
    messages = df.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).distinct()
    part = F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long")
    messages = messages.withColumn("part", part)
    dealt = messages.withColumn("slice", F.lit(0)) if part_rows is None else _sliced(messages, part_rows)
    # the array sorts by turn, role and text; a null turn is the least
    parts = dealt.groupBy("conv_id", "part", "slice").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "role", "text"))).alias("said"))
    speakers = messages.where("role <> 'system'").select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective")).distinct()
    rows = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv")))
    pieces = F.transform("said", lambda m: F.struct(_header(m["role"], F.col("perspective")).alias("head"), F.concat(_harmless(m["text"]), F.lit(END)).alias("body"), (m["role"] == F.col("perspective")).alias("own")))
    rows = rows.select("conv_id", "perspective", "part", "slice", F.size("said").cast("long").alias("n_turns"), pieces.alias("pieces"))
    rendered = F.array_join(F.transform("pieces", lambda m: F.concat(m["head"], m["body"])), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(got, m):
        begin = got["at"] + F.length(m["head"])
        end = (begin + F.length(m["body"])).cast("long")
        span = F.struct(begin.cast("long").alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(m["own"], F.concat(got["spans"], F.array(span))).otherwise(got["spans"]).alias("spans"))

    spans = F.aggregate("pieces", start, step)["spans"]
    rows = rows.select("conv_id", "perspective", "part", "slice", "n_turns", rendered.alias("rendered"), spans.alias("loss_spans"))
    return rows.withColumn("loss_chars", F.aggregate("loss_spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]))


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's perspective."""
    rows = rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    spans = F.array_join(F.transform("loss_spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return rows.select("conv_id", "perspective", "part", "slice", "n_turns", "rendered", spans.alias("loss_spans"), "loss_chars")


_HARMLESS = "regexp_replace({}, '<([|]im_(start|end)[|]>)', '< \\1', 'g')"
ORACLE = f"""
with m as (select distinct conv_id, turn, coalesce(role, 'unknown') r, coalesce(text, '') t, coalesce(floor(turn / 512), -1)::bigint part from conversations),
n as (select *, ((row_number() over (partition by conv_id, part order by turn nulls first, r, t) - 1) // 4096)::int slice from m),
s as (select distinct conv_id, r p from m where r <> 'system'),
x as (select n.conv_id, p, part, slice, turn, r, t, r = p own,
        case when r = p then '{START}assistant' when r = 'system' then '{START}system' else '{START}user name=' || regexp_replace({_HARMLESS.format("r")}, '[\\r\\n]', ' ', 'g') end || chr(10) head,
        {_HARMLESS.format("t")} || '{END[:-1]}' || chr(10) body
      from n join s on n.conv_id is not distinct from s.conv_id),
y as (select *, sum(length(head) + length(body)) over (partition by conv_id, p, part, slice order by turn nulls first, r, t) - length(body) b from x)
select conv_id, p perspective, part, slice, count(*) n_turns, string_agg(head || body, '' order by turn nulls first, r, t) rendered,
  coalesce(string_agg(b::bigint || '-' || (b + length(body))::bigint, ',' order by turn nulls first, r, t) filter (where own), '') loss_spans,
  coalesce(sum(length(body)) filter (where own), 0)::bigint loss_chars
from y group by all
"""
