"""Preference formatting: the longest common turn prefix of two conversations once as prompt, then masked completions.

All of it is DataFrame functions. A turn number's messages are compared as a sorted array, so that several messages
with one turn number have a defined order; exact repeats of a message count once. The prompt ends at the first turn
number where chosen and rejected differ. The texts of a part are put together in blocks of 256 turn numbers, so that no row
or task holds an endless conversation; an ordinary part is one block. Spans count from the start of the part, whatever its
blocks, and `start` is where a block's text begins in it.

What decides where a message goes - turn numbers, lengths, whether the sides differ - is worked out without the texts, and
the texts are shuffled once to the blocks. The messages of one turn number are one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.llm.common import HOT_ROWS, SHARE, skew_join, written

#: Template of a message: a role line between markers, then the text and an end marker.
START, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"
BLOCK_TURNS = 256
#: Stands for a null turn, which comes first.
NO_TURN = -(1 << 63)


def _messages(turns: DataFrame, side: str) -> DataFrame:
    """One row for each pair and turn number, with its messages of one side as a sorted array."""
    clean = turns.select(
        "pair_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN)).alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).filter(F.col("pair_id").isNotNull())
    return clean.groupBy("pair_id", "turn").agg(F.array_sort(F.collect_set(F.struct("role", "text"))).alias(side))


def _rendered(messages: Column) -> Column:
    """Messages -> their template texts and whether each is trained on."""
    return F.transform(
        messages,
        lambda m: F.struct(
            F.concat(F.lit(START), m["role"], F.lit(MIDDLE)).alias("head"),
            F.concat(m["text"], F.lit(END)).alias("body"),
            (m["role"] == TRAINED_ROLE).alias("trained"),
        ),
    )


def format_preferences(chosen: DataFrame, rejected: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """format_turns() of two tables (pair_id, turn, role, text), of which any further columns are not read."""
    return format_turns(_messages(chosen, "c").join(_messages(rejected, "r"), ["pair_id", "turn"], "full"), block_turns)


def format_turns(both: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Rows (pair_id, part, block, start, text, spans, n_messages, trained_chars, prefix_turns, paired).

    both: a row (pair_id, turn, c, r) for each turn number of a pair, with its messages (role, text) of the chosen and the
    rejected side, null where a side has none. part is prompt, chosen or rejected; the text of a part is that of its
    blocks in order. spans: character ranges [start, end) of the part's text to learn from, the bodies of assistant
    messages of the completions; the prompt has none. prefix_turns: turn numbers in the prompt. Null text and role count
    as empty, a null turn comes first and is a turn of its own, rows without pair_id have no pair and go. A pair of which
    only one side exists has no prompt, and paired is false. Of equal sides all is prompt. Empty tables give an empty table.
    """
    both = written(both, "turns")
    size = lambda side: F.aggregate(F.col(side), F.lit(0).cast("long"), lambda a, m: a + F.char_length(m["role"]) + F.char_length(m["text"]) + len(START + MIDDLE + END))
    light = written(both.select("pair_id", "turn", (~F.col("c").eqNullSafe(F.col("r"))).alias("differs"), size("c").alias("c_chars"), size("r").alias("r_chars")), "turn-sizes")
    sides = light.groupBy("pair_id").agg(F.min(F.when(F.col("differs"), F.col("turn"))).alias("differ"), (F.count("c_chars") * F.count("r_chars") > 0).alias("paired"), F.count(F.lit(1)).alias("turns"))
    sides = written(sides, "pairs")
    hot = [r[0] for r in sides.filter(F.col("turns") > HOT_ROWS).orderBy(F.desc("turns")).limit(SHARE).select("pair_id").collect()]

    def parts(rows: DataFrame) -> DataFrame:
        """A row for each turn number of each part, with the number of its block."""
        told = skew_join(rows, sides.drop("turns"), "pair_id", hot=hot, deal=F.col("turn"))
        in_prompt = F.coalesce(F.col("turn") < F.col("differ"), F.lit(True))
        part = F.explode(F.when(in_prompt, F.array(F.lit("prompt"))).otherwise(F.array(F.lit("chosen"), F.lit("rejected"))))
        return told.withColumn("part", part).withColumn("block", F.floor(F.col("turn") / block_turns))

    key = ["pair_id", "part", "block"]
    chars = F.when(F.col("part") == "rejected", F.col("r_chars")).otherwise(F.col("c_chars"))
    in_prompt = F.col("part") == "prompt"
    of_block = parts(light).withColumn("chars", chars).groupBy(*key).agg(F.sum("chars").alias("chars"), F.count_if(in_prompt).alias("turns"), F.first("paired").alias("paired"))
    earlier = Window.partitionBy("pair_id", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    starts = of_block.withColumn("start", F.coalesce(F.sum("chars").over(earlier), F.lit(0))).withColumn("prefix_turns", F.sum("turns").over(Window.partitionBy("pair_id")))

    own = F.when(F.col("part") == "rejected", F.col("r")).otherwise(F.col("c"))
    pieces = parts(both).withColumn("messages", _rendered(own)).filter(F.col("messages").isNotNull())
    m = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "messages"))), lambda x: x["messages"]))
    blocks = pieces.groupBy(*key).agg(m.alias("m")).join(starts.drop("chars", "turns"), key)
    # walks the messages of a block once: where the text has come to, and the ranges of trained bodies so far
    walked = F.aggregate(
        "m",
        F.struct(F.col("start").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + F.char_length(m["head"]) + F.char_length(m["body"])).alias("at"),
            F.when(
                m["trained"],
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.char_length(m["head"])).alias("start"), (acc["at"] + F.char_length(m["head"]) + F.char_length(m["body"])).alias("end")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    spans = F.when(in_prompt, F.array().cast("array<struct<start:bigint,end:bigint>>")).otherwise(walked["spans"])
    text = F.array_join(F.transform("m", lambda m: F.concat(m["head"], m["body"])), "")
    shown = blocks.select(*key, "start", text.alias("text"), spans.alias("spans"), F.size("m").cast("long").alias("n_messages"), "prefix_turns", "paired")
    trained = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return shown.select(*key, "start", "text", "spans", "n_messages", trained.alias("trained_chars"), "prefix_turns", "paired")


def last_reply_turns(turns: DataFrame) -> DataFrame:
    """(pair_id, turn, c, r) from one table of conversations: each as chosen, and as rejected its turns before its last reply, then
    the last reply of its neighbour (conv_id with the lowest bit turned). Conversations without a reply, or whose neighbour
    has none, have no rejected side. conv_id is a whole number; rows without one are in no conversation. A null turn comes
    first and is no last reply; null role and text are empty; exact repeats of a message count once. Columns other than
    conv_id, turn, role and text are not read, whatever their names. An empty table gives an empty table."""
    own = written(_messages(turns.select(F.col("conv_id").cast("long").alias("pair_id"), "turn", "role", "text"), "c"), "messages")
    replied = F.exists("c", lambda m: m["role"] == TRAINED_ROLE) & (F.col("turn") != NO_TURN)
    counts = own.groupBy("pair_id").agg(F.max(F.when(replied, F.col("turn"))).alias("last"), F.count(F.lit(1)).alias("turns"))
    last = written(counts, "last-turns")
    known = last.filter(F.col("last").isNotNull()).select("pair_id", "last")
    reply = own.join(known.withColumnRenamed("last", "turn"), ["pair_id", "turn"]).select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.filter("c", lambda m: m["role"] == TRAINED_ROLE).alias("reply"))
    replaced = written(reply.join(known, "pair_id").select("pair_id", F.col("last").alias("turn"), "reply"), "replies")
    hot = [r[0] for r in last.filter(F.col("turns") > HOT_ROWS).orderBy(F.desc("turns")).limit(SHARE).select("pair_id").collect()]
    told = skew_join(own, replaced.select("pair_id", F.col("turn").alias("last")), "pair_id", "left", hot=hot, deal=F.col("turn"))
    rejected = F.when(F.col("turn") < F.col("last"), F.col("c")).when(F.col("turn") == F.col("last"), F.col("reply"))
    return told.join(replaced, ["pair_id", "turn"], "left").select("pair_id", "turn", "c", rejected.alias("r"))
