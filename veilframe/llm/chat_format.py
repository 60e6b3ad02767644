"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, adjacent turns of one role are merged into a block by array
aggregation, and blocks are concatenated. Control strings that occur inside texts are escaped reversibly, so the
formatted string alone gives back every turn and the text under the loss mask.

Template: ``<s>`` then per block ``[ROLE]role[/ROLE]``, the block's texts joined by ``<next>``, and ``</s>``.
Escaping: a backslash becomes two; a control string gets a backslash after its first character (``[\\INST]``), so no
control string is left inside a text and none can arise where a text and a marker meet (no marker overlaps another).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The template's own markers, and strings that other chat templates use as control.
MARKERS = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "<next>")
FOREIGN = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROL = r"([<\[])(s>|/s>|ROLE\]|/ROLE\]|next>|INST\]|/INST\]|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    """A backslash always stands before the character that it protects."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(df: DataFrame) -> DataFrame:
    """(conv_id, formatted) from rows (conv_id, turn, role, text), any other column ignored.

    Null text or role: empty. Turns sort by turn (nulls first), ties by role, then text. Repeated rows are turns of
    their own. A null conv_id is a conversation too. An empty table gives no row. One conversation is one output string,
    so its turns meet in one row; different conversations never do.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    turns = df.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # index of each block's first turn: where the role changes
    size = F.size("turns")
    firsts = F.filter(F.sequence(F.lit(1), size), lambda i: (i == 1) | (F.col("turns")[i - 1]["role"] != F.col("turns")[F.greatest(i - 2, F.lit(0))]["role"]))
    blocks = turns.select("conv_id", "turns", firsts.alias("firsts"))
    block = F.transform(
        F.sequence(F.lit(1), F.size("firsts")),
        lambda k: F.concat(
            F.lit("[ROLE]"), escape(F.col("turns")[F.col("firsts")[k - 1] - 1]["role"]), F.lit("[/ROLE]"),
            F.array_join(
                F.transform(
                    F.slice("turns", F.col("firsts")[k - 1], F.coalesce(F.get("firsts", k), F.size("turns") + 1) - F.col("firsts")[k - 1]),
                    lambda t: escape(t["text"]),
                ),
                "<next>",
            ),
        ),
    )
    return blocks.select("conv_id", F.concat(F.lit("<s>"), F.array_join(block, ""), F.lit("</s>")).alias("formatted"))


def parse_formatted(df: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns: array<struct<role, text>>) read back from the formatted strings alone."""
    body = F.expr("substring(formatted, 4, length(formatted) - 7)")
    blocks = F.slice(F.split(body, r"\[ROLE\]"), 2, F.size(F.split(body, r"\[ROLE\]")))
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.split(b, r"\[/ROLE\]")[1], "<next>"),
                lambda t: F.struct(unescape(F.split(b, r"\[/ROLE\]")[0]).alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    return df.select("conv_id", "formatted", turns.alias("turns"))


def masked_text(turns: Column, role: str = "assistant") -> Column:
    """All text under the loss mask: the assistant's, in order, with nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of every formatted conversation, read back from the output, and of conversation -1, whose texts
    are control strings."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.sql("select -1L conv_id, explode(array(struct(0L turn, 'user' role), struct(1L turn, 'assistant' role))) t").selectExpr(
        "conv_id", "t.turn turn", "t.role role", "'</s>[INST] ok [/INST]' text"
    )
    read = parse_formatted(format_conversations(rows.unionByName(probe))).withColumn("loss", masked_text(F.col("turns")))
    listing = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listing.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The digests that SQL can derive from the rows; formatted_chars follows from the template and its escapes.
OP6_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked as (
  select *, case when role = lag(role) over w then 0 else 1 end as first,
    regexp_replace(replace(text, '\', '\\'), '([<\[])(s>|/s>|ROLE\]|/ROLE\]|next>|INST\]|/INST\]|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>)', '\1\\\2', 'g') as safe
  from rows window w as (partition by conv_id order by turn, role, text))
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  (7 + sum(length(safe)) + sum(case when first = 1 then 13 + length(role) else 6 end))::bigint as formatted_chars
from marked group by conv_id
"""
