"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A conversation is formatted turn after turn as ``<s>role\\ntext</s>``; every assistant turn becomes an example of its
own, written out in full: ``input`` holds all preceding turns (the first ``context_end`` code points) and the reply,
and only the reply's text, from ``loss_start`` to ``loss_end``, is under the loss mask. What is written grows with the
square of a conversation's turns; the examples of a long one are dealt over tasks in pieces of PIECE.

Control strings inside a text are escaped and can be restored exactly. Null roles, texts: empty. A null conv_id is
a conversation of its own; repeated rows and ties of turn are turns of their own, ordered by role and text. A
conversation without assistant turns has no examples. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Examples of one conversation that a task writes, about.
PIECE = 64
#: The strings that a template may give a meaning to; \\0 stands for the escape itself.
CONTROL = ("\\", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    for i, s in enumerate(CONTROL):
        text = F.replace(text, F.lit(s), F.lit(f"\\{i}"))
    return text


def unescape(text: Column) -> Column:
    for i, s in reversed(list(enumerate(CONTROL))):
        text = F.replace(text, F.lit(f"\\{i}"), F.lit(s))
    return text


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, no, role, escaped text, and the place of the text in the formatted conversation (code points)."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    return (
        conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("body"))
        .withColumn("no", F.row_number().over(w))
        .withColumn("head", F.concat(F.lit("<s>"), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n")))
        .withColumn("body", escape(F.col("body")))
        .withColumn("block", F.concat("head", "body", F.lit("</s>")))
        .withColumn("block_end", F.sum(F.length("block").cast("long")).over(Window.partitionBy("conv_id").orderBy("no")))
        .withColumn("loss_end", F.col("block_end") - 4)
        .withColumn("loss_start", F.col("loss_end") - F.length("body"))
    )


def formatted(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contexts, places): conv_id, formatted, pieces; conv_id, example, piece, context_end, loss_start, loss_end."""
    t = turns(conversations)
    replies = F.count_if(F.col("role") == "assistant")
    contexts = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("no", "block"))).alias("blocks"), replies.alias("n"))
    contexts = contexts.select("conv_id", F.concat_ws("", F.transform("blocks", lambda b: b["block"])).alias("formatted"), F.ceil(F.col("n") / PIECE).cast("int").alias("pieces"))
    nth = replies.over(Window.partitionBy("conv_id").orderBy("no"))
    places = (
        t.withColumn("piece", F.floor((nth - 1) / PIECE).cast("int"))
        .where("role = 'assistant'")
        .select("conv_id", F.col("no").alias("example"), "piece", (F.col("loss_start") - F.length("head")).alias("context_end"), "loss_start", "loss_end")
    )
    return contexts, places


def expand(contexts: DataFrame, places: DataFrame) -> DataFrame:
    """Every example with its whole input: conv_id, example, input, context_end, loss_start, loss_end."""
    each = contexts.where("pieces > 0").select(F.col("conv_id").alias("of"), "formatted", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("at"))
    e = places.join(each, places["conv_id"].eqNullSafe(each["of"]) & (places["piece"] == each["at"]))
    return e.select("conv_id", "example", F.expr("substring(formatted, 1, int(loss_end) + 4)").alias("input"), "context_end", "loss_start", "loss_end")


def digests(contexts: DataFrame, examples: DataFrame) -> DataFrame:
    """What the written output says of each conversation: its turns, and what its examples' loss masks hold."""
    masked = F.col("input").substr((F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    lost = examples.select(F.col("conv_id").alias("of"), F.struct("example", unescape(masked).alias("text")).alias("one"))
    lost = lost.groupBy("of").agg(F.array_sort(F.collect_list("one")).alias("lost"))
    whole = contexts.join(lost, contexts["conv_id"].eqNullSafe(lost["of"]), "left")
    parts = F.split("formatted", F.lit("</s>"))

    def spoken(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        role = F.replace(F.replace(head, F.lit("<s>"), F.lit("")), F.lit("\\n"), F.lit("\n"))
        return F.concat(unescape(role), F.lit("\n"), unescape(p.substr(F.length(head) + 2, F.length(p))), F.lit("\n"))

    return (
        whole.withColumn("turns", F.slice(parts, 1, F.size(parts) - 1))
        .withColumn("lost", F.coalesce("lost", F.array()))
        .withColumn("loss", F.concat_ws("", F.transform("lost", lambda x: x["text"])))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.concat_ws("", F.transform("turns", spoken)), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            F.size("lost").cast("long").alias("n_examples"),
        )
    )


def op3(spark, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT -1L AS conv_id, id AS turn, if(id = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)")
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    contexts, places = formatted(rows)
    contexts = common.written(contexts, "chat-contexts")
    return digests(contexts, common.written(expand(contexts, places), "chat-examples"))


def _esc(x: str) -> str:
    for i, s in enumerate(CONTROL):
        x = f"replace({x}, '{s}', '\\{i}')"
    return x


OP3_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + length(replace({_esc('role')}, chr(10), '\\n')) + length({_esc('text')})) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples
FROM c GROUP BY conv_id
"""
