"""Conversations from event logs, rendered with a loss mask; DataFrame functions only.

A log has rows (conv_id, seq, message, kind, role, text).  Events of a
conversation count in the order of seq (ties: message, kind, role, text).  Kinds:

* ``delta`` (also null) appends its text to the message;
* ``edit`` puts its text in place of what the message holds;
* ``regenerate`` drops the message and every later one as they stand and begins
  the message anew with its text.

A message's role is that of its last event with one.  ``fold`` returns the messages that are left.

The template writes an assistant's message as ``<s>role\\ntext</s>`` and any other as
``[INST]role\\ntext[/INST]``.  A control string inside a role or text gets one more
backslash after its bracket (``<\\s>``), and a line break inside a role becomes
``<nl>``; both are undone exactly.  The loss mask lists (turn, start, length) of the
assistants' texts inside their rendered turns, in code points.

Nulls and empties: null texts and roles are empty; a null conv_id is a
conversation of its own; repeated rows are events of their own.  An empty log
gives no rows.  A very long text is one string like any other.  Extra columns are ignored.  One conversation is one string, so its turns meet in
one task; a task holds one conversation at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed strings of the template.
LOSS_OPEN, LOSS_CLOSE, OPEN, CLOSE, BREAK = "<s>", "</s>", "[INST]", "[/INST]", "<nl>"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<(\\*)(/?s|nl)>", r"<\\$1$2>")
    return F.regexp_replace(text, r"\[(\\*)(/?INST)\]", r"[\\$1$2]")


def unescape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<\\(\\*)(/?s|nl)>", r"<$1$2>")
    return F.regexp_replace(text, r"\[\\(\\*)(/?INST)\]", r"[$1$2]")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) of the messages that a log leaves."""
    order = ["seq", "message", "kind", "role", "text"]
    e = events.select("conv_id", "seq", "message", F.coalesce("kind", F.lit("delta")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    later = W.partitionBy("conv_id").orderBy(*[F.col(c).desc() for c in order])
    e = e.withColumn("cut", F.min(F.when(F.col("kind") == "regenerate", F.col("message"))).over(later.rowsBetween(W.unboundedPreceding, -1)))
    e = e.where(F.col("cut").isNull() | (F.col("cut") > F.col("message"))).drop("cut")
    kept = e.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("parts"))
    starts = F.transform("parts", lambda p, i: F.when(p["kind"] != "delta", i + 1).otherwise(F.lit(1)))
    begin = F.array_max(starts)
    roles = F.filter(F.transform("parts", lambda p: p["role"]), lambda r: r.isNotNull())
    text = F.array_join(F.transform(F.slice("parts", begin, F.size("parts")), lambda p: p["text"]), "")
    return kept.select("conv_id", "message", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) of messages (conv_id, message, role, text), in the order of message."""
    loss = F.col("role") == "assistant"
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit(BREAK))
    text = escape(F.coalesce("text", F.lit("")))
    part = F.when(loss, F.concat(F.lit(LOSS_OPEN), role, F.lit("\n"), text, F.lit(LOSS_CLOSE))).otherwise(F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE)))
    start = F.when(loss, F.char_length(role) + len(LOSS_OPEN) + 1)
    m = messages.select("conv_id", F.struct("message", "role", part.alias("part"), start.alias("start"), F.char_length(text).alias("length")).alias("turn"))
    g = m.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    spans = F.transform("turns", lambda t, i: F.struct(i.alias("turn"), t["start"].alias("start"), t["length"].alias("length")))
    return g.select("conv_id", F.array_join(F.transform("turns", lambda t: t["part"]), "").alias("formatted"), F.filter(spans, lambda s: s["start"].isNotNull()).alias("loss"))


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (role, text), loss_text) read from ``formatted`` and ``loss`` alone, with the other columns kept."""
    parts = F.regexp_extract_all("formatted", F.lit(r"(?s)<s>.*?</s>|\[INST\].*?\[/INST\]"), F.lit(0))
    r = rendered.withColumn("_parts", parts)

    def turn(p: Column) -> Column:
        short = p.startswith(LOSS_OPEN)
        body = F.when(short, F.substring(p, len(LOSS_OPEN) + 1, F.char_length(p) - len(LOSS_OPEN + LOSS_CLOSE))).otherwise(F.substring(p, len(OPEN) + 1, F.char_length(p) - len(OPEN + CLOSE)))
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape(F.replace(role, F.lit(BREAK), F.lit("\n"))).alias("role"), unescape(F.substring(body, F.char_length(role) + 2, F.char_length(body))).alias("text"))

    loss = F.transform("loss", lambda s: unescape(F.substring(F.get("_parts", s["turn"]), s["start"] + 1, s["length"])))
    return r.withColumn("turns", F.transform("_parts", turn)).withColumn("loss_text", F.array_join(loss, "")).drop("_parts")


def events_of(conversations: DataFrame) -> DataFrame:
    """A log that leaves the rows of ``conversations`` as messages, in the order of turn, role and text.

    Messages arrive as a recorder would see them, by their number in the conversation:

    * 1, 4, ...: a draft of it and a draft of the message that follows, then a regeneration
      with its first half, which drops both drafts, and a delta with its second half;
    * 2, 5, ...: three deltas;
    * 3, 6, ...: a draft in two deltas, then an edit to its first half, and a delta with its second half.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("message", F.row_number().over(order).cast("long"))
    n = F.char_length("text")
    half, third = F.floor(n / 2).cast("int"), F.floor(n / 3).cast("int")
    message, text, draft = F.col("message"), F.col("text"), F.substring("text", 1, 12)

    def event(k: int, kind: str, text: Column, message: Column = message) -> Column:
        return F.struct((F.col("message") * 8 + k).alias("seq"), message.alias("message"), F.lit(kind).alias("kind"), text.alias("text"))

    def rest(first: Column) -> Column:
        return F.substring(text, first + 1, n)

    regenerated = F.array(event(0, "delta", draft), event(1, "delta", draft, message + 1), event(2, "regenerate", F.substring(text, F.lit(1), half)), event(3, "delta", rest(half)))
    streamed = F.array(event(0, "delta", F.substring(text, F.lit(1), third)), event(1, "delta", F.substring(text, third + 1, third)), event(2, "delta", rest(2 * third)))
    edited = F.array(event(0, "delta", draft), event(1, "delta", F.lit("...")), event(2, "edit", F.substring(text, F.lit(1), half)), event(3, "delta", rest(half)))
    events = F.when(message % 3 == 1, regenerated).when(message % 3 == 2, streamed).otherwise(edited)
    return c.select("conv_id", "role", F.explode(events).alias("e")).select("conv_id", "e.seq", "e.message", "e.kind", "role", "e.text")


def formatted_digests(conversations: DataFrame) -> DataFrame:
    done = read_back(render(fold(events_of(conversations))))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: The digests in DuckDB SQL.
SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, text, coalesce(role = 'assistant', false) AS loss,
    length(regexp_replace(regexp_replace(text, '<(\\*)(/?s|nl)>', '<\\\1\2>', 'g'), '\[(\\*)(/?INST)\]', '[\\\1\2]', 'g')) AS text_chars,
    length(replace(regexp_replace(regexp_replace(coalesce(role, ''), '<(\\*)(/?s|nl)>', '<\\\1\2>', 'g'), '\[(\\*)(/?INST)\]', '[\\\1\2]', 'g'), chr(10), '<nl>')) AS role_chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE loss), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) FILTER (WHERE loss), '')) AS loss_sha256,
  CAST(sum(role_chars + text_chars + 1 + CASE WHEN loss THEN 7 ELSE 13 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
