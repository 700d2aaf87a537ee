r"""Chat formatting by replaying an event log.

An event has conv_id, slot (the place of its message in the conversation), seq (its place
in the log), op, role and text. `fold` replays a log:

- `message` begins the message of a slot: its role, and its text so far
- `delta` appends a streamed piece
- `edit` replaces the text
- `regenerate` discards the text, and every event of later slots that came before it;
  what follows builds the message anew

`render` writes a message as `<s>role`, a line end, its text, `</s>` and a line end, and
returns with the text the spans (code points) of what assistants said: the loss mask.
Control strings inside texts and roles are escaped: a backslash becomes `\0`, the first
character of `<s>` or `</s>` becomes `\1`, that of `[INST]` or `[/INST]` `\2`, a line end
of a role `\3`. `read_back` undoes all of it, so formatting loses nothing.

Everything is column expressions over rows partitioned by conversation once; lengths and
offsets are window sums, so long conversations cost no more for each message than short
ones, and one conversation ends as one row, as the result asks for.

Nulls: a null text or role is empty, a null conv_id is a conversation, a null slot comes
first, a null seq comes first. An event that is logged twice counts once. Events of one
slot and seq are replayed by op, role and text. No events give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The text of the conversation that the digest query adds, and its id.
PROBE_ID = -1
PROBE_TEXT = "</s>[INST] ok [/INST]"

OPEN, END_ROLE, CLOSE = "<s>", "\n", "</s>\n"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_FIRST = {"<": "\\1", "[": "\\2"}
_NO_SLOT = -(1 << 62)


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\0"))
    for control in CONTROL:
        text = F.replace(text, F.lit(control), F.lit(_FIRST[control[0]] + control[1:]))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\3"))


def unescape(text: Column) -> Column:
    """The escaped character last: before, no backslash stands for itself."""
    for code, plain in (("\\1", "<"), ("\\2", "["), ("\\3", "\n"), ("\\0", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def fold(events: DataFrame) -> DataFrame:
    """conv_id, slot, role, text: the messages that a log ends with."""
    log = events.select("conv_id", F.coalesce("slot", F.lit(_NO_SLOT)).alias("slot"), "seq", "op", "role", "text")
    earlier = Window.partitionBy("conv_id").orderBy("slot").rangeBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("_cut", F.max(F.when(F.col("op") == "regenerate", F.col("seq"))).over(earlier))
    log = log.where(F.col("_cut").isNull() | (F.col("seq") > F.col("_cut")))
    slots = log.groupBy("conv_id", "slot").agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("seq", "op", "role", "text")))).alias("events"))
    resets = F.transform("events", lambda e, i: F.when(e["op"] != "delta", i))
    last = F.coalesce(F.array_max(resets), F.lit(0))
    pieces = F.transform(F.filter("events", lambda e, i: i >= last), lambda e: F.when(e["op"] == "regenerate", "").otherwise(F.coalesce(e["text"], F.lit(""))))
    roles = F.filter(F.transform("events", lambda e: e["role"]), lambda r: r.isNotNull())
    return slots.select(
        "conv_id",
        "slot",
        F.when(F.size(roles) > 0, F.element_at(roles, -1)).otherwise("").alias("role"),
        F.array_join(pieces, "").alias("text"),
    )


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (start, length in code points): one row per conversation."""
    before = Window.partitionBy("conv_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    turns = messages.select("conv_id", "slot", "role", escape_role(F.col("role")).alias("_head"), escape(F.col("text")).alias("_body"))
    turns = turns.withColumn("_piece", F.concat(F.lit(OPEN), "_head", F.lit(END_ROLE), "_body", F.lit(CLOSE)))
    turns = turns.withColumn("_start", F.coalesce(F.sum(F.length("_piece")).over(before), F.lit(0)))
    inner = F.col("_start") + len(OPEN) + F.length("_head") + len(END_ROLE)
    span = F.when(F.col("role") == trained_role, F.struct(inner.cast("long").alias("start"), F.length("_body").cast("long").alias("length")))
    whole = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("slot", "_piece"))).alias("_pieces"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
    )
    return whole.select("conv_id", F.array_join(F.transform("_pieces", lambda p: p["_piece"]), "").alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss (texts): what a formatted conversation says."""
    pieces = F.filter(F.split("formatted", CLOSE, -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, END_ROLE, 1)
        return F.struct(
            unescape(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substr(piece, F.length(head) + len(END_ROLE) + 1)).alias("text"),
        )

    masked = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", F.transform(pieces, turn).alias("turns"), masked.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))


def message_events(conversations: DataFrame) -> DataFrame:
    """One `message` event for each row, in the order of turn, role and text; repeated rows are messages of their own."""
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("slot", F.row_number().over(place).cast("long"))
    return rows.select("conv_id", "slot", F.col("slot").alias("seq"), F.lit("message").alias("op"), "role", "text")


def digests(conversations: DataFrame) -> DataFrame:
    """Counts and digests of every conversation, and of the probe, read back from the formatted text."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = conversations.sparkSession.sql(f"SELECT {PROBE_ID}L AS conv_id, 0L AS turn, 'user' AS role UNION ALL SELECT {PROBE_ID}L, 1L, 'assistant'")
    rows = rows.unionByName(probe.withColumn("text", F.lit(PROBE_TEXT)))
    read = read_back(render(fold(message_events(rows))))
    said = F.array_join("loss", "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"),
        F.sha2(said, 256).alias("loss_sha256"),
        "formatted_chars",
    )
