"""Chat formatting by event-sourced reconstruction of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import table

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    r"""`\` doubled, then `<|` written as `<\|`: no control string is left, and `unescape` brings the text back."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    r"""As `escape`, and a line feed becomes `<\n`, as the first line feed of a turn ends its role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


#: Code points of a streamed delta, and what a discarded draft says.
DELTA, DRAFT = 400, "<|im_start|>a draft that is discarded"


def messages_to_events(rows: DataFrame, delta: int = DELTA) -> DataFrame:
    """conversations (conv_id, turn, role, text) as the event log of how they came about: (conv_id, message_id, seq, kind, role, text).

    Rows are numbered within a conversation by turn (null first), role and text; equal turns stay apart. A row is a message
    that deltas of `delta` code points stream, in one of five ways in turn: as it is; after a draft that is regenerated; as a
    draft that an edit replaces; with its role on the last event only; after a deletion of what was written first. The fourth also
    leaves a further message that is deleted. Folded, the log gives the rows back.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    plain = rows.select("conv_id", F.row_number().over(order).cast("long").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n, role, text = F.col("n"), F.col("role"), F.col("text")
    none = F.lit(None).cast("string")

    def event(kind: str, of: Column, who: Column, said: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), of.alias("message_id"), who.alias("role"), said.alias("text"))

    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(delta))
    streamed = lambda who: F.transform(starts, lambda k: event("delta", n, who, F.substring(text, k, F.lit(delta))))
    draft, last = event("delta", n, role, F.lit(DRAFT)), event("delta", n, role, F.lit(""))
    ways = [
        streamed(role),
        F.concat(F.array(draft, event("regenerate", n, none, none)), streamed(none)),
        F.concat(streamed(role), F.array(draft, event("edit", n, none, text))),
        F.concat(streamed(none), F.array(last, event("delta", -n, role, F.lit(DRAFT)), event("delete", -n, none, none))),
        F.concat(F.array(draft, event("delete", n, none, none)), streamed(role)),
    ]
    way = F.when(n % 5 == 0, ways[0])
    for k, w in enumerate(ways[1:], 1):
        way = way.when(n % 5 == k, w)
    told = plain.select("conv_id", "n", F.posexplode(way).alias("at", "e"))
    # seq: by message, then by event
    return told.select("conv_id", "e.message_id", (n * F.lit(1 << 32) + F.col("at")).alias("seq"), "e.kind", "e.role", "e.text")


def fold_events(events: DataFrame) -> DataFrame:
    """Events (conv_id, message_id, seq, kind, role, text) -> messages (conv_id, message_id, seq, role, text).

    kind: `delta` appends its text; `edit` replaces the text by its own; `regenerate` clears it, later deltas write it
    anew; `delete` removes the message unless a later event writes it again. Events of other kinds and further columns don't count. A
    message stands where its first event stood and has the role that its last event with a role gives. Events of
    equal seq count in order of kind, role and text. Null texts are empty; a null message_id is one message of its conversation.
    Repeated rows are events like others. An empty log gives no messages; a text may be as long as a value of Spark.
    """
    last_reset = F.max(F.when(F.col("kind").isin("edit", "regenerate", "delete"), F.struct("seq", "kind", "role", "text"))).over(Window.partitionBy("conv_id", "message_id"))
    here = F.struct("seq", "kind", "role", "text")
    events = events.select("conv_id", "message_id", "seq", "kind", "role", "text")
    marked = events.where(F.col("kind").isin("delta", "edit", "regenerate", "delete")).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_reset", last_reset).withColumn("_live", F.col("_reset").isNull() | (here >= F.col("_reset")))
    written = F.col("_live") & F.col("kind").isin("delta", "edit")
    parts = F.sort_array(F.collect_list(F.when(written, F.struct("seq", "kind", "role", "text"))))
    folded = marked.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("seq"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "kind", "role")))["role"].alias("role"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
        F.max(F.when(F.col("_live") & (F.col("kind") != "delete"), 1)).alias("_alive"),
    )
    return folded.where(F.col("_alive").isNotNull()).select("conv_id", "message_id", "seq", F.coalesce("role", F.lit("")).alias("role"), "text")


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """Messages -> (conv_id, formatted, loss_spans): one text for each conversation and the half-open spans of code points
    of the texts (without marks) that the loss covers."""
    turn = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END + "\n"))
    rows = messages.select("conv_id", F.struct("seq", "message_id", turn.alias("turn"), F.length(turn).alias("chars"), (F.col("role") == trained).alias("loss"), F.length(escape(F.col("text"))).alias("size")).alias("m"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    tail = len(END) + 1
    spans = F.aggregate(
        "m",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + m["chars"]).alias("at"),
            F.when(m["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + m["chars"] - tail - m["size"]).alias("start"), (acc["at"] + m["chars"] - tail).alias("stop"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return whole.select("conv_id", F.array_join(F.transform("m", lambda m: m["turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: DataFrame) -> DataFrame:
    """Reads turns and trained texts back from (conv_id, formatted, loss_spans)."""
    blocks = F.filter(F.split(F.col("formatted"), "<\\|im_start\\|>"), lambda b: b != "")
    turns = F.transform(
        blocks,
        lambda b: F.struct(
            unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
            unescape(F.substring(b, F.instr(b, "\n") + 1, F.length(b) - F.instr(b, "\n") - len(END) - 1)).alias("text"),
        ),
    )
    trained = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"])))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), trained.alias("trained"))


def format_chats(events: DataFrame) -> DataFrame:
    """Event log -> (conv_id, formatted, loss_spans). An empty log gives no rows; a null conv_id is a conversation."""
    return render(fold_events(events))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts hold control strings."""
    tricky = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = parse(format_chats(messages_to_events(rows)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("trained", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
