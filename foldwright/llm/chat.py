"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log has one row for each event. It is partitioned by conversation and sorted by sequence; the events of a message are
folded into its last text, messages that a regeneration takes back are left out, and what remains is rendered as one
text with a loss span for each turn. One exchange by conversation serves sorting, folding and rendering, as all keys
after it begin with the conversation. A conversation is one row of the result, so its rows do meet in one task at the
end; until its texts are joined they are sorted and folded as rows that can spill.

Template: each turn is ``### role: text</turn>`` and a line break, the role percent-encoded. A text's backslashes
are doubled, and a backslash parts the first character from the rest of each ``</turn>`` and ``###``, so neither marker
stands in an escaped text, and taking the backslashes out again gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN_START, ROLE_END, TURN_END = "### ", ": ", "</turn>\n"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    """A text in which no marker of the template occurs."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(doubled, "<(?=/turn>)", r"<\\"), "#(?=##)", r"#\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\/#])", "$1")


def _role_name(role: Column) -> Column:
    return F.replace(F.url_encode(role), F.lit("+"), F.lit("%20"))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of the messages that events(conv_id, seq, kind, message, role, text) end with.

    Events count in the order of seq (null last; ties by message, kind, role and text). kind is one of

    - ``message`` (null and unknown kinds too): the message's text is this text;
    - ``delta``: the text is appended;
    - ``edit``: the message's text is replaced;
    - ``regenerate``: the same, and every message that was opened after this one is withdrawn, for good.

    A message opens with its first event, whatever that is, and place is that event's number in its conversation.
    Its role is the last that its events name, '' if none does. A null text is empty. Events whose message is null
    are messages of their own, so repeated rows are repeated messages; of others, repeated deltas append again. A
    null conv_id is a conversation. Other columns are not read; an empty log gives no rows.
    """
    log = events.select("conv_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.col("message").cast("string").alias("message"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("seq").asc_nulls_last(), "message", "kind", "role", "text")
    log = log.withColumn("at", F.row_number().over(order).cast("long"))
    log = log.withColumn("own", F.when(F.col("message").isNull(), F.col("at")))
    event = F.struct("at", "text")
    reset = F.max(F.when(F.col("kind") != "delta", F.col("at")))
    messages = log.groupBy("conv_id", "message", "own").agg(
        F.min("at").alias("place"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("at"))).alias("role"),
        F.coalesce(reset, F.lit(0)).alias("reset"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("at"))).alias("regenerated"),
        F.collect_list(event).alias("parts"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    messages = messages.withColumn("withdrawn", F.coalesce(F.max("regenerated").over(earlier) > F.col("place"), F.lit(False)))
    live = F.array_sort(F.filter("parts", lambda e: e["at"] >= F.col("reset")))
    text = F.array_join(F.transform(live, lambda e: e["text"]), "")
    return messages.where("not withdrawn").select("conv_id", "place", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, learned: str = LEARNED) -> DataFrame:
    """(conv_id, formatted, loss_spans) of messages(conv_id, place, role, text), one row per conversation.

    loss_spans has one (start, stop) per turn: the characters of the turn, counted in code points from its start, that
    a model learns; they hold the escaped text of the turns whose role is ``learned``, and are empty for others.
    """
    head = F.concat(F.lit(TURN_START), _role_name(F.col("role")), F.lit(ROLE_END))
    rows = messages.select("conv_id", "place", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == learned).alias("learned"))
    start = F.when(F.col("learned"), F.length("head")).otherwise(0)
    stop = F.when(F.col("learned"), F.length("head") + F.length("body")).otherwise(0)
    rows = rows.select("conv_id", "place", F.concat("head", "body", F.lit(TURN_END)).alias("turn"), F.struct(start.alias("start"), stop.alias("stop")).alias("span"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "turn", "span"))).alias("turns"))
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), F.transform("turns", lambda t: t["span"]).alias("loss_spans"))


def format_conversations(events: DataFrame, learned: str = LEARNED) -> DataFrame:
    """(conv_id, formatted, loss_spans) of a log; see fold_events and render."""
    return render(fold_events(events), learned)


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted(formatted, loss_spans, ...) with turns, an array of (role, text, learned) read from them; learned is
    what the loss span covers, unescaped."""
    pieces = formatted.withColumn("__pieces", F.split("formatted", TURN_END))
    pieces = pieces.withColumn("__pieces", F.slice("__pieces", F.lit(1), F.greatest(F.size("__pieces") - 1, F.lit(0))))

    def turn(piece: Column, span: Column) -> Column:
        text_at = F.instr(piece, ROLE_END) + len(ROLE_END)
        role = F.url_decode(F.substring_index(F.substr(piece, F.lit(len(TURN_START) + 1)), ROLE_END, 1))
        learned = F.substr(piece, span["start"] + 1, span["stop"] - span["start"])
        return F.struct(role.alias("role"), unescape(F.substr(piece, text_at)).alias("text"), unescape(learned).alias("learned"))

    return pieces.withColumn("turns", F.zip_with("__pieces", "loss_spans", turn)).drop("__pieces")


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from formatted texts."""
    texts = read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("whole"),
        F.array_join(F.transform("turns", lambda t: t["learned"]), "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return texts.select(
        "conv_id", "n_turns", F.sha2("whole", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
