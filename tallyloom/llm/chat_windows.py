"""Chat formatting into budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens choose windows of whole turns.  A conversation's window
for new turns is its budget less the system turn and the room for history.  A turn over half of
that is a window of its own; the others fall into bins of half of it by where their
prefix sum ends, so that the turns of a bin never pass it.  Each later window repeats the system turn and
at most ``history_turns`` turns before it, as far as they fit the room for history.  The loss
mask covers each assistant text in the window where it is new, and nowhere else.

All of it is window functions that stream over a conversation's turns in order; only the
turns of one window, bounded by the budget, are ever put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The template.  These strings can't occur in an escaped role or text.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"


def escape(text: Column) -> Column:
    """Reversible: a backslash is doubled, and one is put between < and |."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def estimated_tokens(text: Column) -> Column:
    """A turn's tokens as a quarter of its UTF-8 bytes, rounded up, and four for the marks."""
    return (F.ceil(F.octet_length(text) / 4) + 4).cast("long")


def turn_windows(turns: DataFrame, budget: int = 1024, history: int = 256, history_turns: int = 2, tokens=estimated_tokens) -> DataFrame:
    """(conv_id, window, segments): the turns of every window, in order.

    segments: array of (pos, kind, role, text, tokens) with escaped role and text; kind 0 is a
    repeated turn, 1 a new one.
    """
    base = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        escape(F.coalesce(F.col("role").cast("string"), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    ).withColumn("tokens", tokens(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    seen = base.withColumn("pos", F.row_number().over(order)).withColumn("is_system", (F.col("pos") == 1) & (F.col("role") == "system"))
    first = F.first(F.when(F.col("is_system"), F.struct("role", "text", "tokens"))).over(upto)
    room = F.greatest(F.lit(budget - history).cast("long") - F.coalesce(F.col("system.tokens"), F.lit(0)), F.lit(2).cast("long"))
    half = F.floor(F.col("room") / 2)
    own = seen.withColumn("system", first).withColumn("room", room).withColumn("body", F.when(~F.col("is_system"), F.col("tokens")).otherwise(F.lit(0)))
    own = own.withColumn("large", F.col("body") > half)
    own = own.withColumns({"end": F.sum("body").over(upto), "small_end": F.sum(F.when(~F.col("large"), F.col("body")).otherwise(0)).over(upto), "larges": F.sum(F.col("large").cast("long")).over(upto)})
    own = own.withColumn("start", F.col("end") - F.col("body"))
    run = F.struct((F.col("larges") * 2 - F.col("large").cast("long")).alias("run"), F.when(F.col("large"), F.lit(0).cast("long")).otherwise(F.floor((F.col("small_end") - 1) / half)).alias("bin"))
    own = own.withColumn("run", F.when(~F.col("is_system"), run))
    before = F.lag("run").over(order)
    own = own.withColumn("opens", ~F.col("is_system") & (before.isNull() | (before != F.col("run"))))
    own = own.withColumn("window", F.greatest(F.sum(F.col("opens").cast("long")).over(upto), F.lit(1).cast("long")))

    def turn(pos: Column, kind: int, of: str = "") -> Column:
        return F.struct(pos.cast("long").alias("pos"), F.lit(kind).alias("kind"), F.col(f"{of}role").alias("role"), F.col(f"{of}text").alias("text"), F.col(f"{of}tokens").alias("tokens"))

    placed = [F.struct(F.col("window").alias("window"), turn(F.col("pos"), 1).alias("segment"))]
    placed.append(F.when(F.col("opens") & (F.col("window") > 1) & F.col("system").isNotNull(), F.struct(F.col("window").alias("window"), turn(F.lit(0), 0, "system.").alias("segment"))))
    for k in range(1, history_turns + 1):
        own = own.withColumns({f"{c}_{k}": F.lead(c, k).over(order) for c in ("opens", "start", "window")})
        # The windows that a turn is repeated in open after it.
        fits = F.col(f"opens_{k}") & ~F.col("is_system") & (F.col(f"start_{k}") - F.col("start") <= history)
        placed.append(F.when(fits, F.struct(F.col(f"window_{k}").alias("window"), turn(F.col("pos"), 0).alias("segment"))))
    rows = own.select("conv_id", F.explode(F.filter(F.array(*placed), lambda x: x.isNotNull())).alias("p")).select("conv_id", "p.window", "p.segment")
    return rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("segment")).alias("segments"))


def format_chats(turns: DataFrame, budget: int = 1024, history: int = 256, history_turns: int = 2, tokens=estimated_tokens) -> DataFrame:
    """(conv_id, window, formatted, n_repeated, n_new, n_tokens, loss): one row for each window.

    *turns*: (conv_id, turn, role, text).  Turns go by turn, null first; equal turns by role and
    text, repeated rows stay.  A null role or text is empty; a null conv_id is a conversation.  A leading
    turn of the role "system" is repeated in every window.  loss: array of (start, end),
    in code points of *formatted*, end exclusive, of the texts of the role
    "assistant" that are new here.  A turn larger than the budget is a window of its own and passes it;
    turns are never cut.  Other columns of *turns* are not read.
    """
    windows = turn_windows(turns, budget, history, history_turns, tokens)

    def head(s: Column) -> Column:
        return F.concat(F.lit(TURN), s["role"], F.lit(SAYS))

    rendered = F.transform("segments", lambda s: F.concat(head(s), s["text"], F.lit(END)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + F.length(head(s))
        end = begin + F.length(s["text"])
        span = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))
        mine = (s["kind"] == 1) & (s["role"] == "assistant")
        return F.struct((end + len(END)).cast("long").alias("at"), F.when(mine, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return windows.select(
        "conv_id",
        "window",
        F.array_join(rendered, "").alias("formatted"),
        F.size(F.filter("segments", lambda s: s["kind"] == 0)).cast("long").alias("n_repeated"),
        F.size(F.filter("segments", lambda s: s["kind"] == 1)).cast("long").alias("n_new"),
        F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + s["tokens"]).alias("n_tokens"),
        F.aggregate("segments", start, step, lambda acc: acc["spans"]).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, window, turns, losses, chars): the new turns and the texts under the loss mask, parsed from the windows.

    turns: array of (role, text), unescaped, without the repeated ones; losses: array of unescaped texts.
    """
    segments = F.split("formatted", r"<\|end\|>", -1)
    new = F.filter(segments, lambda x, i: (i >= F.col("n_repeated")) & (i < F.col("n_repeated") + F.col("n_new")))

    def parse(x: Column) -> Column:
        role = F.substring_index(x, SAYS, 1)
        return F.struct(unescape(F.substring(role, F.lit(len(TURN) + 1), F.length(role))).alias("role"), unescape(F.substring(x, F.length(role) + len(SAYS) + 1, F.length(x))).alias("text"))

    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", "window", F.transform(new, parse).alias("turns"), masked.alias("losses"), F.length("formatted").cast("long").alias("chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows), read back from the windows.

    A digest over a whole conversation needs its text in one row; this is the only step that does.
    """
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    own = read_back(formatted).select("conv_id", "window", said.alias("said"), F.array_join("losses", "").alias("loss"), F.size("turns").cast("long").alias("n_turns"), "chars")
    whole = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("w"), F.sum("n_turns").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return whole.select("conv_id", "n_turns", F.sha2(F.array_join(F.transform("w", lambda x: x["said"]), ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_windows")
