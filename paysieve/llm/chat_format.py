"""Chat transcripts as training samples under a token budget, with DataFrame functions only.

Prefix sums of the turns' tokens cut a conversation at turn boundaries. The time line is laid out in cells of the room that system turn
and history leave of the budget; the turns that lie within a cell are one window, a turn that crosses the end of its cell is a window of
its own. So only a turn that is longer than that room makes a sample longer than the budget, and no window depends on the one before.
Each sample holds the system turn, then at most ``history`` tokens of turns repeated from the window before, then the window's own turns. Only assistant texts among the own turns are under the loss mask, so each is a target exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Marks of a turn. Texts hold no ``<|`` after escaping.
START, END = "<|im_start|>", "<|im_end|>"
NO_CONVERSATION = -1


def escape(text):
    """One backslash more between ``<`` and ``|``, however many there are; so no mark can arise from a text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text):
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def n_tokens(text, per_token: int = 4):
    """Tokens of a turn: a quarter of its characters, rounded up, and four for its marks."""
    return (F.ceil(F.length(text) / F.lit(per_token)) + 4).cast("long")


def format_chats(turns: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """One row per sample: conv_id, window, formatted, repeated (turns before the own ones), n_turns (own turns), loss (spans of
    code points: struct start long from 1, length long).

    Turns are ordered by turn (null last), then role and text; repeated rows are separate turns. A null text is empty, a null role
    the empty role, null conv_ids form one conversation. System turn, history and own turns of a sample are at most ``budget`` tokens
    (by ``n_tokens``); a turn longer than what system turn and ``history`` leave is a sample of its own and kept whole. A system turn that
    opens the conversation is an own turn of the first window and is repeated in the others, not as history. No turns: no samples.
    """
    if not 0 < history <= budget:
        raise ValueError("history must be positive and at most the budget")
    order = [F.col("turn").isNull(), "turn", "role", "text"]
    conv = Window.partitionBy("conv_id")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"pos": F.row_number().over(conv.orderBy(*order)), "n": n_tokens(F.col("text"))})
    running = conv.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.coalesce(F.sum("n").over(running), F.lit(0)))
    opens = (F.col("pos") == 1) & (F.col("role") == "system")
    rows = rows.withColumn("opening", F.max(F.when(opens, F.col("n")).otherwise(0)).over(conv))
    room = F.greatest(F.lit(budget - history) - F.col("opening"), F.lit(1))
    at = F.col("begin") - F.col("opening")                                        # where the turns after the system turn begin
    cell = F.floor(at / room).cast("long")
    rows = rows.withColumn("cell", F.when(~opens, 2 * cell + (at + F.col("n") > (cell + 1) * room).cast("long")))
    rows = rows.withColumn("first", F.coalesce(F.min("cell").over(conv), F.lit(0).cast("long"))).withColumn("window", F.coalesce("cell", "first")).drop("cell", "opening")
    # the window after a turn's own one, and where it begins: the last value met when looking from the end
    later = conv.orderBy(F.desc("window")).rangeBetween(Window.unboundedPreceding, -1)
    nxt = F.min(F.struct("window", "begin")).over(later)
    rows = rows.withColumn("next", nxt).withColumn("body", F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"), escape(F.col("text")), F.lit(END), F.lit("\n")))
    system = (F.col("pos") == 1) & (F.col("role") == "system")
    own = F.struct(F.col("window"), F.lit(True).alias("own"))
    again = F.when(~system & (F.col("next.begin") - F.col("begin") <= history), F.struct(F.col("next.window").alias("window"), F.lit(False).alias("own")))
    copies = rows.withColumn("at", F.explode(F.array_compact(F.array(own, again)))).select("conv_id", "at.window", "at.own", "pos", "role", "body", "text")
    opening = rows.filter(system).select(F.col("conv_id").alias("_conv"), *(F.col(c) for c in ("pos", "role", "body", "text")))
    more = rows.filter("window > first").select("conv_id", "window").distinct().join(opening, F.col("conv_id").eqNullSafe(F.col("_conv")))
    every = copies.unionByName(more.select("conv_id", "window", F.lit(False).alias("own"), "pos", "role", "body", "text"))
    target = F.col("own") & (F.col("role") == "assistant")
    part = F.struct("pos", "own", "body", F.length("body").cast("long").alias("size"),
                    F.when(target, F.length(F.concat(F.lit(START), F.url_encode("role"), F.lit("\n")))).cast("long").alias("head"),
                    F.when(target, F.length(escape(F.col("text")))).cast("long").alias("length"))
    grouped = every.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    start = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("loss"))
    step = lambda s, p: F.struct((s["at"] + p["size"]).alias("at"), F.when(p["head"].isNull(), s["loss"]).otherwise(
        F.concat(s["loss"], F.array(F.struct((s["at"] + p["head"]).alias("start"), p["length"].alias("length"))))).alias("loss"))
    return grouped.select("conv_id", "window", F.concat_ws("", F.transform("parts", lambda p: p["body"])).alias("formatted"),
                          F.size(F.filter("parts", lambda p: ~p["own"])).alias("repeated"), F.size(F.filter("parts", lambda p: p["own"])).alias("n_turns"),
                          F.aggregate("parts", start, step)["loss"].alias("loss"))


def read_chats(samples: DataFrame) -> DataFrame:
    """The conversations read back from the samples alone: conv_id, turns (role, text of each turn once), targets (the texts under
    the loss mask), formatted_chars."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), F.col("repeated") + 2, F.greatest("n_turns", F.lit(1)))
    body = lambda p: F.substring_index(p, "<|im_end|>", 1)
    turn = lambda p: F.struct(F.url_decode(F.substring_index(p, "\n", 1)).alias("role"),
                              unescape(F.substr(p, F.instr(p, F.lit("\n")) + 1)).alias("text"))
    told = samples.select("conv_id", "window", F.transform(pieces, lambda p: turn(body(p))).alias("turns"),
                          F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"], s["length"]))).alias("targets"),
                          F.length("formatted").cast("long").alias("chars"))
    grouped = told.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "targets"))).alias("all"), F.sum("chars").alias("formatted_chars"))
    return grouped.select("conv_id", F.flatten(F.transform("all", lambda w: w["turns"])).alias("turns"),
                          F.flatten(F.transform("all", lambda w: w["targets"])).alias("targets"), "formatted_chars")
