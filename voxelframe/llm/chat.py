"""Chat formatting with budgeted windows, in DataFrame functions only.

Prefix sums of the turns' tokens cut a conversation into spans of whole turns that fit the budget.
Every window holds the system turn, then a limited part of the history before its span, then the
span. The loss mask covers each assistant text once: what a window repeats is masked.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. Inside roles and texts `<` followed
by k backslashes and `|` is written with k + 1 backslashes, so no control string occurs there and
the original comes back exactly; a role's backslashes and line feeds are escaped too.

Prefix sums are formed in two levels (inside blocks of turns, over blocks), and spans are chosen
inside stretches of 64 budgets, so no task needs a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.llm.common import col, stage

START, END = "<|im_start|>", "<|im_end|>\n"
#: Turns of a prefix-sum block; budgets of a stretch; tokens that the template adds to a turn.
BLOCK, STRETCH, OVERHEAD = 512, 64, 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Also backslash as \\s and line feed as \\n, so that the role ends at the first line feed."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def token_estimate(text: Column) -> Column:
    """A token for every four bytes, and the template's."""
    return (F.ceil(F.octet_length(text) / 4) + OVERHEAD).cast("long")


def windows(turns: DataFrame, budget: int = 2048, history: int = 512, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text", tokens: str | None = None, target: str = "assistant", system: str = "system") -> DataFrame:
    """One row per window: conv, window (prefix sum at its span's start), n_repeated, n_turns, n_tokens, text, loss.

    loss: (start, length) in code points of `text` for each new target text, escaped as it stands
    there; the first n_repeated turns of a window are repeats. Tokens come from a column `tokens`
    or from token_estimate(). A span has at most budget - history - system tokens, or a quarter of the
    budget if that is more and fits beside the system turn; a longer turn has a span of its own, whole.
    History gives way to the span, so every window keeps the budget unless a single turn and the
    system turn together are longer than that.

    Rows are ordered by turn, role, text (nulls first), so ties and repeated rows have a place. A
    null text or role counts as empty; rows of a null conv form one conversation. The system turn is
    the first row if its role is `system`. An empty table gives no windows; further columns are
    not looked at.
    """
    body, speaker = F.coalesce(col(text), F.lit("")), F.coalesce(col(role), F.lit(""))
    base = turns.select(col(conv).alias("c"), col(turn).alias("t"), speaker.alias("r"), body.alias("x"), (token_estimate(body) if tokens is None else F.greatest(F.coalesce(col(tokens), F.lit(0)), F.lit(1)).cast("long")).alias("k"))
    base = base.withColumn("b", F.floor(F.coalesce(F.col("t"), F.lit(-1)) / BLOCK))
    inside = Window.partitionBy("c", "b").orderBy("t", "r", "x", "k")
    local = base.withColumn("i", F.row_number().over(inside)).withColumn("s", F.sum("k").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("k"))
    sums = base.groupBy("c", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("bk"), F.min(F.struct("t", "r", "x", "k")).alias("head"))
    earlier = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("c")
    first = F.min(F.struct("b", "head")).over(everything)["head"]
    offsets = sums.select("c", "b", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("bk").over(earlier), F.lit(0)).alias("s0"), F.when(first["r"] == system, first["x"]).alias("sys"), F.when(first["r"] == system, first["k"]).otherwise(0).alias("sk"))
    offsets = offsets.withColumnsRenamed({"c": "oc", "b": "ob"})
    at = local.join(offsets, F.col("c").eqNullSafe(F.col("oc")) & (F.col("b") == F.col("ob")))
    at = at.select("c", "r", "x", "k", (F.col("i") + F.col("n0")).alias("pos"), (F.col("s") + F.col("s0")).alias("p"), "sys", "sk")
    room = F.greatest(budget - history - F.col("sk"), F.least(F.lit(budget // 4), budget - F.col("sk")), F.lit(1))
    placed = at.withColumn("room", room).withColumn("stretch", F.floor(F.col("p") / (STRETCH * budget)))

    # spans of a stretch: the fold keeps only the starts of spans, at most 64 budgets' worth
    each = placed.groupBy("c", "stretch").agg(F.array_sort(F.collect_list(F.struct("p", "k", "pos", "r", "x"))).alias("turns"), F.first("room").alias("room"), F.first("sys").alias("sys"), F.first("sk").alias("sk"))
    starts = F.aggregate("turns", F.array(F.element_at("turns", 1)["p"]), lambda a, u: F.when(u["p"] + u["k"] - F.element_at(a, -1) > F.col("room"), F.array_union(a, F.array(u["p"]))).otherwise(a))
    spans = each.withColumn("starts", starts)
    spans = spans.select("c", "sys", "sk", F.explode("turns").alias("u"), "starts")
    own = F.array_max(F.filter("starts", lambda z: z <= F.col("u")["p"]))
    spans = spans.select("c", "sys", "sk", own.alias("w"), "u.*")

    # a turn is repeated in the window after its own if it lies in the last `history` tokens before it, and as far as that window has room
    close = Window.partitionBy("c", "w")
    spans = stage(spans.withColumn("end", F.max(F.col("p") + F.col("k")).over(close)).withColumn("is_sys", F.col("sys").isNotNull() & (F.col("pos") == 1)))
    new = spans.select("c", "w", "pos", "r", "x", "k", F.lit(False).alias("again"))
    after = spans.groupBy(F.col("c").alias("nc"), F.col("w").alias("nw")).agg((F.max("end") - F.col("nw")).alias("size"))
    close = spans.where(~F.col("is_sys") & (F.col("end") - F.col("p") <= history)).join(after, F.col("c").eqNullSafe(F.col("nc")) & (F.col("end") == F.col("nw")))
    old = close.where(F.col("end") - F.col("p") <= budget - F.col("sk") - F.col("size")).select("c", F.col("end").alias("w"), "pos", "r", "x", "k", F.lit(True).alias("again"))
    heads = spans.where((F.col("w") > 0) & F.col("sys").isNotNull()).groupBy("c", "w").agg(F.first("sys").alias("x"), F.first("sk").alias("k"))
    heads = heads.select("c", "w", F.lit(1).alias("pos"), F.lit(system).alias("r"), "x", "k", F.lit(True).alias("again"))
    lead = F.concat(F.lit(START), escape_role(F.col("r")), F.lit("\n"))
    rows = new.unionByName(old).unionByName(heads).select("c", "w", "pos", "k", "again", F.length(lead).alias("h"), F.concat(lead, escape(F.col("x")), F.lit(END)).alias("piece"), ((F.col("r") == target) & ~F.col("again")).alias("learn"))
    order = Window.partitionBy("c", "w").orderBy("pos")
    rows = rows.withColumn("from", F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece"))
    mask = F.when(F.col("learn"), F.struct((F.col("from") + F.col("h")).cast("long").alias("start"), (F.length("piece") - F.col("h") - len(END)).cast("long").alias("length")))
    made = rows.groupBy("c", "w").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("pieces"), F.array_sort(F.collect_list(mask)).alias("loss"), F.sum("k").alias("n_tokens"), F.count_if("again").alias("n_repeated"), F.count(F.lit(1)).alias("n_turns"))
    return made.select(F.col("c").alias(conv), F.col("w").alias("window"), "n_repeated", "n_turns", "n_tokens", F.array_join(F.transform("pieces", lambda z: z["piece"]), "").alias("text"), "loss")


def read_turns(text: Column) -> Column:
    """The (role, text) turns of a formatted window, unescaped."""
    split = F.split(text, r"<\|im_start\|>", -1)
    parts = F.slice(split, 2, F.size(split))
    return F.transform(parts, lambda z: F.struct(unescape_role(F.substring_index(z, "\n", 1)).alias("role"), unescape(F.substr(z, F.length(F.substring_index(z, "\n", 1)) + 2, F.length(z) - F.length(F.substring_index(z, "\n", 1)) - 1 - len(END))).alias("text")))


def digest(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, read back from the windows: its turns and what is learned, as digests.

    A digest of a whole conversation needs its text in one place; that is the only step that does.
    """
    fresh = F.slice(read_turns(F.col("text")), (F.col("n_repeated") + 1).cast("int"), F.col("n_turns").cast("int"))
    # the system turn of the first window is new; repeats always stand first
    said = F.array_join(F.transform(fresh, lambda z: F.concat(z["role"], F.lit("\n"), z["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss", lambda z: unescape(F.substr("text", (z["start"] + 1).cast("int"), z["length"].cast("int")))), "")
    each = formatted.select(col(conv).alias("c"), "window", F.size(fresh).alias("n"), said.alias("said"), learned.alias("learned"), F.length("text").alias("size"))
    whole = each.groupBy("c").agg(F.sum("n").cast("long").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "said", "learned"))).alias("all"), F.sum("size").cast("long").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"))
    said, learned = F.array_join(F.col("all.said"), ""), F.array_join(F.col("all.learned"), "")
    return whole.select(F.col("c").alias(conv), "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), "formatted_chars", "n_windows")
