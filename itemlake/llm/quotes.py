"""Quotation linking: reply-ordered conversations without quotes, in DataFrame operations only.

Leading ``>`` marks give a line its quote level. Consecutive quoted lines of a level are a passage.
Lines are normalised (lower case, letters and digits, single blanks) and hashed; a quoted line is
joined to the latest earlier message of its conversation whose own lines, or whose quoted passage's
whole text, has that hash. The message most of whose text is quoted at level one is the one
replied to; without a link it is the message before. Following replies back gives each message its
thread and depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlake.llm.common import cut_lineage, typed
from itemlake.operators.ordered import ordered_scan

MARKS = r"^((?:[ \t]*>)*)"
NONE = -(2**62)  # stands for a missing conversation or turn


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def unquoted(line: Column) -> Column:
    return F.regexp_replace(line, MARKS + "[ \t]?", "")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def own_text(text: str | Column) -> Column:
    """A message without its quoted lines; blank lines around the rest are cut."""
    column = F.col(text) if isinstance(text, str) else text
    lines = F.filter(F.split(column, "\n", -1), lambda x: quote_level(x) == 0)
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+$", "")


def _lines(messages: DataFrame) -> DataFrame:
    exploded = messages.select("conv", "turn", "part", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return exploded.select("conv", "turn", "part", "pos", quote_level(F.col("line")).alias("level"),
                           normalised(unquoted(F.col("line"))).alias("words")).filter("words <> ''")


def _passages(lines: DataFrame) -> DataFrame:
    """Runs of neighbouring lines of one level, as one text. Groups are runs of one message's lines."""
    run = ordered_scan(lines.withColumn("__pos", F.col("pos").cast("long")), ["conv", "turn", "part"], ["__pos"],
                       prior={"__before": F.col("level")})
    starts = (~F.col("level").eqNullSafe(F.col("__before"))).cast("long")
    marked = ordered_scan(run.withColumn("__new", starts), ["conv", "turn", "part"], ["__pos"], running={"run": F.col("__new")})
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__pos", "words"))), lambda x: x["words"]), " ")
    return marked.groupBy("conv", "turn", "part", "level", "run").agg(joined.alias("words"))


def quotation_links(messages: DataFrame) -> DataFrame:
    """``(conv, turn, level, source, chars)``: characters that a turn quotes at a level from turn ``source``."""
    lines = cut_lineage(_lines(messages))
    quoted = lines.filter("level > 0").select("conv", "turn", "level", "words")
    whole = _passages(lines)
    units = cut_lineage(quoted.union(whole.filter("level > 0").select("conv", "turn", "level", "words"))
                        .select("conv", "turn", "level", F.xxhash64("words").alias("hash"), F.length("words").alias("chars"))
                        .groupBy("conv", "turn", "level", "hash").agg(F.max("chars").alias("chars")))
    own = (lines.filter("level = 0").select("conv", "turn", "words")
           .union(whole.filter("level = 0").select("conv", "turn", "words")).select("conv", "turn", F.xxhash64("words").alias("hash")))
    # Only hashes that are quoted somewhere in the conversation matter.
    asked = units.select("conv", "hash").distinct()
    said = own.join(asked, ["conv", "hash"], "left_semi").distinct()
    both = (units.select("conv", "hash", "turn", F.lit(None).cast("long").alias("said"))
            .union(said.select("conv", "hash", "turn", F.col("turn").alias("said")))
            .groupBy("conv", "hash", "turn").agg(F.max("said").alias("said")))
    found = ordered_scan(both, ["conv", "hash"], ["turn"], prior={"source": F.col("said")}).filter(F.col("source").isNotNull())
    return (units.join(found.select("conv", "hash", "turn", "source"), ["conv", "hash", "turn"])
            .groupBy("conv", "turn", "level", "source").agg(F.sum("chars").alias("chars")))


def _threads(replies: DataFrame) -> DataFrame:
    """Depth and first turn of every turn's chain of replies.

    Turns that reply to the turn before them form stretches, within which depth is a difference of
    places. Only the stretches' heads, which begin a conversation or reply further back, are followed
    by doubling the step taken back.
    """
    far = ~F.col("reply_to").eqNullSafe(F.col("before")) | F.col("before").isNull()
    laid = cut_lineage(ordered_scan(replies.withColumn("far", far), ["conv"], ["turn"], position="place",
                                    running={"stretch": F.col("far").cast("long")}))
    heads = laid.filter("far").select("conv", "stretch", F.col("turn").alias("first"), F.col("place").alias("at"), "reply_to")
    source = laid.select(F.col("conv").alias("__c"), F.col("turn").alias("__t"), F.col("stretch").alias("__s"), F.col("place").alias("__p"))
    begins = heads.select(F.col("conv").alias("__hc"), F.col("stretch").alias("__hs"), F.col("at").alias("__hat"))
    linked = (heads.filter(F.col("reply_to").isNotNull())
              .join(source, (F.col("conv") == F.col("__c")) & (F.col("reply_to") == F.col("__t")))
              .join(begins, (F.col("conv") == F.col("__hc")) & (F.col("__s") == F.col("__hs")))
              .select("conv", "stretch", F.col("__s").alias("up"), (F.col("__p") - F.col("__hat") + 1).alias("steps")))
    state, done = cut_lineage(linked), heads.filter(F.col("reply_to").isNull()).select(
        "conv", "stretch", F.col("stretch").alias("up"), F.lit(0).cast("long").alias("steps"))
    while not state.isEmpty():
        above = state.select(F.col("conv").alias("__c"), F.col("stretch").alias("__s"), F.col("up").alias("__up"), F.col("steps").alias("__n"))
        after = cut_lineage(state.join(above, (F.col("conv") == F.col("__c")) & (F.col("up") == F.col("__s")), "left").select(
            "conv", "stretch", F.coalesce("__up", "up").alias("up"), (F.col("steps") + F.coalesce("__n", F.lit(0))).alias("steps"),
            F.col("__up").isNotNull().alias("moved")))
        moved = not after.filter("moved").isEmpty()
        state = after.drop("moved")
        if not moved:
            done = done.union(state)
            break
    roots = heads.select(F.col("conv").alias("__c"), F.col("stretch").alias("__s"), F.col("first").alias("thread"))
    placed = heads.select("conv", "stretch", "at").join(done, ["conv", "stretch"]).join(
        roots, (F.col("conv") == F.col("__c")) & (F.col("up") == F.col("__s"))).select("conv", "stretch", "at", "steps", "thread")
    return (laid.join(placed, ["conv", "stretch"])
            .select("conv", "turn", "thread", (F.col("steps") + F.col("place") - F.col("at")).alias("depth")))


def reply_ordered(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """Messages without quotes: ``conv_id, turn, role, reply_to, thread, depth, text, n_quoted, n_linked``.

    ``thread`` is the first turn of the chain of replies, ``depth`` the replies from there; a conversation is
    in order by thread, depth and turn. ``n_quoted`` counts quoted lines, ``n_linked`` characters found in
    earlier messages. Rows with equal conversation and turn are parts of one message and share its links;
    each comes back, equal rows too. A missing conversation or turn is a value of its own, before all
    others. NULL text stays NULL and quotes nothing; no rows give none.
    """
    inputs = typed(conversations, {"conv": (conv_id, "long"), "turn": (turn, "long"), "role": (role, "string"), "text": (text, "string")})
    keyed = inputs.na.fill({"conv": NONE, "turn": NONE})
    parts = keyed.filter(F.col("text").isNotNull()).select("conv", "turn", "text", F.xxhash64("text").alias("part")).distinct()
    links = cut_lineage(quotation_links(parts))
    parent = (links.filter("level = 1").groupBy("conv", "turn")
              .agg(F.max(F.struct("chars", "source"))["source"].alias("source")))
    linked = links.groupBy("conv", "turn").agg(F.sum("chars").alias("n_linked"))
    turns = keyed.select("conv", "turn").distinct()
    before = ordered_scan(turns, ["conv"], ["turn"], prior={"before": F.col("turn")})
    replies = cut_lineage(before.join(parent, ["conv", "turn"], "left").join(linked, ["conv", "turn"], "left")
                          .select("conv", "turn", "before", F.coalesce("source", "before").alias("reply_to"),
                                  F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked")))
    placed = replies.drop("before").join(_threads(replies), ["conv", "turn"])
    quoted = F.size(F.filter(F.split("text", "\n", -1), lambda x: quote_level(x) > 0))
    joined = keyed.join(placed, ["conv", "turn"])

    def shown(name: str) -> Column:
        return F.when(F.col(name) != NONE, F.col(name)).alias(name)

    return joined.select(shown("conv").alias("conv_id"), shown("turn"), "role", shown("reply_to"), shown("thread"), "depth",
                         own_text("text").alias("text"),
                         F.when(F.col("text").isNull(), 0).otherwise(quoted).cast("long").alias("n_quoted"), "n_linked")
