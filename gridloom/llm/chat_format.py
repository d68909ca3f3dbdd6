"""Chat formatting by perspective rotation.

For every participant of a conversation the whole dialogue is rendered once with that speaker as the assistant and
all others as named users; the loss mask covers what the assistant says. A rendering comes as its segments, one for
each turn in order, with the characters that each takes in the whole rendering (start inclusive, end exclusive), so
that a dialogue of any length never has to fit one row or one task; joining the segments of a (conv_id, perspective)
in order of char_start gives the text.

Offsets are worked out on lengths alone: rows with one turn, speaker and beginning are a place; prefix sums over places
are taken in two steps, of blocks of turns, then within a block. The texts are shuffled once, to their places, and are
repeated for each perspective after that.

Defined cases: a null text is an empty one; a null role speaks as `unknown`; `system` is context, never a
perspective (a conversation of system turns alone gives no rows); turns that share a number (or have none) are
ordered by number, role and text; repeated rows are repeated turns; a null conv_id is a conversation of its own; other
columns are ignored. Neither a text nor a role can forge a turn: marker strings are broken up by a space in both, and
line breaks in a role are blanks. A participant called `assistant` is one as any other: where it isn't the perspective,
its turns are a named user's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
CONTEXT_ROLES = ("system",)
#: Turns in a block of the prefix sums, and the characters of a text that its place has.
BLOCK_TURNS = 1024
BEGINNING = 4


def unmarked(c: Column) -> Column:
    """Without marker strings."""
    return F.replace(c, F.lit("<|im_"), F.lit("<| im_"))


def speaker_of(role: Column) -> Column:
    """A role as it may stand in a header line."""
    return F.translate(unmarked(F.coalesce(role, F.lit("unknown"))), "\r\n", "  ")


def rotate(turns: DataFrame, context_roles: tuple[str, ...] = CONTEXT_ROLES, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, perspective, turn, speaker, segment, trained (boolean), char_start, char_end, mask_start, mask_end (null where not trained)."""
    said = turns.select(F.col("conv_id").alias("c"), F.col("turn").cast("long").alias("t"), speaker_of(F.col("role")).alias("s"), unmarked(F.coalesce("text", F.lit(""))).alias("said"))
    # structs as keys: their fields may be null and still be equal
    said = said.select(F.struct("c", "t", "s", F.left("said", F.lit(BEGINNING)).alias("b")).alias("place"), "said")
    trained = F.col("place.s") == F.col("perspective")
    header = F.when(F.col("place.s").isin(*context_roles), F.col("place.s")).when(trained, "assistant").otherwise(F.concat(F.lit("user name="), F.col("place.s")))
    header = F.concat(F.lit(START), header, F.lit("\n"))
    around = (F.length(header) + len(END) + 1).cast("long")
    places = said.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("said")).alias("chars"))
    conv = F.struct(F.col("place.c")).alias("conv")
    seats = places.filter(~F.col("place.s").isin(*context_roles)).select(conv, F.col("place.s").alias("perspective")).distinct()
    seen = places.withColumn("conv", conv).join(seats, "conv").withColumns({"side": F.struct("conv", "perspective"), "block": F.floor(F.col("place.t") / block_turns)})
    seen = seen.select("place", "perspective", "side", F.struct("side", "block").alias("of"), (F.col("chars") + F.col("n") * around).alias("width"))
    blocks = seen.groupBy("of").agg(F.sum("width").alias("chars"))
    before = Window.partitionBy("of.side").orderBy("of.block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("of", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("of").orderBy("place.t", "place.s", "place.b").rowsBetween(Window.unboundedPreceding, -1)
    starts = seen.join(blocks, "of").select("place", "perspective", (F.col("base") + F.coalesce(F.sum("width").over(within), F.lit(0))).alias("at"))
    starts = starts.groupBy("place").agg(F.collect_list(F.struct("perspective", "at")).alias("seats"))
    # within a place all headers have one length
    earlier = Window.partitionBy("place").orderBy("said").rowsBetween(Window.unboundedPreceding, -1)
    own = said.withColumns({"rows": F.count(F.lit(1)).over(earlier), "chars": F.coalesce(F.sum(F.length("said")).over(earlier), F.lit(0))})
    each = own.join(starts.hint("merge"), "place").select("place", "said", "rows", "chars", F.inline("seats"))
    each = each.select("place", "perspective", trained.alias("trained"), F.concat(header, F.col("said"), F.lit(END + "\n")).alias("segment"), F.length(header).cast("long").alias("head"), (F.col("at") + F.col("chars") + F.col("rows") * around).alias("at"))
    stop = F.col("at") + F.length("segment")
    return each.select(
        F.col("place.c").alias("conv_id"), "perspective", F.col("place.t").alias("turn"), F.col("place.s").alias("speaker"), "segment", "trained", F.col("at").alias("char_start"), stop.alias("char_end"),
        F.when(F.col("trained"), F.col("at") + F.col("head")).alias("mask_start"), F.when(F.col("trained"), stop - 1).alias("mask_end"),
    )
