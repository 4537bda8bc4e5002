"""Chat formatting with multi-party perspective rotation.

For every participant of a dialogue (a speaker other than `system`) the dialogue is rendered with that speaker as
assistant and the others as named users; mask spans cover what the assistant says, and only that is trained on.

A turn becomes `<|system|>`, `<|user name=X|>` or `<|assistant|>`, a line break, the text, `<|end|>` and a line break; its
mask span covers text and end mark. `<|` inside a text or name is written `< |`, so texts can't forge marks.

Turns are counted by their place in the dialogue, whatever their numbers. A dialogue is rendered whole as long as its turns
(their texts, their names and 32 bytes each for marks) have at most `part_bytes` bytes, so what a row and a task hold is
bounded in bytes. Longer ones are cut into parts: a turn goes to the part of the bytes before it, divided by part_bytes.
`part_turns` cuts by a number of turns instead; None for both renders all dialogues whole. Later parts open with the system
turns that open the dialogue (those of its first part) and with the last `context_turns` turns of the part before; what is
repeated so is never a target, as it was one before. A part has a row for each participant who speaks in its own turns: for
others there is nothing in it to train on.

Places are given by a sort of all rows by dialogue and turn. Spark cuts that order into ranges that may part a dialogue;
a dialogue's rows in a range are numbered on from those in the ranges before. So one that has a third of all rows is
spread as well.

Defined results: rows without conv_id belong to no dialogue and are left out. A null role is the speaker `unknown`, a null
text is empty, a null turn comes first. Turns of one number are ordered by role, then by text; repeated rows are all
rendered. A dialogue of system turns alone has no participant, and no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_enough, stored

PART_BYTES = 1 << 22
#: Turns of the part before that a part opens with.
CONTEXT_TURNS = 16
#: Bytes of a turn beside its text and its speaker's name.
MARK_BYTES = 32
#: Sizes that are summed at a time, for positions in a text.
_BLOCK = 64


def _placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, role, text, size, __range, __bytes), where place counts a dialogue's turns from 0 and __bytes are those
    of the ranges before; and (conv_id, n, n_bytes), a dialogue's turns and bytes in all."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    # a hash parts rows that are equal in all this, so that a range needn't hold all of them
    ranged = turns.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order, "__tie").sortWithinPartitions(*order)
    size = (F.octet_length("role") + F.octet_length("text") + MARK_BYTES).cast("long").alias("size")
    ranged = stored(ranged.withColumn("__at", F.monotonically_increasing_id()).select("conv_id", "role", "text", size, "__at", F.shiftright("__at", 33).alias("__range")))
    counts = stored(ranged.groupBy("conv_id", "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"), F.sum("size").alias("__size")))
    before = lambda n: F.sum(n).over(W.partitionBy("conv_id").orderBy("__range").rowsBetween(W.unboundedPreceding, 0)) - F.col(n)
    offsets = counts.select("conv_id", "__range", (before("__n") - F.col("__first")).alias("__shift"), before("__size").alias("__bytes"))
    placed = ranged.join(offsets, ["conv_id", "__range"]).select("conv_id", (F.col("__at") + F.col("__shift")).alias("place"), "role", "text", "size", "__range", "__bytes")
    return placed, counts.groupBy("conv_id").agg(F.sum("__n").alias("n"), F.sum("__size").alias("n_bytes"))


def _parts(placed: DataFrame, lengths: DataFrame, part_turns: int | None, part_bytes: int | None, context_turns: int) -> DataFrame:
    """(conv_id, part, turns, opening), arrays of turns: those of a part and those that it repeats."""
    none = F.slice("turns", 1, 0)
    gathered = F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns")
    whole = lambda rows: rows.groupBy("conv_id").agg(gathered).select("conv_id", F.lit(0).cast("long").alias("part"), "turns", none.alias("opening"))
    if not part_turns and not part_bytes:
        return whole(placed)
    long = stored(lengths.where(F.col("n") > part_turns if part_turns else F.col("n_bytes") > part_bytes).select("conv_id"))
    if long.isEmpty():
        return whole(placed)
    long = small_enough(long)
    within = F.coalesce(F.sum("size").over(W.partitionBy("conv_id", "__range").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = F.floor(F.col("place") / part_turns) if part_turns else F.floor((F.col("__bytes") + within) / part_bytes)
    parts = stored(placed.join(long, "conv_id", "left_semi").withColumn("__cut", cut).groupBy("conv_id", "__cut").agg(gathered))
    # a turn longer than a part leaves a gap in the numbers
    numbers = stored(parts.select("conv_id", "__cut").withColumn("part", F.row_number().over(W.partitionBy("conv_id").orderBy("__cut")).cast("long") - 1))
    parts = parts.join(small_enough(numbers), ["conv_id", "__cut"]).drop("__cut")
    # system turns before the first that isn't
    until = F.array_position(F.transform("turns", lambda t: t["role"] != "system"), F.lit(True)).cast("int") - 1
    openings = stored(parts.where("part = 0").select("conv_id", F.slice("turns", F.lit(1), F.when(until < 0, F.size("turns")).otherwise(until)).alias("first")))
    parts = parts.join(small_enough(openings), "conv_id")
    again = F.when(F.col("part") > 0, F.col("first")).otherwise(none)
    if context_turns:
        last = F.slice("turns", F.greatest(F.lit(1), F.size("turns") - context_turns + 1), F.lit(context_turns))
        context = F.when(F.col("part") > 0, last).otherwise(F.filter(last, lambda t: t["place"] >= F.size("first")))
        before = stored(parts.select("conv_id", (F.col("part") + 1).alias("part"), context.alias("before")))
        parts = parts.join(small_enough(before), ["conv_id", "part"], "left")
        again = F.concat(again, F.coalesce("before", none))
    return whole(placed.join(long, "conv_id", "left_anti")).unionByName(parts.select("conv_id", "part", "turns", again.alias("opening")))


def _sum(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda a, x: a + x)


def rotate(df: DataFrame, part_turns: int | None = None, part_bytes: int | None = PART_BYTES, context_turns: int = CONTEXT_TURNS) -> DataFrame:
    """From (conv_id, turn, role, text): conv_id, perspective, part, n_turns, n_repeated (turns of the opening that are also
    in parts before), n_targets, text, and mask, an array of (start, end) in code points."""
    clean = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    turns = df.where("conv_id is not null").select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        clean(F.coalesce(F.col("role"), F.lit("unknown"))).alias("role"),
        clean(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
    )
    parts = _parts(*_placed(turns), part_turns, part_bytes, context_turns)
    speakers = F.filter(F.array_distinct(F.transform("turns", lambda t: t["role"])), lambda r: r != "system")
    views = parts.withColumn("perspective", F.explode(speakers)).withColumn("turns", F.concat("opening", "turns"))
    head = lambda t: F.when(t["role"] == F.col("perspective"), "<|assistant|>\n").when(t["role"] == "system", "<|system|>\n").otherwise(F.concat(F.lit("<|user name="), t["role"], F.lit("|>\n")))
    views = views.withColumn("pieces", F.transform("turns", lambda t, i: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit("<|end|>\n")).alias("body"), ((t["role"] == F.col("perspective")) & (i >= F.size("opening"))).alias("target"))))
    views = views.withColumn("sizes", F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["body"])))
    views = views.withColumn("sums", F.transform(F.sequence(F.lit(0), F.floor((F.size("sizes") - 1) / _BLOCK).cast("int")), lambda b: _sum(F.slice("sizes", b * _BLOCK + 1, F.lit(_BLOCK)))))
    views = views.withColumn("blocks", F.transform("sums", lambda _, b: _sum(F.slice("sums", F.lit(1), b))))
    block = lambda i: F.floor(i / _BLOCK).cast("int")
    begin = lambda i: F.get("blocks", block(i)) + _sum(F.slice("sizes", block(i) * _BLOCK + 1, i % _BLOCK))
    spans = F.transform("pieces", lambda p, i: F.struct(p["target"].alias("target"), (begin(i) + F.length(p["head"])).alias("start"), (begin(i) + F.length(p["head"]) + F.length(p["body"]) - 1).alias("end")))
    return views.select(
        "conv_id",
        "perspective",
        "part",
        F.size("pieces").cast("long").alias("n_turns"),
        F.size("opening").cast("long").alias("n_repeated"),
        F.size(F.filter("pieces", lambda p: p["target"])).cast("long").alias("n_targets"),
        F.concat_ws("", F.transform("pieces", lambda p: F.concat(p["head"], p["body"]))).alias("text"),
        F.transform(F.filter(spans, lambda s: s["target"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("mask"),
    )
