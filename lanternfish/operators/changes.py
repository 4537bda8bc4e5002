"""Change capture and mutations, as joins and rewrites by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Digits of a modification time that count.
TIME_DIGITS = 6


def time_changed(stored: Column, current: Column) -> Column:
    return stored.isNull() | (F.round(stored, TIME_DIGITS) != F.round(current, TIME_DIGITS))


def diff(stored: DataFrame, current: DataFrame, key: str, time_col: str) -> DataFrame:
    """(key, change) for every key of either side: new, changed, deleted or same."""
    old = stored.select(key, F.col(time_col).alias("__old"), F.lit(True).alias("__stored"))
    new = current.select(key, F.col(time_col).alias("__new"), F.lit(True).alias("__there"))
    change = F.when(F.col("__stored").isNull(), "new").when(F.col("__there").isNull(), "deleted").when(time_changed(F.col("__old"), F.col("__new")), "changed").otherwise("same")
    return old.join(new, key, "full_outer").select(key, change.alias("change"))


def needs_rebuild(listed: DataFrame, current: DataFrame, key: str, time_col: str) -> DataFrame:
    """(key, needs_rebuild) for keys asked about: unknown, gone or of another time, unrounded."""
    both = current.select(key, F.col(time_col).alias("__now")).join(listed.select(key, F.col(time_col).alias("__then")), key, "left")
    return both.select(key, (F.col("__then").isNull() | F.col("__now").isNull() | (F.col("__then") != F.col("__now"))).alias("needs_rebuild"))


def delete_cascading(removed: DataFrame, parent: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """What is left of parent and child when the parents whose keys are in removed go."""
    gone = removed.select(F.col(parent_key).alias("__gone")).distinct()
    return parent.join(gone, F.col(parent_key) == F.col("__gone"), "left_anti"), child.join(gone, F.col(child_key) == F.col("__gone"), "left_anti")


def keep_one(rows: DataFrame, key: str, order: list[str], last: bool) -> DataFrame:
    """One row a key: the last by order (upserts) or the first (inserts that don't replace)."""
    columns = [c for c in rows.columns if c != key]
    by = F.struct(*order)
    whole = F.struct(*columns)
    chosen = (F.max_by if last else F.min_by)(whole, by).alias("__row")
    return rows.groupBy(key).agg(chosen).select(key, *(F.col("__row")[c].alias(c) for c in columns))


def replace_rows(table: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The table with all rows of fresh's keys replaced by fresh."""
    return table.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def upsert(table: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The table with rows put in by key: of several rows of a key the last by order counts. All get one time, updated_at."""
    return replace_rows(table, keep_one(rows, key, order, last=True).withColumn("updated_at", F.current_timestamp()).select(*table.columns), key)


#: Ranges of time that a scan over the rows of a key is cut into.
SEGMENTS = 64


def segmented(rows: DataFrame, time_col: str, segments: int = SEGMENTS) -> DataFrame:
    """Adds __segment, a number that grows with the time (null: the first): ranges of about as many rows each, by the quantiles
    of all rows, so that a key that holds most rows is dealt over many tasks. Rows of one time lie in one segment; where the
    cuts are doesn't change what scans return. The cuts are a bounded list."""
    at = F.unix_micros(F.col(time_col).cast("timestamp"))
    cuts = rows.agg(F.percentile_approx(at, [k / segments for k in range(1, segments)], 10_000)).first()[0] or []
    before = sum((at > F.lit(cut)).cast("int") for cut in sorted(set(cuts))) if cuts else F.lit(0)
    return rows.withColumn("__segment", F.coalesce(before, F.lit(0)))


def _carried(parts: DataFrame, key: str, value: Column) -> Column:
    """The value of the segment of a key before this one that has any rows: a row a key and segment, so a window bears it."""
    return F.lag(value).over(W.partitionBy(key).orderBy("__segment"))


def previous(rows: DataFrame, key: str, order: list[str], columns: dict[str, str], segments: int = SEGMENTS) -> DataFrame:
    """lag() over the rows of a key in order, the first of which is a time, for keys that may hold most rows: within segments
    by a window, and from the last row of the segment before for each first one. columns: what to take, and its new name;
    __first says that there is no row before."""
    cut = segmented(rows, order[0], segments)
    within = W.partitionBy(key, "__segment").orderBy(*order)
    taken = F.struct(*(F.col(c).alias(f"v{i}") for i, c in enumerate(columns)))
    cut = cut.withColumn("__before", F.lag(taken).over(within)).withColumn("__at", F.row_number().over(within))
    ordered = F.struct(*(x for c in order for x in (F.col(c).isNotNull(), F.col(c))))  # nulls come first, as in a window
    ends = cut.groupBy(key, "__segment").agg(F.max_by(taken, ordered).alias("last"))
    ends = ends.select(F.col(key).alias("__key"), F.col("__segment").alias("__of"), _carried(ends, key, F.col("last")).alias("__carried"))
    # only the first rows of segments look for what is carried
    first = cut.where("__at = 1").drop("__before").join(ends, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__segment") == F.col("__of"))).withColumn("__before", F.col("__carried")).select(*cut.columns)
    both = cut.where("__at > 1").unionByName(first)
    return both.select(*rows.columns, "__segment", F.col("__before").isNull().alias("__first"), *(F.col("__before")[f"v{i}"].alias(name) for i, name in enumerate(columns.values())))


def sessions(events: DataFrame, key: str, time_col: str, gap_seconds: float, segments: int = SEGMENTS) -> DataFrame:
    """Debounced runs of events: (key, first_ts, last_ts, n_events). A new run begins after a pause longer than the gap. Events
    of one time are counted first, so those without one are one run; runs are made within segments, and those that meet at a
    cut joined."""
    gap = int(gap_seconds * 1_000_000)
    times = events.groupBy(key, time_col).agg(F.count("*").alias("__n"))
    cut = segmented(times, time_col, segments)
    order = W.partitionBy(key, "__segment").orderBy(time_col)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    pause = micros(time_col) - F.unix_micros(F.lag(time_col).over(order).cast("timestamp"))
    numbered = cut.withColumn("__new", F.when(pause.isNull() | (pause > gap), 1).otherwise(0))
    numbered = numbered.withColumn("__run", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = numbered.groupBy(key, "__segment", "__run").agg(F.min(time_col).alias("first_ts"), F.max(time_col).alias("last_ts"), F.sum("__n").alias("n_events"), F.count("*").alias("__times"))
    # a segment's first and last run may go on over the cuts; all between are whole. Of segments with one run it is both.
    ends = numbered.groupBy(key, "__segment").agg(F.max("__run").alias("__runs"), F.min(time_col).alias("__from"), F.max(time_col).alias("__to"))
    by_segment = W.partitionBy(key).orderBy("__segment")
    joins = F.coalesce(micros("__from") - F.unix_micros(F.lag("__to").over(by_segment).cast("timestamp")) <= gap, F.lit(False))
    begun = F.col("__runs") - F.when(joins, 1).otherwise(0)  # runs that begin in the segment
    ends = ends.withColumn("__begun", begun).withColumn("__offset", F.sum("__begun").over(by_segment.rowsBetween(W.unboundedPreceding, 0)) - F.col("__runs"))
    ends = ends.select(F.col(key).alias("__key"), F.col("__segment").alias("__of"), "__offset")
    named = runs.join(ends, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__segment") == F.col("__of"))).withColumn("__run", F.col("__run") + F.col("__offset"))
    return named.groupBy(key, "__run").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n_events").alias("n_events")).drop("__run")


def head_moves(events: DataFrame, key: str, order: list[str], head_col: str) -> DataFrame:
    """Adds fired: the head differs from the one before, both being known."""
    rows = previous(events, key, order, {head_col: "__head"})
    return rows.withColumn("fired", F.coalesce(F.col("__head").isNotNull() & F.col(head_col).isNotNull() & (F.col("__head") != F.col(head_col)), F.lit(False))).select(*events.columns, "fired")


def signed_deltas(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """(keys, n): how many more rows of the keys there are after than before, where that isn't 0. Rows with a null key count
    for nothing."""
    rows = before.select(*keys, F.lit(-1).cast("long").alias("n")).unionByName(after.select(*keys, F.lit(1).cast("long").alias("n")))
    return rows.dropna().groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")


def merged_deltas(deltas: DataFrame, *keys: str) -> DataFrame:
    """Deltas of a history added up: (keys, n) of what is left."""
    return deltas.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 0")
