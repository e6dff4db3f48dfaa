"""References to records that do not exist, from signed counts.

Existence of a key is the running sum of +1/-1 deltas taken from its record versions; references are +1 deltas of the
referring rows. Keys whose references are positive while their existence is zero are orphans. The same deltas give the
judgement as of any load time, the report per table and month, and an incrementally maintained state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stands for "at no time yet": rows without a load time count as loaded after everything else.
NEVER = "9999-12-31 00:00:00"
ALWAYS = "0001-01-01 00:00:00"


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def reference_rows(segments: DataFrame) -> DataFrame:
    """(row_id, node_id, judged_at, loaded_at): every non-null element of node_refs, once per row.

    Null and empty lists give no row. A row without loaded_at is judged by all that was ever loaded.
    """
    return segments.select(
        "row_id",
        F.explode(F.array_distinct(F.filter("node_refs", lambda x: x.isNotNull()))).alias("node_id"),
        F.coalesce(F.col("loaded_at").cast("timestamp_ntz"), _ntz(NEVER)).alias("judged_at"),
        F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"),
    )


def existence_deltas(nodes: DataFrame) -> DataFrame:
    """(node_id, at, delta, seen): the signed changes of existence of each key, in load order.

    After each load the highest version so far says whether the key exists. ``delta`` is +1 when it begins to exist, -1
    when it ends, 0 on the first load of a key that arrives deleted; loads that change nothing give no row, apart from
    the first of a key. Repeated deliveries of one version count from the first, visible if any of them is; a null
    is_visible is visible, a null version the lowest, a null loaded_at never loaded; null ids are left out.
    """
    first = (
        nodes.where(F.col("osm_id").isNotNull())
        .groupBy(F.col("osm_id").alias("node_id"), F.coalesce(F.col("version").cast("long"), F.lit(-(1 << 40))).alias("version"))
        .agg(
            F.min(F.coalesce(F.col("loaded_at").cast("timestamp_ntz"), _ntz(NEVER))).alias("at"),
            F.max(F.coalesce(F.col("is_visible"), F.lit(True)).cast("int")).alias("visible"),
        )
    )
    by_time = Window.partitionBy("node_id").orderBy("at")
    # version and flag in one number: the highest version's flag is the lowest bit of the running maximum
    state = first.select("node_id", "at", (F.max(F.col("version") * 2 + F.col("visible")).over(by_time) % 2).alias("bit"))
    state = state.select("node_id", "at", F.abs("bit").cast("int").alias("exists"))
    order = Window.partitionBy("node_id").orderBy("at", "exists")
    before = F.lag("exists").over(order)
    return (
        state.withColumn("before", before)
        .where(F.col("before").isNull() | (F.col("before") != F.col("exists")))
        .select("node_id", "at", (F.col("exists") - F.coalesce("before", F.lit(0))).alias("delta"), F.col("before").isNull().alias("first"))
    )


def existence_intervals(deltas: DataFrame) -> DataFrame:
    """(node_id, from_at, to_at, state) covering all time of every known key; state is late, live or deleted."""
    order = Window.partitionBy("node_id").orderBy("at", F.col("first").desc())
    running = deltas.select(
        "node_id", "at", "first", F.sum("delta").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("n"), F.lead("at").over(order).alias("next_at")
    )
    end = F.coalesce("next_at", _ntz("9999-12-31 23:59:59"))
    now = F.struct(F.col("at").alias("from_at"), end.alias("to_at"), F.when(F.col("n") > 0, "live").otherwise("deleted").alias("state"))
    early = F.struct(_ntz(ALWAYS).alias("from_at"), F.col("at").alias("to_at"), F.lit("late").alias("state"))
    return running.select("node_id", F.explode(F.when(F.col("first"), F.array(early, now)).otherwise(F.array(now))).alias("i")).select("node_id", "i.*")


def orphan_references(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """(row_id, node_id, orphan_kind, loaded_at): references without a live record when their row was loaded.

    missing: no record of the key at all; late: all were loaded later; deleted: the highest version loaded by then is
    not visible. The join is on the key, its order sort-merge, so that adaptive execution can split a hot key's
    references; the other side has few rows a key, since it holds changes only. Empty inputs give what follows: no
    segments no rows, no nodes only missing ones.
    """
    refs = reference_rows(segments)
    known = existence_intervals(existence_deltas(nodes))
    joined = refs.join(
        known, (refs.node_id == known.node_id) & (refs.judged_at >= known.from_at) & (refs.judged_at < known.to_at), "left"
    ).select(refs.row_id, refs.node_id, F.coalesce(known.state, F.lit("missing")).alias("orphan_kind"), refs.loaded_at)
    return joined.where(F.col("orphan_kind") != "live")


def orphans_by_period(orphans: DataFrame, table: str, column: str = "loaded_at") -> DataFrame:
    """(table_name, period, orphan_kind, n_refs, n_rows): orphan references per table and month of loaded_at.

    Rows without a load time count under the period ``none``.
    """
    return (
        orphans.groupBy(F.coalesce(F.date_format(column, "yyyy-MM"), F.lit("none")).alias("period"), "orphan_kind", "row_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("period", "orphan_kind")
        .agg(F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_rows"))
        .select(F.lit(table).alias("table_name"), "period", "orphan_kind", "n_refs", "n_rows")
    )


def signed_counts(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, n_refs, n_exists): references and existence per key after all deltas."""
    refs = reference_rows(segments).groupBy("node_id").agg(F.count(F.lit(1)).alias("r"))
    live = existence_deltas(nodes).groupBy("node_id").agg(F.sum("delta").alias("e"))
    return merge_counts(
        refs.select("node_id", F.col("r").alias("n_refs"), F.lit(0).cast("long").alias("n_exists")),
        live.select("node_id", F.lit(0).cast("long").alias("n_refs"), F.col("e").cast("long").alias("n_exists")),
    )


def current_references(segments: DataFrame) -> DataFrame:
    """(segment, node_id): references of the newest row of each segment (osm_id), by edited_at, then row_id.

    A segment that is delivered again replaces its older rows, and their references end. Rows without osm_id stand for
    themselves. Rows meet by partial aggregation, so a segment with very many deliveries is no hot task.
    """
    refs = F.array_distinct(F.filter("node_refs", lambda x: x.isNotNull()))
    newest = F.max(F.struct(F.coalesce(F.col("edited_at").cast("timestamp_ntz"), _ntz(ALWAYS)).alias("edited_at"), "row_id", refs.alias("refs"))).alias("now")
    key = F.struct(F.col("osm_id").isNotNull().alias("has_id"), F.coalesce("osm_id", "row_id").alias("id"))
    return segments.groupBy(key.alias("segment")).agg(newest).select("segment", F.explode("now.refs").alias("node_id"))


def reference_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(node_id, n_refs, n_exists): signed changes of references between two states of ``current_references``.

    A reference that a replaced or removed segment no longer makes counts -1, a new one +1; unchanged keys give no row.
    To be merged into the maintained state with ``merge_counts``; of a batch both states need only hold the segments
    that it touches.
    """
    signed = before.select("node_id", F.lit(-1).alias("n")).unionAll(after.select("node_id", F.lit(1).alias("n")))
    return signed.groupBy("node_id").agg(F.sum("n").alias("n_refs")).where("n_refs <> 0").select("node_id", "n_refs", F.lit(0).cast("long").alias("n_exists"))


def live_counts(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, n_refs, n_exists): as ``signed_counts``, but only the newest row of each segment refers."""
    refs = current_references(segments)
    live = existence_deltas(nodes).groupBy("node_id").agg(F.sum("delta").alias("e"))
    return merge_counts(reference_deltas(refs.limit(0), refs), live.select("node_id", F.lit(0).cast("long").alias("n_refs"), F.col("e").cast("long").alias("n_exists")))


def merge_counts(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """The maintained state after one more batch of signed deltas (both: node_id, n_refs, n_exists).

    Sums commute, so batches may come in any order and a batch may hold a retraction before what it retracts. Keys
    whose counts are both zero leave the state.
    """
    return (
        state.unionByName(deltas)
        .groupBy("node_id")
        .agg(F.sum("n_refs").alias("n_refs"), F.sum("n_exists").alias("n_exists"))
        .where("n_refs <> 0 OR n_exists <> 0")
    )


def current_orphans(counts: DataFrame) -> DataFrame:
    """Keys with positive references and zero existence."""
    return counts.where("n_refs > 0 AND n_exists <= 0").select("node_id", "n_refs")
