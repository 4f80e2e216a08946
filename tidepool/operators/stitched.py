"""Neighbouring rows of long, ordered groups, without giving a group to one task.

Rows are range-partitioned by (key, order, tie), so a key with half of all rows, even at one time, spreads over as many tasks as any other half.
Each task walks its range once and gives every row its place in its run of equal keys and the item that
follows. What a range cannot know, the rows of its first key before it and the item after its last row, comes
from one edge row per range: a prefix pass over these stitches the runs together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.session import stage_table

_ROW, _FIRST, _LAST = 0, 1, 2


@dataclass(frozen=True)
class Stitched:
    """``rows<key, value, place, next, part>``: place from 1 within the range's run, ``next`` null at its end.

    ``edges`` has one tuple per range that has rows: (part, first key, rows of it before the range, last key, last value, first value).
    """

    rows: DataFrame
    edges: list[tuple]


def _walk(batches):
    """Local places and followers; the last row of a batch waits for the next batch."""
    held = None
    first = True
    run = 0

    def out(table, kind):
        return table.set_column(table.schema.get_field_index("kind"), "kind", pa.array(np.full(table.num_rows, kind, np.int32)))

    names = ["kind", "key", "value", "place", "next", "part"]
    for batch in batches:
        if not batch.num_rows:
            continue
        key, value, part = (batch.column(batch.schema.get_field_index(n)) for n in ("key", "value", "part"))
        size = batch.num_rows
        # a null key is a key like any other
        same = np.zeros(size, bool)
        if size > 1:
            same[1:] = _equal(key.slice(1), key.slice(0, size - 1))
        if held is not None:
            same[0] = _equal(key.slice(0, 1), held.column("key").combine_chunks())[0]
        starts = np.where(same, -1, np.arange(size))
        starts = np.maximum.accumulate(starts)
        place = np.arange(size) - starts + 1
        place[starts < 0] += run - 1
        run = int(place[-1])
        following = pa.concat_arrays([value.slice(1), pa.nulls(1, value.type)])
        follows = np.append(same[1:], False)
        after = pc.if_else(pa.array(follows), following, pa.scalar(None, value.type))
        table = pa.table([pa.array(np.zeros(size, np.int32)), key, value, pa.array(place), after, part], names)
        if held is not None:
            nxt = value.slice(0, 1) if same[0] else pa.nulls(1, value.type)
            yield from held.set_column(4, "next", nxt).to_batches()
        if first:
            yield from out(table.slice(0, 1), _FIRST).to_batches()
            first = False
        held = table.slice(size - 1)
        yield from table.slice(0, size - 1).to_batches()
    if held is not None:
        yield from held.to_batches()
        yield from out(held, _LAST).to_batches()


def _equal(a: pa.Array, b: pa.Array) -> np.ndarray:
    both = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
    return both | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))


def stitch(df: DataFrame, key: str, value: str, order: list[str], ranges: int | None = None) -> Stitched:
    """Walks ``df`` in the order of ``key`` and ``order``; rows that tie in both may come in any order, so ``value`` should be in ``order``."""
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = list(dict.fromkeys([key, value, *order]))
    # written once: the tie is then the same for the sample that chooses the ranges and for every attempt of a task
    tied = stage_table(df.select(*columns).withColumn("_tie", F.monotonically_increasing_id()), "tied-rows")
    by = [key, *order, "_tie"]
    dealt = tied.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    dealt = dealt.select(F.col(key).alias("key"), F.col(value).alias("value"), F.spark_partition_id().alias("part"))
    key_type, value_type = (df.schema[c].dataType.simpleString() for c in (key, value))
    walked = dealt.mapInArrow(_walk, f"kind int, key {key_type}, value {value_type}, place bigint, next {value_type}, part int")
    walked = stage_table(walked, "walked-rows")
    ends = walked.where(F.col("kind") > _ROW).select("part", "kind", "key", "value", "place").collect()
    edges = _prefix(ends)
    return Stitched(walked.where(F.col("kind") == _ROW).drop("kind"), edges)


def _prefix(ends: list) -> list[tuple]:
    """One pass over the two ends of each range: rows of its first key that lie in earlier ranges."""
    first = {r.part: r for r in ends if r.kind == _FIRST}
    last = {r.part: r for r in ends if r.kind == _LAST}
    edges, carried, key = [], 0, None
    for part in sorted(first):
        head, tail = first[part], last[part]
        before = carried if edges and head.key == key else 0
        edges.append((part, head.key, before, tail.key, tail.value, head.value))
        # a range of one key alone hands on what came before it, too; the first row of a run has place 1
        alone = head.key == tail.key
        carried, key = tail.place + (before if alone else 0), tail.key
    return edges


def places(stitched: Stitched) -> DataFrame:
    """``<key, value, place>`` with places over whole groups."""
    rows = stitched.rows
    moved = [(part, key, before) for part, key, before, *_ in stitched.edges if before]
    if moved:
        # one row per range at most
        shift = rows.sparkSession.createDataFrame(moved, f"part int, key {rows.schema['key'].dataType.simpleString()}, before bigint")
        shift = F.broadcast(shift.withColumnRenamed("key", "shifted").withColumnRenamed("part", "shift_part"))
        on = (F.col("part") == F.col("shift_part")) & F.col("key").eqNullSafe(F.col("shifted"))
        rows = rows.join(shift, on, "left").withColumn("place", F.col("place") + F.coalesce("before", F.lit(0)))
    return rows.select("key", "value", "place")


def followers(stitched: Stitched) -> DataFrame:
    """``<cur, next>`` of every two consecutive rows of a key."""
    rows = stitched.rows
    pairs = rows.where("next IS NOT NULL").select(F.col("value").alias("cur"), "next")
    across = [
        (left[4], right[5]) for left, right in zip(stitched.edges, stitched.edges[1:])
        if left[3] == right[1] and right[5] is not None
    ]
    if across:
        kind = rows.schema["value"].dataType.simpleString()
        pairs = pairs.unionByName(rows.sparkSession.createDataFrame(across, f"cur {kind}, next {kind}"))
    return pairs
