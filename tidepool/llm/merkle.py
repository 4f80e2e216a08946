"""Merkle manifest of a dataset: rank queries on merged bitmaps give each row its leaf, keyed slot arrays reduce the levels.

Coordinates. A row is one bit of its group's bitmap of integer ids. Every task ORs its bits into 64-bit words, only words that
hold a bit exist (the compressed form), and equal words of all tasks merge by ``bit_or``. A directory of popcounts lies
above: each of its blocks covers 2^16 words and sums into a block of the next layer, so four layers cover all 64-bit ids. The rank of
a row is what the directory counts before its word plus the popcount of the lower bits of its word: no leaf is sorted.

Levels. Rows of one group and one run of ``arity ** levels`` ranks fill a slot array, which one call reduces to its top node; the
tops are the rows of the next round. A group with one node left waits. The way down hands each array the siblings above it.
The groups' own roots, in the order of the groups, make the same kind of tree.

Memory is bounded by a slot array (256 nodes as built), a directory block and one row's siblings. No key holds more than that
many rows, so a group that has a third of all rows is spread like any other. The driver gets partition sizes, one largest count and
the root.

Cases: null fields hash as ``-``, an empty text as ``0:``; null ids come first in their group; rows that share an id are ordered by
their leaf (equal leaves are the same row, so their order shows nowhere) through a range shuffle of just the words in which
an id repeats; the null group comes first; an empty table gives no rows; names of further columns play no part, as only
the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.llm.common import small_batches
from tidepool.session import stage_table

ARITY = 2
#: Levels that one slot array reduces.
LEVELS = 8
#: A directory block covers two to this power entries of the layer below.
DIRECTORY_BITS = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Below every word of a 64-bit id: the word of null ids.
NULL_WORD = -(1 << 57) - 1
PATH = "array<struct<left:string,right:string>>"


def leaf_hash(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values, each as its UTF-8 byte count, a colon and its text, or ``-`` if null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and its siblings give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]).cast("binary"), 256))


def path_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def numbered(rows: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """``rows`` with their place (from 0) in the given order; rows that tie in all of it are spread over tasks, too."""
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = stage_table(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_local", local).drop("_tie"), "numbered")
    sizes = dict(dealt.groupBy("_part").count().collect())
    starts, at = [], 0
    for part in range(max(sizes, default=0) + 1):
        starts.append(at)
        at += sizes.get(part, 0)
    before = F.get(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("_part"))
    return dealt.withColumn(name, before + F.col("_local")).drop("_part", "_local")


def _directory(words: DataFrame) -> DataFrame:
    """(g, word, bits, n, before, total): rows of the group before each word, and in all."""
    layers = [words.select("g", "word", "n")]
    for layer in range(1, 4):
        up = F.shiftright("word", DIRECTORY_BITS * layer).alias("word")
        layers.append(words.groupBy("g", up).agg(F.sum("n").alias("n")))
    everything = Window.partitionBy("g")
    top = layers.pop()
    known = top.select("g", "word", (F.sum("n").over(everything.orderBy("word")) - F.col("n")).alias("before"), F.sum("n").over(everything).alias("total"))
    while layers:
        layer = layers.pop().withColumn("up", F.shiftright("word", DIRECTORY_BITS))
        own = F.sum("n").over(Window.partitionBy("g", "up").orderBy("word")) - F.col("n")
        above = known.select("g", F.col("word").alias("up"), F.col("before").alias("base"), "total")
        known = layer.withColumn("own", own).join(above, ["g", "up"]).select("g", "word", (F.col("own") + F.col("base")).alias("before"), "total")
    return known.join(words, ["g", "word"])


def coordinates(rows: DataFrame) -> DataFrame:
    """``rows`` (g, id, leaf and others) with ``index``, the place among their group's leaves, and ``m``, the number of these."""
    rows = rows.withColumn("word", F.coalesce(F.shiftright("id", 6), F.lit(NULL_WORD)))
    rows = rows.withColumn("bit", F.coalesce(F.col("id").bitwiseAND(F.lit(63)), F.lit(0)).cast("int"))
    one = F.expr("shiftleft(1L, bit)")
    words = stage_table(rows.groupBy("g", "word").agg(F.bit_or(one).alias("bits"), F.count("*").alias("n")), "words")
    directory = stage_table(_directory(words), "directory").withColumn("again", F.col("n") > F.bit_count("bits"))
    placed = rows.join(directory.drop("n"), ["g", "word"])
    lower = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, bit)")))
    names = [c for c in rows.columns if c not in ("word", "bit")]
    single = placed.where("not again").select(*names, (F.col("before") + lower).alias("index"), F.col("total").alias("m"))
    if directory.where("again").isEmpty():
        return single
    shared = numbered(placed.where("again").drop("bits", "again", "bit"), "g", "word", "id", "leaf")
    first = stage_table(shared.groupBy("g", "word").agg(F.min("position").alias("first")), "first-of-word")
    shared = shared.join(first, ["g", "word"])
    return single.unionByName(shared.select(*names, (F.col("before") + F.col("position") - F.col("first")).alias("index"), F.col("total").alias("m")))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(nodes: list[str], rest: bool, arity: int = ARITY, levels: int = LEVELS) -> list[list[str]]:
    """The levels above ``nodes``, themselves included: up to the single node if this is the group's only array, else ``levels`` of them."""
    found = [nodes]
    while len(found[-1]) > 1 if not rest else len(found) <= levels:
        below = found[-1]
        found.append([_sha("".join(below[i : i + arity])) for i in range(0, len(below), arity)])
    return found


def _arrays(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """Slot arrays (g, block, m, slots) of nodes (g, index, m, node, key)."""
    width = F.lit(arity**levels)
    slot = F.struct((F.col("index") % width).cast("int").alias("slot"), "node", "key")
    arrays = nodes.groupBy("g", F.floor(F.col("index") / width).alias("block"))
    return stage_table(arrays.agg(F.max("m").alias("m"), F.collect_list(slot).alias("slots")), "slots")


def _slots(batch: pa.RecordBatch, row: int):
    """The entries of one slot array, put into their places."""
    slots = batch.column(batch.schema.get_field_index("slots"))
    entries = slots.values.slice(slots.offsets[row].as_py(), slots.offsets[row + 1].as_py() - slots.offsets[row].as_py())
    at = entries.field("slot").to_numpy(zero_copy_only=False)
    order = np.empty(len(at), np.int64)
    order[at] = np.arange(len(at))
    return entries.take(pa.array(order))


def _tops(arrays: DataFrame, arity: int, levels: int) -> DataFrame:
    """The node that each slot array reduces to, as the nodes of the next round."""
    width = arity**levels

    def reduce(batches):
        for batch in batches:
            m = batch.column(batch.schema.get_field_index("m")).to_pylist()
            found = [
                levels_of(_slots(batch, i).field("node").to_pylist(), m[i] > width, arity, levels)[-1][0] for i in range(batch.num_rows)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("g"), batch.column("block"), pa.array([-(-x // width) for x in m], pa.int64()), pa.array(found, pa.string())],
                ["g", "index", "m", "node"],
            )

    return arrays.mapInArrow(reduce, "g string, index long, m long, node string").withColumn("key", F.lit(None).cast("string"))


def _descend(arrays: DataFrame, above: DataFrame, key: str, arity: int, levels: int) -> DataFrame:
    """(g, index, subroot, node, key, path) of every slot; ``above`` has (g, index, subroot, path) of each array."""
    width = arity**levels
    joined = arrays.join(above.withColumnRenamed("index", "block"), ["g", "block"])

    def paths(batches):
        for batch in batches:
            m, block = batch.column("m").to_pylist(), batch.column("block").to_pylist()
            g, subroot, upper = batch.column("g"), batch.column("subroot"), batch.column("path").to_pylist()
            for i in range(batch.num_rows):
                entries = _slots(batch, i)
                steps = []
                for level in levels_of(entries.field("node").to_pylist(), m[i] > width, arity, levels)[:-1]:
                    starts = [j - j % arity for j in range(len(level))]
                    steps.append([("".join(level[s:j]), "".join(level[j + 1 : s + arity])) for j, s in enumerate(starts)])
                end = [(s["left"], s["right"]) for s in upper[i]]
                flat = []
                for j in range(len(entries)):
                    at = j
                    for step in steps:
                        flat.append(step[at])
                        at //= arity
                    flat += end
                size = len(steps) + len(end)
                both = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.string())], ["left", "right"])
                path = pa.ListArray.from_arrays(pa.array(np.arange(len(entries) + 1, dtype=np.int32) * size), both)
                same = pa.array(np.full(len(entries), i))
                index = pa.array(np.arange(len(entries), dtype=np.int64) + block[i] * width)
                yield pa.RecordBatch.from_arrays(
                    [g.take(same), index, subroot.take(same), entries.field("node"), entries.field("key"), path],
                    ["g", "index", "subroot", "node", "key", "path"],
                )

    return joined.select("g", "block", "m", "slots", "subroot", "path").mapInArrow(
        paths, f"g string, index long, subroot string, node string, key {key}, path {PATH}"
    )


def _climb(nodes: DataFrame, largest: int, arity: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The slot arrays of every round and the last node of each group, for groups of at most ``largest`` nodes."""
    rounds = [_arrays(nodes, arity, levels)]
    while (largest := -(-largest // arity**levels)) > 1:
        rounds.append(_arrays(_tops(rounds[-1], arity, levels), arity, levels))
    return rounds, stage_table(_tops(rounds[-1], arity, levels), "tops")


def proofs(docs: DataFrame, fields=FIELDS, group: str = "lang", order: str = "doc_id", claim: Column | None = None,
           arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: group, id, leaf, claim, subroot, root, path.

    ``path`` lists the siblings from the leaf up, each step with those left and right of the node; ``fold`` gives the root.
    ``claim`` is any string of the row that is handed through, such as the leaf of a copy that is to be verified.
    """
    small_batches(docs.sparkSession)
    named = F.col(f"`{group}`").cast("string")
    # '-' comes before '=', so the null group is the first one
    g = F.coalesce(F.concat(F.lit("="), named), F.lit("-"))
    claim = F.lit(None).cast("string") if claim is None else claim
    leaf = leaf_hash(*[F.col(f"`{f}`") for f in fields])
    rows = docs.select(g.alias("g"), F.col(f"`{order}`").cast("long").alias("id"), leaf.alias("leaf"), claim.alias("claim"))
    nodes = coordinates(stage_table(rows, "leaves"))
    key = "struct<id:bigint,claim:string>"
    nodes = nodes.select("g", "index", "m", F.col("leaf").alias("node"), F.struct("id", "claim").alias("key"))
    first = _arrays(nodes, arity, levels)
    largest = first.agg(F.max("m")).first()[0]
    name = F.when(F.col("g") != "-", F.substr("g", F.lit(2))).alias("group")
    out = [name, "key.id", F.col("node").alias("leaf"), "key.claim", "subroot"]
    if largest is None:
        nothing = first.select("g", F.explode("slots").alias("s")).select("g", "s.key", "s.node", F.lit("").alias("subroot"))
        return nothing.select(*out, F.lit("").alias("root"), F.array().cast(PATH).alias("path"))
    rounds = [first]
    while (largest := -(-largest // arity**levels)) > 1:
        rounds.append(_arrays(_tops(rounds[-1], arity, levels), arity, levels))
    subroots = stage_table(_tops(rounds[-1], arity, levels).select("g", "node"), "subroots")
    groups = numbered(subroots, "g", name="index")
    count = groups.count()
    groups = groups.select(F.lit("").alias("g"), "index", F.lit(count).cast("long").alias("m"), "node", F.col("g").alias("key"))
    group_rounds, last = _climb(groups, count, arity, levels)
    root = last.first().node
    above = last.select("g", F.lit(0).cast("long").alias("index"), F.col("node").alias("subroot"), F.array().cast(PATH).alias("path"))
    for arrays in reversed(group_rounds):
        above = _descend(arrays, above, "string", arity, levels)
        below = stage_table(above, "group-paths")
        above = below.select("g", "index", "subroot", "path")
    above = below.select(F.col("key").alias("g"), F.lit(0).cast("long").alias("index"), F.col("node").alias("subroot"), "path")
    for arrays in reversed(rounds[1:]):
        above = stage_table(_descend(arrays, above, "string", arity, levels).select("g", "index", "subroot", "path"), "paths")
    return _descend(first, above, key, arity, levels).select(*out, F.lit(root).alias("root"), "path")


def manifest(proved: DataFrame) -> DataFrame:
    """(group, subroot, n_leaves, root) from the rows of ``proofs``."""
    return proved.groupBy("group", "subroot", "root").agg(F.count("*").alias("n_leaves"))


def verified(proved: DataFrame) -> DataFrame:
    """The rows of ``proofs`` as digests, with the root that the claim (else the leaf) folds to."""
    folded = fold(F.coalesce("claim", "leaf"), F.col("path"))
    rows = proved.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
