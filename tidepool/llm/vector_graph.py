"""Embedding near-duplicates by a robust-pruned flat graph.

Cells. Distinct vectors are dealt into overlapping cells: a cell with more than ``cell_rows`` vectors is split by centroids that one task
fits to a bounded sample of it, and a vector goes to its nearest centroid and to each other one whose bisector is within
``margin`` of it. Centroids closer than ``APART`` count as one, so a tight ball of near copies stays together; a cell that
leaves one centroid is not split by place but by hash into blocks, and every pair of blocks is a task. No task holds more
than two blocks or one cell, however many vectors are alike.

Graph. In a cell, overlapping shards each link a vector to those of its nearest neighbours that survive robust pruning (a neighbour
goes if a kept one is closer to it, by ``ALPHA``, than the vector is); the lists of all shards, and their reverses, united are one flat
graph. Search starts at the shards' medoids and the asked vector's own node, follows the nearest unread node until the ``beam`` holds
none, and from then on expands every node within range. Each met pair is verified by its cosine in double precision.

A task hands on one count and one link per vector, not pairs. A pair met in several cells counts in the first cell that both share.
``audit`` compares counts of sampled vectors with brute force over all vectors; ``groups`` searches again more widely while recall
is too low.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; equal vectors are one
node with a number of copies; vectors of different lengths never link; a null vec_id takes part, and a component of such rows only has no
id; repeated ids are rows of their own; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import let, small_batches
from tidepool.llm.simhash import components
from tidepool.session import stage_table

THRESHOLD = 0.95
CELL_ROWS = 4096
#: Distance from a bisector within which a vector lies in both cells.
MARGIN = 0.05
#: Least distance of two centroids.
APART = 0.5
#: Vectors to which centroids are fitted, and most centroids of a split.
FIT_ROWS = 8192
MOST_CENTROIDS = 256
SHARD_ROWS = 512
#: Neighbours before and after pruning, the pruning factor, and the list of the greedy search.
CANDIDATES = 32
DEGREE = 16
ALPHA = 1.2
BEAM = 8
#: Vectors whose counts are checked by brute force, and the recall that they must show.
AUDIT_ROWS = 256
LEAST_RECALL = 0.95
#: Stands for no cell.
NO_CELL = -1
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Vectors asked together: bounds the table of seen nodes.
ASKED_ROWS = 512


# --- distinct vectors -------------------------------------------------------------------------------


def prepared(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, h1, h2, unit): two hashes of the vector and its unit vector, null where it links with nothing."""
    # adding zero turns a negative zero into zero, so that equal vectors hash alike
    vec = F.transform(F.col(f"`{embedding}`").cast("array<double>"), lambda x: x + F.lit(0.0))
    largest = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (largest > 0)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), vec.alias("v"))
    rows = rows.withColumn("v", F.when(sound, F.col("v")))
    # scaled first, so that squares neither overflow nor vanish
    scaled = let(largest, lambda m: F.transform("v", lambda x: x / m))
    norm = lambda s: F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, x: a + x * x))
    unit = let(scaled, lambda s: let(norm(s), lambda n: F.transform(s, lambda x: x / n)))
    return rows.select(
        "vec_id", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"),
        F.when(F.col("v").isNotNull(), unit).alias("unit"),
    )


def nodes_of(rows: DataFrame) -> DataFrame:
    """(node, h1, h2, unit, copies, least) of each distinct vector that can link."""
    alike = rows.where("h1 IS NOT NULL").groupBy("h1", "h2")
    found = alike.agg(F.first("unit").alias("unit"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    return found.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "unit", "copies", "least")


# --- cells ------------------------------------------------------------------------------------------


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most ``k`` unit centroids of unit vectors, no two closer than APART."""
    centers = x[np.random.default_rng(len(x)).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centers)
    kept: list[np.ndarray] = []
    for c in centers:
        if all(np.linalg.norm(c - d) >= APART for d in kept):
            kept.append(c)
    return np.array(kept)


def cells_near(x: np.ndarray, centers: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, centroid): the nearest centroid of each row and those whose bisector is within ``margin``."""
    found = x @ centers.T
    best = found.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * centers @ centers.T))
    return np.nonzero(found[np.arange(len(x)), best][:, None] - found <= margin * apart[best])


def _matrix(column) -> np.ndarray:
    """A batch of equal-length lists as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _child(cell: int, which: np.ndarray) -> np.ndarray:
    """Names of the parts of a cell: 62 mixed bits, so that parts of different cells differ."""
    mixed = (np.uint64(cell) ^ np.uint64(0x5851F42D4C957F2D)) * MIX + which.astype(np.uint64) + np.uint64(1)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX
    return (mixed >> np.uint64(2)).astype(np.int64)


def _split(rows: DataFrame, sizes: DataFrame, margin: float, cell_rows: int, number: int) -> DataFrame:
    """``rows`` (node, cell, unit) of large cells in their new cells; a cell that cannot be split keeps its name and is ``whole``.

    Rows of a cell are dealt over tasks by hash, and each of these parts starts with the cell's centroids.
    """
    sample = rows.join(sizes, "cell").where(F.pmod(F.xxhash64("node", F.lit(number)), F.lit(1 << 30)) < F.lit(float(FIT_ROWS << 30)) / F.col("count"))

    def fit(frame):
        import pandas as pd

        x = np.stack(frame["unit"].to_numpy())
        wanted = min(MOST_CENTROIDS, max(2, int(4 * frame["count"].iloc[0] // cell_rows)))
        centers = fit_centroids(x, wanted)
        return pd.DataFrame({"cell": frame["cell"].iloc[:1], "centers": [centers.ravel().tolist()]})

    fitted = stage_table(sample.select("cell", "unit", "count").groupBy("cell").applyInPandas(fit, "cell long, centers array<double>"), "centroids")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("count") / (4 * cell_rows))).cast("int")
    data = rows.join(sizes, "cell").select("cell", part.alias("part"), "node", "unit", F.lit(None).cast("array<double>").alias("centers"))
    parts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("count") / (4 * cell_rows)).cast("int") - 1))
    heads = fitted.join(sizes, "cell").select("cell", parts.alias("part"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("array<double>").alias("unit"), "centers")
    # a null node comes first
    dealt = data.unionByName(heads).repartition("cell", "part").sortWithinPartitions("cell", "part", "node")

    def assign(batches):
        cell, centers = 0, np.zeros((0, 0))
        for batch in batches:
            heads = np.flatnonzero(batch.column(1).is_null().to_numpy(zero_copy_only=False)).tolist()
            for a, b in zip([-1, *heads], [*heads, batch.num_rows], strict=True):
                if a >= 0:
                    cell, centers = batch.column(0)[a].as_py(), np.array(batch.column(3)[a].as_py())
                members = batch.slice(a + 1, b - a - 1)
                if not members.num_rows:
                    continue
                x = _matrix(members.column(2))
                c = centers.reshape(-1, x.shape[1])
                row, which = cells_near(x, c, margin)
                names = np.full(len(row), cell) if len(c) < 2 else _child(cell, which)
                taken = members.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [taken.column(1), pa.array(names), taken.column(2), pa.array(np.full(len(row), len(c) < 2))], ["node", "cell", "unit", "whole"]
                )

    return dealt.select("cell", "node", "unit", "centers").mapInArrow(assign, "node long, cell long, unit array<double>, whole boolean")


def cells(nodes: DataFrame, cell_rows: int = CELL_ROWS, margin: float = MARGIN) -> DataFrame:
    """(node, cell, unit, whole): every node in its overlapping cells; the first cells are the lengths of the vectors."""
    open_rows = nodes.select("node", F.size("unit").cast("long").alias("cell"), "unit", F.lit(False).alias("whole"))
    done, number = [], 0
    while True:
        sizes = stage_table(open_rows.where("NOT whole").groupBy("cell").count().where(F.col("count") > cell_rows), "large-cells")
        if sizes.isEmpty():
            break
        done.append(open_rows.join(sizes.select("cell", F.lit(False).alias("whole")), ["cell", "whole"], "left_anti").select(*open_rows.columns))
        open_rows = stage_table(_split(open_rows.where("NOT whole").drop("whole"), sizes, margin, cell_rows, number), "cells")
        number += 1
    for rows in done:
        open_rows = open_rows.unionByName(rows)
    return open_rows


# --- one cell ---------------------------------------------------------------------------------------


def robust_lists(x: np.ndarray) -> np.ndarray:
    """Pruned neighbour lists of unit vectors, by position, -1 where there are fewer."""
    n, k = len(x), min(CANDIDATES, len(x) - 1)
    if k < 1:
        return np.full((n, 1), -1)
    alike = x @ x.T
    np.fill_diagonal(alike, -2)
    near = np.argpartition(-alike, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(alike, near, 1), axis=1, kind="stable"), 1)
    own = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(alike, near, 1)))
    between = np.sqrt(np.maximum(0, 2 - 2 * alike[near[:, :, None], near[:, None, :]]))
    alive, out = np.ones((n, k), bool), np.full((n, DEGREE), -1)
    for d in range(min(DEGREE, k)):
        some = alive.any(axis=1)
        first = alive.argmax(axis=1)
        out[some, d] = near[some, first[some]]
        # a neighbour that is closer to the kept one than to the vector, by ALPHA, is reached through it
        alive &= ALPHA * between[np.arange(n), first] > own
        alive[np.arange(n), first] = False
    return out


def flat_graph(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour lists united over overlapping shards, and the shards' medoids."""
    n = len(x)
    shards, medoids, lists = max(1, -(-n // SHARD_ROWS)), [], []
    centers = fit_centroids(x[:: max(1, n // 2048)], shards) if shards > 1 else x[:1]
    found = x @ centers.T
    near = np.argsort(-found, axis=1, kind="stable")[:, :2] if len(centers) > 1 else np.zeros((n, 1), int)
    for s in range(len(centers)):
        members = np.flatnonzero((near == s).any(axis=1))
        # a shard of alike vectors may be larger than meant; its parts are dealt by position
        for part in np.array_split(members, max(1, -(-len(members) // (2 * SHARD_ROWS)))):
            if not len(part):
                continue
            mean = x[part].mean(axis=0)
            medoids.append(part[(x[part] @ mean).argmax()])
            found_lists = robust_lists(x[part])
            row, at = np.nonzero(found_lists >= 0)
            lists.append(np.stack((part[row], part[found_lists[row, at]]), axis=1))
    # medoids of parts are joined to each other, so that parts dealt by position stay one graph
    medoids = np.unique(medoids)
    found_lists = robust_lists(x[medoids])
    row, at = np.nonzero(found_lists >= 0)
    lists.append(np.stack((medoids[row], medoids[found_lists[row, at]]), axis=1))
    pairs = np.concatenate(lists)
    pairs = np.unique(np.concatenate((pairs, pairs[:, ::-1])), axis=0)
    counts = np.bincount(pairs[:, 0], minlength=n)
    graph = np.full((n, max(1, counts.max(initial=0))), -1)
    graph[pairs[:, 0], np.arange(len(pairs)) - np.repeat(np.cumsum(counts) - counts, counts)] = pairs[:, 1]
    return graph, medoids


def _cosines(x: np.ndarray, asked: np.ndarray, met: np.ndarray) -> np.ndarray:
    out = np.empty(len(asked))
    for s in range(0, len(asked), 65536):
        out[s : s + 65536] = np.einsum("ij,ij->i", x[asked[s : s + 65536]], x[met[s : s + 65536]])
    return out


def range_search(x: np.ndarray, graph: np.ndarray, medoids: np.ndarray, asked: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(asked position, node) of every met pair with cosine of at least ``threshold``, other than a node with itself."""
    n, q = len(x), len(asked)
    seen, wide = np.zeros((q, n), bool), graph.shape[1]
    seen[:, medoids] = True
    seen[np.arange(q), asked] = True
    begin = x[asked] @ x[medoids].T
    keep = min(beam, len(medoids))
    top = np.argsort(-begin, axis=1, kind="stable")[:, :keep]
    nodes = np.concatenate((asked[:, None], medoids[top], np.full((q, beam), -1)), axis=1)[:, : beam + 1]
    values = np.concatenate((np.ones((q, 1)), np.take_along_axis(begin, top, 1), np.full((q, beam), -2.0)), axis=1)[:, : beam + 1]
    unread = nodes >= 0
    in_range = [np.stack((np.arange(q), asked))]
    r, m = np.nonzero(begin >= threshold)
    in_range.append(np.stack((r, medoids[m])))
    while True:
        rows = np.flatnonzero(unread.any(axis=1))
        if not len(rows):
            break
        first = np.where(unread[rows], values[rows], -3).argmax(axis=1)
        unread[rows, first] = False
        near = graph[nodes[rows, first]]
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        r, c = np.nonzero(fresh)
        near_value = np.full((len(rows), wide), -2.0)
        near_value[r, c] = _cosines(x, asked[rows[r]], near[r, c])
        seen[rows[r], near[r, c]] = True
        hit_r, hit_c = np.nonzero(near_value >= threshold)
        in_range.append(np.stack((rows[hit_r], near[hit_r, hit_c])))
        all_nodes = np.concatenate((nodes[rows], near), axis=1)
        all_values = np.concatenate((values[rows], near_value), axis=1)
        all_unread = np.concatenate((unread[rows], fresh), axis=1)
        best = np.argsort(-all_values, axis=1, kind="stable")[:, : beam + 1]
        nodes[rows] = np.take_along_axis(all_nodes, best, 1)
        values[rows] = np.take_along_axis(all_values, best, 1)
        unread[rows] = np.take_along_axis(all_unread, best, 1) & (values[rows] > -2)
    # every node in range is expanded, so that the range is left only where no link leads on
    found = np.concatenate(in_range, axis=1)
    frontier = found
    while frontier.shape[1]:
        grown = []
        for s in range(0, frontier.shape[1], 1 << 17):
            who, node = frontier[:, s : s + (1 << 17)]
            near = graph[node]
            flat = np.unique((who[:, None] * n + near)[near >= 0])
            flat = flat[~seen.ravel()[flat]]
            seen.ravel()[flat] = True
            who, node = flat // n, flat % n
            fits = _cosines(x, asked[who], node) >= threshold
            grown.append(np.stack((who[fits], node[fits])))
        frontier = np.concatenate(grown, axis=1)
        found = np.concatenate((found, frontier), axis=1)
    return found[:, asked[found[0]] != found[1]]


def _least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that each position reaches through links (i, j) given both ways."""
    label = np.arange(n)
    while True:
        after = label.copy()
        np.minimum.at(after, i, label[j])
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _search_cell(x, node, copies, homes, block, cell, blocks, threshold, beam):
    """Rows (u, v, n) of one cell or pair of blocks: counts have no v, links no n."""
    graph, medoids = flat_graph(x)
    counts, links_i, links_j = np.zeros(len(x), np.int64), [], []
    for start in range(0, len(x), ASKED_ROWS):
        asked = np.arange(start, min(len(x), start + ASKED_ROWS))
        who, met = range_search(x, graph, medoids, asked, threshold, beam)
        i, j = asked[who], met
        if blocks:
            # a pair of different blocks is this task's own, one within a block belongs to the task of that block alone
            fits = block[i] != block[j] if blocks[0] != blocks[1] else np.ones(len(i), bool)
            i, j = i[fits], j[fits]
        links_i.append(i)
        links_j.append(j)
        for s in range(0, len(i), 65536):
            a, b = homes[i[s : s + 65536]], homes[j[s : s + 65536]]
            shared = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] != NO_CELL)).any(axis=2)
            first = np.where(shared, a, np.iinfo(np.int64).max).min(axis=1)
            own = first == cell
            np.add.at(counts, i[s : s + 65536][own], copies[j[s : s + 65536][own]])
    i, j = np.concatenate(links_i), np.concatenate(links_j)
    label = _least_reached(len(x), np.concatenate((i, j)), np.concatenate((j, i)))
    joined = np.flatnonzero(label != np.arange(len(x)))
    some = np.flatnonzero(counts)
    u = np.concatenate((node[some], node[joined]))
    v = pa.array(np.concatenate((np.zeros(len(some), np.int64), node[label[joined]])), mask=np.arange(len(u)) < len(some))
    return pa.RecordBatch.from_arrays([pa.array(u), v, pa.array(np.concatenate((counts[some], np.zeros(len(joined), np.int64))))], ["u", "v", "n"])


def search(placed: DataFrame, threshold: float = THRESHOLD, beam: int = BEAM, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Rows (u, v, n) for rows (node, cell, unit, copies, homes): n links of node u found here, or a link of u and v."""
    sizes = placed.groupBy("cell").count().where(F.col("count") > cell_rows)
    sizes = stage_table(sizes.select("cell", F.ceil(F.col("count") / (cell_rows // 2)).cast("int").alias("parts")), "block-cells")
    marked = placed.join(sizes, "cell", "left")
    block = F.when(F.col("parts").isNull(), -1).otherwise(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    marked = marked.withColumn("block", block)
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    marked = marked.withColumn("other", other)
    marked = marked.select("cell", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "node", "copies", "homes", "unit")
    dealt = marked.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b")

    def run(table):
        cell, a, b = (table.column(k)[0].as_py() for k in ("cell", "a", "b"))
        homes = table.column("homes").to_pylist()
        wide = max(map(len, homes))
        homes = np.array([h + [NO_CELL] * (wide - len(h)) for h in homes], np.int64)
        take = lambda k: table.column(k).to_numpy()
        return _search_cell(_matrix(table.column("unit")), take("node"), take("copies"), homes, take("block"), cell, (a, b) if a >= 0 else (), threshold, beam)

    def all_cells(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            keys = np.stack([table.column(k).to_numpy().astype(np.int64) for k in ("cell", "a", "b")], axis=1)
            start = 0
            for end in (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist():
                yield run(table.slice(start, end - start))
                start = end
            held = table.slice(start)
        if held is not None and held.num_rows:
            yield run(held)

    return dealt.mapInArrow(all_cells, "u long, v long, n long")


# --- the whole --------------------------------------------------------------------------------------


def audit(nodes: DataFrame, counts: DataFrame, threshold: float = THRESHOLD, rows: int = AUDIT_ROWS) -> float:
    """Share of the links of ``rows`` sampled nodes, by brute force over all nodes, that ``counts`` (node, n) holds."""
    sample = nodes.orderBy(F.xxhash64("h1", F.lit(7)), "node").limit(rows).select("node", "unit").collect()
    if not sample:
        return 1.0
    by_length: dict[int, list] = {}
    for r in sample:
        by_length.setdefault(len(r.unit), []).append(r)
    asked = {d: (np.array([r.node for r in rs]), np.array([r.unit for r in rs])) for d, rs in by_length.items()}

    def brute(batches):
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            for d, (ids, x) in asked.items():
                rows = batch.filter(pa.array(lengths == d))
                if not rows.num_rows:
                    continue
                met = x @ _matrix(rows.column(1)).T >= threshold
                met &= ids[:, None] != rows.column(0).to_numpy()[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(met @ rows.column(2).to_numpy())], ["node", "truth"])

    truth = nodes.select("node", "unit", "copies").mapInArrow(brute, "node long, truth long").groupBy("node").agg(F.sum("truth").alias("truth"))
    both = truth.join(counts, "node", "left").agg(F.sum("truth").alias("t"), F.sum(F.least("truth", F.coalesce("n", F.lit(0)))).alias("f")).first()
    return both.f / both.t if both.t else 1.0


def groups(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, beam: int = BEAM,
           margin: float = MARGIN, cell_rows: int = CELL_ROWS, least_recall: float = LEAST_RECALL) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    small_batches(vectors.sparkSession)
    rows = stage_table(prepared(vectors, vec_id, embedding), "vectors")
    nodes = stage_table(nodes_of(rows), "nodes")
    while True:
        dealt = stage_table(cells(nodes, cell_rows, margin), "cells")
        homes = dealt.groupBy("node").agg(F.sort_array(F.collect_set("cell")).alias("homes")).join(nodes.select("node", "copies"), "node")
        found = stage_table(search(dealt.drop("whole").join(homes, "node"), threshold, beam, cell_rows), "found")
        counts = stage_table(found.where("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n")), "counts")
        if audit(nodes, counts, threshold) >= least_recall:
            break
        beam, margin = 2 * beam, 2 * margin
        if margin > 2:
            raise ValueError("the search does not reach the wanted recall")
    joined = components(found.where("v IS NOT NULL").select("u", "v"))
    classes = nodes.select("node", "h1", "h2", "copies", "least").join(counts, "node", "left").join(joined, "node", "left")
    classes = stage_table(classes.withColumn("component", F.coalesce("component", "node")), "classes")
    labels = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    known = classes.join(labels, "component").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.lit(True).alias("links"))
    out = rows.select("vec_id", "h1", "h2").join(known, ["h1", "h2"], "left")
    label = F.when(F.col("links"), F.col("component_id")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), label.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
