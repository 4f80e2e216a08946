"""Best matches by dot product: exact by streaming, approximate in a forest of random cuts.

The exact search keeps requests in a task's memory and lets candidates stream past them (``search``). The forest compares the
vectors of a leaf in tiles. Pairs exist in a task's memory, a slice at a time, and never as rows; only the best ``n`` candidates of
each request leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.scalars import angular_score
from tidepool.operators.ranking import score_order, top_n
from tidepool.operators.search import search_for
from tidepool.session import stage_table

DIGITS = 6
#: Kinds of rows, in the order in which a task reads them.
_EXCLUDED, _REQUEST, _CANDIDATE = 0, 1, 2
_SLICE_CELLS = 1 << 18  # keeps a slice of scores in the processor's cache
_EXACT_INTEGERS = 2.0**53
#: Vectors of a resident or broadcast block.
_BLOCK_BYTES = 32 << 20
#: Requests and their running lists that a task holds where both sides move.
_RESIDENT_BYTES = 128 << 20
_ENTRY_BYTES = 32
_TASKS_PER_CORE = 2
#: Up to so many requests are broadcast even if the candidates could be.
_FEW_REQUESTS = 1024
_MOST_PARTITIONS = 100_000
_BITS_PER_ROUND = 8
#: Heaviest terms by which sparse rows are put beside alike ones.
_NEIGHBOURHOOD_TERMS = 3
_SPLIT_ROUNDS = 7  # leaf paths of 7 x 8 bits fit into a bigint


def _dense(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows as a matrix; accepts dense lists and structs of index and weight lists."""
    flat = column.combine_chunks()
    if pa.types.is_struct(flat.type):
        idx, w = flat.flatten()
        matrix = np.zeros((len(flat), width))
        rows = np.repeat(np.arange(len(flat)), idx.value_lengths().to_numpy())
        matrix[rows, idx.flatten().to_numpy()] = w.flatten().to_numpy()
        return matrix
    return flat.flatten().to_numpy().reshape(len(flat), width)


def _positions(ids: pa.ChunkedArray, known: pa.ChunkedArray) -> np.ndarray:
    """Row of each id within ``known``, or -1."""
    return pc.fill_null(pc.index_in(ids, value_set=known), -1).to_numpy()


def _tile_kernel(n: int, width: int, digits: int, drop_self: bool, positive_only: bool):
    scale = 10.0**digits

    def best_of_tile(tile: pa.Table) -> pa.Table:
        kind = tile.column("kind")
        requests = tile.filter(pc.equal(kind, _REQUEST))
        candidates = tile.filter(pc.equal(kind, _CANDIDATE)).sort_by("item")
        excluded = tile.filter(pc.equal(kind, _EXCLUDED))
        keys, items = requests.column("key"), candidates.column("item")
        out_keys, out_items, out_scores = [], [], []
        if len(keys) and len(items):
            left, right = _dense(requests.column("vec"), width), _dense(candidates.column("vec"), width).T
            m, keep = right.shape[1], min(n, right.shape[1])
            skip_row, skip_col = _positions(excluded.column("key"), keys), _positions(excluded.column("item"), items)
            both = (skip_row >= 0) & (skip_col >= 0)
            skip_row, skip_col = skip_row[both], skip_col[both]
            if drop_self:
                own = _positions(keys, items)
                skip_row = np.concatenate((skip_row, np.flatnonzero(own >= 0)))
                skip_col = np.concatenate((skip_col, own[own >= 0]))
            by_row = np.argsort(skip_row, kind="stable")
            skip_row, skip_col = skip_row[by_row], skip_col[by_row]
            place = np.arange(m, dtype=np.float64)
            largest = np.sqrt((left**2).sum(axis=1).max() * (right**2).sum(axis=0).max())
            packed = (largest * scale + 1) * m < _EXACT_INTEGERS
            step = max(1, _SLICE_CELLS // m)
            for start in range(0, len(keys), step):
                scores = left[start : start + step] @ right
                order = scores * scale
                np.rint(order, out=order)
                if packed:  # one exact number per cell: rounded score, then place in id order
                    order *= m
                    order -= place
                low, high = np.searchsorted(skip_row, [start, start + len(scores)])
                order[skip_row[low:high] - start, skip_col[low:high]] = -np.inf
                if packed:
                    cols = np.argpartition(order, m - keep, axis=1)[:, m - keep :]
                else:
                    cols = np.argsort(-order, axis=1, kind="stable")[:, :keep]
                rows = np.repeat(np.arange(len(scores)), keep)
                cols = cols.ravel()
                valid = order[rows, cols] != -np.inf
                if positive_only:  # the best come first, so dropping here loses nothing
                    valid &= np.rint(scores[rows, cols] * scale) > 0
                rows, cols = rows[valid], cols[valid]
                out_keys.append(rows + start)
                out_items.append(cols)
                out_scores.append(scores[rows, cols])
        if not out_keys:
            return pa.table({"key": keys.slice(0, 0), "item": items.slice(0, 0), "score": pa.array([], pa.float64())})
        return pa.table(
            {
                "key": keys.take(pa.array(np.concatenate(out_keys))),
                "item": items.take(pa.array(np.concatenate(out_items))),
                "score": np.concatenate(out_scores),
            }
        )

    return best_of_tile


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _block(column: str, blocks: int):
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def _row_bytes(df: DataFrame, width: int, sparse: bool) -> tuple[int, float]:
    """Number of rows of ``df`` and bytes of a vector in a task's memory."""
    if not sparse:
        return df.count(), 8.0 * max(1, width)
    found = df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("vec.idx")).alias("terms")).first()
    return found.n, 16.0 * max(1.0, found.terms or 1.0)


def _arrow_block(df: DataFrame) -> bytes:
    """A table of checked size as Arrow bytes, for a broadcast."""
    table, out = df.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _as_table(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[bool, pa.Table]]:
    """Pieces of sorted batches with one value of ``column`` each, and whether a new value begins."""
    last = None
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield values[start] != last, pa.Table.from_batches([batch.slice(start, end - start)])
                last = values[start]


def best_matches(
    requests: DataFrame,
    candidates: DataFrame,
    n: int,
    width: int,
    *,
    exclude: DataFrame | None = None,
    drop_self: bool = False,
    positive_only: bool = False,
    digits: int = DIGITS,
) -> DataFrame:
    """Exact ``<key, item, score, rank>``: the ``n`` candidates with the largest dot product per request.

    ``requests<key, vec>`` and ``candidates<item, vec>`` have unique ids; ``vec`` is ``array<double>`` of
    ``width`` numbers or ``struct<idx, w>`` of non-negative weights (then ``positive_only`` is asked for). ``exclude<key, item>`` pairs are
    left out. Ranking is by score rounded to ``digits``, then by id.

    A block of requests is resident in a task while candidates stream past it, and a running list per request is all
    that leaves the task. Which side moves is decided by checked sizes:

    - candidates of at most ``_BLOCK_BYTES`` are broadcast, each request moves once, and its list is final in its task;
    - else requests of at most ``_BLOCK_BYTES`` are broadcast, candidates stay where they are, and the lists of the tasks are merged. Sparse candidates
      move to others of their neighbourhood instead, twice: first requests find a bound among them there, so that then most parts are passed by;
    - else tasks are a grid of request blocks and candidate parts: a candidate moves once per block and a request once per part. Either requests
      are dealt over all tasks and there is one part, or there are as few blocks as ``_RESIDENT_BYTES`` allows and as many parts as tasks
      need, whose lists are merged: whichever moves less. This work is requests x candidates and meant for asked items; ``vector_index`` answers all-item search.

    An excluded pair moves once, to the request (or, where requests are broadcast, to the candidate; in the grid, to the task) it belongs to.
    """
    sparse = requests.schema["vec"].dataType.typeName() == "struct"
    if sparse and not positive_only:
        raise ValueError("sparse rows are searched for positive scores only")
    how = {"digits": digits, "drop_self": drop_self, "positive_only": positive_only}
    (n_requests, request_bytes), (n_candidates, candidate_bytes) = (_row_bytes(df, width, sparse) for df in (requests, candidates))
    tasks = _TASKS_PER_CORE * requests.sparkSession.sparkContext.defaultParallelism
    if n_requests <= _FEW_REQUESTS and n_requests * request_bytes <= _BLOCK_BYTES < n_candidates * candidate_bytes:
        return _past_resident_requests(requests, candidates, n, width, exclude, sparse, digits, how, tasks)
    if n_candidates * candidate_bytes <= _BLOCK_BYTES:
        return _past_resident_candidates(requests, candidates, n, width, exclude, sparse, how, max(tasks, math.ceil(n_requests * request_bytes / _BLOCK_BYTES)))
    if n_requests * request_bytes <= _BLOCK_BYTES:
        return _past_resident_requests(requests, candidates, n, width, exclude, sparse, digits, how, tasks)
    fewest = math.ceil(n_requests * (request_bytes + _ENTRY_BYTES * n) / _RESIDENT_BYTES)
    grids = [(max(fewest, tasks), 1), (fewest, math.ceil(tasks / fewest))]
    blocks, parts = min(grids, key=lambda g: g[0] * n_candidates * candidate_bytes + g[1] * n_requests * request_bytes)
    return _past_request_blocks(requests, candidates, n, width, exclude, sparse, digits, how, blocks, parts)


def _rows_by_kind(requests: DataFrame, exclude: DataFrame | None, candidates: DataFrame) -> DataFrame:
    """Rows (kind, key, item, vec): hidden pairs, then requests."""
    key_type, item_type = _type(requests, "key"), _type(candidates, "item")
    rows = requests.select(F.lit(_REQUEST).alias("kind"), "key", F.lit(None).cast(item_type).alias("item"), "vec")
    if exclude is None:
        return rows
    no_vec = F.lit(None).cast(requests.schema["vec"].dataType).alias("vec")
    return rows.unionByName(exclude.select(F.lit(_EXCLUDED).alias("kind"), F.col("key").cast(key_type), F.col("item").cast(item_type), no_vec))


def _past_resident_candidates(requests, candidates, n, width, exclude, sparse, how, tasks) -> DataFrame:
    block = requests.sparkSession.sparkContext.broadcast(_arrow_block(candidates.select("item", "vec")))
    # a task holds as many requests as the candidates' share of memory; hidden pairs of a request are fewer than candidates
    rows = _rows_by_kind(requests, exclude, candidates).repartition(tasks, "key").sortWithinPartitions("kind")
    kind_of = search_for(sparse)

    def answer(batches):
        known, hidden, asked = _as_table(block.value), [], []
        for _, piece in runs(batches, "kind"):
            (hidden if piece.column("kind")[0].as_py() == _EXCLUDED else asked).append(piece)
        if not asked:
            return
        asked = pa.concat_tables(asked)
        search = kind_of(asked.column("key"), asked.column("vec"), width, n, **how)
        for piece in hidden:
            search.hide(piece.column("key"), piece.column("item"))
        for start in range(0, known.num_rows, search.chunk):
            some = known.slice(start, search.chunk)
            search.meet(some.column("item"), some.column("vec"))
        found = search.best()
        if found is not None:
            yield found

    return rows.mapInArrow(answer, f"key {_type(requests, 'key')}, item {_type(candidates, 'item')}, score double, rank int")


def _neighbourhood() -> Column:
    """The heaviest terms of a sparse row, heaviest first: rows that agree in them are alike."""
    by_weight = "array_sort(zip_with(vec.w, vec.idx, (w, i) -> struct(-w as w, i as i)))"
    return F.expr(f"transform(slice({by_weight}, 1, {_NEIGHBOURHOOD_TERMS}), x -> x.i)").alias("spot")


def _with_bounds(requests: DataFrame, candidates: DataFrame, n: int, width: int, how: dict, tasks: int) -> DataFrame:
    """Adds ``bound`` to sparse requests: the score of the ``n``-th best among the candidates of their neighbourhood, or null if there are fewer.

    Ranges are cut by neighbourhood, then by item, so a neighbourhood of many copies is more than one task; its requests are in its first.
    """
    key_type, item_type = _type(requests, "key"), _type(candidates, "item")
    no_key, no_item, cell = F.lit(None).cast(key_type).alias("key"), F.lit(None).cast(item_type).alias("item"), F.lit(0).alias("cell")
    asked = requests.select(cell, F.lit(_REQUEST).alias("kind"), "key", no_item, "vec", _neighbourhood())
    met = candidates.select(cell, F.lit(_CANDIDATE).alias("kind"), no_key, "item", "vec", _neighbourhood())
    rows = asked.unionByName(met).repartitionByRange(tasks, "spot", "item").sortWithinPartitions("kind").drop("spot")
    found = rows.mapInArrow(answer_groups("cell", width, n, True, how), f"key {key_type}, item {item_type}, score double, rank int")
    bounds = found.where(F.col("rank") == n).groupBy(F.col("key").alias("bounded")).agg(F.max("score").alias("bound"))
    return requests.select("key", "vec").join(bounds, F.col("key").eqNullSafe(F.col("bounded")), "left").select("key", "vec", "bound")


def _past_resident_requests(requests, candidates, n, width, exclude, sparse, digits, how, tasks) -> DataFrame:
    bounded = sparse and exclude is None
    if bounded:
        # alike candidates lie together, so a request with a bound passes most of them by
        requests = _with_bounds(requests, candidates, n, width, how, tasks)
        candidates = candidates.select("item", "vec", _neighbourhood()).repartitionByRange(tasks, "spot", "item").sortWithinPartitions("spot")
    block = requests.sparkSession.sparkContext.broadcast(_arrow_block(requests.select("key", "vec", *["bound"] * bounded)))
    key_type, item_type = _type(requests, "key"), _type(candidates, "item")
    rows = candidates.select(F.lit(_CANDIDATE).alias("kind"), F.lit(None).cast(key_type).alias("key"), "item", "vec")
    if exclude is not None:
        no_vec = F.lit(None).cast(candidates.schema["vec"].dataType).alias("vec")
        hidden = exclude.select(F.lit(_EXCLUDED).alias("kind"), F.col("key").cast(key_type), F.col("item").cast(item_type), no_vec)
        rows = rows.unionByName(hidden).repartition(tasks, "item").sortWithinPartitions("kind")
    kind_of = search_for(sparse)

    def answer(batches):
        asked = _as_table(block.value)
        search = kind_of(asked.column("key"), asked.column("vec"), width, n, **how)
        if bounded:
            search.bound(asked.column("bound"))
        for _, piece in runs(batches, "kind"):
            if piece.column("kind")[0].as_py() == _EXCLUDED:
                search.hide(piece.column("key"), piece.column("item"))
            else:
                search.offer(piece.column("item"), piece.column("vec"))
        found = search.best()
        if found is not None:
            yield found

    tops = rows.mapInArrow(answer, f"key {key_type}, item {item_type}, score double, rank int").drop("rank")
    return top_n(tops, ["key"], score_order("score", "item", digits), n)


def answer_groups(group: str, width: int, n: int, sparse: bool, how: dict):
    """For rows sorted by ``group`` and kind: the running lists of the requests of each group after its candidates have streamed past."""
    kind_of = search_for(sparse)

    def answer(batches):
        def done(search):
            found = None if search is None else search.best()
            return [] if found is None else [found]

        search, hidden, held = None, [], []
        for new, piece in runs(batches, group):
            if new:
                yield from done(search)
                search, hidden, held = None, [], []
            for _, part in runs(piece.to_batches(), "kind"):
                kind = part.column("kind")[0].as_py()
                if kind == _EXCLUDED:
                    hidden.append(part)
                elif kind == _REQUEST:
                    held.append(part)
                elif held:
                    if search is None:
                        block = pa.concat_tables(held)
                        search = kind_of(block.column("key"), block.column("vec"), width, n, **how)
                        for pairs in hidden:
                            search.hide(pairs.column("key"), pairs.column("item"))
                        hidden = []
                    search.offer(part.column("item"), part.column("vec"))
        yield from done(search)

    return answer


def _past_request_blocks(requests, candidates, n, width, exclude, sparse, digits, how, blocks, parts) -> DataFrame:
    key_type, item_type = _type(requests, "key"), _type(candidates, "item")
    no_key, no_item = F.lit(None).cast(key_type).alias("key"), F.lit(None).cast(item_type).alias("item")

    def cell(block, part):
        return (block * parts + part).cast("int").alias("cell")

    each_block, each_part = (F.explode(F.sequence(F.lit(0), F.lit(size - 1))) if size > 1 else F.lit(0) for size in (blocks, parts))
    asked = requests.select("key", "vec", each_part.alias("part")).select(
        cell(_block("key", blocks), F.col("part")), F.lit(_REQUEST).alias("kind"), "key", no_item, "vec"
    )
    met = candidates.select("item", "vec", each_block.alias("block")).select(
        cell(F.col("block"), _block("item", parts)), F.lit(_CANDIDATE).alias("kind"), no_key, "item", "vec"
    )
    rows = asked.unionByName(met)
    if exclude is not None:
        pairs = exclude.select(F.col("key").cast(key_type), F.col("item").cast(item_type))
        no_vec = F.lit(None).cast(requests.schema["vec"].dataType).alias("vec")
        rows = rows.unionByName(pairs.select(cell(_block("key", blocks), _block("item", parts)), F.lit(_EXCLUDED).alias("kind"), "key", "item", no_vec))
    rows = rows.repartitionById(min(_MOST_PARTITIONS, blocks * parts), "cell").sortWithinPartitions("cell", "kind")
    found = rows.mapInArrow(answer_groups("cell", width, n, sparse, how), f"key {key_type}, item {item_type}, score double, rank int")
    return found if parts == 1 else top_n(found.drop("rank"), ["key"], score_order("score", "item", digits), n)


def copy_groups(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members<item_id, rep>`` and ``distinct<rep, vec>``: items with equal vectors share the smallest id."""
    keyed = stage_table(vectors.select("item_id", "vec", F.sha2(F.col("vec").cast("string"), 256).alias("print")), "vector-prints")
    groups = stage_table(
        keyed.groupBy("print").agg(F.min("item_id").alias("rep"), F.min_by("vec", "item_id").alias("vec")), "vector-groups"
    )
    members = keyed.select("item_id", "print").join(groups.select("print", "rep"), "print").select("item_id", "rep")
    return members, groups.select("rep", "vec")


def expand_copies(rep_lists: DataFrame, members: DataFrame, distinct: DataFrame, n: int) -> DataFrame:
    """Neighbour lists of items from neighbour lists of their groups.

    ``rep_lists<key, item, score>`` holds the ``n`` best other groups of each group. Members of one group
    tie, so only the ``n + 1`` smallest ids of a group can ever be listed, and the ``n`` best items of a
    member lie in its own group or in those ``n`` groups: nothing is lost.
    """
    heads = stage_table(top_n(members, ["rep"], [F.col("item_id").asc()], n + 1), "group-heads").select(
        F.col("rep").alias("other"), F.col("item_id").alias("neighbor_id")
    )
    own = distinct.select(
        F.col("rep"), F.col("rep").alias("other"),
        F.when(F.exists("vec", lambda x: x != 0), F.lit(1.0)).otherwise(F.lit(0.0)).alias("score"),
    )
    groups = own.unionByName(rep_lists.select(F.col("key").alias("rep"), F.col("item").alias("other"), "score"))
    listed = top_n(groups.join(heads, "other"), ["rep"], score_order("score", "neighbor_id"), n + 1)
    listed = stage_table(listed.select("rep", "neighbor_id", "score"), "group-lists")
    answers = stage_table(members, "group-members").join(listed, "rep").where("item_id <> neighbor_id")
    return top_n(answers.select("item_id", "neighbor_id", "score"), ["item_id"], score_order("score", "neighbor_id"), n)


def knn_exact(vectors: DataFrame, n: int, width: int, requests: DataFrame | None = None, positive_only: bool = False) -> DataFrame:
    """``<item_id, neighbor_id, score, rank>`` by cosine; ``vectors<item_id, vec>`` are unit rows.

    ``requests<item_id>`` limits whose neighbours are searched. There is no similarity floor unless
    ``positive_only``; a zero vector has cosine 0 with everything.
    """
    asked = vectors if requests is None else vectors.join(requests.select("item_id").distinct(), "item_id", "left_semi")
    found = best_matches(
        asked.select(F.col("item_id").alias("key"), "vec"),
        vectors.select(F.col("item_id").alias("item"), "vec"),
        n, width, drop_self=True, positive_only=positive_only,
    )
    return found.select(F.col("key").alias("item_id"), F.col("item").alias("neighbor_id"), "score", "rank")


def _projections(rows: DataFrame, directions: np.ndarray) -> DataFrame:
    """Adds ``p``, the products of ``vec`` with the directions of the row's tree, and drops ``vec``."""
    shared = rows.sparkSession.sparkContext.broadcast(directions)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_tree = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors = batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, -1)
            trees = batch.column("tree").to_numpy()
            products = np.empty((batch.num_rows, _BITS_PER_ROUND))
            for tree in np.unique(trees):
                products[trees == tree] = vectors[trees == tree] @ of_tree[tree]
            offsets = pa.array(np.arange(0, products.size + 1, _BITS_PER_ROUND, dtype=np.int32))
            p = pa.ListArray.from_arrays(offsets, pa.array(products.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("rep", "tree", "leaf", "need")] + [p], ["rep", "tree", "leaf", "need", "p"])

    schema = f"rep {_type(rows, 'rep')}, tree int, leaf bigint, need int, p array<double>"
    return rows.select("rep", "tree", "leaf", "need", "vec").mapInArrow(project, schema)


def _grow_forest(distinct: DataFrame, n_reps: int, width: int, trees: int, leaf_rows: int, seed: int) -> DataFrame:
    """``<rep, tree, depth, leaf, parts>``: the leaf of every vector in every tree.

    A round splits each leaf that is too full by as many bits as its size asks for (at most 8). A bit is
    the side of a random hyperplane through the mean of that leaf, so a dense cluster, wherever it lies,
    is halved like anything else. All leaves and trees of a round are split in one job; rows whose leaf
    is small enough take no part in later rounds. What is still too full after the last round is cut
    into ``parts`` blocks that the search pairs up in tiles.
    """
    each_tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    rows = distinct.select("rep", each_tree.alias("tree"), F.lit(0).cast("long").alias("leaf"))
    grown: list[DataFrame] = []

    def settled(df: DataFrame, depth: int) -> DataFrame:
        parts = F.ceil(F.col("size") / F.lit(4 * leaf_rows)).cast("int").alias("parts")
        return df.select("rep", "tree", F.lit(depth).alias("depth"), "leaf", parts)

    for depth in range(_SPLIT_ROUNDS + 1):
        if depth:
            sizes = rows.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("size"))
            sized = rows.join(stage_table(sizes, "leaf-sizes"), ["tree", "leaf"])
        else:
            sized = rows.withColumn("size", F.lit(n_reps))
        full = F.col("size") > 2 * leaf_rows
        if depth == _SPLIT_ROUNDS or n_reps <= 2 * leaf_rows:
            grown.append(settled(sized, depth))
            break
        if depth:
            grown.append(settled(sized.where(~full), depth))
        need = F.least(F.lit(_BITS_PER_ROUND), F.ceil(F.log2(F.col("size") / F.lit(leaf_rows))).cast("int"))
        open_rows = sized.where(full).withColumn("need", need).join(distinct, "rep")
        directions = np.random.default_rng([seed, depth]).standard_normal((trees, width, _BITS_PER_ROUND))
        projected = stage_table(_projections(open_rows, directions), "projections")
        if projected.isEmpty():
            break
        means = projected.groupBy("tree", "leaf").agg(F.array(*[F.avg(F.col("p")[i]) for i in range(_BITS_PER_ROUND)]).alias("m"))
        child = F.expr(
            f"aggregate(sequence(0, need - 1), leaf * {1 << _BITS_PER_ROUND}L, "
            "(path, i) -> path + if(p[i] > m[i], shiftleft(1L, i), 0L))"
        )
        rows = projected.join(stage_table(means, "leaf-means"), ["tree", "leaf"]).select("rep", "tree", child.alias("leaf"))
        rows = stage_table(rows, "forest-rows")
    return reduce(DataFrame.unionByName, grown)


def knn_forest(vectors: DataFrame, n: int, trees: int = 16, leaf_rows: int = 512, seed: int = 42) -> DataFrame:
    """Approximate ``<item_id, neighbor_id, score, rank>`` for dense unit rows ``vectors<item_id, vec>``.

    Every tree cuts the vectors by random hyperplanes into leaves of about ``leaf_rows``; an item is
    compared with the items it shares a leaf with in any tree, and scores are true cosines. Equal
    vectors are searched once and expanded at the end, since no hyperplane can part them. More trees
    or larger leaves raise recall.
    """
    members, distinct = copy_groups(vectors)
    n_reps = distinct.count()
    first = distinct.select(F.size("vec").alias("d")).first()
    width = first.d if first else 1
    leaves = stage_table(_grow_forest(distinct, n_reps, width, trees, leaf_rows, seed), "leaves")
    placed = leaves.join(distinct, "rep")
    rep_type = _type(distinct, "rep")
    no_rep = F.lit(None).cast(rep_type)
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cell = ["tree", "depth", "leaf"]
    req = placed.select(*cell, part.alias("rb"), each.alias("cb"), F.lit(_REQUEST).alias("kind"), F.col("rep").alias("key"), no_rep.alias("item"), "vec")
    cand = placed.select(*cell, each.alias("rb"), part.alias("cb"), F.lit(_CANDIDATE).alias("kind"), no_rep.alias("key"), F.col("rep").alias("item"), "vec")
    kernel = _tile_kernel(n, width, DIGITS, drop_self=True, positive_only=False)
    found = req.unionByName(cand).groupBy(*cell, "rb", "cb").applyInArrow(kernel, f"key {rep_type}, item {rep_type}, score double")
    best = found.groupBy("key", "item").agg(F.max("score").alias("score"))
    rep_lists = stage_table(top_n(best, ["key"], score_order("score", "item", DIGITS), n), "forest-lists")
    # A vector that met too few others in its leaves is searched exactly, so that every list is full.
    complete = rep_lists.groupBy("key").agg(F.count(F.lit(1)).alias("found")).where(F.col("found") >= min(n, n_reps - 1))
    alone = stage_table(distinct.join(complete, distinct.rep == complete.key, "left_anti"), "forest-alone")
    if n_reps > 1 and not alone.isEmpty():
        exact = best_matches(
            alone.select(F.col("rep").alias("key"), "vec"), distinct.select(F.col("rep").alias("item"), "vec"), n, width, drop_self=True
        )
        rep_lists = rep_lists.join(alone, rep_lists.key == alone.rep, "left_anti").unionByName(exact)
    return expand_copies(rep_lists, members, distinct, n)


def with_angular(neighbors: DataFrame) -> DataFrame:
    return neighbors.withColumn("angular", angular_score(F.col("score")))


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """One row ``<recall>``: share of exact neighbour pairs that the approximate lists contain."""
    pairs = approximate.select("item_id", "neighbor_id", F.lit(1).alias("hit"))
    joined = exact.select("item_id", "neighbor_id").join(pairs, ["item_id", "neighbor_id"], "left")
    return joined.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
