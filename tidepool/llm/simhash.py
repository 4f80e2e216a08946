"""SimHash near-duplicates through one-wildcard variants of few segments.

A fingerprint has one bit per position that is set in over half of the XXH64 values of the text's shingles.
Two fingerprints that differ in at most ``max_bits`` positions have, among ``max_bits // 2 + 1`` segments, one in which they differ
at most once. So every distinct fingerprint is indexed by each whole segment, which meets the pairs that agree there,
and by each segment with one position left out, which meets the pairs that differ just there. Rows of equal signature
are verified by their full bit distance. Links join components by alternating star contraction.

Skew: equal fingerprints are one row before the index. A signature with more than ``block_rows`` rows is cut into
blocks by hash, and each pair of blocks is compared by a task of its own, so no task holds a whole group and no link is
lost. A task hands on a spanning set of the links it verified, not all pairs.

Cases: null and empty texts, and texts of white space, have fingerprint zero, which links like any other; a text
of fewer words than a shingle is one shingle; repeated rows share a component; a null doc_id takes part and is larger
than all others, rows that share an id (or have none) are linked by their fingerprints alone; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.llm.common import small_batches, spare, whole_text
from tidepool.session import stage_table

SHINGLE_WORDS = 4
MAX_BITS = 4
HASH_SEED = 42
BLOCK_ROWS = 4096
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, words: int = SHINGLE_WORDS) -> list[bytes]:
    """Space-joined runs of words, A-Z in lower case, repeats included."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [joined[a:b] for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def fingerprint(text: str, words: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """The 64-bit SimHash of a whole text; memory is bounded by slices of its shingles."""
    parts = shingles(text, words)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(parts), 65536):
        values = np.array([xxhash.xxh64_intdigest(p, seed) for p in parts[at : at + 65536]], "<u8")
        votes += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(parts), bitorder="little") if parts else np.zeros(8, np.uint8)
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = SHINGLE_WORDS, name: str = "fp") -> DataFrame:
    """``docs`` with its fingerprint in the signed 64-bit column ``name``."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts):
        return texts.map(lambda t: fingerprint(t, words)).astype("uint64").astype("int64")

    return docs.withColumn(name, of(whole_text(text)))


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    n = max_bits // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def signatures(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(slot, value, node, fp): slot 64 + s for the whole segment s, or the position left out of its segment."""
    slots = []
    for s, (first, width) in enumerate(segments(max_bits)):
        mask = ((1 << width) - 1) << first
        for slot, kept in [(64 + s, mask), *((bit, mask & ~(1 << bit)) for bit in range(first, first + width))]:
            signed = kept - (1 << 64) if kept >> 63 else kept
            slots.append(F.struct(F.lit(slot).alias("slot"), F.col("fp").bitwiseAND(F.lit(signed)).alias("value")))
    rows = nodes.select("node", "fp", F.explode(F.array(*slots)).alias("s"))
    # the slot leaves its position free: a row takes part in it on either side
    return rows.select(F.col("s.slot").alias("slot"), F.col("s.value").alias("value"), "node", "fp")


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows with the block pair (a, b) of their signature in which they meet others."""
    sizes = rows.groupBy("slot", "value").count().where(F.col("count") > block_rows)
    hot = stage_table(sizes.select("slot", "value", F.ceil(F.col("count") / block_rows).cast("int").alias("parts")), "hot-signatures")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    joined = rows.join(hot, ["slot", "value"], "left").withColumn("own", F.when(F.col("parts").isNull(), 0).otherwise(own))
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = joined.select("slot", "value", "node", "fp", "own", other.alias("other"))
    return pairs.select("slot", "value", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "node", "fp")


def _spanning(left, right, dist_ok, label):
    """Links (i, j) that join components not joined yet; ``label`` is a union-find array."""
    links = []
    for i in left:
        near = right[dist_ok(i, right)]
        for j in near.tolist():
            a, b = i, j
            while label[a] != a:
                label[a] = label[label[a]]
                a = label[a]
            while label[b] != b:
                label[b] = label[label[b]]
                b = label[b]
            if a != b:
                label[max(a, b)] = min(a, b)
                links.append((i, j))
    return links


def _run_links(fp: np.ndarray, slot: int, max_bits: int) -> list[tuple[int, int]]:
    """A spanning set of the links inside one long run of equal signature."""
    label = np.arange(len(fp))
    near = lambda i, others: np.bitwise_count(fp[others] ^ fp[i]) <= max_bits
    if slot >= 64:
        everyone = np.arange(len(fp))
        links = []
        for i in range(len(fp) - 1):
            links += _spanning([i], everyone[i + 1 :], near, label)
        return links
    side = (fp >> np.uint64(slot)) & np.uint64(1)
    return _spanning(np.flatnonzero(side == 0).tolist(), np.flatnonzero(side == 1), near, label)


def _verify(max_bits: int, short: int = 48):
    """For sorted batches of signature rows: the links between nodes, a spanning set of each long run."""

    def links_of(slot, value, a, b, node, fp):
        key_changes = (slot[1:] != slot[:-1]) | (value[1:] != value[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        starts = np.concatenate(([0], np.flatnonzero(key_changes) + 1))
        sizes = np.diff(np.concatenate((starts, [len(slot)])))
        out = []
        run = np.repeat(np.arange(len(starts)), sizes)
        brief = sizes <= short
        few = np.flatnonzero(brief[run] & (sizes[run] > 1))
        for gap in range(1, min(short, int(sizes[brief].max(initial=1)))):
            i = few[few + gap < len(slot)]
            i = i[run[i] == run[i + gap]]
            if not len(i):
                break
            differ = fp[i] ^ fp[i + gap]
            bit = np.minimum(slot[i], 63).astype(np.uint64)
            fits = (np.bitwise_count(differ) <= max_bits) & ((slot[i] >= 64) | ((differ >> bit) & np.uint64(1) == 1))
            out.append(np.stack((node[i[fits]], node[i[fits] + gap]), axis=1))
        for r in np.flatnonzero(~brief):
            at = slice(starts[r], starts[r] + sizes[r])
            pairs = np.array(_run_links(fp[at], int(slot[starts[r]]), max_bits), np.int64).reshape(-1, 2)
            out.append(node[at][pairs])
        found = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return np.unique(np.sort(found, axis=1), axis=0)

    def verify(batches):
        held = None
        names = ("slot", "value", "a", "b", "node", "fp")
        for batch in batches:
            now = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            last = np.ones(len(now[0]), bool)
            for column in now[:4]:
                last &= column == column[-1]
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            held = [x[cut:] for x in now]
            if cut:
                found = links_of(*[x[:cut] for x in now[:5]], now[5][:cut].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])
        if held is not None and len(held[0]):
            found = links_of(*held[:5], held[5].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])

    return verify


def links(nodes: DataFrame, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (u, v) that join all fingerprints within ``max_bits``; ``nodes`` has one row (node, fp) per fingerprint."""
    rows = _blocks(signatures(nodes, max_bits), block_rows)
    sorted_rows = rows.select("slot", "value", "a", "b", "node", "fp").repartition("slot", "value", "a", "b")
    sorted_rows = sorted_rows.sortWithinPartitions("slot", "value", "a", "b")
    return sorted_rows.mapInArrow(_verify(max_bits), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v): the smallest node reachable.

    Alternating large and small stars; each round is a written table, and a round ends in one row per link, so the work shrinks.
    """
    edges = stage_table(edges.where("u <> v").select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).distinct(), "links")
    while True:
        both = edges.select(F.col("lo").alias("n"), F.col("hi").alias("o")).union(edges.select("hi", "lo"))
        least = both.groupBy("n").agg(F.least("n", F.min("o")).alias("m"))
        large = both.where("o > n").join(least, "n").select(F.col("m").alias("lo"), F.col("o").alias("hi"))
        large = stage_table(large.where("lo <> hi").distinct(), "large-star")
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi")
        small = small.select(F.col("m").alias("a"), F.explode(F.array("hi", "lo")).alias("b")).where("a <> b")
        after = stage_table(small.select(F.col("a").alias("lo"), F.col("b").alias("hi")).distinct(), "small-star")
        moved = after.join(edges, ["lo", "hi"], "left_anti").union(edges.join(after, ["lo", "hi"], "left_anti"))
        if moved.isEmpty():
            return after.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        edges = after


def groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
           max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, fp."""
    rows = fingerprints(docs.select(F.col(doc).alias("doc_id"), whole_text(text).alias("t")), "t", words)
    found = _classes(stage_table(rows.select("doc_id", "fp"), "fingerprints"), max_bits, block_rows)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


#: Stands for a null doc_id among the keys of the join.
LAST = (1 << 63) - 1


def _classes(rows: DataFrame, max_bits: int, block_rows: int) -> DataFrame:
    """``rows`` with a number of their component (``class``) and its smallest doc_id; nodes are the distinct fingerprints."""
    nodes = stage_table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    joined = components(links(nodes.select(F.col("fp").alias("node"), "fp"), max_bits, block_rows))
    classes = nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left")
    classes = stage_table(classes.select("fp", "least", F.coalesce("component", "fp").alias("class")), "classes")
    # null where all ids of the component are
    labels = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    return rows.join(classes.select("fp", "class").join(labels, "class"), "fp")


def drop_near_copies(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
                     max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id.

    Rows of a component that share that doc_id are told apart by fingerprint and a hash of their text, and equal ones count as one.
    """
    name = spare(docs, "fp")
    brief = fingerprints(docs.select(F.col(doc).alias("doc_id"), whole_text(text).alias("t")), "t", words)
    brief = stage_table(brief.select("doc_id", "fp", F.xxhash64("t").alias("body")), "fingerprints")
    found = _classes(brief, max_bits, block_rows)
    stays = found.groupBy("class").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("d"), "fp", "body")).alias("best"))
    stays = stage_table(stays.select(F.col("best.d").alias(spare(docs, "stay_id")), F.col("best.body").alias(spare(docs, "stay_body"))), "stays")
    stay, body = stays.columns
    marked = docs.withColumn(name, F.coalesce(F.col(doc), F.lit(LAST)))
    kept = marked.join(stays, (F.col(name) == F.col(stay)) & (F.xxhash64(whole_text(text)) == F.col(body)))
    place = spare(kept, "place")
    # the keys of the join, so that texts are not shuffled again
    first = Window.partitionBy(stay, body).orderBy(F.col(doc).isNull())
    return kept.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).select(*[f"`{c}`" for c in docs.columns])
