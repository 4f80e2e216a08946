"""Language-model scores from a log-frequency Bloom filter.

The filter holds each word and each pair of adjacent words with its count on a logarithmic scale: a count of level q is
entered q times, under the levels 1 to q, and a lookup probes level after level until one is missing. Counts are therefore never too
low by more than a step of the scale, and too high only by the filter's error rate. The probability of a word is
``share * c(previous, word) / c(previous) + (1 - share) * base``, with the add-half base of single words; the share is the one of a fixed grid
that scores the training texts best when each pair is counted without itself.

The filter has at least ``bits_per_token`` bits for each training token, rounded up to a power of two, and as many segments as keep the n-grams of
each below ``GROUP_GRAMS``; the first bits of a hash name its segment. Neither is ever gathered: texts are read in chunks, the distinct n-grams of a chunk go
to the tasks of their segments with their counts in training rows, and such a task builds its segment, probes it for every chunk and hands back levels.
So only a chunk and a segment have a size bound, and the error rate does not rise with the corpus.

The base score uses exact counts: those of the most frequent words (at most ``HEAD_WORDS``) travel with the tasks, all other words of a document are joined.
Words are told apart by 64-bit XXH64.

Cases: null and empty texts have the end token alone; a null id counts as trained on; repeated rows are each scored and counted;
without training rows N and V are 0, every base probability is 1 and all scores are 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import small_batches, whole_text
from tidepool.session import stage_table

#: The least number of segments and of bits in one.
SEGMENTS = 256
SEGMENT_BITS = 256
BITS_PER_TOKEN = 6
HASHES = 4
#: Counts of level q are at least STEP ** (q - 1).
STEP = 1.5
LEVELS = 60
HEAD_WORDS = 1 << 21
#: N-grams of all chunks that one segment meets, on average.
GROUP_GRAMS = 2_000_000
#: Tokens of a chunk, which a text longer than that exceeds.
FLUSH_TOKENS = 2_000_000
GRID = (0.0, 0.001, 0.003, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.7)
#: Odd 64-bit constants that mix hashes, and the seed of word hashes.
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
SEED = 7
#: Hash of the end token, which no word has as it contains white space.
END = np.uint64(xxhash.xxh64_intdigest(b"\n", SEED))
#: By level: the count that it stands for.
VALUES = np.array([0, *[math.ceil(STEP ** (q - 1)) for q in range(1, LEVELS + 1)]], np.float64)


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * A
    h = (h ^ (h >> np.uint64(29))) * B
    return h ^ (h >> np.uint64(32))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * C + second)


def level_of(counts: np.ndarray) -> np.ndarray:
    """The largest level whose count is not above the given one."""
    return np.searchsorted(VALUES, counts, side="right") - 1


class Words:
    """Hashes of the words of a batch, each computed once."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hashes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts with the end token after each, and the number of tokens of each text."""
        if len(self.known) > 300_000:
            self.known.clear()
        known, out, sizes = self.known, [], []
        for text in texts:
            found = tokens(text)
            for w in found:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w, SEED)
            out.append(np.fromiter(map(known.__getitem__, found), np.uint64, len(found)))
            out.append(np.array([END]))
            sizes.append(len(found) + 1)
        return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(sizes, np.int64)


def pairs_of(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(previous, word) of each token; the first of a text follows the end of another."""
    before = np.concatenate(([END], words[:-1]))
    before[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = END
    return before, words


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return keys >> np.uint64(64 - segments.bit_length() + 1)


def places(keys: np.ndarray, level: int, size: int) -> list[np.ndarray]:
    """The HASHES positions of each key at a level within its segment of ``size`` bits."""
    inside = np.uint64(size - 1)
    one = mix(keys + np.uint64(level * int(C) % (1 << 64)))
    two = mix(one ^ B) | np.uint64(1)
    return [(one + np.uint64(i) * two) & inside for i in range(HASHES)]


def segment_bits(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The bits of a segment that holds these keys."""
    body, level = np.zeros(size, bool), level_of(counts)
    for q in range(1, int(level.max(initial=0)) + 1):
        for place in places(keys[level >= q], q, size):
            body[place] = True
    return body


def probe(body: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Levels of the keys of one segment: probes go on until one is missing."""
    level = np.zeros(len(keys), np.uint8)
    alive = np.arange(len(keys))
    for q in range(1, LEVELS + 1):
        if not len(alive):
            break
        hit = np.ones(len(alive), bool)
        for place in places(keys[alive], q, len(body)):
            hit &= body[place]
        alive = alive[hit]
        level[alive] = q
    return level


@dataclass
class Filter:
    """The table (segment, body) of all segments, their number, and the bits of all."""

    rows: DataFrame
    segments: int
    bits: int


def lookup(table: Filter, keys: np.ndarray) -> np.ndarray:
    """Levels of a few keys, on the driver; holds one segment at a time."""
    level, own = np.zeros(len(keys), np.int64), segment_of(keys, table.segments)
    for row in table.rows.toLocalIterator():
        at = np.flatnonzero(own == np.uint64(row.segment))
        if len(at):
            level[at] = probe(np.unpackbits(np.frombuffer(row.body, np.uint8), bitorder="little").view(bool), keys[at])
    return level


@dataclass
class Model:
    """Exact totals, exact counts of frequent words by sorted hash, the least count of these, and the filter if it was kept."""

    n: int
    v: int
    head: np.ndarray
    head_counts: np.ndarray
    head_least: int
    table: Filter | None = None

    def exact(self, keys: np.ndarray) -> np.ndarray:
        """Counts of frequent words, -1 for others."""
        if not len(self.head):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.head, keys), len(self.head) - 1)
        return np.where(self.head[at] == keys, self.head_counts[at], -1)


def sizes_of(n: int, most: int, bits_per_token: int = BITS_PER_TOKEN, group_grams: int = GROUP_GRAMS) -> tuple[int, int]:
    """(segments, bits) for ``n`` training tokens among at most ``most`` tokens."""
    segments = 1 << max(SEGMENTS.bit_length() - 1, math.ceil(math.log2(max(1, 2 * most / group_grams))))
    return segments, max(segments * SEGMENT_BITS, 1 << math.ceil(math.log2(max(1, n * bits_per_token))))


def chunk_keys(distinct: np.ndarray, back: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens ``distinct[back]``: the sorted n-grams, the order that sorts words and then pairs so, and each token's place among the pairs."""
    before, found = pairs_of(distinct[back], lengths)
    pairs, place = np.unique(pair_hash(before, found), return_inverse=True)
    keys = np.concatenate((mix(distinct), pairs))
    order = np.argsort(keys, kind="stable")
    return keys[order], order, place


def pack(values: np.ndarray) -> bytes:
    """Whole numbers, compressed byte plane by byte plane."""
    body = values.view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpack(data: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    body = pa.decompress(data[8:], n * width, codec="zstd", asbytes=True) if n else b""
    return np.frombuffer(body, np.uint8).reshape(width, n).T.copy().view(kind).reshape(n)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64)


def _chunks(rows: DataFrame, chunk_tokens: int) -> DataFrame:
    """From (doc_id, trained, t), a row a chunk: the sorted hashes of its words, its tokens as places among the words by falling count, and its documents.

    A written table, as chunks must not change between their uses.
    """

    def chunk(number, held):
        ids, flags, found, lengths = zip(*held, strict=True)
        distinct, back, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        rank = np.empty(len(distinct), "<u4")
        order = np.argsort(-times, kind="stable")
        rank[order] = np.arange(len(distinct))
        columns = [
            pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in (
                pack_sorted(distinct), pack(order.astype("<u4")), pack(rank[back]), pack(np.concatenate(lengths).astype("<i8")))),
            *(pa.ListArray.from_arrays(pa.array([0, sum(map(len, x))], pa.int32()), pa.concat_arrays(x)) for x in (ids, flags)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "words", "ranks", "tokens", "lengths", "ids", "trained"])

    def gather(batches):
        words, held, size, number = Words(), [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, flags, texts = (batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "trained", "t"))
            for at in range(0, len(texts), 100):
                found, lengths = words.hashes(texts.slice(at, 100).to_pylist())
                held.append((ids.slice(at, 100), flags.slice(at, 100), found, lengths))
                size += len(found)
                if size >= chunk_tokens:
                    yield chunk(number, held)
                    held, size, number = [], 0, number + 1
        if held:
            yield chunk(number, held)

    kind = rows.schema["doc_id"].dataType.simpleString()
    kinds = f"chunk long, words binary, ranks binary, tokens binary, lengths binary, ids array<{kind}>, trained array<boolean>"
    return stage_table(rows.mapInArrow(gather, kinds), "chunks")


def chunk_tokens_of(words: bytes, ranks: bytes, tokens: bytes, lengths: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted word hashes, each token's place among them, and the number of tokens of each text."""
    return unpack_sorted(words), unpack(ranks, "<u4")[unpack(tokens, "<u4")], unpack(lengths, "<i8")


def _gram_rows(segments: int):
    """For chunks: a row a segment with its n-grams and their counts in training rows."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                number, *packed, trained = [column[i].as_py() for column in batch.columns]
                distinct, back, lengths = chunk_tokens_of(*packed)
                keys, order, place = chunk_keys(distinct, back, lengths)
                own = np.repeat(np.array(trained, bool), lengths)
                counts = np.concatenate((np.bincount(back[own], minlength=len(distinct)), np.bincount(place[own], minlength=len(keys) - len(distinct))))
                counts = counts[order].astype("<u4")
                group = segment_of(keys, segments)
                first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
                ends = [*first[1:], len(group)]
                for at in range(0, len(first), 512):
                    some = list(zip(first[at : at + 512], ends[at : at + 512], strict=True))
                    yield pa.RecordBatch.from_pydict({
                        "segment": pa.array([int(group[a]) for a, _ in some], pa.int32()), "chunk": pa.array([number] * len(some), pa.int64()),
                        "keys": pa.array([pack_sorted(keys[a:b]) for a, b in some], pa.binary()),
                        "counts": pa.array([pack(counts[a:b]) for a, b in some], pa.binary()),
                    })

    return run


def _segments_of(batches):
    """By sorted rows (segment, chunk, keys, counts): the rows of each segment."""
    key, held = None, []
    for batch in batches:
        for segment, *row in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            if segment != key and held:
                yield key, held
                held = []
            key = segment
            held.append(row)
    if held:
        yield key, held


def _by_segment(size: int, keep: bool):
    """For sorted rows of segments of ``size`` bits: the body of each, or the levels of each chunk's n-grams."""

    def run(batches):
        for segment, rows in _segments_of(batches):
            parts = [unpack_sorted(k) for _, k, _ in rows]
            keys, counts = np.concatenate(parts), np.concatenate([unpack(c, "<u4") for _, _, c in rows]).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            new = np.concatenate(([True], keys[1:] != keys[:-1]))
            first = np.flatnonzero(new)
            distinct = keys[first]
            body = segment_bits(distinct, np.add.reduceat(counts, first), size)
            if keep:
                yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "body": pa.array([np.packbits(body, bitorder="little").tobytes()], pa.binary())})
                continue
            levels = np.empty(len(keys), np.uint8)
            levels[order] = probe(body, distinct)[np.cumsum(new) - 1]
            ends = np.cumsum([len(k) for k in parts]).tolist()
            for at in range(0, len(rows), 512):
                some = range(at, min(at + 512, len(rows)))
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([rows[i][0] for i in some], pa.int64()), "segment": pa.array([segment] * len(some), pa.int32()),
                    "levels": pa.array([pack(levels[ends[i - 1] if i else 0 : ends[i]]) for i in some], pa.binary()),
                })

    return run


def _spread(rows: DataFrame, key: str, then: str) -> DataFrame:
    """Rows by hash of ``key``, in tasks that are not joined by size as each byte is much work."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, key).sortWithinPartitions(key, then)


def _grams(chunks: DataFrame, segments: int) -> DataFrame:
    texts = chunks.select("chunk", "words", "ranks", "tokens", "lengths", "trained")
    return _spread(texts.mapInArrow(_gram_rows(segments), "segment int, chunk long, keys binary, counts binary"), "segment", "chunk")


def _most_tokens(texts: DataFrame) -> int:
    """No less than the tokens of the texts (column t): each but the end has a byte and white space after it."""
    return texts.agg(F.sum(F.floor((F.octet_length("t") + 1) / 2) + 1)).first()[0] or 0


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n): exact counts by signed 64-bit hash."""

    def count(batches):
        words, held, size = Words(), [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 100):
                held.append(words.hashes(texts[at : at + 100])[0])
                size += len(held[-1])
                if size >= 2 * FLUSH_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return train.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _head(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes and counts of the words with at least the least count that keeps them within ``most``."""
    sizes = counts.groupBy(F.when(F.col("n") < 1000, F.col("n")).otherwise(F.pow(10.0, F.floor(F.log10("n"))).cast("long")).alias("least"))
    least, total = 1 << 62, 0
    for row in sorted(sizes.agg(F.count("*").alias("k")).collect(), reverse=True):  # some 1,015 rows at most
        if total + row.k > most:
            break
        least, total = row.least, total + row.k
    arrow = counts.where(F.col("n") >= least).toArrow()
    keys = arrow.column("word").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], arrow.column("n").to_numpy()[order], least


def _learn(texts: DataFrame, head_words: int) -> tuple[Model, DataFrame]:
    counts = stage_table(word_counts(texts), "word-counts")
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    return Model(totals.n or 0, totals.v, *_head(counts, head_words)), counts


def train(docs: DataFrame, text: str = "text", bits_per_token: int = BITS_PER_TOKEN, head_words: int = HEAD_WORDS,
          group_grams: int = GROUP_GRAMS, chunk_tokens: int = FLUSH_TOKENS) -> tuple[Model, DataFrame]:
    """The model of all rows of ``docs`` with its filter as a written table, and the table of exact word counts."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.lit(0).alias("doc_id"), F.lit(True).alias("trained"), whole_text(text).alias("t"))
    model, counts = _learn(texts.select("t"), head_words)
    segments, bits = sizes_of(model.n, _most_tokens(texts), bits_per_token, group_grams)
    built = _grams(_chunks(texts, chunk_tokens), segments).mapInArrow(_by_segment(bits // segments, True), "segment int, body binary")
    model.table = Filter(stage_table(built, "filter"), segments, bits)
    return model, counts


def score(docs: DataFrame, trained: Column, doc: str = "doc_id", text: str = "text", bits_per_token: int = BITS_PER_TOKEN,
          head_words: int = HEAD_WORDS, group_grams: int = GROUP_GRAMS, chunk_tokens: int = FLUSH_TOKENS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows where ``trained`` holds.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model, counts = _learn(docs.where(trained).select(whole_text(text).alias("t")), head_words)
    rows = docs.select(F.col(doc).alias("doc_id"), trained.alias("trained"), whole_text(text).alias("t"))
    segments, bits = sizes_of(model.n, _most_tokens(rows), bits_per_token, group_grams)
    chunks = _chunks(rows, chunk_tokens)
    levels = _grams(chunks, segments).mapInArrow(_by_segment(bits // segments, False), "chunk long, segment int, levels binary")
    bodies = chunks.select("chunk", F.lit(-1).alias("segment"), F.lit(None).cast("binary").alias("levels"), "words", "ranks", "tokens", "lengths", "ids", "trained")
    probed = _spread(bodies.unionByName(levels, allowMissingColumns=True), "chunk", "segment")
    sent = spark.sparkContext.broadcast(model)
    fields = pa.schema([
        ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("scores", pa.list_(pa.float64())),
        ("own", pa.list_(pa.float64())), ("rare", pa.list_(pa.int64())),
    ])

    def of(batches):
        held, levels = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                segment = batch.column(1)[i].as_py()
                if segment >= 0:
                    levels.append(batch.column(2)[i].as_py())
                    continue
                if held is not None:
                    yield from chunk(held, levels)
                held, levels = [batch.column(k)[i] for k in range(3, 9)], []
        if held is not None:
            yield from chunk(held, levels)

    def chunk(held, levels):
        m, grid = sent.value, np.array(GRID)
        whole = math.log10(m.n + 0.5 * (m.v + 1))
        distinct, tokens, sizes = chunk_tokens_of(*[x.as_py() for x in held[:4]])
        ids, trained = held[4].values, held[5].values
        keys, order, place = chunk_keys(distinct, tokens, sizes)
        level = np.empty(len(keys), np.uint8)
        level[order] = np.concatenate([unpack(x, "u1") for x in levels])
        count = VALUES[level]
        every = m.exact(distinct)
        alone_of = np.where(every >= 0, every, count[: len(distinct)])
        before = np.concatenate(([0], tokens[:-1]))
        before[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = np.searchsorted(distinct, END)
        pair_of = np.minimum(count[len(distinct) :][place], np.minimum(alone_of[before], alone_of[tokens]))
        flags, stops = trained.to_pylist(), np.concatenate(([0], np.cumsum(sizes)))
        for at in range(0, len(flags), 50):
            lengths = sizes[at : at + 50]
            part = slice(stops[at], stops[at + len(lengths)])
            back, pair, context, found = tokens[part], pair_of[part], alone_of[before[part]], distinct[tokens[part]]
            ends, single = np.cumsum(lengths), alone_of
            known, base = every[back], (single[back] + 0.5) / 10**whole
            own = np.repeat(np.array(flags[at : at + 50], bool), lengths)
            share = np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0)
            left = np.divide(np.maximum(pair - 1, 0), context - 1, out=np.zeros(len(pair)), where=context > 1)
            apart = np.maximum(single[back] - 1 + 0.5, 0.5) / 10**whole
            log_base = np.where(known >= 0, np.log10(np.maximum(known, 0) + 0.5) - whole, 0.0)
            starts = ends - lengths
            scores = np.stack([np.add.reduceat(np.log10(s * share + (1 - s * (context > 0)) * base), starts) for s in grid], axis=1)
            alone = np.stack([np.add.reduceat(np.where(own, np.log10(s * left + (1 - s * (context > 1)) * apart), 0.0), starts) for s in grid], axis=1)
            rare = known < 0
            yield pa.RecordBatch.from_arrays([
                ids.slice(at, len(lengths)), trained.slice(at, len(lengths)),
                pa.array(lengths), pa.array(np.add.reduceat((known > 0).astype(np.int64), starts)),
                pa.array(np.add.reduceat(log_base, starts)), pa.array(scores.tolist(), fields.field("scores").type),
                pa.array(alone.tolist(), fields.field("own").type),
                pa.array([found[a:b][rare[a:b]].view(np.int64) for a, b in zip(starts, ends, strict=True)], fields.field("rare").type),
            ], names=["doc_id", "trained", *fields.names])

    kinds = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, trained boolean, n_tokens long, n_known long, base double"
    kinds += ", scores array<double>, own array<double>, rare array<long>"
    scored = probed.mapInArrow(of, kinds).withColumn("row", F.monotonically_increasing_id())
    scored = stage_table(scored, "scores")
    log_all = math.log10(model.n + 0.5 * (model.v + 1))
    # words that are not frequent: exact counts by an ordinary join; unknown ones have count 0
    rare = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    few = counts.where(F.col("n") < model.head_least)
    rare = rare.join(few, "word", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("n"))
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * (F.log10(F.col("n") + 0.5) - log_all)).alias("more_base"),
    )
    best = best_share(scored)
    held = scored.select("row", "doc_id", "trained", "n_tokens", "n_known", "base", F.get("scores", F.lit(best)).alias("score"))
    return held.join(rare, "row", "left").select(
        "doc_id", (~F.col("trained")).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score",
    )


def best_share(scored: DataFrame) -> int:
    """The place in GRID that scores the training texts best, each pair and word counted without itself."""
    total = scored.agg(*[F.sum(F.get("own", F.lit(i))) for i in range(len(GRID))]).first()
    return max(range(len(GRID)), key=lambda i: (total[i] or 0.0, -i))
