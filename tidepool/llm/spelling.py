"""Spelling variants: words that differ by one code point, found by recurrences on bit-sliced sets of the vocabulary.

Counts. A task counts the runs of its texts and hands on partial sums; words below ``least`` occurrences are left out after the sum.

Index. A shard of words of length m and m + 1 keeps, per position and letter, the bitset of the words that have the letter there.
A word of length m is asked against all of them at once, letter by letter: ``zero`` holds the words equal so far, ``swap``
those with one letter replaced so far, ``more`` those with one letter more, read one position further on. Each step is a few word-parallel
operations, so 64 words of the vocabulary advance together. What is left in ``swap`` among words of length m and in ``more`` among
words of length m + 1 is near. Only the bitsets of two positions exist at a time, so long words cost time but no memory.

Shards. All words of the lengths m and m + 1 are one shard until it has more than ``most`` words. Then it is cut exactly: two near words agree
in their next c letters from the left or, if not, in their last c letters, so a shard becomes shards by the one and by the
other; the second kind takes just the pairs that the first cannot see (``limit`` bounds the common prefix), so no pair counts
twice and none is lost. Cuts double in length, so a word gets few rows even where a third of all words share their beginning. A shard that cannot
be cut further holds words that differ in one or two places only, which the alphabet bounds.

A shard hands on one row per word (count and best of its near words), not pairs.

Cases: null and empty texts have no runs; the runs of a row without id stay as they are, as their hash is unknown; repeated rows count
each time; ties in the count go to the smaller word in code-point order; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import small_batches, whole_text
from tidepool.session import stage_table

#: Fixed value: letters of a run.
RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
LEAST_LETTERS = 7
LEAST_COUNT = 2
#: A word's form occurs at least this many times as often.
FORM_RATIO = 10
#: One run in so many loses a code point.
TYPO = 31
#: Words of a shard before it is cut, and bytes of one set of a batch of asked words.
MOST_WORDS = 8192
SET_BYTES = 1 << 20
#: Different words that a task counts before it hands them on.
HELD_WORDS = 200_000


def words_of(text: str, doc_id: int | None, least: int = LEAST_LETTERS, typo: int = TYPO) -> Counter:
    """Counts of the words of one text; ``typo`` 0 leaves all runs as they are."""
    found: Counter = Counter()
    head = None if doc_id is None or not typo else zlib.crc32(b"%d:" % doc_id)
    lowered: Counter = Counter()
    for run, n in Counter(RUN.findall(text)).items():
        if len(run) >= least:
            lowered[run.encode().lower()] += n
    for raw, n in lowered.items():
        word = raw.decode()
        if head is not None:
            h = zlib.crc32(raw, head)
            if h % typo == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
                if len(word) < least:
                    continue
        found[word] += n
    return found


def vocabulary(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS, count: int = LEAST_COUNT, typo: int = TYPO) -> DataFrame:
    """(word, n) of every word with at least ``least`` letters and ``count`` occurrences."""
    small_batches(docs.sparkSession)

    def counted(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in words_of(value.as_py(), doc_id, least, typo).items():
                    held[word] += n
            if len(held) > HELD_WORDS:
                yield out()
                held.clear()
        if held:
            yield out()

    rows = docs.select(F.col(f"`{doc}`").cast("long").alias("doc_id"), whole_text(text).alias("text"))
    sums = rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") >= count)


KEY = ("m", "a", "b", "limit", "key")


def _key() -> F.Column:
    """What the words of a shard share: their first a and last b letters."""
    return F.xxhash64(F.substr("word", F.lit(1), F.col("a")), F.expr("right(word, b)"))


def shards(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """Rows (m, a, b, limit, key, word, n) of each word in each of its shards; shards above ``most`` words are cut while they can be."""
    length = F.length("word")
    rows = words.select(F.explode(F.array(length - 1, length)).alias("m"), "word", "n")
    first = rows.select("m", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit((1 << 31) - 1).alias("limit"), F.lit(0).cast("long").alias("key"), "word", "n")
    open_rows, done, cut = stage_table(first, "shards"), [], 2
    while True:
        large = open_rows.groupBy(*KEY).count().where((F.col("count") > most) & (F.col("m") - F.col("a") - F.col("b") >= 2))
        large = stage_table(large.select(*KEY, F.lit(True).alias("large")), "large-shards")
        if large.isEmpty():
            break
        marked = open_rows.join(large, list(KEY), "left")
        done.append(marked.where("large IS NULL").drop("large"))
        c = F.least(F.lit(cut), F.floor((F.col("m") - F.col("a") - F.col("b")) / 2)).cast("int")
        apart = marked.where("large").withColumn("c", c)
        left = F.struct((F.col("a") + F.col("c")).alias("a"), F.col("b").alias("b"), F.col("limit").alias("limit"))
        right = F.struct(F.col("a").alias("a"), (F.col("b") + F.col("c")).alias("b"), F.least("limit", F.col("a") + F.col("c")).alias("limit"))
        parts = apart.select("m", "word", "n", F.explode(F.array(left, right)).alias("p")).select("m", "p.*", "word", "n")
        open_rows = stage_table(parts.select("m", "a", "b", "limit", _key().alias("key"), "word", "n"), "shards")
        cut *= 2
    for rows in done:
        open_rows = open_rows.unionByName(rows)
    return open_rows


def _slices(column: np.ndarray, letters: int, width: int) -> np.ndarray:
    """The bitsets of one position: a row per letter code, a bit per word."""
    bits = np.zeros((letters, width * 64), bool)
    present = np.flatnonzero(column >= 0)
    bits[column[present], present] = True
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _members(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(asked word, word) of every bit in ``sets``."""
    row, at = np.nonzero(sets)
    bits = np.unpackbits(sets[row, at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    which, bit = np.nonzero(bits)
    return row[which], at[which] * 64 + bit


def near_pairs(words: list[str], m: int, set_bytes: int = SET_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (i, j) of near words, i of length m and j of length m (both ways round) or m + 1, and the length of their common prefix."""
    size, width = len(words), -(-len(words) // 64)
    codes = np.full((size, m + 2), -1, np.int16)
    lengths = np.fromiter(map(len, words), np.int64, size)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    alphabet, flat = np.unique(flat, return_inverse=True)
    codes[np.repeat(np.arange(size), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    short = np.zeros(width * 64, bool)
    short[:size] = lengths == m
    longer = np.zeros(width * 64, bool)
    longer[:size] = lengths == m + 1
    short, longer = (np.packbits(x, bitorder="little").view(np.uint64) for x in (short, longer))
    asked = np.flatnonzero(lengths == m)
    step = max(1, set_bytes // (8 * width))
    parts = []
    if not len(asked):
        return (np.zeros(0, np.int64),) * 3
    slices: dict[int, np.ndarray] = {}
    # bitsets of all positions are kept while they are few; otherwise a batch of asked words makes them anew
    keep = (m + 2) * len(alphabet) * width * 8 <= 1 << 26
    at = lambda p: _slices(codes[:, p], len(alphabet), width)
    for start in range(0, len(asked), step):
        batch = asked[start : start + step]
        zero = np.broadcast_to(short | longer, (len(batch), width)).copy()
        swap = np.zeros_like(zero)
        more = zero & longer
        here = slices.get(0) if 0 in slices else at(0)
        for p in range(m):
            ahead = slices[p + 1] if p + 1 in slices else at(p + 1)
            if keep:
                slices[p], slices[p + 1] = here, ahead
            letter = codes[batch, p]
            same, shifted = here[letter], ahead[letter]
            swap &= same
            swap |= zero & ~same
            zero &= same
            more &= shifted
            more |= zero & longer
            here = ahead
        i, j = _members((swap & short) | (more & longer))
        parts.append((batch[i], j))
    i, j = (np.concatenate(x) for x in zip(*parts, strict=True))
    common = np.full(len(i), m, np.int64)
    for s in range(0, len(i), 4096):
        differ = codes[i[s : s + 4096], :m] != codes[j[s : s + 4096], :m]
        common[s : s + 4096] = np.where(differ.any(axis=1), differ.argmax(axis=1), m)
    return i, j, common


def _summary(words: list[str], counts: np.ndarray, m: int, limit: int):
    """Per word with near words here: it, their number, and the largest count among them with its smallest word."""
    i, j, common = near_pairs(words, m)
    fits = common < limit
    i, j = i[fits], j[fits]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    up = lengths[j] == m + 1
    i, j = np.concatenate((i, j[up])), np.concatenate((j, i[up]))
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((place[j], -counts[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate((first, [len(i)])))
    return [words[x] for x in i[first]], sizes, counts[j[first]], [words[x] for x in j[first]]


def _ask(batches):
    """Sorted rows of shards to summaries; one shard is held at a time."""
    held = None
    names = [*KEY, "word", "n"]

    def shard(table):
        if table.num_rows > 1:
            found = _summary(table.column("word").to_pylist(), table.column("n").to_numpy(), table.column("m")[0].as_py(), table.column("limit")[0].as_py())
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[0], pa.string()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64()), pa.array(found[3], pa.string())],
                ["word", "near", "best_n", "best"],
            )

    for batch in batches:
        table = pa.Table.from_batches([batch]).select(names)
        if held is not None:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        keys = np.stack([table.column(k).to_numpy().astype(np.int64) for k in KEY], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        start = 0
        for end in cuts.tolist():
            yield from shard(table.slice(start, end - start))
            start = end
        held = table.slice(start).combine_chunks()
    if held is not None:
        yield from shard(held)


def near_words(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(word, n_near, form_n, form): for each word with near words, their number and the most frequent one."""
    rows = shards(words, most)
    dealt = rows.repartition(*KEY).sortWithinPartitions(*KEY)
    found = dealt.mapInArrow(_ask, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form"))).alias("best")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): where the forms lead. Each round doubles the steps; counts grow along them, so they end."""
    known = stage_table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stage_table(known.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        known = after.select("word", "root")


def variants(docs: DataFrame, doc: str = "doc_id", text: str = "text", ratio: int = FORM_RATIO, most: int = MOST_WORDS, **counting) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    words = stage_table(vocabulary(docs, doc, text, **counting), "words")
    joined = words.join(near_words(words, most), "word", "left")
    formed = F.col("form_n") >= F.col("n") * ratio
    joined = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n"))
    joined = stage_table(joined, "formed")
    led = roots(joined.where("form IS NOT NULL"))
    return joined.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
