"""Byte-level BPE through recursive DuckDB queries in each task.

A task cuts its texts at the pattern, gathers the words it has not met yet, and contracts them together: rows (word
position, token) join the merge table with their right neighbour, each word's leftmost pair of least rank becomes one
token, and the recursion ends when no word has a pair left. Ids of met words are kept in a bounded cache. Decoding joins
(position, id) rows with the token bytes in the order of the positions; the column's own buffer is then the text.

Words longer than ``LONG_BYTES`` would need as many rounds as they have merges; they take the same merges from a heap
instead. The files of ranks are read by Spark on the driver (under 2 MB) and travel with the tasks.

Cases: null and empty texts give no ids and empty bytes; a null id list decodes to empty bytes; an unknown id raises;
rows do not depend on each other, so repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import re
from functools import lru_cache
from itertools import chain

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import small_batches, whole_text

LONG_BYTES = 1000
#: Rows of one word take its number times this, plus their position.
STRIDE = 1024
#: Met words of a generation; the generation before it is kept too, and words met again move on.
CACHE_WORDS = 400_000
#: Words contracted by one recursive query.
QUERY_WORDS = 50_000
#: A space after other white space: there the cut at single spaces would differ from the pattern. The null marks the cuts.
UNEVEN = re.compile(r"\s |\0")

CONTRACT = f"""
WITH RECURSIVE state(k, tok, best) AS (
  SELECT k, tok, best FROM start LEFT JOIN (
    SELECT a.k // {STRIDE} AS word, min(m.merged * {STRIDE}::BIGINT + a.k % {STRIDE}) AS best
    FROM start a JOIN merges m ON m.pair = a.tok * 65536::BIGINT + a.nxt GROUP BY 1
  ) ON word = k // {STRIDE}
  UNION ALL (
    WITH moved AS MATERIALIZED (
      SELECT CASE WHEN k % {STRIDE} > best % {STRIDE} THEN k - 1 ELSE k END AS k,
             CASE WHEN k % {STRIDE} = best % {STRIDE} THEN (best // {STRIDE})::INTEGER ELSE tok END AS tok
      FROM state WHERE best IS NOT NULL AND k % {STRIDE} <> best % {STRIDE} + 1),
    ranked AS MATERIALIZED (
      SELECT a.k // {STRIDE} AS word, min(m.merged * {STRIDE}::BIGINT + a.k % {STRIDE}) AS best
      FROM moved a JOIN moved b ON b.k = a.k + 1 JOIN merges m ON m.pair = a.tok * 65536::BIGINT + b.tok GROUP BY 1)
    SELECT k, tok, best FROM moved LEFT JOIN ranked ON word = k // {STRIDE}))
SELECT k // {STRIDE} AS word, tok FROM state WHERE best IS NULL ORDER BY k
"""
DECODE = "SELECT piece FROM given LEFT JOIN vocab USING (id) ORDER BY pos"


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The rank file as bytes; a path without scheme that the driver can open is read there."""
    if "://" not in path:
        with open(path, "rb") as file:
            return file.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


class Coder:
    """Ranks, merge table and bounded word cache of one Python worker."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        if max(self.ranks.values()) >= 65536:
            raise ValueError("ranks must be below 65536")
        self.pattern = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        splits = [
            (self.ranks[token[:i]] * 65536 + self.ranks[token[i:]], rank)
            for token, rank in self.ranks.items() for i in range(1, len(token))
            if token[:i] in self.ranks and token[i:] in self.ranks
        ]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        pair, merged = zip(*splits, strict=True) if splits else ((), ())
        self._keep("merges", pair=pa.array(pair, pa.int64()), merged=pa.array(merged, pa.int32()))
        # a byte is shown as the character of its number, so that pieces can be joined as text
        self._keep("vocab", id=pa.array(self.ranks.values(), pa.int32()), piece=pa.array([t.decode("latin-1") for t in self.ranks], pa.string()))
        self.first = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)

    def _keep(self, name, **columns):
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text) if not self.pattern.groups else [m[0] for m in self.pattern.finditer(text)]

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        brief = [i for i, w in enumerate(words) if len(w) <= LONG_BYTES]
        out = [b"" if len(w) <= LONG_BYTES else self._by_heap(w) for w in words]
        for at in range(0, len(brief), QUERY_WORDS):
            some = brief[at : at + QUERY_WORDS]
            sizes = np.array([len(words[i]) for i in some])
            flat = self.first[np.frombuffer(b"".join([words[i] for i in some]), np.uint8)]
            if (flat < 0).any():
                raise ValueError("the ranks lack a single byte")
            begin = np.cumsum(sizes) - sizes
            k = np.repeat(np.arange(len(some)) * STRIDE - begin, sizes) + np.arange(len(flat))
            follows = np.append(flat[1:], -1)
            follows[np.cumsum(sizes) - 1] = -1
            self.db.register("start", pa.table({"k": k, "tok": flat, "nxt": follows}))
            got = self.db.execute(CONTRACT).fetchnumpy()
            self.db.unregister("start")
            ids = np.asarray(got["tok"]).astype("<u4")
            ends = np.searchsorted(np.asarray(got["word"]), np.arange(len(some) + 1)) * 4
            body = ids.tobytes()
            for n, i in enumerate(some):
                out[i] = body[ends[n] : ends[n + 1]]
        return out

    def _by_heap(self, word: bytes) -> bytes:
        """The same merges, leftmost least rank first, from a heap of pairs over a linked list."""
        ends = list(range(1, len(word) + 1))
        before, alive = list(range(-1, len(word) - 1)), [True] * len(word)
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and ends[i] < len(word):
                stop = ends[ends[i]]
                rank = self.ranks.get(word[i:stop])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, stop))

        for i in range(len(word)):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or ends[i] >= len(word) or ends[ends[i]] != stop:
                continue
            alive[ends[i]] = False
            ends[i] = stop
            if stop < len(word):
                before[stop] = i
            offer(before[i])
            offer(i)
        at, ids = 0, []
        while at < len(word):
            ids.append(self.ranks[word[at : ends[at]]])
            at = ends[at]
        return np.array(ids, "<u4").tobytes()

    def _unmet(self, words: set[str]) -> list[str]:
        """The words without kept ids; those of the older generation move on."""
        unmet = []
        for word in words.difference(self.cache):
            if word in self.older:
                self.cache[word] = self.older[word]
            else:
                unmet.append(word)
        return unmet

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Texts are cut at single spaces first, where the pattern always cuts; ids of cuts and of the pattern's words are kept."""
        if len(self.cache) > CACHE_WORDS:
            self.older, self.cache = self.cache, {}
        cuts = []
        for text in texts:
            if UNEVEN.search(text):
                cuts.append(self.pieces(text))
            else:
                cuts.append(text.replace(" ", "\0 ").split("\0"))
        new = self._unmet(set(chain.from_iterable(cuts)))
        parts = [self.pieces(c) for c in new]
        words = self._unmet(set(chain.from_iterable(parts)))
        self.cache.update(zip(words, self.contract([w.encode("utf-8", "surrogatepass") for w in words]), strict=True))
        for cut, some in zip(new, parts, strict=True):
            if len(some) != 1:
                self.cache[cut] = b"".join([self.cache[w] for w in some])
        return [b"".join(map(self.cache.__getitem__, cut)) for cut in cuts]

    def decode(self, lists: list[bytes]) -> list[bytes]:
        """Bytes of each list of ids."""
        ids = [np.frombuffer(x or b"", "<u4") for x in lists]
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
        self.db.register("given", pa.table({"pos": np.arange(len(flat), dtype=np.int64), "id": flat.astype(np.int32)}))
        pieces = self.db.sql(DECODE).to_arrow_table().column("piece").cast(pa.large_string())
        self.db.unregister("given")
        if pieces.null_count:
            raise ValueError("an id is not in the vocabulary")
        pieces = pa.concat_arrays(pieces.chunks) if pieces.num_chunks else pa.array([], pa.large_string())
        # the pieces lie in their order in one buffer; characters below 256 are bytes
        _, places, buffer = pieces.buffers()
        places = np.frombuffer(places, np.int64)[: len(pieces) + 1] if len(pieces) else np.zeros(1, np.int64)
        body = buffer.to_pybytes() if buffer is not None else b""
        ends = places[np.cumsum(sizes)].tolist()
        return [body[a:b].decode().encode("latin-1") for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def coder(ranks: bytes, pattern: str) -> Coder:
    """One coder per worker, so that its merge table and cache outlive a task."""
    return Coder(ranks, pattern)


def _slices(values, most: int = 2_000_000):
    """Index ranges of at most about ``most`` characters or bytes."""
    begin = size = 0
    for i, value in enumerate(values):
        size += len(value or "")
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(values):
        yield begin, len(values)


def with_ids(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with the ids of the whole text, little-endian unsigned 32-bit integers, in the binary column ``name``."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        own, values = coder(sent.value, pattern), texts.tolist()
        return pd.Series([x for a, b in _slices(values) for x in own.encode(values[a:b])], dtype=object)

    return docs.withColumn(name, encode(whole_text(text)))


def with_bytes(rows: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that ``ids`` stand for in the binary column ``name``."""
    small_batches(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("binary")
    def decode(lists: pd.Series) -> pd.Series:
        own, values = coder(sent.value, pattern), lists.tolist()
        return pd.Series([x for a, b in _slices(values) for x in own.decode(values[a:b])], dtype=object)

    return rows.withColumn(name, decode(F.col(ids)))


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 and decoded_sha256 of the decoded ids."""
    rows = with_ids(docs.select(F.col(doc).alias("doc_id"), whole_text(text).alias("t")), ranks, pattern, "t")
    rows = with_bytes(rows, ranks, pattern)
    return rows.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
