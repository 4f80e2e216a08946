"""Token ids in Arrow IPC files of fixed-size lists.

Documents in ascending doc_id order are range-partitioned; each task encodes its range and writes one shard of two files in the
shared folder. ``<shard>.seq.arrow`` holds batches of equal-length sequences: ``ids`` and ``mask`` are fixed-size lists without nulls,
so a mapped file gives any sequence, or any run of ids, as a view of the file. Only the last sequence of a shard is padded (mask
false). ``<shard>.idx.arrow`` holds each document's place. Files are written under a name of their own attempt and only those that the
finished job lists are read, so lost executors and repeated tasks leave no trace in the result.

Cases: null and empty texts have the end id alone; repeated rows follow each other; a null doc_id comes first; an empty
table gives no shard and an empty result.
"""

from __future__ import annotations

import gc
import json
import re
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from tidepool.llm.common import small_batches, whole_text
from tidepool.session import shared_folder, stage_table

LENGTH = 2048
#: Sequences of a record batch, and words whose ids a task keeps.
BATCH_SEQUENCES = 256
CACHE_WORDS = 400_000
#: Characters encoded at once, as distinct cuts are looked up once in a group, and what a row counts for beside its text.
GROUP = 8_000_000
ROW = 64
#: A space after other white space: there the cut at single spaces would differ from the pattern. The null marks the cuts.
UNEVEN = re.compile(r" (?<=\s )|\0")
#: The same for Arrow, whose own white space is that of ASCII.
UNEVEN_LISTED = f"[{''.join(re.findall(r'\s', ''.join(map(chr, range(0x3001)))))}] |\\x00"
#: The pattern at which the library's byte-level step cuts, for texts whose characters every Unicode version classes alike.
PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9²³¹¼-¾]+| ?[^\sA-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼-¾]+|\s+(?!\S)|\s+")
PLAIN = re.compile(r"[\t-\r -~\xa0-\xff]*")
#: For Arrow: plain cuts that begin with a space and end without white space, so that the pattern cuts between any two of them.
JOINT = r"\A [\t-\r -~\x{a0}-\x{ff}]*[!-~\x{a1}-\x{ff}]\z"
#: Words in a row that the model is given.
WORDS = 200


def _shown_bytes() -> dict[int, str]:
    """The character that the byte-level step shows for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


SHOWN = _shown_bytes()
#: The same for words that nulls part.
SHOWN_PARTED = {b: c for b, c in SHOWN.items() if b}


def _binary(parts: list[bytes]) -> pa.Array:
    return _sliced(np.cumsum([0, *map(len, parts)], dtype=np.int64), b"".join(parts))


def _sliced(stops: np.ndarray, body: bytes) -> pa.Array:
    """The stretches of ``body`` between the stops."""
    return pa.Array.from_buffers(pa.large_binary(), len(stops) - 1, [None, pa.py_buffer(np.ascontiguousarray(stops)), pa.py_buffer(body)])


def _laid(parts: pa.Array, order) -> tuple[np.ndarray, memoryview]:
    """Byte strings in the order of their places, one behind the other, and where each begins and ends."""
    laid = parts.take(pa.array(order))
    _, stops, body = laid.buffers()
    return np.frombuffer(stops, np.int64, len(laid) + 1), memoryview(body or b"")


class Encoder:
    """A tokenizer with the ids of words it has met; texts are cut at single spaces, where its pattern always cuts.

    Where the definition has nothing but the byte-level step and the model, cuts of plain characters are cut at the step's pattern here and only
    words that are not met yet go to the model, already cut: the library's own cutting takes most of its time. All other cuts go to the whole tokenizer.
    Arrow cuts the texts, finds the distinct cuts and puts the ids in order, so only distinct words and cuts of other characters are looked up.
    """

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.cuts_at_spaces = '"ByteLevel"' in definition and '"use_regex": false' not in definition and '"use_regex":false' not in definition
        size = max(self.tokenizer.get_vocab().values()) + 1
        self.lengths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)])  # a character stands for a byte
        self.model = Tokenizer(self.tokenizer.model) if self._is_plain(json.loads(definition)) else None
        # ids of words, and of cuts of other characters; those of the older generation move on when they are met again
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _is_plain(self, parts: dict) -> bool:
        step, model = parts.get("pre_tokenizer") or {}, parts.get("model") or {}
        return (
            step.get("type") == "ByteLevel" and not step.get("add_prefix_space", True) and step.get("use_regex", True)
            and model.get("type") == "BPE" and not model.get("dropout") and set(SHOWN.values()) <= model.get("vocab", {}).keys()
            and not any(model.get(name) for name in ("continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
            and not any(parts.get(name) for name in ("normalizer", "truncation", "padding"))
            and all(token["special"] for token in parts.get("added_tokens") or [])
        )

    def _ids(self, texts: list) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Ids of words that were encoded in one go and end at these bytes."""
        stops = ((np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1) * self.dtype.itemsize).tolist()
        body = ids.tobytes()
        self.cache.update(zip(words, [body[a:b] for a, b in zip([0, *stops], stops)], strict=True))

    def _unmet(self, words: set[str]) -> list[str]:
        """The words without kept ids; those of the older generation move on."""
        unmet = words.difference(self.cache)
        moved = unmet.intersection(self.older)
        self.cache.update(zip(moved, map(self.older.__getitem__, moved)))
        return list(unmet - moved)

    def _learn_plain(self, words: list[str]) -> None:
        """Ids of new words of plain characters."""
        if not words:
            return
        shown = "\0".join(words).encode().decode("latin-1").translate(SHOWN_PARTED).split("\0")
        rows = [shown[at : at + WORDS] for at in range(0, len(shown), WORDS)]
        ids = [e.ids for e in self.model.encode_batch_fast(rows, is_pretokenized=True, add_special_tokens=False)]
        self._keep(words, np.array(list(chain.from_iterable(ids)), self.dtype), np.cumsum(list(map(len, shown))))

    def _learn_whole(self, cuts: list[str]) -> None:
        """Ids of new cuts by the whole tokenizer: those that begin with a space and end without one go in one text and are told apart by their bytes."""
        joint = [c for c in cuts if c[:1] == " " and not c[-1:].isspace()]
        alone = [c for c in cuts if not (c[:1] == " " and not c[-1:].isspace())]
        for cut, ids in zip(alone, self._ids(alone), strict=True):
            self.cache[cut] = ids.tobytes()
        for at in range(0, len(joint), 200):
            some = joint[at : at + 200]
            self._keep(some, self._ids(["".join(some)])[0], np.cumsum([len(c.encode()) for c in some]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Nothing here makes cycles, so the collector, which would walk the kept words again and again, waits."""
        if not self.cuts_at_spaces:
            return [ids.tobytes() for ids in self._ids(texts)]
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._joined(texts)
        finally:
            if collects:
                gc.enable()

    def _joined(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_WORDS:
            self.older, self.cache = self.cache, {}
        column = pa.array(texts, pa.large_string())
        uneven = pc.match_substring_regex(column, UNEVEN_LISTED)
        joined = iter(self._cut(column.filter(pc.invert(uneven))))
        whole = iter(self._ids(column.filter(uneven).to_pylist()))
        return [next(whole).tobytes() if u else next(joined) for u in uneven.to_pylist()]

    def _cut(self, column: pa.Array) -> list[bytes]:
        """Ids of texts that are cut at single spaces."""
        if not len(column):
            return []
        cuts = pc.split_pattern(pc.replace_substring(column, " ", "\0 "), "\0")
        coded = cuts.flatten().dictionary_encode()
        ids, place = self._of_cuts(coded.dictionary)
        stops, body = _laid(ids, place[coded.indices.to_numpy()])
        stops = stops[cuts.offsets.to_numpy()].tolist()
        return [bytes(body[a:b]) for a, b in zip(stops, stops[1:])]

    def _of_cuts(self, cuts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of distinct cuts in some order, and the place of each cut there."""
        joint = np.zeros(len(cuts), bool) if self.model is None else pc.match_substring_regex(cuts, JOINT).to_numpy(zero_copy_only=False)
        others = cuts.filter(pa.array(~joint)).to_pylist()
        plain = np.array([self.model is not None and PLAIN.fullmatch(c) is not None for c in others], bool)
        alone, odd = ([c for c, p in zip(others, plain.tolist(), strict=True) if p == kind] for kind in (True, False))
        place, rest = np.empty(len(cuts), np.int64), np.flatnonzero(~joint)
        place[np.concatenate((np.flatnonzero(joint), rest[plain], rest[~plain]))] = np.arange(len(cuts))
        some = cuts.filter(pa.array(joint))
        sizes = np.concatenate((pc.utf8_length(some).to_numpy(), np.array([len(c) for c in alone], np.int64)))
        stops, body = self._of_words("".join(some.to_numpy(zero_copy_only=False)), alone, np.cumsum(sizes))
        self._learn_whole(self._unmet(set(odd)))
        found = [self.cache[c] for c in odd]
        stops = np.concatenate((stops, stops[-1] + np.cumsum(list(map(len, found)), dtype=np.int64)))
        return _sliced(stops, b"".join((body, *found))), place

    def _of_words(self, text: str, alone: list[str], ends: np.ndarray) -> tuple[np.ndarray, memoryview]:
        """Ids of plain cuts, one behind the other, and where each begins and ends: those that make up ``text``, then those that stand alone.

        A cut is as many words in a row as have its characters; ``ends`` counts the characters up to its end.
        """
        words = PATTERN.findall(text)
        words.extend(chain.from_iterable(map(PATTERN.findall, alone)))
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn_plain(self._unmet(set(words)))
        stops, body = _laid(_binary(list(map(self.cache.__getitem__, words))), coded.indices)
        sizes = pc.utf8_length(coded.dictionary).to_numpy()[coded.indices.to_numpy()]
        at = np.searchsorted(np.concatenate(([0], np.cumsum(sizes))), ends)
        return stops[np.concatenate(([0], at))], body


_ENCODERS: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """One encoder a worker."""
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system, inner


class _SequenceFile:
    """Writes a stream of ids as batches of fixed-size lists."""

    def __init__(self, path: str, dtype: np.dtype, length: int):
        self.dtype, self.length = dtype, length
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([
            pa.field("ids", pa.list_(pa.field("item", kind, nullable=False), length), nullable=False),
            pa.field("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length), nullable=False),
        ])
        system, inner = _open(path)
        self.sink = system.open_output_stream(inner)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.parts: list[bytes] = []
        self.size = 0

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)
        self.size += len(ids)
        step = BATCH_SEQUENCES * self.length * self.dtype.itemsize
        if self.size >= step:
            body = b"".join(self.parts)
            for at in range(0, len(body) - step + 1, step):
                self._batch(np.frombuffer(body, self.dtype, step // self.dtype.itemsize, at), step // self.dtype.itemsize)
            rest = body[len(body) - len(body) % step :]
            self.parts, self.size = [rest], len(rest)

    def _batch(self, ids: np.ndarray, real: int) -> None:
        columns = []
        for field, values in zip(self.schema, (pa.array(ids), pa.array(np.arange(len(ids)) < real)), strict=True):
            columns.append(pa.FixedSizeListArray.from_arrays(values, type=field.type))
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        ids = np.frombuffer(b"".join(self.parts), self.dtype)
        if len(ids):
            padded = np.zeros(-(-len(ids) // self.length) * self.length, self.dtype)
            padded[: len(ids)] = ids
            self._batch(padded, len(ids))
        self.writer.close()
        self.sink.close()


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _groups(batches):
    """(shard, doc ids, texts) of rows in a row with at most ``GROUP`` characters, or of one row."""
    ids, texts, size, shard = [], [], 0, None
    for batch in batches:
        column, here, begin = batch.column(0), batch.column(1).to_pylist(), 0
        for at, text in enumerate(here):
            if size and size + len(text) + ROW > GROUP:
                yield batch.column(2)[0].as_py(), pa.concat_arrays([*ids, column.slice(begin, at - begin)]), texts + here[begin:at]
                ids, texts, size, begin = [], [], 0, at
            size += len(text) + ROW
        shard = batch.column(2)[0].as_py() if here else shard
        ids.append(column.slice(begin))
        texts += here[begin:]
    if texts:
        yield shard, pa.concat_arrays(ids), texts


def write_shards(docs: DataFrame, definition: str, end_id: int, folder: str, length: int = LENGTH, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards; returns the table (shard, first_id, path, n_tokens, n_docs) of those that the job has finished."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(definition)
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), whole_text(text).alias("t"))
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "t").withColumn("shard", F.spark_partition_id())

    def write(batches):
        own, path, out = encoder(sent.value), f"{folder}/{uuid.uuid4().hex}", None
        end = np.array([end_id], own.dtype).tobytes()
        first, shard, start = None, None, 0
        for shard, ids_here, texts in _groups(batches):
            if out is None:
                out = _SequenceFile(f"{path}.seq.arrow", own.dtype, length)
                system, inner = _open(f"{path}.idx.arrow")
                index_sink = system.open_output_stream(inner)
                index = pa.ipc.new_file(index_sink, INDEX)
                first = ids_here[0].as_py()
            counts = []
            for ids in own.encode(texts):
                out.add(ids + end)
                counts.append(len(ids) // own.dtype.itemsize + 1)
            stops = start + np.cumsum(counts)
            index.write_batch(pa.RecordBatch.from_arrays([ids_here, pa.array(stops - counts, pa.int64()), pa.array(counts, pa.int64())], schema=INDEX))
            start = int(stops[-1])
        if out is not None:
            out.close()
            index.close()
            index_sink.close()
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "first_id": pa.array([first], pa.int64()),
                "path": pa.array([path]), "n_tokens": pa.array([start], pa.int64()),
            })

    return stage_table(rows.mapInArrow(write, "shard int, first_id long, path string, n_tokens long"), "shards")


class Shard:
    """Random access to one shard. A local file is mapped, so sequences and documents are views of it."""

    def __init__(self, path: str):
        system, inner = _open(f"{path}.seq.arrow")
        local = isinstance(system, fs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(inner) if local else system.open_input_file(inner))
        self.length = self.file.schema.field("ids").type.list_size
        system, inner = _open(f"{path}.idx.arrow")
        self.index = pa.ipc.open_file(pa.memory_map(inner) if local else system.open_input_file(inner))
        self._at, self._batch = -1, None

    def batch(self, number: int) -> pa.RecordBatch:
        if number != self._at:
            self._at, self._batch = number, self.file.get_batch(number)
        return self._batch

    def sequence(self, number: int, column: str = "ids") -> np.ndarray:
        """One sequence, or its mask: full batches have the same size, so its batch is known without a search."""
        values = self.batch(number // BATCH_SEQUENCES).column(column)[number % BATCH_SEQUENCES].values
        return values.to_numpy(zero_copy_only=column == "ids")

    def ids(self, start: int, count: int) -> np.ndarray:
        """A run of ids: a view where it lies in one batch."""
        step, parts = BATCH_SEQUENCES * self.length, []
        while count > 0:
            values = self.batch(start // step).column("ids").flatten().to_numpy(zero_copy_only=True)
            part = values[start % step : start % step + count]
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (over all shards), n_tokens, ids_crc32; ids as unsigned 32-bit."""
    spark = shards.sparkSession
    small_batches(spark)
    # one row per shard: their number is that of the partitions, not of the documents
    offsets = shards.withColumn("before", F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    files = stage_table(offsets.select("path", F.coalesce("before", F.lit(0)).alias("before")), "shard-offsets")

    def read(batches):
        for batch in batches:
            for path, before in zip(*[batch.column(i).to_pylist() for i in range(2)], strict=True):
                shard = Shard(path)
                for number in range(shard.index.num_record_batches):
                    places = shard.index.get_batch(number)
                    starts, counts = places.column(1).to_pylist(), places.column(2).to_pylist()
                    sums = [zlib.crc32(shard.ids(a, n).astype("<u4")) for a, n in zip(starts, counts, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [places.column(0), pa.array([before + a for a in starts], pa.int64()), places.column(2), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    spread = files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared one, made by Spark so that every file system will do."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    return path
