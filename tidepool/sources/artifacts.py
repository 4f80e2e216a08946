"""Saved stages: one Parquet folder per version of a component, and a log that says which versions were completed and from what.

A log is a folder of numbered files that are created only if absent and never changed. A commit is one such file: writers that meet at a number
go on to the next one, so no commit replaces another, and a file that its writer did not finish counts for nothing. The highest
whole file is the present state.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(df: DataFrame | None) -> str:
    """Schema, row count and an order-independent sum of row hashes, in one distributed pass."""
    if df is None:
        return "none"
    row_hash = F.pmod(F.xxhash64(*df.columns), F.lit(2**31 - 1)).cast("decimal(20,0)")
    shape = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row_hash).alias("h")).first()
    content = f"{df.schema.simpleString()}|{shape.n}|{shape.h}"
    return hashlib.sha256(content.encode()).hexdigest()


def combined(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in df.schema)


_LOG_FILE = re.compile(r"(\d{12})\.json")
#: Versions without a commit may still be in the writing; they are garbage after this time.
GRACE_SECONDS = 24 * 3600


class ArtifactStore:
    """Components under one folder, on any file system Spark can reach.

    Every save writes a new version folder and then the commit that names it. A job that died in
    between is recomputed, and a model that is open elsewhere keeps reading the version it opened, until ``collect_garbage``.
    Writers need a file system that creates a file only if it is absent (HDFS and most object stores with conditional writes).
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.reused: list[str] = []
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _hadoop(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._path(name))

    def _names(self, folder: str) -> list[str]:
        path = self._hadoop(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _numbers(self, name: str) -> list[int]:
        return [int(m[1]) for m in map(_LOG_FILE.fullmatch, self._names(f"{name}.log")) if m]

    def _entry(self, name: str, number: int) -> dict | None:
        """The record of one commit, or None if its writer did not finish it."""
        stream = self._fs.open(self._hadoop(f"{name}.log/{number:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        body, _, check = text.rpartition("\n")
        return json.loads(body) if body and check == hashlib.sha256(body.encode()).hexdigest() else None

    def write_record(self, name: str, record: dict) -> int:
        """Appends a commit; returns its number."""
        body = json.dumps(record, sort_keys=True)
        content = bytearray(f"{body}\n{hashlib.sha256(body.encode()).hexdigest()}".encode())
        number = max(self._numbers(name), default=0) + 1
        while True:
            try:
                out = self._fs.create(self._hadoop(f"{name}.log/{number:012d}.json"), False)
            except Py4JJavaError as error:
                if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                    raise
                number += 1
                continue
            out.write(content)
            out.close()
            return number

    def read_record(self, name: str) -> dict | None:
        """The newest whole commit."""
        for number in reversed(self._numbers(name)):
            record = self._entry(name, number)
            if record is not None:
                return record
        return None

    def collect_garbage(self, name: str, keep: int = 1, grace_seconds: float = GRACE_SECONDS) -> list[str]:
        """Deletes the versions of a component, but for the newest ``keep`` commits and what may still be in the writing; returns their names."""
        entries = [(number, self._entry(name, number)) for number in self._numbers(name)]
        whole = [(number, record) for number, record in entries if record is not None]
        kept = {record.get("version") for _, record in whole[-keep:]}
        named = {record.get("version") for _, record in whole}
        gone = []
        for folder in self._names(name):
            version, path = f"{name}/{folder}", self._hadoop(f"{name}/{folder}")
            age = time.time() - self._fs.getFileStatus(path).getModificationTime() / 1000
            if version not in kept and (version in named or age >= grace_seconds):
                self._fs.delete(path, True)
                gone.append(version)
        for number, _ in whole[:-keep]:
            self._fs.delete(self._hadoop(f"{name}.log/{number:012d}.json"), False)
        return gone

    def _open(self, record: dict) -> DataFrame:
        return self.spark.read.schema(record["schema"]).parquet(self._path(record["version"]))

    def read(self, name: str) -> DataFrame | None:
        """The saved component, or None if it was never completed."""
        record = self.read_record(name)
        return None if record is None else self._open(record)

    def save(self, name: str, df: DataFrame, print_: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        record = {"fingerprint": print_, "schema": _ddl(df), "version": f"{name}/{uuid.uuid4().hex}"}
        df.write.partitionBy(*partition_by).parquet(self._path(record["version"]))
        self.write_record(name, record)
        return self._open(record)

    def stage(self, name: str, print_: str, compute: Callable[[], DataFrame], reuse: bool) -> DataFrame:
        """The saved component if its fingerprint matches, else the computed one, saved."""
        record = self.read_record(name) if reuse else None
        if record is not None and record["fingerprint"] == print_:
            self.reused.append(name)
            return self._open(record)
        return self.save(name, compute(), print_)
