"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.session import ship_package

#: Fixed value: the white space of the contracts, ``[\x20\x09-\x0D]``; ``bytes.split()`` cuts at exactly these.
WHITE = b" \t\n\x0b\x0c\r"
#: The same set as a Java regular expression that cuts words.
WHITE_RUN = r"[\x20\x09-\x0D]+"
#: Records in an Arrow batch: texts may be long, so far fewer than Spark's default of 10,000.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Ready a session for Python workers: send the code, and bound the rows that one Arrow batch holds."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def whole_text(name: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def spare(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use; Spark compares names without case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held_out(column: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` when divided by ``parts``; false for a null id."""
    digest = F.crc32(F.col(column).cast("string").cast("binary"))
    return F.coalesce(F.pmod(digest, F.lit(parts)) == part, F.lit(False))
