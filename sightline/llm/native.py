"""Column expressions shared by the operators that stay inside the JVM."""

from __future__ import annotations

import string
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCS_A_FILE = 5000
#: Everything that is not an ASCII digit, an ASCII letter (after lower-casing) or a non-ASCII character.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def text_of(column: str | Column) -> Column:
    """A null text is the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z only; F.lower would also fold letters outside ASCII."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    """The array of lower-cased word strings."""
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoints(spark) -> None:
    """The cluster's checkpoint folder is used as it is set; only a local session without one gets a temporary folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def few_files(docs: DataFrame) -> int:
    """Files to which what comes from docs is coalesced before it is written; partitions that are fewer stay as they are.

    On a local disk without Hadoop's native library each file starts processes that set its rights, and a process that has just started counts as large as its JVM.
    """
    return max(8, docs.count() // DOCS_A_FILE)


def small_batches(spark, rows: int = 2000) -> None:
    """Whole texts go to Python in batches of at most so many rows; a smaller setting of the session stands."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def spare(taken, *names: str) -> list[str]:
    """Working names that no column of taken has, whatever its case."""
    low = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


def member_filter(rows: DataFrame, key: str | Column, members: DataFrame, member: str, wanted: bool = True, most_bits: int = 1 << 23) -> DataFrame:
    """Rows whose key may be among the members, or with wanted=False the rest, whose keys surely aren't.

    A bitmap over key hashes is broadcast as (word, bits), at most most_bits / 64 rows whatever the number
    of members. Beyond some most_bits / 8 members it lets more rows pass; joins after it stay exact.
    Columns of rows stay as they are, whatever their names.
    """
    n = members.count()
    bits = min(most_bits, max(1 << 16, 1 << (8 * n).bit_length()))
    word, mask = spare(rows.columns, "filter_word", "filter_bits")

    def slot(c: str | Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(bits))

    def at(c: str | Column) -> Column:
        return (slot(c) / 64).cast("int")

    marked = members.groupBy(at(member).alias(word)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot(member) % 64).cast("int"))).alias(mask))
    x = rows.join(F.broadcast(marked), at(key) == F.col(word), "left")
    hit = F.coalesce(F.call_function("shiftright", F.col(mask), (slot(key) % 64).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return x.filter(hit if wanted else ~hit).select(*rows.columns)
