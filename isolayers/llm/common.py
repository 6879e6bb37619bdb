"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, or a temporary one if that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint in the shared folder, so a lost executor costs no long lineage.

    With spark.cleaner.referenceTracking.cleanCheckpoints Spark deletes its files once the DataFrame is gone.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table of its own in the shared folder and reads it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sliced(batches: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """Batches of at most `rows` rows. Spark bounds an Arrow batch by its bytes; this bounds what is made of one at a time."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.iloc[i : i + rows].reset_index(drop=True)


def quoted(name: str) -> Column:
    """The column of just this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, *more: Column) -> DataFrame:
    """Rows as one struct column `row` beside the columns that an operator works with, so that no name of df can clash with these."""
    return df.select(F.struct(*(quoted(c) for c in df.columns)).alias("row") if df.columns else F.struct().alias("row"), *more)


def unpacked(names: list[str], new: dict[str, Column]) -> list[Column]:
    """The columns of a packed row, and new ones. A column called like a new one comes back as <name>_input."""
    ours, given = {n.lower() for n in new}, {n.lower() for n in names} | {n.lower() for n in new}
    out = []
    for n in names:
        to = n
        if n.lower() in ours:
            to = n + "_input"
            while to.lower() in given:
                to += "_"
            given.add(to.lower())
        out.append(F.col("row").getField(n).alias(to))
    return out + [c.alias(n) for n, c in new.items()]


def as_given(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs alone from the result of an operator that puts its new columns last, whatever their names."""
    return found.toDF(*(f"_{i}" for i in range(len(found.columns)))).select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per distinct text: key (16-byte digest), body (UTF-8 bytes; null counts as empty), n (rows with it).

    Copies meet in a partial aggregate before the shuffle, so a text that a third of all rows share costs
    one row per task.
    """
    body = F.coalesce(quoted(text_col).cast("binary"), F.lit(b""))
    return (
        docs.select(body.alias("body"))
        .select(text_key(F.col("body")).alias("key"), "body")
        .groupBy("key")
        .agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("n"))
    )


def text_key(body):
    """Digest column by which rows find their distinct text."""
    return F.unhex(F.md5(body))


def gathered(df: DataFrame, by: list[str], then: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a group in one partition, next to each other.

    It deals by a hash of the columns: after a join on the same columns Spark would leave out a plain repartition(), and
    then read the join's parts where they lie or split them, which tears groups apart.
    """
    return df.repartition(F.xxhash64(*by)).sortWithinPartitions(*by, *then)


#: A key with more than one row in HOT_SHARE is hot; there are at most HOT_SHARE of them, whatever the input.
HOT_SHARE = 200


def hot_join(rows: DataFrame, facts: DataFrame, key: str, count: str, spread: Column, total: int, salts: int = 64) -> DataFrame:
    """rows with the columns of facts, which has one row per key (not null) and the key's number of rows in `count`.

    The rows of a hot key are dealt over `salts` parts by a hash of `spread`, and its facts are repeated for each part, so no task holds all rows
    of one key. Only the names of hot keys, at most HOT_SHARE, come to the driver.
    """
    hot = [r[0] for r in facts.where(F.col(count) * HOT_SHARE > total).select(key).collect()]
    if not hot:
        return rows.join(facts, key)
    is_hot = F.col(key).isin(hot)
    rows = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0))
    each = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(facts.withColumn("_salt", F.explode(each)), [key, "_salt"]).drop("_salt")


def row_tuples(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named columns of Arrow batches as Python tuples, a batch at a time (null is None, so long numbers stay exact)."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def record_batches(rows: Iterable[tuple], schema: pa.Schema, most_rows: int = 2000, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of tuples, cut by the number of rows and by the length of their strings."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= most_rows or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def text_key_of(value: Column) -> Column:
    """A value as a string that also orders and groups nulls: '' for null, else 'k' and the value."""
    return F.coalesce(F.concat(F.lit("k"), value.cast("string")), F.lit(""))


def value_of_key(key: str, kind) -> Column:
    """The value that text_key_of() made a key of."""
    return F.when(F.col(key) != "", F.substring(key, 2, 2**31 - 1)).cast(kind)
