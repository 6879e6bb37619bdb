"""Sources and sinks: long tables as Parquet, CSV or text, file catalogs, and partitioned output."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_long(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, aliases: dict[str, str] | None = None, form: str = "parquet") -> DataFrame:
    """A long table from one or several paths, with variables renamed by aliases."""
    reader = spark.read.format(form)
    if form == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return df.withColumnsRenamed(aliases) if aliases else df


def time_slice(df: DataFrame, step: str, window: str = "all") -> DataFrame:
    """'all', or '<first>,<count>' with the first step numbered 1; a filter that reaches the scan."""
    if window == "all":
        return df
    first, count = (int(x) for x in window.split(","))
    return df.where(F.col(step).between(first, first + count - 1))


def mask_lines(lines: DataFrame, value: str = "value", header: str = "lat") -> DataFrame:
    """Text lines 'lat,lon,v0,v1,...' as (lat, lon, lev, v); lines that begin with the header's word are skipped, empty values are null."""
    parts = lines.where(~F.startswith(F.lower(F.ltrim(value)), F.lit(header))).select(F.split(value, ",").alias("p"))
    rows = parts.select(F.trim(F.col("p")[0]).cast("double").alias("lat"), F.trim(F.col("p")[1]).cast("double").alias("lon"), F.posexplode(F.slice("p", 3, F.greatest(F.size("p") - 2, F.lit(0)))).alias("lev", "v"))
    return rows.withColumn("v", F.expr("try_cast(nullif(trim(v), '') AS int)"))


def parsed_catalog(files: DataFrame, name: str = "file") -> DataFrame:
    """Identity columns from dotted names suite.model.experiment.member.freq.realm.table.variable.ver-version.ext."""
    p = F.split(name, r"\.")
    fields = ("suite", "model", "experiment", "member", "freq", "realm", "table", "variable")
    return files.select("*", *(F.get(p, F.lit(i)).alias(f) for i, f in enumerate(fields)), F.regexp_extract(name, r"ver-([^.]+)", 1).alias("version"))


def latest_version(catalog: DataFrame, ids: list[str], version: str) -> DataFrame:
    """The row with the largest version of each identity."""
    rank = F.row_number().over(Window.partitionBy(*ids).orderBy(F.col(version).desc()))
    return catalog.withColumn("_r", rank).where("_r = 1").drop("_r")


def paired(left: DataFrame, right: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, left without a partner, right without a partner)."""
    return left.join(right, ids), left.join(right, ids, "left_anti"), right.join(left, ids, "left_anti")


def complete_sets(catalog: DataFrame, ids: list[str], variables: list[str], variable: str = "variable", version: str = "version") -> tuple[DataFrame, DataFrame]:
    """(ids with the latest version of each variable, ids with the variables that they lack), from one aggregate for any number of variables.

    A variable whose versions are all null counts as lacking; ids with none of the variables are in neither.
    """
    newest = (F.max(F.when(F.col(variable) == v, F.col(version))).alias(v) for v in variables)
    rows = catalog.where(F.col(variable).isin(variables)).groupBy(*ids).agg(*newest)
    rows = rows.withColumn("missing", F.array_compact(F.array(*(F.when(F.col(v).isNull(), F.lit(v)) for v in variables))))
    return rows.where(F.size("missing") == 0).drop("missing"), rows.where(F.size("missing") > 0).select(*ids, "missing")


def first_member_first(catalog: DataFrame, ids: list[str], member: str = "member", first: str = "r1i1p1", out: str = "priority") -> DataFrame:
    """catalog with the rank of each row among those of its ids: the first member, then the others by name."""
    w = Window.partitionBy(*ids).orderBy(F.when(F.col(member) == first, 0).otherwise(1), member)
    return catalog.withColumn(out, F.row_number().over(w))


def not_written(catalog: DataFrame, written: DataFrame, ids: list[str], overwrite: bool = False) -> DataFrame:
    """Work that is left: rows whose output is not there yet, or all of them."""
    return catalog if overwrite else catalog.join(written.select(*ids).distinct(), ids, "left_anti")


def whole_outputs(spark: SparkSession, path: str, ids: list[str], least_bytes: int = 1_000_000) -> DataFrame:
    """(ids) of the partitions of an output whose files all have at least least_bytes: a run that died leaves smaller ones, which count as not written.

    ids are the partition columns of the folder. Sizes come from the listing; no file is opened, so a truncated one does no harm.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(*ids, "length")
    return files.groupBy(*ids).agg(F.min("length").alias("_least")).where(F.col("_least") >= least_bytes).select(*ids)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in spark.checkpoint.dir, the folder that all machines share; in local mode a temporary one if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{found}/{name}-{uuid.uuid4().hex}"


def stored_by_keys(df: DataFrame, name: str, keys: list[str], buckets: int, path: str) -> DataFrame:
    """Writes df as a table bucketed and sorted by keys, at a path that all machines share, and reads it.

    Tables with the same keys and buckets join, and are grouped or ranked by these keys, without a shuffle: run, control and noise are dealt once, when they
    are written. Of buckets there should be some per core, each a few hundred MB.
    """
    df.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def append_years(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Writes df and replaces only the partitions that it has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def merged_variable(df: DataFrame, side: DataFrame, keys: list[str], variable: str) -> DataFrame:
    """df with a variable of a side table, joined by the grid keys; a column of that name is replaced, points that the side lacks are null."""
    return df.drop(variable).join(side.select(*keys, variable), keys, "left")


def selected_runs(catalog: DataFrame, models: DataFrame, experiment: str, least_control: int = 140) -> DataFrame:
    """Runs of an experiment whose model (model, control_years) has a control run of at least `least_control` years."""
    long_ = models.where(F.col("control_years") >= least_control).select("model")
    return catalog.where(F.col("experiment") == experiment).join(long_, "model", "left_semi")


def version_clashes(catalog: DataFrame, ids: list[str], version: str = "version") -> DataFrame:
    """Identities that have more than one version: ids, and the versions in order."""
    found = catalog.groupBy(*ids).agg(F.array_sort(F.collect_set(version)).alias("versions"))
    return found.where(F.size("versions") > 1)
