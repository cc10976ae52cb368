"""Reading and writing: declared schemas, journals, refuse-overwrite and publish-together sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T, functions as F

OBSERVATION = T.StructType([
    T.StructField("a", T.IntegerType()), T.StructField("r", T.LongType()), T.StructField("c", T.LongType()),
    T.StructField("dn4", T.LongType()), T.StructField("dn5", T.LongType()), T.StructField("qa", T.IntegerType()),
    T.StructField("v4", T.IntegerType()), T.StructField("v5", T.IntegerType()), T.StructField("vqa", T.IntegerType())])

JOURNAL = "seq long, event_type string, acquisition_id string, attempt int, task_id string, state string"
REGISTRY = "scene_id string, members array<struct<band:string,offset:long>>"
SCENE_CSV = "scene_id string, cloud string, sun_az string, sun_el string"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Where the session names none, a local master gets a temporary folder, as in tests; any
    other master is refused, since its executors would not see that folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        checkpoint = spark.sparkContext.getCheckpointDir()
        if not checkpoint and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = checkpoint or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate once to the shared folder and read it back.

    For tables that several branches of a plan use: later scans are columnar
    and pruned, the lineage ends here, and a lost executor costs a re-read.
    """
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


REUSE = True  # set False to rebuild derived tables in every query (bench.py does)
_derived: dict[tuple, DataFrame] = {}


def listing(spark: SparkSession, source: str) -> tuple:
    """Number of files below a folder and a sum over their names, sizes and times; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).select("path", "length", "modificationTime")
    return tuple(files.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first())


def derived(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table of one source folder, written on first use and read by later plans of the session.

    A source folder whose files have changed since is read anew.
    """
    key = (spark.sparkContext.applicationId, source, name, listing(spark, source) if REUSE else None)
    if not REUSE or key not in _derived:
        _derived[key] = materialize(spark, build(), name)
    return _derived[key]


def same_columns(df: DataFrame, want: T.StructType) -> DataFrame:
    """Stop when names, order or types differ from the declared bands."""
    have = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    need = [(f.name, f.dataType.simpleString()) for f in want.fields]
    if have != need:
        raise ValueError(f"band order or type differs: {have} != {need}")
    return df


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return same_columns(spark.read.parquet(path), OBSERVATION)


def write_observations(df: DataFrame, path: str) -> None:
    """One folder per acquisition, so that a scan of a few acquisitions prunes the rest."""
    df.write.partitionBy("a").mode("errorifexists").parquet(path)


def read_registry(spark: SparkSession, path: str, schema: str = REGISTRY, members: str = "members") -> DataFrame:
    reg = spark.read.schema(schema).option("multiLine", True).json(path)
    return reg.withColumn("m", F.explode(members)).drop(members).select("*", "m.*").drop("m")


def read_scene_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, schema=SCENE_CSV)
    return raw.select("scene_id", *[F.expr(f"try_cast({c} AS double)").alias(c) for c in ("cloud", "sun_az", "sun_el")])


def read_journal(spark: SparkSession, path: str, schema: str = JOURNAL) -> DataFrame:
    """JSON lines with a ``corrupt`` column holding any line that is no object of this schema."""
    return spark.read.schema(schema + ", corrupt string").option("columnNameOfCorruptRecord", "corrupt").json(path)


def append_journal(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_new(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def band_matches(names: DataFrame, column: str, tokens: list[str]) -> DataFrame:
    """How many distinct names carry each band token, with a one / none / many state."""
    hit = names.select(F.col(column).alias("_n")).distinct().select(
        *[F.count_if(F.contains(F.col("_n"), F.lit(t))).alias(t) for t in tokens])
    rows = F.array(*[F.struct(F.lit(t).alias("token"), F.col(t).alias("matches")) for t in tokens])
    return hit.select(F.explode(rows).alias("x")).select("x.*").withColumn(
        "located", F.when(F.col("matches") == 1, "one").when(F.col("matches") == 0, "none").otherwise("many"))


def input_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """Paths below a folder (the file content is never read)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length")


def publish(spark: SparkSession, tables: dict[str, DataFrame], target: str,
            validate: Callable[[dict[str, DataFrame]], DataFrame]) -> DataFrame:
    """Stage linked tables, validate the staged copies together, then write the final ones.

    Nothing is published when a check fails; a target that exists is an error.
    """
    staging = shared_dir(spark, "staging")
    for name, df in tables.items():
        df.write.parquet(f"{staging}/{name}")
    staged = {name: spark.read.parquet(f"{staging}/{name}") for name in tables}
    checks = validate(staged)
    failed = [r["check_id"] for r in checks.where(~F.col("passed")).select("check_id").take(100)]
    if failed:
        raise ValueError(f"not published, failed checks: {failed}")
    for name, df in staged.items():
        write_new(df, f"{target}/{name}")
    return checks
