"""Stage tables: each stage is written once to the shared checkpoint folder and read back by the next one."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from lossloom.config import Settings

_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder the cluster names for cut lineage. A temporary folder is used only on a local master without one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        _ROOTS[app] = tempfile.mkdtemp(prefix="lossloom-")
    return _ROOTS[app]


#: Folder below which intermediate tables go; a job has one of its own, so that clearing it leaves the tables of others alone.
_SCOPE: ContextVar[str] = ContextVar("lossloom_cut_scope", default="cut")


def _cut_folder(spark: SparkSession, scope: str) -> str:
    return f"{shared_root(spark)}/lossloom/{spark.sparkContext.applicationId}/{scope}"


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{_cut_folder(spark, _SCOPE.get())}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_cuts(spark: SparkSession, scope: str = "cut") -> None:
    """Delete the intermediate tables that ``cut_lineage`` wrote in one scope; call it when no result still reads them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_cut_folder(spark, scope))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def own_cuts(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside go to a folder of their own, which is deleted at the end."""
    scope = f"cut-{uuid.uuid4().hex[:12]}"
    token = _SCOPE.set(scope)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        clear_cuts(spark, scope)


@contextmanager
def loan_co_location(spark: SparkSession) -> Iterator[None]:
    """While a loan table is written, tables bucketed on the loan serve joins on (loan, date) without a shuffle, and in the order of their files.

    A loan has at most one row per month, so partitioning such a join by the loan alone cannot skew; other plans of the session keep the
    default, under which a join is dealt by all its keys. Spark takes the order of a bucket only where it is one file.
    """
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


#: Orders behind one partition of the loan panel: about 300,000 loan months, whose widest sort takes some 500 MB.
ORDERS_PER_PARTITION = 50_000


def fit_partitions(spark: SparkSession, orders: int) -> None:
    """Raise the session's shuffle partitions to what so many orders ask for; they are never lowered.

    With a fixed number the rows of one sort, window or hash table grow with the input, until tasks spill.
    """
    key = "spark.sql.shuffle.partitions"
    wanted = -(-orders // ORDERS_PER_PARTITION)
    if wanted > int(spark.conf.get(key)):
        spark.conf.set(key, str(wanted))


#: Bytes of the largest generated method an operator may run in. Java's optimizing compiler gives up on the methods that hold a whole row of a
#: loan table (6,400 bytes in the mart) and never compiles those beyond 8,000; operators with longer ones use Spark's split projections.
METHOD_BYTES = 2_000


def fit_methods(spark: SparkSession) -> None:
    """Bound the session's generated methods at ``METHOD_BYTES``, unless someone has set a limit."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == "65535":  # Spark's default, the longest method Java takes
        spark.conf.set(key, str(METHOD_BYTES))


def write_by_loan(df: DataFrame, table: str, path: str) -> None:
    """Bucketed by loan and sorted by loan and month: one file per bucket, so that later windows and joins on the loan start from the files."""
    spark = df.sparkSession
    month = [c for c in ("as_of_date", "month_index") if c in df.columns][:1]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with loan_co_location(spark):
        (df.repartition(buckets, "loan_id").write.mode("overwrite").format("parquet").option("path", path)
         .bucketBy(buckets, "loan_id").sortBy("loan_id", *month).saveAsTable(table))


class Stages:
    """Named, lazily built stage tables for one input folder.

    Loan-keyed stages are bucketed on ``loan_id`` with as many buckets as shuffle partitions: later windows and joins on
    the loan then start from the files without a shuffle. Other stages are plain parquet. A written table also ends the
    lineage, so a lost executor costs one stage and not the whole chain.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, settings: Settings | None = None,
                 builders: dict[str, tuple[Callable[[Stages], DataFrame], str]] | None = None, write: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.cfg = settings or Settings()
        self.write = write
        self.tables: dict[str, DataFrame] = {}
        if builders is None:
            from lossloom.plans.stages import BUILDERS as builders
        self.builders = builders

    def __call__(self, name: str) -> DataFrame:
        if name not in self.tables:
            build, layout = self.builders[name]
            df = build(self)
            self.tables[name] = self._written(name, df, layout) if self.write and layout != "lazy" else df
        return self.tables[name]

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _written(self, name: str, df: DataFrame, layout: str) -> DataFrame:
        key = hashlib.md5(f"{self.sf_dir}|{self.cfg}".encode()).hexdigest()[:10]
        path = f"{shared_root(self.spark)}/lossloom/{self.spark.sparkContext.applicationId}/{key}/{name}"
        if layout == "text":
            df.write.mode("overwrite").partitionBy("vintage_year").text(path)
            return self.spark.read.text(path)
        if layout == "plain":
            df.write.mode("overwrite").parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)
        table = f"lossloom_{key}_{name}"
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        write_by_loan(df, table, path)
        return self.spark.table(table)


_STAGES: dict[tuple[str, str], tuple[Stages, int]] = {}


def stages_for(spark: SparkSession, sf_dir: str) -> Stages:
    """Stage tables are shared by all queries of one application on one input folder. Shuffles are sized by that input, methods by the compiler."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _STAGES:
        t = Stages(spark, sf_dir)
        _STAGES[key] = t, t.raw("orders").count()
    t, orders = _STAGES[key]
    fit_partitions(spark, orders)
    fit_methods(spark)
    return t
