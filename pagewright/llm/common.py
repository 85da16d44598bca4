"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of every contract: blank and the five ASCII controls from tab to return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names.

    A local session that names none (tests) gets one under the working machine's temporary
    folder; a cluster without the setting is refused, as its executors share no local disk.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        root = os.path.join(tempfile.gettempdir(), "pagewright")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, at: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage ends there.

    The files outlive lost executors. Tables that a result still reads stay until the shared
    folder's owner clears it; ``Tables`` drops those that nothing reads any more.
    """
    spark = df.sparkSession
    at = at or scratch(spark)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


class Tables:
    """Written tables of one operator below one folder, dropped together when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at, self.n = spark, scratch(spark), 0

    def written(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return written(df, f"{self.at}/{self.n}")

    def drop(self) -> None:
        """Only for tables whose readers have themselves been written: what is lost after this can't be read again."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.at)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _files_once(docs: DataFrame, leaf) -> bool:
    """Whether the scan ``leaf`` of ``docs`` lists each of its files once: read twice, two rows would share a place."""
    try:
        listed = len(leaf.relation().location().inputFiles())
    except Py4JError:  # not a scan of files
        return False
    return len(docs._jdf.inputFiles()) == listed  # distinct ones


def stable(docs: DataFrame, moved: bool = True) -> DataFrame:
    """``docs`` itself if its rows are rows of files and no file is read twice, else a written copy: each row then has a place of its own that no scan changes.

    Without ``moved`` rows that are dealt anew behind the scan are written too: a task that is tried again then meets its rows in the same order.
    """
    plan = docs._jdf.queryExecution().analyzed()
    plain = plan.deterministic()
    while plain and plan.children().size() == 1:
        plain = plan.nodeName() in ("Project", "Filter", "SubqueryAlias", *("Repartition", "RepartitionByExpression") * moved)
        plan = plan.children().head()
    if plain and plan.children().isEmpty() and _files_once(docs, plan):
        try:
            docs.select(docs.metadataColumn("_metadata")["row_index"])
            return docs
        except AnalysisException:
            pass
    return written(docs)


def place(docs: DataFrame) -> list[Column]:
    """Two columns, ``file`` (hash of its path) and ``at`` (row in it), that name a row of a ``stable`` table at each scan.

    Two of a million files have one hash with a chance of 3e-8.
    """
    meta = docs.metadataColumn("_metadata")
    return [F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("at")]


def whole(docs: DataFrame) -> DataFrame:
    """The rows of a ``stable`` table in one column ``doc``, so that no name in them can clash, with ``file`` and ``at``."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), *place(docs))


def retexted(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``rows`` (doc, text): the new text, its n_chars, and the others as they were."""
    number = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    new = {"text": F.col("text"), **number}
    return rows.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def running(df: DataFrame, order: list[str], sums: list[str], rows: int, held: int = 200_000) -> DataFrame:
    """``df`` (``rows`` rows) with ``rank`` (from 1) in ``order``, which is total, and ``before_x``, the sum of x over the rows before.

    Above ``held`` rows in two steps: inside ranges of some ``held`` rows, then over the ranges' totals, so no task ranks a large table.
    """
    if rows <= held:
        one = Window.orderBy(*order)
        before = one.rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", F.row_number().over(one).cast("long").alias("rank"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in sums])
    n = rows // held + 1
    cut = written(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    totals = cut.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_t_{c}") for c in sums])
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_range", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_b{c}") for c in ("_n", *[f"_t_{c}" for c in sums])])
    inside = Window.partitionBy("_range").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = cut.withColumn("_r", F.row_number().over(inside)).withColumns({f"_i_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums}).join(bases, "_range")
    return out.select(*df.columns, (F.col("_b_n") + F.col("_r")).alias("rank"), *[(F.col(f"_b_t_{c}") + F.col(f"_i_{c}")).alias(f"before_{c}") for c in sums])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def compact(text: Column) -> Column:
    """The text without any white space: plain byte searches, so cheaper than a regex."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def let(value: Column, body) -> Column:
    """``body`` over ``value`` evaluated once: a lambda over an array of one element.

    Without it the optimizer copies an expensive expression into each place of use.
    """
    return F.transform(F.array(value), body)[0]
