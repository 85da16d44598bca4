"""Landing: files that arrive become books, one by one, each replaced as a whole where it changes.

A library is a folder with pages, chapters and files by book, and a kept index. A file is read when its
book is new or its content another; what it was last is written when all else is, so that a batch that is tried
again does what is missing and nothing twice. A file that can't be read is listed with its error and changes no book.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.operators import models as MD
from pagewright.operators import retrieval as R
from pagewright.operators.index import KeptIndex
from pagewright.plans import ingest
from pagewright.sources import books as BK
from pagewright.sources.settings import Settings
from pagewright.sources.tables import kept

FILES = "filename string, sha256 string, bytes long, book string"
ERRORS = "filename string, sha256 string, error string, batch long"


def book_name(path: Column) -> Column:
    """A book's name from a path: the file's without folders (of either slash) and ending, each run of anything but letters, digits, blanks, points, dashes and underlines as one underline, ``book`` if nothing is left."""
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    bare = F.regexp_replace(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""), r"[^\p{L}\p{N} ._-]+", "_")
    bare = F.regexp_replace(F.trim(bare), r"^\.+", "")
    return F.when(bare == "", "book").otherwise(bare)


class Library:
    """What has landed at ``at``."""

    def __init__(self, spark: SparkSession, at: str, embedder: R.Embedder = R.HASHED, settings: Settings = Settings()):
        self.spark, self.at, self.embedder, self.settings = spark, at.rstrip("/"), embedder, settings
        self.index = KeptIndex(spark, f"{self.at}/index", embedder)

    def _table(self, name: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        try:
            return reader.parquet(f"{self.at}/{name}")
        except AnalysisException:
            if schema is None:
                raise
            return self.spark.createDataFrame([], schema)

    def files(self) -> DataFrame:
        """(filename, sha256, bytes, book) of what each book was read from."""
        return self._table("files", FILES)

    def errors(self) -> DataFrame:
        """(filename, sha256, error, batch) of files that could not be read."""
        return self._table("errors", ERRORS)

    def pages(self) -> DataFrame:
        return self._table("pages")

    def chapters(self) -> DataFrame:
        return self._table("chapters")

    def writer(self, parser: MD.Parser = MD.plain_text) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch`` over a stream of binary files (path, modificationTime, length, content).

        Of several files of one book the one changed last counts, then the greatest path.
        """

        def write(batch: DataFrame, number: int) -> None:
            newest = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("modificationTime"), F.desc("path")))
            named = batch.select("path", "modificationTime", book_name(F.col("path")).alias("book")).withColumn("n", newest).where("n = 1").select("path", "book")
            files = batch.select("path", "length", "content").join(named, "path").select("book", F.regexp_extract("path", r"([^/\\]*)$", 1).alias("filename"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), "content")
            new = kept(files.join(self.files().select("book", "sha256"), ["book", "sha256"], "left_anti"))
            if not new.limit(1).count():
                return
            lines = kept(MD.parsed_files(new.select("book", "content"), parser, self.settings.max_pages))
            broken = lines.where("error IS NOT NULL").select("book", "error")
            listed = self.errors().where(F.col("batch") == number).select("filename", "sha256")
            broken_files = new.drop("content").join(broken, "book").join(listed, ["filename", "sha256"], "left_anti")
            broken_files.select("filename", "sha256", "error", F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(f"{self.at}/errors")
            good = new.drop("content").join(broken.select("book"), "book", "left_anti")
            if not good.limit(1).count():
                return
            whole = lines.where("error IS NULL").drop("error").join(good.select("book", "filename"), "book")
            read = ingest.read(whole, settings=self.settings)
            pages = kept(read.pages)
            BK.save(pages, f"{self.at}/pages")
            BK.replace(read.chapters, good.select("book"), f"{self.at}/chapters")
            self.index.ingest(read.chunks.where("NOT is_index"), good.select("book"))
            BK.save(good.select("filename", "sha256", "bytes", "book"), f"{self.at}/files")

        return write


def stream(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as they come to ``path`` or a folder below; one that is written again counts anew if its name or time differs."""
    return spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
