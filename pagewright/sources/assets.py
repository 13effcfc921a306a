"""Assets as files: a sink that writes one a row and tells what lies on the disk, and a reader for media that items name."""

from __future__ import annotations

import hashlib
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import text as X

WRITTEN = "path string, bytes long, sha256 string"


@dataclass
class _Done(WriterCommitMessage):
    """What a task has put under names of its own, and what each is to be called."""

    files: list[tuple[str, str, int, str]]


class _Writer(DataSourceWriter):
    """Tasks write to names of their own; only the commit gives files their names, so a task that is tried again leaves one file, and a job that fails none."""

    def __init__(self, root: str, listing: str):
        self.root, self.listing = root, listing
        self.staged = os.path.join(root, f".staged-{uuid.uuid4().hex}")

    def write(self, iterator) -> _Done:
        files = []
        os.makedirs(self.staged, exist_ok=True)
        for row in iterator:
            to = os.path.normpath(row.path)
            if os.path.isabs(to) or to.split(os.sep)[0] == os.pardir or to == os.curdir:
                raise ValueError(f"an asset has to lie below the folder: {row.path}")
            body = row.content if isinstance(row.content, bytes | bytearray) else (row.content or "").encode("utf-8")
            at = os.path.join(self.staged, uuid.uuid4().hex)
            with open(at, "wb") as f:
                f.write(body)
            with open(at, "rb") as f:  # what is on the disk is what is told
                on_disk = f.read()
            files.append((at, to, len(on_disk), hashlib.sha256(on_disk).hexdigest()))
        return _Done(files)

    def commit(self, messages) -> None:
        rows = sorted((to, size, digest, at) for m in messages if m is not None for at, to, size, digest in m.files)
        for to, _, _, at in rows:
            path = os.path.join(self.root, to)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            os.replace(at, path)
        last = {to: f"{to}\t{size}\t{digest}\n" for to, size, digest, _ in rows}
        os.makedirs(os.path.dirname(self.listing), exist_ok=True)
        with open(self.listing, "w") as f:
            f.writelines(last.values())
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        for d, _, names in os.walk(self.staged, topdown=False):
            for n in names:
                os.remove(os.path.join(d, n))
            os.rmdir(d)


class AssetSink(DataSource):
    """Rows (path, content) as files below option("path"), a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "assets"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options["listing"])


def write_assets(assets: DataFrame, folder: str) -> DataFrame:
    """Writes assets (path, relative to the folder; content, text or binary; null is empty) and gives path, bytes and sha256 of what lies on the disk.

    Of several rows with a path one is kept. The folder is a path of a file system that all machines mount. The listing is kept beside the files, as `.assets-*`.
    """
    spark = assets.sparkSession
    spark.dataSource.register(AssetSink)
    listing = os.path.join(folder, f".assets-{uuid.uuid4().hex}", "listing.tsv")
    assets.select("path", "content").write.format("assets").option("path", folder).option("listing", listing).mode("append").save()
    return spark.read.option("sep", "\t").schema(WRITTEN).csv(listing)


def media_paths(source: Column | str) -> Column:
    """The path that a file URL names, percent-decoded; null for other protocols, which a table of files can't hold."""
    c = X.col(source)
    plain = F.regexp_replace(c, "[?#].*$", "")
    return F.when(F.lower(c).startswith("file:///"), F.url_decode(F.replace(F.substring(plain, 8, 1 << 20), F.lit("+"), F.lit("%2B"))))


def read_media(spark: SparkSession, items: DataFrame, folder: str, source: str = "source") -> DataFrame:
    """items with path, bytes, sha256 and content of the file that `source` names, and error: why there is none.

    The files below a folder are read once, by Spark, and joined by path; an item without one stays, as do those of other protocols.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.select(F.regexp_replace("path", "^file:/+", "/").alias("_path"), "length", "content")
    named = items.withColumn("path", media_paths(source))
    out = named.join(files, F.col("path") == F.col("_path"), "left")
    error = F.when(F.coalesce(F.col(source), F.lit("")) == "", "no source").when(F.col("path").isNull(), "not a file").when(F.col("_path").isNull(), "no such file")
    return out.select(*items.columns, "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content", error.alias("error"))
