"""Writers: appends, replacement in one step, users with ids, CSV exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefeed.functions import text as X
from tidefeed.operators import relational as R
from tidefeed.operators.numbering import numbered


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


POINTER = "_current"


class Versions:
    """A table as a folder of whole versions and a pointer to one of them, which is swapped in one step.

    A version is written beside the others, then the pointer file is replaced by a rename, which readers see as done or not done. A
    writer that fails leaves the old version; a reader that has resolved the pointer goes on reading its version, which is
    kept until `keep` newer ones are there. A writer may read the table that it replaces.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._hadoop, self._options = jvm.org.apache.hadoop.fs, jvm.org.apache.hadoop.fs.Options
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.path).getFileSystem(self._conf)
        self.path = self._fs.makeQualified(self._hadoop.Path(self.path)).toString()

    def _at(self, *names: str):
        return self._hadoop.Path("/".join([self.path, *names]))

    def current(self) -> str | None:
        """The name of the version that readers get; none before the first."""
        at = self._at(POINTER)
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return stream.readLine()
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        now = self.current()
        return None if now is None else self.spark.read.parquet(str(self._at(now)))

    def write(self, df: DataFrame) -> str:
        """A new version's name; readers don't see it yet."""
        name = f"v{0 if (now := self.current()) is None else int(now[1:].split('-')[0]) + 1}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(str(self._at(name)))
        return name

    def switch(self, name: str, keep: int = 1) -> None:
        """Readers get the version from now on; all but it and the `keep` before it go."""
        new = self._at(f"{POINTER}.{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        out.writeBytes(name)
        out.close()
        context = self._hadoop.FileContext.getFileContext(new.toUri(), self._conf)
        overwrite = self.spark.sparkContext._gateway.new_array(self._options.Rename, 1)
        overwrite[0] = self._options.Rename.OVERWRITE
        context.rename(new, self._at(POINTER), overwrite)
        number = int(name[1:].split("-")[0])
        for status in self._fs.listStatus(self._hadoop.Path(self.path)):
            other = status.getPath().getName()
            if other.startswith("v") and other != name and int(other[1:].split("-")[0]) < number - keep + (keep == 0):
                self._fs.delete(status.getPath(), True)


def replace_if_any(df: DataFrame, path: str) -> bool:
    """A new version of the table at path, unless df is empty: an empty log leaves the last recommendations alone. Read with Versions."""
    table = Versions(df.sparkSession, path)
    name = table.write(df)
    if table.spark.read.parquet(str(table._at(name))).isEmpty():
        table._fs.delete(table._at(name), True)
        return False
    table.switch(name)
    return True


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def interactions_export(ix: DataFrame, articles: DataFrame, users: DataFrame) -> DataFrame:
    rows = R.joined(ix, articles, users)
    return rows.orderBy(F.col("created_at").desc_nulls_first(), "id").select("id", "pseudonym", "article_id", "title", "source", X.label(F.col("category")).alias("category"), "event_type", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


def articles_export(articles: DataFrame) -> DataFrame:
    return articles.orderBy(F.col("parsed_at").desc_nulls_first(), "id").select("id", "title", "source", X.label(F.col("category")).alias("category"), "url", F.date_format("parsed_at", "yyyy-MM-dd HH:mm:ss").alias("parsed_at"), X.url_hash(F.col("url")).alias("url_hash"), X.clip(F.col("excerpt"), 200).alias("excerpt"))


def new_users(batch: DataFrame, users: DataFrame) -> DataFrame:
    """id, pseudonym of the batch's readers that aren't among users yet: ids go on densely from the greatest, in order of pseudonym.

    Ids come from counts of ranges, so no task numbers them all; a batch that is tried again gives the same, and nothing once it is in.
    """
    new = batch.select("pseudonym").where(X.nonempty(F.col("pseudonym"))).distinct().join(users.select("pseudonym"), "pseudonym", "left_anti")
    top = users.agg(F.max("id")).first()[0] or 0
    return numbered(new, [F.col("pseudonym")], "_n").select((F.col("_n") + F.lit(top)).alias("id"), "pseudonym")


def log_interactions(batch: DataFrame, users: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """batch (pseudonym, article_id, event_type) to (new users with ids, interactions kept with user_id). Users are created even if the article is unknown; unknown kinds count as clicks."""
    new = new_users(batch, users)
    ids = users.select(F.col("id").cast("long").alias("user_id"), "pseudonym").unionByName(new.select(F.col("id").alias("user_id"), "pseudonym"))
    kind = F.when(F.col("event_type").isin("click", "read", "share", "rec_click"), F.col("event_type")).otherwise("click")
    kept = batch.where(X.nonempty(F.col("pseudonym"))).join(articles.select(F.col("id").alias("article_id")), "article_id", "left_semi").withColumn("event_type", kind)
    return new, kept.join(ids, "pseudonym")


def metrics_long(results: DataFrame, key: str) -> DataFrame:
    """One row per metric."""
    names = [c for c in results.columns if c != key]
    return results.select(key, *[F.col(n).cast("double").alias(n) for n in names]).unpivot([key], names, "metric", "value")
