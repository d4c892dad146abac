"""A store of collected texts with an index of its keys and a list of commits.

Keys lie in buckets by their hash, so a batch reads the buckets its own keys fall into and no texts. A batch becomes
visible by one step, a commit file whose number must be free; of two runs that commit at once the later one looks again at
what the other has added, drops those keys and tries the next number. So no URL is added by two runs, and a folder without
a commit, left by a job that was lost, is never read. Numbers are as safe as the file system's rename that refuses to
replace a file.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from resonance.functions import scalars as S
from resonance.sources.tables import TEXT_SCHEMA
from resonance.streaming.collect import run_id

#: Buckets of a store; it keeps the number it was made with in its paths, so change it for new stores only.
BUCKETS = 256


class Commit(NamedTuple):
    number: int
    id: str
    owner: str | None


class KeyStore:
    """Texts by URL under ``path``, with parts ``texts``, ``keys`` and ``commits``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def commits(self) -> list[Commit]:
        """All commits in order: a few bytes for each batch ever added."""
        try:
            found = self.spark.read.schema("number long, id string, owner string").json(f"{self.path}/commits").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(Commit(*r) for r in found)

    def texts(self) -> DataFrame:
        """The texts of all commits."""
        ids = [c.id for c in self.commits()]
        if not ids:
            return self.spark.createDataFrame([], TEXT_SCHEMA)
        return self.spark.read.schema(TEXT_SCHEMA).parquet(*[f"{self.path}/texts/{i}" for i in ids])

    def keys(self, commits: list[Commit], buckets: list[int]) -> DataFrame | None:
        """Keys of those buckets in those commits; none without any. Folders of other buckets are not listed by Spark's scan."""
        if not commits or not buckets:
            return None
        rows = self.spark.read.schema("key string, id string, bucket int").option("basePath", f"{self.path}/keys")
        return rows.parquet(*[f"{self.path}/keys/id={c.id}" for c in commits]).where(F.col("bucket").isin(buckets)).select("key")

    def add(self, batch: DataFrame, owner: str | None = None) -> bool:
        """Add the texts of a batch whose URL no commit has; whether there was anything to do.

        No URL or no text is left out; a URL twice in the batch is kept twice. With ``owner``, a batch that was committed
        under that name before adds nothing.
        """
        seen = self.commits()
        if owner and any(c.owner == owner for c in seen):
            return False
        usable = batch.where(F.col("post_url").isNotNull() & S.not_blank(F.col("post_text")))
        texts = usable.select("post_url", S.strip(F.col("post_text")).alias("post_text")).persist()
        try:
            buckets = sorted(r[0] for r in texts.select(self._bucket()).distinct().collect())  # at most all buckets
            new = self._write(self._without(texts, self.keys(seen, buckets)))
        finally:
            texts.unpersist()
        while not self._commit(Commit(len(seen) + 1, new, owner)):
            later = self.commits()[len(seen):]
            if owner and any(c.owner == owner for c in later):
                return False
            mine = self.spark.read.schema(TEXT_SCHEMA).parquet(f"{self.path}/texts/{new}")
            new = self._write(self._without(mine, self.keys(later, buckets)))
            seen += later
        return True

    def _bucket(self):
        return F.pmod(F.xxhash64("post_url"), F.lit(self.buckets)).cast("int").alias("bucket")

    @staticmethod
    def _without(texts: DataFrame, keys: DataFrame | None) -> DataFrame:
        return texts if keys is None else texts.join(keys, texts["post_url"] == keys["key"], "left_anti")

    def _write(self, fresh: DataFrame) -> str:
        """Texts and keys under a new name, which nobody sees yet."""
        name = uuid.uuid4().hex
        fresh.select("post_url", "post_text").write.parquet(f"{self.path}/texts/{name}")
        keys = self.spark.read.schema(TEXT_SCHEMA).parquet(f"{self.path}/texts/{name}")
        keys = keys.select(F.col("post_url").alias("key"), self._bucket()).distinct()
        keys.repartition("bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{self.path}/keys/id={name}")
        return name

    def _commit(self, commit: Commit) -> bool:
        """Take the commit's number; whether it was free."""
        context = self.spark.sparkContext
        hadoop, conf = context._jvm.org.apache.hadoop.fs, context._jsc.hadoopConfiguration()
        final = hadoop.Path(f"{self.path}/commits/{commit.number:012d}.json")
        store = final.getFileSystem(conf)
        draft = hadoop.Path(f"{self.path}/drafts/{commit.id}.json")
        out = store.create(draft, True)
        out.write(bytearray(json.dumps(commit._asdict()).encode()))
        out.close()
        store.mkdirs(final.getParent())
        none = context._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        none[0] = getattr(hadoop, "Options$Rename").NONE
        final = store.makeQualified(final)
        try:
            hadoop.FileContext.getFileContext(final.toUri(), conf).rename(store.makeQualified(draft), final, none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            return False
        return True


def collect_by_key(incoming: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Append the new texts of a stream to a :class:`KeyStore`; runs until the input at hand is used up.

    A batch is named by the run and its number, so one replayed after a failure adds nothing twice.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        KeyStore(spark, store).add(batch, f"{run_id(spark, checkpoint)}/{batch_id}")

    return (
        incoming.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
