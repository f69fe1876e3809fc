"""Token counts as rollups that are maintained by signed changes.

A change adds or takes away a document's tokens; a revision is taking away the old count and adding
the new one. A batch of changes is summed per (source, lang, tokenizer) and committed under its own name
in a folder: the data are written to a folder of the attempt, then one rename publishes them as the
batch. A batch that is there already is not written again, so a repeated or restarted commit changes
nothing. Totals are sums over all committed batches.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm.text import texts

GROUP = ["source", "lang", "tokenizer"]
SUMS = ["docs", "tokens", "bytes"]
# fixed value: how the public merge file splits a text before merging
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LAYOUT = "source string, lang string, tokenizer string, docs long, tokens long, bytes long"


class Ranks:
    """A byte-level merge vocabulary and its version: the digest of its file."""

    def __init__(self, path: str, pattern: str):
        import base64

        with open(path, "rb") as f:
            lines = f.read()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line)}
        self.pattern = pattern
        self.version = "bpe-" + hashlib.sha256(lines + pattern.encode()).hexdigest()[:12]

    def encoder(self):
        """The encoder, made once per process."""
        import tiktoken

        if "made" not in self.__dict__:
            self.made = tiktoken.Encoding(self.version, pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return self.made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "made"}


def count_tokens(
    docs: DataFrame, ranks: Ranks, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang"
) -> DataFrame:
    """(key, source, lang, tokenizer, sign, tokens, bytes), one insert for every row of ``docs``.

    Special strings are ordinary text. NULL and empty texts have no tokens but count as documents; NULL
    sources and languages are groups of their own; repeated rows count each. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(frames):
        for batch in frames:
            encode = shared.value.encoder().encode_ordinary
            values = texts(batch.column(3))
            numbers = [len(encode(t.decode("utf-8", "replace"))) for t in values]
            n = len(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([shared.value.version] * n), pa.array([1] * n, pa.int64()), pa.array(numbers, pa.int64()), pa.array(list(map(len, values)), pa.int64())],
                names=["key", "source", "lang", "tokenizer", "sign", "tokens", "bytes"],
            )

    chosen = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()
    return chosen.mapInArrow(run, f"key {kind}, source string, lang string, tokenizer string, sign long, tokens long, bytes long")


def deletes(changes: DataFrame) -> DataFrame:
    """The changes that take the given ones back."""
    return changes.withColumn("sign", -F.col("sign"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """The changes that put new counts in the place of old ones; unchanged rows cancel each other."""
    return deletes(old).unionByName(new)


def delta(changes: DataFrame) -> DataFrame:
    """Signed changes summed per group; partial sums are taken before the shuffle, so no group is hot."""
    return changes.groupBy(*GROUP).agg(
        F.sum("sign").alias("docs"),
        F.sum(F.col("sign") * F.col("tokens")).alias("tokens"),
        F.sum(F.col("sign") * F.col("bytes")).alias("bytes"),
    )


class Ledger:
    """Committed batches in one folder of a file system that Spark can write to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _batch(self, name: str) -> str:
        return f"{self.folder}/committed/{hashlib.sha256(name.encode()).hexdigest()[:32]}"

    def has(self, name: str) -> bool:
        files, place = self._files(self._batch(name))
        return files.exists(place)

    def commit(self, name: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if a batch of that name is committed already."""
        if self.has(name):
            return False
        attempt = f"{self.folder}/attempts/{uuid.uuid4().hex}"
        delta(changes).write.parquet(attempt)
        files, source = self._files(attempt)
        _, target = self._files(self._batch(name))
        files.mkdirs(target.getParent())
        if files.exists(target) or not files.rename(source, target):
            files.delete(source, True)
            return False
        return True

    def totals(self) -> DataFrame:
        """Sums of all committed batches per group; groups with no document left are gone."""
        files, place = self._files(f"{self.folder}/committed")
        found = [s.getPath().toString() for s in files.listStatus(place)] if files.exists(place) else []
        if not found:
            return self.spark.createDataFrame([], _LAYOUT)
        # one scan, however many batches there are
        every = self.spark.read.schema(_LAYOUT).parquet(*sorted(found))
        sums = every.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS])
        return sums.filter("docs <> 0 OR tokens <> 0 OR bytes <> 0")


def public_ranks(spark: SparkSession) -> Ranks:
    """Merge file and split pattern: ``spark.loomstat.mergeFile`` and ``mergePattern`` or the machine's public ones."""
    path = spark.conf.get("spark.loomstat.mergeFile", "/opt/tokenizers/byte_bpe_50k.tiktoken")
    return Ranks(path, spark.conf.get("spark.loomstat.mergePattern", PATTERN))
