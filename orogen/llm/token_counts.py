"""Token counts: additive rollups kept up to date by signed deltas.

A batch is a table of signed rows (source, lang, tokenizer, docs, tokens): inserts are
positive, deletes negative, and a revised count is a delete of the old and an insert of
the new. ``commit`` sums a batch by key, writes it and then a new version of the store's
manifest, which alone decides what counts. A batch that the manifest names, as open or as folded
into the base, is ignored, so a retried job never counts twice; a write that broke off
before the manifest counts for nothing and is written again. ``fold`` sums base and batches
into a new base in the same way. A store is its folder: a later session opens it by
path and goes on. One writer at a time.

Totals are sums over small tables by key; keys whose documents are all gone disappear.
Partial sums come before the shuffle, so a source with a third of all rows is harmless.

Cases: null or empty text has no tokens but is a document. Null sources and languages are
keys of their own. Repeated rows count each, whatever their ids. Extra columns are ignored. Texts of
any length are counted whole. An empty table has no totals. Sums know no ties.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kit import Manifest, TextView, Workspace, slices
from .tokens import Encoder

KEYS = ["source", "lang", "tokenizer"]
WORDS_VERSION, BPE_VERSION = "words-1", "byte_bpe_50k-1"
_DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


class Rollup:
    """Totals by source, language and tokenizer version in a folder all executors share."""

    def __init__(self, spark: SparkSession, store: Workspace, name: str = "rollup"):
        self.spark, self.store, self.name = spark, store, name
        self.manifest = Manifest(store, name)

    def _path(self, batch_id: str) -> str:
        return f"{self.name}/batch-{batch_id}"

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add a batch once; false if it was there."""
        if batch_id in self.manifest.names("batch") + self.manifest.names("folded"):
            return False
        summed = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        self.store.save(summed.filter("docs <> 0 or tokens <> 0"), self._path(batch_id))
        self.manifest.save([*self.manifest.rows, ("batch", batch_id)])
        return True

    def _sum(self) -> DataFrame:
        names = [*self.manifest.names("base"), *map(self._path, self.manifest.names("batch"))]
        parts = [self.spark.read.schema(_DELTA).parquet(self.store.path(n)) for n in names]
        parts = parts or [self.spark.createDataFrame([], _DELTA)]
        return reduce(DataFrame.unionByName, parts).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def fold(self) -> None:
        """Sum everything into a new base; later retries of its batches stay ignored."""
        spent = [*self.manifest.names("base"), *map(self._path, self.manifest.names("batch"))]
        base = f"{self.name}/base-{self.manifest.version + 1}"
        self.store.save(self._sum(), base)
        folded = self.manifest.names("folded") + self.manifest.names("batch")
        self.manifest.save([("base", base), *(("folded", x) for x in folded)])
        for name in spent:
            self.store.drop(name)

    def totals(self) -> DataFrame:
        return self._sum().filter("docs <> 0 or tokens <> 0").select(*KEYS, F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens"))


def counted(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, source, lang, words, bpe of every row: counts over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            for part, texts in slices(batch):
                view = TextView(texts)
                view.words()
                bpe = [encoder.count(t or "") for t in texts.to_pylist()]
                words = (view.first[1:] - view.first[:-1]).astype("int64")
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(words), pa.array(bpe, pa.int64())], names=["doc_id", "source", "lang", "words", "bpe"])

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), "text").mapInArrow(run, "doc_id long, source string, lang string, words long, bpe long")


def deltas(rows: DataFrame, sign: int, columns: dict[str, str]) -> DataFrame:
    """Signed rows of counted documents; ``columns`` maps a tokenizer version to its count."""
    one = [F.struct(F.lit(v).alias("tokenizer"), F.expr(c).cast("long").alias("n")) for v, c in columns.items()]
    out = rows.select("source", "lang", F.explode(F.array(*one)).alias("x"))
    return out.select("source", "lang", "x.tokenizer", F.lit(sign).cast("long").alias("docs"), (F.col("x.n") * sign).alias("tokens"))


def maintained(docs: DataFrame, batches: int = 4, tokenizer: str | None = None, store: Workspace | None = None) -> DataFrame:
    """Totals of a table that arrives in batches, by way of the rollup.

    Each batch enters with its word counts and a provisional BPE count (five quarters of its
    words); the next commit revises that to the real count. One batch is also deleted
    and entered again, and every commit is retried once. The totals are those of the
    whole table.
    """
    spark = docs.sparkSession
    store = store or Workspace(spark)
    rows = store.save(counted(docs, tokenizer).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "counted")
    rollup = Rollup(spark, store)
    exact, rough = {WORDS_VERSION: "words", BPE_VERSION: "bpe"}, {WORDS_VERSION: "words", BPE_VERSION: "words * 5 div 4"}
    for k in range(batches):
        part = rows.filter(F.col("part") == k)
        commits = {
            f"enter-{k}": deltas(part, 1, rough),
            f"revise-{k}": deltas(part, -1, {BPE_VERSION: rough[BPE_VERSION]}).unionByName(deltas(part, 1, {BPE_VERSION: "bpe"})),
        }
        if k == 0:
            commits |= {"delete-0": deltas(part, -1, exact), "again-0": deltas(part, 1, exact)}
        for name, change in commits.items():
            rollup.commit(name, change)
            rollup.commit(name, change)  # a retry changes nothing
        if k == batches // 2:
            rollup.fold()
    return rollup.totals()
