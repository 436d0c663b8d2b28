"""Line dedup: levelled sorted runs of line digests, DataFrame functions only.

A line's key is the line without white space at its ends and with A-Z in lower
case. A key found in at least ``least`` documents is frequent, and all its lines
go, in every document.

Documents arrive in batches. The state is a set of written runs, each a table of keys and
counts bucketed and sorted by key, and a manifest that names them and the number of buckets; a
store is opened by its folder and goes on where it stopped, and an ``add`` that broke off left no trace.
``LineRuns.add`` counts a batch's keys and merge-joins them with the runs on their order, each read
as it lies, without exchange or sort: keys of the frequent runs are anti-joined away, counts of
the other runs are added, keys that reach the threshold become a frequent run, and the rest is the
batch's own new run. When a level holds ``fanout`` runs, they are compacted into one of the next
level, without the keys that have become frequent since. There are as many buckets as keep
BUCKET_KEYS keys in each, up to Spark's own limit for bucketed tables.

Only digests (two hashes of 64 bits over different bytes), counts and places are shuffled, after a
partial sum where they are counted, so a line that a third of all documents share costs one row a task. Texts move
once, to meet their own document's flags, one a line, which say what stays; a line's flag is found by
its place, so a document costs time in proportion to its lines, however many of them are frequent.
Frequent lines are found by a join that Spark may broadcast if the frequent run is small enough, and deals by key otherwise.

Cases: null or empty text is one empty line; empty lines are never dropped.
Repeated rows are counted as documents of their own. Null doc_ids are
kept. Extra columns, of any name, stay inside the ``doc`` struct. Texts of any length are split
whole. An empty table gives an empty one. Nothing is ordered, so there are no ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kit import Manifest, Workspace

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]
BUCKET_KEYS, MOST_BUCKETS = 500_000, 100_000
SCAN_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    """Stripped, A-Z in lower case; ASCII lines take the faster function."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def digest(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.concat(F.lit("2"), key)).alias("h2"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_digests(keys: Column) -> Column:
    """A digest for each line, null for an empty one."""
    return F.transform(keys, lambda k: F.when(k != "", digest(k)))


def distinct_digests(keys: Column) -> Column:
    return F.transform(F.filter(F.array_distinct(keys), lambda k: k != ""), digest)


class LineRuns:
    """Runs of (h1, h2, n) by level, and runs of frequent keys, in a folder that outlives the session."""

    SCHEMA = "h1 long, h2 long, n long"

    def __init__(self, spark: SparkSession, store: Workspace, least: int = 10, fanout: int = 3, buckets: int = 16):
        self.spark, self.store, self.least, self.fanout = spark, store, least, fanout
        self.manifest = Manifest(store, "runs")
        self.buckets = int(*self.manifest.names("buckets") or [buckets])
        self.runs = [(k, n) for k, n in self.manifest.rows if k != "buckets"]
        self.made: list[str] = []

    def _table(self, name: str) -> str:
        return f"run_{hashlib.sha256(self.store.root.encode()).hexdigest()[:24]}_{name.replace('-', '_')}"

    @contextmanager
    def _in_order(self) -> Iterator[None]:
        """Queries that run meanwhile trust the order of a bucket's single file."""
        before = self.spark.conf.get(SCAN_ORDER)
        self.spark.conf.set(SCAN_ORDER, "true")
        try:
            yield
        finally:
            self.spark.conf.set(SCAN_ORDER, before)

    def _write(self, run: DataFrame, name: str) -> DataFrame:
        table = self._table(name)
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        dealt = run.select(*KEY, "n").repartition(self.buckets, *KEY).sortWithinPartitions(*KEY)
        dealt.write.mode("overwrite").bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet").option("path", self.store.path(name)).saveAsTable(table)
        self.made.append(name)
        return self.spark.table(table)

    def _run(self, name: str) -> DataFrame:
        """The run of that name; a reopened store's files are declared to the session again."""
        path = self.store.path(name)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._table(name)} (h1 BIGINT, h2 BIGINT, n BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(self._table(name))

    def _met(self, batch: DataFrame) -> DataFrame:
        """The batch's keys that are not frequent yet, with their counts in it and in all."""
        for kind, name in self.runs:
            if kind == "frequent":
                batch = batch.join(self._run(name).hint("merge"), KEY, "left_anti")
        batch = batch.withColumn("total", F.col("n"))
        for kind, name in self.runs:
            if kind != "frequent":
                run = self._run(name).withColumnRenamed("n", "before").hint("merge")
                batch = batch.join(run, KEY, "left").select(*KEY, "n", (F.col("total") + F.coalesce("before", F.lit(0))).alias("total"))
        return batch

    def add(self, digests: DataFrame) -> None:
        """One batch: a row (h1, h2) for each distinct key of each document."""
        v = self.manifest.version + 1
        batch = self._write(digests.groupBy(*KEY).agg(F.count("*").alias("n")), f"batch-{v}")
        with self._in_order():
            batch = self.store.save(self._met(batch), f"met-{v}")
        rows = list(self.runs)
        for kind, test in (("frequent", F.col("total") >= self.least), ("0", F.col("total") < self.least)):
            self._write(batch.filter(test), f"{kind}-{v}")
            rows.append((kind, f"{kind}-{v}"))
        rows, level = self._compacted(rows, "frequent", "frequent", v), 0
        while sum(k == str(level) for k, _ in rows) >= self.fanout:
            rows, level = self._compacted(rows, str(level), str(level + 1), v), level + 1
        gone = {n for _, n in self.runs} - {n for _, n in rows}
        self.runs = rows
        self.manifest.save([("buckets", str(self.buckets)), *rows])
        self._drop([f"batch-{v}", *gone])
        self.store.drop(f"met-{v}")

    def _compacted(self, rows: list[tuple[str, str]], kind: str, into: str, v: int) -> list[tuple[str, str]]:
        """The runs of a level merged into one of the next, if there are ``fanout``."""
        names = [n for k, n in rows if k == kind]
        if len(names) < self.fanout:
            return rows
        merged = reduce(DataFrame.unionByName, map(self._run, names)).groupBy(*KEY).agg(F.sum("n").alias("n"))
        if kind != "frequent":
            for k, n in rows:
                merged = merged.join(self._run(n).hint("merge"), KEY, "left_anti") if k == "frequent" else merged
        self._write(merged, f"{into}-merged-{v}")
        return [(k, n) for k, n in rows if n not in names] + [(into, f"{into}-merged-{v}")]

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
            self.store.drop(name)

    def close(self) -> None:
        """Remove the runs of a store that takes no more batches."""
        self._drop(self.made)

    def frequent_keys(self) -> DataFrame:
        """Every key in at least ``least`` documents of all batches so far."""
        runs = [self._run(n).select(*KEY) for k, n in self.runs if k == "frequent"]
        return reduce(DataFrame.unionByName, runs) if runs else self.spark.createDataFrame([], "h1 long, h2 long")


def drop_frequent_lines(docs: DataFrame, least: int = 10, batches: int = 4, fanout: int = 3, store: Workspace | None = None) -> DataFrame:
    """(doc struct of all input columns, n_lines, n_dropped, kept text)."""
    spark = docs.sparkSession
    store = store or Workspace(spark)
    row = [F.xxhash64("doc.doc_id", "doc.text").alias("r1"), F.xxhash64(F.concat(F.lit("2"), "doc.text"), "doc.doc_id").alias("r2")]
    rows = docs.select(F.struct("*").alias("doc")).select("doc", *row)
    keyed = rows.select("r1", "r2", F.transform(lines_of(F.col("doc.text")), line_key).alias("keys"))
    keyed = keyed.select("r1", "r2", line_digests(F.col("keys")).alias("all"), distinct_digests(F.col("keys")).alias("keys"))
    repeats = F.size(F.filter("all", lambda d: d.isNotNull())) > F.size("keys")
    keyed = keyed.select("r1", "r2", "all", F.when(repeats, F.col("keys")).alias("keys"), F.pmod("r1", F.lit(batches)).cast("int").alias("batch"))
    keyed = store.save(keyed, "keyed", by=["batch"])

    n_keys = keyed.agg(F.sum(F.size("all").cast("long"))).first()[0] or 0
    runs = LineRuns(spark, store, least, fanout, min(MOST_BUCKETS, max(4, n_keys // BUCKET_KEYS)))
    for k in range(batches):
        own = keyed.filter(F.col("batch") == k).select(F.explode(F.coalesce("keys", "all")).alias("k"))
        runs.add(own.filter("k is not null").select("k.*"))
    frequent = runs.frequent_keys()

    placed = keyed.select("r1", "r2", F.posexplode("all").alias("place", "k")).filter("k is not null")
    hits = placed.select("r1", "r2", "place", "k.*").join(frequent, KEY, "left_semi")
    hits = hits.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("place")).alias("places"))
    hits = store.save(hits, "hits").select("r1", "r2", stays(F.col("places")).alias("stays"))
    hits = store.save(hits, "flags")
    runs.close()
    store.drop("keyed")
    store.drop("hits")
    store.release()
    lines = lines_of(F.col("doc.text"))
    kept = F.filter(lines, lambda x, i: F.coalesce(F.get("stays", i), F.lit(True)))
    out = rows.join(hits, ["r1", "r2"], "left").select("doc", F.size(lines).cast("long").alias("n_lines"), F.when(F.col("stays").isNotNull(), kept).alias("some"))
    dropped = F.when(F.col("some").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("some")).cast("long")
    text = F.coalesce(F.array_join("some", "\n"), "doc.text", F.lit(""))
    return out.select("doc", "n_lines", dropped.alias("n_dropped"), text.alias("kept"))


def stays(places: Column) -> Column:
    """Flags of the lines up to the last dropped one, from the ascending places of those that go."""
    gaps = F.transform(places, lambda p, j: F.array_append(F.array_repeat(F.lit(True), p - F.coalesce(F.get(places, j - 1), F.lit(-1)) - 1), F.lit(False)))
    return F.flatten(gaps)


ORACLE = """
WITH r AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM r),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, count(DISTINCT r) >= 10 AND key <> '' AS often FROM k GROUP BY key)
SELECT max(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE often) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT often), '')) AS kept_sha256
FROM k JOIN f USING (key) GROUP BY r
"""
