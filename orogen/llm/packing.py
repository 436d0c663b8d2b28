"""Best-fit packing: plan over the histogram of lengths, place by rank.

1. Every text becomes token ids with one end id; longer ones are cut into pieces
   of ``size`` tokens, of which the first may be shorter. Only the piece table
   (no ids) is written.
2. The histogram of piece lengths has at most ``size`` rows and is all
   the driver sees. Best-fit decreasing runs over its counts: as many pieces
   of a length as there are open sequences of the tightest fitting gap go there
   in one step. A step is a run of consecutive ranks of a length, sequence
   numbers and one offset; the plan's size follows the number of distinct
   lengths and gaps, not of documents.
3. A piece's rank within its length is the rank within (length, salt) plus what
   earlier salts hold; there are as many salts as keep some ten thousand pieces in each. Pieces
   then join the plan on (length, rank div CHUNK), a step standing in every chunk of ranks that
   it touches. No length, however common, meets in one task.

Ids are the tokenizers library's; a special token's string in a text is one id.

Cases: null or empty text is the end id alone. Texts of any length are taken whole. Repeated
rows are packed each; equal rows may trade places, which changes nothing. Null doc_ids are packed like
others. Extra columns of documents are ignored; those of a table of pieces stay,
whatever their names, but for ``sequence_id`` and ``offset``, which are replaced. An
empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kit import Workspace, slices
from .tokens import Encoder

SIZE, END = 2048, 0
CHUNK, A_SALT = 4096, 20_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of every row; ``with_ids`` adds their token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            for part, texts in slices(batch):
                rows: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), texts.to_pylist(), strict=True):
                    ids = np.append(encoder.ids(text or ""), np.uint32(end)).astype("<u4")
                    cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
                    rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b] if with_ids else None) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(x, t) for x, t in zip(columns, kinds, strict=False)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(columns[5], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECES + (", ids array<int>" if with_ids else ""))


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, number, first sequence, offset).

    Open sequences are kept by their gap as runs of sequence numbers.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    steps, opened = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        for gap in sorted(g for g in gaps if g >= length):
            runs = gaps.pop(gap)
            while runs and left:
                first, n = runs.pop()
                take = min(n, left)
                if n > take:
                    runs.append((first + take, n - take))
                steps.append((length, rank, take, first, size - gap))
                gaps[gap - length].append((first, take))
                rank, left = rank + take, left - take
            if runs:
                gaps[gap] += runs
            if not left:
                break
        per = size // length
        while left:  # new sequences: as many of this length as fit in each
            n = max(1, left // per)
            each = min(per, left)
            for k in range(each):
                steps.append((length, rank, n, opened, k * length))
                rank += n
            gaps[size - each * length].append((opened, n))
            opened, left = opened + n, left - n * each
    return steps


def pack(cut: DataFrame, size: int = SIZE, store: Workspace | None = None) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces; other columns of it are kept."""
    spark = cut.sparkSession
    store = store or Workspace(spark)
    rows = store.save(cut.drop("sequence_id", "offset").select(F.struct("*").alias("row")), "pieces")
    salts = max(64, rows.count() // A_SALT)
    rows = rows.select("row", F.col("row.length").alias("length"), F.pmod(F.xxhash64("row.doc_id", "row.piece"), F.lit(salts)).alias("salt"))
    counts = store.save(rows.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts")
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "salt").orderBy("row.doc_id", "row.piece", "row.start", F.xxhash64("row"))
    ranked = rows.withColumn("place", F.row_number().over(order)).join(base, ["length", "salt"])
    ranked = ranked.select("row", "length", (F.col("base") + F.col("place") - 1).alias("rank"))
    ranked = ranked.withColumn("chunk", F.expr(f"rank div {CHUNK}"))
    steps = spark.createDataFrame(plan(histogram, size), "length long, first_rank long, number long, first_sequence long, offset long")
    steps = steps.withColumn("chunk", F.explode(F.expr(f"sequence(first_rank div {CHUNK}, (first_rank + number - 1) div {CHUNK})")))
    placed = ranked.join(steps, ["length", "chunk"]).filter("rank >= first_rank and rank < first_rank + number")
    return placed.select("row.*", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")
