"""Suffix-array dedup: shard Burrows-Wheeler transforms merged by interleave refinement.

Every byte covered by a ``SPAN``-byte string that also starts in a document with a
smaller doc_id is removed. Strings are judged on the input.

1. Candidates. A span's anchor is its least-hashed ``GRAM``-byte string, leftmost
   on ties: a function of the span's bytes, so equal spans have equal anchors. Spans of
   a document that share an anchor follow one another and form a run. Runs are dealt by
   anchor to groups of bounded size. A run whose anchor is in no other document
   has no repeated span. Within a batch of documents and within a group, runs with
   equal bytes are represented by their smallest document; the others are removed.
   This decides anchors that have one content. Nothing is lost: only equal strings meet.
2. Merging. Anchors with several contents keep their distinct runs. A group's
   runs are split into shards; each shard's suffixes are ordered to
   SPAN symbols at least and give its transform. The transforms are merged by Holt and
   McMillan's method: the interleave starts as a concatenation and is dealt stably
   by symbol once for each symbol of depth, which sorts all suffixes by that many
   symbols without comparing any. The round in which two neighbours part is their
   common prefix, so after SPAN rounds the undivided intervals are the repeated spans.
3. Spans whose interval holds a smaller doc_id are removed; runs of one document unite.

An anchor with more distinct runs than ``HOT`` is dealt again by hashes of its
single spans, so no group grows with a common phrase's surroundings.

Cases: null or empty text has no bytes. Repeated rows share a doc_id, so neither
removes the other; where there are any, doc_ids must lie within 42 bits. A null
doc_id neither removes nor loses bytes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kit import U64, TextView, Workspace, mix, prefix_hashes, range_hashes, slices

SPAN, GRAM, SALTS = 50, 22, 64
WIDTH = SPAN - GRAM + 1
BATCH_BYTES, GROUP_RUNS, GROUP_BYTES, HOT = 16_000_000, 300_000, 200_000, 32_768
_PLACE = (1 << 31) - 1


# Candidate runs -----------------------------------------------------------------------------------


def runs(view: TextView) -> tuple[np.ndarray, ...]:
    """(anchor hash, content hash, document, first span in it, number of spans) of all runs."""
    data, off = view.data, view.off
    n = len(data) - SPAN + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    prefix = prefix_hashes(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = range_hashes(prefix, at, at + GRAM)
    least = np.concatenate([(gram & ~U64(_PLACE)) | at.astype(np.uint64), np.full(-len(gram) % WIDTH, ~U64(0))]).reshape(-1, WIDTH)
    ahead = np.minimum.accumulate(least, axis=1).ravel()
    behind = np.minimum.accumulate(least[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[:n], ahead[WIDTH - 1 : WIDTH - 1 + n]) & U64(_PLACE)).astype(np.int64)
    turns = np.zeros(len(data) + 2, np.int32)
    stops = np.maximum(off[1:] - SPAN + 1, off[:-1])  # spans of a document start before this
    np.add.at(turns, off[:-1], 1)
    np.add.at(turns, stops, -1)
    whole = np.cumsum(turns)[:n] > 0
    fresh = np.ones(n, bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | ~whole[:-1]
    fresh[off[:-1][off[:-1] < n]] = True
    begin = np.flatnonzero(whole & fresh)
    doc = np.searchsorted(off, begin, side="right") - 1
    end = np.minimum(np.append(begin[1:], n), stops[doc])
    return gram[anchor[begin]], range_hashes(prefix, begin, end + SPAN - 1), doc, begin - off[doc], end - begin


def _planes(x: np.ndarray) -> np.ndarray:
    """Bytes of a 64-bit array, byte by byte: high bytes are mostly zero and compress well."""
    return x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T


def _pack(anchor: np.ndarray, content: np.ndarray, key: np.ndarray, lo: np.ndarray, n: np.ndarray) -> bytes:
    order = np.argsort(anchor)
    first = np.diff(anchor[order], prepend=U64(0))
    return b"".join(x.tobytes() for x in (_planes(first)[:6], _planes(content[order])[:6], _planes(key[order]), _planes(lo[order])[:4], n[order].astype(np.uint8)))


def _unpack(body: bytes) -> tuple[np.ndarray, ...]:
    rows = np.frombuffer(body, np.uint8).reshape(25, -1)

    def whole(a: int, b: int) -> np.ndarray:
        out = np.zeros((8, rows.shape[1]), np.uint8)
        out[: b - a] = rows[a:b]
        return np.ascontiguousarray(out.T).view(np.uint64).ravel()

    return np.cumsum(whole(0, 6), dtype=np.uint64), whole(6, 12), whole(12, 20).view(np.int64), whole(20, 24).view(np.int64), rows[24].astype(np.int64)


def _dealt(docs: DataFrame, groups: int, shift: int) -> DataFrame:
    """Runs by group, packed; and what is already known to go: (group, body, key, start, stop)."""
    schema = "group int, body binary, key long, start long, stop long"

    def flush(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        anchor, content, key, lo, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        anchor = anchor & U64((1 << 48) - 1)
        order = np.lexsort((key, content))
        anchor, content, key, lo, n = (x[order] for x in (anchor, content, key, lo, n))
        first = np.flatnonzero(np.append(True, content[1:] != content[:-1])) if len(content) else np.zeros(0, np.int64)
        smallest = np.repeat(key[first], np.diff(np.append(first, len(content))))
        gone = (key >> shift) > (smallest >> shift)
        start, stop, whose = lo[gone], lo[gone] + n[gone] + SPAN - 1, key[gone]
        order = np.lexsort((start, whose))
        start, stop, whose = start[order], stop[order], whose[order]
        if len(start):
            where = np.flatnonzero(np.append(True, (whose[1:] != whose[:-1]) | (start[1:] > stop[:-1])))  # runs follow one another
            start, whose, stop = start[where], whose[where], stop[np.append(where[1:], len(stop)) - 1]
        count = len(start)
        names = ["group", "body", "key", "start", "stop"]
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(np.mod(whose, groups), pa.int32()), pa.nulls(count, pa.binary()), pa.array(whose), pa.array(start), pa.array(stop)], names=names)
        anchor, content, key, lo, n = (x[~gone] for x in (anchor, content, key, lo, n))
        group = (mix(anchor) % U64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        filled, first = np.unique(group[order], return_index=True)
        bodies = [_pack(anchor[rows], content[rows], key[rows], lo[rows], n[rows]) for rows in np.split(order, first[1:])] if len(order) else []
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(bodies, pa.binary()), *(pa.nulls(len(bodies), pa.int64()) for _ in range(3))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for rows, text in slices(batch):
                view = TextView(text)
                anchor, content, doc, lo, n = runs(view)
                parts.append((anchor, content, rows.column(0).to_numpy(zero_copy_only=False)[doc].astype(np.int64), lo, n))
                size += len(view.data)
                if size >= BATCH_BYTES:
                    yield from flush(parts)
                    parts, size = [], 0
        if parts:
            yield from flush(parts)

    return docs.mapInArrow(run, schema)


_DECIDED = "key long, start long, stop long, anchor long, hot boolean"


def _decide(shift: int):
    """Of a group's runs: what goes already (anchor null), and what is left to merge."""

    def run(table: pa.Table) -> pa.Table:
        known = table.filter(pc.is_null(table.column("body")))
        out = [(known.column("key").to_numpy(), known.column("start").to_numpy(), known.column("stop").to_numpy(), None, None)]
        bodies = [x for x in table.column("body").to_pylist() if x is not None]
        if bodies:
            anchor, content, key, lo, n = (np.concatenate(x) for x in zip(*map(_unpack, bodies), strict=True))
            order = np.lexsort((key, content, anchor))
            anchor, content, key, lo, n = (x[order] for x in (anchor, content, key, lo, n))
            head = np.append(True, anchor[1:] != anchor[:-1])
            same = np.append(True, (content[1:] != content[:-1]) | head[1:])
            of, by = np.cumsum(head) - 1, np.flatnonzero(same)
            first = np.flatnonzero(head)
            low, high = np.minimum.reduceat(key, first), np.maximum.reduceat(key, first)
            shared = ((low >> shift) != (high >> shift))[of]
            kinds = np.add.reduceat(same.astype(np.int64), first)[of]
            smallest = np.repeat(key[by], np.diff(np.append(by, len(key))))
            gone = shared & ((key >> shift) > (smallest >> shift))
            rest = shared & ~gone & (kinds > 1)
            out.append((key[gone], lo[gone], lo[gone] + n[gone] + SPAN - 1, None, None))
            out.append((key[rest], lo[rest], lo[rest] + n[rest] + SPAN - 1, anchor[rest], kinds[rest] > HOT))
        parts = [pa.table({"key": pa.array(k, pa.int64()), "start": pa.array(a, pa.int64()), "stop": pa.array(b, pa.int64()), "anchor": pa.array(x.view(np.int64)) if x is not None else pa.nulls(len(k), pa.int64()), "hot": pa.array(h, pa.bool_()) if h is not None else pa.nulls(len(k), pa.bool_())}) for k, a, b, x, h in out]
        return pa.concat_tables(parts)

    return run


def _cut_out(rows: DataFrame, groups: int) -> DataFrame:
    """The bytes of the runs left to merge: (group, key, start, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, bodies, where = [], [], [], []
            for key, text, open_runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                for x in open_runs:
                    step = 1 if x["hot"] else x["stop"] - x["start"]
                    for a in range(x["start"], x["stop"] - SPAN + 1, step):
                        body = data[a : min(a + step + SPAN - 1, x["stop"])]
                        keys.append(key)
                        starts.append(a)
                        bodies.append(body)
                        where.append(hash_of(body) % groups if x["hot"] else x["anchor"] % groups)
                if len(bodies) > 20_000:
                    yield out(where, keys, starts, bodies)
                    keys, starts, bodies, where = [], [], [], []
            if bodies:
                yield out(where, keys, starts, bodies)

    def hash_of(body: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(body, digest_size=6).digest(), "little")

    def out(where: list, keys: list, starts: list, bodies: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(bodies, pa.binary())], names=["group", "key", "start", "body"])

    return rows.mapInArrow(run, "group int, key long, start long, body binary")


# Transforms and their merge -----------------------------------------------------------------------


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes by their first ``depth`` symbols at least, up to the end mark 0."""
    n = len(symbols)
    marks = np.flatnonzero(symbols == 0)
    rest = marks[np.searchsorted(marks, np.arange(n))] - np.arange(n)
    bits = 8 * symbols.dtype.itemsize
    known = 64 // bits
    padded = np.append(symbols.astype(np.uint64), np.zeros(known, np.uint64))
    key = np.zeros(n, np.uint64)
    for j in range(known):
        key = (key << U64(bits)) | np.where(j < rest, padded[j : n + j], U64(0))
    while True:
        order = np.argsort(key)
        if known >= depth:
            return order
        ordered = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
        after = np.where(rest > known, rank[np.minimum(np.arange(n) + known, n - 1)] + U64(1), U64(0))
        key = rank * U64(n + 1) + after
        known *= 2


def transform_of(symbols: np.ndarray, order: np.ndarray, step: int) -> np.ndarray:
    """The ``step`` symbols (1 or 2) before each suffix, in order, each text being a ring with its end mark."""
    marks = np.flatnonzero(symbols == 0)
    end = marks[np.searchsorted(marks, order)]
    first = np.append(0, marks[:-1] + 1)[np.searchsorted(marks, order)]
    before = np.where(order > first, order - 1, end)
    if step == 1:
        return symbols[before]
    twice = np.where(before > first, before - 1, end)
    return (symbols[twice].astype(np.uint16) << 8) | symbols[before]


def interleave(transforms: list[np.ndarray], depth: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Merge transforms: which shard each suffix comes from, and common prefixes with
    the suffix before, up to ``depth`` and in whole steps.

    Each round deals the interleave stably by symbol, or by pair with a step of 2. A
    place parts from the one before it when their symbols differ or the places they came
    from have parted.
    """
    which = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    n = len(which)
    prefix = np.full(n, depth, np.int16)
    prefix[:1] = 0
    parted = np.zeros(n, bool)
    parted[:1] = True
    kind = np.zeros(n, np.int32)
    symbol = np.empty(n, transforms[0].dtype)
    for k in range(0, depth, step):
        for s, t in enumerate(transforms):
            symbol[which == s] = t
        deal = np.argsort(symbol, kind="stable")
        dealt, which, kind = symbol[deal], which[deal], kind[deal]
        new = np.empty(n, bool)
        new[:1] = True
        new[1:] = (dealt[1:] != dealt[:-1]) | (kind[1:] != kind[:-1])
        fresh = new & ~parted
        if not fresh.any():  # classes no longer divide, nor will they later
            break
        prefix[fresh] = k
        parted = new
        kind = np.cumsum(parted, dtype=np.int32)
    return which, prefix


def _merge(shift: int, shards: int = 2):
    """Of one group's runs: the spans of which a smaller document has a copy."""

    def run(table: pa.Table) -> pa.Table:
        key, start = table.column("key").to_numpy(), table.column("start").to_numpy()
        column = table.column("body").combine_chunks().cast(pa.large_binary())
        _, offsets, body = column.buffers()
        off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(body, np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        used = np.unique(data)
        step = 2 if len(used) < 256 and SPAN % 2 == 0 else 1
        code = np.zeros(256, np.uint8 if step == 2 else np.uint16)
        code[used] = np.arange(1, len(used) + 1)
        bounds = np.searchsorted(off, np.linspace(0, len(data), shards + 1)[1:-1])
        bounds = [0, *bounds.tolist(), len(off) - 1]
        transforms, places = [], []
        for a, b in zip(bounds, bounds[1:], strict=False):
            if a == b:
                continue
            ends = off[a + 1 : b + 1] - off[a]
            symbols = np.insert(code[data[off[a] : off[b]]], ends, 0)
            order = suffix_order(symbols, SPAN)
            transforms.append(transform_of(symbols, order, step))
            string = np.repeat(np.arange(a, b), np.diff(off[a : b + 1]) + 1)
            inside = np.arange(len(symbols)) - (off[string] - off[a] + string - a)
            places.append((string[order], inside[order]))
        which, prefix = interleave(transforms, SPAN, step)
        string, inside = np.empty(len(which), np.int64), np.empty(len(which), np.int64)
        for s, (x, y) in enumerate(places):
            string[which == s], inside[which == s] = x, y
        span = inside + SPAN <= off[string + 1] - off[string]
        interval = np.flatnonzero(prefix < SPAN)
        low = np.minimum.reduceat(np.where(span, key[string], np.iinfo(np.int64).max), interval)
        low = np.repeat(low, np.diff(np.append(interval, len(which))))
        gone = span & ((key[string] >> shift) > (low >> shift))
        whose, at = key[string[gone]], start[string[gone]] + inside[gone]
        order = np.lexsort((at, whose))
        whose, at = whose[order], at[order]
        head = np.flatnonzero(np.append(True, (whose[1:] != whose[:-1]) | (at[1:] != at[:-1] + 1))) if len(at) else at
        last = np.append(head[1:], len(at)) - 1 if len(at) else at
        return pa.table({"key": pa.array(whose[head], pa.int64()), "start": pa.array(at[head], pa.int64()), "stop": pa.array(at[last] + SPAN, pa.int64())})

    return run


# The operator -------------------------------------------------------------------------------------


def _numbered(docs: DataFrame, store: Workspace) -> tuple[DataFrame, int]:
    """Rows with a key of their own, and how many low bits tell rows of one doc_id apart.

    The key is the doc_id where no id repeats. Otherwise the id, or its rank among all ids where
    it is too large, is followed by a number within the id, as wide as the most repeated id needs.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    named = docs.filter("doc_id is not null")
    salt = F.pmod(F.xxhash64("text"), F.lit(SALTS))
    found = named.groupBy("doc_id", salt.alias("salt")).agg(F.count("*").alias("n"))
    found = found.groupBy("doc_id").agg(F.sum("n").alias("n"), F.max("n").alias("salted"))
    most, salted, low, high = found.agg(F.max("n"), F.max("salted"), F.min("doc_id"), F.max("doc_id")).first()
    if not most or most == 1:
        return docs.withColumn("key", F.col("doc_id")), 0
    shift = (salted * SALTS - 1).bit_length()
    if max(abs(low), abs(high)) >> (62 - shift):
        ids = store.save(named.select("doc_id").distinct().repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ids")
        sizes = sorted((r["part"], r["n"]) for r in ids.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row a range
        base = docs.sparkSession.createDataFrame([(p, sum(n for q, n in sizes if q < p)) for p, _ in sizes], "part int, base long")
        rank = F.row_number().over(Window.partitionBy("part").orderBy("doc_id")) - 1 + F.col("base")
        docs = docs.join(ids.join(base, "part").select("doc_id", rank.alias("at")), "doc_id", "left")
    else:
        docs = docs.withColumn("at", F.col("doc_id"))
    number = (F.row_number().over(Window.partitionBy("doc_id", salt).orderBy(F.xxhash64("text"))) - 1) * SALTS + salt
    key = F.when(F.col("doc_id").isNotNull(), F.shiftleft(F.col("at"), shift) + number)
    return docs.withColumn("key", key.cast("long")).drop("at"), shift


def remove_repeats(docs: DataFrame, with_kept: bool = True, store: Workspace | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and ``kept``, the remaining bytes."""
    store = store or Workspace(docs.sparkSession)
    docs, shift = _numbered(docs, store)
    if shift:
        docs = store.save(docs, "numbered")
    keyed = docs.filter("key is not null").select("key", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(8, 2 * size // (WIDTH * GROUP_RUNS) + 1)
    decided = _dealt(keyed, groups, shift).groupBy("group").applyInArrow(_decide(shift), _DECIDED)
    decided = store.save(decided, "decided")
    store.release()
    left = decided.filter("anchor is not null")
    volume = left.agg(F.sum(F.when(F.col("hot"), (F.col("stop") - F.col("start") - SPAN + 1) * SPAN).otherwise(F.col("stop") - F.col("start")))).first()[0] or 0
    spans = decided.filter("anchor is null").select("key", "start", "stop")
    if volume:
        listed = left.groupBy("key").agg(F.collect_list(F.struct("start", "stop", "anchor", "hot")).alias("open"))
        pieces = _cut_out(keyed.join(listed, "key").select("key", "text", "open"), int(volume // GROUP_BYTES + 1))
        merged = pieces.groupBy("group").applyInArrow(_merge(shift), "key long, start long, stop long")
        spans = spans.unionByName(store.save(merged, "merged"))
        store.release()
    gone = spans.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("gone"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, listed in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = (text or "").encode()
                if listed.is_valid:
                    pairs = listed.values
                    a, b = pairs.field(0).to_numpy(), pairs.field(1).to_numpy()
                    order = np.argsort(a)
                    a, b = a[order], np.maximum.accumulate(b[order])
                    head = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
                    a, b = a[head].tolist(), b[np.append(head[1:], len(a)) - 1].tolist()
                    kept = b"".join(data[x:y] for x, y in zip([0, *b], [*a, len(data)], strict=True))
                else:
                    a, kept = [], data
                rows.append((len(data), len(data) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept))
            n, removed, spans, digest, kept = zip(*rows, strict=True) if rows else ((),) * 5
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_kept:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    return docs.join(gone, "key", "left").select("doc_id", "text", "gone").mapInArrow(apply, schema)
