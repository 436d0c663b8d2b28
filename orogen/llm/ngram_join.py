"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersection.

Two documents link when the Jaccard similarity of their shingle sets reaches
``num / den``. With |x| + |y| known, that bounds the symmetric difference d by
(|x| + |y|) (den - num) / (den + num). The join uses the bound twice.

Tiles. Set sizes fall into bands, and linked sets meet in one of them. Shingles have one
order: first by how common they are, then by hash. Of two sets with an overlap of o or more,
the first |x| - o + l and |y| - o + l shingles in that order share l or more, whatever the
order. A tile is (band, shingle), and a set enters the tiles of its first shingles only. Common
ones come last, so a passage that a third of all documents hold makes a tile only of sets
that are nearly made of it.

Chance meetings. Other sets fall into 64 buckets by content. Of a set's tiles of a band, only those stay that hold a bucket
met in l of them or more: a linked set's bucket is, so no link is lost, while chance meetings are spread
over the buckets. A tile of which one batch has several members counts for every bucket. This comes first of all, since what
sets meet by chance grows with the square of the corpus.

How common a shingle is, is read from counts of all documents' shingles in 2^20 buckets, as the
number of binary digits by which its bucket exceeds twice the mean. The counts
have one size for any corpus; any order gives the same links, a good one fewer candidates.

Bitmaps. Each set carries parity bits of its shingle hashes, at least twice as many as
shingles, from 256 to 2^16; the longer of two is folded. The number of differing bits never exceeds d,
so it bounds the overlap from above. Only pairs within the bound get their sorted
arrays intersected.

Links within a tile. A task pairs the members of a tile with the smallest of its batch, and a
tile's group pairs these leaders with the smallest of all: the pairs are few, and a
tile that a third of all documents share costs its group one row a batch. Most tiles,
even hot ones, become one component this way.

Tiles that still hold several components. A family of edited texts shares many tiles, each with a few members less, so those
with one leader are laid together where their comparisons do not grow by more than four times: a document then
is in a few blocks, however many tiles and relatives it has. Members of a block of bounded size are compared by shorter maps, and the
block gives a forest of the pairs of components within the bound, not the pairs. The components of all forests hold
every such pair. Whole sets are dealt by them, each document's once, and compared exactly unless the block has joined the
two already. So nothing that is written or moved grows with the pairs of a family; comparisons in memory do.
Components equal those of the full join. A document in very many pairs with leaders is joined by parts.

Cases: null or empty text, or text without words: an empty set, linked with
nothing, its own component. Fewer words than k: one shingle of all words.
Null doc_id: the row stays, its component is null and it takes no part. Rows
that share a doc_id count as one document for links. Extra columns are
ignored. Hashes have 64 bits; equality of whole sets uses 128. Texts of any length are
taken whole, a megabyte or one text at a time. An empty table gives an empty one. Ties
go to the smallest doc_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import PARTS, components
from .kit import U64, TextView, Workspace, as_long, mix, shingle_hashes, slices, small_broadcasts

BLOCK, BLOCK_SHINGLES, BATCH_TILES, GROUP_TILES, MET_ROWS = 4096, 4_000_000, 500_000, 250_000, 100_000
BUCKET_BITS, SLICES, SPLIT, MANY, ID_BITS = 20, 16, 4096, 1 << 15, 1 << 24


class Bands:
    """Size bands for a threshold of num/den; band i holds sizes up to ``top[i]``.

    ``shared[i]`` is how many tiles of band i linked sets share at least. Band 0 holds
    sets of one shingle, which have no tiles; its number serves for one shared tile.
    ``one_first``: a set is judged with the leader of most of its tiles only; its other pairs are left to the tiles
    that then still hold several components.
    """

    one_first, bits_type = False, np.uint64

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.top = [1]
        while self.top[-1] < 1 << 31:  # Spark's longest text has fewer words
            self.top.append(max(self.top[-1] + 1, self.top[-1] * den // num, self.top[-1] * 9 * den // (8 * num)))
        self.most = [2 * t * (den - num) // (den + num) for t in self.top]
        self.least = [1, *(max(1, t * num // den) for t in self.top[:-1])]  # smallest size that enters
        self.shared = [1, *(min(2 + n // 20, self.overlap(n, n)) for n in self.least[1:])]

    def overlap(self, x: int, y: int) -> int:
        """The least intersection of linked sets of these sizes."""
        return -(-self.num * (x + y) // (self.num + self.den))

    def partners(self, n: int) -> list[tuple[int, int]]:
        """The bands whose tiles a set of size n enters, each with its smallest partner there."""
        i = int(np.searchsorted(self.top, n))
        smallest = {i: max(self.least[i], -(-n * self.num // self.den))}
        if n * self.den // self.num > self.top[i]:
            smallest[i + 1] = self.top[i] + 1
        return [(j, y) for j, y in smallest.items() if self.most[j]]

    def of(self, n: int) -> list[tuple[int, int]]:
        """The bands whose tiles a set of size n enters, each with its number of first shingles."""
        return [(j, min(n, n - self.overlap(n, y) + self.shared[j])) for j, y in self.partners(n)]

    def retained(self, elements: np.ndarray) -> np.ndarray:
        """What of a set tiles are made of."""
        return elements

    def maps(self, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a pair is judged by before its exact intersection, and what members of a block are judged by."""
        bits = parity_bits(elements)
        return bits, folded(bits, max(8, len(bits) // 4))

    def asked_share(self, band: int) -> float:
        """The share of a band's tiles whose members are compared, where leaders leave several components."""
        return 1.0

    def possible(self, n: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """Which pairs with ``n`` shingles in sum may link by their bits."""
        return self.fits(n, np.array([apart(x, y) for x, y in zip(a, b, strict=True)], np.int64))

    def fits(self, n: np.ndarray, differ: np.ndarray) -> np.ndarray:
        """Which pairs with ``n`` shingles in sum and that many differing bits may link."""
        return (n - differ) * (self.den + self.num) >= n * (2 * self.num)

    def block_fits(self, n: np.ndarray, of: int, differ: np.ndarray) -> np.ndarray:
        """``fits`` of one set of size ``of`` with those of sizes ``n``, by short bits."""
        return self.fits(n + of, differ)


def tiles_of(elements: np.ndarray, bands: Bands, levels: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(band, tile keys of 48 bits) of one set of uint64 hashes; band 0 if two of its keys are equal."""
    out = []
    where = bands.of(len(elements))
    if where:
        some = bands.retained(elements)
        h = mix(some + U64(0x3C6EF372))
        ordered = np.sort((levels[bucket(some)].astype(np.uint64) << U64(56)) | (h >> U64(8)))
    for j, first in where:
        keys = mix(ordered[:first] ^ mix(np.array([j + 1], np.uint64))) >> U64(16)
        distinct = np.unique(keys)
        out.append((j if len(distinct) == len(keys) else 0, distinct))
    return out


def bucket(elements: np.ndarray) -> np.ndarray:
    return (mix(elements + U64(0x510E527F)) >> U64(64 - BUCKET_BITS)).astype(np.int64)


def commonness(docs: DataFrame, k: int, bands: Bands) -> np.ndarray:
    """The level of every bucket of retained shingles, from counts over all documents."""
    width = (1 << BUCKET_BITS) // SLICES

    def rows(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        salt = TaskContext.get().partitionId() % 64
        bodies = [zlib.compress(x.tobytes(), 1) for x in total.values()]
        columns = [pa.array(total, pa.int32()), pa.array([salt] * len(total), pa.int32()), pa.array(bodies, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["slice", "salt", "body"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for _, sets in _sets(batches, k):
            total += np.bincount(bucket(np.concatenate([bands.retained(s) for s in sets])), minlength=len(total))
        yield rows({i: x for i, x in enumerate(total.reshape(SLICES, width)) if x.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, body in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(zlib.decompress(body.as_buffer()), np.int64)
        yield rows(total)

    schema = "slice int, salt int, body binary"
    parts = docs.select("doc_id", "text").mapInArrow(count, schema)
    for by in (["slice", "salt"], ["slice"]):
        parts = parts.repartition(*by).mapInArrow(add, schema)
    total = np.zeros((SLICES, width), np.int64)
    for row in parts.collect():  # one row of fixed size for each slice
        total[row["slice"]] += np.frombuffer(zlib.decompress(row["body"]), np.int64)
    over = total.ravel() // (2 * total.sum() // total.size + 1)
    return np.frexp(over.astype(np.float64))[1].astype(np.uint8)


def parity_bits(elements: np.ndarray) -> np.ndarray:
    """Parities of the elements' hashes as uint64 words; a power of two of bits."""
    size = 1 << min(16, max(8, (2 * len(elements) - 1).bit_length()))
    count = np.bincount((mix(elements + U64(11)) & U64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((count & 1).astype(np.uint8)).view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parities modulo a smaller power of two: halves fold by exclusive or."""
    while len(bits) > words:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def apart(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the symmetric difference's size."""
    words = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum())


def _text_sets(text: pa.Array, k: int) -> list[np.ndarray]:
    view = TextView(text, lower=True)
    words = view.word_hashes()
    return [np.unique(shingle_hashes(words[a:b], k)) for a, b in zip(view.first[:-1], view.first[1:], strict=True)]


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        for rows, text in slices(batch):
            yield rows.column(0), _text_sets(text, k)


def _planes(x: np.ndarray, n: int) -> bytes:
    """The low ``n`` bytes of a 64-bit array, byte by byte: high bytes are mostly alike and compress well."""
    return x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T[:n].tobytes()


def _pack(tile: np.ndarray, doc: np.ndarray, content: np.ndarray, flags: np.ndarray) -> bytes:
    """Rows sorted by tile, as byte planes."""
    return _planes(np.diff(tile, prepend=U64(0)), 6) + _planes(doc, 8) + _planes(content, 8) + _planes(flags, 2)


def _unpack(body: bytes) -> tuple[np.ndarray, ...]:
    rows = np.frombuffer(body, np.uint8).reshape(24, -1)
    full = [np.zeros((8, rows.shape[1]), np.uint8) for _ in range(4)]
    for part, lo, hi in zip(full, (0, 6, 14, 22), (6, 14, 22, 24), strict=True):
        part[: hi - lo] = rows[lo:hi]
    tile, doc, content, flags = (np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in full)
    return np.cumsum(tile, dtype=np.uint64), doc.view(np.int64), content, flags.view(np.int64)


_PLAIN = {"doc_id": "long", "n_shingles": "long", "k1": "long", "k2": "long", "bits": "binary", "short": "binary", "tile": "long", "leader": "long", "band": "long", "mask": "long"}
_ARROW = {c: pa.binary() if t == "binary" else pa.int64() for c, t in _PLAIN.items()}
_PLAIN_SCHEMA = ", ".join(f"{c} {t}" for c, t in _PLAIN.items())


def _dealt(docs: DataFrame, k: int, bands: Bands, levels: np.ndarray, groups: int) -> DataFrame:
    """Sketches of all rows, links to look at within a batch, and packed tiles by group.

    Of a batch's members of a tile, each distinct set keeps its smallest document; these are paired
    with the smallest of all, the batch's leader, which alone goes on to the tile's group. Sketches
    and links need no grouping: they are dealt by row, whatever their content.
    """
    packed_levels = zlib.compress(levels.tobytes())

    def plain(**columns: pa.Array) -> pa.RecordBatch:
        n = len(columns["doc_id"])
        rows = [columns[c] if c in columns else pa.nulls(n, t) for c, t in _ARROW.items()]
        start = zlib.crc32(np.asarray(columns["doc_id"].fill_null(0)).tobytes())
        group = mix(np.arange(start, start + n, dtype=np.uint64)) % U64(groups)
        return pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), pa.nulls(n, pa.binary()), *rows], names=["group", "body", *_PLAIN])

    def flush(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        tile, doc, content, band = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.lexsort((doc, content, tile))
        tile, doc, content, band = tile[order], doc[order], content[order], band[order]
        own = np.append(True, (tile[1:] != tile[:-1]) | (content[1:] != content[:-1]))
        tile, doc, content, band = tile[own], doc[own], content[own], band[own]
        first = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
        size = np.diff(np.append(first, len(tile)))
        leader = np.minimum.reduceat(doc, first)
        of = np.repeat(leader, size)
        rest = doc != of
        if rest.any():
            yield plain(doc_id=pa.array(doc[rest]), tile=pa.array(as_long(tile[rest])), leader=pa.array(of[rest]), band=pa.array(band[rest].astype(np.int64)))
        lead = np.flatnonzero(~rest)
        lead = lead[np.append(True, tile[lead][1:] != tile[lead][:-1])]
        tile, doc, content, flags = tile[lead], doc[lead], content[lead], band[lead].astype(np.int64) | ((size > 1) * MANY)
        group = (mix(tile) % U64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        filled, start = np.unique(group[order], return_index=True)
        bodies = [_pack(tile[r], doc[r], content[r], flags[r]) for r in np.split(order, start[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(bodies, pa.binary()), *(pa.nulls(len(bodies), t) for t in _ARROW.values())], names=["group", "body", *_PLAIN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(zlib.decompress(packed_levels), np.uint8)
        parts, size = [], 0
        for ids, sets in _sets(batches, k):
            maps = [bands.maps(s) for s in sets]
            bits, short = (pa.array([m[i].tobytes() for m in maps], pa.binary()) for i in (0, 1))
            k1, k2 = (np.array([mix(s ^ U64(c)).sum(dtype=np.uint64) for s in sets], np.uint64) for c in (0x51ED270B, 0xB5297A4D))
            yield plain(doc_id=ids, n_shingles=pa.array([len(s) for s in sets], pa.int64()), k1=pa.array(as_long(k1)), k2=pa.array(as_long(k2)), bits=bits, short=short)
            for doc, s, content in zip(ids.to_pylist(), sets, k1, strict=True):
                for band, tiles in tiles_of(s, bands, levels) if doc is not None else []:
                    n = len(tiles)
                    parts.append((tiles, np.full(n, doc, np.int64), np.full(n, content), np.full(n, band, np.int16)))
                    size += n
            if size >= BATCH_TILES:
                yield from flush(parts)
                size = 0
        if parts:
            yield from flush(parts)

    schema = f"group int, body binary, {_PLAIN_SCHEMA}"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def others(content: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each of a tile's members, the buckets of the other contents in it as bits; a tile's contents are sorted."""
    at = content >> U64(58)
    bit = U64(1) << at
    again = (content[1:] != content[:-1]) & (at[1:] == at[:-1])
    again[first[1:] - 1] = False  # another tile
    twice = np.repeat(np.bitwise_or.reduceat(np.where(np.append(False, again), bit, U64(0)), first), size)
    return np.repeat(np.bitwise_or.reduceat(bit, first), size) & ~(bit & ~twice)


def _gathered(table: pa.Table) -> pa.Table:
    """A group's plain rows as they are, and its tiles' batch leaders with the smallest of them and a mask of the others' buckets.

    A tile of which a batch has several members has a full mask: those are not all here.
    """
    out = table.filter(pc.is_null(table.column("body"))).select(list(_PLAIN))
    bodies = [x for x in table.column("body").to_pylist() if x is not None]
    if bodies:
        tile, doc, content, flags = (np.concatenate(x) for x in zip(*map(_unpack, bodies), strict=True))
        order = np.lexsort((content, tile))
        tile, doc, content, flags = tile[order], doc[order], content[order], flags[order]
        first = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
        size = np.diff(np.append(first, len(tile)))
        many = np.logical_or.reduceat(flags >= MANY, first)
        rows = np.repeat(many | (content[first] != content[first + size - 1]), size)
        leader = np.repeat(np.minimum.reduceat(doc, first), size)
        mask = np.where(np.repeat(many, size), ~U64(0), others(content, first, size))
        found = {"doc_id": pa.array(doc[rows]), "tile": pa.array(as_long(tile[rows])), "leader": pa.array(leader[rows]), "band": pa.array(flags[rows] % MANY), "mask": pa.array(as_long(mask[rows]))}
        out = pa.concat_tables([out, pa.table({c: found.get(c, pa.nulls(int(rows.sum()), t)) for c, t in _ARROW.items()})])
    return out


def frequent(key: tuple[np.ndarray, ...], mask: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which rows hold a bit that ``need`` or more rows of their key hold; rows are sorted by key."""
    first = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in key], axis=0)))
    bits = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1)
    enough = np.add.reduceat(bits, first, axis=0, dtype=np.int32) >= need[first][:, None]
    of = np.packbits(enough, axis=1).view(np.uint64).ravel()
    return (mask & np.repeat(of, np.diff(np.append(first, len(mask))))) != 0


def _often_met(members: DataFrame, bands: Bands) -> DataFrame:
    """(tile, doc_id, leader, band): of a document's tiles, those with a bucket of other sets that it meets as often as a link must.

    Other sets fall into 64 buckets by content. A linked set's bucket is met in each of the tiles that both are in, so these rows
    all stay. Chance meetings are spread over the buckets, so documents that have only those go.
    """
    rows = members.select("tile", "doc_id", "leader", F.col("band").cast("int").alias("band"), F.coalesce("mask", F.lit(-1)).alias("mask"))
    rows = rows.repartition("doc_id", "band").sortWithinPartitions("doc_id", "band")
    need, kept = np.array(bands.shared), ["tile", "doc_id", "leader", "band"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, passed = [], 0, None

        def settled(last: bool) -> Iterator[pa.RecordBatch]:
            """Rows that stay; those of the last key wait for more, unless one document id has so many texts that it passes unasked."""
            nonlocal waiting, size, passed
            t = pa.Table.from_batches(waiting).combine_chunks()
            doc, band, mask = (t.column(c).to_numpy() for c in ("doc_id", "band", "mask"))
            end = len(t) if last else int(np.flatnonzero((doc != doc[-1]) | (band != band[-1])).max(initial=-1)) + 1
            keep = np.zeros(len(t), bool)
            if end:
                keep[:end] = frequent((doc[:end], band[:end]), mask[:end].view(np.uint64), need[band[:end]])
            if passed:
                keep |= (doc == passed[0]) & (band == passed[1])
            if end == 0:
                passed, end = (doc[-1], band[-1]), len(t)
                keep[:] = True
            yield from t.select(kept).filter(pa.array(keep)).to_batches()
            waiting, size = t.slice(end).to_batches(), len(t) - end

        for batch in batches:
            waiting.append(batch)
            size += len(batch)
            if size >= MET_ROWS:
                yield from settled(False)
        if size:
            yield from settled(True)

    return rows.mapInArrow(run, "tile long, doc_id long, leader long, band int")


def shingle_arrays(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, elements): sorted 64-bit shingle hashes, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, k):
            yield pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "elements"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, elements binary")


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.select(*(F.col(c).alias(name if c == "doc_id" else f"{name}_{c}") for c in df.columns))


def _bounded(pairs: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b) that their bits leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            keep = bands.possible(total, *([np.frombuffer(v.as_buffer(), bands.bits_type) for v in batch.column(i)] for i in (4, 5)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "a_n_shingles", "b_n_shingles", "a_bits", "b_bits").mapInArrow(run, "a long, b long")


def _beside(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Pairs with the columns of ``table`` for both sides; a document in many pairs is joined by parts.

    Parts are given while the pairs are narrow, so what is wide moves once for each side. Documents in more than SPLIT
    pairs are few, a row for SPLIT pairs at most.
    """
    many = {side: F.broadcast(pairs.groupBy(side).agg(F.ceil(F.count("*") / SPLIT).alias("parts")).filter("parts > 1")) for side in "ab"}
    out = pairs
    for side, other in ("ab", "ba"):
        out = out.join(many[side], side, "left").withColumn(f"{side}_split", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1)))).drop("parts")
    for side in "ba":
        rows = _side(table, side).join(many[side], side, "left")
        rows = rows.withColumn(f"{side}_split", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        out = out.join(rows, [side, f"{side}_split"])
    return out.drop("a_split", "b_split")


def _about(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents of ``ids`` and a few others, without moving texts: marks of a fixed size are looked up in place."""
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(ID_BITS)).cast("long")
    marks = ids.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("mask"))
    near = docs.withColumn("at", at).withColumn("word", F.shiftright("at", 6)).join(F.broadcast(marks), "word")
    return near.filter("shiftrightunsigned(mask, cast(at & 63 AS int)) & 1 = 1").select("doc_id", "text")


def verified(pairs: DataFrame, sketch: DataFrame, docs: DataFrame, k: int, bands: Bands, store: Workspace, name: str) -> DataFrame:
    """Of distinct pairs (a, b), those that link: bits first, then exact intersection."""
    num, den = bands.num, bands.den
    bits = sketch.select("doc_id", "n_shingles", "bits")
    pairs = store.save(pairs, f"{name}-pairs")
    near = _bounded(_beside(pairs, bits), bands).distinct()
    near = store.save(near, f"{name}-near")
    ids = near.select(F.col("a").alias("doc_id")).union(near.select("b"))
    arrays = store.save(shingle_arrays(_about(docs.select("doc_id", "text"), ids), k), f"{name}-arrays")
    full = _beside(near, arrays).select("a", "b", "a_elements", "b_elements")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and both * den >= (len(x) + len(y) - both) * num)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = store.save(full.mapInArrow(run, "a long, b long"), f"{name}-links")
    store.drop(f"{name}-pairs")
    store.drop(f"{name}-near")
    store.drop(f"{name}-arrays")
    return links


class _Block:
    """Members of a block and their maps; maps of one length lie together and are folded once for each shorter length."""

    def __init__(self, t: pa.Table, bands: Bands):
        self.bands = bands
        self.ids, self.own, self.n = (t.column(c).to_numpy() for c in ("doc_id", "own", "n_shingles"))
        self.part = np.unique(t.column("component").to_numpy(), return_inverse=True)[1]
        self.i, self.j = (t.column(c)[0].as_py() for c in ("i", "j"))
        self.maps = [np.frombuffer(v.as_buffer(), np.uint64) for v in t.column("bits")]
        self.length, self.row = np.array([len(m) for m in self.maps]), np.zeros(len(t), np.int64)
        self.stacks = {}
        for length in np.unique(self.length):
            at = np.flatnonzero(self.length == length)
            self.row[at] = np.arange(len(at))
            self.stacks[length, length] = np.stack([self.maps[i] for i in at])

    def asked(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each member with those that it is to be compared with."""
        if self.i == self.j:
            yield from ((x, np.arange(x + 1, len(self.ids))) for x in range(len(self.ids)))
        else:
            other = np.flatnonzero(self.own == self.j)
            yield from ((x, other) for x in np.flatnonzero(self.own == self.i))

    def _folded(self, length: int, words: int) -> np.ndarray:
        if (length, words) not in self.stacks:
            self.stacks[length, words] = np.ascontiguousarray(folded(self.stacks[length, length].T, words).T)
        return self.stacks[length, words]

    def near(self, x: int, ys: np.ndarray) -> np.ndarray:
        """Those of ``ys`` that may link with ``x`` by their bits, fewest differing ones first."""
        differ = np.zeros(len(ys), np.int64)
        for length in np.unique(self.length[ys]):
            at, words = np.flatnonzero(self.length[ys] == length), min(length, self.length[x])
            rows = self._folded(length, words)[self.row[ys[at]]]
            differ[at] = np.bitwise_count(rows ^ folded(self.maps[x], words)).sum(1, dtype=np.int64)
        fits = self.bands.block_fits(self.n[ys], self.n[x], differ)
        return ys[fits][np.argsort(differ[fits], kind="stable")]


def _likely(b: _Block, t: pa.Table) -> list[tuple[int, int]]:
    """A forest whose trees hold every pair of different components that may link by its bits."""
    label, out = np.arange(len(b.ids)), []
    for x, ys in b.asked():
        ys = b.near(x, ys[(b.part[ys] != b.part[x]) & (label[ys] != label[x])])
        hit, first = np.unique(label[ys], return_index=True)
        if len(hit):
            out += [(b.ids[x], b.ids[y]) for y in ys[first]]
            label[np.isin(label, hit)] = label[x]
    return out


def _linking(b: _Block, t: pa.Table) -> list[tuple[int, int]]:
    """A forest of links that joins all components of a block that links join, by exact intersection."""
    sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in t.column("elements")]
    num, den, label, out = b.bands.num, b.bands.den, b.part.copy(), []
    for x, ys in b.asked():
        for y in b.near(x, ys[label[ys] != label[x]]):
            if label[y] != label[x]:
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if both > 0 and both * den >= (len(sets[x]) + len(sets[y]) - both) * num:
                    out.append((b.ids[x], b.ids[y]))
                    label[label == label[y]] = label[x]
    return out


def _within_blocks(members: DataFrame, bands: Bands, pairs: Callable[[_Block, pa.Table], list[tuple[int, int]]]) -> DataFrame:
    """Distinct (a, b) that ``pairs`` finds in the blocks of ``members`` (tile, blocks, doc_id, component, n_shingles, bits, ...).

    A tile is cut into ``blocks`` by a hash; each pair of blocks is one unit of work, so memory stays bounded
    however hot the tile.
    """
    units = members.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other")
    units = units.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []

        def ask(t: pa.Table) -> None:
            if len(t) > 1:
                found.extend(pairs(_Block(t, bands), t))

        rest: list[pa.Table] = []
        key = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            keys = [t.column(c).to_numpy() for c in ("tile", "i", "j")]
            cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1
            edges = [0, *cut.tolist(), len(t)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo < hi:
                    now = tuple(x[lo] for x in keys)
                    if rest and now != key:
                        ask(pa.concat_tables(rest))
                        rest.clear()
                    key = now
                    rest.append(t.slice(lo, hi - lo))
        if rest:
            ask(pa.concat_tables(rest))
        a, b = np.sort(np.array(found, np.int64).reshape(-1, 2), 1).T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return units.mapInArrow(run, "a long, b long").distinct()


def _laid_together(shared: DataFrame, parts: DataFrame, store: Workspace) -> DataFrame:
    """(tile, doc_id, component, blocks): members of tiles of several components, tiles with one leader as one.

    Where the union of a leader's tiles costs more than four times the comparisons of its tiles, they stay apart.
    """
    placed = shared.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = placed.select("tile", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    # tiles with the same members ask the same question: they count once
    same = [F.sum(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(i)), 28)).alias(f"s{i}") for i in (1, 2)]
    tiles = placed.groupBy("tile").agg((F.min("component") < F.max("component")).alias("mixed"), F.min("doc_id").alias("lead"), F.count("*").alias("n"), *same)
    tiles = store.save(tiles, "tiles")
    met = shared.join(tiles.select("tile", "lead", "mixed"), "tile").groupBy("lead", "doc_id").agg(F.max("mixed").alias("mixed"))
    met = store.save(met.filter("mixed").drop("mixed"), "met")
    union = met.groupBy("lead").agg(F.count("*").cast("double").alias("u"))
    squares = tiles.filter("mixed").select("lead", "n", "s1", "s2").distinct().groupBy("lead").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    apart = store.save(union.join(squares, "lead").filter("u * u > 4 * squares").select("lead"), "apart")
    rest = met.join(apart, "lead", "left_anti").select((-1 - F.col("lead")).alias("tile"), "doc_id")
    if apart.limit(1).count():
        alone = tiles.filter("mixed").join(apart, "lead", "left_semi").groupBy("n", "s1", "s2").agg(F.min("tile").alias("tile"))
        rest = rest.unionByName(shared.join(alone.select("tile"), "tile", "left_semi").select("tile", "doc_id"))
    rest = rest.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    rest = store.save(rest.select("tile", "doc_id", F.coalesce("component", "doc_id").alias("component")), "rest")
    size = rest.groupBy("tile").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    return rest.join(size, "tile")


def _joined(edges: DataFrame, parts: DataFrame, sketch: DataFrame, docs: DataFrame, k: int, bands: Bands, store: Workspace) -> DataFrame:
    """Links (a, b) that join all components that links within the components of ``edges`` join."""
    near = components(edges, store, "near").select(F.col("node").alias("doc_id"), F.col("component").alias("tile"))
    near = near.join(sketch.groupBy("doc_id").agg(F.sum("n_shingles").alias("n")), "doc_id")
    size = near.groupBy("tile").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    near = near.join(size, "tile").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    near = store.save(near.select("doc_id", "tile", "blocks", F.coalesce("component", "doc_id").alias("component")), "near")
    members = _about(docs.select("doc_id", "text"), near).withColumn("doc_id", F.col("doc_id").cast("long")).join(near, "doc_id")
    kept = ["doc_id", "tile", "blocks", "component"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in slices(batch):
                sets = _text_sets(text, k)
                maps = pa.array([bands.maps(s)[1].tobytes() for s in sets], pa.binary())
                columns = [*(rows.column(c) for c in kept), pa.array([len(s) for s in sets], pa.int64()), maps, pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_shingles", "bits", "elements"])

    members = members.select(*kept, "text").mapInArrow(run, "doc_id long, tile long, blocks int, component long, n_shingles long, bits binary, elements binary")
    links = store.save(_within_blocks(members.filter("n_shingles > 0"), bands, _linking), "cross-links")
    store.drop("near")
    return links


def similarity_components(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, store: Workspace | None = None, bands: Bands | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; see the module's docstring."""
    with small_broadcasts(docs.sparkSession):
        return _linked(docs, k, bands or Bands(num, den), store or Workspace(docs.sparkSession))


def _linked(docs: DataFrame, k: int, bands: Bands, store: Workspace) -> DataFrame:
    num, den = bands.num, bands.den
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(8, size * (den - num) // (2 * (den + num) * GROUP_TILES) + 1)
    whole = _dealt(docs, k, bands, commonness(docs, k, bands), groups).groupBy("group").applyInArrow(_gathered, _PLAIN_SCHEMA)
    whole = store.save(whole, "sketch")
    store.release()
    every = whole.filter("tile is null").drop("tile", "leader", "band", "mask")
    sketch = every.filter("doc_id is not null and n_shingles > 0")
    members = store.save(_often_met(whole.filter("tile is not null"), bands), "shared")
    need = F.element_at(F.array(*map(F.lit, bands.shared)), F.col("band") + 1)
    reps = store.save(sketch.groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("rep")), "reps")
    copies = sketch.join(reps, ["n_shingles", "k1", "k2"]).filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    pairs = members.filter("doc_id <> leader").groupBy(F.col("leader").alias("a"), F.col("doc_id").alias("b"), "band").agg(F.count("*").alias("n"))
    pairs = pairs.filter(F.col("n") >= need)
    if bands.one_first:
        first = pairs.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b")
    else:
        first = pairs.select("a", "b").distinct()
    first = verified(first, sketch, docs, k, bands, store, "star")
    # only copies that may hold other links take part in the rounds: those in tiles, and ids of several texts
    copies = store.save(copies.distinct(), "copies")
    several = copies.groupBy("b").agg(F.count("*").alias("n")).filter("n > 1").select("b")
    own = members.select(F.explode(F.array("doc_id", "leader")).alias("b")).unionByName(reps.select(F.col("rep").alias("b"))).unionByName(several)
    parts = components(first.unionByName(copies.join(own.distinct(), "b", "left_semi")), store, "parts")
    shared = members
    shares = [bands.asked_share(j) for j in range(len(bands.shared))]
    if min(shares) < 1:
        share = F.element_at(F.array(*map(F.lit, shares)), F.col("band") + 1)
        shared = shared.filter(F.pmod(F.xxhash64("tile"), F.lit(1 << 20)) < share * (1 << 20))
    shared = shared.select("tile", "doc_id")
    rest = _laid_together(shared, parts, store).join(sketch.select("doc_id", "n_shingles", F.col("short").alias("bits")), "doc_id")
    edges = store.save(_within_blocks(rest, bands, _likely), "likely")
    for name in ("tiles", "met", "apart", "rest", "shared"):
        store.drop(name)
    store.release()
    found = _joined(edges, parts, sketch, docs, k, bands, store)
    links = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
    parts = components(links.unionByName(found), store, "parts-cross")
    store.release()
    of = copies.groupBy(F.col("b").alias("doc_id")).agg(F.min("a").alias("first"))
    placed = every.select("doc_id", "n_shingles").join(of, "doc_id", "left").withColumn("node", F.coalesce("first", "doc_id"))
    # a third of all rows may be copies of one text: its component is looked up by parts
    final = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")).join(final, ["node", "part"], "left")
    out = store.save(placed.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id")), "components")
    for name in ("sketch", "reps", "copies", "likely", "cross-links"):
        store.drop(name)
    store.release()
    return out
