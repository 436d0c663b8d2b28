"""Cross-tokenizer alignment: label strings, groups of tokens, and counts of linked ids.

A text with a space before it is encoded by a byte-level BPE (A) and a sentencepiece model (B). Each
byte gets a label: no token ends there, one of A, one of B, or both. A regular
expression scans the labels for spans up to each both-label; the labels in a span give how many tokens
of A and of B form the group. Between two ends one token of A and one of B lie
over each other, and every overlapping pair has one such stretch, so the labelled bytes are the links.

Chunks. Neither vocabulary has a token that holds a space after another character, so
at a single space between two other characters both tokenizers start afresh, and both have an
end. A text is cut there, and each distinct chunk of a block of texts (BLOCK bytes; one longer text
is a block) is encoded and scanned once. The chunks of a block are encoded as one string; those that end
in white space, or hold a very long run of it, are encoded alone.
``tests`` compare the ids with those of uncut texts.

Corpus counts. A block gives one row for each pair of linked ids, with its number of links, so a
pair that most texts hold costs a row a block before the sums by pair. The sums and the highest
of each B id go back to the blocks that hold the pair, and there to the texts by way
of their chunks. A row of a text carries its distinct chunks as numbers. Memory is bounded by a block.
The number of blocks follows the bytes of the corpus: many small files are read together.

Cases: null or empty texts, and texts whose joined A or B bytes are not space and text (one that
holds U+2581, say), have no tokens: zeros and an empty digest. They count nothing. Null and repeated doc_ids are rows
like others; repeated rows count each. Ties for the highest count all count. Texts
of any length are taken whole. Extra columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import Workspace, slices
from .tokens import LONG_SPACE, Encoder, Pieces

BLOCK = 8_000_000
NONE, A_END, B_END, BOTH = b".abc"
CUT = re.compile(r"(?<=\S) (?=\S)")
SPAN = re.compile(rb"[.ab]*c")
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_ROWS = "block long, doc_id long, text_row boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, body binary, pairs array<long>, numbers array<long>"
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Vocabulary:
    """Lengths and bytes of a tokenizer's ids, for joining them again."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.body = np.frombuffer(b"".join(tokens), np.uint8)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.size[ids])

    def joins_to(self, ids: np.ndarray, data: np.ndarray) -> bool:
        """Whether the ids' bytes, joined, are ``data``."""
        size = self.size[ids]
        if size.sum() != len(data):
            return False
        at = np.arange(len(data)) + np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        return bool((self.body[at] == data).all())


class Aligned:
    """Label string, groups and links of one byte string with two token sequences."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray):
        label = np.zeros(n, np.uint8)
        label[a_ends - 1] |= 1
        label[b_ends - 1] |= 2
        self.labels = np.frombuffer(bytes((NONE, A_END, B_END, BOTH)), np.uint8)[label].tobytes()
        self.span_ends = np.array([m.end() for m in SPAN.finditer(self.labels)], np.int64)
        self.a_before, self.b_before = (np.append(0, np.cumsum(label & k > 0)) for k in (1, 2))
        self.a_tokens, self.b_tokens = np.diff(self.a_before[self.span_ends], prepend=0), np.diff(self.b_before[self.span_ends], prepend=0)
        self.link_ends = np.flatnonzero(label) + 1
        self.linked_a, self.linked_b = a[self.a_before[self.link_ends - 1]], b[self.b_before[self.link_ends - 1]]


class Aligner:
    """Both tokenizers and the chunks of a block."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None):
        self.a, self.b = Encoder(a_path), Pieces(b_path)
        a, b = self.a.token_bytes(), self.b.token_bytes()
        self.a_words, self.b_words, self.width = Vocabulary(a), Vocabulary(b), len(b)
        # a token's digits, followed by what may stand after it
        self.a_text = [[f"{i}{c}".encode() for i in range(len(a))] for c in ",|"]
        self.b_text = [[f"{i}{c}".encode() for i in range(len(b))] for c in ",;"]

    def chunks(self, words: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Of each chunk: counts (valid, then _COUNTS), its groups as text with a last ';', its links and their owners."""
        alone = [k for k, w in enumerate(words) if w[-1:].isspace() or not w or LONG_SPACE.search(w) or "▁" in w]
        rest = sorted(set(range(len(words))) - set(alone))
        counts, texts = np.zeros((len(words), 1 + len(_COUNTS)), np.int64), [b""] * len(words)
        links, owners = [], []
        parts = [rest] if rest else []
        parts += [[k] for k in alone]
        while parts:
            part = parts.pop()
            done = self._encoded([words[k] for k in part])
            if done is None:
                half = len(part) // 2  # one chunk spoils its string: it is found by halves
                parts += [part[:half], part[half:]] if half else []
                continue
            some, each, pairs, of = done
            where = np.array(part)
            counts[where] = some
            for k, t in zip(part, each, strict=True):
                texts[k] = t
            links.append(pairs)
            owners.append(where[of])
        return counts, texts, *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (links, owners))

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray] | None:
        text = " ".join(words)
        data = np.frombuffer(f" {text}".encode(), np.uint8)
        a, b = self.a.ordinary_ids(f" {text}"), self.b.ids(text)
        if not (self.a_words.joins_to(a, data) and self.b_words.joins_to(b, data)):
            return None
        got = Aligned(len(data), a, b, self.a_words.ends(a), self.b_words.ends(b))
        ends = np.cumsum([1 + len(w.encode()) for w in words])
        if np.setdiff1d(ends, got.span_ends, assume_unique=True).size:
            return None
        cut = lambda of: np.diff(np.searchsorted(of, ends, side="right"), prepend=0)
        counts = np.stack([np.ones(len(words), np.int64), np.diff(got.a_before[ends], prepend=0), np.diff(got.b_before[ends], prepend=0), cut(got.span_ends), cut(got.link_ends)], 1)
        # tokens in the order of the text form: a group's tokens of A, then its tokens of B
        last_a, last_b = np.cumsum(got.a_tokens), np.cumsum(got.b_tokens)
        place_a = np.arange(len(a)) + np.repeat(last_b - got.b_tokens, got.a_tokens)
        place_b = np.arange(len(b)) + np.repeat(last_a, got.b_tokens)
        out = np.empty(len(a) + len(b), object)
        (comma, bar), (b_comma, semicolon) = self.a_text, self.b_text
        out[place_a] = [comma[i] for i in a.tolist()]
        out[place_b] = [b_comma[i] for i in b.tolist()]
        out[place_a[last_a - 1]] = [bar[i] for i in a[last_a - 1].tolist()]
        out[place_b[last_b - 1]] = [semicolon[i] for i in b[last_b - 1].tolist()]
        tokens, edges = out.tolist(), [0, *np.cumsum(counts[:, 1] + counts[:, 2]).tolist()]
        each = [b"".join(tokens[lo:hi]) for lo, hi in zip(edges, edges[1:], strict=False)]
        owner = np.repeat(np.arange(len(words)), counts[:, 4])
        return counts, each, got.linked_a.astype(np.int64) * self.width + got.linked_b, owner


def _packed(*arrays: np.ndarray) -> bytes:
    return zlib.compress(np.concatenate([np.array([len(arrays[0])]), *arrays]).astype("<u4").tobytes(), 1)


def _unpacked(body: bytes, n: int) -> list[np.ndarray]:
    rows = np.frombuffer(zlib.decompress(body), "<u4")
    first = int(rows[0])
    return [rows[1 : 1 + first], rows[1 + first :]][:n]


def encoded(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, block: int = BLOCK) -> DataFrame:
    """Rows of texts, with their chunks in ``body``, and a row a block: its chunks' links, pairs and their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, turn = Aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        pending: list[tuple[pa.Array, pa.Array]] = []
        size = 0
        for batch in batches:
            for rows, text in slices(batch, most=block):
                held = text.nbytes
                if pending and size + held > block:
                    yield finish(aligner, pending, turn)
                    turn, size, pending = turn + 1, 0, []
                pending.append((rows.column(0), text))
                size += held
        if pending:
            yield finish(aligner, pending, turn)

    def finish(aligner: Aligner, pending: list[tuple[pa.Array, pa.Array]], block_id: int) -> pa.RecordBatch:
        known: dict[str, int] = {}
        ids, held = [], []
        for doc, column in pending:
            ids += doc.to_pylist()
            for text in column:
                words = CUT.split(t) if (t := text.as_py()) else []
                held.append(np.array([known.setdefault(w, len(known)) for w in words], np.int64))
        counts, texts, links, owners = aligner.chunks(list(known))
        pairs, which = np.unique(links, return_inverse=True)
        n, total = len(held), np.zeros(len(known), np.int64)
        columns = np.zeros((n, len(_COUNTS)), np.int64)
        digests, bodies = [""] * n, [b""] * n
        for k, codes in enumerate(held):
            if len(codes) and counts[codes, 0].all():
                columns[k] = counts[codes, 1:].sum(0)
                digests[k] = hashlib.sha256(b"".join([texts[c] for c in codes.tolist()])[:-1]).hexdigest()
                own, times = np.unique(codes, return_counts=True)
                total[own] += times
                bodies[k] = _packed(np.diff(own, prepend=0), times)
        numbers = np.zeros(len(pairs), np.int64)
        np.add.at(numbers, which, total[owners])
        body = _packed(owners, which) if len(which) else b""
        arrays = [
            pa.array([block_id] * (n + 1), pa.int64()),
            pa.array([*ids, None], pa.int64()),
            pa.array([True] * n + [False]),
            *(pa.array([*c, None], pa.int64()) for c in columns.T.tolist()),
            pa.array([*digests, None], pa.string()),
            pa.array([*bodies, body], pa.binary()),
            pa.array([None] * n + [pairs], pa.list_(pa.int64())),
            pa.array([None] * n + [numbers], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _ROWS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ROWS)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): links of a pair of ids in the whole corpus, and whether no other of its B id has more."""
    each = rows.filter("not text_row").select(F.explode(F.arrays_zip("pairs", "numbers")).alias("x"))
    total = each.select(F.col("x.pairs").alias("pair"), F.col("x.numbers").alias("n")).filter("n > 0").groupBy("pair").agg(F.sum("n").alias("n"))
    most = total.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("most"))
    return total.withColumn("b", F.col("pair") % width).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _with_counts(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """The texts of one block with the sums over their links."""
    number, best = pairs.column("n").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(pairs.column("pair").to_numpy())
    pair, number, best = pairs.column("pair").to_numpy()[order], number[order], best[order]
    is_text = texts.column("text_row").to_numpy(zero_copy_only=False)
    bodies = texts.column("body")
    at = int(np.flatnonzero(~is_text)[0])
    chunk_sum = chunk_best = np.zeros(0, np.int64)
    if bodies[at].as_py():
        owners, which = _unpacked(bodies[at].as_py(), 2)
        own = np.array(texts.column("pairs")[at].values.to_numpy(), np.int64)
        place = np.searchsorted(pair, own)
        found = place < len(pair)  # pairs of texts without tokens only are not counted
        found[found] = pair[place[found]] == own[found]
        place = np.where(found, place, 0)
        n, b = (np.where(found, x[place] if len(x) else 0, 0) for x in (number, best))
        chunk_sum, chunk_best = (np.zeros(int(owners.max()) + 1, np.int64) for _ in range(2))
        np.add.at(chunk_sum, owners, n[which])
        np.add.at(chunk_best, owners, b[which])
    out = texts.filter(pa.array(is_text)).combine_chunks()
    sums = []
    for body in out.column("body").to_pylist():
        if body:
            step, times = _unpacked(body, 2)
            own = np.cumsum(step.astype(np.int64))
            sums.append((int((chunk_best[own] * times).sum()), int((chunk_sum[own] * times).sum())))
        else:
            sums.append((0, 0))
    got = {"n_best": pa.array([s[0] for s in sums], pa.int64()), "count_sum": pa.array([s[1] for s in sums], pa.int64())}
    return pa.table({c: got.get(c) if c in got else out.column(c) for c in (f.split()[0] for f in _OUT.split(", "))})


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, block: int = BLOCK, store: Workspace | None = None) -> DataFrame:
    """One row a text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; see the module."""
    store = store or Workspace(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # many small files make few blocks; larger ones stay as they are dealt
    rows = store.save(encoded(docs.coalesce(size // block + 1), a_path, b_path, block), "encoded")
    counts = pair_counts(rows, len(Pieces(b_path).token_bytes()))
    held = rows.filter("not text_row").select(F.col("block").alias("of_block"), F.explode("pairs").alias("pair"))
    back = held.join(counts, "pair").select("of_block", "pair", "n", "best")
    return rows.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(_with_counts, _OUT)
