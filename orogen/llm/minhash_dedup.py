"""MinHash near-dedup: bottom-k sketches, inverted lists, union-sketch estimates, exact Jaccard.

A set's sketch is its k smallest shingle hashes, all by one hash function; a set of
fewer shingles is its own sketch. Of two sets, the k smallest hashes of both sketches are the sketch of the union, and
the share of them that both sets hold estimates their similarity.

Threshold. With s shared hashes in the union's sketch of k, and x + y shingles in sum, linked sets hold
ceil(num (x + y) / (num + den)) of at most floor(den (x + y) / (num + den)) shingles in common, so s is at least
hypergeometric. A pair goes on to the exact check if s reaches the quantile that a link falls below with a
chance of MISS. Where the union has k shingles at most, s is the overlap itself and nothing is estimated. Pairs are judged by
the first ESTIMATE values of a sketch, lists are made of all K: most texts have fewer shingles than that, and
their lists are as sharp as those of whole sets.

Inverted lists. s shared hashes are s common retained values at least, so in any order of values, two
linked sketches share l of their first |sketch| - s + l. Lists are kept of those first values only, rarest first
as counted over all sketches, so a value that a third of all sketches retain makes a list only of those that
consist of such values. Lists are split by bands of set size. Overlaps are counted per
pair of a list's member and its leader, and each set is judged with the leader it meets most often; lists with several
components left are compared in blocks by parity maps of their retained values. Linked sets share many lists, so a share
of the lists is asked, such that a link is in none of them with a chance of MISS. The jobs are those of ``ngram_join``, with
sketches in the place of whole sets: no pairs are expanded within a group, copies of a set enter once a batch, and
there is no cap.

Links are confirmed on full sets. Cases are those of ``ngram_join``; ``kept`` is true for a null doc_id,
which is linked with nothing.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import U64, Workspace, mix
from .ngram_join import Bands, similarity_components

K, ESTIMATE, MISS, SHORT_WORDS = 512, 128, 1e-7, 16


def shared_quantile(population: int, common: int, draws: int, miss: float) -> int:
    """The largest t with a chance of fewer than t common ones of at most ``miss``, drawing without replacement."""
    lg = math.lgamma
    choose = lambda n, r: lg(n + 1) - lg(r + 1) - lg(n - r + 1) if 0 <= r <= n else -math.inf
    total, chance, t = choose(population, draws), 0.0, max(0, draws - (population - common))
    while t < min(draws, common):
        chance += math.exp(choose(common, t) + choose(population - common, draws - t) - total)
        if chance > miss:
            break
        t += 1
    return t


class SketchBands(Bands):
    """Size bands whose tiles are inverted lists of retained values, and the union-sketch test.

    Lists are made of k retained values, estimates of the first ``estimate`` of them, as 32 bits each.
    """

    one_first, bits_type = True, np.uint32

    def __init__(self, num: int, den: int, k: int = K, estimate: int = ESTIMATE, miss: float = MISS):
        super().__init__(num, den)
        self.k, self.estimate = k, estimate
        # by the sum of sizes; the larger the population, the wider the spread, and the last entry serves for all beyond
        self.listed, self.estimated = (np.array([self._least(n, d, miss) for n in (*range(8 * d), *range(8 * d, 64 * d, 64), 1 << 22)]) for d in (k, estimate))
        self.listed, self.estimated = (self._every(t, d) for t, d in ((self.listed, k), (self.estimated, estimate)))
        self.shared = [1, *(min(2 + min(n, k) // 10, self._lowest(n, n)) for n in self.least[1:])]

    @staticmethod
    def _every(table: np.ndarray, draws: int) -> np.ndarray:
        """Entries for every sum: a coarse step has the lower of its ends."""
        fine, rest = table[: 8 * draws], table[8 * draws :]
        return np.concatenate([fine, np.repeat(np.minimum(rest[:-1], rest[1:]), 64), rest[-1:]])

    def _least(self, total: int, draws: int, miss: float) -> int:
        common = self.overlap(total, 0)
        union = max(total - common, 1)
        return min(common, union) if union <= draws else shared_quantile(union, common, draws, miss)

    def _lowest(self, n: int, smallest: int) -> int:
        """The shared values that a set of size ``n`` has with any partner from ``smallest`` on."""
        lo, hi = (min(n + y, len(self.listed) - 1) for y in (smallest, n * self.den // self.num))
        return int(self.listed[lo : max(lo, hi) + 1].min())

    def of(self, n: int) -> list[tuple[int, int]]:
        size = min(n, self.k)
        return [(j, min(size, max(1, size - self._lowest(n, y) + self.shared[j]))) for j, y in self.partners(n)]

    def at_least(self, total: np.ndarray) -> np.ndarray:
        """The shared values in the union's sketch that a link with ``total`` shingles in sum has."""
        return self.estimated[np.minimum(total, len(self.estimated) - 1)]

    def retained(self, elements: np.ndarray) -> np.ndarray:
        return elements[: self.k]  # sets are sorted by hash

    def maps(self, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = elements[: self.k]
        count = np.bincount((mix(some + U64(11)) & U64(64 * SHORT_WORDS - 1)).astype(np.int64), minlength=64 * SHORT_WORDS)
        return (elements[: self.estimate] >> U64(32)).astype(np.uint32), np.packbits((count & 1).astype(np.uint8)).view(np.uint64)

    def asked_share(self, band: int) -> float:
        # linked sets share that many lists: the chance that none of them is asked is MISS
        return 1.0 - MISS ** (1.0 / self.shared[band])

    def possible(self, n: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        # two values of one set may have the same 32 bits: one is allowed for
        return np.array([self._union(x, y) for x, y in zip(a, b, strict=True)], np.int64) + 1 >= self.at_least(n)

    def _union(self, x: np.ndarray, y: np.ndarray) -> int:
        """Shared values within the sketch of the union."""
        _, times = np.unique(np.concatenate([np.unique(x), np.unique(y)]), return_counts=True)
        return int((times[: self.estimate] == 2).sum())

    def block_fits(self, n: np.ndarray, of: int, differ: np.ndarray) -> np.ndarray:
        both = np.minimum(n, self.k) + min(of, self.k) - differ
        return both >= 2 * self.listed[np.minimum(n + of, len(self.listed) - 1)]


def near_duplicates(docs: DataFrame, words: int = 2, num: int = 8, den: int = 10, k: int = K, store: Workspace | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; the smallest doc_id of a component is kept."""
    out = similarity_components(docs, words, num, den, store, SketchBands(num, den, k))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
