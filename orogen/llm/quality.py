"""Quality rules: Jensen-Shannon distance to language references.

Each document gives two histograms: code points by character class, and words
by a short list of common words for each language, with one slot for all
other words. References are the sums of the histograms of all documents of a
language that pass the base rules, however few; only a language without such documents, of which
none is kept, is compared with the reference over all languages. A document is kept when it passes the base rules
and its distances stay under their limits. Distances are square roots of the
base-2 divergence, from 0 to 1.

Minimum-length guards: the base rules ask for 50 words; the word histogram is
judged from ``guard`` words up, with a limit of ``most_common`` plus ``slack``
over the root of the number of words, as short texts vary more.

Base rules: fewer than 50 words fail; so do texts of which more than half the
words lie in 3-word windows that occur twice or more.

Cases: null or empty text has no words and fails. A null language is a language of its
own. Repeated rows each get their row. Extra columns stay inside ``doc``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kit import LOWER, TextView, Workspace, prefix_hashes, range_hashes, shingle_hashes, slices

# Frequent function words of four languages.
COMMON = {
    "en": "the of and to in is that for it as was with be by on not he his but at are this have an".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus pas ne il avec elle".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
}
WORDS = sorted({w for words in COMMON.values() for w in words})
CLASSES = ["lower", "upper", "digit", "space", "stop", "mark", "other", "wide"]
SYMBOLS = b"#*$%&|<>"

_CLASS = np.full(256, 6, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
_CLASS[list(b".,;:!?'\"()-")] = 4
_CLASS[list(b"#*$%&|<>@^_~+=/\\[]{}`")] = 5
_CLASS[0xC0:] = 7
_CLASS[0x80:0xC0] = 8  # continuation bytes are no code points
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, common array<long>"


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _common_hashes() -> tuple[np.ndarray, np.ndarray]:
    view = TextView(pa.array([" ".join(WORDS)]), lower=True)
    hashes = view.word_hashes()
    order = np.argsort(hashes)
    return hashes[order], order


def features(view: TextView, known: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """The base counts and both histograms of every document of a view."""
    data, off, n = view.data, view.off, len(view.off) - 1
    prefix = prefix_hashes(data)
    view.words()
    words = range_hashes(prefix, view.starts, view.ends)
    first = view.first
    point = (data & 0xC0) != 0x80
    inside = np.zeros(len(data) + 1, np.int8)
    inside[view.starts] += 1
    inside[view.ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool) if len(data) else inside[:0].astype(bool)
    # Adjacent documents can end and start a word at one place: +1 and -1 cancel, which is right.

    newline = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([off[:-1], newline + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    ends = ends - (data[ends - 1] == 10) if len(starts) else ends
    wordy = np.searchsorted(view.starts, ends) > np.searchsorted(view.starts, starts)
    starts, ends = starts[wordy], ends[wordy]
    lines, line_first = range_hashes(prefix, starts, ends), np.searchsorted(starts, off)

    dup, repeat = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        own = lines[line_first[i] : line_first[i + 1]]
        dup[i] = len(own) - len(np.unique(own)) if len(own) > 1 else 0
        own = words[first[i] : first[i + 1]]
        if len(own) > 3:
            _, back, count = np.unique(shingle_hashes(own, 3), return_inverse=True, return_counts=True)
            twice = count[back] > 1
            if twice.any():
                cover = np.zeros(len(own), bool)
                for j in range(3):
                    cover[j : j + len(twice)] |= twice
                repeat[i] = cover.sum()

    doc = np.repeat(np.arange(n), np.diff(off))
    classes = np.bincount(doc * 9 + _CLASS[data], minlength=9 * n).reshape(n, 9)[:, :8] if n else np.zeros((0, 8), np.int64)
    low = range_hashes(prefix_hashes(LOWER[data]), view.starts, view.ends)
    keys, order = known
    at = np.minimum(np.searchsorted(keys, low), len(keys) - 1)
    slot = np.where(keys[at] == low, order[at], len(keys)) if len(low) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(n), np.diff(first))
    width = len(keys) + 1
    common = np.bincount(doc * width + slot, minlength=width * n).reshape(n, width)
    return {
        "n_words": np.diff(first).astype(np.int64), "word_chars": _sums(point & inside, off), "n_symbols": _sums(_SYMBOL[data], off),
        "n_dup_lines": dup, "n_repeat_words": repeat, "classes": classes, "common": common,
    }


def measured(docs: DataFrame) -> DataFrame:
    """(doc struct of all columns but the text, base counts, histograms) of every row."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("doc"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _common_hashes()
        for batch in batches:
            for part, text in slices(batch):
                found = features(TextView(text), known)
                listed = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().astype(np.int64))) for x in (found["classes"], found["common"])]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(found[c]) for c in BASE), *listed], names=["doc", *BASE, "classes", "common"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, {_SCHEMA}")


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of matching rows of counts, 0 to 1; an empty row has all shares 0."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    q = q / np.maximum(q.sum(1, keepdims=True), 1)
    m = (p + q) / 2
    terms = np.where(p > 0, p * np.log2(np.where(p > 0, p / np.where(m > 0, m, 1), 1)), 0) + np.where(q > 0, q * np.log2(np.where(q > 0, q / np.where(m > 0, m, 1), 1)), 0)
    return np.sqrt(np.maximum(0, terms.sum(1) / 2))


def _distances(rows: DataFrame) -> DataFrame:
    """Replaces each histogram and its reference by their distance."""
    plain = ["doc", *BASE, "base_failed"]
    kept = rows.select(*plain).schema
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at = batch.num_rows, len(plain)
            table = [pc.list_flatten(batch.column(at + k)).to_numpy().reshape(n, -1) for k in range(4)]
            found = [pa.array(js_distance(table[k], table[k + 2]), pa.float64()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(at)), *found], names=[*plain, "class_distance", "word_distance"])

    return rows.select(*plain, "classes", "common", "ref_classes", "ref_common").mapInArrow(run, f"{fields}, class_distance double, word_distance double")


def _reference(rows: DataFrame, by: list[Column]) -> DataFrame:
    sums = [F.sum(F.col(h)[i]).alias(f"{h}{i}") for h, n in (("classes", len(CLASSES)), ("common", len(WORDS) + 1)) for i in range(n)]
    out = rows.groupBy(*by).agg(F.sum("n_words").alias("mass"), *sums)
    return out.select(*[c for c in out.columns if c == "key"], "mass", F.array(*[f"classes{i}" for i in range(len(CLASSES))]).alias("ref_classes"), F.array(*[f"common{i}" for i in range(len(WORDS) + 1)]).alias("ref_common"))


def quality_rules(docs: DataFrame, guard: int = 80, most_classes: float = 0.3, most_common: float = 0.22, slack: float = 1.0, store: Workspace | None = None) -> DataFrame:
    """(doc, base counts, base_failed, class_distance, word_distance, kept) of every row.

    ``doc`` holds the input columns but the text.
    """
    store = store or Workspace(docs.sparkSession)
    rows = store.save(measured(docs), "measured").withColumn("key", F.coalesce(F.col("doc.lang"), F.lit("")))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    sound = rows.filter(~F.col("base_failed"))
    own = _reference(sound, [F.col("key")])
    every = _reference(sound, []).first()  # one row of some hundred sums
    general = {h: F.array(*[F.lit(int(x or 0)).cast("long") for x in every[f"ref_{h}"]]) for h in ("classes", "common")}
    judged = rows.join(store.save(own, "own"), "key", "left")
    judged = _distances(judged.withColumns({f"ref_{h}": F.coalesce(f"ref_{h}", c) for h, c in general.items()}))
    limit = most_common + slack / F.sqrt(F.greatest("n_words", F.lit(1)).cast("double"))
    odd = (F.col("class_distance") > most_classes) | ((F.col("n_words") >= guard) & (F.col("word_distance") > limit))
    return judged.select("doc", *BASE, "base_failed", "class_distance", "word_distance", (~F.col("base_failed") & ~odd).alias("kept"))


def oracle(guard: int = 80, most_classes: float = 0.3, most_common: float = 0.22, slack: float = 1.0) -> str:
    """DuckDB SQL for the query's rows."""
    words = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
    share = lambda h: f"list_transform({h}, lambda x: x / greatest(list_sum({h}), 1))"
    term = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END"
    dist = lambda p, q: f"sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {term(f'{p}[i]', f'{q}[i]')} + {term(f'{q}[i]', f'{p}[i]')})) / 2))"
    summed = lambda h: f"(SELECT k, list(v ORDER BY i) AS {h} FROM (SELECT k, i, sum(v) AS v FROM (SELECT k, unnest({h}) AS v, generate_subscripts({h}, 1) AS i FROM sound) GROUP BY k, i) GROUP BY k)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS k, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
  list_histogram(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS hist FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
o AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM c GROUP BY r),
h AS (SELECT r, doc_id, k, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  list_transform(['[^a-z]', '[^A-Z]', '[^0-9]', '[^\x20\x09-\x0D]', '[^.,;:!?''"()\-]', '[^#*$%&|<>@^_~+=/\\\[\]{{}}`]', '[a-zA-Z0-9\x20\x09-\x0D.,;:!?''"()\-#*$%&|<>@^_~+=/\\\[\]{{}}`]|[^\x00-\x7F]', '[\x00-\x7F]'], lambda x: length(regexp_replace(t, x, '', 'g'))) AS classes,
  list_transform({words}, lambda x: coalesce(list_extract(map_extract(hist, x), 1), 0)) AS listed FROM w LEFT JOIN o USING (r)),
f AS (SELECT *, list_append(listed, n_words - list_sum(listed)) AS common, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM h),
sound AS (SELECT k, classes, common FROM f WHERE NOT base_failed), mass AS (SELECT k FROM f WHERE NOT base_failed GROUP BY k HAVING sum(n_words) > 0),
own AS (SELECT * FROM {summed('classes')} x JOIN {summed('common')} y USING (k) JOIN mass USING (k)),
every AS (SELECT x.v AS classes, y.v AS common FROM (SELECT list(v ORDER BY i) AS v FROM (SELECT i, sum(v) AS v FROM (SELECT unnest(classes) AS v, generate_subscripts(classes, 1) AS i FROM sound) GROUP BY i)) x,
  (SELECT list(v ORDER BY i) AS v FROM (SELECT i, sum(v) AS v FROM (SELECT unnest(common) AS v, generate_subscripts(common, 1) AS i FROM sound) GROUP BY i)) y),
m AS (SELECT f.*, coalesce(own.classes, every.classes) AS rc, coalesce(own.common, every.common) AS rw FROM f CROSS JOIN every LEFT JOIN own USING (k)),
s AS (SELECT *, {share('classes')} AS p1, {share('rc')} AS q1, {share('common')} AS p2, {share('rw')} AS q2 FROM m),
v AS (SELECT *, {dist('p1', 'q1')} AS cd, {dist('p2', 'q2')} AS wd FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (cd > {most_classes} OR (n_words >= {guard} AND wd > {most_common} + {slack} / sqrt(greatest(n_words, 1)))) AS kept,
  round(cd, 9) AS class_distance, round(wd, 9) AS word_distance FROM v
"""
