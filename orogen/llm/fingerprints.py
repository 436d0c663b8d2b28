"""Document fingerprints: invertible Bloom lookup sketches, DataFrame functions only.

A text's paragraphs are its lines. A line of more than ``LONG`` characters is cut after sentence
ends, a sentence of more than twice as many after words that end in k, w or y, and what is
still longer than ``LONG`` into blocks of that many from its start: all cuts depend on the line's own
characters only, and one-line texts and texts without punctuation have parts too. Each distinct paragraph's
64-bit digest goes to one cell in each of three groups of eight cells; a
cell has a count, the xor of its digests and the xor of their check hashes.

Two versions' sketches subtract cell by cell: what both hold cancels. Peeling then
takes cells with count 1 or -1 whose check fits, removes their digests
everywhere, and repeats. If cells remain, the attempt failed, and both versions
are sketched again in blocks, a digest's hash naming its block; a block that still
fails is sketched again as four. The recovered digests are the exact difference.
After the last retry a block's difference is counted from its digests.

Likeness is 1 - difference / (paragraphs of both); two texts without
paragraphs are alike (1). The fingerprint is the one-block sketch with the
number of paragraphs and the text's hash, so equal texts have equal fingerprints.

Next documents: doc_ids are cut at approximate quantiles into ranges of some
thousand rows; each range's first row is also dealt to the range before it, and a
window over the range reads the following row. No window spans the table.

Cases: null text counts as empty. Repeated doc_ids are ordered by a hash of their text; rows
with a null doc_id come last. A single row is its own next document. Extra columns are ignored. Texts of any
length are taken whole. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LONG, GROUPS, WIDTH, ROUNDS = 200, 3, 8, 12
ENDS, WORDS = r"(?<=[.!?]) |(?<=[\u3002\uff01\uff1f])", r"(?<=[kwy]) "
LOAD, RETRIES = 8, 3


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and pass it on, inside a row's expression."""
    return F.transform(F.array(value), use)[0]


def paragraph_digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's non-empty paragraphs."""
    def finer(parts: Column, most: int, cut: Callable[[Column], Column]) -> Column:
        return F.flatten(F.transform(parts, lambda x: F.when(F.length(x) > most, cut(x)).otherwise(F.array(x))))

    def blocks(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.length(x) - 1, F.lit(LONG)), lambda at: F.substring(x, at + 1, F.lit(LONG)))

    cut = finer(F.split(text, "\n", -1), LONG, lambda x: F.split(x, ENDS, -1))
    cut = finer(finer(cut, 2 * LONG, lambda x: F.split(x, WORDS, -1)), LONG, blocks)
    return F.array_distinct(F.transform(F.filter(cut, lambda x: x != ""), lambda x: F.xxhash64(x)))


def cells_of(group: int) -> Column:
    """The three bits that name a cell of a group, in place, for all its cells."""
    return F.array(*(F.lit(c << (5 + 3 * group)).cast("long") for c in range(WIDTH)))


def placed(digest: Column, group: int, cell: Column) -> Column:
    return digest.bitwiseAND(F.lit((WIDTH - 1) << (5 + 3 * group)).cast("long")) == cell


def check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(3))


def _xor(values: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(f(x)))


def _cell(count: Column, key: Column, proof: Column) -> Column:
    return F.struct(count.cast("int").alias("c"), key.alias("k"), proof.alias("h"))


def split(sets: Column, bits: Column, shift: int) -> Column:
    """Each set of digests in 2^bits sets by the hash bits above ``shift``."""
    fan = F.pow(F.lit(2.0), bits).cast("int")

    def part(own: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), fan - 1), lambda b: F.filter(own, lambda d: F.shiftrightunsigned(d, shift).bitwiseAND((fan - 1).cast("long")) == b))

    return F.when(bits == 0, sets).otherwise(F.flatten(F.transform(sets, part)))


def blocks(digests: Column, bits: Column) -> Column:
    """2^bits sets of digests, at most 2^12, four bits at a time: the work grows with the
    number of digests and the logarithm of the number of blocks."""
    sets = F.array(digests)
    for k in range(3):
        sets = split(sets, F.greatest(F.lit(0), F.least(F.lit(4), bits - 4 * k)), 16 + 4 * k)
    return sets


def sketch(digests: Column) -> Column:
    """The cells of a set of digests, GROUPS x WIDTH of them."""

    def group(g: int) -> Column:
        def cell(c: Column) -> Column:
            own = F.filter(digests, lambda d: placed(d, g, c))
            return bind(own, lambda got: F.when(F.size(got) == 0, _empty()).otherwise(_cell(F.size(got), _xor(got, lambda d: d), _xor(got, check))))

        return F.transform(cells_of(g), cell)

    return F.concat(*(group(g) for g in range(GROUPS)))


def _empty() -> Column:
    return _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))


def subtract(a: Column, b: Column) -> Column:
    """The sketch of the symmetric difference, counts signed."""
    return F.zip_with(a, b, lambda p, q: _cell(p["c"] - q["c"], p["k"].bitwiseXOR(q["k"]), p["h"].bitwiseXOR(q["h"])))


def peel(cells: Column) -> Column:
    """struct(left: cells that remain filled, found: digests recovered) of one block."""

    def state(x: Column, found: Column, live: Column) -> Column:
        return F.struct(x.alias("cells"), found.cast("int").alias("found"), live.alias("live"))

    def pure(x: Column) -> Column:
        fits = F.filter(x, lambda c: (F.abs(c["c"]) == 1) & (c["h"] == check(c["k"])))
        return F.array_distinct(F.transform(fits, lambda c: F.struct(c["c"].alias("c"), c["k"].alias("k"))))

    def without(x: Column, gone: Column) -> Column:
        signs = lambda got: F.aggregate(got, F.lit(0), lambda a, d: a + d["c"])

        def group(g: int) -> Column:
            def cell(c: Column, at: Column) -> Column:
                here = F.filter(gone, lambda d: placed(d["k"], g, at))
                return bind(here, lambda got: F.when(F.size(got) == 0, c).otherwise(_cell(c["c"] - signs(got), c["k"].bitwiseXOR(_xor(got, lambda d: d["k"])), c["h"].bitwiseXOR(_xor(got, lambda d: check(d["k"]))))))

            return F.zip_with(F.slice(x, g * WIDTH + 1, WIDTH), cells_of(g), cell)

        return F.concat(*(group(g) for g in range(GROUPS)))

    def turn(s: Column, _: Column) -> Column:
        step = bind(pure(s["cells"]), lambda gone: F.when(F.size(gone) == 0, state(s["cells"], s["found"], F.lit(False))).otherwise(state(without(s["cells"], gone), s["found"] + F.size(gone), F.lit(True))))
        return F.when(~s["live"], s).otherwise(step)

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state(cells, F.lit(0), F.lit(True)), turn)
    return bind(done, lambda s: F.struct(F.size(F.filter(s["cells"], lambda c: (c["c"] != 0) | (c["k"] != 0))).alias("left"), s["found"].alias("found")))


def _bits(*sets: Column) -> Column:
    """As many bits of blocks as keep about LOAD digests of the largest set in each."""
    most = F.greatest(*(F.size(x) for x in sets), F.lit(1)).cast("double")
    return F.greatest(F.lit(2), F.least(F.lit(12), F.ceil(F.log2(F.greatest(F.lit(1.0), most / LOAD))))).cast("int")


def _unless(settled: Column) -> Callable[[Column], Column]:
    return lambda _: ~settled


def _in_four(shift: int) -> Callable[[Column], Column]:
    four = lambda own: split(F.array(own), F.lit(2), shift)
    return lambda p: F.zip_with(four(p["a"]), four(p["b"]), lambda x, y: F.struct(x.alias("a"), y.alias("b"), sketch(x).alias("x")))


def _fixed(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds or replaces columns behind inline(), so that no expression is copied into later ones."""
    kept = [F.col(c) for c in rows.columns if c not in columns]
    return rows.select(F.inline(F.array(F.struct(*kept, *(c.alias(k) for k, c in columns.items())))))


def with_likeness(rows: DataFrame, pairs: dict[str, tuple[str, str, str, str]]) -> DataFrame:
    """Adds a likeness for each name -> (digests, sketch, other digests, other sketch); the first set is the same in all.

    The first attempt subtracts the one-block sketches. A pair that keeps cells is sketched in
    blocks; each retry sketches the blocks that failed as four. What the last retry leaves
    is counted from the digests.
    """
    first = {n: peel(subtract(F.col(x), F.col(y))) for n, (_, x, _, y) in pairs.items()}
    rows = _fixed(rows, **{f"{n}_try": c for n, c in first.items()})
    whole = {n: F.col(f"{n}_try.left") == 0 for n in pairs}
    settled = F.lit(True)
    for n in pairs:
        settled = settled & whole[n]
    own = next(iter(pairs.values()))[0]  # the first set of every pair; its blocks are sketched once
    rows = _fixed(rows, _bits=F.when(~settled, _bits(F.col(own), *(F.col(b) for _, _, b, _ in pairs.values()))))
    rows = _fixed(rows, _own=F.transform(F.filter(blocks(F.col(own), F.col("_bits")), lambda _: ~settled), lambda a: F.struct(a.alias("a"), sketch(a).alias("x"))))
    both = lambda b: F.zip_with("_own", blocks(F.col(b), F.col("_bits")), lambda p, q: F.struct(p["a"].alias("a"), q.alias("b"), p["x"].alias("x")))
    rows = _fixed(
        rows,
        **{f"{n}_found": F.when(whole[n], F.col(f"{n}_try.found")).otherwise(F.lit(0)) for n in pairs},
        **{f"{n}_open": F.when(whole[n], F.array()).otherwise(both(b)) for n, (_, _, b, _) in pairs.items()},
    ).drop("_own", "_bits")
    for retry in range(RETRIES):
        rows = _fixed(rows, **{f"{n}_open": F.transform(f"{n}_open", lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), peel(subtract(p["x"], sketch(p["b"]))).alias("r"))) for n in pairs})
        found, left = {}, {}
        for n in pairs:
            done = F.aggregate(f"{n}_open", F.lit(0), lambda s, p: s + F.when(p["r"]["left"] == 0, p["r"]["found"]).otherwise(F.lit(0)))
            found[f"{n}_found"] = F.col(f"{n}_found") + done
            failed = F.filter(f"{n}_open", lambda p: p["r"]["left"] != 0)
            left[f"{n}_open"] = F.flatten(F.transform(failed, _in_four(28 + 2 * retry)))
        rows = _fixed(rows, **found, **left)
    for n, (a, _, b, _) in pairs.items():
        rest = F.aggregate(f"{n}_open", F.lit(0), lambda s, p: s + F.size(F.array_except(p["a"], p["b"])) + F.size(F.array_except(p["b"], p["a"])))
        total = F.size(a) + F.size(b)
        rows = rows.withColumn(n, F.when(total == 0, F.lit(1.0)).otherwise(1.0 - (F.col(f"{n}_found") + rest) / F.greatest(total, F.lit(1))))
    return rows.drop(*(f"{n}_{x}" for n in pairs for x in ("try", "found", "open")))


def as_text(digests: Column, cells: Column, whole: Column) -> Column:
    """The fingerprint: text hash, number of paragraphs, cells in hexadecimal."""
    parts = F.transform(cells, lambda c: F.concat(F.hex(c["c"]), F.lit("."), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(F.pmod(c["h"], F.lit(1 << 32))), 8, "0")))
    return F.concat_ws(":", F.lpad(F.hex(whole), 16, "0"), F.size(digests).cast("string"), F.array_join(parts, ""))


def with_next(docs: DataFrame, payload: list[str], rows_a_range: int = 2000, most_ranges: int = 4096) -> DataFrame:
    """Adds ``next``: a struct of ``payload`` of the row with the following doc_id."""
    spark = docs.sparkSession
    n = docs.select("doc_id").count()
    ranges = max(1, min(most_ranges, n // rows_a_range))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else None
    cuts = sorted(set(cuts or []))
    bounds = F.array(*[F.lit(int(c)).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    own = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.size(F.filter(bounds, lambda b: b < F.col("doc_id"))))
    rows = docs.withColumn("range", own).withColumn("tie", F.xxhash64("text"))
    order = F.struct(F.col("doc_id"), F.col("tie"))
    heads = sorted(rows.groupBy("range").agg(F.min(order).alias("head")).collect(), key=lambda r: r["range"])  # a row a range
    table = [(r["range"], heads[k - 1]["range"], r["head"]["doc_id"], r["head"]["tie"]) for k, r in enumerate(heads)]
    heads = spark.createDataFrame(table, "range int, before int, head_id long, head_tie long")
    rows = rows.join(F.broadcast(heads), "range")  # most_ranges + 2 rows at most
    first = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    here, ahead = F.struct(F.col("range"), F.lit(False).alias("guest")), F.struct(F.col("before").alias("range"), F.lit(True).alias("guest"))
    dealt = rows.select(*docs.columns, "tie", F.explode(F.when(first, F.array(here, ahead)).otherwise(F.array(here))).alias("at"))
    window = Window.partitionBy("at.range").orderBy("at.guest", F.asc_nulls_last("doc_id"), "tie")
    return dealt.withColumn("next", F.lead(F.struct(*payload)).over(window)).filter(~F.col("at.guest")).select(*docs.columns, "next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next of every row.

    The edited text keeps the first half (rounded up) and continues with the start of
    the next document, as many characters as were cut or all it has.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("digests", paragraph_digests(F.col("text"))), ["text", "digests"])
    n = F.length("text")
    cut = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.xxhash64("text").alias("whole"), "digests", F.col("next.digests").alias("next_digests"), edited.alias("edited"))
    rows = _fixed(rows).select("doc_id", "n_chars", "whole", "digests", "next_digests", F.xxhash64("edited").alias("edited_whole"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), paragraph_digests(F.col("edited")).alias("edited_digests"))
    rows = _fixed(rows)
    sides = {"": "digests", "edited_": "edited_digests", "next_": "next_digests"}
    rows = _fixed(rows, **{f"{k}cells": sketch(F.col(v)) for k, v in sides.items()})
    rows = with_likeness(rows, {f"near_{k}": ("digests", "cells", f"{k}_digests", f"{k}_cells") for k in ("edited", "next")})
    shown = {f"{k}fingerprint": as_text(F.col(f"{k}digests"), F.col(f"{k}cells"), F.col(f"{k}whole")) for k in ("", "edited_")}
    return rows.select("doc_id", "n_chars", "edited_sha256", *(c.alias(k) for k, c in shown.items()), "near_edited", "near_next")
