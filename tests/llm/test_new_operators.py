"""Cross-tokenizer alignment, MinHash near-dedup and embedding whitening, against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orogen.llm import kit, minhash_dedup, ngram_join, token_alignment, whitening
from orogen.llm.queries import QUERIES
from tests.llm.test_operators import ODD, SCHEMA, WORD, rows_of

# ---------------------------------------------------------------- alignment


@pytest.fixture(scope="module")
def aligner():
    return token_alignment.Aligner()


def plain(aligner, text):
    """Uncut ids, groups and links of one text; None without tokens."""
    if not text:
        return None
    a, b = aligner.a._slow(f" {text}"), aligner.b.ids(text).tolist()
    a_bytes, b_bytes = aligner.a_bytes, aligner.b_bytes
    if b"".join(a_bytes[i] for i in a) != f" {text}".encode() or b"".join(b_bytes[i] for i in b) != f" {text}".encode():
        return None
    ends_a, ends_b = (np.cumsum([len(t[i]) for i in x]).tolist() for t, x in ((a_bytes, a), (b_bytes, b)))
    links, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        links.append((a[i], b[j]))
        p, q = ends_a[i], ends_b[j]
        i, j = i + (p <= q), j + (q <= p)
    cuts = sorted(set(ends_a) & set(ends_b))
    groups, lo_a, lo_b = [], 0, 0
    for c in cuts:
        hi_a, hi_b = ends_a.index(c, lo_a) + 1, ends_b.index(c, lo_b) + 1
        groups.append(",".join(map(str, a[lo_a:hi_a])) + "|" + ",".join(map(str, b[lo_b:hi_b])))
        lo_a, lo_b = hi_a, hi_b
    return a, b, groups, links


def aligned_by_force(aligner, rows):
    aligner.a_bytes, aligner.b_bytes = aligner.a.token_bytes(), aligner.b.token_bytes()
    each = [(i, plain(aligner, t)) for i, t in rows]
    count = collections.Counter(link for _, x in each if x for link in x[3])
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for i, x in each:
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = x
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
            out.append((i, len(a), len(b), len(groups), len(links), sum(count[v] == most[v[1]] for v in links), sum(count[v] for v in links), digest))
    return sorted(out, key=repr)


SPECIAL = ["<|endoftext|> and <s> or <0x41>", "▁odd", "a ▁ b", "tab\tand  two", " lead", "trail ", "x \n y\n \nz", "nul \0 byte", "　wide　 space", "it's we'll 12 345", "ﬁ ligature", "\x1c control", "é" * 3000]


def test_alignment(spark, aligner, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").repartition(3)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, QUERIES["op11_cross_tokenizer_alignment"](spark, tiny).collect()), key=repr) == aligned_by_force(aligner, rows)


def test_alignment_of_odd_rows_over_many_blocks(spark, aligner):
    texts = ODD[:8] + ["word " * 3000, "x" * 20_000, " " * 1_000_000, "\n" * 50_000, "a" + " " * 2000 + "b"] + SPECIAL + ODD[3:6]
    rows = rows_of(texts) + rows_of(["null id"], [None]) + rows_of([ODD[5], ODD[5]], [5, 5])
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(map(tuple, token_alignment.align(df, block=20_000).collect()), key=repr)
    # the plain merge of a million blanks is slow in tokens, not in the check: they are the same ids
    assert got == aligned_by_force(aligner, [(r[0], r[1]) for r in rows])
    assert token_alignment.align(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from([" ", "a", "b", "'", "s", "\n", "\t", "1", "é", "漢", "　", "\x1c", ".", "▁", "<|endoftext|>"[0]]), max_size=14), max_size=6))
@example(["a b", "b 's a", " a", "a \n", "'s"])
def test_chunks_are_whole_texts(aligner, texts):
    aligner.a_bytes, aligner.b_bytes = aligner.a.token_bytes(), aligner.b.token_bytes()
    cut = [token_alignment.CUT.split(t) if t else [] for t in texts]
    known = list(dict.fromkeys(w for words in cut for w in words))
    counts, groups, links, owners = aligner.chunks(known)
    for text, words in zip(texts, cut, strict=True):
        want, at = plain(aligner, text), [known.index(w) for w in words]
        if want is None:
            assert not text or not counts[at, 0].all()
            continue
        assert counts[at, 0].all()
        assert counts[at, 1:].sum(0).tolist() == [len(want[0]), len(want[1]), len(want[2]), len(want[3])]
        assert b"".join(groups[k] for k in at)[:-1].decode() == ";".join(want[2])
        pairs = collections.Counter(int(p) for k in at for p in links[owners == k])
        assert pairs == collections.Counter(a * aligner.b_words.size.size + b for a, b in want[3])


def test_ids_of_long_runs(aligner):
    for text in (" " * 300_000, "a" * 300_000, "\n" * 300_000, "x" + " " * 5000 + "y <|endoftext|>", "\t \n" * 50_000):
        assert aligner.a.ordinary_ids(text).tolist() == aligner.a._slow(text)
        assert aligner.a.ids(text).tolist() == aligner.a._whole(text)


# ---------------------------------------------------------------- MinHash


def components_by_force(rows, k, num, den):
    sets = []
    for i, text in rows:
        words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append((i, {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()))
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    known = [(i, s) for i, s in sets if i is not None and s]
    for n, (i, x) in enumerate(known):
        for j, y in known[:n]:
            if len(x & y) * den >= len(x | y) * num and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=repr)


def edited(rng, words, share):
    return [w if rng.random() > share else rng.choice("pqrstuvw") + str(rng.randrange(900)) for w in words]


@pytest.mark.parametrize("block", [4, 4096])
def test_near_duplicates_on_edited_texts(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BATCH_TILES", 500)
    rng, texts = random.Random(3), list(ODD[:7])
    passage = [f"c{i}" for i in range(60)]  # stands in a third of all texts
    for base in range(24):
        words = [f"w{rng.randrange(2000)}" for _ in range(rng.choice([3, 5, 9, 40, 70, 200]))]
        for share in (0, 0.01, 0.03, 0.05, 0.08):
            own = edited(rng, words, share)
            texts.append(" ".join(own + passage if base % 3 == 0 else own))
    rows = rows_of(texts) + rows_of(["null id", texts[20], texts[25], texts[26]], [None, 21, 9, 9])
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(map(tuple, got.collect()), key=repr) == components_by_force([(r[0], r[1]) for r in rows], 2, 8, 10)
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_jaccard_join_of_copies_and_repeated_ids(spark):
    """Copies that stay out of the rounds, ids of several texts between them, a third of all rows alike."""
    rng, texts, ids = random.Random(5), [], []
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(30)) for _ in range(6)]
    for i in range(90):
        texts.append(base[0] if i % 3 == 0 else base[rng.randrange(6)])
        ids.append(100 - i)
    texts += [base[1], base[2], base[2], base[3]]
    ids += [500, 500, 501, 501]
    df = spark.createDataFrame(rows_of(texts, ids), SCHEMA).repartition(6)
    got = sorted((r[0], r[1], r[2]) for r in ngram_join.similarity_components(df, 3, 9, 10).collect())
    root = {i: i for i in ids}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, t in zip(ids, texts, strict=True):
        for j, u in zip(ids, texts, strict=True):
            if t == u and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert [(d, c) for d, _, c in got] == sorted((i, find(i)) for i in ids)


@settings(max_examples=60, deadline=None)
@given(st.integers(5, 600), st.integers(0, 10**6))
def test_linked_sketches_share_lists_and_pass_the_estimate(n, seed):
    rng = np.random.default_rng(seed)
    bands, levels = minhash_dedup.SketchBands(8, 10), rng.integers(0, 3, 1 << ngram_join.BUCKET_BITS).astype(np.uint8)
    pool = kit.mix(rng.integers(0, 2**63, 2 * n + 2, dtype=np.uint64))
    gone = int(rng.integers(0, n // 9 + 1))
    x, y = np.unique(pool[:n]), np.unique(np.append(pool[: n - gone], pool[n : n + gone]))
    both = len(np.intersect1d(x, y))
    if both * 10 < (len(x) + len(y) - both) * 8:
        return
    assert bands.possible(np.array([len(x) + len(y)]), [bands.maps(x)[0]], [bands.maps(y)[0]]).all()
    differ = np.bitwise_count(bands.maps(x)[1] ^ bands.maps(y)[1]).sum(dtype=np.int64)
    assert bands.block_fits(np.array([len(y)]), len(x), np.array([differ])).all()
    if both < len(x) or both < len(y):
        a, b = (dict(ngram_join.tiles_of(v, bands, levels)) for v in (x, y))
        assert any(len(np.intersect1d(a[j], b[j])) >= bands.shared[j] for j in a.keys() & b.keys())


def test_shared_quantile():
    rng = np.random.default_rng(1)
    for population, common, draws in ((100, 80, 64), (400, 320, 64), (70, 56, 64)):
        t = minhash_dedup.shared_quantile(population, common, draws, 1e-3)
        seen = rng.hypergeometric(common, population - common, draws, 200_000)
        assert (seen < t).mean() <= 2e-3 and (seen < t + 1).mean() > 5e-4
    assert minhash_dedup.shared_quantile(50, 40, 50, 1e-9) == 40


# ---------------------------------------------------------------- whitening

VECTORS = "vec_id long, embedding array<float>, label int, n long, component int, x int, size int"


def whitened_by_force(rows, most=4):
    used = [(i, v) for i, v in rows if v is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(256 * np.array([v for _, v in used], float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    c = fit - sums / n
    values, basis = np.linalg.eigh(c.T @ c / n)
    values, basis = values[::-1][:most], basis[:, ::-1][:, :most]
    return [i for i, _ in used], n, ((n * x - sums) ** 2).sum(1), (x - sums / n) @ basis / np.sqrt(values), values / np.trace(c.T @ c / n)


def held(got, want):
    """Rows of the operator against brute force; a component's sign is free."""
    ids, n, deviation, white, explained = want
    key = sorted(range(len(ids)), key=lambda k: (str(ids[k]), int(deviation[k]), np.abs(white[k]).round(6).tolist()))
    rows = collections.defaultdict(list)
    for r in got:
        rows[r["component"]].append(r)
    assert sorted(rows) == list(range(1, len(explained) + 1))
    for k, part in rows.items():
        assert all(r["n"] == n and abs(r["explained"] - explained[k - 1]) < 1e-9 and r["identity_error"] < 1e-9 for r in part)
        mine = sorted((str(r["vec_id"]), int(r["deviation"]), round(abs(r["whitened"]), 6)) for r in part)
        assert [m[:2] for m in mine] == sorted((str(ids[j]), int(deviation[j])) for j in key)
        wide = sorted((str(ids[j]), int(deviation[j]), round(abs(white[j, k - 1]), 6)) for j in key)
        assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(mine, wide, strict=True))


def test_whitening(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/embeddings.parquet").collect()
    held(QUERIES["op13_embedding_whitening"](spark, tiny).collect(), whitened_by_force([(r["vec_id"], r["embedding"]) for r in rows]))


def test_whitening_of_odd_rows_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FANIN", 2)
    rng = np.random.default_rng(2)
    vectors = [(int(i), [float(np.float32(c)) for c in rng.normal(size=6) * [1, 2, 3, 4, 5, 6]]) for i in range(200)]
    hot = [(1000 + i, vectors[0][1]) for i in range(100)]
    odd = [(1, None), (2, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (3, [float("nan")] * 6), (4, [float("inf")] * 6), (5, []), (None, vectors[3][1]), (7, vectors[7][1]), (7, vectors[7][1])]
    every = vectors + hot + odd
    df = spark.createDataFrame([(i, v, 1, 2, 3, 4, 5) for i, v in [*every, (8, [1.0, 2.0])]], VECTORS).repartition(9)
    held(whitening.whiten(df).collect(), whitened_by_force(every))


def test_whitening_without_variance(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 1, 2, 3, 4, 5) for i, v in rows], VECTORS)
    assert whitening.whiten(make([])).collect() == []
    assert whitening.whiten(make([(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect() == []
    line = whitening.whiten(make([(1, [0.5, 0.5]), (2, [0.25, 0.25]), (3, [0.0, 0.0])])).collect()
    assert {r["component"] for r in line} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in line)
    huge = whitening.whiten(make([(1, [3e15, 0.0]), (2, [-3e15, 1.0]), (3, [1.0, 2.0])])).collect()
    assert max(r["deviation"] for r in huge) > 2**63 and {r["n"] for r in huge} == {3}
    beyond = whitening.whiten(make([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1.0, 2.0])])).collect()
    assert {r["deviation"] for r in beyond if r["vec_id"] == 1} == {None}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.integers(0, 10**6), st.sampled_from(["full", "low", "twice", "zero", "spread"]))
def test_symmetric_eigen(d, seed, kind):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(d, d))
    q, _ = np.linalg.qr(a)
    spectrum = {"full": rng.normal(size=d), "low": np.arange(d) < 2, "twice": np.arange(d) // 2, "zero": np.zeros(d), "spread": 10.0 ** -np.arange(d)}[kind].astype(float)
    a = (q * spectrum) @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.symmetric_eigen(a)
    size = max(1e-300, np.abs(a).max())
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * max(size, 1)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-12 * max(size, 1)


def test_moments_merge_like_one_pass():
    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, size=(500, 5))
    whole, parts = whitening.Moments(5), whitening.Moments(5)
    whole.add(x)
    for part in np.array_split(x, 7):
        m = whitening.Moments(5)
        m.add(part)
        parts.merge(m.n, m.sums, m.mean, m.squares)
    assert parts.n == 500 and parts.sums.tolist() == whole.sums.tolist() == x.sum(0).tolist()
    assert np.allclose(parts.covariance(), np.cov(x.T, bias=True), rtol=1e-12) and np.allclose(whole.covariance(), np.cov(x.T, bias=True), rtol=1e-12)


def test_operators_name_no_clashing_columns(spark):
    df = spark.createDataFrame(rows_of(["a b c", "a b c d"]), SCHEMA).withColumns({"block": F.lit(1), "pairs": F.lit("x"), "n_links": F.lit(2), "component_id": F.lit(3)})
    assert token_alignment.align(df).count() == 2 and minhash_dedup.near_duplicates(df).count() == 2
