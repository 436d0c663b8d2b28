import collections
import functools
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orogen.llm import fingerprints, graph, kit, licenses, line_dedup, mixing, ngram_join, packing, quality, suffix_dedup, token_counts, tokens, toxicity
from orogen.llm.queries import ORACLES, QUERIES
from tests.conftest import same_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, kept string, tile int, h1 long, rank int, token string"


def rows_of(texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en", "s", None if t is None else len(t), 1, "k", 2, 3, 4, "t") for i, t in zip(ids, texts, strict=True)]


ODD = [None, "", "   \n\t ", "one", "One  two", "one two three four five six", "é ü 漢字 \U0001f600 x", "a\nb\n\na\n", "word " * 30_000, "x" * 100_000, "one two three four five six"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, a null id, clashing extra columns."""
    rows = rows_of(ODD) + rows_of([ODD[5], ODD[5], "another text", None], [5, 5, 3, None]) + rows_of(["null id"], [None])
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


def texts_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, tiny, duck, name):
    got, want = same_rows(QUERIES[name](spark, tiny), duck, ORACLES[name])
    assert got == want and got


def test_odd_rows_pass_every_operator(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (5, 1), (7, None), (None, 1)], "doc_id long, toxic int")
    n = odd.count()
    one_row_each = {
        "join": ngram_join.similarity_components,
        "lines": line_dedup.drop_frequent_lines,
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "quality": quality.quality_rules,
        "prints": fingerprints.fingerprints,
        "mix": mixing.mix_sources,
        "suffix": suffix_dedup.remove_repeats,
    }
    for name, f in one_row_each.items():
        assert f(odd).count() == n, name
        assert f(empty).count() == 0, name
    assert packing.pack(packing.pieces(odd)).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert packing.pack(packing.pieces(empty)).count() == 0
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0
    assert token_counts.maintained(odd).filter("tokenizer = 'words-1'").first()["n_docs"] == n
    assert token_counts.maintained(empty).count() == 0


# Kit ------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b漢", max_size=12)), max_size=6))
def test_words_of_a_view(texts):
    view = kit.TextView(pa.array(texts, pa.string()))
    hashes = view.word_hashes()
    got = [[view.data[a:b].tobytes().decode() for a, b in zip(view.starts[i:j], view.ends[i:j], strict=True)] for i, j in zip(view.first[:-1], view.first[1:], strict=True)]
    assert got == [WORD.findall(t or "") for t in texts]
    flat = [w for d in got for w in d]
    assert len(set(hashes.tolist())) == len(set(flat))


def test_components(spark):
    edges = [(k, k + 1) for k in range(10, 40)] + [(1, 2), (2, 9), (9, 1), (50, 50)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(df, kit.Workspace(spark), "t").collect()}
    assert got == {k: 10 for k in range(10, 41)} | {1: 1, 2: 1, 9: 1}


# 1 License scans ------------------------------------------------------------------------------------


def test_license_scan(spark):
    rng = random.Random(4)
    filler = lambda n: " ".join(rng.choice(["aba", "cod", "eli", "fam", "gor"]) + str(rng.randint(0, 99)) for _ in range(n))
    names = sorted(licenses.TEMPLATES)
    texts, want = [], set()
    for k in range(120):
        name = rng.choice(names)
        texts.append(f"{filler(rng.randint(0, 60))}\n{licenses.TEMPLATES[name].upper()} {filler(rng.randint(0, 60))}")
        want.add((k, name))
    texts += [filler(200) for _ in range(20)]
    got = licenses.scan(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()
    found = {(r["doc_id"], r["license"]) for r in got if r["containment"] == 1.0}
    assert want <= found
    assert all(any(licenses.TEMPLATES[r["license"]].split()[0].lower() in texts[r["doc_id"]].lower() for _ in [0]) for r in got)
    shingle = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[a-z0-9\u0080-￿]+", t.lower())] for i in range(max(1, len(w) - 4))}
    for k, t in enumerate(texts):  # every template wholly within a text is found
        for n in names:
            if shingle(licenses.TEMPLATES[n]) <= shingle(t):
                assert (k, n) in found
    assert all(licenses.miss_bound(t, 0.8) < 2e-6 for t in range(1, 200))
    with pytest.raises(ValueError):
        licenses.Catalogue({"empty": " ,. "})


# 2 N-gram Jaccard join ------------------------------------------------------------------------------


def jaccard_components(rows, k, num, den):
    sets = {}
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d)) for d, s in sets.items())


@pytest.mark.parametrize(("k", "num"), [(3, 9), (5, 8), (1, 5)])
def test_jaccard_join(docs, k, num):
    got = sorted(tuple(r) for r in ngram_join.similarity_components(docs, k, num, 10).collect())
    assert got == jaccard_components(texts_of(docs), k, num, 10)


def test_jaccard_join_in_blocks(spark, monkeypatch):
    """Groups that share a tile without being near: no pair may be lost, whatever the block."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(70):
        own = base[:]
        for _ in range(rng.randint(0, 12)):
            own[rng.randrange(60)] = f"x{rng.randint(0, 30)}"
        texts.append(" ".join(own[: rng.randint(40, 60)]))
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = sorted(tuple(r) for r in ngram_join.similarity_components(df, 1, 8, 10).collect())
    assert got == jaccard_components(list(enumerate(texts)), 1, 8, 10)


def wrong_corpora(spark, corpora, batches):
    """Which corpora get other components than brute force; text i of a corpus goes to batch i modulo ``batches``."""
    rows, want = [[] for _ in range(batches)], []
    for c, texts in enumerate(corpora):
        own = [(100 * c + i, t) for i, t in enumerate(texts)]
        want += [(d, p) for d, _, p in jaccard_components(own, 1, 9, 10)]
        for d, t in own:
            rows[d % 100 % batches].append((d, t))
    parts = [spark.createDataFrame(r, "doc_id long, text string").coalesce(1) for r in rows]
    out = ngram_join.similarity_components(functools.reduce(lambda a, b: a.unionByName(b), parts), 1, 9, 10)
    got = {r["doc_id"]: r["component_id"] for r in out.collect()}
    assert len(got) == len(want)
    return sorted({d // 100 for d, p in want if got[d] != p})


def test_jaccard_join_with_an_older_text_of_the_same_opening(spark):
    """The older text leads some tiles of x and y = x + one word, and is left out as it shares too few."""
    corpora = []
    for c in range(800):
        rng = random.Random(c)
        x = [f"c{c}w{i}" for i in range(rng.randint(10, 24))]
        corpora.append([" ".join(x[: rng.randint(1, len(x) - 1)] + [f"c{c}o{i}" for i in range(rng.randint(2, 24))]), " ".join(x), " ".join([*x, "z"])])
    assert wrong_corpora(spark, corpora, 1) == []


def test_jaccard_join_of_tiles_with_like_members(spark):
    """Tiles with the same documents but other leaders are different questions."""
    corpora = []
    for seed in [*range(40), 1678, 2882, 3161, 3465, 3556]:
        rng = random.Random(seed)
        base = [f"s{seed}w{i}" for i in range(rng.randint(14, 19))]
        texts = []
        for _ in range(12):
            own = base[rng.randint(0, 3) : rng.randint(len(base) - 3, len(base))]
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = f"s{seed}x{rng.randint(0, 9)}"
            texts.append(" ".join(own))
        corpora.append(texts)
    assert wrong_corpora(spark, corpora, 3) == []


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([(8, 10), (9, 10), (1, 2)]), st.integers(1, 400), st.integers(0, 40), st.integers(0, 10**6))
def test_linked_sets_share_tiles(threshold, n, d, seed):
    num, den = threshold
    rng = np.random.default_rng(seed)
    levels = rng.integers(0, 3, 1 << ngram_join.BUCKET_BITS).astype(np.uint8)
    x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    gone = min(d // 2, len(x) - 1)
    y = np.unique(np.concatenate([x[gone:], rng.integers(0, 2**63, d - d // 2).astype(np.uint64)]))
    both = len(np.intersect1d(x, y))
    bands = ngram_join.Bands(num, den)
    if den * both >= num * (len(x) + len(y) - both) and not np.array_equal(x, y):
        a, b = (dict(ngram_join.tiles_of(v, bands, levels)) for v in (x, y))
        assert any(len(np.intersect1d(a[j], b[j])) >= bands.shared[j] for j in a.keys() & b.keys())
    apart = ngram_join.apart(ngram_join.parity_bits(x), ngram_join.parity_bits(y))
    assert apart <= len(x) + len(y) - 2 * both


def test_jaccard_join_of_empty_and_equal_thirds(spark):
    """A third of all rows empty, a third equal: none of them weighs on one group of sketches."""
    texts = [""] * 300 + ["one text that very many documents hold word for word"] * 300
    texts += [f"d{i // 2} " + " ".join(f"w{i // 2}x{j}" for j in range(20)) for i in range(300)]
    out = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_components(spark.createDataFrame(rows_of(texts), SCHEMA).repartition(5)).collect()}
    assert out == {i: i if i < 300 else 300 if i < 600 else i - i % 2 for i in range(900)}
    bands, levels = ngram_join.Bands(8, 10), np.zeros(1 << ngram_join.BUCKET_BITS, np.uint8)
    rows = ngram_join._dealt(spark.createDataFrame(rows_of(texts), SCHEMA).repartition(5), 5, bands, levels, 16).filter("body is null and tile is null")
    assert max(r["count"] for r in rows.groupBy("group").count().collect()) < 3 * 900 / 16


# 3 Line dedup ---------------------------------------------------------------------------------------


def test_line_dedup_edges(spark):
    common = ["  Shared LINE\t"] * 9 + ["shared line"]
    texts = [f"{c}\nown {i}\n\n{c}" for i, c in enumerate(common)] + ["É\né"] * 9 + [None, "shared line"]
    out = line_dedup.drop_frequent_lines(spark.createDataFrame(rows_of(texts), SCHEMA), least=10)
    got = {r["doc"]["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in out.collect()}
    for i in range(10):
        assert got[i] == (4, 2, f"own {i}\n")
    assert got[10] == (2, 0, "É\né") and got[19] == (1, 0, "") and got[20] == (1, 1, "")


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (7, 2), (5, 9)])
def test_line_runs_do_not_depend_on_batches(spark, tiny, docs, batches, fanout):
    whole = line_dedup.drop_frequent_lines(docs, least=4)
    parts = line_dedup.drop_frequent_lines(docs, least=4, batches=batches, fanout=fanout)
    key = lambda df: sorted((r["doc"]["doc_id"], r["n_dropped"], r["kept"]) for r in df.collect())
    assert key(whole) == key(parts)


def test_line_runs_go_on_after_reopening(spark):
    """Batches added by one store object each; a broken-off add in between; merges on the runs' order."""
    root = kit.Workspace(spark).root
    batches = [[(k % 7 + 100 * (k % 3), 1) for k in range(s, 40 + s)] for s in range(6)]
    counts = collections.Counter()
    for i, batch in enumerate(batches):
        runs = line_dedup.LineRuns(spark, kit.Workspace(spark, root), least=11, fanout=2, buckets=4)
        if i == 3:
            runs._write(spark.createDataFrame([(5, 5, 99)], line_dedup.LineRuns.SCHEMA), f"frequent-{runs.manifest.version + 1}")
        runs = line_dedup.LineRuns(spark, kit.Workspace(spark, root), least=11, fanout=2, buckets=4)
        runs.add(spark.createDataFrame(batch, "h1 long, h2 long"))
        counts.update(batch)
        want = {k for k, n in counts.items() if n >= 11}
        assert {tuple(r) for r in runs.frequent_keys().collect()} == want
    assert want
    assert line_dedup.LineRuns(spark, kit.Workspace(spark, root), buckets=9).buckets == 4
    with runs._in_order():
        plan = runs._met(runs._run(runs.runs[0][1]))
        text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("SortMergeJoin") == len(runs.runs) > 1
    assert "Broadcast" not in text and "Exchange" not in text and "Sort [" not in text


def test_line_dedup_of_many_frequent_lines(spark):
    """Time in proportion to a document's lines, all of them frequent but each third, some twice."""
    n = 20_000
    texts = ["\n".join(f"own {d} {i}" if i % 3 == 0 else f" Common {i % 15_000}" for i in range(n)) for d in range(10)]
    out = line_dedup.drop_frequent_lines(spark.createDataFrame(rows_of(texts), SCHEMA).repartition(4))
    began = time.monotonic()
    out = out.collect()
    assert time.monotonic() - began < 10
    for r in out:
        want = [x for x in r["doc"]["text"].split("\n") if x.startswith("own")]
        assert r["kept"] == "\n".join(want) and (r["n_lines"], r["n_dropped"]) == (n, n - len(want))


def test_manifest_keeps_its_last_versions(spark):
    store = kit.Workspace(spark)
    manifest = kit.Manifest(store, "m")
    for k in range(5):
        manifest.save([("a", str(j)) for j in range(k)])
    again = kit.Manifest(store, "m")
    assert again.version == 4 and again.names("a") == ["0", "1", "2", "3"]
    versions = spark.read.schema(kit.Manifest.SCHEMA).parquet(store.path("m-manifest")).select("version").distinct()
    assert {r["version"] for r in versions.collect()} == {2, 3, 4}


def test_line_digest_has_two_hashes(spark):
    rows = spark.range(3).select(line_dedup.digest(F.concat(F.lit("line "), "id")).alias("d")).select("d.*", F.xxhash64("d.h1"), F.xxhash64("d.h1", F.lit(1))).collect()
    same = spark.createDataFrame([(r["h1"],) for r in rows], "h1 long").select(F.expr("xxhash64(1, h1)")).collect()
    assert all(r["h2"] not in tuple(r)[:1] + tuple(r)[2:] + tuple(x) for r, x in zip(rows, same, strict=True))


# 4 Toxicity -----------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    wrong = sum(r["predicted"] and not r["toxic"] for r in rows)
    toxic = sum(r["toxic"] for r in rows)
    assert hit / toxic > 0.85 and wrong / (len(rows) - toxic) < 0.03
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_misspellings_share_grams():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [" ".join(word() for _ in range(20)) + (" stupidity" if i % 2 else "") for i in range(200)]
    model = toxicity.train(texts, np.array([i % 2 for i in range(200)], np.float32), np.ones(200, np.float32))
    plain = " ".join(word() for _ in range(20))
    low, high = toxicity.scores(kit.TextView(pa.array([plain, plain + " stupiditty"])), model)
    assert low < 0.5 < high


# 5 Quality rules ------------------------------------------------------------------------------------


def base_counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality_base_counts(docs, odd):
    for df in (docs, odd.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        want = dict(texts_of(df)) if df is docs else {r["doc_id"]: r["text"] for r in df.collect()}
        for r in quality.quality_rules(df.filter("true")).collect():
            if r["doc"]["doc_id"] in (3, 5) and df is not docs:
                continue  # which of the repeated rows stayed is not fixed
            n = base_counts(want[r["doc"]["doc_id"]])
            assert tuple(r[c] for c in quality.BASE) == n
            assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
            assert not (r["base_failed"] and r["kept"])


def test_js_distance():
    p, q = np.array([[1, 0], [2, 2], [0, 0], [3, 1]]), np.array([[0, 5], [7, 7], [1, 0], [1, 3]])
    got = quality.js_distance(p, q)
    a, m = np.array([0.75, 0.25]), np.array([0.5, 0.5])
    want = np.sqrt((a * np.log2(a / m)).sum() / 2 + (a[::-1] * np.log2(a[::-1] / m)).sum() / 2)
    assert got[:2] == pytest.approx([1, 0]) and got[3] == pytest.approx(want) and got[2] <= 1


def test_quality_verdicts_follow_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.quality_rules(docs).select("doc.doc_id", "kept", "base_failed").join(labels, "doc_id").filter("not base_failed").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.2


@pytest.mark.parametrize("rare", [False, True])
def test_quality_verdicts_in_small_languages(spark, tiny, rare):
    """Languages of a few thousand words, or one of five documents among sf0.01, are judged by their own words."""
    docs, labels = (spark.read.parquet(f"{tiny if not rare else '/root/testdata/sf0.01'}/{t}.parquet") for t in ("documents", "labels"))
    if rare:
        five = docs.join(labels.filter("quality = 1"), "doc_id", "left_semi").filter("lang = 'de'").orderBy("doc_id").limit(5)
        docs = docs.filter("lang <> 'de'").unionByName(five)
    rows = quality.quality_rules(docs).select("doc.doc_id", "doc.lang", "kept", "base_failed").join(labels, "doc_id")
    rows = rows.filter("not base_failed and quality = 1").filter("lang = 'de'" if rare else "lang <> 'en'").collect()
    assert rows and all(r["kept"] for r in rows)


# 6 Best-fit packing ---------------------------------------------------------------------------------


def check_packing(rows, pieces, size=packing.SIZE):
    whole = collections.defaultdict(list)
    for r in rows:
        whole[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in whole.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= size
    assert len(rows) == pieces
    return len(whole)


@pytest.fixture(scope="module")
def plain_ids():
    """The contract's call: an unaltered Tokenizer."""
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: whole.encode(text, add_special_tokens=False).ids


def wanted_pieces(pairs, plain_ids):
    want = collections.Counter()
    for d, t in pairs:
        ids = np.append(plain_ids(t or ""), 0).astype("<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want.update((d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts)))
    return want


def test_packing(spark, docs, plain_ids):
    want = wanted_pieces(texts_of(docs), plain_ids)
    rows = packing.pack(packing.pieces(docs)).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    n = check_packing(rows, want.total())
    assert n <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1
    with_ids = packing.pack(packing.pieces(docs, with_ids=True)).filter("doc_id = 0").first()
    assert zlib.crc32(np.array(with_ids["ids"], "<u4").tobytes()) == with_ids["ids_crc32"]


def test_packing_of_odd_rows_and_hot_lengths(spark, odd, plain_ids, monkeypatch):
    """Special strings, nulls, repeated rows, one length in most rows; chunks and salts of a few rows."""
    texts = ["end <|endoftext|> of", "<|endoftext|>", "a|b <|endoftext |>"] + ["same"] * 300 + [f"w {i}" for i in range(100)]
    df = odd.unionByName(spark.createDataFrame(rows_of(texts, range(100, 100 + len(texts))), SCHEMA))
    monkeypatch.setattr(packing, "CHUNK", 7)
    monkeypatch.setattr(packing, "A_SALT", 5)
    cut = packing.pieces(df)
    rows = packing.pack(cut.withColumn("base", F.lit(1)).withColumn("rank", F.lit("x")).withColumn("offset", F.lit(-1))).collect()
    want = wanted_pieces([(r["doc_id"], r["text"]) for r in df.collect()], plain_ids)
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    check_packing(rows, want.total())
    assert all(r["base"] == 1 and r["rank"] == "x" for r in rows)


def test_ids_are_the_plain_tokenizers(plain_ids):
    fast = tokens.Encoder()
    rng = random.Random(1)
    hard = ["", " ", "\n\n  \t x", "it's we'LL <|endoftext|>", "end<|endoftext|>.", "<|endoftext|", "a" * 5000, "é漢字\U0001f600" * 50, "\u0085  ᠎​1٣²Ⅷ", "12345  67", "\x00\x1c\x1f", "﻿́á"]
    hard += ["".join(chr(rng.choice([rng.randint(0, 0x250), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(60)) for _ in range(300)]
    for t in hard:
        assert fast.ids(t).tolist() == plain_ids(t), repr(t)
    assert fast.ids("end <|endoftext|> of").tolist() == [437, 220, 50256, 286]


def least_sequences(histogram, size):
    """A lower bound: for each k, pieces over size - k need a sequence each, and what others of at least k do not fit beside them needs more."""
    best = 0
    for k in range(size // 2 + 1):
        large = {x: n for x, n in histogram.items() if x > size - k}
        middle = {x: n for x, n in histogram.items() if size // 2 < x <= size - k}
        small = sum(x * n for x, n in histogram.items() if k <= x <= size // 2)
        room = sum((size - x) * n for x, n in middle.items())
        best = max(best, sum(large.values()) + sum(middle.values()) + max(0, -(-(small - room) // size)))
    return best


@settings(max_examples=60, deadline=None)
@example({1: 1, 2: 1, 33: 21})
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), min_size=1, max_size=20))
def test_plan_places_every_piece_once(histogram):
    seen, room = set(), collections.Counter()
    for length, rank, n, sequence, offset in packing.plan(histogram, 64):
        for k in range(n):
            assert (length, rank + k) not in seen
            seen.add((length, rank + k))
            assert room[sequence + k] == offset
            room[sequence + k] += length
            assert room[sequence + k] <= 64
    assert len(seen) == sum(histogram.values())
    assert len(room) <= 11 / 9 * least_sequences(histogram, 64) + 1  # best-fit decreasing's guarantee, 6/9 rounded up


# 7 Token counts -------------------------------------------------------------------------------------


def test_token_counts(spark, docs):
    want = collections.defaultdict(lambda: [0, 0])
    encoder = tokens.Encoder()
    for r in docs.collect():
        for version, n in ((token_counts.WORDS_VERSION, len(WORD.findall(r["text"]))), (token_counts.BPE_VERSION, encoder.count(r["text"]))):
            want[r["source"], r["lang"], version][0] += 1
            want[r["source"], r["lang"], version][1] += n
    got = {tuple(r)[:3]: list(tuple(r)[3:]) for r in token_counts.maintained(docs).collect()}
    assert got == dict(want)


def test_rollup_commits_once(spark):
    store = kit.Workspace(spark)
    rollup = token_counts.Rollup(spark, store)
    row = lambda d, n: spark.createDataFrame([("s", None, "t", d, n)], "source string, lang string, tokenizer string, docs long, tokens long")
    assert rollup.commit("a", row(2, 10)) and not rollup.commit("a", row(2, 10))
    assert rollup.commit("b", row(-1, -4))
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", None, "t", 1, 6)]
    rollup.fold()
    assert not rollup.commit("a", row(2, 10)) and rollup.commit("c", row(-1, -6))
    assert rollup.totals().count() == 0


def test_rollup_goes_on_in_a_later_session(spark):
    """Reopened by path after a fold, and after writers killed before the manifest was written."""
    root = kit.Workspace(spark).root
    again = lambda: token_counts.Rollup(spark, kit.Workspace(spark, root))
    row = lambda d, n: spark.createDataFrame([("s", "en", "t", d, n)], token_counts._DELTA)
    totals = lambda: [tuple(r)[3:] for r in again().totals().collect()]
    assert again().commit("a", row(2, 10)) and again().commit("b", row(1, 3))
    again().fold()
    assert totals() == [(3, 13)]
    assert not again().commit("a", row(2, 10)) and not again().commit("b", row(1, 3))
    killed = again()
    killed.store.save(row(50, 50), killed._path("c"))  # a batch's table without its manifest
    killed.store.save(row(70, 70), f"rollup/base-{killed.manifest.version + 1}")  # a fold's base without its manifest
    assert totals() == [(3, 13)]
    assert again().commit("c", row(1, 1)) and again().commit("d", row(-1, -3))
    assert totals() == [(3, 11)]
    again().fold()
    assert totals() == [(3, 11)] and not again().commit("d", row(-1, -3))


# 8 Document fingerprints ----------------------------------------------------------------------------


def test_fingerprints(spark, docs):
    rows = texts_of(docs)
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    most = fingerprints.LONG
    words = lambda x: re.split(r"(?<=[kwy]) ", x) if len(x) > 2 * most else [x]
    blocks = lambda x: [x[i : i + most] for i in range(0, len(x), most)]
    sentences = lambda x: re.split(r"(?<=[.!?]) |(?<=[。！？])", x) if len(x) > most else [x]
    parts = lambda t: {b for x in t.split("\n") for s in sentences(x) for w in words(s) for b in blocks(w)}
    alike = lambda a, b: 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        cut = len(t) // 2
        edited = t[: len(t) - cut] + after[:cut]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(alike(parts(t), parts(edited))) and r["near_next"] == pytest.approx(alike(parts(t), parts(after)))
    whole = [r for r in got.values() if r["n_chars"] > 400 and r["near_next"] < 1]
    assert sum(r["near_edited"] > r["near_next"] for r in whole) >= 0.99 * len(whole)
    by_text = collections.defaultdict(set)
    for d, t in rows:
        by_text[t].add(got[d]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_next_document_over_many_ranges(spark):
    ids = [3, 9, 9, 11, 40, 41, 1000, 10**12]
    df = spark.createDataFrame(rows_of([f"t{i}" for i in range(8)], ids), SCHEMA).select("doc_id", "text")
    for per in (1, 2, 100):
        got = fingerprints.with_next(df, ["doc_id"], rows_a_range=per).collect()
        pairs = sorted((r["doc_id"], r["next"]["doc_id"]) for r in got)
        assert pairs == sorted(zip(ids, ids[1:] + ids[:1], strict=True))


def test_peeling_recovers_differences(spark):
    sizes = [(0, 0), (1, 0), (3, 3), (40, 2), (300, 280), (900, 0)]
    rng = random.Random(5)
    rows = []
    for k, (n, m) in enumerate(sizes):
        a = [rng.getrandbits(63) for _ in range(n)]
        rows.append((k, a, a[: n // 2] + [rng.getrandbits(63) for _ in range(m)]))
    df = spark.createDataFrame(rows, "k int, a array<long>, b array<long>")
    df = df.withColumns({"x": fingerprints.sketch(F.col("a")), "y": fingerprints.sketch(F.col("b"))})
    for r in fingerprints.with_likeness(df, {"near": ("a", "x", "b", "y")}).collect():
        a, b = set(r["a"]), set(r["b"])
        assert r["near"] == pytest.approx(1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0)


# 9 Mixing -------------------------------------------------------------------------------------------


def test_mixture_meets_its_margins(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mix_sources(d).cache()
    expected = out.select("doc.source", "doc.lang", (F.col("n_tokens") * F.col("probability")).alias("e"), "n_tokens").toPandas()
    for c in ("source", "lang"):
        share = expected.groupby(c).e.sum() / expected.e.sum()
        mass = expected.groupby(c).n_tokens.sum() ** 0.7
        assert share.to_numpy() == pytest.approx((mass / mass.sum()).to_numpy(), rel=0.02)
    assert out.agg(F.max("probability")).first()[0] == pytest.approx(1.0)
    targets = {"m_source": spark.createDataFrame([("=src0", 0.5), ("=src1", 0.5)], "m_source string, share double")}
    kept = mixing.mix_sources(d, targets).filter("probability > 0").select("doc.source").distinct().collect()
    assert {r[0] for r in kept} == {"src0", "src1"}


# 10 Suffix dedup ------------------------------------------------------------------------------------


def repeats(rows):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            least[b[i : i + 50]] = min(least.get(b[i : i + 50], d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def removed(df):
    return sorted(tuple(r) for r in suffix_dedup.remove_repeats(df, with_kept=False).collect())


def test_suffix_dedup(docs):
    assert removed(docs) == repeats(texts_of(docs))


@pytest.mark.parametrize("alphabet", ["ab", "abcdé", "abcdefghij \n"])
@pytest.mark.parametrize("hot", [2, 10**6])
def test_suffix_dedup_on_repetitive_texts(spark, monkeypatch, alphabet, hot):
    for name, v in (("HOT", hot), ("GROUP_BYTES", 2000), ("GROUP_RUNS", 50), ("BATCH_BYTES", 2000)):
        monkeypatch.setattr(suffix_dedup, name, v)
    rng = random.Random(3)
    word = lambda a, b: "".join(rng.choice(alphabet) for _ in range(rng.randint(a, b)))
    blocks = [word(30, 120) for _ in range(10)]
    texts = ["".join(rng.choice(blocks) if rng.random() < 0.7 else word(1, 60) for _ in range(rng.randint(0, 12))) for _ in range(120)]
    rows = list(enumerate(texts)) + [(200, None), (200, "a" * 80), (3, "a" * 300), (3, "a" * 300)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int").repartition(5)
    assert removed(df) == repeats(rows)


@pytest.mark.parametrize("step", [1, 2])
def test_interleave_orders_all_suffixes(step):
    rng = np.random.default_rng(6)
    shards, texts = [], []
    for _ in range(3):
        own = [rng.integers(1, 3, rng.integers(8, 30)) for _ in range(5)]
        symbols = np.concatenate([np.append(t, 0) for t in own]).astype(np.uint8)
        order = suffix_dedup.suffix_order(symbols, 8)
        shards.append((symbols, order, suffix_dedup.transform_of(symbols, order, step)))
        texts.append(own)
    which, prefix = suffix_dedup.interleave([s[2] for s in shards], 8, step)
    at = [0] * 3
    merged = []
    for s in which.tolist():
        symbols, order, _ = shards[s]
        p = int(order[at[s]])
        at[s] += 1
        tail = symbols[p : p + 8].tolist()
        merged.append(tail[: tail.index(0) + 1] if 0 in tail else tail)
    assert merged == sorted(merged)
    for i in range(1, len(merged)):
        if len(merged[i]) == len(merged[i - 1]) == 8 and 0 not in merged[i] + merged[i - 1]:
            same = next((k for k in range(8) if merged[i][k] != merged[i - 1][k]), 8)
            assert prefix[i] == same // step * step


# The pipeline ---------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, tiny, docs):
    import corpus_pipeline as pipeline

    names = [n for n, _ in pipeline.STAGES]
    assert len(names) == 5
    stage = dict(pipeline.STAGES)
    table = lambda df: sorted(map(tuple, df.select(*pipeline.COLUMNS).collect()), key=repr)
    store, now = kit.Workspace(spark), docs.select(*pipeline.COLUMNS)

    kept = {r["doc_id"] for r in quality.quality_rules(now).select("doc.doc_id", "kept").collect() if r["kept"]}
    out = store.save(stage["quality rules"](spark, now, tiny), "a")
    assert table(out) == [r for r in table(now) if r[0] in kept] and len(kept) < now.count()

    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    rows = table(out)
    seen = collections.Counter(k for r in rows for k in {key(x) for x in r[1].split("\n")} if k)
    cut = lambda t: "\n".join(x for x in t.split("\n") if seen[key(x)] < 10)
    want = sorted(((r[0], cut(r[1]), r[2], r[3], len(cut(r[1]))) for r in rows), key=repr)
    out = store.save(stage["line dedup"](spark, out, tiny), "b")
    assert table(out) == want

    first = {d for d, _, c in jaccard_components([(r[0], r[1]) for r in want], 5, 8, 10) if d == c}
    out = store.save(stage["n-gram Jaccard join"](spark, out, tiny), "c")
    assert table(out) == [r for r in want if r[0] in first]

    drawn = {r["doc"]["doc_id"] for r in mixing.mix_sources(out).filter("kept").collect()}
    before = table(out)
    out = store.save(stage["mixing sources"](spark, out, tiny), "d")
    assert table(out) == [r for r in before if r[0] in drawn]

    packed = stage["best-fit packing"](spark, out, tiny).collect()
    encoder = tokens.Encoder()
    total = {r[0]: encoder.count(r[1]) + 1 for r in table(out)}
    got = collections.Counter()
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert got == total
    check_packing(packed, sum(-(-n // 2048) for n in total.values()))
    names = sorted(packed[0].asDict())
    whole = sorted(tuple(r[n] for n in names) for r in pipeline.run(spark, tiny).collect())
    assert whole == sorted(tuple(r[n] for n in names) for r in packed)


def test_pipeline_stages_on_odd_rows(spark, odd, empty):
    import corpus_pipeline as pipeline

    stage = dict(pipeline.STAGES)
    for name, f in pipeline.STAGES:
        out = f(spark, empty, "")
        assert out.count() == 0, name
        assert name == "best-fit packing" or out.columns == pipeline.COLUMNS, name
    pairs = lambda df: collections.Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    every = pairs(odd)

    assert not pairs(stage["quality rules"](spark, odd, ""))  # all are short or repeat one window
    assert pairs(stage["line dedup"](spark, odd, "")) == collections.Counter((d, t or "") for d, t in every.elements())
    assert pairs(stage["n-gram Jaccard join"](spark, odd, "")) == collections.Counter(p for p in every if p[0] != 10)
    assert pairs(stage["mixing sources"](spark, odd, "")) <= every
    packed = stage["best-fit packing"](spark, odd, "")
    assert {r["doc_id"] for r in packed.collect()} == {d for d, _ in every}
