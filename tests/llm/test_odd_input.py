"""Extreme values, repeated and missing ids, and bounds of what moves."""

import math
import os
import random
import time
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact, itq, kdshard, minhash, packing, pst, spm, tokenfile, tokens, toxicity, warc
from tidemark.llm.scratch import Scratch

from .test_operators import BPE, PIECES, components, words


@pytest.fixture
def saved(monkeypatch):
    """Rows of everything that operators save, by name."""
    out: dict[str, list[int]] = {}
    save = Scratch.save

    def counted(self, df, name):
        got = save(self, df, name)
        out.setdefault(name, []).append(got.count())
        return got

    monkeypatch.setattr(Scratch, "save", counted)
    return out


def exactly_near(a, b):
    """Cosine >= 0.98 in exact arithmetic, for vectors that aren't within rounding of it."""
    a, b = [Fraction(x) for x in a], [Fraction(x) for x in b]
    dot = sum(x * y for x, y in zip(a, b, strict=True))
    return dot > 0 and dot * dot >= Fraction(98, 100) ** 2 * sum(x * x for x in a) * sum(x * x for x in b)


@pytest.mark.parametrize("size", [1e160, 1e-170, 5e-324, 1e308, 1.0])
def test_vectors_of_extreme_size(spark, size):
    half = [math.cos(math.pi / 3), math.sin(math.pi / 3)]
    vectors = [[size, 0.0], [size * half[0], size * half[1]], [size, size / 16], [0.0, 0.0], [-size, 0.0], [size * 0.5, 0.0]]
    rows = [(k, v, 1, "x", 5) for k, v in enumerate(vectors)]
    got = {r["vec_id"]: r for r in itq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string, key long")).collect()}
    links = [(i, j) for i in range(6) for j in range(i) if any(vectors[i]) and any(vectors[j]) and exactly_near(vectors[i], vectors[j])]
    for k in range(6):
        assert got[k]["n_links"] == sum(k in x for x in links)
    assert [got[k]["component_id"] for k in range(6)] == components(6, links)


def test_vectors_decided_alike_in_rows_and_blocks(spark, monkeypatch):
    """The same links whether pairs of buckets are expanded or multiplied."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((6, 8))
    x = np.concatenate([base + rng.standard_normal((6, 8)) * 0.14 for _ in range(40)])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").cache()
    out = []
    for pairs in (0, 10**9):
        monkeypatch.setattr(itq, "PAIRS", pairs)
        out.append(sorted(tuple(r) for r in itq.near_vectors(df).collect()))
    assert out[0] == out[1] and any(r[1] for r in out[0])


def test_wide_ids(tmp_path):
    path = tmp_path / "x.tok"
    with open(path, "wb") as out:
        writer = tokenfile.TokenFileWriter(out, 4)
        writer.add(1, np.array([70_000, 3], np.uint32))
        writer.finish()
        with pytest.raises(ValueError, match="70000"):
            tokenfile.TokenFileWriter(out, 2).add(1, np.array([70_000], np.uint32))
    with open(path, "rb") as stream:
        assert tokenfile.TokenFileReader(stream, path.stat().st_size).read(0).tolist() == [70_000, 3]
    data = bytearray(path.read_bytes())
    data[data.index((0x184D2A50).to_bytes(4, "little")) + 20] ^= 1  # in the document index
    path.write_bytes(data)
    with open(path, "rb") as stream, pytest.raises(ValueError, match="checksum"):
        tokenfile.TokenFileReader(stream, len(data))


def test_token_files_of_repeated_ids(spark):
    """Rows that share an id, or have none, keep one order whatever the partitions."""
    rows = [(k % 3 or None, f"text {k % 5} " * (k % 4)) for k in range(60)]
    out = [
        sorted((r["doc_id"] or -1, r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.token_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), BPE).collect())
        for n in (1, 5)
    ]
    assert out[0] == out[1] and len(out[0]) == 60
    at = 0
    for _, start, n, _ in sorted(out[0], key=lambda r: r[1]):
        assert start == at
        at += n


def test_hops_of_a_long_archive(spark, saved):
    """As many hops as ranges at most, halved in reach each round, and every range entered."""
    ranges = [("f", 1000, k * 10, k * 10 + 10, [k * 10 + k % 7], [(k + 1) * 10 + (k + 1) % 7], [(k + 1) * 10 + (k + 1) % 7]) for k in range(100)]
    ranges[-1] = (*ranges[-1][:5], [1000], [1000])
    df = spark.createDataFrame(ranges, "path string, bytes long, lo long, hi long, at array<long>, next array<long>, exit array<long>")
    entered = warc._verified(df, Scratch(spark, "warc")).collect()
    assert sorted((r["lo"], r["entry"]) for r in entered) == [(k * 10, k * 10 + k % 7) for k in range(100)]
    assert max(saved["hops"]) <= 100 and len(saved["hops"]) <= 9 and max(saved["reached"]) <= 101


def test_warc_with_a_very_long_url(spark):
    rows = [(1, "http://a/" + "x" * 5_000_000, "p"), (2, "http://b/" + " " * 70_000, "p"), (3, None, None), (4, "u", "other")]
    got = {r["page_id"]: r["refers_to"] for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: 2, 2: None, 3: None, 4: None}


def test_near_duplicates_that_share_ids(spark):
    """Each row is compared by its own text; the smallest id of a group is its component."""
    rng = random.Random(8)
    a, b = (" ".join(rng.choices("klmnopqrst", k=120)) for _ in range(2))
    rows = [(5, a), (5, b), (7, a + " z"), (3, b + " z"), (None, a), (9, "alone with words of its own"), (2, a)]
    got = [(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(5, 2), (5, 3), (7, 2), (3, 3), (None, None), (9, 9), (2, 2)], key=str)


def test_chain_of_templates(spark, saved, monkeypatch):
    """Pages that each share half of their words with the next: buckets connect them all, but what is compared grows
    with the buckets' members, not with the square of the family."""
    rng = random.Random(9)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    half = [" ".join(rng.choices([f"w{k}" for k in range(500)], k=60)) for _ in range(200)]
    texts = [half[k] + " " + half[k + 1] for k in range(199)]
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(words, texts)]
    links = [(i, j) for i in range(199) for j in range(i) if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])]
    assert [r["component_id"] for r in sorted(got)] == components(199, links)
    assert sum(saved["open"] if "open" in saved else [0]) <= sum(saved["members"])
    assert sum(saved["pairs"]) <= sum(saved["members"])


def test_sequence_numbers_are_distinct(spark):
    """Pieces of different groups, levels and full ones never share a number."""
    lengths = [random.Random(k).choice([1024, 1024, 700, 400, 300, 90, 5]) for k in range(600)]
    pieces = spark.createDataFrame([(k << 33, n) for k, n in enumerate(lengths)], "uid long, length long")
    placed = packing.pack(pieces, 1024, Scratch(spark, "packing"), group_size=64, islands=1, epochs=1).join(pieces, "uid")
    fill = placed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k")).collect()
    assert sum(r["k"] for r in fill) == 600 and max(r["n"] for r in fill) <= 1024
    assert len(fill) <= math.ceil(sum(lengths) / 1024) * 1.03


def plain_features(text):
    """Distinct words without outer punctuation, and heads of 5 and 6 bytes of longer ones."""
    out = set()
    for w in words(text):
        w = w.encode()
        inner = [i for i, c in enumerate(w) if c >= 128 or chr(c).isalnum()]
        if inner:
            w = w[inner[0] : inner[-1] + 1]
            out |= {w} | {(n, w[:n]) for n in (5, 6) if len(w) > n}
    return out


def test_chain_against_dense_matrices(spark):
    """Out-of-fold probabilities and models by dense matrices and a plain loop."""
    rng = random.Random(12)
    texts = [" ".join(rng.choices(["good", "bad!", "terrible", "fine", "walking", "Worst", "calm", "(quiet)", "awfully"], k=6)) for _ in range(90)]
    low = np.array([float("bad" in t) for t in texts])
    toxic = np.array([float("terrible" in t and "bad" in t) for t in texts])
    toxic[:6] = np.nan
    fold = np.array([k % 3 for k in range(90)])
    value, at = toxicity.features(pa.array(texts))
    chain = toxicity.ClassifierChain.fit(["low", "toxic"], value, at, np.stack([low, toxic], 1), fold, least=2)

    count = {}
    for t in texts:
        for x in plain_features(t):
            count[x] = count.get(x, 0) + 1
    names = sorted((x for x, n in count.items() if n >= 2), key=str)
    assert len(names) == len(chain.vocabulary)
    matrix = np.array([[float(x in plain_features(t)) for x in names] for t in texts])

    def fit(rows, extra, y):
        x, d, y = matrix[rows], extra[rows], y[rows]
        n, share = len(y), y.mean()
        yes, no = x[y > 0].sum(0), x[y == 0].sum(0)
        scale = np.log((yes + 0.5) / (y.sum() + 1)) - np.log((no + 0.5) / (n - y.sum() + 1))
        full = np.concatenate((x * scale, d, np.ones((n, 1))), 1)
        w = np.zeros(full.shape[1])
        w[-1] = math.log((share * n + 0.5) / ((1 - share) * n + 0.5))
        decay = np.full(len(w), 3e-4)
        decay[-1] = 0
        mean, var = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, 61):
            grad = full.T @ (np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) * (1 / (1 + np.exp(-full @ w)) - y) / n) + decay * w
            mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad**2
            w = w - 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.99**t)) + 1e-9)
        return lambda x, d: 1 / (1 + np.exp(-(np.concatenate((x * scale, d, np.ones((len(x), 1))), 1) @ w)))

    extra, seen_later = np.zeros((90, 0)), np.zeros((90, 0))
    for y in (low, toxic):
        known = ~np.isnan(y)
        out = np.zeros(90)
        for k in range(3):
            out[fold == k] = fit(known & (fold != k), extra, y)(matrix[fold == k], extra[fold == k])
        p = fit(known, extra, y)(matrix, seen_later)
        extra = np.concatenate((extra, out[:, None]), 1)
        seen_later = np.concatenate((seen_later, p[:, None]), 1)
    assert chain.predict(pa.array(texts)) == pytest.approx(seen_later, rel=1e-6, abs=1e-9)
    hard = (out[6:] >= chain.threshold) == (toxic[6:] > 0)
    assert hard.mean() > 0.8


def test_sample_of_labels_is_bounded(spark, monkeypatch):
    """Repeated ids train once, and the texts of the sample stay within its bytes."""
    seen = []
    fit = toxicity.ClassifierChain.fit.__func__

    def counted(cls, names, value, at, labels, fold, least=4):
        seen.append(len(at) - 1)
        return fit(cls, names, value, at, labels, fold, least)

    monkeypatch.setattr(toxicity.ClassifierChain, "fit", classmethod(counted))
    docs = spark.createDataFrame([(k % 50, "word " * 200) for k in range(500)] + [(None, "x"), (99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 3 == 0 and 1 or 0) for k in range(50)], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(docs, labels).count() == 502
    assert toxicity.score_toxicity(docs, labels, sample_bytes=10_500).count() == 502
    assert toxicity.score_toxicity(docs, labels, sample=7).count() == 502
    assert seen == [50, 10, 7]


def test_missing_and_repeated_ids(spark):
    """Rows without an id and rows that repeat one each have a result, in every operator on documents."""
    rows = [(None, "some words that are here for once"), (None, None), (4, "other words of a text with few"), (4, "other words of a text with few"), (4, ""), (6, "last of all these texts here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((r[0] for r in rows), key=str)
    for found in (
        pst.suffix_tree_scores(docs), minhash.near_duplicates(docs), exact.exact_duplicates(docs), spm.token_digests(docs, PIECES), tokenfile.token_digests(docs, BPE),
        packing.pack_documents(docs, BPE), kdshard.shard(docs.withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit("en"))),
    ):
        assert sorted((r["doc_id"] for r in found.collect()), key=str) == want


def test_keep_clean_leaves_rows_as_they_are(spark):
    """Every column and repeated row of what stays, and of rows that share an id only the rejected text goes."""
    texts = [f"vile filth number{k} spew" if k % 3 == 0 else f"kind words number{k} garden" for k in range(300)]
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    rows = [(k, t, [k], "a") for k, t in enumerate(texts)] + [(0, "kind words of a garden", [], None), (None, None, None, "b"), (7, "vile filth spew", [1], "c"), (7, texts[7], [7], "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p0 array<int>, rejected string")
    kept = toxicity.keep_clean(docs, labels)
    assert kept.schema == docs.schema
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs.collect() if "vile" not in (r["text"] or ""))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_evolution_beats_best_fit_on_real_lengths():
    """On token counts of the driver's documents, evolved packings take fewer sequences than their best-fit seed."""
    from pyarrow import parquet

    column = parquet.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).cast(pa.string())
    lengths = []
    for chunk in column.chunks:
        lengths += [x for n in np.diff(tokens.encoder(BPE).encode(chunk)[1]).tolist() for x in packing.cut(n, 1024) if x < 1024]
    random.Random(1).shuffle(lengths)
    saved = []
    for k in range(3):
        ga = packing.GroupingGA(lengths[k::3], 1024, 5)
        best = ga.evolve([])
        assert all(sum(ga.lengths[i] for i in x) + s == 1024 for x, s in zip(*best, strict=True))
        assert ga.bound <= len(best[0])
        saved.append(len(ga.seeds()[0][0]) - len(best[0]))
    assert min(saved) >= 0 and sum(saved) > 0


def test_fullest():
    rng = random.Random(2)
    for _ in range(200):
        lengths = [rng.randint(1, 30) for _ in range(8)]
        got = packing.fullest(lengths, list(range(8)), 60)
        sums = {sum(lengths[i] for i in range(8) if m >> i & 1) for m in range(256)}
        assert len(set(got)) == len(got) and sum(lengths[i] for i in got) == max(s for s in sums if s <= 60)


def test_saving_leaves_no_shuffle_files(spark):
    def shuffles():
        return set(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))

    before, setting = shuffles(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    saved_ = Scratch(spark, "brief").save(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(100):
        if not {x for x in shuffles() - before if "shuffle" in x}:
            break
        time.sleep(0.1)
    else:
        raise AssertionError("shuffle files stay")
    assert saved_.agg(F.sum("count")).first()[0] == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_intermediates_written_without_commands(spark, monkeypatch):
    """Hadoop's local files come with checksums, and a command for each file; those of the workers with neither."""
    rows = [(i, [i, -i], None if i % 5 else f"é{i}", i % 2 == 0) for i in range(500)]
    docs = spark.createDataFrame(rows, "id long, list array<long>, text string, even boolean")
    monkeypatch.setattr("tidemark.llm.scratch._GROUP", 1 << 10)
    scratch = Scratch(spark, "quiet", quiet=True)
    kept = scratch.save(docs.withColumn("sum", F.col("id").cast("decimal(20,0)")).repartition(7, "id"), "docs")
    assert sorted(tuple(r)[:4] for r in kept.collect()) == rows and kept.filter("sum = id").count() == 500
    assert scratch.save(docs.filter("id < 0"), "none").count() == 0
    assert not [f for _, _, names in os.walk(scratch.root[5:]) for f in names if not f.endswith(".parquet") or f.startswith(".")]


def test_near_duplicates_start_no_commands(spark, monkeypatch):
    roots = []
    made = Scratch.__init__
    monkeypatch.setattr(Scratch, "__init__", lambda self, *a, **k: (made(self, *a, **k), roots.append(self.root))[0])
    texts = [f"{i % 4} {'a b c d e f g h i j k l m n o p'} {i}" for i in range(40)]
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == 40
    files = [f for root in roots for _, _, names in os.walk(root[5:]) for f in names]
    assert files and not [f for f in files if f.endswith(".crc")]
