"""The operators against brute force, with null, empty, repeated and clashing inputs."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import exact, itq, kdshard, minhash, packing, pst, spm, tokenfile, tokens, toxicity, warc
from tidemark.llm import textkernels as K
from tidemark.llm.components import connected_components
from tidemark.llm.scratch import Scratch

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SPACE = re.compile("[ \t\n\x0b\f\r]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return [w for w in SPACE.split((text or "").translate(LOWER)) if w]


def corpus(seed=0, n=60):
    """Texts with nulls, empties, exact and near copies, and one very long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    out = [None, "", "  \n", "one", "Two words", "two WORDS"]
    while len(out) < n:
        base = rng.choices(vocabulary, k=rng.randint(3, 120))
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = base[:]
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(rng.choice([" ", "\n", "  "]).join(copy))
    return out + [" ".join(rng.choices(vocabulary, k=30_000))]


def frame(spark, texts):
    """With extra columns whose names the operators use inside."""
    rows = [(i, t, "x", i, 1, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, rep long, component long, sha string").repartition(3)


def components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [root(i) for i in range(n)]


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_kernels():
    texts = ["A bc\tA", None, "", "x" * 5000, "bc\x0ba é"]
    hashes, at = K.words(pa.array(texts))
    assert np.diff(at).tolist() == [3, 0, 0, 1, 3]
    assert hashes[0] == hashes[2] == hashes[5] and hashes[1] == hashes[4] and len(set(hashes.tolist())) == 4
    assert K.word_hash("bc") == hashes[1]


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 360)]
    want = components(361, links)
    got = connected_components(spark.createDataFrame(links, "src long, dst long"), Scratch(spark, "t")).collect()
    assert all(want[r["node"]] == r["component"] for r in got)
    assert {r["node"] for r in got} == {x for a, b in links if a != b for x in (a, b)}


def test_minhash(spark):
    texts = corpus() + ["one"]
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(len(texts), links)
    assert len(set(want)) < len(want) - 5
    rows = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    assert [rows[i]["component_id"] for i in range(len(texts))] == want
    assert [rows[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert {r["doc_id"] for r in minhash.keep_one(frame(spark, texts)).collect()} == {i for i, c in enumerate(want) if i == c}
    assert minhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("n", range(8))
def test_shingles_of_few_words(n):
    """A text alone in its batch has the same set as among others."""
    text = " ".join("abcdefgh"[:n])
    sets, at = minhash.shingle_sets(pa.array(["x y z x y z x", text, "q"]), 5)
    alone, _ = minhash.shingle_sets(pa.array([text]), 5)
    assert sets[at[1] : at[2]].tolist() == alone.tolist() and len(alone) == (n - 4 if n >= 5 else min(n, 1))


def test_minhash_families():
    """Blocks give the same intersections as sets."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 500, rng.integers(0, 300))).astype(np.uint64) for _ in range(20)]
    got = minhash._intersections(sets, np.arange(9), np.arange(9, 20))
    assert got.tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in range(9, 20)] for i in range(9)]


def test_filter_merges_without_loss():
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 2**20, 3000, dtype=np.uint64) for _ in range(4)]
    made = [exact.CountingQuotientFilter.build(p, np.ones(len(p), np.int64), 20, 6) for p in parts]
    merged = exact.CountingQuotientFilter.merge([exact.CountingQuotientFilter.from_bytes(m.to_bytes()) for m in made])
    want = Counter(np.concatenate(parts).tolist())
    assert dict(zip(merged.fingerprints().tolist(), merged.counts().tolist(), strict=True)) == dict(want)
    none = exact.CountingQuotientFilter.build(np.zeros(0, np.uint64), np.zeros(0, np.int64), 20, 6)
    assert len(exact.CountingQuotientFilter.from_bytes(none.to_bytes()).remainders) == 0


def test_exact(spark):
    texts = corpus(1) + ["o n\te", "one "]
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[SPACE.sub("", t or "")].append(i)
    rows = {r["doc_id"]: r for r in exact.exact_duplicates(frame(spark, texts)).collect()}
    for key, members in groups.items():
        keep = min(members, key=lambda i: (-len(texts[i] or ""), i))
        for i in members:
            r = rows[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (keep, len(members), i == keep, hashlib.sha256(key.encode()).hexdigest())
    assert exact.keep_one(frame(spark, texts)).count() == len(groups)
    assert exact.exact_duplicates(empty(spark)).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 32))
    rows = []
    for k, v in enumerate(base):
        for _ in range(rng.integers(1, 12)):
            rows.append((v + rng.standard_normal(32) * rng.choice([0, 0.05, 0.2]), k % 3))
    rows += [(base[0] + rng.standard_normal(32) * 0.02, 0) for _ in range(150)]
    table = [(i, [float(x) for x in v], label) for i, (v, label) in enumerate(rows)]
    n = len(table)
    table += [(n, None, 1), (n + 1, [0.0] * 32, 1), (n + 2, [1.0, None] * 16, 1), (n + 3, [float("nan")] * 32, 1), (n + 4, table[0][1], None), (n + 5, [1.0, 2.0], 0)]
    m = np.stack([v for v, _ in rows])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    label = np.array([x for _, x in rows])
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(n, dtype=bool)
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in itq.near_vectors(df).collect()}
    links = np.array([got[i]["n_links"] for i in range(n)])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.9 * near.sum()
    want = components(n, list(zip(*np.nonzero(near), strict=True)))
    assert np.mean([got[i]["component_id"] == want[i] for i in range(n)]) > 0.95
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(n, n + 6))
    assert itq.near_vectors(df.limit(0)).count() == 0


def test_sharding(spark):
    texts = corpus(4, 400) + ["same text"] * 60
    rows = {r["doc_id"]: r for r in kdshard.shard(frame(spark, texts), 5, metadata=("id", "sha")).collect()}
    assert len(rows) == len(texts)
    load, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for i, t in enumerate(texts):
        r = rows[i]
        data = (t or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[t or ""].add(r["shard"])
    assert set(load) == set(range(5)) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())
    big = max(Counter({i: rows[i]["size"] for i in rows}).values())
    rest = sorted(v for v in load.values() if v < big)
    assert rest[-1] - rest[0] < 0.2 * rest[-1]
    assert kdshard.shard(spark.createDataFrame([], "doc_id long, text string, source string, lang string")).count() == 0


def random_texts(n, seed):
    rng = random.Random(seed)
    alphabet = [*"ab1 .'\n\t\r, é«»…中\x1c\x85▁🎉", "<|endoftext|>", "'s", "  ", "\n\n", "tion", "the"]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(n)]


def test_encoder_equals_the_library():
    texts = [*random_texts(4000, 1), *(t or "" for t in corpus(2)), None]
    encoder = tokens.Encoder(BPE)
    ids, at = encoder.encode(pa.array(texts), None)
    want = encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert all(ids[at[i] : at[i + 1]].tolist() == w.ids for i, w in enumerate(want))


def test_token_files(spark, tmp_path):
    texts = corpus(3)
    encoder = tokens.Encoder(BPE)
    ids, at = encoder.encode(pa.array(texts))
    got = {r["doc_id"]: r for r in tokenfile.token_digests(frame(spark, texts), BPE).collect()}
    for i in range(len(texts)):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at[i], at[i + 1] - at[i], tokens.ids_crc32(ids[at[i] : at[i + 1]]))
    files = tokenfile.write_token_files(frame(spark, texts), f"file://{tmp_path}/x", BPE)
    files = spark.createDataFrame(files.collect(), files.schema)
    back = {r["doc_id"]: r["ids"] for r in tokenfile.read_token_files(files).collect()}
    assert all(back[i] == ids[at[i] : at[i + 1]].tolist() for i in back) and len(back) == len(texts)
    assert tokenfile.token_digests(empty(spark), BPE).count() == 0


def test_token_file_reads_only_what_is_asked(tmp_path):
    path = tmp_path / "f"
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (0, 10, 300_000, 5, 70_000)]
    with open(path, "wb") as f:
        w = tokenfile.TokenFileWriter(f, 2, frame_bytes=1 << 16)
        for i, d in enumerate(docs):
            w.add(None if i == 3 else i, d)
        w.finish()
    size = path.stat().st_size
    with open(path, "rb") as f:
        r = tokenfile.TokenFileReader(f, size)
        assert r.doc_ids == [0, 1, 2, None, 4]
        assert all(np.array_equal(r.read(i), docs[i]) for i in (4, 1, 2, 0, 3))
    data = bytearray(path.read_bytes())
    data[20] ^= 1
    path.write_bytes(data)
    import zstandard

    with open(path, "rb") as f, pytest.raises((ValueError, zstandard.ZstdError)):
        tokenfile.TokenFileReader(f, size).read(1)


def test_packing(spark):
    texts = corpus(6, 300)
    encoder = tokens.Encoder(BPE)
    ids, at = encoder.encode(pa.array(texts))
    rows = packing.pack_documents(frame(spark, texts), BPE, 128, group_size=64).collect()
    bins, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append(r)
        docs[r["doc_id"]].append(r)
    for held in bins.values():
        held.sort(key=lambda r: r["offset"])
        end = 0
        for r in held:
            assert r["offset"] == end
            end += r["length"]
        assert end <= 128
    for i in range(len(texts)):
        n = at[i + 1] - at[i]
        mine = sorted(docs[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine))) and sum(r["length"] for r in mine) == n
        assert len(mine) == 1 or n > 128
        assert all(r["length"] == 128 for r in mine[1:])
        for r in mine:
            assert r["ids_crc32"] == tokens.ids_crc32(ids[at[i] + r["start"] : at[i] + r["start"] + r["length"]])
    assert len(bins) <= 1.02 * math.ceil(len(ids) / 128) + 1
    assert packing.pack_documents(empty(spark), BPE).count() == 0


def test_genetic_algorithm_beats_its_seed():
    rng = random.Random(1)
    lengths = [x for _ in range(40) for x in (lambda a, b: (a, b - a, 100 - b))(*sorted(rng.sample(range(20, 80), 2)))]
    ga = packing.GroupingGA(lengths, 100, 1, generations=40)
    first = ga.seeds()[0]
    best = ga.evolve([])
    assert sorted(i for x in best[0] for i in x) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in x) + s == 100 for x, s in zip(*best, strict=True))
    assert ga.bound <= len(best[0]) <= len(first[0])


def test_suffix_tree(spark):
    texts = corpus(7, 200) + ["the cat sat on the mat and the dog sat on the log"] * 30
    rows = {r["doc_id"]: r for r in pst.suffix_tree_scores(frame(spark, texts), alphabet=512, least=2e-4).collect()}
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    seen = [[*words(t), "\n"] for t in texts]
    c = Counter(w for s, h in zip(seen, held, strict=True) if not h for w in s)
    n, v = sum(c.values()), len(c)
    for i, s in enumerate(seen):
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(s), sum(c[w] > 0 for w in s), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in s))
        assert r["score"] < 0
    copies = [i for i in range(len(texts) - 31, len(texts)) if held[i] and texts[i].startswith("the cat")]
    assert copies and all(rows[i]["score"] > rows[i]["base_score"] + 3 for i in copies)
    assert pst.suffix_tree_scores(empty(spark)).count() == 0


def test_suffix_tree_of_all_words(spark, monkeypatch):
    """The whole tree by brute force, and a context that is rare in a large corpus but in every partition of it."""
    monkeypatch.setattr(pst, "PART_TOKENS", 500)
    rng = random.Random(3)
    texts = corpus(5, 80)[:-1] + ["quokkas munch leaves at dusk"] * 9 + [" ".join(rng.choices([f"w{i}" for i in range(5000)], k=20_000))]
    rows = {r["doc_id"]: r for r in pst.suffix_tree_scores(frame(spark, texts)).collect()}
    number = {w: i for i, w in enumerate(sorted({w for t in texts for w in words(t)}), 1)}
    alphabet = pst.Alphabet(np.arange(len(number), dtype=np.int64))
    seen = [[0, *(number[w] for w in words(t)), 0] for t in texts]
    train = [s for i, s in enumerate(seen) if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(x for s in train for x in s[1:])
    root = np.array([c[x] + 1.0 for x in range(alphabet.size)]) / (sum(c.values()) + len(c) + 1)
    tree = pst.SuffixTree(alphabet, root)

    def code(s, i, k):
        return sum(s[i - 1 - j] * alphabet.size**j for j in range(k))

    for k in (1, 2, 3):
        following = defaultdict(Counter)
        for s in train:
            for i in range(k, len(s)):
                following[code(s, i, k)][s[i]] += 1
        for context, counts in following.items():
            if counts.total() >= 2 and (often := {x: n for x, n in counts.items() if n >= 2}):
                tree.grow(k, context, counts.total(), often)
    assert all(len(x) > 5 for x in tree.codes[1:])
    for i, s in enumerate(seen):
        want = sum(math.log10(tree.probability(tree.suffix(code(s, j, min(j, 3)), min(j, 3)), s[j])) for j in range(1, len(s)))
        assert rows[i]["score"] == pytest.approx(want, rel=1e-9), texts[i]


def test_suffix_tree_without_words_or_training(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    for rows in ([(i, "a b c") for i in held], [(1, None), (None, ""), (3, None)], [(1, "a"), (3, "b c d e")]):
        got = pst.suffix_tree_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == len(rows) and all(r["train_tokens"] or r["score"] == r["base_score"] == 0 for r in got)


def test_suffix_tree_distributions_sum_to_one():
    alphabet = pst.Alphabet(np.arange(5, dtype=np.int64))
    root = np.array([0.1, 0.2, 0.2, 0.1, 0.1, 0.1, 0.2])
    tree = pst.SuffixTree(alphabet, root)
    tree.grow(1, 3, 1000, {1: 900, 2: 50})
    tree.grow(2, 3 + 7 * 2, 400, {1: 10, 4: 300})
    assert len(tree.parent) == 3
    for s in range(3):
        assert sum(tree.probability(s, x) for x in range(7)) == pytest.approx(1)
    frozen = tree.freeze()
    s, at = np.array([0, 2, 3, 4, 3, 1, 0]), np.array([0, 7])
    got = frozen.score(s, at)
    want = [0, 0, 0, tree.probability(2, 4), tree.probability(0, 3), tree.probability(1, 1), tree.probability(0, 0)]
    assert got[3:] == pytest.approx(np.log10(want[3:]))


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    texts = [*random_texts(4000, 2), *(t or "" for t in corpus(5)), None]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec = spm.Codec(PIECES)
    ids, at = codec.encode(pa.array(texts))
    want = library.encode([t or "" for t in texts])
    assert all(ids[at[i] : at[i + 1]].tolist() == w for i, w in enumerate(want))
    data, ends = codec.decode(ids, at)
    assert all(data[a:b].decode() == library.decode(w) for a, b, w in zip(ends[:-1], ends[1:], want, strict=True))
    rows = {r["doc_id"]: r for r in spm.encode(frame(spark, texts[-40:]), PIECES).collect()}
    assert all(rows[i]["ids"] == w for i, w in enumerate(want[-40:]))
    back = {r["doc_id"]: r["text"] for r in spm.decode(spm.encode(frame(spark, texts[-40:]), PIECES), PIECES).collect()}
    assert all(back[i] == library.decode(w) for i, w in enumerate(want[-40:]))
    digests = spm.token_digests(frame(spark, texts[-40:]), PIECES).collect()
    assert all(r["n_tokens"] == len(want[-40:][r["doc_id"]]) for r in digests) and spm.token_digests(empty(spark), PIECES).count() == 0


def test_viterbi_finds_the_best_sum():
    codec = spm.Codec(PIECES, spm.UNIGRAM)
    v = codec.v

    def best(word, at=0, memo=None):
        memo = {} if memo is None else memo
        if at == len(word):
            return 0.0
        if at not in memo:
            memo[at] = max(v.scores[v.ids[word[at:e]]] + best(word, e, memo) for e in range(at + 1, len(word) + 1) if word[at:e] in v.ids)
        return memo[at]

    for word in sorted(["▁the", "▁then", "▁thenation", "▁nation", "▁na"]):
        assert sum(v.scores[i] for i in codec.viterbi.ids(word)) == pytest.approx(best(word))


def test_keep_clean_shared_ids(spark):
    """Clean rows with the id of a rejected row, null or repeated, stay."""
    rng = random.Random(4)
    plain = ["".join(rng.choices("aeioulnrst", k=6)) for _ in range(200)]
    clean = [" ".join(rng.choices(plain, k=40)) for _ in range(200)]
    toxic = [" ".join(x for w in rng.choices(plain, k=20) for x in (w, "vilest")) for _ in range(200)]
    texts = [x for pair in zip(clean, toxic, strict=True) for x in pair]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    more = [(None, "vilest " * 20), (None, clean[0]), (None, None), (1000, "vilest " * 20), (1000, clean[1])]
    df = spark.createDataFrame([*enumerate(texts), *more], "doc_id long, text string")
    rejected = {r["text"] for r in df.select("text", "doc_id").collect() if r["text"] and "vilest" in r["text"]}
    kept = sorted(((r["doc_id"] or -1, r["text"] or "") for r in toxicity.keep_clean(df, labels).collect()))
    assert kept == sorted((i or -1, t or "") for i, t in [*enumerate(texts), *more] if t not in rejected)


def test_toxicity(spark):
    rng = random.Random(9)
    bad, plain = ["vilest", "scorned", "rotter"], ["".join(rng.choices("aeioulnrst", k=6)) for _ in range(200)]
    texts, labels = [], []
    for i in range(700):
        w = rng.choices(plain, k=40)
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "ly", "ness", "!"]))
        texts.append(" ".join(w))
        labels.append((i, 1, int(toxic)))
    texts += [None, ""]
    table = spark.createDataFrame([x for x in labels if x[0] < 500], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(frame(spark, texts), table).collect()}
    held = range(500, 700)
    assert np.mean([rows[i]["rejected"] == bool(labels[i][2]) for i in held]) > 0.97
    assert not rows[700]["rejected"] and not rows[701]["rejected"]
    kept = {r["doc_id"] for r in toxicity.keep_clean(frame(spark, texts), table).collect()}
    assert kept == {i for i, r in rows.items() if not r["rejected"]}
    none = toxicity.score_toxicity(frame(spark, texts[:5]), table.limit(0)).collect()
    assert len(none) == 5 and not any(r["rejected"] for r in none)
    assert toxicity.score_toxicity(empty(spark), table).count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_warc(spark, compress):
    record = warc.record_bytes(99, "u", b"false", None)
    inner = "x" * 10 + record.decode() + "tail"
    pages = [(i, f"http://h/{i}", f"<p>{i % 7}</p>") for i in range(30)]
    pages += [(100, "http://a b\n", inner), (101, None, None), (102, "u", ""), (103, "u", warc.gzip_member(record).decode("latin-1")), (104, "u", inner * 9000), (105, "u", inner)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    best = {}
    for i, _, h in pages:
        best[h or ""] = max(best.get(h or "", -1), i)
    rows = {r["page_id"]: r for r in warc.round_trip(df, compress).collect()}
    assert set(rows) == {p[0] for p in pages}
    for i, _, h in pages:
        data = (h or "").encode()
        to = best[h or ""]
        want = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to == i else "revisit", None if to == i else to)
        assert tuple(rows[i][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == want
    assert warc.round_trip(df.limit(0), compress).count() == 0
    small = {r["page_id"]: r["record_type"] for r in warc.round_trip(df, compress, min_bytes=1).collect()}
    assert small[101] == small[102] == "response"


@pytest.mark.parametrize("compress", [True, False])
def test_warc_long_heads(spark, tmp_path, compress):
    urls = {1: "u", 2: "data:text/html," + "a%20b" * 60_000, 3: "v", 4: "x" * (1 << 16), 5: "w"}
    df = spark.createDataFrame([(i, u, f"<p>{i}") for i, u in urls.items()], "page_id long, url string, html string").coalesce(1)
    assert sorted(r["page_id"] for r in warc.round_trip(df, compress).collect()) == list(urls)
    files = warc.write_warc(df, f"file://{tmp_path}/a", compress)
    files.write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")
    assert {r["page_id"]: r["url"] for r in warc.read_warc(files, range_bytes=10_000).collect()} == urls
    with pytest.raises(ValueError, match="5 of 6 records"):
        warc.read_warc(files.withColumn("records", files["records"] + 1))


def test_warc_ranges(spark, tmp_path):
    """Small ranges, so that chains cross many of them."""
    data = b"".join(warc.record_bytes(i, "u", b"WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 5 + b"y" * (i * 37 % 400), None) for i in range(80))
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "cut.warc").write_bytes(data[:5000])
    files = spark.createDataFrame([(f"file://{tmp_path}/a.warc", len(data)), (f"file://{tmp_path}/cut.warc", 5000)], "path string, bytes long")
    rows = warc.read_warc(files, range_bytes=700).collect()
    assert sorted(r["page_id"] for r in rows if r["path"].endswith("a.warc")) == list(range(80))
    cut = sorted(r["page_id"] for r in rows if r["path"].endswith("cut.warc"))
    assert cut == list(range(len(cut))) and cut


def test_suffix_tree_numbers():
    """Contexts' keys are distinct whatever the partition that numbered them; differences within groups come back."""
    for partitions in (1, 3, 7):
        numbers = np.concatenate([[0], *[pst._numbered(t, np.arange(50), partitions) for t in range(partitions)]])
        keys = pst._dealt(numbers, partitions)
        assert len(set(numbers.tolist())) == len(set(keys.tolist())) == 50 * partitions + 1
        assert set((keys >> pst._PLACE).tolist()) == set(range(partitions))
    for each in ([0, 3, 0, 1, 2, 0], [0, 0], []):
        x = np.array([5, 6, 9, 0, 2, 7][: sum(each)], np.int64)
        each = np.array(each, np.int64)
        assert pst._risen(pst._rises(x, each), each).tolist() == x.tolist()


def test_suffix_tree_sends_what_is_not_known():
    """A pair without training tokens comes without a probability; a block that has all listed symbols finds the factor."""
    none, one = np.empty(0, np.int64), lambda *x: np.array(x, np.int64)
    seen = pst._pack(one(5), one(50), one(1), one(7), one(0), one(40), none, np.array([0.01], np.float32))
    held = pst._pack(one(5), one(0), one(1), one(7), one(0), one(0), none, np.empty(0, np.float32))
    bare = pst._pack(one(5), one(60), one(0), none, none, none, none, np.empty(0, np.float32))
    sent = pa.table({"block": [0, 1, 2], "target": [0, 0, 0], "data": pa.array([held, seen, bare], pa.binary())})
    replies = [pst._unpack(x.as_py(), *pst._REPLY) for x in pst._grow(2, True, 2, 2, 1000)(sent).column("data")]
    assert [x[0].tolist() for x in replies] == [[2], [2], [1]] and [len(x[1]) for x in replies] == [0, 0, 1]
    assert [x[2].tolist() for x in replies] == [[110]] * 3 and [x[4].tolist() for x in replies] == [[40], [40], []]
    below = np.array([0.01], np.float32)
    p = pst._smoothed(np.array([40]), below, np.array([110]))
    assert replies[2][1][0] == pst._left(p, below.astype(np.float64))[0] and abs(p[0] + replies[2][1][0] * (1 - below[0]) - 1) < 1e-6
    rng = np.random.default_rng(2)
    for x in (rng.integers(0, 50, 400), rng.integers(0, 1 << 62, 400), none):
        assert all((a == b).all() for a, b in zip(pst._unique(x), np.unique(x, return_inverse=True), strict=True))
