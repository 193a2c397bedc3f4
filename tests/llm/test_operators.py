"""Every operator against a plain brute-force version, on given tables and on edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

from tarnflow.llm import common, embed_dedup, exact_dedup, language_id, minhash_dedup, packing, queries, substring_dedup, token_planes, tokens, url_rules, warc, word_table
from tarnflow.llm.components import connected_components

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("sig", T.StringType()), T.StructField("start", T.LongType())])
WORDS = re.compile(r"[^\x20\x09-\x0D]+")

_long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
_base = [f"term{i}" for i in range(120)]
EDGE = [
    (1, None, "en"), (2, "", "en"), (3, "   \n\t ", None), (4, "one two three", "en"), (5, "one  two\nthree", "de"), (6, "one two three four five", "en"),
    (7, " ".join(_base), "en"), (8, " ".join(_base[:100] + ["changed"] + _base[101:]), "en"), (9, " ".join(_base).upper(), "fr"), (10, " ".join(_base), "en"), (10, " ".join(_base), "en"),
    (11, _long, "en"), (12, "intro " + " ".join(_long.split()[1000:1100]) + " outro", "en"), (13, "1234 !! 567", "en"), (14, "a\x0bb\x0cc\u00a0d  e \u2028 f<|endoftext|>g <|startoftext|> h  ", "en"),
    (15, "e\u0301te\u0301 \u0301alone \u1e9e \u0130x don't I'LL \U0001f600\U0001f600 \u0928\u092e\u0938\u094d\u0924\u0947", "hi"), (None, "no id here at all in this text", "en"), (16, "x" * 5000, "en"), (17, " lead", "en"), (18, "trail \n ", "en"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, x, None, None, "clash", -1) for i, t, x in EDGE], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def result(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def least_reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("table", ["docs", "edge", "empty"])
def test_exact(request, table):
    df = request.getfixturevalue(table)
    groups = {}
    rows = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows_of(df)]
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    want = []
    for i, t in rows:
        keep = min((x for x in groups[t] if x is not None), default=None)
        want.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    for memory in (exact_dedup.MEMORY, 2000):
        assert result(exact_dedup.exact_duplicates(df, memory), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)


def test_trie_spills_and_splits(tmp_path):
    rng = np.random.default_rng(3)
    keys = [bytes(rng.integers(97, 100, rng.integers(0, 9)).tolist()) for _ in range(3000)]
    trie = exact_dedup.PatriciaTrie(3000, f"file://{tmp_path}")
    want = {}
    for i, k in enumerate(keys):
        trie.insert(k, 5000 - i)
        low, n = want.get(k, (10**9, 0))
        want[k] = (min(low, 5000 - i), n + 1)
    assert {k: (a, b) for k, a, b in trie.entries()} == want
    assert not list(tmp_path.iterdir())


def test_trie_of_prefixes(tmp_path):
    """Strings that are each other's prefixes, far over the budget, and one string over it by itself."""
    trie = exact_dedup.PatriciaTrie(20_000, f"file://{tmp_path}")
    keys = [b"a" * i for i in range(1500)] + [b"b" * 50_000] * 3
    for i, k in enumerate(keys):
        trie.insert(k, i)
        trie.insert(k, i + 1)
    assert {k: (a, b) for k, a, b in trie.entries()} == {**{b"a" * i: (i, 2) for i in range(1500)}, b"b" * 50_000: (1500, 6)}
    assert not list(tmp_path.iterdir())


def shingles(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("table", ["docs", "edge", "empty"])
def test_minhash(request, table):
    df = request.getfixturevalue(table)
    rows = [(i, shingles(t)) for i, t in rows_of(df)]
    links = [(a, b) for a, x in rows for b, y in rows if a is not None and b is not None and a < b and x and 100 * len(x & y) >= 75 * len(x | y)]
    comp = least_reachable({i for i, _ in rows if i is not None}, links)
    want = [(i, len(s), comp.get(i), i == comp.get(i)) for i, s in rows]
    assert result(minhash_dedup.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)


def test_minhash_chain_and_residual(spark, monkeypatch):
    """A chain whose ends don't link, groups that share half of their words, and tiny blocks."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for _ in range(3):
        common = [f"c{x}" for x in rng.integers(0, 10**6, 100)]
        for _ in range(6):
            own = [f"o{x}" for x in rng.integers(0, 10**6, 34)]
            for _ in range(4):
                w = common + own
                for p in rng.integers(0, len(w), 2):
                    w[p] = f"m{rng.integers(0, 10**6)}"
                rows.append((i, " ".join(w)))
                i += 1
    chain = [f"k{x}" for x in range(150)]
    for s in range(8):
        rows.append((i, " ".join(chain[s * 12 : s * 12 + 100])))
        i += 1
    order = rng.permutation(i).tolist()
    rows = [(order[a], t) for a, t in rows]
    sets = [(a, shingles(t)) for a, t in rows]
    links = [(a, b) for a, x in sets for b, y in sets if a < b and 100 * len(x & y) >= 75 * len(x | y)]
    comp = least_reachable(range(i), links)
    got = result(minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "component_id")
    assert got == sorted(comp.items(), key=repr)


def brute_components(rows):
    sets = [(a, shingles(t)) for a, t in rows]
    links = [(a, b) for a, x in sets for b, y in sets if a < b and x and 100 * len(x & y) >= 75 * len(x | y)]
    return sorted(least_reachable([a for a, _ in rows], links).items(), key=repr)


def test_minhash_few_long_texts(spark):
    """Texts over a tile's bytes, alike but not enough to link, whose blocks leave a tile with one side; and one
    that does link."""
    word = [f"shared word {i % 9973} of many {i}" for i in range(60_000)]
    rows = []
    for i, share in ((0, 0.0), (1, 0.176), (6, 0.176), (9, 0.02)):
        own = int(len(word) * share)
        rows.append((i, " ".join(word[own:] + [f"own {i} {k} text of its own" for k in range(own)])))
    assert sum(len(t) for _, t in rows) > minhash_dedup.BLOCK_BYTES // 4
    assert result(minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), "doc_id", "component_id") == brute_components(rows)


@pytest.mark.parametrize("size", [60, 3000])
def test_minhash_tiny_blocks_of_bytes(spark, monkeypatch, size):
    """Blocks by bytes leave many of them empty: tiles with one side hold no pair."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_BYTES", 200)
    monkeypatch.setattr(minhash_dedup, "TASK_ROWS", 3)
    rng, rows = np.random.default_rng(2), []
    base = [f"b{i}" for i in range(size)]
    for i in range(12):
        w = list(base)
        for p in rng.integers(0, size, size // 28):
            w[p] = f"x{rng.integers(0, 10**6)}"
        rows.append((int(i * 3 % 13), " ".join(w)))
    assert result(minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "component_id") == brute_components(rows)


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 1, 20, 50, 0, 90)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    assert minhash_dedup.common_counts(sets, sets).tolist() == want
    assert minhash_dedup.common_counts(sets[:2], sets[:1]).tolist() == [[0], [0]]


def passages(rows, window=50):
    first = {}
    words = [(i, WORDS.findall(t or "")) for i, t in rows]
    for i, w in words:
        if i is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p : p + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for p in range(len(w) - window + 1):
                if first[tuple(w[p : p + window])] < i:
                    gone.update(range(p, p + window))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_difference_cover():
    assert {(a - b) % 31 for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(31))


@pytest.mark.parametrize("table", ["docs", "edge", "empty"])
@pytest.mark.parametrize("held", [substring_dedup.HELD, 500])
def test_substring(request, table, held, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HELD", held)
    df = request.getfixturevalue(table)
    assert result(substring_dedup.repeated_passages(df), "doc_id", "n_words", "n_removed", "kept_sha256") == passages(rows_of(df))


def test_substring_one_word_over_and_over(spark):
    rows = [(i, " ".join(["a"] * (60 + i * 40) + ["b", str(i)] * (i % 3))) for i in range(8)] + [(3, " ".join(["a"] * 55)), (9, " ".join(["x y"] * 100))]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "text")
        assert result(substring_dedup.repeated_passages(df), "doc_id", "n_words", "n_removed", "kept_sha256") == passages(rows)


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_substring_texts_that_share_an_id(spark, parts):
    """One doc_id with many texts and many equal rows, whose passages a smaller document owns."""
    shared = " ".join(f"s{i}" for i in range(70))
    rows = [(5, f"{k} {shared} own{k} " + " ".join(f"t{k}x{i}" for i in range(k * 9))) for k in range(12)] + [(5, f"0 {shared} own0 ")] * 9 + [(2, shared), (7, shared + " " + shared), (2, "z " + shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert result(substring_dedup.repeated_passages(df), "doc_id", "n_words", "n_removed", "kept_sha256") == passages(rows)


def test_substring_random_overlaps(spark):
    rng = np.random.default_rng(9)
    pool = [f"p{x}" for x in range(3000)]
    rows = []
    for i in range(80):
        w = []
        for _ in range(rng.integers(1, 5)):
            a, n = rng.integers(0, 2800), rng.integers(20, 120)
            w += pool[a : a + n] + [f"u{rng.integers(0, 10**9)}"] * rng.integers(0, 3)
        rows.append((int(rng.integers(0, 60)), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(substring_dedup.repeated_passages(df), "doc_id", "n_words", "n_removed", "kept_sha256") == passages(rows)


def library_ids(name, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path(name))
    return t, t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("table", ["docs", "edge", "empty"])
def test_token_planes(request, table):
    df = request.getfixturevalue(table)
    got = token_planes.token_file_digests(df).collect()
    rows = {}
    for i, t in rows_of(df):
        ids = library_ids("byte_bpe_50k.json", t)[1] + [0]
        rows.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((i is not None, i or 0, *x) for i, v in rows.items() for x in v)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert ids == sorted(ids)


@pytest.mark.parametrize("bits", [False, True])
def test_plane_file_round_trip(tmp_path, bits):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 2**32, n, dtype=np.uint32) for n in (0, 1, 700, 3000, 5, 0)]
    with pa.OSFile(str(tmp_path / "f"), "wb") as out:
        w = token_planes.PlaneWriter(out, bits, chunk=512)
        for i, p in enumerate(parts):
            w.add(np.array([i]), np.array([0, len(p)]), p)
        assert w.close() == (6, 3706)
    with pa.OSFile(str(tmp_path / "f"), "rb") as source:
        r = token_planes.PlaneReader(source)
        assert (np.concatenate(list(r.chunks())) == np.concatenate(parts)).all()
    with pa.OSFile(str(tmp_path / "f"), "rb") as source:
        assert list(token_planes.PlaneReader(source).documents()) == [(i, len(p), zlib.crc32(p.tobytes())) for i, p in enumerate(parts)]


@pytest.mark.parametrize("table", ["docs", "edge", "empty"])
def test_word_table(request, table):
    df = request.getfixturevalue(table)
    want = []
    for i, text in rows_of(df):
        t, ids = library_ids("word_bpe_49k.json", text)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert result(word_table.word_table_digests(df), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


@pytest.mark.parametrize("table", ["docs", "edge"])
def test_word_table_by_small_chunks(request, table):
    df = request.getfixturevalue(table)
    cols = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert result(word_table.word_table_digests(df, chunk_bytes=3000), *cols) == result(word_table.word_table_digests(df), *cols)


def test_word_table_holds_one_chunk(monkeypatch, tmp_path):
    """What a worker holds of a split is a chunk's words, and both scans cut alike however they are batched."""
    import types

    import pyarrow as pa
    import pyarrow.dataset as pads

    texts = [" ".join(f"w{i % 290}x{j}" for j in range(40)) for i in range(300)]
    vocabulary = tokens.vocabulary_path("word_bpe_49k.json")

    def batches(rows):
        for a in range(0, len(texts), rows):
            part = texts[a : a + rows]
            yield pa.record_batch([pa.array(range(a, a + len(part))), pa.array([t.split() for t in part]), pa.array([7] * len(part), pa.int64())], ["doc_id", "words", "split"])

    monkeypatch.setattr("pyspark.TaskContext.get", lambda: types.SimpleNamespace(partitionId=lambda: 0))
    asked = pa.Table.from_batches(word_table._asked(2, 5000)(batches(70))).sort_by("word_group")
    answered = pa.Table.from_batches(word_table._answered(vocabulary)(iter(asked.to_batches())))
    pads.write_dataset(answered.drop(["part"]), tmp_path / "f", format="parquet", partitioning=["split", "chunk"], partitioning_flavor="hive")
    held = []

    class Seen(word_table._Answers):
        def __init__(self, *args):
            super().__init__(*args)
            held.append(sum(map(len, self.words.to_pylist())))

    monkeypatch.setattr(word_table, "_Answers", Seen)
    monkeypatch.setattr(word_table, "encode_units", None)  # every word has its answer
    got = pa.Table.from_batches(word_table._digests(vocabulary, (tmp_path / "f").as_uri(), 5000)(batches(11))).to_pylist()
    assert len(held) > 10 and max(held) <= 5000 + max(map(len, texts))
    for r, text in zip(got, texts, strict=True):
        ids = library_ids("word_bpe_49k.json", text)[1]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_small_batches_are_set_for_one_call(spark):
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    def run(df):
        return df.mapInArrow(sizes, "n long")

    records, size = common._RECORDS, common._BYTES
    before = spark.conf.get(records), spark.conf.get(size)
    spark.conf.set(records, "4000")
    try:
        df = spark.range(0, 4000, 1, 1)
        small = common.settled("probe", small_batches=True)(run)(df)
        assert {r.n for r in small.collect()} == {common.BATCH_ROWS, 4000 % common.BATCH_ROWS}
        assert spark.conf.get(records) == "4000" and spark.conf.get(size) == before[1]
        usual = common.settled("probe")(run)(df)
        assert [r.n for r in usual.collect()] == [4000]
        common.discard(small), common.discard(usual)
        long = common.settled("probe", small_batches=True)(run)(df.selectExpr("repeat('x', 100000) AS text"))
        assert max(r.n for r in long.collect()) <= common.BATCH_BYTES // 100_000 + 1
        common.discard(long)
    finally:
        spark.conf.unset(records)
    assert spark.conf.get(records) == before[0]


@pytest.mark.parametrize("table", ["docs", "edge", "empty"])
def test_packing(request, table):
    df = request.getfixturevalue(table)
    got = packing.pack(df).collect()
    want = []
    for i, text in rows_of(df):
        ids = library_ids("word_bpe_49k.json", text)[1] + [0]
        for p in range(0, len(ids), 2048):
            want.append((i, p // 2048, p, len(ids[p : p + 2048]), zlib.crc32(np.array(ids[p : p + 2048], "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, size in sorted(b):
            assert offset == at
            at += size
        assert at <= 2048
    sizes = [r.length for r in got]
    if table == "docs":
        assert len(bins) <= packing.lower_bound(sizes, 2048) + 1


def triplets(n, capacity, seed):
    """Pieces that fit n bins exactly, three to a bin, which best fit decreasing doesn't find."""
    import random

    rng, sizes = random.Random(seed), []
    for _ in range(n):
        a, b = rng.randint(capacity * 27 // 100, capacity * 40 // 100), rng.randint(capacity * 27 // 100, capacity * 40 // 100)
        sizes += [a, b, capacity - a - b]
    return sorted(sizes, reverse=True)


@pytest.mark.parametrize("step", [packing.mutation, packing.crossover])
def test_genetic_packing_beats_best_fit(step, monkeypatch):
    """Evolution, by mutation alone and by crossover alone, needs strictly fewer bins than best fit decreasing."""
    import random

    monkeypatch.setattr(packing, "MUTATED", 1.0 if step is packing.mutation else 0.0)
    for seed in range(3):
        sizes = triplets(60, 1000, seed)
        rng, bound = random.Random(seed), packing.lower_bound(sizes, 1000)
        start = packing._seeded(sizes, 1000, rng, 4, bound)
        plain = len(packing.Packing(sizes, 1000).best_fit(list(range(len(sizes)))).bins)
        end = packing.evolve(sizes, 1000, start, bound, rng, 60)[0]
        assert bound <= len(end.bins) < plain and len(end.bins) < min(plain, 64)
        assert sorted(i for b in end.bins for i in b) == list(range(180))
        assert all(sum(sizes[i] for i in b) + r == 1000 and r >= 0 for b, r in zip(end.bins, end.free, strict=True))


def test_packing_islands_and_equal_rows(spark, monkeypatch):
    """Islands over Spark beat best fit as well, and rows that are all equal are spread over the shards."""
    sizes = triplets(60, 100, 3)
    rows = [(i, " ".join(["a"] * (n - 1))) for i, n in enumerate(sizes)]  # a word is an id, and the end's
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), length=100).collect()
    assert sorted(r.length for r in got) == sorted(sizes)
    assert len({r.sequence_id for r in got}) < len(packing.Packing(sizes, 100).best_fit(list(range(180))).bins)
    monkeypatch.setattr(packing, "SHARD", 50)
    got = packing.pack(spark.createDataFrame([(7, "same text")] * 400, "doc_id long, text string")).collect()
    assert len(got) == 400 and len({r.sequence_id >> 24 for r in got}) == 8


def test_language_id(request, spark, docs, edge, empty):
    df = docs
    got = {r.doc_id: r for r in language_id.predict(df, language_id.train(df), ("lang",)).collect()}
    held = [r for r in got.values() if r.held_out and r.lang]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    model = language_id.train(df)
    for r in language_id.predict(edge, model).collect():
        text = {i: t for i, t, _ in EDGE}[r.doc_id]
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
    assert language_id.predict(empty, language_id.train(empty)).count() == 0
    assert {r.lang_pred for r in language_id.predict(edge, language_id.train(empty)).collect()} == {"und"}


def brute_grams(text):
    """Buckets of a text's letter n-grams, one letter at a time."""
    c = [x if x.isalpha() else "\0" for x in f" {text.lower()} "]
    c = [x for k, x in enumerate(c) if not k or x != "\0" or c[k - 1] != "\0"]
    for k, n in enumerate(language_id.ORDERS):
        for a in range(len(c) - n + 1):
            h = 0
            for x in c[a : a + n]:
                h = ((h ^ (0 if x == "\0" else ord(x))) * 0x9E3779B1) & 0xFFFFFFFF
                h ^= h >> 15
            yield (h >> 3) % language_id.BUCKETS + k * language_id.BUCKETS


def brute_model(texts):
    """texts of each language -> languages, codewords, log odds and weight of each bit."""
    import math

    langs = sorted(texts)
    codes = language_id.code_matrix(len(langs))
    p = {}
    for x in langs:
        total = [language_id.SMOOTH] * (language_id.BUCKETS * len(language_id.ORDERS))
        for t in texts[x]:
            for g in brute_grams(t):
                total[g] += 1
        whole = sum(total)
        p[x] = [v / whole for v in total]
    odds, weight = [], []
    for b in range(codes.shape[1]):
        sides = [[p[x] for k, x in enumerate(langs) if codes[k, b] * s > 0] for s in (1, -1)]
        up, down = ([sum(v) / len(side) for v in zip(*side, strict=True)] for side in sides)
        odds.append([math.log(u / d) for u, d in zip(up, down, strict=True)])
        weight.append(sum((u - d) * w for u, d, w in zip(up, down, odds[-1], strict=True)))
    return langs, codes, odds, [w * len(weight) / sum(weight) for w in weight]


def brute_language(text, model):
    """Language, score and lead over the second, by loss-weighted decoding one bit at a time."""
    import math

    langs, codes, odds, weight = model
    if not any(x.isalpha() for x in text or ""):
        return "und", 0.0, 0.0
    found = list(brute_grams(text))
    margin = [sum(o[g] for g in found) / len(found) for o in odds]
    loss = [sum(math.log1p(math.exp(-language_id.SLOPE * m * codes[k, b])) * weight[b] for b, m in enumerate(margin)) for k in range(len(langs))]
    best = sorted(loss)
    return langs[loss.index(best[0])], 1 / sum(math.exp(best[0] - x) for x in loss), best[1] - best[0]


def test_language_id_equals_brute_force(spark):
    said = {"en": ["the cat sat on the mat", "where is the house of the king"], "de": ["die Katze sa\u00df auf der Matte", "wo ist das Haus"], "fr": ["le chat est sur le tapis", "o\u00f9 est la maison du roi"], "es": ["el gato est\u00e1 en la alfombra", "\u00bfd\u00f3nde est\u00e1 la casa?"]}
    rows = [(i, t, x) for x, ts in said.items() for i, t in enumerate(ts * 3)]
    asked = [(100 + i, t, None) for i, t in enumerate(["the house", "das Haus der Katze", "la maison", "la casa del gato est\u00e1 aqu\u00ed", "12 !", None, "", "Der the LE el", "long " * 60])]
    kept = lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    plain = brute_model({x: [t for i, t, y in rows if y == x and kept(i)] for x in said})
    schema = "doc_id long, text string, lang string"
    model = language_id.train(spark.createDataFrame(rows, schema))
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(asked, schema), model).collect()}
    for i, t, _ in asked:
        lang, score, _ = brute_language(t, plain)
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-3
    assert [got[i].lang_pred for i in (104, 105, 106)] == ["und"] * 3
    with pytest.raises(ValueError, match="languages"):
        language_id.train(spark.createDataFrame(rows, schema), most=3)


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 20])
def test_codewords(n):
    m = language_id.code_matrix(n)
    assert len({tuple(r) for r in m.tolist()}) == n
    assert all(-n < c < n for c in m.sum(axis=0))


def brute_vectors(rows, cosine=0.93):
    def unit(e):
        if e is None or not len(e) or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            return None
        return np.array(e, float) / np.abs(e).max()

    one = {}
    for i, e, label in rows:
        one.setdefault(i, (label, unit(e)))
    count, links = dict.fromkeys(one, 0), []
    for a, (la, x) in one.items():
        for b, (lb, y) in one.items():
            if a is not None and b is not None and a != b and la == lb and la is not None and x is not None and y is not None and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                count[a] += 1
                links.append((a, b))
    comp = least_reachable(one, links)
    return sorted(((i, count[i], comp[i], i == comp[i]) for i in one), key=repr)


@pytest.mark.parametrize(("tile", "whole", "grid"), [(4096, 65_536, (10**6, 10**7)), (8, 65_536, (10**6, 10**7)), (8, 5, (10**6, 10**7)), (40, 5, (8, 10**7)), (8, 5, (8, 20))])
def test_embeddings(spark, monkeypatch, tile, whole, grid):
    """One cell a label in one tile and in many, and cells of one, two and three coordinates."""
    for name, value in (("TILE", tile), ("WHOLE", whole), ("GRID", grid)):
        monkeypatch.setattr(embed_dedup, name, value)
    monkeypatch.setattr(embed_dedup, "RUN", 7)
    rng = np.random.default_rng(4)
    rows = []
    for k in range(30):
        center = rng.standard_normal(16)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows) * 7 % 1009, (center + 0.25 * rng.standard_normal(16)).astype(np.float32).tolist(), int(k % 3)))
    rows += [(3000 + i, rows[3][1], rows[3][2]) for i in range(20)]  # copies of one vector
    rows += [(2001, None, 1), (2002, [], 1), (2003, [0.0] * 16, 1), (2004, [float("nan")] * 16, 1), (2005, [1.0, None] * 8, 1), (2006, rows[0][1], None), (2007, [1.0] * 8, 0), (2008, [2.0] * 8, 0), (2009, [float("inf")] * 16, 1), rows[0]]
    schema = "vec_id long, embedding array<float>, label int, block int"
    df = spark.createDataFrame([(*r, 5) for r in rows], schema)
    assert result(embed_dedup.near_duplicate_vectors(df), "vec_id", "n_links", "component_id", "kept") == brute_vectors(rows)
    assert embed_dedup.near_duplicate_vectors(df.where("false")).count() == 0


def test_embeddings_of_doubles(spark):
    """Compared as given: a pair just above the threshold and one just below it, and numbers beyond floats."""
    def pair(cosine):
        return [1.0, 0.0, 0.0, 0.0], [cosine, (1 - cosine * cosine) ** 0.5, 0.0, 0.0]

    rows = [(2 * k + i, [x * scale for x in v], k) for k, (c, scale) in enumerate([(0.93 + 1e-9, 1.0), (0.93 - 1e-9, 1.0), (0.95, 1e300), (0.95, 1e-300)]) for i, v in enumerate(pair(c))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert [r[1] for r in result(embed_dedup.near_duplicate_vectors(df), "vec_id", "n_links")] == [1, 1, 0, 0, 1, 1, 1, 1]


PAGES = "page_id long, url string, html string, digest string, owner long"


def test_warc(spark):
    big, edge = "<p>é" + "x" * 1500, "y" * 1000
    rows = [(1, "http://a/\r\nX: y", big), (5, None, big), (3, "http://ü.de/ß", big), (2, "http://b", edge), (9, "", edge), (4, "http://c", "small"), (6, "http://d", "small"), (7, "http://e", None), (8, None, ""), (5, None, big), (10, "http://f", "z\r\n\r\nWARC/1.1\r\n" * 100), (None, "http://g", big)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES).repartition(3)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        owner = max((a for a, _, b in rows if (b or "").encode() == data and a is not None), default=None) if len(data) >= 1000 and i is not None else None
        revisit = owner is not None and owner != i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", owner if revisit else None))
    assert result(warc.archive_digests(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert warc.archive_digests(df.where("false")).count() == 0


def judged(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, "allow")


def test_urls(spark, monkeypatch):
    urls = [None, "", "no scheme", "http://", "HTTP://A.NET/x", "http://net", "http://net/", "http://x.example.net/en/1?q", "http://x.example.net/en", "http://example.com/de/#", "http://b.example.com/de/x://y", "http://xnet/", "http://.net/", "a://b..org/fr/x", "http://org/fr/", "http://u@x.net:80/", "http://ex.net?x/", "http://K.net/", "x://y.NET\n/z", "://z.net/q", "http://É.net/"]
    df = spark.createDataFrame([(i % 5, u, "h") for i, u in enumerate(urls + urls)], "page_id long, url string, host string")
    rules = spark.createDataFrame(url_rules.RULES, "verdict string, host string, path string")
    want = sorted(((i % 5, *judged(u)) for i, u in enumerate(urls + urls)), key=repr)
    assert result(url_rules.judge(df, rules), "page_id", "host", "path", "rule", "verdict") == want
    many = spark.sql("SELECT 'block' AS verdict, concat('h', id, '.listed.org') AS host, concat('/', id % 7) AS path FROM range(3000)").unionByName(rules).unionByName(rules)
    assert result(url_rules.judge(df, many), "page_id", "host", "path", "rule", "verdict") == want
    hit = spark.createDataFrame([(1, "http://a.h12.listed.org/5/x", ""), (2, "http://h12.listed.org/4", "")], "page_id long, url string, host string")
    assert result(url_rules.judge(hit, many), "page_id", "rule", "verdict") == [(1, "h12.listed.org/5", "block"), (2, None, "allow")]
    long = "http://" + ".".join(["a"] * 300) + ".net/" + "p" * 10**6
    assert result(url_rules.judge(spark.createDataFrame([(1, long, "")], "page_id long, url string, host string"), rules), "rule", "verdict") == [("net/", "block")]
    monkeypatch.setattr(url_rules, "FILTER_URLS", 0)
    assert result(url_rules.judge(df, rules), "page_id", "host", "path", "rule", "verdict") == want
    assert url_rules.judge(df.where("false"), rules).count() == 0
    assert {r.verdict for r in url_rules.judge(df, rules.where("false")).collect()} == {"allow"}


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    nodes = {x for a, b in edges for x in (a, b) if None not in (a, b) and a != b}
    want = least_reachable(nodes, [(a, b) for a, b in edges if None not in (a, b)])
    got = connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert result(got, "node", "component") == sorted(want.items(), key=repr)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_tables_between_steps_go(spark):
    """An operator leaves its result behind and nothing else, also where it fails."""
    import os

    folder = common.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))

    @common.settled("kept")
    def operator(df):
        common.materialize(df, "first")
        second = common.materialize(inner(df), "second")
        return second if df.columns == ["id"] else second.select("none")

    @common.settled("inner")
    def inner(df):
        common.materialize(df, "third")
        return df

    out = operator(spark.range(5))
    assert out.count() == 5 and {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == {"kept"}
    common.discard(out)
    with pytest.raises(Exception, match="none"):
        operator(spark.range(5).withColumnRenamed("id", "x"))
    assert set(os.listdir(folder)) == before
    assert spark.conf.get(common._CLEANUP) == "false"


def test_shared_folder_is_no_local_one_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_folder(Session())


@pytest.mark.parametrize("most", [0, 10**6])
def test_by_id_keeps_rows_with_null_keys(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_IDS", most)
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (None, None)], "doc_id long, text string")
    ids = spark.createDataFrame([(1, 7), (None, 8)], "doc_id long, owner long")
    rows = lambda how, x: sorted(map(tuple, common.by_id(left, x, "doc_id", how).collect()), key=repr)
    assert rows("left", ids) == sorted([(1, "a", 7), (2, "b", None), (None, "c", None), (None, None, None)], key=repr)
    assert rows("left_anti", ids) == sorted([(2, "b"), (None, "c"), (None, None)], key=repr)
    assert rows("left_semi", ids) == [(1, "a")] and rows("inner", ids) == [(1, "a", 7)]


def test_queries_cover_all_operators():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 11))
    assert isinstance(Row(x=1).x, int)
