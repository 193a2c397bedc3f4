"""The pipeline's stages, each on its predecessor's rows, against brute force."""

import hashlib
import re
import zlib

import corpus_pipeline
import numpy as np

from tarnflow.llm import language_id, packing
from tarnflow.llm.common import materialize

from .test_operators import EDGE, WORDS, brute_language, brute_model, least_reachable, library_ids, passages, shingles

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, sig string, start long, set_key string"


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), f"test-{name}")
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "language":
            told = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
            learnt = {}
            for i, t in before.items():
                if told[i] is not None and t is not None and zlib.crc32(str(i).encode()) % 5:
                    learnt.setdefault(told[i], []).append(t)
            model = brute_model(learnt)
            judged = {i: brute_language(t, model) for i, t in before.items()}
            assert after == {i: t for i, t in before.items() if judged[i][0] != "und" and judged[i][2] >= language_id.LEAD}
            assert len(after) >= 0.99 * len(before)
        elif name == "exact":
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i] or ""), i)
            assert after == {i: before[i] for i in first.values()}
        elif name == "near":
            sets = {i: shingles(t) for i, t in before.items()}
            links = [(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and x and 100 * len(x & y) >= 75 * len(x | y)]
            comp = least_reachable(sets, links)
            assert after == {i: t for i, t in before.items() if comp[i] == i}
        else:
            want = {i: (n, gone, digest) for i, n, gone, digest in passages(list(before.items())) if gone < n or not gone}
            assert after.keys() == want.keys()
            for i, t in after.items():
                assert hashlib.sha256(" ".join(WORDS.findall(t)).encode()).hexdigest() == want[i][2]
                assert want[i][1] or t == before[i]
        before = after
    want = []
    for i, text in before.items():
        ids = library_ids("word_bpe_49k.json", text)[1] + [0]
        want += [(i, p // 2048, p, len(ids[p : p + 2048]), zlib.crc32(np.array(ids[p : p + 2048], "<u4").tobytes())) for p in range(0, len(ids), 2048)]
    got = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for some in places.values():
        ends = [a + n for a, n in sorted(some)]
        assert [a for a, _ in sorted(some)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(places) <= packing.lower_bound([r.length for r in got], 2048) + 1


def test_stages_on_edge_rows(spark, sf):
    """Nulls, repeated rows, a long text, clashing columns: every stage ends, keeps the columns and its own rule."""
    rows = [(i, t, x, None, None, "s", -1, "k") for i, t, x in EDGE] + [(20, "x" * 2_000_000 + " word", "en", None, None, "s", 1, "k"), (None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {(r.doc_id, r.text) for r in docs.collect()}
        docs = materialize(stage(spark, docs, sf), f"test-{name}")
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        after = {(r.doc_id, r.text) for r in docs.collect()}
        if name != "substring":
            assert after <= before
        if name == "language":
            assert {i for i, _ in before - after} >= {1, 2, 3, 13}  # nothing to read
        else:
            assert {i for i, _ in after} >= {None, 4, 6, 14, 15, 16}  # rows of their own stay, and those without an id
    got = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in got} == {i for i, _ in after}


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), f"test-{name}")
        assert docs.count() == 0


def test_run_leaves_its_result_alone_behind(spark, tmp_path):
    import os

    from tarnflow.llm.common import shared_folder

    docs = spark.createDataFrame([(i, t, x, "web", 1) for i, t, x in EDGE[:9]], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == {"packed"}
    assert {r.doc_id for r in out.collect()} >= {4, 6, 7}
