"""Every stage of the pipeline against brute force, on what the stage before it kept, and the whole of it."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from wavespark.llm import order_minhash
from wavespark.llm.queries import VOCABULARY
from wavespark.llm.words import WordHashes, find_words

from test_dedup import by_force
from test_rest import by_hand


@pytest.fixture(scope="module")
def stages(spark, docs_dir, tmp_path_factory):
    """The rows before the first stage and after each one."""
    frame = spark.read.parquet(f"{docs_dir}/documents.parquet")
    rows = [frame.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path_factory.mktemp('stage')}/{i}"
        stage(spark, frame, docs_dir).write.parquet(path)
        frame = spark.read.parquet(path)
        rows.append(frame.collect())
        assert i == len(corpus_pipeline.STAGES) - 1 or frame.columns == spark.read.parquet(f"{docs_dir}/documents.parquet").columns
    return rows


def test_quality_stage(spark, docs_dir, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{docs_dir}/labels.parquet").collect()}
    docs = [(r.doc_id, r.text, r.source, r.lang) for r in stages[0]]
    scores = by_hand(docs, {i: v for i, v in labels.items() if i in {d[0] for d in docs}})
    clear = {i for i, (_, _, s) in scores.items() if abs(s - 0.5) > 1e-6}
    assert {r.doc_id for r in stages[1]} & clear == {i for i, (_, _, s) in scores.items() if s >= 0.5} & clear
    assert {r.doc_id: r.text for r in stages[1]}.items() <= {r.doc_id: r.text for r in stages[0]}.items()


def test_near_duplicate_stage(stages):
    hashes = WordHashes()
    words = {r.doc_id: hashes.of(find_words(r.text or "")) for r in stages[1]}
    up = {i: i for i in words}

    def root(i):
        return i if up[i] == i else root(up[i])

    for a, x in words.items():
        for b, y in words.items():
            limit = int(0.2 * max(len(x), len(y)) + 1e-9)
            if a < b and len(x) and len(y) and abs(len(x) - len(y)) <= limit and order_minhash.least_edits(x, y) <= limit:
                if order_minhash.edits_within(x, y, limit) is not None:
                    up[max(root(a), root(b))] = min(root(a), root(b))
    assert {r.doc_id for r in stages[2]} == {i for i in words if root(i) == i}


def test_substring_stage(stages):
    want = {i: (gone, kept) for i, _, gone, kept in by_force([(r.doc_id, r.text) for r in stages[2]])}
    before = {r.doc_id: r.text for r in stages[2]}
    assert {r.doc_id: r.text for r in stages[3]} == {i: kept if gone else before[i] for i, (gone, kept) in want.items()}


def test_mixing_stage(stages):
    size = {r.doc_id: len(find_words(r.text or "")) for r in stages[3]}
    per: Counter = Counter()
    for r in stages[3]:
        per[r.source] += size[r.doc_id]
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    stopped: set = set()
    while True:
        rest, share = sum(per.values()) - sum(3 * per[s] for s in stopped), sum(weight[s] for s in order if s not in stopped)
        target = {s: 3 * per[s] if s in stopped else weight[s] * rest / share for s in order}
        more = {s for s in order if s not in stopped and target[s] > 3 * per[s]}
        if not more:
            break
        stopped |= more
    want: Counter = Counter()
    for r in stages[3]:
        rate = min(3.0, target[r.source] / per[r.source]) if per[r.source] else 0.0
        draw = int(hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest()[:13], 16) / 16**13
        want[r.doc_id] = int(rate) + (draw < rate - int(rate))
    assert Counter(r.doc_id for r in stages[4]) == +want


def test_encoding_stage(stages):
    library = Tokenizer.from_file(VOCABULARY)
    text = {r.doc_id: r.text for r in stages[4]}
    assert Counter(r.doc_id for r in stages[5]) == Counter(r.doc_id for r in stages[4])
    for r in stages[5]:
        ids = library.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_whole_run(spark, docs_dir, stages):
    got = corpus_pipeline.run(spark, docs_dir).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, stages[-1]))
