"""Own encoder against the library, on the test tables and on odd texts."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wavespark.llm.bpe import PairTree, WordBpe, encode_decode, library_differences

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "I'm they'll 'S  it's", "İstanbul ΣΑΣ Σ", "a<|endoftext|>b <|startoftext|>", "<|endoftext|", "e\u0301 \u00e9 ﬁ Å\u030a", "x\x1cy\x85z\xa0w\u3000q", "日本語テスト 漢字", "👩‍👩‍👧 🏽", "१२३ 12345", "a" * 500, "!?" * 300, "\u0300\u0301 a", "\u1100\u1161\u11a8", "ǅ ß ẞ ſt"]


@pytest.fixture(scope="module")
def both():
    return WordBpe(PATH, library_differences()), Tokenizer.from_file(PATH)


def same(both, text):
    own, lib = both
    want = lib.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want, text
    ids, decoded = own.both(text)
    assert memoryview(ids).cast("I").tolist() == want
    assert decoded == lib.decode(want, skip_special_tokens=False), text


def test_odd_texts(both):
    for text in ODD:
        same(both, text)


def test_code_points_of_other_unicode_versions(both):
    """All code points that the library's tables know otherwise than Python's, and random ones of all planes."""
    points = {c for pairs in library_differences() for c, _ in pairs}
    assert {0x558, 0x88F, 0x208F, 0x1C89, 0xA7CB} & points
    rng = random.Random(6)
    points |= {c for c in (rng.randrange(0x80, 0x110000) for _ in range(3000)) if not 0xD800 <= c < 0xE000}
    some = sorted(points)
    for at in range(0, len(some), 50):
        same(both, " ".join(f"Ab{chr(c)}cD {chr(c)}1{chr(c)} !{chr(c)}" for c in some[at : at + 50]))
    for _ in range(500):
        same(both, "".join(chr(rng.choice(some)) for _ in range(20)))


def test_random_texts(both):
    rng = random.Random(5)
    letters = [*"abcdefghijklmnopqrstuvwxyzABCÉéßüñ' .,!?-0123456789\t\n<|>", "the", "tion", "ing", "'s", "<|endoftext|>", "\u0301", "ه", "я", "字", "😀"]
    for _ in range(1500):
        same(both, "".join(rng.choice(letters) for _ in range(rng.randint(1, 60))))


def test_tree_root_is_leftmost_least():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 40)
        keys = [rng.randint(0, 5) * n + i for i in range(n)]
        tree = PairTree(keys, 10**6)
        for _ in range(20):
            i = rng.randrange(n)
            keys[i] = rng.choice([10**6, rng.randint(0, 5) * n + i])
            tree.put(i, keys[i])
            assert tree.root == min(keys)


def test_documents_and_edges(spark, both, docs_dir):
    lib = both[1]
    docs = spark.read.parquet(f"{docs_dir}/documents.parquet")
    rows = encode_decode(spark, docs.withColumn("ids", docs.doc_id), PATH, keep_ids=True).collect()
    assert len(rows) == docs.count()
    for r in rows[:60]:
        assert r.ids == lib.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded == lib.decode(r.ids, skip_special_tokens=False)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "x " * 50_000)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in encode_decode(spark, odd, PATH).collect()) == [0, 0, 0, 50_000]
    assert encode_decode(spark, odd.limit(0), PATH).count() == 0
