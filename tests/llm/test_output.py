"""Fill-in-middle and token files: the library and plain Python against them, round trips, damage, edges."""

import hashlib
import os
import random
import tempfile
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from tokenizers import Tokenizer

from wavespark.llm import fim, queries, rans, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n\t", "a", "é́ x", "👩‍👩‍👧 🏽", "x\x1cy\x85z\xa0w　q", "a<|endoftext|>b", "<P>", "a <S> b", "<M", "<P<P", "S>" * 5, "word " * 30_000]


def same_as_sql(spark, sf, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = con.sql(queries.ORACLES[name]), queries.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(repr, (tuple(r[i] for i in at) for r in want.fetchall())))


# Fill in the middle


def test_units_are_those_of_a_search():
    rng = random.Random(3)
    for unit in (fim.CODE_POINT, r"\S+\s*", r"a|ab|abc", r"\X", r"[^\s]{1,3}"):
        for text in [*ODD[:-1], "abcabab a" * 400, *("".join(rng.choice("ab c\n👩é́") for _ in range(700)) for _ in range(20))]:
            assert list(fim.unit_ends(text, unit)) == [m.end() for m in regex.finditer(unit, text)]


def test_outputs_and_restored_texts(spark):
    rng = random.Random(4)
    texts = [None, *ODD, *("".join(rng.choice(["<", ">", "P", "S", "M", "<P>", "é", "👍", " ", "b"]) for _ in range(rng.randint(1, 40))) for _ in range(300))]
    data = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (7, texts[7]), (7, texts[7])]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'x' AS n", "1 AS form", "2 AS _fim2")
    got = fim.fill_in_middle(df).collect()
    assert len(got) == len(data) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        t = r.text or ""
        h = hashlib.sha256(f"1:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
        a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
        if not t or any(m in t for m in fim.MARKS) or h[2] % 100 >= 90:
            want = ("plain", None, None, t)
        elif h[3] % 100 < 20:
            want = ("spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}")
        else:
            want = ("psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}")
        assert (r.form, r.prefix_chars, r.middle_chars, r.output) == want and r.n == len(t)
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert fim.fill_in_middle(df.limit(0)).count() == 0
    assert {r.output for r in fim.fill_in_middle(df, keep_output=False).collect()} == {None}
    words = fim.fill_in_middle(df, unit=r"\S+\s*", changed=100, marks=("[p]", "[s]", "[m]")).collect()
    assert all(r.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() for r in words)


def test_marks_that_cannot_be_read_back_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for marks in (("aba", "x", "y"), ("<", "<S>", "<M>"), ("ab", "bc", "x"), ("", "a", "b")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(df, marks=marks)


def test_fill_in_middle_equals_sql(spark):
    same_as_sql(spark, "/root/testdata/sf0.01", "op11_fill_in_middle", ["documents"])


# Token files


def test_codec_round_trips():
    rng = np.random.default_rng(1)
    for kinds in (1, 2, 300, 40_000):
        p = 1 / np.arange(1, kinds + 1)
        sizes = [0, 1, 31, 32, 33, rans.STRETCH - 1, rans.STRETCH, rans.STRETCH + 1, 3 * rans.STRETCH + 5]
        blocks = [rng.choice(kinds, size=n, p=p / p.sum()).astype(np.uint16) for n in sizes]
        counts = sum(np.bincount(b, minlength=kinds) for b in blocks)
        freq = rans.frequencies(counts.tolist())
        assert freq.sum() == 1 << rans.BITS and ((freq > 0) == (counts > 0)).all()
        tables = rans.Tables(freq)
        coded = tables.encode(blocks)
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, tables.decode(coded), strict=True))
        for i, b in enumerate(blocks):  # each alone, too
            assert (tables.decode(coded[i : i + 1])[0] == b).all()
    assert rans.frequencies([1] * 10 + [10**15, 0]).sum() == 1 << rans.BITS
    with pytest.raises(ValueError):
        rans.Tables(rans.frequencies([1, 0])).encode([np.array([1])])


def test_words_are_encoded_as_in_their_texts(monkeypatch):
    """Words taken apart at their end, looked up in tables that are full at once, against the library on whole texts."""
    monkeypatch.setattr(token_files, "KNOWN", 50)
    monkeypatch.setattr(token_files, "KNOWN_PARTS", 60)
    own, library, rng = token_files.Words(PATH), Tokenizer.from_file(PATH), random.Random(1)
    parts = ["a", "B", "É", "é", "'s", "'", "...", "*", ",", "<|endoftext|>", "<|", "1", "²", "Ⅷ", "字", "\u0301", "ſ", "İ", "ﬁ", "^^", "&", "%.", "_", "-", " ", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        ids, sizes = own.encode(pa.array(some))
        for t, end, n in zip(some, np.cumsum(sizes), sizes, strict=True):
            assert ids[end - n : end].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_parts_of_words_are_encoded_as_in_their_texts():
    """Capitals, marks on both sides, letters that compose with what follows, and what looks like a special token, against whole texts."""
    own, library, rng = token_files.Words(PATH), Tokenizer.from_file(PATH), random.Random(2)
    parts = ["a", "B", "H", "I", "Ä", "ä", "ß", "×", "÷", "Þ", "'S", "'", "'RE", "...", "(", "=", "<", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "endoftext"]
    parts += ["1", "²", "\u0301", "\u0304", "\u0307", "\u0331", "\u0338", "\u212a", "Σ", "ᄀ", "ᅡ", "🙂", " ", "\n", "\x85", "\x1c", "\x00"]
    texts = ["", "<", "(", "É", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(20_000))]
    for some in [[t] for t in texts[:4]] + [texts[at : at + 1000] for at in range(0, len(texts), 1000)]:
        ids, sizes = own.encode(pa.array([None, *some])[1:])
        for t, end, n in zip(some, np.cumsum(sizes), sizes, strict=True):
            assert ids[end - n : end].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_new_words_go_to_the_library_together():
    """A word in other capitals or between other marks is the same, and many words of small letters are one text for the library."""
    own, seen = token_files.Words(PATH), []

    class Counted:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, texts, **more):
            seen.extend(texts)
            return self.library.encode_batch_fast(texts, **more)

    for name in ("library", "bare"):
        if hasattr(own, name):
            setattr(own, name, Counted(getattr(own, name)))
    words = [a + b + c for a in "bdfgklm" for b in ("ea", "ou", "ö", "ü") for c in ("nd", "rst", "lt", "ß", "mp")]
    ids, _ = own.encode(pa.array([" ".join(words), " ".join(w.upper() for w in words if w.isascii()), ", ".join(f"({w.capitalize()})" for w in words)]))
    assert len(ids) > 3 * len(words) and len(seen) < 12


def test_damage_is_noticed():
    tables = rans.Tables(rans.frequencies([5, 3, 2]))
    data = token_files.pack(tables.encode([np.array([0, 1, 2, 0, 0])])[0], [1, None], [2, 3])
    assert token_files.unpack(data)[1] == [1, None]
    for k in range(len(data)):
        broken = bytearray(data)
        broken[k] ^= 1
        with pytest.raises(ValueError):
            token_files.unpack(bytes(broken))


def written(spark, df, **more):
    folder = f"file://{tempfile.mkdtemp(prefix='spark-')}/files"
    return folder, token_files.write_token_files(spark, df, PATH, folder, **more)


def test_documents_come_back_in_order(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 3_000)
    library = Tokenizer.from_file(PATH)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(-5 - i, t) for i, t in enumerate([None, *ODD])]
    folder, manifest = written(spark, spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS part", "'q' AS mark").repartition(5), end_id=2)
    got = sorted(token_files.read_token_files(spark, folder, keep_ids=True).collect(), key=lambda r: r.start)
    start = 0
    for r, (doc_id, text) in zip(got, sorted(docs), strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (doc_id, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    rows = manifest.orderBy("part", "block").collect()
    assert len(rows) > 5 and sum(r.tokens for r in rows) == start
    # Files are in order within, and a file that no row names is not there any more.
    root = folder.removeprefix("file://")
    assert {f for f in os.listdir(root) if f.endswith(".tok")} == {r.path for r in rows}
    assert all(a.offset + a.length == b.offset for a, b in zip(rows, rows[1:], strict=False) if a.path == b.path)


def test_token_file_edges(spark):
    df = spark.createDataFrame([(None, "b"), (None, None), (3, "a a"), (3, "a a"), (3, "c")], "doc_id long, text string")
    folder, _ = written(spark, df)
    got = token_files.read_token_files(spark, folder).orderBy("start", "n_tokens").collect()
    assert [r.doc_id for r in got] == [None, None, 3, 3, 3] and sorted(r.n_tokens for r in got) == [0, 1, 1, 2, 2]
    assert [r.start for r in got] == sorted(r.start for r in got)
    folder, _ = written(spark, df.limit(0), end_id=2)
    assert token_files.read_token_files(spark, folder).count() == 0
    folder, _ = written(spark, df.limit(1).selectExpr("doc_id", "'' AS text"))
    assert [r.n_tokens for r in token_files.read_token_files(spark, folder).collect()] == [0]
