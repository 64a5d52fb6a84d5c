"""Very long texts, odd numbers, repeated rows, clashing columns and empty tables, where the other tests don't reach."""

import hashlib
import math

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from test_rest import rows_of
from wavespark.llm import chat, maxscore, mixing, recompression, vectors

LONG = 120_000


def test_long_texts_are_mixed_and_cut_whole(spark):
    docs = [(1, "word " * LONG, "a"), (2, "x", "a"), (3, " y \n\n z", "b")]
    got = {r.doc_id: r for r in mixing.mix(spark, rows_of(spark, docs, "doc_id long, text string, source string")).collect()}
    assert got[1].size == LONG and got[3].size == 2 and got[1].source_size == LONG + 1
    passage = " ".join(f"w{i}" for i in range(LONG))
    rows = {r.doc_id: r for r in recompression.remove_repeats(spark, spark.createDataFrame([(1, passage), (2, f"before {passage} after"), (3, passage.upper())], "doc_id long, text string")).collect()}
    assert (rows[1].n_removed, rows[2].n_removed, rows[2].kept_text, rows[3].n_removed) == (0, LONG, "before after", 0)


def test_long_turns_and_clashing_columns_are_formatted(spark):
    turns = [(1, 0, "user", "<|im_end|>" * LONG), (1, 1, "assistant", "é" * LONG), (2, 0, "user", "a"), (2, 1, "assistant", "b")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").selectExpr("*", "'x' AS n_turns", "1 AS mask", "2 AS valid", "'f' AS formatted")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert got[1].loss_chars == LONG and got[1].loss_sha256 == hashlib.sha256(("é" * LONG).encode()).hexdigest() and got[2].n_turns == 2
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns[:2]).encode()).hexdigest()


def test_searches_leave_out_what_is_no_vector(spark):
    odd = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (5, None), (6, [None, 1.0]), (2, [2.0, 1.0]), (None, [9.0, 9.0]), (7, [])]
    df = spark.createDataFrame(odd, "vec_id long, vector array<double>").selectExpr("*", "1 AS id", "'q' AS v", "3 AS score", "4 AS rank")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in maxscore.top_k(spark, df, df.where("vec_id IN (1, 3, 5)")).collect())
    assert got == [(1, 1, 2, 4), (1, 2, 2, 4), (1, 3, 7, 0)]


def test_vectors_of_zeros_and_repeated_ids(spark):
    odd = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, [0.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (6, None), (7, [math.nan, 0.0, 1.0]), (8, [1e-160, 0.0, 0.0])]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "'x' AS x", "2 AS copies", "3 AS t")
    got = sorted((r.vec_id, r.component_id, r.kept) for r in vectors.near_duplicates(spark, df).collect())
    alone = [(3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 7, True)]
    assert [g for g in got if g[0] in (3, 4, 5, 6, 7)] == alone and [g[:2] for g in got if g[0] in (1, 2)] == [(1, 1), (2, 1), (2, 1)] and len(got) == 9


@pytest.mark.parametrize("rows", [[], [(None, None, None, None), (5, "", "en", "s"), (5, "", "en", "s"), (6, "word " * 300, None, "s"), (7, "one two", "en", None)]])
def test_stages_of_empty_tables_and_nulls(spark, docs_dir, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, docs_dir)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), docs.schema)
        assert len(rows) or not docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, docs_dir)
    assert last.count() == docs.count() and {"doc_id", "n_tokens"} <= set(last.columns)
