"""The divergence audit against plain Python and SQL; radix selection against sorting."""

import random
import re
from collections import Counter, defaultdict

import pytest
from test_output import same_as_sql

from wavespark.llm import divergence
from wavespark.llm.common import Scratch

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(docs, least, most):
    """docs: (text, lang, source)."""
    n, there, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]
        n[lang, source].update(terms)
        n[lang, None].update(terms)
        there[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, k in there[lang].items() if k >= least]

        def shares(g, kept=kept):
            total = sum(n[g][t] for t in kept)
            return {t: 1 + 10**9 * (n[g][t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        own, whole = shares((lang, source)), shares((lang, None))
        pairs = [(s, sum(f(own[t], q) for t, q in shares((lang, s)).items())) for l2, s in groups if l2 == lang and s != source]
        terms = [(t, f(own[t], whole[t])) for t in kept if n[lang, source][t] and own[t] > whole[t]]
        for part, rows in (("pair", pairs), ("term", terms)):
            rows.sort(key=lambda r: (-r[1], r[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(rows[: None if part == "pair" else most])]
    return sorted(out)


def test_audit_is_that_of_plain_python(spark):
    rng = random.Random(2)
    words = ["a", "B", "b", "ſ", "É", "é", "日本", "ab1c", "x-y", "\x80z", "😀", "naïve", "ḱ", *[f"w{chr(97 + i)}" for i in range(26)]]
    docs = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "é", None, "z"])) for _ in range(400)]
    docs += [(None, "en", "s9"), ("", "fr", "only"), ("12 .", "xx", "p"), (None, "xx", "q"), ("big " * 20_000, "en", "s2"), *[("same same", "en", "s1")] * 30]
    df = spark.createDataFrame(docs, "text string, lang string, source string").selectExpr("*", "1 AS term", "'x' AS n", "2 AS docs").repartition(6)
    got = sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(spark, df, 4, 5).collect())
    assert got == plain(docs, 4, 5)
    assert divergence.audit(spark, df.limit(0)).count() == 0


def test_counts_do_not_depend_on_when_tables_are_sent(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(" ".join(rng.choices("abcdefghij", k=9)), "en", rng.choice("xyz")) for _ in range(200)]
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(3)
    monkeypatch.setattr(divergence, "HELD", 5)
    got = sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(spark, df, 2, 3).collect())
    assert got == plain(docs, 2, 3)


@pytest.mark.parametrize("few", [0, 3, 1000])
def test_radix_selection_is_that_of_sorting(spark, monkeypatch, few):
    monkeypatch.setattr(divergence, "FEW", few)
    rng = random.Random(few)
    rows = []
    for g in range(12):
        size, top = rng.choice([1, 4, 60, 300]), rng.choice([0, 3, 1500, 2**40])
        items = {"".join(rng.choices(["a", "b", "é", "日", "￿", "😀", "A"], k=rng.choice([0, 1, 3, 9]))) for _ in range(size)}
        rows += [(g, i, rng.randint(0, top)) for i in items]
    rows += [(99, f"prefix{'x' * 50}{i}", 7) for i in range(40)] + [(98, "dup", 1)] * 30 + [(97, None, 3), (97, "a", None), (None, "n", 5)]
    df = spark.createDataFrame(rows, "g int, item string, value long").repartition(4)
    got = sorted((r.g if r.g is not None else -1, r["rank"], r.item, r.value) for r in divergence.top_k(Scratch(spark, "radix"), df, ["g"], "value", "item", 7).where("g IS NOT NULL").collect() if r.item is not None)
    want = []
    for g in {r[0] for r in rows} - {None}:
        mine = sorted((r for r in rows if r[0] == g and r[1] is not None and r[2] is not None), key=lambda r: (-r[2], r[1].encode()))[:7]
        want += [(g, i + 1, r[1], r[2]) for i, r in enumerate(mine)]
    assert [w for w in sorted(want) if w[0] != 97] == [x for x in got if x[0] != 97]


def test_audit_equals_sql(spark):
    same_as_sql(spark, "/root/testdata/sf0.01", "op12_source_audit", ["documents"])
