"""Mixing, chats, vectors, search, pages, licences and quality: brute force, round trips, held-out accuracy, edges."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavespark.llm import chat, licenses, maxscore, mixing, quality, vectors, wrappers


def rows_of(spark, data, schema):
    """With columns more whose names the operators use inside."""
    return spark.createDataFrame(data, schema).selectExpr("*", "1 AS n", "'x' AS mark", "2 AS root", "3 AS size2")


# Mixing


def test_mix_reaches_targets_and_reruns_agree(spark):
    rng = random.Random(1)
    docs = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    df = rows_of(spark, docs, "doc_id long, text string, source string")
    got = mixing.mix(spark, df).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in mixing.mix(spark, df.repartition(7)).collect())
    total = sum(r.size for r in got)
    for s in ("a", "b", "c", None):
        mine = [r for r in got if r.source == s]
        assert sum(r.copies * r.size for r in mine) == pytest.approx(mine[0].target, rel=0.1)
        assert mine[0].target <= 3 * mine[0].source_size + 1e-6 and all(0 <= r.copies <= 3 for r in mine)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(total)
    assert mixing.emit(mixing.mix(spark, df)).count() == sum(r.copies for r in got)


def test_mix_edges(spark):
    df = rows_of(spark, [(None, None, None), (1, "", "a"), (1, "", "a"), (2, "x y", "b")], "doc_id long, text string, source string")
    got = mixing.mix(spark, df).collect()
    assert sorted(r.size for r in got) == [0, 0, 0, 2] and {r.copies for r in got if r.source != "b"} == {0}
    assert mixing.emit(mixing.mix(spark, df)).columns == df.columns
    assert mixing.mix(spark, df.limit(0)).count() == 0


# Chats


def test_chat_round_trip(spark):
    rng = random.Random(2)
    parts = ["<|", "|>", "<|im_end|>", "<|im_start|>", "\n", "\\", "<\\|", "assistant", "é", " ", "a", ""]
    convs = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole\\n"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for c in range(60) for t in range(rng.randint(1, 5))]
    convs += [(None, None, None, None), (7, 0, "user", "x"), (7, 0, "user", "x")]
    df = rows_of(spark, convs, "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in convs}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in convs if r[0] == c), key=key)]
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256("".join(t for r, t in turns if r == "assistant").encode()).hexdigest()
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_chat_order():
    valid = chat.ChatTemplate().valid
    assert valid(["system", "user", "assistant"]) and valid(["user", "assistant", "user", "assistant"])
    assert not valid(["assistant"]) and not valid(["user"]) and not valid([]) and not valid(["user", "user", "assistant"])


# Vectors


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base + rng.standard_normal(base.shape) * s for s in (0, 0.1, 0.25, 0.4)] + [np.repeat(base[:1], 30, axis=0)])
    x = np.concatenate([x, np.zeros((1, 16))]).astype(np.float32)
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [float("nan")] + [1.0] * 15), (902, [1.0, None] + [1.0] * 14), (903, [1.0, 2.0])]
    df = rows_of(spark, data, "vec_id long, embedding array<float>")
    n = np.linalg.norm(x.astype(np.float64), axis=1)
    unit = x.astype(np.float64) / np.maximum(n, 1e-300)[:, None]
    like = (unit @ unit.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    low = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min([low[i], *low[like[i]]]) for i in range(len(x))])
        if (new == low).all():
            break
        low = new
    got = {r.vec_id: r for r in vectors.near_duplicates(spark, df).collect()}
    near_limit = (np.abs(unit @ unit.T - 0.95) < 1e-9).any()
    assert not near_limit
    assert {i: (got[i].n_links, got[i].component_id) for i in range(len(x))} == {i: (int(like[i].sum()), int(low[i])) for i in range(len(x))}
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (900, 901, 902, 903))
    assert vectors.near_duplicates(spark, df.limit(0)).count() == 0


def test_estimate_bounds_hold():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = vectors.Codes(32, 8, 3)
    code, factor = codes.code(x)
    estimate = code @ (x @ codes.turn).T / factor[:, None]
    true = x @ x.T
    assert (vectors.bounds(estimate, factor[:, None], 32, 6.0) >= true - 1e-9).all()
    off = ~np.eye(300, dtype=bool)
    assert abs((estimate - true)[off].mean()) < 0.01


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    data = [(i, v) for i, v in enumerate(rng.integers(-50, 50, (400, 12)).tolist())] + [(50, [1] * 12), (1000, None), (1001, [1, None] + [0] * 10), (None, [1] * 12), (1050, [3, 4])]
    df = rows_of(spark, data, "vec_id long, vector array<long>")
    got = maxscore.top_k(spark, df, df.where("vec_id % 50 = 0"))
    fit = [(i, v + [0] * (12 - len(v))) for i, v in data if i is not None and v is not None and None not in v]
    queries: dict[int, list[int]] = {}
    for i, v in fit:
        if i % 50 == 0:
            queries[i] = min(queries.get(i, v), v)
    want = []
    for q, v in queries.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in fit if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == sorted(want)
    assert maxscore.top_k(spark, df.limit(0), df.limit(0)).count() == 0


# Pages


def page(title, blocks, extra=""):
    body = "".join(f"<p>{b}</p>" for b in blocks)
    return f"<html><head><title>{title}</title><style>p {{}}</style></head><body><nav><ul><li>Home</li><li>News</li></ul></nav>{extra}<article><h1>{title}</h1>{body}</article><div class='comments'><p>first!</p></div><footer>c 2020</footer><script>var a = '<p>no</p>';</script></body></html>"


def test_main_text(spark):
    rng = random.Random(7)
    data, want = [], {}
    for i in range(40):
        blocks = [f"Block {i} {k} &amp; more" for k in range(rng.randint(1, 6))]
        extra = "<aside>Buy now</aside>" if rng.random() < 0.5 else ""
        data.append((i, f"http://h{i % 3}.org/{i}", page(f"Title  {i}", blocks, extra)))
        want[i] = " ".join([f"Title {i}", *[b.replace("&amp;", "&") for b in blocks]])
    data += [(100, None, None), (101, "nonsense", ""), (102, "http://h0.org/x", "plain &lt;text&gt;"), (103, None, page("T", ["x"]))]
    got = {r.page_id: r for r in wrappers.extract(spark, rows_of(spark, data, "page_id long, url string, html string")).collect()}
    assert {i: got[i].text for i in want} == want
    assert got[100].text == "" and got[101].text == "" and got[102].text == "plain <text>" and got[103].text == "T x"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert wrappers.extract(spark, spark.createDataFrame(data[:1], "page_id long, url string, html string").limit(0)).count() == 0


# Licences and quality


def test_licences(spark):
    odd = "He has no driver's license and needs permission to travel."
    data = [(1, "Some text.\nReleased under the MIT License.\nMore."), (2, odd), (3, None), (4, ""), (5, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (5, odd), (6, "a " * 50_000 + "\nLicensed under CC BY 4.0.")]
    df = rows_of(spark, data, "doc_id long, text string")
    got = sorted((r.doc_id, r.licences) for r in licenses.scan(spark, df).collect())
    assert got == [(1, ["MIT"]), (2, []), (3, []), (4, []), (5, []), (5, ["Apache-2.0", "CC-BY-NC-4.0"]), (6, ["CC-BY-4.0"])]


def test_quality_held_out(spark, docs_dir):
    """Trained on half of the labels, right on most of the other half."""
    big = docs_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    scored = quality.classify(spark, docs, labels.where(half), keep_text=False)
    test = scored.join(labels.where(~half).select("doc_id", "quality"), "doc_id").select("kept", "quality").collect()
    right = sum(r.kept == (r.quality >= 0.5) for r in test) / len(test)
    assert len(test) > 20 and right >= 0.9, right


def test_licences_are_told_by_the_model(spark):
    """Paragraphs without any of the usual words, hard ones with all of them, and a family against a like one."""
    lines = [
        ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute", ["Unlicense"]),
        ("PERMISSION TO USE, COPY, MODIFY, AND/OR DISTRIBUTE THIS SOFTWARE FOR ANY PURPOSE WITH OR WITHOUT FEE IS HEREBY GRANTED, PROVIDED THAT THE ABOVE COPYRIGHT NOTICE AND THIS PERMISSION NOTICE APPEAR IN ALL COPIES.", ["ISC"]),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0"]),
        ("The copyright license of the software comes with no warranty and needs permission as is.", []),
        ("Permission was granted to the city, free of charge, to deal with the public notice in the Mozilla park.", []),
    ]
    rows = [(i, t, 1) for i, (t, _) in enumerate(lines)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, licences int")
    got = sorted((r.doc_id, r.licences) for r in licenses.scan(spark, docs).collect())
    assert got == sorted((i, want) for i, (_, want) in enumerate(lines) for _ in range(2))
    none = licenses.scan(spark, docs.limit(0))
    assert none.count() == 0 and none.columns == ["doc_id", "text", "licences", "n_licence_paragraphs", "licence_score"]


def by_hand(docs, labels, soft=0.05):
    """The posteriors with plain sums: (id, text, source, lang) and {id: label} to {id: (evidence, site, score)}."""
    rows = [(i, (s, g), np.array(quality.measures(t), np.float32).astype(float)) for i, t, s, g in docs]
    known = [(x, labels[i]) for i, _, x in rows if i in labels]
    w = np.array(quality.fit(np.array([x for x, _ in known]), np.array([float(v) for _, v in known])))
    evidence = {i: 1 / (1 + math.exp(-(x @ w[:-1] + w[-1]))) for i, _, x in rows}
    own = {i: (1.0, float(labels[i])) if i in labels else (soft, evidence[i]) for i, _, _ in rows}
    site = {i: s for i, s, _ in rows}

    def sums(key):
        out = {}
        for i, (n, v) in own.items():
            old = out.get(key(i), (0.0, 0.0))
            out[key(i)] = (old[0] + n, old[1] + n * v)
        return out

    def strength(groups):
        spread, chance = sum(n * (k / n - m) ** 2 for n, k, m in groups), sum(m * (1 - m) for _, _, m in groups)
        extra = (spread - chance) / (chance / len(groups) * (sum(n for n, _, _ in groups) - len(groups)))
        return min(1e4, max(1.0, 1 / extra - 1 if extra > 0 else 1e4))

    paths, hosts, (all_n, all_k) = sums(lambda i: site[i]), sums(lambda i: site[i][0]), sums(lambda i: 0)[0]
    rate = all_k / all_n
    s0 = strength([(n, k, rate) for n, k in hosts.values()])
    s1 = strength([(n, k, (hosts[h][1] + s0 * rate) / (hosts[h][0] + s0)) for (h, _), (n, k) in paths.items()])
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    out = {}
    for i, (n, v) in own.items():
        h = (hosts[site[i][0]][1] - n * v + s0 * rate) / (hosts[site[i][0]][0] - n + s0)
        s = (paths[site[i]][1] - n * v + s1 * h) / (paths[site[i]][0] - n + s1)
        out[i] = evidence[i], s, 1 / (1 + math.exp(-(logit(evidence[i]) + logit(s) - logit(rate))))
    return out


def test_quality_equals_plain_sums(spark):
    rng = random.Random(8)
    docs, labels = [], {}
    for i in range(400):
        source, lang = rng.choice(["a", "a", "b", "c", None]), rng.choice(["en", "de", None])
        good = rng.random() < {"a": 0.9, "b": 0.5, "c": 0.2, None: 0.6}[source]
        text = " ".join(rng.choice(["tree", "House", "water", "seen", "Found"]) + str(rng.randint(0, 40)) for _ in range(rng.randint(5, 60))) if good or rng.random() < 0.1 else "BUY | NOW ! " * rng.randint(1, 30)
        docs.append((i, text, source, lang))
        if rng.random() < 0.4:
            labels[i] = int(good)
    frame = rows_of(spark, docs, "doc_id long, text string, source string, lang string")
    got = quality.classify(spark, frame, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()
    truth = by_hand(docs, labels)
    assert len(got) == len(docs)
    for r in got:
        assert (r.evidence, r.site, r.quality_score) == pytest.approx(truth[r.doc_id], abs=1e-6) and r.kept == (r.quality_score >= 0.5)


def test_quality_sample_is_bounded(spark):
    base = spark.range(3000).selectExpr("id", f"transform(sequence(1, {quality.MEASURES}), x -> cast((id % 7) * x / 50 AS float)) AS measures", "cast(id % 7 > 3 AS double) AS label")
    least = sorted(r.h for r in base.select(F.xxhash64("id").alias("h")).collect())[:200]
    seen = []
    fit, quality.fit = quality.fit, lambda x, y: seen.append(len(y)) or fit(x, y)
    try:
        assert quality.train(base, 200) is not None and seen == [200] and least[-1] < least[0] + 2**64
    finally:
        quality.fit = fit


def test_quality_edges(spark):
    docs = rows_of(spark, [(None, None, None, None), (1, "", "s", "l"), (1, "x", "s", None), (2, "y " * 20_000, None, "l")], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.kept for r in quality.classify(spark, docs, none).collect()] == [True] * 4
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality.classify(spark, docs, labels)
    assert set(docs.columns) <= set(got.columns) and got.count() == 4 and all(0 <= r.quality_score <= 1 and not math.isnan(r.quality_score) for r in got.collect())
    assert quality.classify(spark, docs.limit(0), labels).count() == 0


def test_what_all_pages_share_is_template(spark):
    """Rules of tags and classes alone would keep the greeting and the signature of a host; its wrapper tells them apart."""
    body = lambda i: f"<p>Story {i} goes on for some words.</p>"
    pages = [(i, "http://a.org/x", f"<div class=q7>Welcome to our house</div><div class=z1>{body(i)}</div>") for i in range(12)]
    pages += [(20 + i, "http://b.org/x", f"<article>{body(i)}<p class=sig>Written by the team</p></article>") for i in range(12)]
    pages += [(40 + i, "http://c.org/x", f"<article><p>The very same story on every page.</p><p class=no>{i}</p></article>") for i in range(12)]
    pages += [(60 + i, "http://d.org/x", f"<div class=q7>Welcome</div><div class=z1>{body(i)}</div>") for i in range(3)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract(spark, df).collect()}
    assert all(got[i] == f"Story {i} goes on for some words." == got[20 + i] for i in range(12))
    assert all(got[40 + i] == f"The very same story on every page. {i}" for i in range(12)) and got[60] == "Welcome Story 0 goes on for some words."
    assert wrappers.main_text(pages[0][2], None) == "Welcome to our house Story 0 goes on for some words."


def test_slots_are_judged_over_all_pages_of_their_host(spark):
    """Where tags and words say nothing the wrapper alone tells template from text, however long what repeats is; what a part of the pages
    share stays, and a page that its wrapper can't read is read by its own places."""
    row = lambda k: "".join(f"<td><b>{k} {j}</b></td><td>x{j}{k}</td>" for j in range(9))  # noqa: E731 - a group of 18 tokens and more
    body = lambda i: f"<div class=q>Our house</div><table>{''.join(f'<tr>{row(f'{i}{k}')}</tr>' for k in range(i % 4 + 1))}</table><div class=z>Bye now</div>"
    pages = [(i, "http://a.org/x", body(i)) for i in range(20)]
    lead = "<p class=lead>The same lead on some.</p>"
    pages += [(100 + i, "http://b.org/x", f"<article>{lead if i < 8 else ''}<p>Story {i} is told here at length.</p></article>") for i in range(100)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS slot", "'h' AS host", "2 AS wrapper")
    got = {r.page_id: r.text for r in wrappers.extract(spark, df).collect()}
    plain = lambda i: " ".join(f"{i}{k} {j} x{j}{i}{k}" for k in range(i % 4 + 1) for j in range(9))
    assert all(got[i] == plain(i) for i in range(20))
    assert all(wrappers.main_text(h, None) == f"Our house {plain(i)} Bye now" for i, _, h in pages[:20])  # without its wrapper a page keeps both
    assert all(got[100 + i] == ("The same lead on some. " if i < 8 else "") + f"Story {i} is told here at length." for i in range(100))
    shapes = [wrappers.fold([s for s, _ in wrappers.tokens(h) if s]) for _, _, h in pages[1:4]]
    assert shapes[0] == shapes[1] == shapes[2]  # rows fold to one group, whatever their length
    assert wrappers.fold(["a"] * 3) == [["+", ["a"]]] and len(wrappers.fold([f"<x{i}" for i in range(30_000)])) == 30_000
    long_page = "<p>word</p>" * 30_000
    assert wrappers.extract(spark, spark.createDataFrame([(1, "http://c.org", long_page), (1, "http://c.org", long_page)], df.select("page_id", "url", "html").schema)).first().n_chars == 5 * 30_000 - 1


def test_classes_that_stand_in_for_each_other():
    """An advert on one page where another has its body, a notice against a promo before the article: neither hides the rest."""
    page = lambda one, two, n: f"<html><body><div class='{one}'><p>{one} {n}</p></div><article><div class='{two}'><p>first {n}</p></div><p>last {n}</p></article></body></html>"
    pages = [page("notice", "ad", 1), page("promo", "body", 2)]
    left, right = [wrappers.fold([s for s, _ in wrappers.tokens(p) if s]) for p in pages]
    wrapper = json.dumps(wrappers.align(left, right))
    assert [wrappers.main_text(p, wrapper) for p in pages] == ["last 1", "first 2 last 2"]


def test_wrapper_matches_in_linear_time():
    nodes = [["+", [["?", ["a"]], ["?", ["a"]], ["+", ["a"]]]]] * 6 + ["b"]
    automaton = wrappers.Automaton(nodes)
    assert automaton.matches(["a"] * 3000 + ["b"]) and not automaton.matches(["a"] * 3000) and not automaton.matches(["a"] * 5 + ["b"])
    assert wrappers.Automaton([["?", ["a"]]]).matches([]) and not automaton.matches([])
