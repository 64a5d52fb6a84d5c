"""Source divergence audit: how each source's words differ from those of its language and of every other source.

Terms are counted inside tasks, in tables that are sent on when they are full, so what is exchanged is one row per term and
table. A term that enough documents of a language have is kept. With N and V the occurrences and the number of kept terms,
a group gives a term with n occurrences p = 1 + floor(10**9 * (n + 2) / (N + 2V)), and two of them differ by
f = floor((p - q)**2 / (p + q)); all of it is whole numbers.

Two sources are summed over terms that one of them has: a term that a source lacks has its *base* p there, so the sum is V times the f of
both bases, plus corrections. A correction by one source alone depends on the term's count only, so counts are grouped first; the pairs
of sources that have one term are joined.

The largest values of each group are found by radix selection (``top_k``): histograms over ten bits at a time tell where the kth
value lies, ties there are refined by histograms over the bytes of the items, and only what is left is ordered.

Defined cases: null texts, languages and sources are empty texts; repeated rows are documents of their own; a group without
terms has N = 0 and takes part; a language without kept terms has differences of 0; other columns are not read; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Bytes that are part of terms stand for themselves, capitals for small letters, all others for a space. In UTF-8 all
#: characters but ASCII are bytes from 0x80 on.
_BYTES = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
#: Terms in the tables of a task before they are sent on.
HELD = 400_000
SCALE = 1_000_000_000
#: Bits of a value and bytes of an item in one histogram; undecided rows of a group that are simply ordered.
DIGIT, CHUNK, FEW = 10, 2, 1000


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Parts of the counts: ``lang, source, term, n, docs``. A row without a term stands for a group that occurs."""
    empty = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`"), empty).alias(n) for c, n in ((lang, "lang"), (source, "source"))], F.coalesce(F.col(f"`{text}`"), empty).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple[str, str]] = set()
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def sent() -> Iterator[pa.RecordBatch]:
            for (of, by), (n, there) in counts.items():
                terms = list(n)
                for at in range(0, len(terms), 20_000):
                    some = terms[at : at + 20_000]
                    columns = [pa.array([x] * len(some), pa.string()) for x in (of, by)] + [pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some]), pa.array([there[t] for t in some])]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            counts.clear()

        held = 0
        for batch in batches:
            groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for group, data in zip(groups, batch.column(2), strict=True):
                known.add(group)
                terms = data.as_py().translate(_BYTES).split()
                if not terms:
                    continue
                n, there = counts[group]
                held -= len(n)
                n.update(terms)
                there.update(set(terms))
                held += len(n)
                if held >= HELD:
                    yield from sent()
                    held = 0
            if len(known) >= HELD:
                yield _groups(known)
                known.clear()
        yield from sent()
        if known:
            yield _groups(known)

    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _groups(known: set[tuple[str, str]]) -> pa.RecordBatch:
    of, by = (pa.array(c, pa.string()) for c in zip(*known, strict=True))
    zero = pa.array([0] * len(known), pa.int64())
    return pa.RecordBatch.from_arrays([of, by, pa.nulls(len(known), pa.string()), zero, zero], names=["lang", "source", "term", "n", "docs"])


def kept_terms(parts: DataFrame, least: int) -> DataFrame:
    """Kept terms of each group with ``n``, the language's ``lang_n``, and ``first`` on one row of each (language, term); a row
    without a term for each group. One exchange, by language and term, serves the sums and the windows."""
    sums = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    told = sums.withColumns({"lang_n": F.sum("n").over(w), "_docs": F.sum("docs").over(w), "first": F.col("source") == F.min("source").over(w)})
    return told.where(F.col("term").isNull() | (F.col("_docs") >= least)).drop("docs", "_docs")


def share(n: Column, total: Column, terms: Column) -> Column:
    """p, exactly; null where there are no kept terms."""
    scaled = (n.cast("decimal(20,0)") + 2) * F.lit(SCALE).cast("decimal(11,0)")
    return F.when(terms > 0, 1 + F.call_function("div", scaled, (total + 2 * terms).cast("decimal(21,0)")))


def unlike(p: Column, q: Column) -> Column:
    """f; p and q are at most 10**9 + 1, so all fits into 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of every two sources of a language. kept: with ``p``; groups: ``lang, source, total, terms, base``."""
    c = F.col
    own = groups.select("lang", c("source").alias("a"), c("base").alias("a_base"), "terms")
    other = groups.select("lang", c("source").alias("b"), c("base").alias("b_base"))
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    bases = own.join(other, "lang").where("a < b").select("lang", "a", "b", F.coalesce(c("terms") * unlike(c("a_base"), c("b_base")), F.lit(0)).alias("value"))
    # One source's terms against the other's base: they are as many as there are different counts.
    alike = kept.where("term IS NOT NULL").groupBy("lang", c("source").alias("a"), "p").agg(F.count("*").alias("m"))
    single = alike.join(own.drop("terms"), ["lang", "a"]).join(other, "lang").where("a <> b")
    single = single.select("lang", *ends, (c("m") * (unlike(c("p"), c("b_base")) - unlike(c("a_base"), c("b_base")))).alias("value"))
    told = kept.where("term IS NOT NULL").select("lang", "term", "source", "p", "base")
    left = told.select("lang", "term", c("source").alias("a"), c("p").alias("a_p"), c("base").alias("a_base"))
    right = told.select("lang", "term", c("source").alias("b"), c("p").alias("b_p"), c("base").alias("b_base"))
    both = unlike(c("a_p"), c("b_p")) - unlike(c("a_p"), c("b_base")) - unlike(c("a_base"), c("b_p")) + unlike(c("a_base"), c("b_base"))
    common = left.join(right, ["lang", "term"]).where("a < b").select("lang", "a", "b", both.alias("value"))
    sums = bases.unionByName(single).unionByName(common).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(c("a").alias("source"), c("b").alias("item")), F.struct(c("b").alias("source"), c("a").alias("item"))))
    return sums.select("lang", ways.alias("w"), "value").select("lang", "w.source", "w.item", "value")


def top_k(scratch: Scratch, rows: DataFrame, keys: Sequence[str], value: str, item: str, k: int) -> DataFrame:
    """The k rows of the largest values of each group, ties to the smaller item by its UTF-8 bytes, with ``rank`` from 1.

    Values are whole numbers from 0 on (rows without one take no part). No group is ordered as a whole: what is ordered are k rows of it, and
    FEW ties more at most, but where more rows than that repeat one item.
    """
    c, keys = F.col, list(keys)
    rows = scratch.write(rows.where(c(value).isNotNull()))
    bits = max(1, int(rows.agg(F.max(value)).first()[0] or 0).bit_length())
    w = Window.partitionBy(*keys)

    def boundary(counts: DataFrame, by: Column, need: Column) -> DataFrame:
        """The bucket of each group in which its last row lies: the last one with fewer than ``need`` rows before it."""
        before = F.coalesce(F.sum("here").over(w.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        told = counts.withColumn("before", before).where(c("before") < need)
        last = told.withColumn("_last", F.row_number().over(w.orderBy(c("before").desc()))).where("_last = 1")
        return last.select(*keys, "bucket", (need - c("before")).alias("need"), "here")

    state = None
    for shift in range((bits - 1) // DIGIT * DIGIT, -1, -DIGIT):
        bucket = F.shiftright(c(value), shift)
        if state is None:
            counts = rows.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("here")).withColumn("need", F.lit(k).cast("long"))
        else:
            inside = rows.join(state.select(*keys, c("bucket").alias("_high"), "need"), keys).where(F.shiftright(c(value), shift + DIGIT) == c("_high"))
            counts = inside.groupBy(*keys, "need", bucket.alias("bucket")).agg(F.count("*").alias("here"))
        state = scratch.write(boundary(counts, c("bucket").desc(), c("need")))
    least = state.select(*keys, c("bucket").alias("_least"), c("need").alias("_need"), c("here").alias("_here"))
    reached = scratch.write(rows.join(least, keys).where(c(value) >= c("_least")))
    # Ties at the kth value: a prefix of the items' bytes is lengthened until few enough items begin with it.
    item_bytes = c(item).cast("binary")
    tied = reached.where((c(value) == c("_least")) & (c("_here") > c("_need")))
    upto = state.where("here > need").select(*keys, F.lit(b"").alias("_upto"), "need", "here")
    length, found = 0, []
    while not (open_ := scratch.write(upto.where((c("here") > c("need")) & (c("here") > FEW) & (F.octet_length("_upto") == length)))).isEmpty():
        found.append(upto.join(open_.select(*keys), keys, "left_anti"))
        inside = tied.join(open_.drop("here"), keys).where(F.substring(item_bytes, 1, length) == c("_upto"))
        counts = inside.groupBy(*keys, "need", F.substring(item_bytes, 1, length + CHUNK).alias("bucket")).agg(F.count("*").alias("here"))
        upto = scratch.write(boundary(counts, c("bucket"), c("need")).withColumnRenamed("bucket", "_upto"))
        length += CHUNK
    for more in found:
        upto = upto.unionByName(more)
    near = reached.join(upto.select(*keys, "_upto"), keys, "left")
    own = near.where((c(value) > c("_least")) | c("_upto").isNull() | (F.expr(f"substring(CAST(`{item}` AS BINARY), 1, octet_length(_upto))") <= c("_upto")))
    rank = F.row_number().over(w.orderBy(c(value).desc(), c(item)))
    return own.drop("_least", "_need", "_here", "_upto").withColumn("rank", rank).where(c("rank") <= k)


def audit(spark: SparkSession, docs: DataFrame, least_docs: int = 10, most_terms: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has every other source of the language, part ``term`` the
    ``most_terms`` terms that the source has more of than the language, by how unlike they are."""
    scratch, c = Scratch(spark, "divergence"), F.col
    found = scratch.write(kept_terms(count_terms(docs, text, lang, source), least_docs))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = found.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if(c("first") & c("term").isNotNull()).alias("terms"))
    groups = scratch.write(totals.join(langs, "lang").withColumn("base", share(F.lit(0), c("total"), c("terms"))))
    kept = scratch.write(found.where("term IS NOT NULL").join(groups, ["lang", "source"]).select("lang", "source", "term", "base", share(c("n"), c("total"), c("terms")).alias("p"), share(c("lang_n"), c("lang_total"), c("terms")).alias("q")))
    pairs = source_pairs(kept, groups)
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(c("value").desc(), "item")))
    more = kept.where("p > q").select("lang", "source", c("term").alias("item"), unlike(c("p"), c("q")).alias("value"))
    terms = top_k(scratch, more, ["lang", "source"], "value", "item", most_terms)
    names = ["lang", "source", "item", "value", "rank"]
    return ranked.select(*names, F.lit("pair").alias("part")).unionByName(terms.select(*names, F.lit("term").alias("part"))).select("lang", "source", "part", "item", "value", c("rank").cast("int").alias("rank"))
