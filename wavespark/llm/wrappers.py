"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

1. Every page becomes a stream of tokens (tags with their class words, text slots); repeats are folded to groups.
2. Distinct folded streams per host are counted by Spark, then aligned one after another, in groups of bounded size and
   as many rounds as that takes: what only some pages have becomes optional, what repeats becomes a repeated group, and
   all text becomes slots. The result is one wrapper per host.
3. Each page is read by its host's wrapper, which tells the slot that every text of it fills. Over all pages of the host each
   slot is judged once: left out are slots that always stand in menus, footers, adverts, comments ..., where an article is there those
   outside of it, and those that hold one text on every page of the host (eight at least): that is its template. Where such texts are
   the larger part of all, the pages are copies, and they are content. Tags and class words only say where a slot stands; where one
   page has a slot in an advert and another in its article, each page's own place decides.
4. A page's main text is what fills the slots that are left.

Defined cases: a null or empty page has the empty text; a page whose url is null or has no host belongs to the host
``''``; repeated rows are pages of their own; a page that its wrapper doesn't match (none of those it was made from), or
that fills no such slot, is read by where its own texts stand alone; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg)\b[^>]*+>.*?(?:</\1\s*+>|\Z)|</?[a-zA-Z](?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+>|<[!?][^>]*+>|[^<]++|<", re.S | re.I
)
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSED_BY_BLOCK = frozenset(("p",))
CONTAINERS = frozenset("html body article main section div nav header footer aside form table tr td th ul ol dl blockquote head".split())
MAIN = frozenset(("article", "main"))
#: Elements and class words whose text is never main text.
NEVER = frozenset("head title nav menu footer aside form select option button textarea dialog".split())
NEVER_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar side aside ad ads advert adverts advertisement advertising sponsor sponsored promo notice notices cookie consent alert comment comments disqus respond share social related subscribe newsletter popup modal widget pagination pager".split()
)
PAGE_ONLY = frozenset(("header", "banner", "masthead"))
TEXT = "#"
#: Pages of a host from which on texts that all of them share tell its template.
TEMPLATE_PAGES = 8
#: Streams aligned by one task at once, and tokens of a page up to which repeats are folded (each needs a character).
ALIGNED_AT_ONCE, MOST_FOLDED = 32, 400_000


def tokens(page: str) -> list[tuple[str, str]]:
    """(symbol, text) of a page: symbols ``<tag words``, ``</tag`` or ``#``; blank text has the symbol ``''``."""
    out = []
    for m in TOKEN.finditer(page):
        t = m[0]
        if t[0] != "<" or t == "<":
            out.append((TEXT if t.strip() else "", t))
        elif (name := TAG.match(t)) and not m[1]:
            tag = name[1].lower()
            if t[1] == "/":
                out.append(("</" + tag, ""))
            else:
                words = sorted({re.sub(r"\d+", "0", w) for v in MARKS.findall(t) for w in v.strip("\"'").lower().split()})
                out.append((" ".join(["<" + tag, *words]), ""))
    return out


def tag_of(symbol: str) -> str:
    return symbol.lstrip("</").split(" ", 1)[0]


def fold(symbols: list[str]) -> list:
    """Repeats become groups ``["+", [...]]``, the inner ones first."""
    if len(symbols) > MOST_FOLDED:
        return list(symbols)
    code: dict[str, str] = {}
    nodes: list = []

    def char(key: str, node) -> str:
        if key not in code:
            code[key] = chr(0x4E00 + len(nodes)) if len(nodes) < 20_000 else chr(0x20000 + len(nodes))
            nodes.append(node)
        return code[key]

    by_char = lambda c: nodes[ord(c) - 0x4E00 if ord(c) < 0x20000 else ord(c) - 0x20000]
    text = "".join(char(s, s) for s in symbols)

    def group(m: re.Match) -> str:
        body = [by_char(c) for c in m[1]]
        if len(body) == 1 and isinstance(body[0], list):
            return m[1]
        return char("+" + m[1], ["+", body])

    size = 1
    while size <= len(text) // 2:
        if not _repeated(text, size):
            size += 1
            continue
        folded = _repeats(size).sub(group, text)
        size, text = (size + 1 if folded == text else 1), folded
    return [by_char(c) for c in text]


def _repeated(text: str, size: int) -> bool:
    """Whether so many characters stand twice, one behind the other."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    unlike = np.flatnonzero(codes[size:] != codes[:-size])
    return bool((np.diff(unlike, prepend=-1, append=len(codes) - size) > size).any())


@lru_cache(maxsize=1024)
def _repeats(size: int) -> re.Pattern:
    return re.compile(r"(.{%d})\1+" % size, re.S)


def align(wrapper: list, sample: list) -> list:
    """One wrapper for both: equal parts stay, parts that only one has become optional, single occurrences of a group
    that the other repeats join the group."""
    left, right = _join_groups(wrapper, sample), _join_groups(sample, wrapper)
    left_key, right_key = [json.dumps(_bare(x)) for x in left], [json.dumps(_bare(x)) for x in right]
    out: list = []
    for what, i, j, k, m in SequenceMatcher(None, left_key, right_key, autojunk=False).get_opcodes():
        if what == "equal":
            out += [a if _optional(a) else b for a, b in zip(left[i:j], right[k:m], strict=True)]
        else:
            out += [x if _optional(x) else ["?", [x]] for x in [*left[i:j], *right[k:m]]]
    return out


def _optional(x) -> bool:
    return isinstance(x, list) and x[0] == "?"


def _bare(x):
    return x[1][0] if _optional(x) else x


def _join_groups(seq: list, other: list) -> list:
    for body in sorted((x[1] for x in map(_bare, other) if isinstance(x, list) and x[0] == "+"), key=len, reverse=True):
        out, i = [], 0
        while i < len(seq):
            if seq[i : i + len(body)] == body:
                out.append(["+", body])
                i += len(body)
            else:
                out.append(seq[i])
                i += 1
        seq = out
    return seq


class Place:
    """Where a slot stands: the open elements, kept through tags that were never closed."""

    def __init__(self) -> None:
        self.open: list[tuple[str, bool, bool]] = []  # tag, main, never

    def see(self, symbol: str) -> None:
        tag = tag_of(symbol)
        if symbol.startswith("</"):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == tag:
                    del self.open[i:]
                    break
                if tag not in CONTAINERS and self.open[i][0] in CONTAINERS:
                    break
        elif tag not in VOID:
            if tag not in INLINE and self.open:
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i][0] in CLOSED_BY_BLOCK:
                        del self.open[i:]
                        break
                    if self.open[i][0] in CONTAINERS:
                        break
            words = {w for part in symbol.split(" ")[1:] for w in re.split(r"[^a-z]+", part)}
            main = any(o[1] for o in self.open) or tag in MAIN or "main" in symbol.split(" ")[1:]
            self.open.append((tag, main, tag in NEVER or bool(words & NEVER_WORDS) or not main and (tag in PAGE_ONLY or bool(words & PAGE_ONLY))))

    @property
    def main(self) -> bool:
        return bool(self.open) and any(o[1] for o in self.open)

    @property
    def never(self) -> bool:
        return any(o[2] for o in self.open)


def _flat(nodes: list) -> Iterator[str]:
    for x in nodes:
        if isinstance(x, str):
            yield x
        else:
            yield from _flat(x[1])


def places(symbols: list[str]) -> list[tuple[bool, bool]]:
    """For each text slot in order, whether it stands in an article, and whether in something that is never main text."""
    place, found = Place(), []
    for s in symbols:
        if s == TEXT:
            found.append((place.main, place.never))
        else:
            place.see(s)
    return found


class Automaton:
    """The wrapper as an automaton: sets of positions are bits of a number, and followed only once (a page takes time in
    proportion to its length, whatever the wrapper)."""

    def __init__(self, nodes: list) -> None:
        self.at: dict[str, int] = {}
        self.follow: list[int] = []
        self.first, self.last, self.empty = self._add(nodes)
        self.before = [0] * len(self.follow)
        for p, to in enumerate(self.follow):
            for q in _ones(to):
                self.before[q] |= 1 << p
        self.after: dict[int, int] = {}

    def _add(self, seq: list) -> tuple[int, int, bool]:
        first, last, empty = 0, 0, True
        for x in seq:
            if isinstance(x, str):
                f = end = 1 << len(self.follow)
                self.at[x] = self.at.get(x, 0) | f
                self.follow.append(0)
                skip = False
            else:
                f, end, skip = self._add(x[1])
                if x[0] == "+":
                    self._lead(end, f)
                else:
                    skip = True
            self._lead(last, f)
            first |= f if empty else 0
            last, empty = end | (last if skip else 0), empty and skip
        return first, last, empty

    def _lead(self, start: int, to: int) -> None:
        for p in _ones(start):
            self.follow[p] |= to

    def path(self, symbols: list[str]) -> list[int] | None:
        """The positions of the wrapper that the symbols take, one way through it (the earliest positions from the end on); None if
        there is no way."""
        if not symbols:
            return [] if self.empty else None
        now, sets = self.first, []
        for s in symbols:
            here = now & self.at.get(s, 0)
            if not here:
                return None
            sets.append(here)
            if here not in self.after:
                if len(self.after) >= 10_000:
                    self.after.clear()
                to = 0
                for p in _ones(here):
                    to |= self.follow[p]
                self.after[here] = to
            now = self.after[here]
        here = sets[-1] & self.last
        out = []
        for k in range(len(sets) - 1, -1, -1):
            if not here:
                return None
            p = (here & -here).bit_length() - 1
            out.append(p)
            here = sets[k - 1] & self.before[p] if k else 0
        return out[::-1]

    def matches(self, symbols: list[str]) -> bool:
        return self.path(symbols) is not None


def _ones(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


@lru_cache(maxsize=512)
def matcher(wrapper: str) -> Automaton:
    return Automaton(json.loads(wrapper))


def slots(symbols: list[str], wrapper: str | None) -> list[int] | None:
    """The slot of the wrapper that each text of a page fills; None for a page that it doesn't match."""
    way = matcher(wrapper).path(symbols) if wrapper else None
    return None if way is None else [p for s, p in zip(symbols, way, strict=True) if s == TEXT]


def main_text(page: str | None, wrapper: str | None, kept: dict[int, int] | None = None) -> str:
    """kept: slots of the wrapper that hold main text, with 0, or, where the page's own place decides, 1 (and 2: only within an article). A page
    that fills none of them is read by where its texts stand."""
    toks = tokens(page or "")
    symbols = [s for s, _ in toks if s]
    at = [i for i, s in enumerate(symbols) if s == TEXT]
    filled = slots(symbols, wrapper)
    found = places(symbols)
    picked = []
    if filled and kept:
        how = [kept.get(slot) for slot in filled]
        picked = [i for i, (h, (main, never)) in enumerate(zip(how, found, strict=True)) if h == 0 or h and not never and (main or h == 1)]
    if not picked:
        article = any(m and not n for m, n in found)
        picked = [i for i, (main, never) in enumerate(found) if not never and (main or not article)]
    marked = {at[i] for i in picked}
    blocks, block, i = [], [], -1
    for s, t in toks:
        i += bool(s)
        if not s:
            block.append(t)
        elif s == TEXT and i in marked:
            block.append(t)
        elif s == TEXT or tag_of(s) not in INLINE:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    return " ".join(x for b in blocks if (x := " ".join(entities.unescape(b).split())))


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def infer(spark: SparkSession, pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One wrapper per host: ``(host, wrapper)``. pages: ``url``, ``html``."""
    scratch = scratch or Scratch(spark, "wrappers")

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams: dict[tuple, int] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shape = host, json.dumps(fold([s for s, _ in tokens(page or "") if s]))
                streams[shape] = streams.get(shape, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in streams], pa.string()), pa.array([w for _, w in streams], pa.string()), pa.array(list(streams.values()), pa.int64())], names=["host", "wrapper", "n"])

    told = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(shapes, "host string, wrapper string, n long")
    level = scratch.write(told.groupBy("host", "wrapper").agg(F.sum("n").alias("n")))

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n", "wrapper"], ascending=[False, True])
        out: list | None = None
        for w in group.wrapper:
            out = json.loads(w) if out is None else align(out, json.loads(w))
        return pd.DataFrame({"host": group.host.iloc[:1], "wrapper": json.dumps(out), "n": group.n.sum()})

    while True:
        sizes = level.groupBy("host").agg(F.count("*").alias("of"))
        most = sizes.agg(F.max("of")).first()[0] or 0
        if most <= 1:
            return level.select("host", "wrapper")
        dealt = level.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("of") / (ALIGNED_AT_ONCE / 2)).cast("long")))
        level = scratch.write(dealt.groupBy("host", "part").applyInPandas(merged, "host string, wrapper string, n long"))


def judged(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """``(host, kept, how)``: the slots of each host's wrapper that hold main text, and how (``main_text``). pages: ``host``, ``html``, ``wrapper``."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = lambda text: xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63
        for batch in batches:
            # Of each slot: pages, texts, those in an article, those never main text, characters, least and largest hash. Slot -1: the pages themselves.
            sums: dict[tuple[str, int], list[int]] = {}
            for host, page, wrapper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                toks = [(s, t) for s, t in tokens(page or "") if s]
                symbols = [s for s, _ in toks]
                filled = slots(symbols, wrapper)
                if filled is None:
                    continue
                texts = [" ".join(t.split()) for s, t in toks if s == TEXT]
                own: dict[int, list[int]] = {-1: [1, 0, 0, 0, 0, 0, 0]}
                for slot, (main, never), text in zip(filled, places(symbols), texts, strict=True):
                    h = mark(text)
                    had = own.setdefault(slot, [1, 0, 0, 0, 0, h, h])
                    own[slot] = [1, had[1] + 1, had[2] + main, had[3] + never, had[4] + len(text), min(had[5], h), max(had[6], h)]
                for slot, new in own.items():
                    had = sums.setdefault((host, slot), [0, 0, 0, 0, 0, new[5], new[6]])
                    sums[host, slot] = [*[a + b for a, b in zip(had[:5], new[:5], strict=True)], min(had[5], new[5]), max(had[6], new[6])]
            rows = [(h, s, *v) for (h, s), v in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i else pa.string()) for i in range(9)], names=["host", "slot", "pages", "texts", "main", "never", "chars", "low", "high"])

    c = F.col
    parts = pages.select("host", "html", "wrapper").mapInArrow(told, "host string, slot long, pages long, texts long, main long, never long, chars long, low long, high long")
    sums = scratch.write(parts.groupBy("host", "slot").agg(*[F.sum(n).alias(n) for n in ("pages", "texts", "main", "never", "chars")], F.min("low").alias("low"), F.max("high").alias("high")))
    hosts = sums.where("slot = -1").select("host", c("pages").alias("_all"))
    shared = (c("_all") >= TEMPLATE_PAGES) & (c("pages") == c("_all")) & (c("low") == c("high"))
    rated = sums.where("slot >= 0 AND never < texts").join(hosts, "host").withColumn("_shared", shared)
    has = rated.groupBy("host").agg(F.max(2 * c("main") > c("texts")).alias("_has"))
    inside = rated.join(has, "host").where((c("main") > 0) | ~c("_has"))
    parts_of = inside.groupBy("host").agg((F.sum(F.when(c("_shared"), c("chars")).otherwise(0)) > F.sum(F.when(c("_shared"), 0).otherwise(c("chars")))).alias("_copies"))
    mixed = (c("never") > 0) | c("_has") & (c("main") < c("texts"))
    how = F.when(~mixed, 0).when(c("_has"), 2).otherwise(1)
    left = inside.join(parts_of, "host").where(~c("_shared") | c("_copies"))
    listed = F.sort_array(F.collect_list(F.struct("slot", how.alias("how"))))  # as many as a wrapper has slots
    told_ = left.groupBy("host").agg(listed.alias("k"))
    return scratch.write(told_.select("host", F.transform("k", lambda x: x["slot"]).alias("kept"), F.transform("k", lambda x: x["how"]).alias("how")))


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page."""
    scratch = Scratch(spark, "wrappers")
    pages = pages.select("page_id", "url", "html")
    joined = pages.withColumn("host", host_of(F.col("url"))).join(infer(spark, pages, scratch), "host", "left")
    joined = joined.join(judged(joined, scratch), "host", "left").select("page_id", "url", "html", "wrapper", "kept", "how")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(p, w, dict(zip(k or (), h or (), strict=True))) for p, w, k, h in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4, 5)], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
