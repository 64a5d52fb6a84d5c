"""BPE encoding and decoding with a word-end vocabulary file (lower case, white space dropped).

A piece's adjacent pairs stand in the leaves of a segment tree, each as (rank, place); the root is the leftmost pair of
the lowest rank. A merge changes three leaves, each in logarithmic time, until the root holds no rank.

Texts are split at white space first: no rule of the vocabulary reaches across it, so what a word becomes is kept in a
bounded table per task. Defined cases: a null or empty text has no tokens and decodes to the empty text; rows that repeat
are encoded each; other columns pass through (``n_tokens``, ``ids`` ... replace columns of their name).
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, normalizers

from .words import gather, portions, word_table

#: Unicode white space as the vocabulary's own patterns have it (without the separators U+001C to U+001F).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: Longer words and pieces are encoded anew each time.
LONGEST_KEPT = 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes stand for themselves, the others for U+0100 and on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PairTree:
    """Ranks of adjacent pairs under a minimum tree. Keys are rank * width + place, so the least key is leftmost too."""

    def __init__(self, keys: list[int], none: int):
        self.none, self.width = none, 1 << max(0, (len(keys) - 1).bit_length())
        self.node = [none] * self.width + keys + [none] * (self.width - len(keys))
        for i in range(self.width - 1, 0, -1):
            left, right = self.node[2 * i], self.node[2 * i + 1]
            self.node[i] = left if left < right else right

    @property
    def root(self) -> int:
        return self.node[1]

    def put(self, place: int, key: int) -> None:
        node, i = self.node, self.width + place
        node[i] = key
        while i > 1:
            i >>= 1
            left, right = node[2 * i], node[2 * i + 1]
            least = left if left < right else right
            if node[i] == least:
                break
            node[i] = least


class Recent(dict):
    """A table in two generations of bounded size: when the young one is full, it becomes the old one, and what is
    looked up in the old one becomes young again. Common keys stay, and memory is bounded."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


Pairs = tuple[tuple[int, str], ...]


@lru_cache(maxsize=1)
def library_differences() -> tuple[Pairs, Pairs]:
    """What the tokenizers library lower-cases, and what it takes for a letter or a number, otherwise than Python's tables,
    which are of another version of Unicode: (code point, its lower case), and (code point, a character of its kind)."""
    points = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    lower: list[tuple[int, str]] = []
    kinds: list[tuple[int, str]] = []
    for at in range(0, len(points), 4096):
        some = points[at : at + 4096]
        text = "\n".join(some)
        told = lambda how: how.normalize_str(text).split("\n")  # noqa: B023, E731
        small = told(normalizers.Lowercase())
        lower += [(ord(c), x) for c, x in zip(some, small, strict=True) if c.replace("Σ", "σ").lower() != x]
        letter, number = (told(normalizers.Replace(Regex(p), "a")) for p in (r"\p{L}", r"\p{N}"))
        for c, x, n, mine in zip(some, letter, number, regex.sub(r"\p{N}", "1", regex.sub(r"\p{L}", "a", text)).split("\n"), strict=True):
            kind = "a" if x == "a" else "1" if n == "a" else c
            if kind != mine:
                kinds.append((ord(c), "!" if kind == c else kind))
    return tuple(lower), tuple(kinds)


def ranges(points: Iterable[int]) -> list[tuple[int, int]]:
    """The runs of neighbours among numbers, first and last of each."""
    out: list[tuple[int, int]] = []
    for c in sorted(points):
        if out and out[-1][1] == c - 1:
            out[-1] = out[-1][0], c
        else:
            out.append((c, c))
    return out


class WordBpe:
    """The vocabulary in a file: ``encode`` to ids, ``decode`` to text, ``word`` for one word without white space."""

    def __init__(self, path: str, differences: tuple[Pairs, Pairs] = ((), ()), most_words: int = 250_000):
        self.lower, self.kinds = map(dict, differences)
        # Ranges, as a class of single code points is walked one by one; ASCII texts don't come to it.
        odd = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges(self.lower.keys() | self.kinds.keys()))
        self.odd = re.compile(f"[{odd}]").search if odd else lambda text: None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.begin = {t[0] for t in self.special}
        self.text = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        # Symbols are ids: a pair is one number, and each rank has the id that its merge makes.
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.ranks = {self.ids[a] << 32 | self.ids[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [self.ids[a + b] for a, b in pairs]
        self.inner = [self.ids[x] for x in byte_letters()]
        self.last = [self.ids[x + self.end] for x in byte_letters()]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = regex.compile(split.replace(r"\s", SPACE))
        self.pieces, self.split = pattern.findall, pattern.finditer
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else lambda t: [t]
        self.words = re.compile(f"[^{SPACE}]+").findall
        self.known = Recent(self.word, most_words)
        self.piece = Recent(self.encode_piece, most_words)

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge until no pair has a rank: the root of the tree says which. The tree is that of ``PairTree``, written
        out here, as it is most of the work."""
        n = len(symbols)
        if n < 2:
            return symbols
        rank, made, none = self.ranks.get, self.made, len(self.made) * n + n
        width = 1 << (n - 2).bit_length()
        level = [none if (r := rank(a << 32 | b)) is None else r * n + i for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))]
        node = level = level + [none] * (width - n + 1)
        while len(level) > 1:
            level = list(map(min, level[::2], level[1::2]))
            node = level + node
        node.insert(0, none)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (top := node[1]) < none:
            r, i = divmod(top, n)
            j = after[i]
            symbols[i] = one = made[r]
            symbols[j] = -1
            after[i] = k = after[j]
            changes = []
            if j < n - 1:
                changes.append((width + j, none))
            if k < n:
                before[k] = i
                r = rank(one << 32 | symbols[k])
                changes.append((width + i, none if r is None else r * n + i))
            else:
                changes.append((width + i, none))
            if (h := before[i]) >= 0:
                r = rank(symbols[h] << 32 | one)
                changes.append((width + h, none if r is None else r * n + h))
            for at, key in changes:
                if node[at] != key:
                    node[at] = key
                    while at > 1:
                        if key > (other := node[at ^ 1]):
                            key = other
                        at >>= 1
                        if node[at] == key:
                            break
                        node[at] = key
        return [s for s in symbols if s >= 0]

    def plain(self, text: str) -> list[int]:
        """Ids of text that holds no special token."""
        if text.isascii():
            return self.joined(self.pieces(text.lower()))
        text = unicodedata.normalize("NFC", text)
        if self.odd(text):
            text = "".join([self.lower[ord(c)] if ord(c) in self.lower else c.replace("Σ", "σ").lower() for c in text])
            # The pattern sees characters of the right kinds; the pieces are those of the text.
            pieces = [text[m.start() : m.end()] for m in self.split(text.translate(self.kinds))]
        else:
            pieces = self.pieces(text.replace("Σ", "σ").lower())
        return self.joined(pieces)

    def joined(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for piece in pieces:
            out += self.piece[piece] if len(piece) <= LONGEST_KEPT else self.encode_piece(piece)
        return out

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        return self.merge(symbols)

    def encode_word(self, word: str) -> list[int]:
        if not any(c in word for c in self.begin):
            return self.plain(word)
        out: list[int] = []
        for part in self.at_special(word):
            out += [self.special[part]] if part in self.special else self.plain(part) if part else []
        return out

    def word(self, word: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the decoded text, of a word without white space."""
        ids = self.encode_word(word)
        return array("I", ids).tobytes(), self.decode(ids)

    def encode(self, text: str | None) -> list[int]:
        return [i for w in self.words(text or "") for i in self.encode_word(w)]

    def decode(self, ids: list[int]) -> str:
        """The tokens' own strings with one space between: the file names no decoder, so nothing else is undone."""
        return " ".join(self.text[i] for i in ids)

    def both(self, text: str | None) -> tuple[bytes, str]:
        known = self.known
        found = [known[w] if len(w) <= LONGEST_KEPT else self.word(w) for w in self.words(text or "")]
        return b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[1]])

    def texts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Buffer]]:
        """Ids and decoded text in UTF-8 of each text; words that the texts share are looked up once."""
        bounds, which, words = word_table(texts)
        known = self.known
        found = [known[w] if len(w) <= LONGEST_KEPT else self.word(w) for w in words]
        ids, ends = gather([f[0] for f in found], which, bounds, np.dtype("<u4"))
        said = pa.array([f[1] or None for f in found], pa.string()).take(pa.array(which))
        if said.null_count:  # words without a token
            bounds = np.concatenate(([0], np.cumsum(said.is_valid().to_numpy(zero_copy_only=False))))[bounds]
            said = said.drop_null()
        decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), said), " ").cast(pa.binary())
        for a, b, one in zip(ends[:-1].tolist(), ends[1:].tolist(), decoded, strict=True):
            yield ids[a:b], one.as_buffer()


@lru_cache(maxsize=1)
def loaded(path: str, differences: tuple[Pairs, Pairs]) -> WordBpe:
    """One vocabulary per Python worker: its tables serve all tasks that the worker runs."""
    return WordBpe(path, differences)


def encode_decode(spark: SparkSession, docs: DataFrame, vocabulary: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, with ``keep_ids``, ``ids`` and ``decoded``.

    ``vocabulary`` is a file on the driver; Spark hands it to the executors. The step has no exchange: a document is
    read, encoded and written by one task, and lost tasks are simply run again.
    """
    spark.sparkContext.addFile(vocabulary)
    name, shared = vocabulary.rsplit("/", 1)[-1], spark.sparkContext.broadcast(library_differences())  # as many as Unicode has
    added = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    added += [("ids", T.ArrayType(T.LongType()), pa.list_(pa.int64())), ("decoded", T.StringType(), pa.string())] * keep_ids
    rest = docs.drop(*[n for n, _, _ in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(SparkFiles.get(name), shared.value)
        for whole in batches:
            for batch in portions(whole, text):
                cols: list[list] = [[] for _ in added]
                for ids, decoded in bpe.texts(batch.column(batch.schema.get_field_index(text))):
                    row = [len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()]
                    row += [ids, str(decoded, "utf-8")] * keep_ids
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, t) for c, (_, _, t) in zip(cols, added, strict=True)]], names=[*batch.schema.names, *[n for n, _, _ in added]])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, *[T.StructField(n, t) for n, t, _ in added]]))


def digests(spark: SparkSession, docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """The document's id, its number of tokens and the two digests, from as few columns as that takes."""
    return encode_decode(spark, docs.select("doc_id", F.col(text).alias("text")), vocabulary).drop("text")
