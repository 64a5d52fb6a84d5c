"""Token ids of all documents in binary files, entropy-coded, in the order of the documents' ids.

Documents are dealt by ranges of their ids, sorted, and encoded by the tokenizers library inside tasks. Whole documents
fill a block up to BLOCK tokens, and blocks stand in a table. One aggregation over all blocks makes the frequencies that
all files share, and each task writes its blocks (``rans``) one behind the other into a file of its own.

A file can't be read wrongly without a word: a block carries a checksum and the number of its tokens, and ends in a known
state. The table ``manifest`` in the folder has a row per block: file, offset, length, and the number of tokens before it,
so any block is read alone. A task that dies leaves a file that no row of the manifest names; those are swept away.

A block, little endian: ``magic, tokens u64, documents u64, stretches u64, words u64, crc32 of all the rest u32``; ids of the documents
(i64), whether each is there (u8), their numbers of tokens (u64); per stretch (every ``rans.STRETCH`` tokens a checkpoint) its
number of words (u32) and the lanes' states (u64); words (u32).

Defined cases: a null or empty text is the end token alone; null ids come first; documents of one id stand in the order of a hash
of their texts, then of the texts; a longer document than a block is a block of its own; other columns are not written; no
documents make an empty manifest.
"""

from __future__ import annotations

import os
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .common import Scratch
from .words import gather, portions

#: Tokens in a block, at least (the last document is whole), and in the blocks that are coded side by side.
BLOCK, TOGETHER = 65_536, 4_000_000
#: Tokens that a reading task takes, about.
READ = 1 << 26
MAGIC = b"tokblok1"
HEAD, CRC = struct.Struct("<8s4Q"), struct.Struct("<I")
BLOCKS = "part long, block long, doc_ids array<long>, lengths array<long>, ids binary"
MANIFEST = "part long, block long, path string, offset long, length long, tokens long, documents long"
READ_BACK = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Parts of words that a worker remembers the ids of, in each of two generations: KNOWN_PARTS of small letters alone, KNOWN others. Longer
#: ones are encoded anew each time.
KNOWN, KNOWN_PARTS, LONGEST = 150_000, 500_000, 64
#: Documents whose words are looked up together, and bytes of their texts.
ROWS, BYTES = 1024, 1 << 23
#: Parts of small letters that are encoded in one text.
JOINED = 256
#: Marks that a word is taken apart at, beside letters and digits.
MARKS = ".,;:!?*&#%$@()[]{}/\\+-=_~^\"`<>"
_LETTER, _UPPER, _MARK, _SPACE, _WIDE = 1, 2, 4, 8, 16
_KINDS = bytes(
    _WIDE if b > 127 else _LETTER * c.isalnum() | _UPPER * c.isupper() | _MARK * (c in MARKS) | _SPACE * (c in " \t\n\v\f\r") for b, c in enumerate(map(chr, range(256)))
)
_small = re.compile("[a-zß-öø-ÿ]+").fullmatch


def part_table(texts: pa.Array, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """As ``word_table``, but of words in parts that are encoded apart, in small letters where that changes no id.

    The vocabularies' patterns never join a letter or digit to what is none, so words are cut between those and marks (an apostrophe is
    none: it may take letters with it). A capital composes neither with ASCII nor with U+00C0 to U+00FF. Where a special
    token may stand nothing is cut or changed."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = bytes(memoryview(texts.buffers()[2] or b"")[at[0] : at[-1]])
    at = at - at[0]
    chars, kinds = np.frombuffer(data, np.uint8), np.frombuffer(data.translate(_KINDS), np.uint8)
    letter, upper, mark, space = ((kinds & k) != 0 for k in (_LETTER, _UPPER, _MARK, _SPACE))
    before = letter[:-1] & mark[1:] | mark[:-1] & letter[1:]
    accents = np.flatnonzero(chars == 0xC3) + 1  # letters of two bytes, U+00C0 to U+00FF but for two signs; the first half are capitals
    last = chars[accents]
    accents, last = (a[(last != 0x97) & (last != 0xB7)] for a in (accents, last))
    before[accents[accents < len(before)]] |= mark[1:][accents[accents < len(before)]]
    upper[accents[last < 0x9F]] = True
    upper[:-1] &= (kinds[1:] != _WIDE) | (chars[1:] == 0xC3)
    free = np.ones(len(chars), bool)
    for token in special:
        begins = chars == token[0]
        if len(token) > 1:
            begins[:-1] &= chars[1:] == token[1]
        begins = np.flatnonzero(begins)
        for k in range(len(token) if len(begins) else 0):
            free[np.minimum(begins + k, len(chars) - 1)] = False
    upper &= free
    before &= free[1:]
    start = np.ones(len(chars), bool)
    start[1:] = before | space[:-1]
    start[at[at < len(chars)]] = True
    kept, there = (chars + (upper.view(np.uint8) << 5))[~space], start[~space]
    offsets = np.append(np.flatnonzero(there), len(kept))
    coded = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(kept)).dictionary_encode()
    bounds = np.searchsorted(np.flatnonzero(start & ~space), at)
    return bounds, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


class Known:
    """The ids of words, in two generations, which keep those in use."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, words: list[str]) -> list[bytes | None]:
        found = list(map(self.young.get, words))
        for i, f in enumerate(found):
            if f is None and (f := self.old.get(words[i])) is not None:
                found[i] = self.young[words[i]] = f
        return found

    def add(self, words: list[str], ids: list[bytes], most: int) -> None:
        self.young.update((w, f) for w, f in zip(words, ids, strict=True) if len(w) <= LONGEST)
        if len(self.young) >= most:
            self.old, self.young = self.young, {}


class Words:
    """Ids of words by the library, each new part of one once: no rule of these vocabularies reaches across white space.

    Small letters of ASCII and Latin-1 pass the normalizer unchanged and are one piece, so parts of them alone go through the library
    without its normalizer and pattern, many in one text: the ends of words are marked in the vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.library, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for library in (self.library, self.bare):
            library.no_padding()
            library.no_truncation()
        self.bare.normalizer = None
        self.bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.size = self.library.get_vocab_size()
        self.type = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        suffix = self.library.model.end_of_word_suffix
        if not suffix:
            raise ValueError(f"{path} doesn't mark the ends of words")
        self.last = np.zeros(self.size, bool)
        self.last[[i for w, i in self.library.get_vocab(with_added_tokens=False).items() if w.endswith(suffix)]] = True
        self.small, self.others = Known(), Known()

    def of(self, words: list[str]) -> list[bytes]:
        """The ids of different parts of words."""
        found = self.small.find(words)
        small, rest = [], []
        for i, f in enumerate(found):
            if f is None:
                (small if _small(words[i]) else rest).append(i)
        for i, f in zip(rest, self.others.find([words[i] for i in rest]), strict=True):
            found[i] = f
        alone = [i for i in rest if found[i] is None]
        for known, encode, where, most in ((self.small, self.joined, small, KNOWN_PARTS), (self.others, self.alone, alone, KNOWN)):
            new = [words[i] for i in where]
            ids = encode(new)
            known.add(new, ids, most)
            for i, f in zip(where, ids, strict=True):
                found[i] = f
        return found

    def alone(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def joined(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), JOINED):
            ids = np.array(self.bare.encode_batch_fast([" ".join(words[at : at + JOINED])], add_special_tokens=False)[0].ids, self.type)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * ids.itemsize).tolist()
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        if len(out) != len(words):
            raise ValueError("words and the ends of words differ in number")
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of each text's."""
        bounds, which, words = part_table(texts, self.special)
        ids, ends = gather(self.of(words), which, bounds, self.type)
        return ids, np.diff(ends)


@lru_cache(maxsize=1)
def _words(path: str) -> Words:
    return Words(path)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def token_blocks(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int | None = None, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """Blocks of whole documents in the order of their ids; (part, block) is that order."""
    spark.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]
    rows = docs.select(F.col(f"`{id_}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    order = ["doc_id", "mark", "text"]
    dealt = rows.withColumn("mark", F.xxhash64("text")).repartitionByRange("doc_id", "mark").sortWithinPartitions(*order)
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block = _words(SparkFiles.get(name)), 0
        part, doc_ids, lengths, kept, held = None, [], [], [], 0
        for whole in batches:
            for batch in portions(whole, "text", ROWS, BYTES):
                part = batch.column(0)[0].as_py() if part is None else part
                ids, sizes = words.encode(batch.column(2))
                ends = np.cumsum(sizes)
                for doc_id, stop, size in zip(batch.column(1).to_pylist(), ends.tolist(), sizes.tolist(), strict=True):
                    kept.append(ids[stop - size : stop])
                    if end_id is not None:
                        kept.append(np.array([end_id], words.type))
                    doc_ids.append(doc_id)
                    lengths.append(size + (end_id is not None))
                    held += lengths[-1]
                    if held >= BLOCK:
                        yield _table([(part, block, doc_ids, lengths, np.concatenate(kept).tobytes())], schema)
                        block, doc_ids, lengths, kept, held = block + 1, [], [], [], 0
        if doc_ids:
            yield _table([(part, block, doc_ids, lengths, np.concatenate(kept).tobytes())], schema)

    return dealt.select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "text").mapInArrow(run, BLOCKS)


def token_counts(blocks: DataFrame, size: int, kind: str) -> list[int]:
    """How often each id occurs in all blocks; the driver gets as many numbers as the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            for b in batch.column(0):
                sums += np.bincount(np.frombuffer(b.as_buffer(), kind), minlength=size)
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[there])], names=["id", "n"])

    out = [0] * size
    for i, n in blocks.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        out[i] = n
    return out


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def pack(block: rans.Block, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """A block as it stands in a file."""
    tokens, sizes, states, words = block
    there = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    body = b"".join(a.tobytes() for a in (ids, there, np.array(lengths, "<u8"), sizes.astype("<u4"), states.astype("<u8"), words.astype("<u4")))
    head = HEAD.pack(MAGIC, tokens, len(doc_ids), len(sizes), len(words))
    return head + CRC.pack(zlib.crc32(body, zlib.crc32(head))) + body


def unpack(data: bytes) -> tuple[rans.Block, list[int | None], np.ndarray]:
    """The opposite of ``pack``, with its checks."""
    magic, tokens, documents, stretches, words = HEAD.unpack_from(data)
    body = memoryview(data)[HEAD.size + CRC.size :]
    if magic != MAGIC or (zlib.crc32(body, zlib.crc32(data[: HEAD.size])),) != CRC.unpack_from(data, HEAD.size):
        raise ValueError("not a block of tokens, or a damaged one")
    parts, at = [], 0
    for kind, n in (("<i8", documents), ("<u1", documents), ("<u8", documents), ("<u4", stretches), ("<u8", stretches * rans.LANES), ("<u4", words)):
        parts.append(np.frombuffer(body, kind, n, at))
        at += n * np.dtype(kind).itemsize
    ids, there, lengths, sizes, states, coded = parts
    return (tokens, sizes, states.reshape(-1, rans.LANES), coded), [int(i) if t else None for i, t in zip(ids, there, strict=True)], lengths.astype(np.int64)


def write_token_files(spark: SparkSession, docs: DataFrame, vocabulary: str, folder: str, end_id: int | None = None, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """Writes the files, their table of frequencies and the manifest into a new shared folder; returns the manifest.

    Texts are shuffled once, encoded once and written once as blocks of plain ids, which go when the files stand.
    """
    words = _words(vocabulary)
    scratch = Scratch(spark, "tokens")
    blocks = scratch.write(token_blocks(spark, docs, vocabulary, end_id, text, id_))
    kind, size = words.type.str, max(words.size, (end_id or 0) + 1)
    freq = rans.frequencies(token_counts(blocks, size, kind))
    shared = spark.sparkContext.broadcast(freq)  # as long as the vocabulary
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("tokens", pa.int64()), ("documents", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = rans.Tables(shared.value)
        fs, root = _place(folder)
        fs.create_dir(root, recursive=True)
        open_part, out, path, at, waiting, held = None, None, "", 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal open_part, out, path, at, waiting, held
            rows = []
            for row, coded in zip(waiting, tables.encode([np.frombuffer(r["ids"], kind) for r in waiting]), strict=True):
                if row["part"] != open_part:  # files are in order within, and so are their names
                    if out is not None:
                        out.close()
                    open_part, path, at = row["part"], f"part-{row['part']:08d}-{row['block']:08d}-{uuid.uuid4().hex}.tok", 0
                    out = fs.open_output_stream(posixpath.join(root, path))
                data = pack(coded, row["doc_ids"], row["lengths"])
                out.write(data)
                rows.append((row["part"], row["block"], path, at, len(data), coded[0], len(row["doc_ids"])))
                at += len(data)
            waiting, held = [], 0
            if rows:
                yield _table(rows, schema)

        try:
            for batch in batches:
                for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                    waiting.append(row)
                    held += sum(row["lengths"])
                    if held >= TOGETHER:
                        yield from flush()
            yield from flush()
        finally:
            if out is not None:
                out.close()

    fs, root = _place(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(posixpath.join(root, "frequencies")) as f:
        f.write(freq.astype("<u4").tobytes())
    blocks.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    scratch.drop(blocks)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    _sweep(folder, {r.path for r in manifest.select("path").distinct().collect()})
    return manifest


def _sweep(folder: str, named: set[str]) -> None:
    """Removes what tasks left that were lost or run twice; there are as many names as there were tasks."""
    fs, root = _place(folder)
    for info in fs.get_file_info(pafs.FileSelector(root)):
        if re.search(r"\.tok$", info.base_name) and info.base_name not in named:
            fs.delete_file(info.path)


def read_token_files(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """The documents in the files: ``doc_id``, ``start`` (tokens of all documents before it), ``n_tokens``, ``ids_crc32`` (of the ids as
    little-endian unsigned 32-bit integers) and, with ``keep_ids``, ``ids``. Every block is read by its place alone."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = manifest.agg(F.sum("tokens")).first()[0] or 0
    placed = manifest.withColumn("_inside", inside).join(parts.select("part", before.alias("_before")), "part")
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-total // READ))
    dealt = placed.select("path", "offset", "length", "tokens", (F.col("_before") + F.col("_inside")).alias("before")).repartition(tasks)
    fs, root = _place(folder)
    with fs.open_input_stream(posixpath.join(root, "frequencies")) as f:
        shared = spark.sparkContext.broadcast(np.frombuffer(f.read(), "<u4"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = rans.Tables(shared.value)
        fs, root = _place(folder)
        waiting: list[tuple[int, rans.Block, list, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for (before, block, doc_ids, lengths), ids in zip(waiting, tables.decode([w[1] for w in waiting]), strict=True):
                if len(ids) != lengths.sum():
                    raise ValueError("a block holds other numbers of tokens than its documents")
                wide = ids.astype("<u4")
                ends = np.cumsum(lengths)
                own = [wide[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(before + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(o) for o in own], pa.int64())]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(wide.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names=names)
            waiting.clear()

        held = 0
        for batch in batches:
            for path, offset, length, tokens, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(posixpath.join(root, path)) as f:
                    waiting.append((before, *unpack(f.read_at(length, offset))))
                held += tokens
                if held >= TOGETHER:
                    yield from flush()
                    held = 0
        yield from flush()

    return dealt.mapInArrow(run, READ_BACK + ", ids array<long>" * keep_ids)
