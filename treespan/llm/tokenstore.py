"""Token files: ids of each document compressed on its own with a shared zstandard dictionary.

A store is a folder of shard files in ascending id order, and ``dictionary.zdict``, trained on the
serialised id arrays of a bounded sample of documents (SAMPLE of them, up to SAMPLE_BYTES of each:
it only shapes the dictionary, every document is stored whole). A shard file is

    b"TSTOK1\\0" + width (1 byte: bytes of an id) + SHA-256 of the dictionary
    one zstandard frame a document
    index: ids (int64), first byte of each frame and of the index (uint64), ids a document (uint32)
    documents (uint64) + first byte of the index (uint64) + b"TSTOK1\\0"

so one document is read with its index and one short read. A shard's file is named for the task
attempt that wrote it; only names in the manifest, which Spark commits with the job, count, so a
lost or repeated task leaves no wrong file. Token positions need only the manifest: one row a
shard.

Defined results: added tokens (``<|endoftext|>``) in a text are their own ids, as the library does
by default; null text counts as empty and yields just the end id; repeated ids are separate
documents, next to each other; a null id is written as the smallest integer, so it comes first,
and read as null; a table without documents gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import ragged, slices
from .common import col, new_path, small_batches, written

MAGIC, NULL_ID = b"TSTOK1\0", -(2**63)
SAMPLE, SAMPLE_BYTES, DICTIONARY = 2_000, 128 << 10, 64 << 10  # documents the dictionary is trained on at most, the bytes of ids of each; its own bytes
SHARD_BYTES = 128 << 20
SLICE, CHUNKS = 8 << 20, 2_000  # text held as words, and words given to the tokenizer, at a time
KNOWN, KNOWN_BYTES = 600_000, 16 << 20  # words, and their characters, that a worker keeps between batches


@functools.lru_cache(maxsize=2)
def _tokenizer(data: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(data.decode())


def id_width(tokenizer: bytes) -> int:
    return 2 if _tokenizer(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


class Words:
    """The ids of words, kept between batches: up to about KNOWN words, then it begins anew."""

    def __init__(self, tokenizer: bytes):
        self.own = _tokenizer(tokenizer)
        self.added = [x.content for x in self.own.get_added_tokens_decoder().values()]
        #: Which ids end a word: of words of letters, one after another, each has one such id, its last.
        self.final = np.zeros(self.own.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.own.get_vocab(with_added_tokens=False).items():
            self.final[i] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.bytes = 0
        self.ids, self.starts, self.lens = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def put(self, words: list[str], parts: list[np.ndarray], lens: list[np.ndarray]) -> None:
        n = np.concatenate(lens).astype(np.int64)
        self.bytes += sum(map(len, words))
        self.slots.update(zip(words, range(len(self.lens), len(self.lens) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(n) - n])
        self.lens, self.ids = np.concatenate([self.lens, n]), np.concatenate([self.ids, *parts])

    def learn(self, words: list[str]) -> None:
        """Encodes words that aren't known: those of letters many at a time, if their ends can be told."""
        order: list[str] = []
        parts: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        rest = [w for w in words if not _LETTERS.fullmatch(w)]
        plain = [w for w in words if _LETTERS.fullmatch(w)] if rest else words
        for a in range(0, len(plain), CHUNKS):
            some = plain[a : a + CHUNKS]
            ids = np.array(self.own.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) == len(some):
                order += some
                parts.append(ids)
                lens.append(np.diff(np.concatenate([[0], ends])))
            else:
                rest += some
        for a in range(0, len(rest), CHUNKS):
            some = rest[a : a + CHUNKS]
            each = [np.array(e.ids, np.uint32) for e in self.own.encode_batch_fast(some, add_special_tokens=False)]
            order += some
            parts += each
            lens.append(np.array([len(x) for x in each]))
        if order:
            self.put(order, parts, lens)

    def slots_of(self, words: list[str]) -> np.ndarray:
        if len(self.slots) > KNOWN or self.bytes > KNOWN_BYTES:
            self.clear()
        self.learn([w for w in words if w not in self.slots])
        return np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts without added tokens, each with ``end`` after them, and the end of each text's."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        sizes = np.diff(np.asarray(parts.offsets)).astype(np.int64)
        flat = parts.flatten().dictionary_encode()
        # A piece of Latin letters and closing marks is two words for the tokenizer, the first in lower case.
        cut = pc.extract_regex(flat.dictionary, _SIMPLE)
        simple = cut.is_valid()
        heads = pc.if_else(simple, pc.utf8_lower(cut.field("a")), flat.dictionary).dictionary_encode()
        tails = pc.if_else(simple, cut.field("b"), "").dictionary_encode()
        slots = self.slots_of(heads.dictionary.to_pylist() + tails.dictionary.to_pylist())
        # Then the end id and nothing.
        ids, starts, lens = np.append(self.ids, np.uint32(end)), np.append(self.starts, [len(self.ids), 0]), np.append(self.lens, [1, 0])
        none = len(lens) - 1
        head = np.append(slots[: len(heads.dictionary)][np.asarray(heads.indices)], none - 1)
        tail = np.append(slots[len(heads.dictionary) :][np.asarray(tails.indices)], none)
        order = np.full(len(flat) + len(sizes), len(head) - 1, np.int64)  # the last piece of each text is the end id
        order[ragged((np.cumsum(sizes) - sizes) + np.arange(len(sizes)), sizes)] = np.asarray(flat.indices)
        both = np.stack([head[order], tail[order]], axis=1).ravel()
        picked = lens[both]
        some = picked > 0
        ends = np.concatenate([[0], np.cumsum(picked)])[2 * np.cumsum(sizes + 1)] if len(sizes) else np.zeros(0, np.int64)
        return ids[ragged(starts[both[some]], picked[some])], ends


_SIMPLE = "^(?P<a>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<b>[.,!?;:]*)$"
_LETTERS = re.compile("[a-zß-öø-ÿ]{1,64}")
_words = functools.lru_cache(maxsize=2)(Words)


def encoded(texts: pa.Array, tokenizer: bytes, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts (no nulls), each with ``end`` after them, and the end of each text's.

    For tokenizers that drop white space and never join across it: the distinct pieces between
    blanks and line ends are encoded once a batch. Texts with an added token in them, which the
    tokenizer cuts out before all else, are encoded whole.
    """
    own = _words(tokenizer)
    odd = np.zeros(len(texts), bool)
    for token in own.added:
        odd |= np.asarray(pc.match_substring(texts, token))
    if not odd.any():
        return own.encode(texts, end)
    ids, ends = own.encode(texts.filter(pa.array(~odd)), end)
    whole = own.own.encode_batch_fast(texts.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)
    parts = np.empty(len(texts), object)
    for at, part in zip(np.flatnonzero(~odd), np.split(ids, ends[:-1]) if len(ends) else [], strict=True):
        parts[at] = part
    for at, e in zip(np.flatnonzero(odd), whole, strict=True):
        parts[at] = np.array([*e.ids, end], np.uint32)
    return np.concatenate(list(parts)), np.cumsum([len(x) for x in parts])


def _trained(docs: DataFrame, tokenizer: bytes, end: int, width: int) -> bytes:
    """The dictionary of the documents with the smallest hashes; empty if they are too few."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), SLICE):
                ids, ends = encoded(batch.column(0).slice(a, b - a).cast(pa.string()), shared.value, end)
                raw = [x.astype(f"<u{width}").tobytes() for x in np.split(ids, ends[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array([x[:SAMPLE_BYTES] for x in raw], pa.binary())], ["ids"])

    chosen = docs.where("id IS NOT NULL").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    some = docs.join(F.broadcast(chosen), "id", "left_semi").select(F.coalesce("text", F.lit("")).alias("text"))
    samples = sorted(x for x in some.mapInArrow(run, "ids binary").toArrow().column(0).to_pylist() if x)
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _fs(path: str):
    return pafs.FileSystem.from_uri(path)


def write(docs: DataFrame, path: str, tokenizer: bytes, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes a store at ``path`` (a URI that all executors reach) and returns its manifest: shard, file, docs, tokens."""
    spark = docs.sparkSession
    small_batches(spark)
    width = id_width(tokenizer)
    source = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    dictionary = _trained(source, tokenizer, end, width)
    fs, at = _fs(path)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/dictionary.zdict") as f:
        f.write(dictionary)
    shared = spark.sparkContext.broadcast((tokenizer, dictionary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, words = shared.value
        zstd = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words) if words else None, write_dict_id=False)
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            for a, b in slices(texts, SLICE):
                ids, ends = encoded(texts.slice(a, b - a), tok, end)
                raw, bounds = ids.astype(f"<u{width}").tobytes(), [0, *(ends * width).tolist()]
                frames = [zstd.compress(raw[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pc.fill_null(batch.column(0).slice(a, b - a), NULL_ID), pa.array(np.diff(np.concatenate([[0], ends]))), pa.array(frames, pa.binary())], ["id", "n", "frame"])

    frames = written(source.mapInArrow(encode, "id bigint, n bigint, frame binary"), "frames", compression="none")
    total = frames.agg(F.sum(F.length("frame"))).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-total // SHARD_BYTES))
    order = ["id", "n", F.crc32("frame")]  # the latter two deal repeated ids over shards
    dealt = frames.repartitionByRange(shards, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("shard"), "id", "n", "frame")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, ids, lens, sizes, shard = None, [], [], [], 0
        name = f"{at}/shard-{uuid.uuid4().hex}.tok"
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out, shard = _fs(path)[0].open_output_stream(name), batch.column(0)[0].as_py()
                out.write(MAGIC + bytes([width]) + hashlib.sha256(shared.value[1]).digest())
            ids.append(np.asarray(batch.column(1)))
            lens.append(np.asarray(batch.column(2)))
            sizes.append(np.asarray(pc.binary_length(batch.column(3)), dtype=np.int64))
            out.write(b"".join(batch.column(3).to_pylist()))
        if out is None:
            return
        ids_, lens_, sizes_ = (np.concatenate(x) for x in (ids, lens, sizes))
        ends = len(MAGIC) + 33 + np.concatenate([[0], np.cumsum(sizes_)])
        out.write(ids_.astype("<i8").tobytes() + ends.astype("<u8").tobytes() + lens_.astype("<u4").tobytes() + struct.pack("<QQ", len(ids_), int(ends[-1])) + MAGIC)
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([len(ids_)], pa.int64()), pa.array([int(lens_.sum())], pa.int64())], ["shard", "file", "docs", "tokens"])

    return written(dealt.mapInArrow(store, "shard int, file string, docs bigint, tokens bigint"), "manifest")


class Shard:
    """An open shard file."""

    def __init__(self, fs, file: str, dictionary: bytes):
        self.file = fs.open_input_file(file)
        size, tail = self.file.size(), 16 + len(MAGIC)
        n, at = struct.unpack("<QQ", self.file.read_at(tail, size - tail)[:16])
        head = self.file.read_at(len(MAGIC) + 33, 0)
        if head[: len(MAGIC)] != MAGIC or head[len(MAGIC) + 1 :] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{file} isn't a token file of this dictionary")
        index = self.file.read_at(size - tail - at, at)
        self.width = head[len(MAGIC)]
        self.ids = np.frombuffer(index, "<i8", n)
        self.ends = np.frombuffer(index, "<u8", n + 1, 8 * n).astype(np.int64)
        self.lens = np.frombuffer(index, "<u4", n, 16 * n + 8).astype(np.int64)
        self.zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def decoded(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.zstd.decompress(frame), f"<u{self.width}").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, by one short read."""
        return self.decoded(self.file.read_at(int(self.ends[i + 1] - self.ends[i]), int(self.ends[i])))

    def documents(self, most: int = 16 << 20) -> Iterator[np.ndarray]:
        """The ids of all documents in order, read about ``most`` bytes at a time."""
        i = 0
        while i < len(self.ids):
            j = max(i + 1, int(np.searchsorted(self.ends, self.ends[i] + most, side="right")) - 1)
            data = self.file.read_at(int(self.ends[j] - self.ends[i]), int(self.ends[i]))
            for k in range(i, j):
                yield self.decoded(data[int(self.ends[k] - self.ends[i]) : int(self.ends[k + 1] - self.ends[i])])
            i = j


def read(spark: SparkSession, path: str, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids`` of every document of a store, from its files."""
    placed = manifest.withColumn("first", F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.select("file", "first").repartition(max(1, min(10_000, manifest.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _fs(path)
        with fs.open_input_stream(f"{at}/dictionary.zdict") as f:
            dictionary = f.read()
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(fs, file, dictionary)
                starts = first + np.cumsum(shard.lens) - shard.lens
                held: list = []
                size = i = 0

                def out(i: int, held: list) -> pa.RecordBatch:
                    a = i - len(held)
                    ids = [None if x == NULL_ID else x for x in shard.ids[a:i].tolist()]
                    cols = [pa.array(ids, pa.int64()), pa.array(starts[a:i]), pa.array(shard.lens[a:i]), pa.array([x[0] for x in held], pa.int64())]
                    return pa.RecordBatch.from_arrays(cols + ([pa.array([x[1] for x in held], pa.list_(pa.int64()))] if with_ids else []), names)

                for ids in shard.documents():
                    held.append((zlib.crc32(ids.tobytes()), ids if with_ids else None))
                    size, i = size + len(ids), i + 1
                    if size > 2_000_000 or len(held) >= 10_000:
                        yield out(i, held)
                        held, size = [], 0
                if held:
                    yield out(i, held)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)


def round_trip(docs: DataFrame, tokenizer: bytes, end: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Writes a store in the shared folder and reads it back."""
    path = new_path(docs.sparkSession, "tokens")
    return read(docs.sparkSession, path, write(docs, path, tokenizer, end, id_col, text_col), with_ids)
