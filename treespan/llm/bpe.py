"""Byte-level BPE: encoding to ids and decoding to bytes.

Text is cut by the tokenizer's pattern; only the *distinct* words of a batch are encoded, by
folding ranked merges over their byte arrays with the rank map; ids of the documents are then
gathered from those of their words. Decoding concatenates the binary pieces of the ids.

The fold runs on Arrow batches (see the README: the same fold in Spark's higher-order functions
evaluates a rank look-up as a scan of the literal map). All words of one byte length are a
matrix, and one step merges the leftmost lowest-ranked pair of every row.

Defined results: null text counts as empty; empty text gives no ids and empty bytes; repeated
rows are encoded each; null ids stay null; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import col, map_arrow, small_batches

NONE = np.int32(2**31 - 1)
LONG = 48  # bytes from which a word is folded with a heap instead of in a matrix
SLICE_BYTES = 4 << 20  # text that is held as words at a time
_SPACES = r"\t\n\x{0b}\x{0c}\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts with white space at an end, or in which a space touches other white space: they aren't cut at their spaces.
_UNEVEN = rf"^[{_SPACES}]|[{_SPACES}]$|[{_SPACES}] | [{_SPACES}]"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The rank map of a ``.tiktoken`` file's content."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Codec:
    """A rank map and pattern, with the tables that the fold looks pairs up in."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        top = max(ranks.values()) + 1
        pieces: list[bytes] = [b""] * top
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.pieces = pa.array(pieces, pa.binary())
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(a << 32 | b, rank) for piece, rank in ranks.items() for i in range(1, len(piece)) if (a := ranks.get(piece[:i])) is not None and (b := ranks.get(piece[i:])) is not None]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.merged = np.array([r for _, r in pairs] or [NONE], np.int32)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id into which each pair merges, which is its rank, or NONE."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def fold_equal(self, words: list[bytes]) -> list[np.ndarray] | tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, as a padded matrix and the number of ids of each row."""
        n, size = len(words), len(words[0])
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)].reshape(n, size)
        if size == 1:
            return ids, np.ones(n, np.int64)
        ids = np.hstack([ids, np.full((n, 1), -1, np.int32)])
        ranks = np.hstack([self.pair_ranks(ids[:, :-2].ravel(), ids[:, 1:-1].ravel()).reshape(n, size - 1), np.full((n, 1), NONE, np.int32)])
        lens, live, cols = np.full(n, size, np.int64), np.arange(n), np.arange(size)
        while True:
            here = ranks[live].argmin(axis=1)
            best = ranks[live, here]
            go = best != NONE
            live, here, best = live[go], here[go], best[go]
            if not len(live):
                return ids[:, :-1], lens
            rows, shift = ids[live], (cols[None, :] + (cols[None, :] > here[:, None])).astype(np.intp)
            rows[np.arange(len(live)), here] = best
            rows[:, :-1] = np.take_along_axis(rows, np.minimum(shift, size), axis=1)
            rows[:, -1] = -1
            near = np.take_along_axis(ranks[live], np.minimum(shift, size - 1), axis=1)
            line = np.arange(len(live))
            right = rows[line, here + 1]
            near[line, here] = np.where(right >= 0, self.pair_ranks(best, right), NONE)
            left = np.maximum(here - 1, 0)
            near[line, left] = np.where(here > 0, self.pair_ranks(rows[line, left], best), near[line, left])
            near[:, -1] = NONE
            ids[live], ranks[live] = rows, near
            lens[live] -= 1

    def fold_long(self, word: bytes) -> np.ndarray:
        """Ids of one word, with a heap of its pairs: for very long words."""
        ids: list[int] = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n, find = len(ids), dict(zip(self.keys.tolist(), self.merged.tolist(), strict=True)) if not hasattr(self, "_find") else self._find
        self._find = find
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := find.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (q := find.get(r << 32 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (q, i, r, ids[after[i]]))
            if (p := before[i]) >= 0 and (q := find.get(ids[p] << 32 | r)) is not None:
                heapq.heappush(heap, (q, p, ids[p], r))
        return np.array([x for x in ids if x >= 0], np.int32)

    def fold(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has."""
        data = [w.encode() for w in words]
        lens = np.zeros(len(data), np.int64)
        whole = np.array([self.ranks.get(w, -1) for w in data], np.int32)
        groups: dict[int, list[int]] = {}
        for i in np.flatnonzero(whole < 0).tolist():
            groups.setdefault(len(data[i]), []).append(i)
        lens[whole >= 0] = 1
        done = []
        for size, rows in groups.items():
            if size >= LONG:
                for i in rows:
                    ids = self.fold_long(data[i])
                    lens[i] = len(ids)
                    done.append((np.array([i]), ids[None, :], lens[i : i + 1].copy()))
            elif size:
                ids, n = self.fold_equal([data[i] for i in rows])
                lens[rows] = n
                done.append((np.array(rows), ids, n))
        starts = np.cumsum(lens) - lens
        out = np.empty(int(lens.sum()), np.int32)
        out[starts[whole >= 0]] = whole[whole >= 0]
        for rows, ids, n in done:
            keep = np.arange(ids.shape[1])[None, :] < n[:, None]
            out[(starts[rows][:, None] + np.arange(ids.shape[1])[None, :])[keep]] = ids[keep]
        return out, lens

    def words(self, chunks: list[str], others: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """The words of all chunks, then of all other texts, as indices into the distinct words; those words; how many each has.

        Chunks neither begin nor end with white space but for one leading space, so the
        pattern leaves a vertical tab between two of them alone and all are cut in one go.
        """
        tab = "\x0b"
        joined = tab.join(chunks)
        if joined.count(tab) == max(0, len(chunks) - 1):
            found = self.pattern.findall(joined)
        else:
            each = [self.pattern.findall(chunk) for chunk in chunks]
            found, counts, tab = [w for ws in each for w in ws], [len(ws) for ws in each], None
        rest = [self.pattern.findall(x) for x in others]
        n = len(found)
        coded = pa.array(found + [w for ws in rest for w in ws], pa.large_string()).dictionary_encode()
        index, words = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()
        if tab is not None:
            here = np.zeros(len(index), bool)
            if tab in words:
                here[:n] = index[:n] == words.index(tab)
            if int(here.sum()) != max(0, len(chunks) - 1):
                raise AssertionError("the pattern joined a separator to a chunk")
            counts = np.diff(np.concatenate([[-1], np.flatnonzero(here), [n]])) - 1 if chunks else []
            index = index[~here]
        return index, words, np.concatenate([np.asarray(counts, np.int64), np.array([len(ws) for ws in rest], np.int64)])

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text (no nulls), a text a list."""
        n = len(texts)
        uneven = np.array(pc.match_substring_regex(texts, _UNEVEN)) | np.array(pc.equal(texts, ""))
        even = np.flatnonzero(~uneven)
        parts = pc.split_pattern(texts.take(pa.array(even)), " ")
        sizes = np.diff(np.asarray(parts.offsets)).astype(np.int64)
        flat = parts.flatten().dictionary_encode()
        codes, first = np.array(flat.indices), np.cumsum(sizes) - sizes
        rest = np.ones(len(codes), bool)
        rest[first] = False
        # A word after a space is another chunk than the same word at the start.
        used, codes[rest] = np.unique(codes[rest], return_inverse=True)
        used1, codes1 = np.unique(codes[first], return_inverse=True)
        chunks = [" " + x for x in flat.dictionary.take(pa.array(used)).to_pylist()]
        codes[first] = codes1 + len(chunks)
        chunks += flat.dictionary.take(pa.array(used1)).to_pylist()
        base = len(chunks)
        odd = np.flatnonzero(uneven)
        index, words, counts = self.words(chunks, texts.take(pa.array(odd)).to_pylist())
        ids, lens = self.fold(words)
        starts = np.cumsum(lens) - lens
        # From the documents' chunks to their words to their ids.
        per_doc = np.ones(n, np.int64)
        per_doc[even] = sizes
        order = np.empty(int(per_doc.sum()), np.int64)
        at = np.cumsum(per_doc) - per_doc
        order[ragged(at[even], sizes)] = codes
        order[at[odd]] = base + np.arange(len(odd))
        of = index[ragged((np.cumsum(counts) - counts)[order], counts[order])]
        out = ids[ragged(starts[of], lens[of])]
        ends = np.concatenate([[0], np.cumsum(lens[of])])
        doc_words = np.concatenate([[0], np.cumsum(counts[order])])[np.concatenate([[0], np.cumsum(per_doc)])]
        return pa.ListArray.from_arrays(pa.array(ends[doc_words], pa.int32()), pa.array(out, pa.int32()))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids; an id outside the vocabulary gives null."""
        flat = ids.flatten()
        values = np.asarray(flat.fill_null(-1))
        good = (values >= 0) & (values < len(self.pieces))
        pieces = self.pieces.take(pa.array(np.where(good, values, 0), mask=~good))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(ids).fill_null(0)))]), pa.int32()), pieces)
        return pc.if_else(ids.is_valid(), pc.binary_join(lists, b""), None)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (lens[0] of them), then those of the next."""
    ends = np.cumsum(lens)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


@functools.lru_cache(maxsize=4)
def codec(data: bytes, pattern: str) -> Codec:
    return Codec(read_ranks(data), pattern)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` bytes of text, one row at least."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)) if len(texts) else []
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, stop
        at = stop


def encode(df: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``id_col``, ``ids`` array<int> and, if asked for, ``decoded`` binary (the ids' bytes).

    ranks: the content of the rank file. Nothing is shuffled.
    """
    source = df.select(col(id_col), col(text_col).cast("string").alias("text"))
    kind = source.schema[0].dataType.simpleString()
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary, about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            for a, b in slices(texts):
                ids = own.encode(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids, *([own.decode(ids)] if decoded else [])], names)

    names = [id_col, "ids", *(["decoded"] if decoded else [])]
    quoted = "`" + id_col.replace("`", "``") + "`"
    return source.mapInArrow(run, f"{quoted} {kind}, ids array<int>" + ", decoded binary" * decoded)


def decode(df: DataFrame, ranks: bytes, pattern: str, ids_col: str = "ids") -> DataFrame:
    """All columns of ``df`` and ``decoded`` binary: the concatenated pieces of ``ids_col``; null if the ids are null or one is unknown."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, own.decode(batch.column(at))], [*batch.schema.names, "decoded"])

    return map_arrow(df, run, T.StructType([T.StructField("decoded", T.BinaryType())]))
