"""Words of Arrow batches as codes into the batch's distinct words, for the operators that fit a model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices as slices
from .common import col

#: What is stripped off a word's ends.
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’…–—¡¿"


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes of the words of all texts one after another, the number of words of each text, the distinct words (lower-cased, split at white space)."""
    parts = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    flat = parts.flatten().dictionary_encode()
    codes, distinct = np.asarray(flat.indices).astype(np.int64), flat.dictionary.to_pylist()
    sizes = np.diff(np.asarray(parts.offsets)).astype(np.int64)
    if "" in distinct:  # white space at an end gives an empty word
        keep = codes != distinct.index("")
        of = np.repeat(np.arange(len(sizes)), sizes)[keep]
        codes, sizes = codes[keep], np.bincount(of, minlength=len(sizes))
    return codes, sizes, distinct


def counted(codes: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code below ``width`` (others are left out) and count of each distinct pair, by row and code."""
    rows, keep = np.repeat(np.arange(len(sizes)), sizes), (codes >= 0) & (codes < width)
    key, n = np.unique(rows[keep] * width + codes[keep], return_counts=True)
    return key // width, key % width, n


def sample(labels: DataFrame, label: str, most: int, fold: tuple[int, int, bool], id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` labelled ids, those with the smallest hash: a sample that any run draws alike.

    fold: (modulus, remainder, equal): rows may be learned from if crc32(id) % modulus equals the
    remainder, or doesn't. Of several labels of one id the largest counts; null labels and ids don't.
    """
    m, r, equal = fold
    rest = F.crc32(col(id_col).cast("string").cast("binary")) % m
    rows = labels.where(col(label).isNotNull() & col(id_col).isNotNull() & ((rest == r) if equal else (rest != r)))
    rows = rows.groupBy(col(id_col).alias("_id")).agg(F.max(col(label)).cast("double").alias("_label"))
    return rows.orderBy(F.xxhash64("_id"), "_id").limit(most)


def labelled(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of the sampled ids; ``chosen`` is a sample of bounded size, so it is broadcast and no text moves."""
    return docs.select(col(id_col).alias("_id"), col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "_id")
