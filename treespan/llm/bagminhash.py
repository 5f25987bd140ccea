"""Near-duplicate documents by BagMinHash signatures of their five-word shingles.

Similarity is the weighted Jaccard of shingle multisets: sum of smaller counts by sum of larger
ones, 0.8 or more; words are lower-cased and split at white space.

* Signature: for a shingle with count c, weights are discretised at the integers and split into
  the dyadic intervals [0, 1), [1, 2), [2, 4), ...; each interval carries a Poisson process whose
  rate is its length, seeded by the shingle and the interval, whose points have a component and a
  place in the interval. Points beyond c don't count; component k keeps its earliest point. Points
  come in increasing order, so a process ends at the document's latest component: about
  n + m ln m points a document. Two signatures agree in a component with probability equal to
  the weighted Jaccard.
* The dyadic intervals stand side by side (a flat list, not a tree that is split further).
* Equal texts are collapsed first. Components give two kinds of buckets: BANDS of ROWS components,
  and as many that hold half of the next band too, which large groups of near copies fall apart in.
  Each bucket's members are paired with one of them, its lead, chosen by a hash, so a bucket gives
  fewer pairs than it has members. Pairs are verified on the multisets themselves.
* ROUNDS - 1 times more, each bucket whose members are still in different classes pairs one member a
  class, drawn anew, with one of them. No pair is emitted for two members neither of which leads, so
  a group in which few are alike gives pairs in proportion to its size, not to its square.
* What the buckets and leads leave out is found exactly. In one order of all shingles, frequent ones
  last as far as counts in SLOTS slots over a SHARE of the texts tell, two texts that are alike have
  their first common shingle within the first fifth of both (by weight), whatever the order. Each text lists that prefix; a shingle in the prefixes
  of texts of different classes is open. Members of open shingles with FEW members at most are
  paired and verified; of others, blocks of members meet in a worker that counts what all of them
  share and gives only links between classes, so no row is made for a pair that isn't alike.
* Classes are the connected components of the verified links: those of all pairs of texts.

Defined results: null text counts as empty; a text of one to four words is one shingle of all of
them; texts without a word are only alike if equal; rows of one id are judged each by its own text; a
null id is not compared and is its own class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, forget, fresh, small_batches, written
from .graph import components
from .words import coded, slices

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, ROUNDS = 32, 8, 3
M = BANDS * ROWS
SLICE = 4 << 20
AT_ONCE = 20_000  # points drawn at once
BROADCAST_BYTES = 16 << 20  # of ids up to which they are broadcast
SHARE, SLOTS = 8, 1 << 22  # of the texts that put the shingles in order, and the slots these are counted in
FEW, BLOCK, BLOCK_SHINGLES = 32, 1024, 1 << 19  # members paired as rows; of a block, and their shingles
RARE, COLUMNS = 8, 2048  # texts of a block up to which a shingle's pairs are counted one by one; shingles of a matrix product
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each distinct shingle of each text, by row and hash."""
    codes, sizes, distinct = coded(texts)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    word = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], _U)[codes]
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(codes))  # words from here to the text's end
    h = np.full(len(codes), 0x9E3779B97F4A7C15, _U)
    for k in range(SHINGLE):
        here = np.zeros(len(codes), _U)
        here[: max(0, len(codes) - k)] = word[k:]
        h = mix64(h * _U(0x9E3779B97F4A7C15) + np.where(left > k, here, _U(0)))
    keep = left >= np.minimum(SHINGLE, np.repeat(sizes, sizes))
    rows, h = np.repeat(np.arange(len(sizes)), sizes)[keep], h[keep]
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])]))
    return rows[first], h[first], np.diff(np.concatenate([first, [len(rows)]]))


def signatures(rows: np.ndarray, h: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """The times of the earliest points, a row a text and M columns; infinite for texts without shingles."""
    sig = np.full((n, M), np.inf)
    flat = sig.reshape(-1)
    top = 1 + (np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) if len(count) else count)
    which = np.repeat(np.arange(len(rows)), top)
    level = np.arange(len(which)) - np.repeat(np.cumsum(top) - top, top)
    base = np.where(level > 0, 2.0 ** (level - 1), 0.0)  # the interval is [base, base + rate)
    rate = np.maximum(base, 1.0)
    seed = mix64(h[which] + mix64(level.astype(_U) + _U(0x1234567)))
    row, most, t = rows[which], count[which].astype(float), np.zeros(len(which))
    latest = np.zeros(n)
    step = 0
    while len(row):
        # The next points of each live process, several at once when few are left: later ones change nothing.
        steps = np.arange(step + 1, step + 1 + (1 if len(row) > AT_ONCE else -(-AT_ONCE // len(row))))[: max(1, 4 * M)]
        step = int(steps[-1])
        odd = _U(0x9E3779B97F4A7C15) * (_U(2) * steps.astype(_U))
        r1 = mix64(seed[:, None] + (odd - _U(0x9E3779B97F4A7C15)))
        r2 = mix64(seed[:, None] + odd)
        gaps = -np.log(((r1 >> _U(11)).astype(float) + 0.5) * 2.0**-53) / (rate * M)[:, None]
        gaps[:, 0] += t
        times = np.cumsum(gaps, axis=1)
        good = base[:, None] + np.floor(((r2 >> _U(11)).astype(float) * 2.0**-53) * rate[:, None]) < most[:, None]
        np.minimum.at(flat, ((row * M)[:, None] + (r2 % _U(M)).astype(np.int64))[good], times[good])
        some = np.unique(row)
        latest[some] = sig[some].max(axis=1)
        t = times[:, -1]
        live = t < latest[row]
        row, most, t, seed, base, rate = row[live], most[live], t[live], seed[live], base[live], rate[live]
    return sig


def banded(sig: np.ndarray) -> np.ndarray:
    """The buckets of each row: by each band, then by each band and the first half of the next."""
    bits = sig.view(_U).reshape(len(sig), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=_U), (len(sig), BANDS)).copy()
    for k in range(ROWS):
        h = mix64(h * _U(0x9E3779B97F4A7C15) + bits[:, :, k])
    more, after = mix64(h + _U(1)), np.roll(bits, -1, axis=1)
    for k in range(ROWS // 2):
        more = mix64(more * _U(0x9E3779B97F4A7C15) + after[:, :, k])
    return np.hstack([h, more]).view(np.int64)


def hashes(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a text; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def usual(docs: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """How many shingles of one in SHARE texts (by the hash of the id) fall in each of SLOTS slots; a shingle's slot is its hash modulo SLOTS."""
    some = docs.where(F.pmod(F.xxhash64(col(id_col)), F.lit(SHARE)) == 0).select(col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            texts = pc.fill_null(batch.column(0).cast(pa.string()), "")
            for a, b in slices(texts, SLICE):
                np.add.at(counts, (shingles(texts.slice(a, b - a))[1] % _U(SLOTS)).astype(np.int64), 1)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64())], ["slot", "n"])

    got = some.mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").select("slot", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int32)
    out[np.asarray(got.column("slot"))] = np.asarray(got.column("n"))
    return out


def prefixes(rows: np.ndarray, h: np.ndarray, count: np.ndarray, n: int, often: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and weight before it of each shingle that may be a text's first common one with a text alike; the weight of each text."""
    size = np.bincount(rows, count, n).astype(np.int64)
    by = np.lexsort((h, often[(h % _U(len(often))).astype(np.int64)], rows))
    rows, h, count = rows[by], h[by], count[by]
    before = np.cumsum(count) - count
    before = before - (np.cumsum(size) - size)[rows]
    keep = before <= (size - np.ceil(threshold * size - 1e-9))[rows]
    return rows[keep], h[keep], before[keep], size


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """``id``, ``h1``, ``h2`` (of the text), ``buckets`` (empty without a word), ``size`` (number of shingles), ``prefix``."""
    h1, h2 = hashes(col(text_col))
    often = docs.sparkSession.sparkContext.broadcast(usual(docs, id_col, text_col))
    source = docs.select(col(id_col).alias("id"), h1.alias("h1"), h2.alias("h2"), col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = pc.fill_null(batch.column(3).cast(pa.string()), "")
            for a, b in slices(all_, SLICE):
                n = b - a
                rows, h, count = shingles(all_.slice(a, n))
                sig = signatures(rows, h, count, n)
                some = np.bincount(rows, minlength=n) > 0
                ends = np.concatenate([[0], np.cumsum(some * 2 * BANDS)])
                buckets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(banded(sig[some]).ravel()))
                row, key, before, size = prefixes(rows, h, count, n, often.value, threshold)
                parts = pa.StructArray.from_arrays([pa.array(key.view(np.int64)), pa.array(before, pa.int32())], ["key", "before"])
                prefix = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), parts)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, n) for i in range(3)), buckets, pa.array(size, pa.int32()), prefix], ["id", "h1", "h2", "buckets", "size", "prefix"])

    return source.mapInArrow(run, f"id {source.schema[0].dataType.simpleString()}, h1 bigint, h2 bigint, buckets array<bigint>, size int, prefix array<struct<key:bigint,before:int>>")


def similarity(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard of the shingles of texts at the same place."""
    n = len(a)
    ra, ha, ca = shingles(a)
    rb, hb, cb = shingles(b)
    rows, h, c = np.concatenate([ra, rb]), np.concatenate([ha, hb]), np.concatenate([ca, cb])
    order = np.lexsort((h, rows))
    rows, h, c = rows[order], h[order], c[order]
    both = np.flatnonzero((rows[1:] == rows[:-1]) & (h[1:] == h[:-1])) if len(rows) else np.zeros(0, np.int64)
    least = np.bincount(rows[both], np.minimum(c[both], c[both + 1]), n)
    total = np.bincount(rows, c, n)
    return least / np.maximum(total - least, 1)


def verified(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` (a, b) whose texts are alike, a written table; ``docs`` are id and text. Only texts of ids in pairs move."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    few = ids.agg(F.sum(F.octet_length(F.col("id").cast("string")) + 16)).first()[0] or 0
    few = few <= BROADCAST_BYTES
    texts = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (pc.fill_null(batch.column(i).cast(pa.string()), "") for i in (2, 3))
            for i, j in slices(x, SLICE // 2):
                keep = pa.array(similarity(x.slice(i, j - i), y.slice(i, j - i)) >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(i, j - i).filter(keep) for k in (0, 1)], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    out = written(both.mapInArrow(run, f"a {kind}, b {kind}"), "links")
    forget(ids)
    return out


def shared_by_all(rows: np.ndarray, h: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """The sum of smaller counts of each two different ones of n texts."""
    each = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)  # a shingle that occurs c times is c different ones
    rows, h = np.repeat(rows, count), np.repeat(h, count)
    _, token, df = np.unique(np.where(each > 0, mix64(h + mix64(each.astype(_U))), h), return_inverse=True, return_counts=True)
    order = np.lexsort((rows, token))
    rows, token = rows[order], token[order]
    first, out = np.cumsum(df) - df, np.zeros(n * n, np.float32)
    rare = np.flatnonzero((df[token] > 1) & (df[token] <= RARE))
    for a in range(0, len(rare), 1 << 18):
        part = rare[a : a + (1 << 18)]
        d = df[token[part]]
        other = rows[np.repeat(first[token[part]] - (np.cumsum(d) - d), d) + np.arange(d.sum())]
        out += np.bincount(np.repeat(rows[part], d) * n + other, minlength=n * n)
    out = out.reshape(n, n)
    usual_ = np.flatnonzero(df > RARE)
    for a in range(0, len(usual_), COLUMNS):
        part = usual_[a : a + COLUMNS]
        d = df[part]
        m = np.zeros((n, len(part)), np.float32)
        m[rows[np.repeat(first[part] - (np.cumsum(d) - d), d) + np.arange(d.sum())], np.repeat(np.arange(len(part)), d)] = 1
        out += m @ m.T
    return out


def joining(texts: pa.Array, classes: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of texts that are alike and join all of ``classes`` (numbers) that any such pair joins; at most one less than classes."""
    rows, h, count = shingles(texts)
    n, label, out = len(texts), classes.copy(), []
    size, both = np.bincount(rows, count, n), shared_by_all(rows, h, count, n)
    for x in range(n):
        alike = np.flatnonzero((both[x] / np.maximum(size[x] + size - both[x], 1) >= threshold) & (label != label[x]))
        for y in alike.tolist():
            if label[y] != label[x]:
                out.append((x, y))
                label[label == label[y]] = label[x]
    return out


def rest(table: DataFrame, exact: DataFrame, known: DataFrame, source: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b), a written table, that join all texts alike that ``known`` (node, component) leaves in different classes."""
    of = exact.join(known.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "rep", F.coalesce("component", "rep").alias("class"))
    each = table.withColumnRenamed("id", "rep").join(of, ["h1", "h2", "rep"]).select("rep", "h1", "class", "size", F.explode("prefix").alias("p"))
    key = Window.partitionBy("key")
    each = each.select("rep", "h1", "class", "size", "p.key", "p.before")
    each = each.select("*", F.min("class").over(key).alias("lo"), F.max("class").over(key).alias("hi"), F.count("*").over(key).alias("n"), F.sum("size").over(key).alias("words"))
    open_ = written(each.where("lo <> hi").drop("lo", "hi"), "open")

    x, y = open_.where(F.col("n") <= FEW).alias("x"), open_.where(F.col("n") <= FEW).alias("y")
    # The first common shingle leaves no more to share than what follows it in both.
    most = F.least(F.col("x.size") - F.col("x.before"), F.col("y.size") - F.col("y.before"))
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.class") < F.col("y.class")) & (most * (1 + threshold) >= threshold * (F.col("x.size") + F.col("y.size")) - 1e-6)
    links = verified(written(x.join(y, met).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct(), "pairs"), source, threshold)

    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("words") / BLOCK_SHINGLES)).cast("int")
    many = open_.where(F.col("n") > FEW).select("key", "rep", "h1", "class", blocks.alias("blocks"), F.pmod(F.xxhash64("rep", "h1"), blocks).cast("int").alias("block"))
    many = many.select("key", "rep", "h1", "class", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))).alias("at"))
    many = many.select("key", "at.i", "at.j", "rep", "h1", "class")
    ids = written(open_.where(F.col("n") > FEW).select("rep").distinct(), "ids")
    few = (ids.agg(F.sum(F.octet_length(F.col("rep").cast("string")) + 16)).first()[0] or 0) <= BROADCAST_BYTES
    texts = source.select(F.col("id").alias("rep"), hashes(F.col("text"))[0].alias("h1"), "text").join(F.broadcast(ids) if few else ids, "rep", "left_semi")
    kind = source.schema["id"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        reps, classes = group.column("rep"), group.column("class").combine_chunks().dictionary_encode()
        texts = pc.fill_null(group.column("text").combine_chunks().cast(pa.string()), "")
        pairs = joining(texts, np.asarray(classes.indices).astype(np.int64), threshold)
        a, b = (pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1))
        return pa.table({"a": reps.take(a), "b": reps.take(b)})

    met = many.join(texts, ["rep", "h1"]).select("key", "i", "j", "rep", "class", "text")
    more = written(met.groupBy("key", "i", "j").applyInArrow(run, f"a {kind}, b {kind}"), "links")
    forget(open_, ids)
    return links.union(more)


def grouped(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and ``h1``, ``h2``, ``rep`` (smallest id), ``group_id`` (of its class) of every text with an id."""
    small_batches(docs.sparkSession)
    source = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    table = written(signed(docs, id_col, text_col, threshold), "signatures")
    some = table.where("id IS NOT NULL")
    exact = written(some.groupBy("h1", "h2").agg(F.min("id").alias("rep")), "exact")
    # Equal texts have equal buckets: those of the row with the smallest id stand for all.
    first = some.select("h1", "h2", F.col("id").alias("rep"), "buckets").join(exact, ["h1", "h2", "rep"], "left_semi").select("rep", F.explode("buckets").alias("bucket"))
    drawn = lambda k: F.min_by("rep", F.xxhash64("rep", F.lit(k)))
    lead = first.groupBy("bucket").agg(drawn(0).alias("lead"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("bucket", "lead")
    shared = written(first.join(lead, "bucket").select("bucket", "rep", "lead"), "buckets")
    pairs = written(shared.where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct(), "pairs")
    links = verified(pairs, source, threshold)
    known = written(components(links), "classes")
    for k in range(1, ROUNDS):
        of = shared.select("bucket", "rep").join(known.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("class"))
        each = written(of.groupBy("bucket", "class").agg(drawn(k).alias("rep")), "drawn")
        lead = each.groupBy("bucket").agg(drawn(k).alias("lead"), F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("bucket", "lead")
        more = each.join(lead, "bucket").where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()
        both = pairs.union(pairs.select("b", "a"))
        more = written(more.join(both, ["a", "b"], "left_anti"), "pairs")
        forget(each)
        found = verified(more, source, threshold)
        if found.isEmpty():
            break
        pairs, links = pairs.union(more), links.union(found)
        known = written(components(links), "classes")
    forget(shared)
    found = rest(table, exact, known, source, threshold)
    if not found.isEmpty():
        known = written(components(links.union(found)), "classes")
    return table, exact.join(known.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "rep", F.coalesce("component", "rep").alias("group_id"))


def classes(docs: DataFrame, threshold: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: ``id_col``, ``group_id`` (smallest id of its text's class), ``kept`` (whether that is its own)."""
    table, group = grouped(docs, threshold, id_col, text_col)
    out = table.where("id IS NOT NULL").select("id", "h1", "h2").join(group, ["h1", "h2"]).select("id", "group_id")
    out = out.union(table.where("id IS NULL").select("id", "id"))
    return out.select(F.col("id").alias(id_col), "group_id", F.col("id").eqNullSafe(F.col("group_id")).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one document of each class: that of the smallest id, and of its texts the one with the smallest hash.

    Rows with a null id stay; of repeated rows of one id and text one stays.
    """
    table, group = grouped(docs, threshold, id_col, text_col)
    names = [fresh(docs, x) for x in ("kept_id", "kept_h1", "kept_h2")]
    stay = group.where("rep = group_id").groupBy("rep").agg(F.min(F.struct("h1", "h2")).alias("h")).select(*[F.col(x).alias(n) for x, n in zip(("rep", "h.h1", "h.h2"), names, strict=True)])
    h1, h2 = hashes(col(text_col))
    out = docs.join(stay, (col(id_col) == F.col(names[0])) & (h1 == F.col(names[1])) & (h2 == F.col(names[2])), "left_semi")
    many = written(table.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias(names[0])), "repeated")
    if not many.isEmpty():
        again = col(id_col) == F.col(names[0])
        out = out.join(many, again, "left_anti").unionByName(out.join(many, again, "left_semi").dropDuplicates([id_col]))
    return out.unionByName(docs.where(col(id_col).isNull()))
