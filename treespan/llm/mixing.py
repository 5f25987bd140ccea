"""Mixing sources to target weights by Sainte-Lague apportionment.

The words a mix takes are dealt in equal blocks: highest quotients ``target / (2 k + 1)`` first,
once among the sources and once among the shards of each source. A shard is a seeded hash bucket
of its source's documents, so no task ever holds a whole source; its documents, in seeded order,
form a ring of words of which the quota is taken from a seeded block on. A document is thus taken
floor or ceil of quota / ring size times over, words of a block that begins inside it counted.

Everything is DataFrame expressions. A source of any share is spread over its shards; only sums
per source and per shard meet in windows over sources or shards.

Defined results: a null or empty text has size 0 and takes nothing; null sources are one source,
ordered last; a source of size 0 has target 0; equal rows are separate documents; null ids are
hashed as empty text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, written

WORD = r"[^\x20\x09-\x0D]+"
SHARD_DOCS, SHARDS = 200, 100_000  # documents a shard holds at least; shards there are at most, about
BROADCAST_SOURCES = 10_000  # rows of the table of sources, 50 bytes each, up to which it is broadcast


def sainte_lague(df: DataFrame, weight: str, seats: str, tie: str, within: str | None = None) -> DataFrame:
    """``df`` with ``seats_won``: ``seats`` (a number that is the same in all rows of a group) dealt by highest quotients.

    All but about two quotients a row are settled in closed form: with the divisor
    sum / (seats - rows / 2) rounding deals no seat too many, with sum / (seats + rows / 2) none too few.
    Only the quotients between the two are ranked; ties go to the smaller ``tie``. Without
    ``within``, the rows are one group.
    """
    key = [F.col(within)] if within else [F.lit(1)]
    w = Window.partitionBy(*key)
    half, total = F.count("*").over(w) / 2.0, F.sum(weight).over(w)
    rounded = lambda d: F.floor(F.col(weight) / d + 0.5)
    least = F.when((F.col(seats) > half) & (total > 0), rounded(total / (F.col(seats) - half))).otherwise(F.lit(0).cast("long"))
    most = F.when(total > 0, rounded(total / (F.col(seats) + half))).otherwise(F.lit(0).cast("long"))
    base = df.withColumn("_least", least).withColumn("_most", F.greatest(most, F.col("_least"))).withColumn("_left", F.col(seats) - F.sum("_least").over(w))
    open_ = base.where("_most > _least").select(*([within] if within else []), tie, "_left", weight, F.explode(F.sequence("_least", F.col("_most") - 1)).alias("_k"))
    won = (
        open_.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(F.col(weight) / (2 * F.col("_k") + 1)), tie)))
        .where("_nth <= _left")
        .groupBy(*([within] if within else []), tie)
        .agg(F.count("*").alias("_more"))
    )
    out = base.join(won, [within, tie] if within else [tie], "left")
    return out.withColumn("seats_won", F.col("_least") + F.coalesce("_more", F.lit(0))).drop("_least", "_most", "_left", "_more")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``sources`` (source, size, docs) with ``src`` (rank, from 0), and ``target``.

    By weight, but no target above ``cap`` times its source; what that leaves is shared again by
    weight, until none is above: targets are min(cap * size, level * weight) at the one level
    that spends ``share`` of all sizes.
    """
    pick = F.array(*[F.lit(float(x)) for x in weights])
    out = sources.withColumn("src", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    out = out.withColumn("weight", F.element_at(pick, (F.col("src") % len(weights) + 1).cast("int"))).withColumn("most", F.lit(cap) * F.col("size"))
    by = Window.orderBy(F.col("most") / F.col("weight"), "src")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spent, used = F.coalesce(F.sum("most").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    out = out.withColumn("level", (F.lit(share) * F.sum("size").over(all_) - spent) / (F.sum("weight").over(all_) - used))
    level = F.min(F.when(F.col("most") / F.col("weight") >= F.col("level"), F.struct(F.col("most") / F.col("weight"), "src", "level"))).over(all_)["level"]
    return out.withColumn("target", F.least("most", F.coalesce(level, F.max("level").over(all_)) * F.col("weight"))).drop("level", "most", "weight")


def _hash(seed: int, value: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), value).cast("binary"))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    block: int = 8,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``id_col``, ``size``, ``source_size``, ``target`` (the source's), ``taken`` (words the mix takes of the document, repeats counted).

    weights: of the sources by code point, repeating; share: words of the mix by all words;
    cap: words taken of a source, and of a document, by its own; block: words dealt together.
    keep: columns of ``docs`` that are returned too.
    """
    size = F.coalesce(F.regexp_count(col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    source = docs.select(col(id_col).alias("_id"), col(source_col).cast("string").alias("source"), size.alias("size"), *[col(c).alias(f"_keep{i}") for i, c in enumerate(keep)])
    sized = written(source, "sizes")
    per_source = written(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")), "sources")
    known = targets(per_source, weights, share, cap)
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = known.withColumn("blocks", F.round(F.sum("target").over(all_) / block).cast("long"))
    known = known.withColumn("shards", F.ceil(F.col("docs") / F.greatest(F.lit(SHARD_DOCS), F.ceil(F.sum("docs").over(all_) / SHARDS))))
    known = written(sainte_lague(known, "target", "blocks", "src").select("src", F.col("source").alias("_source"), F.col("size").alias("source_size"), "target", "shards", F.col("seats_won").alias("quota")), "quotas")
    few = known.count() <= BROADCAST_SOURCES
    digest = _hash(seed, F.coalesce(F.col("_id").cast("string"), F.lit("")))
    dealt = (
        sized.join(F.broadcast(known) if few else known, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_order", digest)
        .withColumn("shard", F.pmod(_number(F.col("_order")), F.col("shards")))
        .drop("source", "_source", "shards")
    )
    rings = dealt.groupBy("src", "shard", "quota").agg(F.sum("size").alias("ring")).withColumn("quota", F.col("quota").cast("double"))
    rings = sainte_lague(rings, "ring", "quota", "shard", within="src").select(
        F.col("src").alias("_src"), F.col("shard").alias("_shard"), "ring", F.least(F.col("seats_won") * block, (F.lit(cap) * F.col("ring")).cast("long")).alias("take")
    )
    start = F.lit(block) * F.pmod(_number(_hash(seed, F.concat_ws(":", "src", "shard"))), F.ceil(F.col("ring") / block))
    w = Window.partitionBy("src", "shard").orderBy("_order", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("_at", F.coalesce(F.sum("size").over(w), F.lit(0))).join(rings, (F.col("src") == F.col("_src")) & (F.col("shard") == F.col("_shard")), "left")
    rounds = lambda y: (F.floor(y / F.col("ring")) * F.col("size") + F.least(F.greatest(F.pmod(y, F.col("ring")) - F.col("_at"), F.lit(0)), F.col("size")))
    taken = F.when(F.col("ring") > 0, rounds(start + F.col("take")) - rounds(start)).otherwise(0).cast("long")
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)])


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """All columns of ``docs``, each document as many times as the mix takes it, a half up; texts without a word once.

    Rows of one id are taken alike, by their sums.
    """
    taken = mix(docs, id_col=id_col, **options).groupBy(col(id_col).alias("_id")).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    copies, times, mark = fresh(docs, "id"), fresh(docs, "times"), fresh(docs, "copy")
    taken = taken.select(F.col("_id").alias(copies), F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int").alias(times)).where(F.col(times) > 0)
    out = docs.join(taken, col(id_col).eqNullSafe(F.col(copies))).withColumn(mark, F.explode(F.array_repeat(F.lit(0), F.col(times))))
    return out.select(*[col(c) for c in docs.columns])


#: The same in DuckDB's SQL, with the default parameters.
SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                      md5('17:' || coalesce(doc_id::VARCHAR, '')) AS ord FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS size, count(*) AS docs FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM per),
weighed AS (SELECT *, ([5.0, 2.0, 1.0])[(src % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * size AS most FROM ranked),
levels AS (SELECT *, (1.5::DOUBLE * sum(size) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lev
           FROM weighed WINDOW b AS (ORDER BY most / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT coalesce(arg_min(lev, (most / weight, src)) FILTER (most / weight >= lev), max(lev)) AS lev FROM levels),
tar AS (SELECT src, source, size, docs, least(most, lev.lev * weight) AS target FROM levels, lev),
tot AS (SELECT *, round(sum(target) OVER () / 8)::BIGINT AS blocks, count(*) OVER () / 2.0::DOUBLE AS half, sum(target) OVER () AS total,
               ceil(docs / greatest(200, ceil(sum(docs) OVER () / 100000)))::BIGINT AS shards FROM tar),
lim AS (SELECT *, CASE WHEN blocks > half AND total > 0 THEN floor(target / (total / (blocks - half)) + 0.5) ELSE 0 END::BIGINT AS lo,
               CASE WHEN total > 0 THEN floor(target / (total / (blocks + half)) + 0.5) ELSE 0 END::BIGINT AS hi FROM tot),
cand AS (SELECT src, k, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, src) AS nth FROM (SELECT src, target, unnest(range(lo, greatest(lo, hi))) AS k FROM lim)),
quotas AS (SELECT l.*, lo + (SELECT count(*) FROM cand c WHERE c.src = l.src AND nth <= l.blocks - (SELECT sum(lo) FROM lim)) AS quota FROM lim l),
dealt AS (SELECT s.doc_id, s.size, s.ord, q.src, q.size AS source_size, q.target, q.quota, (('0x' || substr(s.ord, 1, 15))::BIGINT % q.shards) AS shard
          FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source),
ring0 AS (SELECT src, shard, quota, sum(size)::BIGINT AS ring FROM dealt GROUP BY ALL),
ring1 AS (SELECT *, count(*) OVER p / 2.0::DOUBLE AS half, sum(ring) OVER p AS total FROM ring0 WINDOW p AS (PARTITION BY src)),
ring2 AS (SELECT *, CASE WHEN quota > half AND total > 0 THEN floor(ring / (total / (quota::DOUBLE - half)) + 0.5) ELSE 0 END::BIGINT AS lo,
                 CASE WHEN total > 0 THEN floor(ring / (total / (quota::DOUBLE + half)) + 0.5) ELSE 0 END::BIGINT AS hi FROM ring1),
ring3 AS (SELECT *, quota - sum(lo) OVER (PARTITION BY src) AS remain FROM ring2),
cand2 AS (SELECT src, shard, remain, row_number() OVER (PARTITION BY src ORDER BY ring / (2 * k + 1) DESC, shard) AS nth
          FROM (SELECT src, shard, remain, ring, unnest(range(lo, greatest(lo, hi))) AS k FROM ring3)),
won2 AS (SELECT src, shard, count(*) AS more FROM cand2 WHERE nth <= remain GROUP BY ALL),
rings AS (SELECT r.src, r.shard, r.ring, least((lo + coalesce(more, 0)) * 8, 2 * ring)::BIGINT AS take,
                 CASE WHEN ring > 0 THEN 8 * (('0x' || substr(md5('17:' || r.src || ':' || r.shard), 1, 15))::BIGINT % ceil(ring / 8.0)::BIGINT) END AS a
          FROM ring3 r LEFT JOIN won2 w USING (src, shard)),
placed AS (SELECT d.*, ring, a, a + take AS b, coalesce(sum(d.size) OVER (PARTITION BY src, shard ORDER BY ord, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p0
           FROM dealt d JOIN rings USING (src, shard))
SELECT doc_id, size, source_size, target,
       CASE WHEN ring > 0 THEN (b // ring * size + least(greatest(b % ring - p0, 0), size)) - (a // ring * size + least(greatest(a % ring - p0, 0), size)) ELSE 0 END::BIGINT AS taken
FROM placed
"""
