"""Line dedup by a segment-partition edit join.

Lines that aren't empty (blanks at their ends left out) and are equal, or within t edits of each
other, are one class; of a class the occurrence with the smallest (id, line number) stays. t is
``tau``, or with ``chars`` one edit for each ``chars`` characters of the shorter line and ``tau`` at
most, so lines below ``chars`` characters are one class only if equal. Two lines within t edits
share, at a place that their lengths bound, one of the shorter line's t + 1 segments: each distinct
line lists its segments in an index under (length, segment number, hash), and probes the index of
every length from its own down to ``tau`` less with the substrings at the places that leave few
enough edits on both sides of the match.

Equal lines are collapsed, map side first, before any key is made. A key's rows are joined only
where counts of eight letters allow ``tau`` edits (an edit changes two counts at most), a
condition inside the join. Keys that many lines share, found by counts over a share of the lines,
are joined apart with the texts, and the whole comparison is the join's condition: however many
lines share a segment, it makes no rows but links. Which way a key goes doesn't change the result.
Survivors lose their common prefix and suffix, found by halving, and what differs is verified by a
banded bit-parallel edit distance (Hyyro's band of 2 tau + 2 bits in one long) folded over its
characters. All of it is DataFrame expressions.

Defined results: null text has no lines and stays null; an empty text, and empty lines, stay as
they are; a line repeated within a document is removed after its first place; rows of one id are
one document; rows with a null id take no part and stay; an empty table gives no rows; other
columns are kept by ``dedup`` and ignored by ``decisions``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, forget, fresh, written
from .graph import components

TAU, MIN_CHARS = 1, 1
QUERY_TAU, QUERY_CHARS = 3, 20  # one edit for each 20 characters, 3 at most: of the registered query and the pipeline
LETTERS = "eantorislducmphg"
FREQUENT, SHARE = 64, 8  # lines of a key, counted over one line in SHARE, beyond which texts are compared inside the join
LISTED = 1_000  # frequent keys up to which they are listed in a filter
BROADCAST_LINES = 1_000_000  # hashes of candidate lines, 8 bytes each, up to which they are broadcast


def threshold(length: Column, tau: int, chars: int) -> Column:
    """How many edits a line of ``length`` may be from a longer one."""
    most = F.least(F.lit(tau), F.floor(length / chars).cast("int")) if chars else F.lit(tau)
    return F.when(length > 0, most).otherwise(0)


def segment(length: Column, i: Column, k: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``i`` of the ``k`` of a line, the longer ones last."""
    short, long_ = F.floor(length / k).cast("int"), (length % k).cast("int")
    return short * i + F.greatest(long_ - (k - i), F.lit(0)), short + F.when(i >= k - long_, 1).otherwise(0)


def shifts(i: int, delta: int, tau: int) -> range:
    """How far right of segment ``i`` (from 0) its copy may stand in a line longer by ``delta``: at most i edits before it and tau - i after."""
    return range(max(-i, delta - (tau - i)), min(i, delta + (tau - i)) + 1)


def keys(lines: DataFrame, tau: int, chars: int, probes: bool, also: tuple[str, ...] = ()) -> DataFrame:
    """``no``, ``counts``, ``also`` and each index key, or each probe key, of ``lines``; the places are literals, by how much shorter the other line is and its threshold."""

    def listed(delta: int, place) -> Column:
        t, out = threshold(F.col("length") - delta, tau, chars), F.lit(None).cast("array<struct<d:int,k:int,i:int,s:int>>")
        for k in range(max(delta, 1), tau + 1):
            spots = [F.struct(F.lit(delta).alias("d"), F.lit(k + 1).alias("k"), F.lit(i).alias("i"), F.lit(s).alias("s")) for i in range(k + 1) for s in place(i, delta, k)]
            out = F.when(t == k, F.array(*spots)).otherwise(out) if spots else out
        return F.coalesce(out, F.array().cast("array<struct<d:int,k:int,i:int,s:int>>"))

    # A segment at its own place in a line of the same length is found in the index itself.
    moved = lambda i, delta, k: [s for s in shifts(i, delta, k) if delta or s]
    places = [listed(delta, moved) for delta in range(tau + 1)] if probes else [listed(0, lambda i, delta, k: [0])]
    # Places become rows before they are hashed: inside the array each hash would be interpreted.
    p = F.col("p")
    each = lines.select("no", "counts", "line", "length", F.explode(F.flatten(F.array(*places))).alias("p"))
    start, size = segment(F.col("length") - p["d"], p["i"], p["k"])
    return each.select("no", "counts", *also, F.xxhash64(F.col("length") - p["d"], p["i"], F.substring("line", start + p["s"] + 1, size)).alias("key"))


def letters(line: Column) -> Column:
    """Counts of LETTERS, each modulo 16, in one long; a letter is one byte. What is counted is taken out, so the rest gets shorter."""
    out, rest = F.lit(0).cast("long"), F.replace(line, F.lit(" "), F.lit(""))
    for i, c in enumerate(LETTERS):
        less = F.replace(rest, F.lit(c), F.lit(""))
        n = (F.octet_length(rest) - F.octet_length(less)).cast("long")
        out, rest = out.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(15)), 4 * i)), less
    return out


def letters_apart(a: Column, b: Column) -> Column:
    """The sum of the differences of the counts, each the shorter way round 16."""
    total = F.lit(0)
    for i in range(len(LETTERS)):
        d = F.abs(F.shiftrightunsigned(a, 4 * i).bitwiseAND(F.lit(15)) - F.shiftrightunsigned(b, 4 * i).bitwiseAND(F.lit(15)))
        total = total + F.least(d, 16 - d)
    return total


def part_kept(x: Column, y: Column, t: Column) -> Column:
    """Whether ``y`` holds one of the t + 1 parts of ``x`` unchanged: if not, more than t edits lie between them."""

    def held(i: Column) -> Column:
        start, size = segment(F.length(x), i, t + 1)
        return F.contains(y, F.substring(x, start + 1, size))

    return F.exists(F.sequence(F.lit(0), t), held)


def within(x: Column, y: Column, tau: int, most: Column | None = None) -> Column:
    """Whether ``x`` (not the longer) and ``y`` are within ``tau`` edits, or ``most`` of these.

    Column bits of the band around the diagonal, Hyyro (2003): vp and vn are its vertical
    differences, d is the distance on the diagonal and, past its end, along the last row. The
    characters are cut once; a short ``x`` is padded alike on both sides, as the band needs.
    """
    pad = F.when(F.length(x) <= tau, F.repeat(F.lit("\x00"), tau + 1)).otherwise("")
    both = F.struct(F.split(F.concat(pad, x), "").alias("a"), F.split(F.concat(pad, y), "").alias("b"))
    return once(both, lambda p: banded(p["a"], p["b"], tau, F.lit(tau) if most is None else most))


def banded(a: Column, b: Column, tau: int, most: Column) -> Column:
    w = 2 * tau + 2
    ones, n = (1 << w) - 1, F.size(b)
    lit = lambda x: F.lit(x).cast("long")
    inv = lambda x: F.bitwise_not(x).bitwiseAND(lit(ones))

    def step(s: Column, i: Column) -> Column:
        c, m = F.get(b, i), lit(0)
        for k in range(w):
            m = m.bitwiseOR(F.when(F.get(a, i + (tau + 1 - w + k)) == c, lit(1 << k)).otherwise(lit(0)))
        return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), m.alias("m"), i.alias("i"))

    def advance(s: Column) -> Column:
        vp, vn, m = s["vp"], s["vn"], s["m"]
        d0 = (m.bitwiseAND(vp) + vp).bitwiseAND(lit(ones)).bitwiseXOR(vp).bitwiseOR(m).bitwiseOR(vn)
        return F.struct(vp.alias("vp"), vn.alias("vn"), s["d"].alias("d"), d0.alias("d0"), s["i"].alias("i"))

    def settle(s: Column) -> Column:
        vp, vn, d0 = s["vp"], s["vn"], s["d0"]
        hp, hn = vn.bitwiseOR(inv(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
        half = F.shiftright(d0, 1)
        past = s["i"] - (F.size(a) - tau)  # steps past the end of the diagonal
        bit = lambda x: F.call_function("shiftright", x, (w - 2 - past).cast("int")).bitwiseAND(lit(1))
        d = F.when(past < 0, s["d"] + 1 - F.shiftright(d0, w - 1)).otherwise(s["d"] + bit(hp) - bit(hn))
        return F.struct(hn.bitwiseOR(inv(half.bitwiseOR(hp))).alias("vp"), half.bitwiseAND(hp).alias("vn"), d.alias("d"))

    # Along the diagonal the distance never falls, along the last row by 1 a step, 2 tau at most: beyond this it is over.
    over = 2 * tau + most
    go = lambda s, i: F.when(s["d"] > over, s).otherwise(once(once(step(s, i), advance), settle))
    start = F.struct(lit(ones << (w - tau - 1) & ones).alias("vp"), lit(0).alias("vn"), lit(tau).alias("d"))
    return F.aggregate(F.sequence(F.lit(0), n - 1), start, go, lambda s: s["d"] <= most)


def once(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def common(x: Column, y: Column) -> Column:
    """Length of the common prefix, by adding powers of two from the largest on."""
    n = F.least(F.length(x), F.length(y))
    powers = F.transform(F.sequence(F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2.0), k.cast("double")).cast("int"))
    more = lambda a, p: (a + p <= n) & (F.substring(x, a + 1, p) == F.substring(y, a + 1, p))
    return F.aggregate(powers, F.lit(0), lambda a, p: F.when(more(a, p), a + p).otherwise(a))


def middles(x: Column, y: Column) -> Column:
    """What differs: the strings without their common prefix and the common suffix of the rest, as a struct (x, y); their distance is the same."""
    rest = lambda s, p: F.struct(F.reverse(F.substring(s["x"], p + 1, F.length(s["x"]))).alias("x"), F.reverse(F.substring(s["y"], p + 1, F.length(s["y"]))).alias("y"))
    cut = lambda s: once(common(s["x"], s["y"]), lambda p: rest(s, p))
    return once(once(F.struct(x.alias("x"), y.alias("y")), cut), cut)


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``pos``, ``line``, ``h1``, ``h2`` of the lines that count."""
    out = docs.where(col(id_col).isNotNull()).select(col(id_col).alias("id"), F.posexplode(F.split(col(text_col).cast("string"), "\n")).alias("pos", "line"))
    out = out.withColumn("line", F.btrim("line", F.lit(" \t\r"))).where(F.length("line") >= MIN_CHARS)
    return out.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def alike(x: Column, y: Column, tau: int, chars: int) -> Column:
    """Whether two lines are within their threshold; a condition of a join is compiled, so without functions on arrays."""
    d = F.levenshtein(x, y, tau)  # -1 beyond tau
    return (d >= 0) & (d <= threshold(F.least(F.length(x), F.length(y)), tau, chars))


def frequent(some: DataFrame, tau: int, chars: int) -> DataFrame:
    """``key`` and ``length`` (of its lines) of the index keys that about FREQUENT lines or more have, a written table."""
    part = keys(some.where(F.pmod(F.xxhash64(F.lit(2), "no"), F.lit(SHARE)) == 0), tau, chars, False, ("length",))
    part = part.groupBy("key").agg(F.count("*").alias("n"), F.first("length").alias("length"))
    return written(part.where(F.col("n") > FREQUENT // SHARE).select("key", "length"), "frequent")


def linked(distinct: DataFrame, tau: int, chars: int) -> DataFrame:
    """Pairs (a, b) of numbers of different lines within their threshold, a written table; distinct: ``no``, ``line``, ``length``, ``counts`` (of letters)."""
    some = distinct.where(F.col("length") >= chars)
    index, probe = keys(some, tau, chars, False), keys(some, tau, chars, True)

    def met(x: DataFrame, y: DataFrame, whole: bool = False) -> DataFrame:
        """Pairs of ``x`` (of the index) and ``y`` with a common key that letters allow, or that are links."""
        other = F.col("x.no") < F.col("y.no") if y is x else F.col("x.no") != F.col("y.no")
        close = letters_apart(F.col("x.counts"), F.col("y.counts")) <= 2 * tau
        if whole:
            close = close & alike(F.col("x.line"), F.col("y.line"), tau, chars)
        pairs = x.alias("x").join(y.alias("y"), (F.col("x.key") == F.col("y.key")) & other & close)
        return pairs.select(F.least("x.no", "y.no").alias("a"), F.greatest("x.no", "y.no").alias("b"))

    often, more = frequent(some, tau, chars), []
    if n := often.count():
        known = F.broadcast(often.select("key")) if n <= BROADCAST_LINES else often.select("key")
        few = [r.key for r in often.collect()] if n <= LISTED else None

        def held(rows: DataFrame, yes: bool) -> DataFrame:
            """The rows whose key is frequent, or isn't."""
            if few is None:
                return rows.join(known, "key", "left_semi" if yes else "left_anti")
            return rows.where(F.col("key").isin(few) == F.lit(yes))

        spans = often.select(F.explode(F.sequence("length", F.col("length") + tau)).alias("length")).distinct()
        rows = some.join(F.broadcast(spans), "length", "left_semi")
        own, near = (held(keys(rows, tau, chars, probes, ("line",)), True) for probes in (False, True))
        more = [written(met(own, own, True).union(met(own, near, True)).distinct(), "links")]
        index = held(index, False)
    pairs = written(met(index, index).union(met(index, probe)).distinct(), "pairs")
    forget(often)
    wanted = written(pairs.select(F.col("a").alias("no")).distinct().union(pairs.select("b").distinct()).distinct(), "wanted")
    few = wanted.count() <= BROADCAST_LINES
    texts = written(distinct.join(F.broadcast(wanted) if few else wanted, "no", "left_semi").select("no", "line"), "lines")
    both = pairs.join(texts.select(F.col("no").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("no").alias("b"), F.col("line").alias("y")), "b")
    swap = F.length("x") > F.length("y")
    t = threshold(F.least(F.length("x"), F.length("y")), tau, chars)
    both = both.where(F.abs(F.length("x") - F.length("y")) <= t)
    both = both.select("a", "b", t.alias("t"), middles(F.when(swap, F.col("y")).otherwise(F.col("x")), F.when(swap, F.col("x")).otherwise(F.col("y"))).alias("m"))
    # The middles are a table: folded into the filter below they would be cut again at every step.
    both = written(both.select("a", "b", "t", "m.x", "m.y"), "middles")
    forget(pairs, wanted, texts)
    hits = both.where(part_kept(F.col("x"), F.col("y"), F.col("t"))).where(within(F.col("x"), F.col("y"), tau, F.col("t"))).select("a", "b")
    for links in more:
        hits = hits.union(links).distinct()
    hits = written(hits, "links")
    forget(both, *more)
    return hits


def decisions(docs: DataFrame, tau: int = TAU, id_col: str = "doc_id", text_col: str = "text", chars: int = 0) -> DataFrame:
    """A row for each line that goes: ``id``, ``pos`` (from 0), ``first_id`` and ``first_pos`` (the occurrence that stays), ``equal`` (it is the same text)."""
    own = lines(docs, id_col, text_col)
    distinct = own.groupBy("h1", "h2").agg(F.min(F.struct("id", "pos")).alias("first"), F.count("*").alias("n"), F.first("line").alias("line"))
    distinct = distinct.select("*", F.monotonically_increasing_id().alias("no"), F.length("line").alias("length"), letters(F.col("line")).alias("counts"))
    distinct = written(distinct, "lines")
    near = components(linked(distinct, tau, chars))
    near = written(near, "classes")
    some = distinct.select("h1", "h2", "no", "first", "n").join(near.withColumnRenamed("node", "no"), "no", "left").where("n > 1 OR component IS NOT NULL")
    lead = some.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("lead"))
    some = some.join(lead, "component", "left").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "first", F.coalesce("lead", "first").alias("lead"))
    at = F.struct("id", "pos")
    out = own.select("id", "pos", "h1", "h2").join(some, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).where(at != F.col("lead"))
    return out.select("id", "pos", F.col("lead.id").alias("first_id"), F.col("lead.pos").alias("first_pos"), (F.col("first") == F.col("lead")).alias("equal")).distinct()


def dedup(docs: DataFrame, tau: int = TAU, id_col: str = "doc_id", text_col: str = "text", chars: int = 0) -> DataFrame:
    """All rows and columns of ``docs``; ``text_col`` without the lines that go."""
    gone = decisions(docs, tau, id_col, text_col, chars).groupBy("id").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    # A mask of the document's lines up to the last that goes: "1" for each that does.
    mask = F.array_join(F.transform("gone", lambda p, i: F.concat(F.repeat(F.lit("0"), (p - F.when(i > 0, F.get("gone", i - 1)).otherwise(F.lit(-1)) - 1).cast("int")), F.lit("1"))), "")
    id_, flags = fresh(docs, "id"), fresh(docs, "mask")
    gone = gone.select(F.col("id").alias(id_), F.split(mask, "").alias(flags))
    rest = F.filter(F.split(col(text_col), "\n"), lambda x, i: F.coalesce(F.get(flags, i) != "1", F.lit(True)))
    text = F.when(F.col(flags).isNull(), col(text_col)).otherwise(F.array_join(rest, "\n")).alias(text_col)
    out = docs.join(gone, col(id_col) == F.col(id_), "left")
    return out.select(*[text if c == text_col else col(c) for c in docs.columns])


def per_document(docs: DataFrame, tau: int = TAU, id_col: str = "doc_id", text_col: str = "text", chars: int = 0) -> DataFrame:
    """``id_col``, ``n_lines`` (that count), ``n_gone``, ``n_near`` (of those, not the same text as what stays), ``gone`` (their numbers) and ``first_ids`` (documents of the occurrences that stay)."""
    gone = decisions(docs, tau, id_col, text_col, chars).groupBy("id").agg(F.sort_array(F.collect_set("pos")).alias("gone"), F.count("*").alias("n_gone"), F.sum((~F.col("equal")).cast("long")).alias("n_near"), F.sort_array(F.collect_set("first_id")).alias("first_ids"))
    long_ = F.size(F.filter(F.split(col(text_col).cast("string"), "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\r"))) >= MIN_CHARS))
    all_ = docs.select(col(id_col).alias("_id"), F.coalesce(F.when(col(text_col).isNotNull(), long_), F.lit(0)).cast("long").alias("n_lines"))
    out = all_.join(gone, F.col("_id") == F.col("id"), "left")
    empty = F.array().cast(gone.schema["gone"].dataType), F.array().cast(gone.schema["first_ids"].dataType)
    return out.select(F.col("_id").alias(id_col), "n_lines", F.coalesce("n_gone", F.lit(0)).alias("n_gone"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("gone", empty[0]).alias("gone"), F.coalesce("first_ids", empty[1]).alias("first_ids"))
