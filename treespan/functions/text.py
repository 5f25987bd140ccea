"""Text functions on segments, as columns.

``s`` is a segment's substring. Functions that find places return offsets relative to it, -1 for
none; functions that cut return a struct or array of structs (start, stop), relative too: add the
segment's start for places in the document. Native expressions are used wherever they are exact;
Unicode classes, case folding, whitespace splits and regular expressions of the ``regex`` dialect
are Arrow UDFs. Null in gives null out.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that Python's str methods take as white space.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
#: Line ends of Python's splitlines.
LINE_ENDS = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]"
SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
SPANS = "array<struct<start:int,stop:int>>"
CLASSES = ("isalnum", "isalpha", "isascii", "isdecimal", "isdigit", "isidentifier", "islower", "isnumeric", "isprintable", "isspace", "istitle", "isupper")


def span(start: Column, stop: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"))


def substring_of(text: Column, start: Column, stop: Column) -> Column:
    return F.substring(text, start + 1, stop - start)


def _ends(length: Column, start: int | None, end: int | None) -> tuple[Column, Column]:
    """Ends of a slice of literal bounds; the first isn't clamped to the length."""
    a = F.lit(0) if start is None else F.lit(start) if start >= 0 else F.greatest(length + start, F.lit(0))
    b = length if end is None else F.least(F.lit(end), length) if end >= 0 else F.greatest(length + end, F.lit(0))
    return a, b


def count(s: Column, sub: str, start: int | None = None, end: int | None = None) -> Column:
    """Non-overlapping occurrences; the empty string is found length + 1 times."""
    a, b = _ends(F.length(s), start, end)
    part = substring_of(s, a, b)
    if not sub:
        return F.when(s.isNotNull(), F.when(a <= b, b - a + 1).otherwise(0))
    return F.when(a < b, ((F.length(part) - F.length(F.replace(part, F.lit(sub), F.lit("")))) / len(sub)).cast("int")).when(s.isNotNull(), 0)


def starts_with(s: Column, *prefixes: str, start: int | None = None, end: int | None = None) -> Column:
    return _affix(s, prefixes, start, end, lambda part, p: part.startswith(p))


def ends_with(s: Column, *suffixes: str, start: int | None = None, end: int | None = None) -> Column:
    return _affix(s, suffixes, start, end, lambda part, p: part.endswith(p))


def _affix(s: Column, options: tuple[str, ...], start, end, test: Callable) -> Column:
    a, b = _ends(F.length(s), start, end)
    part, hit = substring_of(s, a, b), F.lit(False)
    for p in options:
        hit = hit | test(part, p)
    return F.when(s.isNotNull(), (a <= b) & hit)


def find(s: Column, sub: str, start: int | None = None, end: int | None = None) -> Column:
    """Place of the first occurrence inside [start, end)."""
    a, b = _ends(F.length(s), start, end)
    at = F.instr(substring_of(s, a, b), sub) if sub else F.lit(1)
    return F.when(s.isNotNull(), F.when((a <= b) & (at > 0), a + at - 1).otherwise(-1))


def rfind(s: Column, sub: str, start: int | None = None, end: int | None = None) -> Column:
    """Place of the last occurrence inside [start, end)."""
    a, b = _ends(F.length(s), start, end)
    if not sub:
        return F.when(s.isNotNull(), F.when(a <= b, b).otherwise(-1))
    at = F.instr(F.reverse(substring_of(s, a, b)), sub[::-1])
    return F.when(s.isNotNull(), F.when((a <= b) & (at > 0), b - at + 1 - len(sub)).otherwise(-1))


def _sure(found: Column, sub: str) -> Column:
    return F.when(found >= 0, found).when(found.isNotNull(), F.raise_error(F.lit(f"substring {sub!r} not found")).cast("int"))


def index(s: Column, sub: str, start: int | None = None, end: int | None = None) -> Column:
    """``find`` that fails where there is none."""
    return _sure(find(s, sub, start, end), sub)


def rindex(s: Column, sub: str, start: int | None = None, end: int | None = None) -> Column:
    return _sure(rfind(s, sub, start, end), sub)


def _udf(function: Callable, kind: str) -> Callable[..., Column]:
    """An Arrow UDF of a function of one row's values; any null gives null, whole batches at a time."""
    arrow = {"boolean": pa.bool_(), "string": pa.string(), SPANS: pa.list_(SPAN), "array<int>": pa.list_(pa.int32()), "int": pa.int32()}[kind]

    def run(it: Iterator) -> Iterator[pa.Array]:
        for cols in it:
            cols = cols if isinstance(cols, tuple) else (cols,)
            rows = zip(*(c.to_pylist() for c in cols), strict=True)
            yield pa.array([None if None in r else function(*r) for r in rows], arrow)

    def one(it):
        return run(it)

    def many(it):
        return run(it)

    def call(*cols: Column) -> Column:
        f = one if len(cols) == 1 else many
        f.__annotations__ = {"it": Iterator[pa.Array] if len(cols) == 1 else Iterator[tuple[(pa.Array,) * len(cols)]], "return": Iterator[pa.Array]}
        return F.arrow_udf(f, kind)(*cols)

    return call


def is_class(s: Column, name: str) -> Column:
    """str.isalnum and its like, exactly: all characters (not any) must satisfy; the empty string only ``isascii``."""
    if name not in CLASSES:
        raise ValueError(f"no string class {name!r}")
    if name == "isascii":
        return ~s.rlike(r"[^\x00-\x7F]")
    if name == "isspace":
        return (F.length(s) > 0) & (F.length(F.btrim(s, F.lit(WHITESPACE))) == 0)
    return _udf(lambda x: getattr(x, name)(), "boolean")(s)


def casefold(s: Column) -> Column:
    """Full case folding; native while all text is ASCII isn't known, so an Arrow UDF."""
    return _udf(str.casefold, "string")(s)


def strip(s: Column, chars: str | None = None, side: str = "both") -> Column:
    """What is left (start, stop) without ``chars`` (white space) at the ends; of a segment of only such the empty end."""
    chars = WHITESPACE if chars is None else chars
    if not chars:
        return span(F.lit(0), F.length(s))
    left = F.length(s) - F.length(F.ltrim(s, F.lit(chars))) if side in ("both", "left") else F.lit(0)
    right = F.length(F.rtrim(s, F.lit(chars))) if side in ("both", "right") else F.length(s)
    return F.when(s.isNotNull(), span(left, F.greatest(left, right)))


def partition(s: Column, sep: str) -> Column:
    """Before, separator and after, as three spans; all of it and two empty ones without a separator."""
    return _parts(s, sep, find)


def rpartition(s: Column, sep: str) -> Column:
    return _parts(s, sep, rfind)


def _parts(s: Column, sep: str, where: Callable) -> Column:
    if not sep:
        raise ValueError("empty separator")
    n, at = F.length(s), where(s, sep)
    first = F.array(span(F.lit(0), at), span(at, at + len(sep)), span(at + len(sep), n))
    none = F.array(span(F.lit(0), n), span(n, n), span(n, n)) if where is find else F.array(span(F.lit(0), F.lit(0)), span(F.lit(0), F.lit(0)), span(F.lit(0), n))
    return F.when(at >= 0, first).when(s.isNotNull(), none)


def remove_prefix(s: Column, prefix: str) -> Column:
    return F.when(s.startswith(prefix), span(F.lit(len(prefix)), F.length(s))).when(s.isNotNull(), span(F.lit(0), F.length(s)))


def remove_suffix(s: Column, suffix: str) -> Column:
    return F.when(s.endswith(suffix), span(F.lit(0), F.length(s) - len(suffix))).when(s.isNotNull(), span(F.lit(0), F.length(s)))


def _located(pieces: list[str], text: str) -> list[dict]:
    out, at = [], 0
    for p in pieces:
        at = text.index(p, at)
        out.append({"start": at, "stop": at + len(p)})
        at += len(p)
    return out


def _split_places(text: str, sep: str | None, most: int, right: bool) -> list[dict]:
    pieces = (text.rsplit if right else text.split)(sep, most)
    if sep is None:
        return _located(pieces, text)
    out, at = [], 0
    for p in pieces:
        out.append({"start": at, "stop": at + len(p)})
        at += len(p) + len(sep)
    return out


def split_spans(s: Column, sep: str | None = None, maxsplit: int = -1, right: bool = False) -> Column:
    """str.split and rsplit as spans: at a separator, or at runs of white space, at most ``maxsplit`` times."""
    if sep == "":
        raise ValueError("empty separator")
    return _udf(lambda x: _split_places(x, sep, maxsplit, right), SPANS)(s)


def line_spans(s: Column, keepends: bool = False) -> Column:
    """str.splitlines as spans."""

    def run(x: str) -> list[dict]:
        out, at = [], 0
        for whole in x.splitlines(True):
            bare = whole if keepends else whole.splitlines()[0]
            out.append({"start": at, "stop": at + len(bare)})
            at += len(whole)
        return out

    return _udf(run, SPANS)(s)


def explode_split(df: DataFrame, text: str, sep: str, key: str = "doc_id", label: str | None = None) -> DataFrame:
    """Rows key, ord, start, stop, label of the pieces of a text between literal separators, natively: offsets are running sums."""
    if not sep:
        raise ValueError("empty separator")
    rows = df.select(key, F.posexplode(F.split(F.col(text), "\\Q" + sep + "\\E")).alias("ord", "_piece"))
    before = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("_piece") + len(sep)).over(before), F.lit(0)).cast("int")
    return rows.withColumn("start", start).select(key, "ord", "start", (F.col("start") + F.length("_piece")).alias("stop"), F.lit(label).cast("string").alias("label"))


def explode_words(df: DataFrame, text: str, key: str = "doc_id", label: str | None = "word") -> DataFrame:
    """The same for runs of other characters than blanks; empty pieces go and the rest is renumbered."""
    rows = explode_split(df, text, " ", key, label).where("stop > start")
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("start")) - 1)


def line_col(text: Column, start: Column, eol: str = "\n") -> Column:
    """Line and column of a place, both from 1; ``eol``: a Java-compatible pattern that matches line ends."""
    parts = F.split(F.left(text, start), eol)
    return F.struct(F.size(parts).alias("line"), (F.length(F.element_at(parts, -1)) + 1).alias("col"))


def first_of(*options: Column) -> Column:
    return F.coalesce(*options)


# Escapes and balance. The plain functions work on strings, the column functions on whole columns.


def escapes(text: str, escape: str = "\\") -> list[int]:
    """Places of the escape characters that aren't escaped themselves."""
    out, i = [], 0
    while (i := text.find(escape, i)) >= 0:
        out.append(i)
        i += 2
    return out


def unescaped(text: str, chars: str, escape: str = "\\") -> list[int]:
    """Places of any of ``chars`` that aren't escaped; a dangling escape is an error."""
    if escape in chars:
        raise ValueError("the escape character can't be looked for")
    out, i = [], 0
    while i < len(text):
        if text[i] == escape:
            if i + 1 == len(text):
                raise ValueError(f"dangling escape at the end of {text!r}")
            i += 2
            continue
        if text[i] in chars:
            out.append(i)
        i += 1
    return out


def split_at_unescaped(text: str, char: str, escape: str = "\\") -> list[tuple[int, int]]:
    cuts = unescaped(text, char, escape)
    return list(zip([0, *(c + 1 for c in cuts)], [*cuts, len(text)], strict=True))


def balanced(text: str, left: str, right: str, escape: str = "\\") -> list[tuple[int, int]]:
    """Outermost groups between ``left`` and ``right``, both included; if they are one character, between each two of it."""
    out, opened = [], []
    for i in unescaped(text, left + right, escape):
        if left == right:
            opened = [i] if not opened else out.append((opened[0], i + 1)) or []
        elif text[i] == left:
            opened.append(i)
        elif not opened:
            raise ValueError(f"unbalanced {right!r} at {i}")
        else:
            begin = opened.pop()
            if not opened:
                out.append((begin, i + 1))
    if opened:
        raise ValueError(f"unbalanced {left!r} at {opened[-1]}")
    return out


def _as_spans(pairs) -> list[dict]:
    return [{"start": a, "stop": b} for a, b in pairs]


def escape_places(s: Column, escape: str = "\\") -> Column:
    return _udf(lambda x: escapes(x, escape), "array<int>")(s)


def unescaped_places(s: Column, chars: str, escape: str = "\\") -> Column:
    return _udf(lambda x: unescaped(x, chars, escape), "array<int>")(s)


def unescaped_split(s: Column, char: str, escape: str = "\\") -> Column:
    return _udf(lambda x: _as_spans(split_at_unescaped(x, char, escape)), SPANS)(s)


def balanced_spans(s: Column, left: str, right: str, escape: str = "\\") -> Column:
    return _udf(lambda x: _as_spans(balanced(x, left, right, escape)), SPANS)(s)


# Regular expressions of the ``regex`` dialect, bounded by a segment; what surrounds it stays visible to look-around.


def regex_spans(text: Column, start: Column, stop: Column, pattern: str, mode: str = "finditer", flags: int = 0, overlapped: bool = False) -> Column:
    """Spans in the document of what a pattern finds in [start, stop): ``search``, ``match`` and ``fullmatch`` give one or none, ``finditer`` all, ``split`` what is between."""
    if mode not in ("search", "match", "fullmatch", "finditer", "split"):
        raise ValueError(f"no mode {mode!r}")
    import regex

    regex.compile(pattern, flags)

    def run(x: str, a: int, b: int) -> list[dict]:
        own = regex.compile(pattern, flags)
        if mode in ("finditer", "split"):
            found = [m.span() for m in own.finditer(x, a, b, overlapped=overlapped and mode == "finditer")]
            if mode == "split":
                found = zip([a, *(e for _, e in found)], [*(s for s, _ in found), b], strict=True)
        else:
            m = getattr(own, mode)(x, a, b)
            found = [m.span()] if m else []
        return _as_spans(found)

    return _udf(run, SPANS)(text, start, stop)


# Formatting.

#: The directives of a format, as they are written: %span %start %stop with an optional ":" and an integer format;
#: %desc %string %substr %value with an optional "!" conversion (digits to cut left, a or r, digits to cut right)
#: and an optional ":" with the side to shorten, the greatest width and what stands for what is cut; "% " is nothing.
_DIRECTIVE = re.compile(
    r"%(?:(?P<none> )|(?P<number>span|start|stop)(?::(?P<format>(?:.?[<>=^])?[+-]?#?0?\d*[_,]?[bcdeEfFgGnosxX%]?))?"
    r"|(?P<name>desc|string|substr|value)(?:!(?P<left>\d*)(?P<conversion>[ar])(?P<right>\d*))?(?::(?P<side>[<^>])?(?P<width>\d+)(?P<mark>.+)?)?)",
    re.DOTALL,
)


def shortened(text: str, width: int, mark: str = "", side: str = ">") -> str:
    """``text`` cut to ``width`` characters, ``mark`` in the place of what is cut; shorter texts stay as they are."""
    if len(text) <= width:
        return text
    room = width - len(mark)
    if room <= 0:
        return mark[len(mark) - width :]
    tail = {"<": room, "^": room // 2}.get(side, 0)
    return text[: room - tail] + mark + (text[-tail:] if tail else "")


@functools.lru_cache(maxsize=64)
def _directives(spec: str) -> tuple[list[tuple[str, dict]], str]:
    """The directives of a format, each with what stands before it, and the rest."""
    places = [i for i in escapes(spec, "%")]
    out, at = [], 0
    for i, end in zip(places, [*places[1:], len(spec)], strict=True):
        m = _DIRECTIVE.match(spec, i, end)
        if m:
            out.append((spec[at:i], m.groupdict()))
            at = m.end()
    return out, spec[at:]


def format_node(spec: str, text: str, start: int, stop: int, label: str | None, value: object = None) -> str:
    """A segment by a format with directives; a directive reaches at most to the next."""
    if not spec:
        return text[start:stop]
    parts, rest = _directives(spec)
    out = []
    for before, m in parts:
        out.append(before)
        if m["number"]:
            ends = [format(x, m["format"] or "") for x in ((start, stop) if m["number"] == "span" else (start if m["number"] == "start" else stop,))]
            out.append(f"({', '.join(ends)})" if m["number"] == "span" else ends[0])
        elif m["name"]:
            got = {"desc": label or "", "string": text, "substr": text[start:stop]}.get(m["name"])
            got = str(text[start:stop] if value is None else value) if got is None else got
            if m["conversion"]:
                got = ascii(got) if m["conversion"] == "a" else repr(got)
                cut = int(m["right"] or 0)
                got = got[int(m["left"] or 0) : len(got) - cut if cut else None]
            if m["width"]:
                got = shortened(got, int(m["width"]), m["mark"] or "", m["side"] or ">")
            out.append(got)
    return "".join([*out, rest])


def formatted(text: Column, start: Column, stop: Column, label: Column, spec: str) -> Column:
    """Segments by a format; null labels print nothing."""
    return _udf(lambda t, a, b, d: format_node(spec, t, a, b, d or None), "string")(text, start, stop, F.coalesce(label, F.lit("")))
