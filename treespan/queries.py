"""Named queries over the shared tables, with the same in SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import model
from .functions import segments as sg
from .functions import text as tx
from .operators import nlp, packs, stages
from .plans.forest import Forest, Trees
from .plans.path import find_all, parse
from .plans.walk import Walker
from .sources import store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def tree(spark: SparkSession, folder: str) -> DataFrame:
    return model.line_word_tree(docs(spark, folder))


def trees(spark: SparkSession, folder: str) -> Trees:
    return Trees.of_lines(docs(spark, folder))


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


#: document > lines > words with their ranks; the texts of words and lines in ``sub``.
TREE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS lpos FROM documents WHERE text IS NOT NULL),
ln AS (SELECT doc_id, lpos, line, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY lpos) - length(line) - 1)::INT AS lstart FROM l),
pc AS (SELECT doc_id, lpos, lstart, unnest(string_split(line, ' ')) AS w, generate_subscripts(string_split(line, ' '), 1) AS k FROM ln),
wd AS (SELECT doc_id, lpos, w, (lstart + sum(length(w) + 1) OVER (PARTITION BY doc_id, lpos ORDER BY k) - length(w) - 1)::INT AS start FROM pc),
nd AS (SELECT doc_id, -1 AS lpos, 0 AS depth, 0 AS start, length(text)::INT AS stop, 'doc' AS label, text AS sub FROM documents WHERE text IS NOT NULL
       UNION ALL SELECT doc_id, lpos, 1, lstart, lstart + length(line)::INT, 'line', line FROM ln
       UNION ALL SELECT doc_id, lpos, 2, start, start + length(w)::INT, 'word', w FROM wd WHERE w <> ''),
rk AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY lpos, depth, start) - 1)::INT AS pre, count(*) OVER (PARTITION BY doc_id) AS n, count(*) OVER (PARTITION BY doc_id, lpos) AS m FROM nd),
pr AS (SELECT *, CASE depth WHEN 0 THEN n - 1 WHEN 1 THEN pre + m - 1 ELSE pre END::INT AS last, min(pre) OVER (PARTITION BY doc_id, lpos) AS lead_pre FROM rk),
seg AS (SELECT doc_id, pre, last, CASE depth WHEN 1 THEN 0 WHEN 2 THEN lead_pre END::INT AS parent, depth, CASE depth WHEN 0 THEN 0 WHEN 1 THEN lpos ELSE pre - lead_pre - 1 END::INT AS ord, start, stop, label, sub FROM pr)
"""
NODE = "doc_id, pre, start, stop, label"


def path_query(name: str, path: str, sql: str, ordered: bool = False, columns: str = NODE) -> None:
    """A path from every root, as rows of the nodes found (with their place in the result, if ordered)."""
    names = [c.strip() for c in columns.split(",")] + ["pos"] * ordered

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return find_all(path, trees(spark, folder), ordered=ordered, columns=names[: len(names) - ordered]).select(*names)

    register(name, TREE + sql)(run)


def pick(alias: str) -> str:
    return ", ".join(f"{alias}.{c.strip()} AS {c.strip()}" for c in NODE.split(","))


def axis_sql(context: str, on: str, where: str = "true") -> str:
    return f"SELECT {pick('n')} FROM seg c JOIN seg n ON c.doc_id = n.doc_id AND {on} WHERE {context} AND {where}"


@register("tree_line_word", TREE + "SELECT doc_id, pre, last, parent, depth, ord, start, stop, label FROM seg")
def tree_line_word(spark: SparkSession, folder: str) -> DataFrame:
    return tree(spark, folder)


# Axes, each in both directions where the order shows.
path_query("axis_children", "*", "SELECT doc_id, pre, start, stop, label, ord AS pos FROM seg WHERE parent = 0", ordered=True)
path_query("axis_children_reversed", "-*", "SELECT doc_id, pre, start, stop, label, (count(*) OVER (PARTITION BY doc_id) - 1 - ord)::INT AS pos FROM seg WHERE parent = 0", ordered=True)
path_query("axis_descendants", "**", "SELECT doc_id, pre, start, stop, label, pre - 1 AS pos FROM seg WHERE pre > 0", ordered=True)
path_query("axis_leaves", "***", f"SELECT {NODE} FROM seg WHERE pre > 0 AND pre = last")
path_query("axis_root", "**[d:word]/....", axis_sql("c.label = 'word'", "n.pre = 0"))
path_query("axis_ancestors", "**[d:word]/...", axis_sql("c.label = 'word'", "n.pre < c.pre AND n.last >= c.pre"))
path_query("axis_parent", "**[d:word]/..", axis_sql("c.label = 'word'", "n.pre = c.parent"))
path_query("axis_self", "**[d:line]/.", f"SELECT {NODE} FROM seg WHERE label = 'line'")
path_query("axis_prior_sibling", "**[d:word]/<", axis_sql("c.label = 'word'", "n.parent = c.parent AND n.ord = c.ord - 1"))
path_query("axis_next_sibling", "**[d:word]/>", axis_sql("c.label = 'word'", "n.parent = c.parent AND n.ord = c.ord + 1"))
path_query("axis_prior_siblings", "*/<<", axis_sql("c.parent = 0", "n.parent = c.parent AND n.ord < c.ord"))
path_query("axis_next_siblings", "*/>>", axis_sql("c.parent = 0", "n.parent = c.parent AND n.ord > c.ord"))
path_query("axis_preceding", "*/<<<[d:line]", axis_sql("c.parent = 0", "n.last < c.pre", "n.label = 'line'"))
path_query("axis_following", "*/>>>[d:line]", axis_sql("c.parent = 0", "n.pre > c.last", "n.label = 'line'"))
path_query("axis_distinct", "**[d:word]/../><", f"SELECT DISTINCT {pick('n')} FROM seg c JOIN seg n ON c.doc_id = n.doc_id AND n.pre = c.parent WHERE c.label = 'word'")
path_query("self_option_if_none", "**[d:word]/<!", axis_sql("c.label = 'word'", "n.parent = c.parent AND n.ord = c.ord - 1") + f" UNION ALL SELECT {NODE} FROM seg WHERE label = 'word' AND ord = 0")
path_query("self_option_always", "**[d:word]/..!!", axis_sql("c.label = 'word'", "n.pre = c.parent") + f" UNION ALL SELECT {NODE} FROM seg WHERE label = 'word'")
# Filters.
path_query("filter_label", "**[d:line]", f"SELECT {NODE} FROM seg WHERE label = 'line'")
path_query("filter_label_negated", "**!![~d:word]", f"SELECT {NODE} FROM seg WHERE label <> 'word'")
path_query("filter_string", "**[s:the,und,la]", f"SELECT {NODE} FROM seg WHERE pre > 0 AND sub IN ('the', 'und', 'la')")
path_query("filter_casefold", "**[d:word] & [scf:THE,Und]", f"SELECT {NODE} FROM seg WHERE label = 'word' AND lower(sub) IN ('the', 'und')")
path_query("filter_casefold_affix", "**[d:word] & ([scfsw:UN,pre] | [scfew:ING,tion])", f"SELECT {NODE} FROM seg WHERE label = 'word' AND (lower(sub) LIKE 'un%' OR lower(sub) LIKE 'pre%' OR lower(sub) LIKE '%ing' OR lower(sub) LIKE '%tion')")
path_query("filter_brackets", "**[d:word] & ([ssw:a] | ([ssw:b] & ~[sew:e]))", f"SELECT {NODE} FROM seg WHERE label = 'word' AND (starts_with(sub, 'a') OR (starts_with(sub, 'b') AND NOT ends_with(sub, 'e')))")
path_query("filter_affix", "**[d:word] & [ssw:a,de] & ~[sew:s,n]", f"SELECT {NODE} FROM seg WHERE label = 'word' AND (starts_with(sub, 'a') OR starts_with(sub, 'de')) AND NOT (ends_with(sub, 's') OR ends_with(sub, 'n'))")
path_query("filter_index", "*/*[i:0,2-4,7-]", f"SELECT {NODE} FROM seg WHERE depth = 2 AND (ord = 0 OR ord BETWEEN 2 AND 3 OR ord >= 7)")
path_query("filter_last", "*/-*[i:0]", f"SELECT {NODE} FROM (SELECT *, max(ord) OVER (PARTITION BY doc_id, parent) AS top FROM seg) WHERE depth = 2 AND ord = top")
path_query("filter_xor", "**[ssw:a] ^ [sew:a]", f"SELECT {NODE} FROM seg WHERE pre > 0 AND (starts_with(sub, 'a') <> ends_with(sub, 'a'))")
# Subqueries.
HAS = "EXISTS (SELECT 1 FROM seg n WHERE n.doc_id = c.doc_id AND n.parent = c.pre AND {})"
path_query("subquery_exists", "**[d:line]{*[scf:with,und]}", f"SELECT {pick('c')} FROM seg c WHERE label = 'line' AND " + HAS.format("lower(n.sub) IN ('with', 'und')"))
path_query("subquery_not_exists", "*~{*[s:the]}", f"SELECT {pick('c')} FROM seg c WHERE parent = 0 AND NOT " + HAS.format("n.sub = 'the'"))
path_query("subquery_xor", "*{*[s:the]} ^ {*[s:of]}", f"SELECT {pick('c')} FROM seg c WHERE parent = 0 AND " + HAS.format("n.sub = 'the'") + " <> " + HAS.format("n.sub = 'of'"))
path_query("subquery_nested", "**[d:word]{..{*[i:0] & [ssw:T,D]}}", f"SELECT {pick('c')} FROM seg c JOIN seg f ON f.doc_id = c.doc_id AND f.parent = c.parent AND f.ord = 0 WHERE c.label = 'word' AND (starts_with(f.sub, 'T') OR starts_with(f.sub, 'D'))")


@register("find_first", TREE + f"SELECT {NODE} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pre) AS k FROM seg WHERE label = 'word') WHERE k = 1")
def find_first(spark: SparkSession, folder: str) -> DataFrame:
    from .plans.path import compile_path

    columns = NODE.replace(" ", "").split(",")
    return compile_path("**[d:word]").find(trees(spark, folder), columns=columns).select(*columns)


@register("filter_null_label", TREE + f"SELECT doc_id, pre, start, stop, CASE WHEN label = 'line' AND length(sub) < 40 THEN NULL ELSE label END AS label FROM seg WHERE label = 'line'")
def filter_null_label(spark: SparkSession, folder: str) -> DataFrame:
    own = model.line_word_tree(docs(spark, folder), line_label=F.when(F.length("line_text") >= 40, "line"))
    return find_all("*[~d:word]", own, ordered=False, together=True).select(*NODE.replace(" ", "").split(","))


@register("filter_predicate_value", TREE + f"SELECT {NODE} FROM seg WHERE label = 'word' AND stop - start > 12 AND ord IN (1, 3)")
def filter_predicate_value(spark: SparkSession, folder: str) -> DataFrame:
    own = tree(spark, folder).withColumn("value", F.col("ord"))
    long_ = lambda row: row["stop"] - row["start"] > 12
    return find_all("**[d:word] & [p:long] & [v:one,three]", own, values={"one": 1, "three": 3}, predicates={"long": long_}, ordered=False, together=True).select(*NODE.replace(" ", "").split(","))


# Text functions.
@register("tokens_ws_offsets", r"""WITH p AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS k FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, k, w, (sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(w) - 1)::INT AS start FROM p)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS ord, start, (start + length(w))::INT AS stop, 'word' AS label FROM o WHERE w <> ''""")
def tokens_ws_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return tx.explode_words(docs(spark, folder), "text")


@register("lines_offsets", r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS w, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (k - 1)::INT AS ord, (sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(w) - 1)::INT AS start, (sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS stop, 'line' AS label FROM p""")
def lines_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return tx.explode_split(docs(spark, folder), "text", "\n", label="line")


@register("text_functions", r"""SELECT p_partkey, (length(p_name) - length(replace(p_name, 'e', '')))::INT AS n_e, (instr(p_name, 'in') - 1)::INT AS first_in,
CASE WHEN instr(p_name, ' ') > 0 THEN (length(p_name) - instr(reverse(p_name), ' '))::INT ELSE -1 END AS last_blank, starts_with(p_name, 'a') OR starts_with(p_name, 'b') AS ab, ends_with(p_name, 'e') AS e,
length(p_name) - length(ltrim(p_name, 'abc')) AS left_abc, length(rtrim(p_name, 'xyz ')) AS right_xyz, regexp_full_match(p_name, '[\x00-\x7F]*') AS ascii_only,
CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, 1, instr(p_name, ' ') - 1) ELSE p_name END AS head FROM part""")
def text_functions(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("p_name")
    first = tx.partition(s, " ")[0]
    return table(spark, folder, "part").select(
        "p_partkey", tx.count(s, "e").alias("n_e"), tx.find(s, "in").alias("first_in"), tx.rfind(s, " ").alias("last_blank"), tx.starts_with(s, "a", "b").alias("ab"), tx.ends_with(s, "e").alias("e"),
        tx.strip(s, "abc", "left")["start"].alias("left_abc"), tx.strip(s, "xyz ", "right")["stop"].alias("right_xyz"), tx.is_class(s, "isascii").alias("ascii_only"),
        tx.substring_of(s, first["start"], first["stop"]).alias("head"),
    )


@register("text_places", r"""SELECT p_partkey, (CASE WHEN instr(p_name, ' ') > 0 THEN length(p_name) - instr(reverse(p_name), ' ') ELSE 0 END)::INT AS tail_cut, (instr(p_type, ' ') - 1)::INT AS first_blank, (length(p_type) - instr(reverse(p_type), ' '))::INT AS last_blank,
CASE WHEN starts_with(p_type, 'STANDARD ') THEN 9 ELSE 0 END AS prefix_cut, (length(p_type) - CASE WHEN ends_with(p_type, 'STEEL') THEN 5 ELSE 0 END)::INT AS suffix_cut FROM part WHERE instr(p_type, ' ') > 0""")
def text_places(spark: SparkSession, folder: str) -> DataFrame:
    s, t = F.col("p_name"), F.col("p_type")
    return table(spark, folder, "part").where("instr(p_type, ' ') > 0").select(
        "p_partkey", tx.rpartition(s, " ")[0]["stop"].alias("tail_cut"), tx.index(t, " ").alias("first_blank"), tx.rindex(t, " ").alias("last_blank"),
        tx.remove_prefix(t, "STANDARD ")["start"].alias("prefix_cut"), tx.remove_suffix(t, "STEEL")["stop"].alias("suffix_cut"),
    )


CLASS_TESTS = {
    "isalpha": "[A-Za-z]+", "isalnum": "[A-Za-z0-9]+", "isdigit": "[0-9]+", "isdecimal": "[0-9]+", "isnumeric": "[0-9]+", "isspace": "[ \\t\\n]+", "islower": "[^A-Za-z]*[a-z][^A-Z]*", "isupper": "[^A-Za-z]*[A-Z][^a-z]*",
    "isidentifier": "[A-Za-z_][A-Za-z0-9_]*", "isprintable": "[\\x20-\\x7e]*", "istitle": "[^A-Za-z]*[A-Z][a-z]*([^A-Za-z]+([A-Z][a-z]*)?)*", "isascii": "[\\x00-\\x7f]*",
}


@register("class_tests", "WITH w AS (SELECT DISTINCT unnest(string_split(p_name || ' ' || p_brand || ' ' || p_type, ' ')) AS w FROM part UNION SELECT unnest(['12', 'Ab', 'aB', 'A1', '_x', 'A-b', '', ' ', 'Ab Cd'])) SELECT w, " + ", ".join(f"regexp_full_match(w, '{v}') AS {k}" for k, v in CLASS_TESTS.items()) + " FROM w")
def class_tests(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_brand", "p_type"), " ")).alias("w"))
    rows = rows.union(spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("12", "Ab", "aB", "A1", "_x", "A-b", "", " ", "Ab Cd")])).alias("w"))).distinct()
    return rows.select("w", *[tx.is_class(F.col("w"), k).alias(k) for k in CLASS_TESTS])


#: Words of part names with their spans, and the same by several ways of cutting.
_WORD_SPANS = """WITH p AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS k FROM part),
s AS (SELECT p_partkey, (sum(length(w) + 1) OVER (PARTITION BY p_partkey ORDER BY k) - length(w) - 1)::INT AS start, (sum(length(w) + 1) OVER (PARTITION BY p_partkey ORDER BY k) - 1)::INT AS stop, k FROM p) """


def word_spans(name: str, spans: Callable, sql: str = "SELECT p_partkey, start, stop FROM s") -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return table(spark, folder, "part").select("p_partkey", F.explode(spans(F.col("p_name"))).alias("x")).select("p_partkey", "x.start", "x.stop")

    register(name, _WORD_SPANS + sql)(run)


word_spans("split_at_blanks", lambda s: tx.split_spans(s))
word_spans("split_from_the_right", lambda s: tx.split_spans(s, " ", 1, right=True), """, m AS (SELECT *, count(*) OVER (PARTITION BY p_partkey) AS n FROM s)
SELECT p_partkey, start, stop FROM m WHERE k = n UNION ALL SELECT p_partkey, 0, max(stop)::INT FROM m WHERE k < n GROUP BY p_partkey""")
word_spans("lines_of_text", lambda s: tx.line_spans(F.replace(s, F.lit(" "), F.lit("\n"))))
word_spans("regex_finds", lambda s: tx.regex_spans(s, F.lit(0), F.length(s), "[^ ]+"))
word_spans("regex_splits", lambda s: tx.regex_spans(s, F.lit(0), F.length(s), " ", "split"))
word_spans("split_at_unescaped", lambda s: tx.unescaped_split(F.replace(s, F.lit(" "), F.lit(",")), ","))
word_spans("balanced_parts", lambda s: tx.balanced_spans(F.concat(F.lit("("), F.replace(s, F.lit(" "), F.lit(")(")), F.lit(")")), "(", ")"), "SELECT p_partkey, (start + k - 1)::INT AS start, (stop + k + 1)::INT AS stop FROM s")
word_spans("regex_searches", lambda s: tx.regex_spans(s, F.lit(0), F.length(s), "[^ ]+", "search"), "SELECT p_partkey, start, stop FROM s WHERE k = 1")


@register("escape_places", _WORD_SPANS + "SELECT p_partkey, start - 1 AS place, true AS escape FROM s WHERE k > 1 UNION ALL SELECT p_partkey, start - 1, false FROM s WHERE k > 1")
def escape_places(spark: SparkSession, folder: str) -> DataFrame:
    own, s = table(spark, folder, "part"), F.col("p_name")
    slashes = own.select("p_partkey", F.explode(tx.escape_places(F.replace(s, F.lit(" "), F.lit("\\")))).alias("place"), F.lit(True).alias("escape"))
    return slashes.unionByName(own.select("p_partkey", F.explode(tx.unescaped_places(F.replace(s, F.lit(" "), F.lit(";")), ";")).alias("place"), F.lit(False).alias("escape")))


@register("nested_spans", TREE + "SELECT doc_id, label, depth, count(*) AS n, sum(last - pre)::BIGINT AS below FROM (SELECT doc_id, label, depth, pre, last FROM seg WHERE stop > start AND NOT EXISTS (SELECT 1 FROM seg e WHERE e.doc_id = seg.doc_id AND e.stop = e.start)) GROUP BY doc_id, label, depth")
def nested_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Trees made anew by containment from their bare spans, of documents without an empty line."""
    own = tree(spark, folder)
    whole = own.join(own.where("stop = start").select("doc_id").distinct(), "doc_id", "left_anti").withColumn("emit_no", F.col("pre"))
    return model.nest(whole).groupBy("doc_id", "label", "depth").agg(F.count("*").alias("n"), F.sum(F.col("last") - F.col("pre")).alias("below"))


@register("characters_of_words", TREE + "SELECT doc_id, sum(stop - start)::BIGINT AS n, sum((stop - start) * (start + stop - 1) / 2)::BIGINT AS places FROM seg WHERE label = 'word' GROUP BY doc_id")
def characters_of_words(spark: SparkSession, folder: str) -> DataFrame:
    out = sg.characters(tree(spark, folder).where("label = 'word'"))
    return out.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start").alias("places"))


@register("sub_segments", TREE + "SELECT doc_id, pre, (start + least(1, stop - start))::INT AS start, greatest(stop - 1, start + least(1, stop - start))::INT AS stop FROM seg WHERE label = 'word'")
def sub_segments(spark: SparkSession, folder: str) -> DataFrame:
    return sg.sub_segment(tree(spark, folder).where("label = 'word'"), 1, -1).select("doc_id", "pre", "start", "stop")


@register("successive_parts", "SELECT p_partkey, label, start, stop FROM (SELECT p_partkey, unnest([{'label': 'a', 'start': 0, 'stop': 4}, {'label': 'b', 'start': 5, 'stop': 7}]) AS x FROM part) t, LATERAL (SELECT x.label AS label, x.start AS start, x.stop AS stop)")
def successive_parts(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "part").select("p_partkey", F.lit("some of it").alias("text"))
    parts = F.concat(store.successive(F.col("text"), ["some"], "a"), F.transform(store.successive(F.substring("text", 5, 99), ["of"], "b"), lambda x: x.withField("start", x["start"] + 4).withField("stop", x["stop"] + 4)))
    return own.select("p_partkey", F.explode(parts).alias("x")).select("p_partkey", "x.label", "x.start", "x.stop")


@register("line_col_of_match", r"""SELECT doc_id, place, (length(left(text, place)) - length(replace(left(text, place), chr(10), '')) + 1)::INT AS line,
CASE WHEN instr(left(text, place), chr(10)) = 0 THEN place + 1 ELSE instr(reverse(left(text, place)), chr(10)) END::INT AS col
FROM (SELECT doc_id, text, (instr(text, 'e') - 1)::INT AS place FROM documents) WHERE place >= 0""")
def line_col_of_match(spark: SparkSession, folder: str) -> DataFrame:
    found = docs(spark, folder).withColumn("place", tx.find(F.col("text"), "e")).where("place >= 0")
    return found.withColumn("lc", tx.line_col(F.col("text"), F.col("place"))).select("doc_id", "place", "lc.line", "lc.col")


@register("number_mentions", r"""SELECT doc_id, unnest(regexp_extract_all(text, '[-+]?(?:(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?|\.[0-9]+)(?:[Ee][-+]?[0-9]+| ?[Xx✕] ?10\^ ?[-+]?[0-9]+)?')) AS number FROM documents""")
def number_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).select("doc_id", F.explode(nlp.numbers(F.col("text"))).alias("number"))


# Gaps, splits, covers.
@register("gaps_between_words", TREE + """, w AS (SELECT doc_id, start, stop, lag(stop, 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS prev, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS nx FROM seg WHERE label = 'word')
SELECT doc_id, prev AS start, start AS stop FROM w WHERE start > prev UNION ALL SELECT w.doc_id, w.stop, d.stop FROM w JOIN seg d ON d.doc_id = w.doc_id AND d.pre = 0 WHERE nx IS NULL AND w.stop < d.stop
UNION ALL SELECT doc_id, start, stop FROM seg d WHERE pre = 0 AND stop > 0 AND NOT EXISTS (SELECT 1 FROM w WHERE w.doc_id = d.doc_id)""")
def gaps_between_words(spark: SparkSession, folder: str) -> DataFrame:
    return sg.gaps_in_documents(trees(spark, folder), "word").select("doc_id", "start", "stop")


MARKS = r"""WITH p AS (SELECT conv_id, turn, length(text)::INT AS size, unnest(string_split(text, '. ')) AS w, generate_subscripts(string_split(text, '. '), 1) AS k, len(string_split(text, '. ')) AS n FROM conversations WHERE text IS NOT NULL),
o AS (SELECT *, (sum(length(w) + 2) OVER (PARTITION BY conv_id, turn ORDER BY k) - length(w) - 2)::INT AS a, (sum(length(w) + 2) OVER (PARTITION BY conv_id, turn ORDER BY k) - 2)::INT AS b FROM p) """
SPLITS = {
    "none": "SELECT conv_id, turn, a AS start, b AS stop FROM o WHERE a < b",
    "leading": "SELECT conv_id, turn, a - CASE WHEN k > 1 THEN 2 ELSE 0 END AS start, b AS stop FROM o WHERE (k > 1 OR n = 1)",
    "trailing": "SELECT conv_id, turn, a AS start, b + CASE WHEN k < n THEN 2 ELSE 0 END AS stop FROM o WHERE (k < n OR n = 1)",
    "all": "SELECT conv_id, turn, a AS start, b AS stop FROM o WHERE a < b UNION ALL SELECT conv_id, turn, b, b + 2 FROM o WHERE k < n",
}


def split_query(keep: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        key = ("conv_id", "turn")
        rows = table(spark, folder, "conversations").where("text IS NOT NULL").withColumn("key", F.struct(*key))
        pieces = tx.explode_split(rows, "text", ". ", "key")
        after = F.lead("start").over(Window.partitionBy("key").orderBy("ord"))
        marks = pieces.select("key.*", F.col("stop").alias("start"), after.alias("stop")).where("stop IS NOT NULL")
        bounds = rows.select(*key, F.lit(0).alias("start"), F.length("text").alias("stop"))
        return sg.split_pieces(marks, bounds, keep, keys=key).select(*key, "start", "stop")

    register(f"split_modes_{keep}", MARKS + SPLITS[keep])(run)


for _keep in SPLITS:
    split_query(_keep)


@register("cover_words", TREE + "SELECT doc_id, min(start) AS start, max(stop) AS stop, 'words' AS label FROM seg WHERE label = 'word' GROUP BY doc_id")
def cover_words(spark: SparkSession, folder: str) -> DataFrame:
    return sg.covering(tree(spark, folder).where("label = 'word'"), label="words")


@register("strip_to_children", TREE + "SELECT s.doc_id, s.pre, coalesce(a, s.start) AS start, coalesce(b, s.stop) AS stop FROM seg s LEFT JOIN (SELECT doc_id, parent, min(start) AS a, max(stop) AS b FROM seg WHERE parent IS NOT NULL GROUP BY ALL) k ON k.doc_id = s.doc_id AND k.parent = s.pre")
def strip_to_children(spark: SparkSession, folder: str) -> DataFrame:
    return sg.strip_to_children(trees(spark, folder)).select("doc_id", "pre", "start", "stop")


@register("invert_children", TREE + """, k AS (SELECT n.doc_id, n.parent AS pre, n.start, n.stop, lag(n.stop, 1, p.start) OVER q AS prev, lead(n.start) OVER q AS nx, p.stop AS pstop FROM seg n JOIN seg p ON p.doc_id = n.doc_id AND p.pre = n.parent WINDOW q AS (PARTITION BY n.doc_id, n.parent ORDER BY n.ord))
SELECT doc_id, pre, prev AS start, start AS stop FROM k WHERE start > prev UNION ALL SELECT doc_id, pre, stop, pstop FROM k WHERE nx IS NULL AND pstop > stop UNION ALL SELECT doc_id, pre, start, stop FROM seg WHERE pre = last AND stop > start""")
def invert_children(spark: SparkSession, folder: str) -> DataFrame:
    return sg.invert_children(trees(spark, folder)).select("doc_id", "pre", "start", "stop")


@register("windowed_merge", TREE + """SELECT doc_id, min(start) AS start, max(stop) AS stop, CASE WHEN count(*) = 3 THEN 'three' ELSE 'word' END AS label
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM seg WHERE label = 'word') GROUP BY doc_id, CASE WHEN (k // 3 + 1) * 3 <= n THEN k // 3 ELSE k + n END""")
def windowed_merge(spark: SparkSession, folder: str) -> DataFrame:
    return sg.joined_windows_in_documents(trees(spark, folder), "word", 3, label="three").select("doc_id", "start", "stop", "label")


@register("run_reduce_islands", TREE + """, li AS (SELECT *, sum(CASE WHEN length(sub) < 30 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, ord) AS stretch, length(sub) >= 60 AS b FROM seg WHERE label = 'line'),
r AS (SELECT *, max(b) OVER (PARTITION BY doc_id, stretch ORDER BY start, ord) AS inside FROM li)
SELECT doc_id, min(start) AS start, max(stop) AS stop, CASE WHEN inside THEN 'run' ELSE 'line' END AS label FROM r GROUP BY doc_id, inside, CASE WHEN inside THEN stretch ELSE -1 - pre END""")
def run_reduce_islands(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("stop") - F.col("start")
    return sg.reduced_runs(tree(spark, folder).where("label = 'line'"), size >= 60, size < 30, label="run").select("doc_id", "start", "stop", "label")


@register("first_of_stages", TREE + "SELECT doc_id, start, stop, label FROM seg s WHERE label = 'word' AND starts_with(sub, 'z') OR label = 'line' AND NOT EXISTS (SELECT 1 FROM seg z WHERE z.doc_id = s.doc_id AND z.label = 'word' AND starts_with(z.sub, 'z'))")
def first_of_stages(spark: SparkSession, folder: str) -> DataFrame:
    own = tree(spark, folder)
    z = find_all("**[d:word] & [ssw:z]", trees(spark, folder), ordered=False)
    rows = [x.select("doc_id", "start", "stop", "label") for x in (z, own.where("label = 'line'"))]
    return sg.first_of(("doc_id",), *rows)


@register("canonical_paths", TREE + "SELECT s.doc_id, s.pre, CASE s.depth WHEN 0 THEN '.' WHEN 1 THEN './*[i:' || s.ord || ']' ELSE './*[i:' || p.ord || ']/*[i:' || s.ord || ']' END AS path FROM seg s LEFT JOIN seg p ON p.doc_id = s.doc_id AND p.pre = s.parent")
def canonical_paths(spark: SparkSession, folder: str) -> DataFrame:
    return sg.canonical_paths(trees(spark, folder))


# Aggregates over trees.
@register("documents_of_many_lines", TREE + "SELECT doc_id, count(*) AS n FROM seg WHERE label = 'line' GROUP BY doc_id HAVING count(*) >= 10")
def documents_of_many_lines(spark: SparkSession, folder: str) -> DataFrame:
    return tree(spark, folder).where("label = 'line'").groupBy("doc_id").agg(F.count("*").alias("n")).where("n >= 10")


@register("value_join", TREE + """, again AS (SELECT sub, count(DISTINCT doc_id) AS docs FROM seg WHERE label = 'line' AND sub <> '' GROUP BY sub HAVING count(DISTINCT doc_id) > 1)
SELECT l.doc_id, l.pre, a.docs FROM seg l JOIN again a ON l.sub = a.sub WHERE l.label = 'line'""")
def value_join(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that other documents hold too, with the number of documents."""
    lines = model.with_text(tree(spark, folder).where("label = 'line'"), docs(spark, folder))
    again = lines.where("substring <> ''").groupBy("substring").agg(F.countDistinct("doc_id").alias("docs")).where("docs > 1")
    return sg.value_join(lines, again, ()).select("doc_id", "pre", F.col("docs_r").alias("docs"))


@register("label_rollup", TREE + "SELECT doc_id, label, count(*) AS n, sum(stop - start)::BIGINT AS chars, grouping(doc_id, label) AS level FROM seg GROUP BY ROLLUP (doc_id, label)")
def label_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return sg.label_statistics(tree(spark, folder))


@register("topk_words", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents) WHERE w <> '' GROUP BY w ORDER BY n DESC, w LIMIT 20")
def topk_words(spark: SparkSession, folder: str) -> DataFrame:
    words = docs(spark, folder).select(F.explode(F.split(F.translate("text", "\n", " "), " ")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(20)


@register("pivot_roles", "SELECT conv_id, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns FROM conversations GROUP BY conv_id")
def pivot_roles(spark: SparkSession, folder: str) -> DataFrame:
    out = table(spark, folder, "conversations").groupBy("conv_id").pivot("role", ["user", "assistant"]).agg(F.count(F.lit(1)))
    return out.select("conv_id", *[F.coalesce(r, F.lit(0)).alias(f"{r}_turns") for r in ("user", "assistant")])


# Kernel stages.
@register("extract_groups", r"SELECT doc_id, 'pair' AS label, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+ [0-9]+')) FROM documents) GROUP BY doc_id UNION ALL SELECT doc_id, 'word', count(*) FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+ [0-9]+')) FROM documents) GROUP BY doc_id UNION ALL SELECT doc_id, 'digit', sum(len(regexp_extract_all(p, '[0-9]')))::BIGINT FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+ [0-9]+')) AS p FROM documents) GROUP BY doc_id")
def extract_groups(spark: SparkSession, folder: str) -> DataFrame:
    stage = stages.Extract("(?P<pair>(?P<word>[a-z]+) (?P<digit>[0-9])+)")
    return stages.segment(docs(spark, folder), stage).where("pre > 0").groupBy("doc_id", "label").agg(F.count("*").alias("n"))


@register("pipeline_edges", TREE + "SELECT doc_id, label, count(*) AS n FROM (SELECT doc_id, CASE WHEN label = 'line' THEN 'line' ELSE CASE WHEN regexp_matches(sub, '^[0-9]') THEN 'number' ELSE 'word' END END AS label FROM seg WHERE pre > 0 AND stop > start) GROUP BY ALL")
def pipeline_edges(spark: SparkSession, folder: str) -> DataFrame:
    number = lambda text, n: text[n.start] in "0123456789"
    word = stages.Split(" ", label="word").then(stages.Relabel("number"), number)
    # A line of blanks only has no words.
    lines = stages.Split("\n", label="line").children(word, lambda text, n: text[n.start : n.stop].strip(" ") != "")
    out = stages.segment(docs(spark, folder), lines).where("pre > 0 AND stop > start")
    return out.groupBy("doc_id", "label").agg(F.count("*").alias("n"))


@register("invert_stage", r"SELECT doc_id, count(*) AS n, sum(length(w))::BIGINT AS chars FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^0-9]+')) AS w FROM documents) GROUP BY doc_id")
def invert_stage(spark: SparkSession, folder: str) -> DataFrame:
    out = stages.segment(docs(spark, folder).where("text IS NOT NULL"), stages.Invert("[0-9]+", "rest")).where("label = 'rest' AND stop > start")
    return out.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).alias("chars"))


@register("nlp_counts")
def nlp_counts(spark: SparkSession, folder: str) -> DataFrame:
    return nlp.segment_nlp(docs(spark, folder)).groupBy("doc_id", "label").agg(F.count("*").alias("n"))


@register("flagship_sections")
def flagship_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences that mention a number and are not the first of their paragraph, with their words counted."""
    path = parse("**[d:sentence] & [i:1-]{*[d:number]}")

    def run(f: Forest) -> Iterator[pa.RecordBatch]:
        # Words are children of their sentence.
        words = np.bincount(f.up[f.is_label("word") & (f.up >= 0)], minlength=len(f))
        for part in Walker(f, {}).find(path, np.flatnonzero(f.pre == 0), False):
            yield from f.rows(["doc_id", "pre", "start", "stop"], part.node, {"words": pa.array(words[part.node], pa.int64())})

    return nlp.nlp_trees(docs(spark, folder)).each(run, "doc_id bigint, pre int, start int, stop int, words bigint")


#: Paragraphs and sentences of texts in which every line end is doubled, with blanks between.
_PARTS = r"""WITH d AS (SELECT doc_id, replace(text, chr(10), chr(10) || ' ' || chr(9) || chr(10)) AS text FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, string_split_regex(text, '(?:[ \t\r]*\n){2,}') AS piece, regexp_extract_all(text, '(?:[ \t\r]*\n){2,}') AS sep FROM d),
y AS (SELECT doc_id, unnest(piece) AS piece, generate_subscripts(piece, 1) AS k, sep FROM x),
z AS (SELECT doc_id, piece, sum(length(piece) + coalesce(length(sep[k]), 0)) OVER (PARTITION BY doc_id ORDER BY k) - length(piece) - coalesce(length(sep[k]), 0) AS a FROM y)
SELECT doc_id, a::INT AS start, (a + length(piece))::INT AS stop, 'paragraph' AS label FROM z WHERE piece <> ''"""


def spaced(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).where("text IS NOT NULL").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n \t\n")).alias("text"))


@register("paragraphs_native", _PARTS)
def paragraphs_native(spark: SparkSession, folder: str) -> DataFrame:
    return nlp.paragraph_spans(spaced(spark, folder))


@register("paragraphs_stage", _PARTS)
def paragraphs_stage(spark: SparkSession, folder: str) -> DataFrame:
    out = stages.segment(spaced(spark, folder), nlp.Paragraph().stage()).where("label = 'paragraph' AND stop > start")
    return out.select("doc_id", "start", "stop", "label")


_B = "".join(f"\\x{{{ord(c):x}}}" for c in nlp.BLANKS)
_SHUT, _OPEN = ("".join(f"\\x{{{ord(c):x}}}" for c in sorted(x)) for x in (nlp.CLOSING, nlp.OPENING))
_OR = lambda xs: "|".join(x.replace(".", "\\.") for x in xs)


@register("sentence_counts", rf"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^{_B}]+') AS w, regexp_extract_all(text, '[{_B}]+') AS g, CASE WHEN regexp_matches(text, '^[{_B}]') THEN 1 ELSE 0 END AS lead FROM documents WHERE length(text) > 0),
u AS (SELECT doc_id, w[i] AS w, w[i - 1] AS before, g[i - 1 + lead] AS gap_before, w[i + 1] AS nx, g[i + lead] AS gap, g[i + 1 + lead] AS gap_after FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM t)),
e AS (SELECT doc_id, (nx IS NOT NULL AND regexp_matches(w, '[\p{{L}}\p{{N}}\p{{M}}_](?:\.|\.{{3,}}|…|[!?]+)[{_SHUT}]*$') AND (length(gap) > 1
  OR (gap_after IS NOT NULL AND regexp_matches(nx, '^[{_OPEN}]*(?:{_OR(nlp.STARTS)})$'))
  OR (regexp_matches(nx, '^[{_OPEN}]*[A-Z\p{{Nd}}]') AND NOT regexp_matches(w, '(?:{_OR(nlp.ABBREVIATIONS)})$') AND NOT (regexp_matches(nx, '^\p{{Nd}}') AND regexp_matches(w, '(?:{_OR(nlp.BEFORE_NUMBERS)})$'))
    AND NOT (regexp_matches(w, 'U\.S\.$') AND starts_with(nx, 'Government')) AND NOT coalesce(regexp_matches(w, '^[A-Z]\.$') AND length(gap_before) = 1 AND regexp_matches(before, '[A-Z][a-z]+$') AND regexp_matches(nx, '^[A-Z][a-z]'), false)))) AS stop FROM u)
SELECT t.doc_id, 1 + coalesce(sum(stop::INT), 0)::BIGINT AS n FROM t LEFT JOIN e ON t.doc_id = e.doc_id GROUP BY t.doc_id""")
def sentence_counts(spark: SparkSession, folder: str) -> DataFrame:
    out = stages.segment(docs(spark, folder).where("length(text) > 0"), nlp.sentences()).where("label = 'sentence' AND stop > start")
    return out.groupBy("doc_id").agg(F.count("*").alias("n"))


@register("rule_hits", r"""SELECT doc_id, 'number' AS path, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) FROM documents) GROUP BY doc_id
UNION ALL SELECT doc_id, 'place/capital', count(*) FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'Paris|Madrid|Berlin|London')) FROM documents) GROUP BY doc_id""")
def rule_hits(spark: SparkSession, folder: str) -> DataFrame:
    rules = packs.Rules({("number",): ["[0-9]+"], ("place", "capital"): ["Paris|Madrid|Berlin|London"]})
    return packs.discover(docs(spark, folder), rules).groupBy("doc_id", F.array_join("path", "/").alias("path")).agg(F.count("*").alias("n"))


@register("html_tags", r"SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<[a-z][a-z0-9]*( [^<>]*)?>')) FROM pages) GROUP BY page_id")
def html_tags(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return stages.segment(pages, packs.html_tags()).where(F.col("label") == packs.START_TAG).groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("n"))


def order_xml(spark: SparkSession, folder: str) -> DataFrame:
    line = F.format_string('<line n="%d" q="%d"/>', F.col("l_linenumber").cast("int"), F.col("l_quantity").cast("int"))
    own = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "").alias("body"))
    return own.select(F.col("l_orderkey").alias("doc_id"), F.format_string('<o:order xmlns:o="urn:o" key="%d">%s</o:order>', F.col("l_orderkey").cast("long"), F.col("body")).alias("text"))


@register("xml_elements", "SELECT l_orderkey AS doc_id, 'line' AS local, count(*) AS n FROM lineitem GROUP BY l_orderkey UNION ALL SELECT DISTINCT l_orderkey, 'order', 1 FROM lineitem")
def xml_elements(spark: SparkSession, folder: str) -> DataFrame:
    return packs.elements(packs.xml_trees(order_xml(spark, folder))).groupBy("doc_id", "local").agg(F.count("*").alias("n"))


@register("xml_attributes", "SELECT l_orderkey AS doc_id, l_linenumber::VARCHAR AS value FROM lineitem")
def xml_attributes(spark: SparkSession, folder: str) -> DataFrame:
    return packs.attributes(packs.xml_trees(order_xml(spark, folder))).where("name = 'n'").select("doc_id", "value")


@register("table_rows", "SELECT o_custkey::BIGINT AS doc_id, count(*) AS n FROM orders GROUP BY o_custkey")
def table_rows(spark: SparkSession, folder: str) -> DataFrame:
    rule = "-----+-----"
    row = F.format_string(" %d | %s", F.col("o_orderkey").cast("long"), F.col("o_orderstatus"))
    own = table(spark, folder, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list(row)), f"\n{rule}\n").alias("rows"))
    own = own.select(F.col("o_custkey").cast("long").alias("doc_id"), F.concat(F.lit(f"{rule}\n"), "rows", F.lit(f"\n{rule}")).alias("text"))
    return packs.segment_tables(own, packs.TYPE_1).where("label = 'row'").groupBy("doc_id").agg(F.count("*").alias("n"))


@register("formatted_segments", TREE + "SELECT doc_id, pre, '(' || start || ', ' || stop || ') ' || label || ' : ' || CASE WHEN length(sub) > 12 THEN left(sub, 11) || '…' ELSE sub END AS line FROM seg WHERE label = 'word'")
def formatted_segments(spark: SparkSession, folder: str) -> DataFrame:
    rows = tree(spark, folder).where("label = 'word'").join(docs(spark, folder), "doc_id")
    return rows.select("doc_id", "pre", tx.formatted(F.col("text"), F.col("start"), F.col("stop"), F.col("label"), "%span %desc : %substr:12…").alias("line"))


@register("json_round_trip", TREE + "SELECT doc_id, pre, last, parent, depth, ord, start, stop, label FROM seg")
def json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return store.from_json(store.to_json(trees(spark, folder)))


@register("dumped_trees")
def dumped_trees(spark: SparkSession, folder: str) -> DataFrame:
    return store.dumped(trees(spark, folder), style="tree")


@register("stream_segments", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\n]+')) FROM documents) GROUP BY doc_id")
def stream_segments(spark: SparkSession, folder: str) -> DataFrame:
    from .streaming import segments_once

    return segments_once(spark, f"{folder}/documents.parquet", stages.Extract("(?P<word>[^ \n]+)")).where("label = 'word'").groupBy("doc_id").agg(F.count("*").alias("n"))
