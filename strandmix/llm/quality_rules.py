"""Quality rules in SQL expressions: rules on a document by itself, and the frequency of its lines across documents of a host.

Lines are normalised and hashed; distinct documents are counted per host and line; lines above a limit are removed, and documents that
keep too little are rejected. What counts are groups of near copies: else a group would make its own lines frequent, and all of it would go
before one can be kept. Equal texts of a host are one document to begin with. Of documents with a line that is frequent by that count, the
least of each of four hashes over a quarter of their 5-word windows is taken; near copies mostly agree in it. A line's groups are its distinct
values of a hash, by the hash that has fewest, so copies that lost one of the four to a change still are one group by another.

The limit is a share of the host's documents or an absolute number, whichever is lower: so neither do three documents of a small host nor
a thousand among millions escape, and the rule means the same at any size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmix.llm import sized
from strandmix.llm.sized import counted, sized_join

#: Groups of documents of a host that may share a line: so many in any case, and beyond that so many percent of the host's documents, but no
#: more than MOST. Percent of words that must stay.
MAX_DOCUMENTS, MAX_PERCENT, MOST, MIN_PERCENT = 2, 2, 500, 50


@dataclass(frozen=True)
class Limits:
    """Groups that may share a line: so many in any case, and beyond that so many percent of the host's documents, but no more than ``most``."""

    documents: int = MAX_DOCUMENTS
    percent: int = MAX_PERCENT
    most: int = MOST


#: What stands for a document itself among its lines.
WHOLE = 0

_SPACE = r"[\\x20\\x09-\\x0D]+"
_WORDS = f"array_remove(split(text, '{_SPACE}'), '')"


def let(value: str, name: str, body: str) -> str:
    """SQL that computes ``value`` once and names it in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: Words covered by 5-word windows that occur twice or more: windows are hashed; only a text with equal hashes is sorted to find them.
_REPEATED = let(
    "if(size(w) < 5, array(), transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])))",
    "g",
    "if(size(array_distinct(g)) = size(g), 0L, "
    + let(
        "array_sort(transform(g, (x, i) -> struct(x AS g, i AS i)))",
        "s",
        let(
            "array_sort(transform(filter(s, (x, i) -> coalesce(get(s, i - 1).g = x.g, false) OR coalesce(get(s, i + 1).g = x.g, false)), x -> x.i))",
            "p",
            "aggregate(p, struct(0L AS n, 0 AS e), (a, i) -> struct(a.n + i + 5 - greatest(a.e, i) AS n, i + 5 AS e), a -> a.n)",
        ),
    )
    + ")",
)


def base_columns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the rules on a document by itself in a struct column ``rule_stats``; null texts have no words."""
    stats = let(
        _WORDS,
        "w",
        f"struct(CAST(size(w) AS LONG) AS n_words, CAST(length(regexp_replace(text, '{_SPACE}', '')) AS LONG) AS word_chars, "
        "CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '')) AS LONG) AS n_symbols, "
        + let(r"filter(split(text, '\\n'), x -> rlike(x, '[^\\x20\\x09-\\x0D]'))", "l", "CAST(size(l) - size(array_distinct(l)) AS LONG)")
        + f" AS n_dup_lines, {_REPEATED} AS n_repeat_words)",
    )
    text = f"coalesce(CAST(`{text_col}` AS STRING), '')"
    return docs.withColumn("rule_stats", F.expr(f"transform(array({text}), text -> {stats})[0]"))


def base_failed(stats: Column) -> Column:
    """Under 10 words, or over a fifth of them repeated."""
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


def text_key(text_col: str) -> Column:
    """Equal for equal texts: 128 bits of two hashes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _above(count: Column, documents: Column, limits: Limits) -> Column:
    return (count > limits.documents) & ((100 * count > limits.percent * documents) | (count > limits.most))


def frequent_lines(lines: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(host, line, documents) with more distinct documents than the limits let pass; ``documents`` are the host's.

    ``lines`` has (host, line, key), and a row with line WHOLE for each document. Counts combine before they are shuffled, and a host's
    documents are counted like one more line, so no host is gathered.
    """
    counts = lines.select("host", "line", "key").distinct().groupBy("host", "line").count()
    several, _ = counted(counts.where(F.col("count") > limits.documents))
    hosts = several.where(F.col("line") == WHOLE).select("host", F.col("count").alias("documents"))
    joined = sized_join(several.where(F.col("line") != WHOLE), hosts, "host", "inner", hosts.count())
    return joined.where(_above(F.col("count"), F.col("documents"), limits)).select("host", "line", "documents")


#: SQL: the least of four hashes over 5-word windows of a text: the same 128 bits from four places on. A quarter of the windows count, told by
#: the lengths of their first and last words; a text without such a window has the hash of all its words.
_LEAST = let(
    _WORDS,
    "w",
    let(
        "if(size(w) < 5, array(), transform(filter(sequence(0, size(w) - 5), i -> (length(w[i]) + length(w[i + 4])) % 4 = 0), i -> md5(concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))))",
        "f",
        let("if(size(f) = 0, array(md5(array_join(w, ' '))), f)", "g", "transform(array(0, 8, 16, 24), k -> array_min(transform(g, x -> concat(substring(x, k + 1), substring(x, 1, k)))))"),
    ),
)


def _by_groups(found: DataFrame, docs: DataFrame, rows: int, text_col: str, host_col: str, limits: Limits) -> DataFrame:
    """(host, line): the lines found whose groups of near copies are more than the limits let pass. Only documents that have such a line are looked at."""
    own = _kept(docs, text_col, host_col)
    if rows <= sized.SMALL:
        by_host = found.groupBy("host").agg(F.collect_set("line").alias("lines"))
        mine = let(_NORM, "m", "array_intersect(lines, transform(m, x -> if(xxhash64(x) = 0, 1L, xxhash64(x))))")
        having = own.join(F.broadcast(by_host), "host").withColumn("mine", F.expr(mine)).where("size(mine) > 0").select("host", "text", F.explode("mine").alias("line"))
    else:
        hit = lines_of(docs, text_col, host_col).join(found.select("host", "line").hint("merge"), ["host", "line"]).select("host", "key", "line").distinct()
        having = own.join(hit.hint("merge"), ["host", "key"]).select("host", "text", "line")
    least = having.select("host", "line", F.expr(_LEAST).alias("least"))
    groups = least.groupBy("host", "line").agg(*(F.count_distinct(F.col("least")[k]).alias(f"g{k}") for k in range(4)))
    fewest = groups.select("host", "line", F.least("g0", "g1", "g2", "g3").alias("groups"))
    return sized_join(found, fewest, ["host", "line"], "inner", rows).where(_above(F.col("groups"), F.col("documents"), limits)).select("host", "line")


def _kept(docs: DataFrame, text_col: str, host_col: str, *more) -> DataFrame:
    return docs.select(*more, F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), text_key(text_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


#: SQL: the normal form of each line: lower case, runs of digits as 0, runs of blanks as one.
_NORM = r"transform(split(text, '\\n'), x -> trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0'), '[\\x20\\x09-\\x0D]+', ' ')))"


def lines_of(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(host, key, pos, line, words): the hashed normal form of each line, of any length. A null host is a host, the empty one."""
    lines = _kept(docs, text_col, host_col).select("host", "key", F.posexplode(F.expr(_NORM)).alias("pos", "norm")).where("norm != ''")
    return lines.select("host", "key", "pos", _line("norm").alias("line"), (F.length("norm") - F.length(F.regexp_replace("norm", " ", "")) + 1).cast("long").alias("words"))


def _line(norm: str) -> Column:
    """Hash of a line, which is never WHOLE."""
    return F.when(F.xxhash64(norm) == WHOLE, F.lit(1)).otherwise(F.xxhash64(norm))


def documents_of_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(host, key, line): each document's distinct lines once, and WHOLE for the document itself."""
    norms = F.expr(f"array_union(array(''), {_NORM})")
    lines = _kept(docs, text_col, host_col).select("host", "key", F.explode(norms).alias("norm"))
    return lines.select("host", "key", F.when(F.col("norm") == "", F.lit(WHOLE)).otherwise(_line("norm")).alias("line"))


#: SQL: of a text on whose host ``lines`` are frequent, the places of these and their words.
_HITS = let(
    _NORM,
    "m",
    "transform(filter(transform(m, (x, i) -> struct(i AS i, x AS x)), s -> s.x != '' AND array_contains(lines, if(xxhash64(s.x) = 0, 1L, xxhash64(s.x)))), "
    "s -> struct(s.i AS i, CAST(length(s.x) - length(replace(s.x, ' ', '')) + 1 AS LONG) AS w))",
)


def _marked(table: DataFrame, docs: DataFrame, text_col: str, host_col: str, limits: Limits) -> DataFrame:
    """``table``, which has host, key and text, with (removed, places): words in frequent lines and where these stand; null without any.

    Frequent lines are few and are broadcast by host; documents then find theirs in place and aren't shuffled. Were they more than may
    be broadcast, lines would be joined, and what they find would be joined to documents by host and key.
    """
    found, n = counted(frequent_lines(documents_of_lines(docs, text_col, host_col), limits))
    frequent, n = counted(_by_groups(found, docs, n, text_col, host_col, limits))
    if n <= sized.SMALL:
        by_host = frequent.groupBy("host").agg(F.collect_list("line").alias("lines"))
        marked = table.join(F.broadcast(by_host), "host", "left").withColumn("hits", F.expr(f"if(lines IS NULL, NULL, {_HITS})")).withColumn("hits", F.expr("if(size(hits) > 0, hits, NULL)"))
        return marked.withColumns({"removed": F.expr("aggregate(hits, 0L, (a, h) -> a + h.w)"), "places": F.col("hits.i")}).drop("lines", "hits")
    hit = lines_of(docs, text_col, host_col).join(frequent.hint("merge"), ["host", "line"])
    found = hit.groupBy("host", "key", "pos").agg(F.max("words").alias("words")).groupBy("host", "key").agg(F.sum("words").alias("removed"), F.sort_array(F.collect_list("pos")).alias("places"))
    return table.join(found.hint("merge"), ["host", "key"], "left")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_documents: int = MAX_DOCUMENTS, max_percent: int = MAX_PERCENT, most: int = MOST, min_percent: int = MIN_PERCENT) -> DataFrame:
    """One row per input row: the rules' figures, base_failed, removed_words, kept.

    ``kept`` is false where base_failed, or where less than ``min_percent`` percent of the words stay when frequent lines go. Null texts have no
    words and fail. Null or repeated ids are judged row by row, as nothing is joined by id.
    """
    # Rows travel under names of their own until the end, so that the id's name can't clash.
    own = _kept(docs.withColumn("rule_id", F.col(id_col).cast("long")), text_col, host_col, "rule_id")
    joined = base_columns(_marked(own, docs, text_col, host_col, Limits(max_documents, max_percent, most))).select(F.col("rule_id").alias(id_col), "rule_stats.*", F.coalesce("removed", F.lit(0)).cast("long").alias("removed_words"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = ~failed & (100 * (F.col("n_words") - F.col("removed_words")) >= min_percent * F.col("n_words"))
    return joined.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "removed_words")


def _good(docs: DataFrame, text_col: str, host_col: str, limits: Limits, min_percent: int) -> DataFrame:
    """(row, places): the rows that ``judge`` keeps, and the sorted places of their frequent lines, null where there are none."""
    # Rows travel as one column, so that their names can't clash with the figures.
    whole = _kept(docs, text_col, host_col, F.struct("*").alias("row"))
    good = base_columns(whole).where(~base_failed(F.col("rule_stats")))
    marked = _marked(good, docs, text_col, host_col, limits)
    left = 100 * (F.col("rule_stats.n_words") - F.coalesce("removed", F.lit(0))) >= min_percent * F.col("rule_stats.n_words")
    return marked.where(left).select("row", "places")


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_documents: int = MAX_DOCUMENTS, max_percent: int = MAX_PERCENT, most: int = MOST, min_percent: int = MIN_PERCENT) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns as they are."""
    return _good(docs, text_col, host_col, Limits(max_documents, max_percent, most), min_percent).select("row.*")


def clean(docs: DataFrame, text_col: str = "text", host_col: str = "source", chars_col: str | None = None, max_documents: int = MAX_DOCUMENTS, max_percent: int = MAX_PERCENT, most: int = MOST, min_percent: int = MIN_PERCENT) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, their texts without frequent lines; other lines stay as they are, in their order.

    ``chars_col``, where given and present, becomes the new length of a text that changed.
    """
    good = _good(docs, text_col, host_col, Limits(max_documents, max_percent, most), min_percent)
    # What lies between two places that go stays: linear in the lines of a text.
    stays = let(
        r"split(text, '\\n')",
        "l",
        let("concat(array(-1), places, array(size(l)))", "p", "array_join(flatten(transform(sequence(1, size(p) - 1), i -> slice(l, p[i - 1] + 2, p[i] - p[i - 1] - 1))), '\n')"),
    )
    old = f"CAST(row.`{text_col}` AS STRING)"
    new = good.withColumn("new", F.expr(f"if(places IS NULL, {old}, {let(old, 'text', stays)})"))
    kinds = dict(docs.dtypes)
    changed = {text_col: F.col("new").cast(kinds[text_col])}
    if chars_col in docs.columns:
        changed[chars_col] = F.when(F.col("places").isNull(), F.col(f"row.`{chars_col}`")).otherwise(F.length("new").cast(kinds[chars_col]))
    return new.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 3, 1))) AS i, w FROM d),
k AS (SELECT doc_id, i, [w[i], w[i+1], w[i+2], w[i+3], w[i+4]] AS gram FROM g),
r AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest(range(0, 5)) AS o) GROUP BY doc_id),
l AS (SELECT doc_id, host, md5(text) AS t, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, host, t, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM l),
s AS (SELECT *, len(norm) - len(replace(norm, ' ', '')) + 1 AS words FROM m WHERE norm <> ''),
h AS (SELECT host, count(DISTINCT md5(text)) AS documents FROM d GROUP BY 1),
f0 AS (SELECT host, norm, documents FROM (SELECT host, norm, count(DISTINCT t) AS n FROM s GROUP BY 1, 2) JOIN h USING (host) WHERE n > 2 AND (100 * n > 2 * documents OR n > 500)),
hit AS (SELECT DISTINCT doc_id, host, norm, documents FROM s JOIN f0 USING (host, norm)),
a0 AS (SELECT doc_id, w, list_transform(list_filter(range(1, greatest(len(w) - 3, 1)), lambda i: (len(w[i]) + len(w[i+4])) % 4 = 0), lambda i: md5(concat_ws(' ', w[i], w[i+1], w[i+2], w[i+3], w[i+4]))) AS f FROM d WHERE doc_id IN (SELECT doc_id FROM hit)),
a AS (SELECT doc_id, CASE WHEN len(f) = 0 THEN [md5(array_to_string(w, ' '))] ELSE f END AS g FROM a0),
o AS (SELECT doc_id, list_min(g) AS g0, list_min(list_transform(g, lambda x: x[9:] || x[:8])) AS g1, list_min(list_transform(g, lambda x: x[17:] || x[:16])) AS g2, list_min(list_transform(g, lambda x: x[25:] || x[:24])) AS g3 FROM a),
p AS (SELECT host, norm, any_value(documents) AS documents, least(count(DISTINCT g0), count(DISTINCT g1), count(DISTINCT g2), count(DISTINCT g3)) AS n FROM hit JOIN o USING (doc_id) GROUP BY 1, 2),
f AS (SELECT host, norm FROM p WHERE n > 2 AND (100 * n > 2 * documents OR n > 500)),
x AS (SELECT doc_id, sum(words) AS n FROM s JOIN f USING (host, norm) GROUP BY doc_id),
b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(x.n, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN x ON d.doc_id = x.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * (n_words - removed_words) >= 50 * n_words) AS kept, removed_words FROM b
"""
