"""License scans by ordered signature rules, in SQL expressions.

A gate finds the few texts that name a license at all. There, keywords choose the rules to try. Of the matches of all rules those that
lie inside another, or equal one of a stronger rule, are suppressed; of two that overlap in part, the weaker one is. Everything is worked
out within the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmix.llm.license_rules import GATE, RULES, Rule
from strandmix.llm.quality_rules import let

#: Word characters, as ASCII letters and digits and everything beyond ASCII.
_IN = r"0-9A-Za-z\x{80}-\x{10FFFF}"
#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_WORD = _sql(f"[{_IN}]+")


def _phrase(phrase: str) -> str:
    return _sql(f"(?i)(?<![{_IN}])" + f"[^{_IN}]+".join(phrase.split()) + f"(?![{_IN}])")


def _places(phrase: str) -> str:
    """SQL: number of places of a phrase, and the words before the first and behind the last."""
    return let(f"split(t, {_phrase(phrase)})", "p", f"struct(CAST(size(p) - 1 AS LONG) AS n, CAST(regexp_count(p[0], {_WORD}) AS LONG) AS before, CAST(regexp_count(element_at(p, -1), {_WORD}) AS LONG) AS behind)")


_ONE = "struct<start: int, less: int, priority: int, label: string, weight: double, end: int>"
_FOUND = f"array<{_ONE}>"
#: Elements of a list that are copied when one is added.
_CHUNK = 256
#: SQL: an empty list that grows by chunks, as an array would be copied as a whole with each element.
_EMPTY = f"CAST(array() AS {_FOUND}) AS now, CAST(array() AS array<{_FOUND}>) AS full"


def _with(state: str, x: str) -> str:
    """SQL: the fields of a growing list of a state with one more element."""
    return f"if(size({state}.now) < {_CHUNK}, array_append({state}.now, {x}), array({x})) AS now, if(size({state}.now) < {_CHUNK}, {state}.full, array_append({state}.full, {state}.now)) AS full"


def _same(state: str) -> str:
    return f"{state}.now AS now, {state}.full AS full"


def _all(state: str) -> str:
    """SQL: a growing list as an array."""
    return f"flatten(array_append({state}.full, {state}.now))"


def _detections(rules: str) -> str:
    """SQL: (start, end, priority, label, weight) of every match of a rule whose keyword occurs, by start, longest first, strongest first."""
    start = "a.at + length(p[a.i])"
    match = f"struct({start} AS start, -length(x) AS less, r.priority AS priority, r.label AS label, r.weight AS weight, {start} + length(x) AS end)"
    each = let(
        "regexp_extract_all(t, r.pattern, 0)",
        "m",
        let("split(t, r.pattern)", "p", f"aggregate(m, struct({_EMPTY}, 0 AS at, 0 AS i), (a, x) -> struct({_with('a', match)}, {start} + length(x) AS at, a.i + 1 AS i), a -> {_all('a')})"),
    )
    return f"array_sort(flatten(transform({let('lower(t)', 'lo', f'filter({rules}, r -> contains(lo, r.keyword))')}, r -> {each})))"


#: SQL: of sorted detections ``d``, those that end behind all before them, so that none lies inside another.
_OUTER = f"aggregate(d, struct({_EMPTY}, -1 AS end), (a, x) -> if(x.end <= a.end, a, struct({_with('a', 'x')}, x.end AS end)), a -> {_all('a')})"
#: SQL: of those, ``o``, from the left: each against the survivor before it; where they overlap the stronger one survives.
_KEPT = let(
    f"aggregate(o, struct({_EMPTY}, CAST(NULL AS {_ONE}) AS last), "
    f"(a, x) -> CASE WHEN a.last IS NULL THEN struct({_same('a')}, x AS last) WHEN x.start >= a.last.end THEN struct({_with('a', 'a.last')}, x AS last) "
    f"WHEN x.priority < a.last.priority THEN struct({_same('a')}, x AS last) ELSE a END)",
    "s",
    f"if(s.last IS NULL, {_all('s')}, array_append({_all('s')}, s.last))",
)
_SURVIVORS = let(_OUTER, "o", _KEPT)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, gate: str = GATE) -> DataFrame:
    """One row per input row: words, places of the base phrases, labels, the surviving detections and a score.

    ``n_base`` counts all places of the base phrases, ``first_word`` and ``last_word`` are the smallest and largest word at which one
    starts (null without one). ``labels`` has the base labels and those of the surviving detections. ``score`` is the largest weight
    of a detection, 0.5 where only base phrases were found, else 0. Null texts count as empty; null and repeated ids are kept as they
    are, as rows are scanned one by one and nothing is shuffled.
    """
    rules = RULES if rules is None else rules
    table = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    literal = "array(" + ", ".join(f"struct({_sql(x.label)} AS label, {_sql(x.keyword)} AS keyword, {_sql('(?i)' + x.pattern)} AS pattern, {x.priority} AS priority, CAST({x.weight} AS DOUBLE) AS weight)" for x in rules) + ")"
    none = f"CAST(array() AS {_FOUND})"
    names = list(PHRASES)
    base = ", ".join(f"if(named, {_places(x)}, struct(0L AS n, 0L AS before, 0L AS behind)) AS b{k}" for k, x in enumerate(names))
    table = table.selectExpr(id_col, "t", f"t RLIKE {_sql(gate + '|all[^a-z]+rights|cc[^a-z]+by')} AS named", f"CAST(regexp_count(t, {_WORD}) AS LONG) AS n_words")
    found = table.selectExpr(id_col, "n_words", f"struct({base}) AS b", f"if(named, {let(_detections(literal), 'd', _SURVIVORS)}, {none}) AS d")
    size = {x: len(x.split()) for x in names}
    firsts = ", ".join(f"if(b.b{k}.n > 0, b.b{k}.before, NULL)" for k in range(len(names)))
    lasts = ", ".join(f"if(b.b{k}.n > 0, n_words - b.b{k}.behind - {size[x]}, NULL)" for k, x in enumerate(names))
    own = ", ".join(f"if(b.b{k}.n > 0, '{PHRASES[x]}', NULL)" for k, x in enumerate(names))
    return found.selectExpr(
        id_col,
        "n_words",
        "b.b0.n + b.b1.n + b.b2.n AS n_base",
        f"array_min(array({firsts})) AS first_word",
        f"array_max(array({lasts})) AS last_word",
        f"array_join(array_sort(array_compact(array({own}))), ',') AS base_labels",
        f"array_join(array_sort(array_distinct(concat(array_compact(array({own})), transform(d, x -> x.label)))), ',') AS labels",
        "CAST(coalesce(array_max(transform(d, x -> x.weight)), if(b.b0.n + b.b1.n + b.b2.n > 0, 0.5D, 0D)) AS DOUBLE) AS score",
        "array_join(transform(d, x -> concat_ws(':', x.label, x.start, x.end)), ',') AS detections",
    )


def _phrase_sql(phrase: str) -> str:
    words = phrase.split()
    return f"[i FOR i IN range(1, len(w) + 1) IF {' AND '.join(f'w[i + {k}] = {chr(39)}{x}{chr(39)}' for k, x in enumerate(words))}]"


#: Words and base phrases alone; the signatures are beyond SQL of this size.
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, {", ".join(f"{_phrase_sql(x)} AS p{k}" for k, x in enumerate(PHRASES))} FROM d)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(p0) + len(p1) + len(p2) AS BIGINT) AS n_base, CAST(list_min(p0 || p1 || p2) - 1 AS BIGINT) AS first_word, CAST(list_max(p0 || p1 || p2) - 1 AS BIGINT) AS last_word,
  array_to_string([x FOR x IN list_sort([{", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(PHRASES.values()))}]) IF x IS NOT NULL], ',') AS base_labels FROM p
"""
