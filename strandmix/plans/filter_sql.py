"""SQL for digital filters: recursion over a series' rows, one section of a filter after another."""

from __future__ import annotations

import numpy as np

from strandmix.functions.iir import padding


def _number(x: float) -> str:
    """A literal that SQL reads as a double."""
    return f"({float(x):.17e})"


def _step(sections: np.ndarray, source: str) -> str:
    """SELECT of the next row's states and output from ``source``, which has the row, its value ``v`` and the states (a, b) of each section."""
    states = [f"a{k}, b{k}" for k in range(len(sections))]
    out, given = source, "v"
    for k, (b0, *_) in enumerate(sections):
        out = f"(SELECT *, {_number(b0)} * {given} + a{k} AS y{k} FROM {out})"
        given = f"y{k}"
    new, given = [], "v"
    for k, (_, b1, b2, a1, a2) in enumerate(sections):
        new.append(f"{_number(b1)} * {given} - {_number(a1)} * y{k} + b{k} AS a{k}, {_number(b2)} * {given} - {_number(a2)} * y{k} AS b{k}")
        given = f"y{k}"
    assert len(states) == len(new)
    return f"SELECT subject_id, p, {', '.join(new)}, {given} AS y FROM {out}"


def run_sql(name: str, source: str, sections: np.ndarray) -> str:
    """CTE ``name`` (subject_id, p, y): one run from rest over ``source`` (subject_id, p from 1, v)."""
    rest = ", ".join(f"CAST(0 AS DOUBLE) AS a{k}, CAST(0 AS DOUBLE) AS b{k}" for k in range(len(sections)))
    states = ", ".join(f"s.a{k}, s.b{k}" for k in range(len(sections)))
    first = _step(sections, f"(SELECT subject_id, p, v, {rest} FROM {source} WHERE p = 1)")
    after = _step(sections, f"(SELECT x.subject_id, x.p, x.v, {states} FROM {name} s JOIN {source} x ON x.subject_id = s.subject_id AND x.p = s.p + 1)")
    return f"{name} AS ({first} UNION ALL {after})"


def both_ways_sql(name: str, source: str, sections: np.ndarray) -> str:
    """CTEs that end in ``name`` (subject_id, t, x): ``source``, with the same columns, filtered forward and backward; nulls count as 0 and stay."""
    n, e, f, b, g = (f"{name}_{x}" for x in "nefbg")
    return ", ".join(
        [
            f"{n} AS (SELECT subject_id, count(*) AS n, least(count(*) - 1, {padding(sections)}) AS pad, max(CASE WHEN t = 1 THEN coalesce(x, 0) END) AS x1, arg_max(coalesce(x, 0), t) AS xn FROM {source} GROUP BY 1)",
            f"{e} AS (SELECT s.subject_id, t + pad AS p, coalesce(x, 0) AS v FROM {source} s JOIN {n} n ON s.subject_id = n.subject_id "
            f"UNION ALL SELECT s.subject_id, pad + 2 - t, 2 * x1 - coalesce(x, 0) FROM {source} s JOIN {n} n ON s.subject_id = n.subject_id WHERE t BETWEEN 2 AND pad + 1 "
            f"UNION ALL SELECT s.subject_id, pad + 2 * n - t, 2 * xn - coalesce(x, 0) FROM {source} s JOIN {n} n ON s.subject_id = n.subject_id WHERE t BETWEEN n - pad AND n - 1)",
            run_sql(f, e, sections),
            f"{b} AS (SELECT f.subject_id, n + 2 * pad + 1 - p AS p, y AS v FROM {f} f JOIN {n} n ON f.subject_id = n.subject_id)",
            run_sql(g, b, sections),
            f"{name} AS (SELECT s.subject_id, s.t, CASE WHEN s.x IS NOT NULL THEN g.y END AS x FROM {source} s JOIN {n} n ON s.subject_id = n.subject_id JOIN {g} g ON g.subject_id = s.subject_id AND g.p = n + pad + 1 - s.t)",
        ]
    )
