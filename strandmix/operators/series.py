"""Whole series in time order: several steps in one pass over sorted rows, and filters over series of any length in blocks of time.

Rows come sorted by subject and time and go through Arrow batches. Series of up to WHOLE values are worked on whole, all steps at once.
In panels with longer ones, all series are filtered in blocks that run side by side and hand on their states; memory is bounded by a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandmix.functions import iir
from strandmix.sources.panel import Panel

#: Values of a series, rows times channels, that a task may hold at once.
WHOLE = 1 << 22
#: Rows of a block of a longer series.
BLOCK_ROWS = 1 << 17
#: Stands for a null subject inside.
NOBODY = -(1 << 63)

#: From (times, rows by channels, further columns of the first row) to rows by channels; NaN is missing.
Step = Callable[[np.ndarray, np.ndarray, dict], np.ndarray]


def longest(panel: Panel) -> int:
    """Values of the longest series."""
    return (panel.df.groupBy("subject_id").count().agg(F.max("count")).first()[0] or 0) * len(panel.channels)


def _array(values: np.ndarray) -> pa.Array:
    return pa.array(values, type=pa.float64(), mask=np.isnan(values))


def _runs(batches) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of batches that belong to one subject each, and the subject."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.asarray(batch.column(0).fill_null(NOBODY))
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            yield int(ids[a]), batch.slice(a, b - a)


def _values(part, channels) -> np.ndarray:
    """Rows by channels; null is NaN."""
    return np.stack([np.asarray(part.column(c).to_numpy(zero_copy_only=False), dtype=float) for c in channels], axis=1)


def in_one_pass(panel: Panel, steps: list[Step], extra: tuple[str, ...] = ()) -> Panel:
    """The panel's rows after all steps, a series at a time. ``extra`` columns, equal in all rows of a subject, reach the steps."""
    channels = list(panel.channels)

    def run(batches):
        def done(parts):
            rows = pa.Table.from_batches(parts).combine_chunks()
            first = {c: rows.column(c)[0].as_py() for c in extra}
            t, x = rows.column("t").to_numpy(), np.concatenate([_values(p, channels) for p in parts])
            for step in steps:
                x = step(t, x, first)
            return rows.column("subject_id").chunk(0), rows.column("t").chunk(0), x

        def together(found):
            ids, times, x = zip(*found)
            x = np.concatenate(x)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(times), *(_array(x[:, k]) for k in range(len(channels)))], names=["subject_id", "t", *channels])

        at, parts, found, size = None, [], [], 0
        for subject, part in _runs(batches):
            if subject != at and parts:
                found.append(done(parts))
                parts = []
                size += len(found[-1][2])
                if size >= 10_000:
                    yield together(found)
                    found, size = [], 0
            at = subject
            parts.append(part)
        if parts:
            found.append(done(parts))
        if found:
            yield together(found)

    rows = panel.in_order(*channels, *extra)
    return Panel(rows.mapInArrow(run, rows.select("subject_id", "t", *channels).schema), panel.channels, True)


def _state_after(states: pa.Table, system: iir.System, length: str, offset: str, back: bool) -> np.ndarray:
    """(blocks, order, channels): the state in which each block of one series begins, from the rows and the own state of all of them.

    A block maps the state s that it begins with to A^m s + v: m are its rows, v is where it ends if it begins at rest. So states follow
    from block to block, and only these small maps of a series come together.
    """
    blocks = states.num_rows
    v = np.array(states.column(offset).to_pylist(), dtype=float).reshape(blocks, system.order, -1)
    out, state = np.zeros_like(v), np.zeros(v.shape[1:])
    powers: dict[int, np.ndarray] = {}
    for k in range(blocks - 1, -1, -1) if back else range(blocks):
        out[k] = state
        m = states.column(length)[k].as_py()
        if m not in powers:
            powers[m] = np.linalg.matrix_power(system.powers[1], m)
        state = powers[m] @ state + v[k]
    return out


def filtered_in_blocks(panel: Panel, sections: np.ndarray, zero_phase: bool, size: int = BLOCK_ROWS) -> Panel:
    """A filter over series of any length, in blocks of time that run side by side, forward and backward.

    Each block is run from rest to see where it ends; the states in which blocks begin follow from those ends alone; then every block runs again
    from its own. Backward it is the same over what the forward run gives, which is computed anew where it is needed, so only states travel.
    The first block also runs over what continues the series before it, the last one over what continues it behind. A series has as many blocks as
    whole ones fit into it, so its last block has a whole one's rows at least. A task holds one block, and a series' maps, a state for each block.
    """
    channels, system = list(panel.channels), iir.system(sections)
    pad = iir.padding(sections) if zero_phase else 0
    size = max(size, pad + 1)
    counts = panel.df.groupBy(F.col("subject_id").alias("s__")).agg(F.count("*").alias("n__"))
    rows = panel.df.select("subject_id", "t", *channels).join(counts, F.col("subject_id").eqNullSafe(F.col("s__"))).drop("s__")
    last = F.greatest(F.floor(F.col("n__") / size) - 1, F.lit(0))
    rows = rows.withColumn("block__", F.least(F.floor((F.col("t") - 1) / size), last)).withColumn("last__", last)
    keys = ["subject_id", "block__"]

    def read(part: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, int, int]:
        """Rows in time order, their values with 0 for missing ones, what is missing, and the rows that continue them before and behind."""
        part = part.sort_by("t").combine_chunks()
        x = _values(part, channels)
        gone = np.isnan(x)
        x = np.where(gone, 0.0, x)
        at, n = part.column("block__")[0].as_py(), part.column("n__")[0].as_py()
        own = min(pad, n - 1)
        front = iir.before(x, own) if at == 0 and own else x[:0]
        end = iir.behind(x, own) if at == part.column("last__")[0].as_py() and own else x[:0]
        return part, np.concatenate([front, x, end]), gone, len(front), len(end)

    def states(key, names, columns) -> pa.Table:
        return pa.table({"subject_id": pa.array([key[0].as_py()], pa.int64()), "block__": pa.array([key[1].as_py()], pa.int64()), **{n: pa.array([c]) for n, c in zip(names, columns)}})

    def ends(key, part):
        _, x, _, _, _ = read(part)
        return states(key, ("m", "v"), (len(x), system.run(x, system.rest(x.shape[1]))[1].ravel().tolist()))

    def begins(back: bool):
        def run(key, found):
            found = found.sort_by("block__").combine_chunks()
            own = _state_after(found, system, "m", "v", back)
            kept = found.column("start") if back else None
            named = {"start": kept, "back": pa.array([x.ravel().tolist() for x in own])} if back else {"start": pa.array([x.ravel().tolist() for x in own])}
            return pa.table({"subject_id": found.column("subject_id"), "block__": found.column("block__"), **named})

        return run

    def forward(part: pa.Table, state: pa.Table):
        part, x, gone, front, end = read(part)
        y, _ = system.run(x, np.array(state.column("start")[0].as_py()).reshape(system.order, -1))
        return part, y[front:], gone, end

    def ends_back(key, part, state):
        _, y, _, _ = forward(part, state)
        return states(key, ("m", "v", "start"), (len(y), system.run(y[::-1], system.rest(y.shape[1]))[1].ravel().tolist(), state.column("start")[0].as_py()))

    def finish(key, part, state):
        part, y, gone, end = forward(part, state)
        if zero_phase:
            y = system.run(y[::-1], np.array(state.column("back")[0].as_py()).reshape(system.order, -1))[0][::-1]
        y = np.where(gone, np.nan, y[: len(gone)])
        return pa.table({"subject_id": part.column("subject_id"), "t": part.column("t"), **{c: _array(y[:, k]) for k, c in enumerate(channels)}})

    own = "subject_id long, block__ long"
    given = rows.groupBy(*keys).applyInArrow(ends, f"{own}, m long, v array<double>").groupBy("subject_id").applyInArrow(begins(False), f"{own}, start array<double>")
    if zero_phase:
        given = rows.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInArrow(ends_back, f"{own}, m long, v array<double>, start array<double>")
        given = given.groupBy("subject_id").applyInArrow(begins(True), f"{own}, start array<double>, back array<double>")
    kinds = dict(panel.df.dtypes)
    schema = f"subject_id {kinds['subject_id']}, t {kinds['t']}, " + ", ".join(f"{c} double" for c in channels)
    return Panel(rows.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInArrow(finish, schema), panel.channels)


def filtered(panel: Panel, sections: np.ndarray, zero_phase: bool) -> Panel:
    """A rational filter over each subject's whole series in time order."""
    if longest(panel) > WHOLE:
        return filtered_in_blocks(panel, sections, zero_phase)
    run = iir.filtfilt if zero_phase else iir.sosfilt
    return in_one_pass(panel, [lambda t, x, first: run(sections, x)])
