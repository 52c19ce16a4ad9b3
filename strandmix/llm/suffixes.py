"""Removal of repeated byte strings by sorted suffixes.

A byte goes if a string of ``DEPTH`` bytes covers it that also starts in a document with a smaller id. Four steps, none of which brings
a group of copies or the corpus together in one place:

1. Equal texts are one text with the smallest id of all; what else has it repeats it whole.
2. The anchor of a string of 50 bytes is the least hash among the pieces of 24 bytes in it, so equal strings have equal anchors, and
   neighbouring strings mostly share one. Only anchors travel: tasks by hash range tell those found in several documents.
3. The strings of such an anchor are cut out of the text as segments of overlapping strings and go to the task of the anchor's range. Its
   suffixes are sorted in two stages: those smaller than their successors directly, the others by a scan over the buckets of first
   bytes. Adjacent suffixes with a common prefix of 50 bytes are the same string; the smallest id among them owns it.
4. Spans of strings that have another owner go back to their texts, where they are united and cut out.

Equal segments of a block of text are one, owned by the smallest id, before they leave it; strings of an anchor with more than ``HOT``
segments travel by themselves, under their own hash, so no anchor fills a task.

Nulls: a null text is an empty one. A null id is larger than all others: nothing goes because of such a document. Rows with one id don't
repeat each other; each row has its result. Strings never cross texts, and texts of under 50 bytes stay as they are. Equal rows have equal
results; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmix.llm.batches import bounded, chunks, tidied
from strandmix.llm.storage import discard, written

#: Bytes of a string that may not repeat; of the pieces that anchors are chosen from.
DEPTH, PIECE = 50, 24
#: Bytes of text in a bucket of documents and in an anchors' range; positions that a task looks at together; bytes of segments sorted together.
BUCKET_BYTES, RANGE_BYTES, TILE, SORT_BYTES = 8 << 20, 16 << 20, 1 << 20, 4 << 20
#: Segments beyond which the strings of an anchor travel by themselves.
HOT = 200_000
NO_ID = (1 << 63) - 1

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


# --- sorting ------------------------------------------------------------------------------------------------------------------------


def _words(data: np.ndarray, at: int, n: int) -> np.ndarray:
    """The 8 bytes at each of n positions from ``at``, as a number."""
    return np.ndarray((n,), np.uint64, data, at, (1,)).astype(np.uint64)


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than the one that begins a byte later; the last one counts as such."""
    n = len(text)
    rises = np.ones(n, dtype=bool)
    rises[:-1] = text[:-1] < text[1:]
    decided = np.ones(n, dtype=bool)
    decided[:-1] = text[:-1] != text[1:]
    at = np.flatnonzero(decided)
    return rises[at[np.searchsorted(at, np.arange(n))]] if len(at) < n else rises


def sorted_suffixes(text: np.ndarray, wanted: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The wanted positions in the order of the suffixes there, by ``depth`` bytes at least; equal ones in any order.

    ``text`` ends with a zero byte, ``wanted`` is a mask. Suffixes smaller than their successor are sorted directly. Every other one
    stands, within the bucket of its first byte, in the order of its successor, and before all smaller ones: a scan over the buckets
    from the least byte on, in which each bucket is complete when it is reached, deals out what precedes its suffixes.
    """
    n = len(text)
    small = smaller_than_next(text)
    ends = np.flatnonzero(small)
    starts = np.flatnonzero(wanted)
    mark = np.zeros(n + 1, dtype=np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, ends[np.searchsorted(ends, starts)] + 1, -1)
    needed = np.cumsum(mark[:n]) > 0
    direct = np.flatnonzero(needed & small)
    padded = np.concatenate([text, np.zeros(depth, dtype=np.uint8)])
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]).view(f"S{depth}").ravel()
    direct = direct[np.argsort(keys)]
    breaks = np.ones(n, dtype=bool)
    breaks[1:] = (text[1:] != text[:-1]) | ~needed[:-1]
    run = np.maximum.accumulate(np.where(breaks, np.arange(n), 0))
    counts = np.bincount(text[direct], minlength=256)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        first = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, dtype=np.int64)
        waiting[c] = []
        bucket = [first]
        if len(first) and (longer := first - run[first]).any():
            back = np.arange(int(longer.sum())) - np.repeat(np.cumsum(longer) - longer, longer) + 1
            bucket.append((np.repeat(first, longer) - back)[np.argsort(back, kind="stable")])
        full = np.concatenate([*bucket, direct[cuts[c] : cuts[c + 1]]])
        if not len(full):
            continue
        out.append(full)
        before = full[full > 0] - 1
        before = before[needed[before] & (text[before] > c)]
        chars = text[before]
        before = before[np.argsort(chars, kind="stable")]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(chars, minlength=256))])
        for d in np.flatnonzero(np.diff(bounds)):
            waiting[d].append(before[bounds[d] : bounds[d + 1]])
    order = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each suffix in order but the first, the bytes that it begins with alike to the one before, ``depth`` at most."""
    padded = np.concatenate([text, np.zeros(depth + 8, dtype=np.uint8)])
    n = len(order) - 1
    out = np.zeros(max(n, 0), dtype=np.int64)
    live = np.arange(max(n, 0))
    words = np.ndarray((len(text) + depth,), np.uint64, padded, 0, (1,))
    for k in range(0, depth, 8):
        differ = words[order[live] + k] ^ words[order[live + 1] + k]
        lowest = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.log2(np.maximum(lowest, 1).astype(np.float64)).astype(np.int64) // 8)
        out[live] += same
        live = live[differ == 0]
    return np.minimum(out, depth)


def _repeats(text: np.ndarray, starts: np.ndarray, strings: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of segments at ``starts`` in the text, each with so many overlapping strings: (segment, first, end) of runs of strings that a smaller id owns."""
    total = int(strings.sum())
    segment = np.repeat(np.arange(len(starts)), strings)
    place = np.arange(total) - np.repeat(np.cumsum(strings) - strings, strings)
    at = starts[segment] + place
    wanted = np.zeros(len(text), dtype=bool)
    wanted[at] = True
    index = np.zeros(len(text), dtype=np.int64)
    index[at] = np.arange(total)
    order = sorted_suffixes(text, wanted)
    item = index[order]
    new = np.concatenate([[True], common_prefixes(text, order) < DEPTH]) if total else np.zeros(0, dtype=bool)
    groups = np.flatnonzero(new)
    own = ids[segment[item]]
    owner = np.minimum.reduceat(own, groups) if total else own
    gone = np.zeros(total, dtype=bool)
    gone[item] = np.repeat(owner, np.diff(np.append(groups, total))) < own
    return _runs(gone, segment, place)


def _runs(gone: np.ndarray, segment: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.concatenate([[True], segment[1:] != segment[:-1]]) if len(gone) else gone
    last = np.concatenate([edge[1:], [True]]) if len(gone) else gone
    begins = np.flatnonzero(gone & (edge | ~np.concatenate([[False], gone[:-1]])))
    ends = np.flatnonzero(gone & (last | ~np.concatenate([gone[1:], [False]])))
    return segment[begins], place[begins], place[ends] + DEPTH


# --- anchors ------------------------------------------------------------------------------------------------------------------------


def _batch_texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a batch, with room after them, and where each begins and the last one ends."""
    column = batch.column("text")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.zeros(int(offsets[-1] - offsets[0]) + 2 * DEPTH + 8, dtype=np.uint8)
    if column.buffers()[2] is not None:
        data[: offsets[-1] - offsets[0]] = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(hashes of pieces, starts of segments, their numbers of strings, anchors, document of each, first position, batch, data, offsets) by TILE positions."""
    for batch in batches:
        data, offsets = _batch_texts(batch)
        for base in range(0, int(offsets[-1]), TILE):
            n = min(TILE, int(offsets[-1]) - base)
            pieces = _piece_hashes(data, base, n + DEPTH - PIECE)
            least, span, width = pieces.copy(), 1, DEPTH - PIECE + 1
            while span < width:
                step = min(span, width - span)
                np.minimum(least[:-step], least[step:], out=least[:-step])
                span += step
            least = least[:n]
            edge = offsets - base
            begins = np.zeros(n, dtype=bool)
            begins[0] = True
            begins[edge[(edge >= 0) & (edge < n)]] = True
            ends = edge[1:][(edge[1:] > 0) & (edge[1:] < n + DEPTH - 1)]
            mark = np.zeros(n + 1, dtype=np.int32)
            np.add.at(mark, np.maximum(ends - DEPTH + 1, 0), 1)
            np.add.at(mark, np.minimum(ends, n), -1)
            whole = np.cumsum(mark[:n]) == 0
            begins[1:] |= (least[1:] != least[:-1]) | ~whole[:-1]
            starts = np.flatnonzero(begins & whole)
            stops = np.flatnonzero(np.concatenate([(begins | ~whole)[1:], [True]]) & whole) + 1
            doc = np.searchsorted(offsets, base + starts, "right") - 1
            yield pieces, starts, stops - starts, least[starts], doc, base, batch, data, offsets


def _piece_hashes(data: np.ndarray, at: int, n: int) -> np.ndarray:
    h = _words(data, at, n) * _ODD[0]
    for k in (8, 16):
        h ^= h >> np.uint64(29)
        h += _words(data, at + k, n)
        h *= _ODD[k // 8]
    h ^= h >> np.uint64(32)
    return h


def _ranges_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Hashes are dealt out by other bits than those that made them least."""
    return ((hashes * _ODD[3]) >> np.uint64(33)).astype(np.int64) % ranges


def _count_anchors(ranges: int):
    """A bucket's anchors by range: each once, with its number of segments; the highest bit says that several documents of the bucket have it."""

    def emit(bucket: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        hashes, counts = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(hashes, kind="stable")
        hashes, counts = hashes[order], counts[order]
        new = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        several = np.diff(np.append(new, len(hashes))) > 1
        many = np.bitwise_or.reduceat(counts & 0x8000, new) | np.where(several, 0x8000, 0)
        total = np.minimum(np.add.reduceat((counts & 0x7FFF).astype(np.int64), new), 0x7FFF) | many
        hashes = hashes[new]
        where = _ranges_of(hashes, ranges)
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange(ranges + 1))
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            own = order[cuts[r] : cuts[r + 1]]
            yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "bucket": pa.array([bucket], pa.int64()), "hashes": [hashes[own].tobytes()], "counts": [total[own].astype("<u2").tobytes()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in _by_bucket(batches):
            bucket = batch.column("bucket")[0].as_py()
            if bucket != now and parts:
                yield from emit(now, parts)
                parts = []
            now = bucket
            for _, _, _, anchors, doc, *_ in _tiles([batch]):
                if len(anchors):
                    order = np.argsort(anchors, kind="stable")
                    hashes, docs = anchors[order], doc[order]
                    new = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
                    ends = np.append(new[1:], len(hashes))
                    parts.append((hashes[new], np.minimum(ends - new, 0x7FFF) | np.where(docs[new] != docs[ends - 1], 0x8000, 0)))
        if parts:
            yield from emit(now, parts)

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of one bucket each."""
    for batch in batches:
        if batch.num_rows:
            buckets = np.asarray(batch.column("bucket"))
            cuts = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                yield batch.slice(a, b - a)


def _find_shared(hot: int):
    """From all buckets' anchors of a range: to each bucket, those of its anchors that several documents have, and which of them are hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _by_range(batches):
            hashes = np.concatenate([np.frombuffer(x[1], dtype=np.uint64) for x in own])
            counts = np.concatenate([np.frombuffer(x[2], dtype="<u2") for x in own])
            order = np.argsort(hashes)
            ordered, counted = hashes[order], counts[order].astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            sizes = np.diff(np.append(new, len(ordered)))
            shared = (sizes > 1) | (np.bitwise_or.reduceat(counted, new) >= 0x8000)
            state = np.zeros(len(hashes), dtype=np.int8)
            state[order] = np.repeat(np.where(shared, 1 + (np.add.reduceat(counted & 0x7FFF, new) > hot), 0), sizes)
            at = 0
            for bucket, found, _ in own:
                kept, found = state[at : at + len(found) // 8], np.frombuffer(found, dtype=np.uint64)
                at += len(found)
                if kept.any():
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "shared": [found[kept == 1].tobytes()], "hot": [found[kept == 2].tobytes()]})

    return run


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each range, without it; they come in its order."""
    now, rows = None, []
    for batch in batches:
        for r, *row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
            if r != now and rows:
                yield rows
                rows = []
            now = r
            rows.append(tuple(row))
    if rows:
        yield rows


def _has(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), dtype=bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


#: A row has a bucket's segments for a range, or (range -1) spans that the bucket knows to go.
_CUT = "range int, bucket long, anchors binary, ids binary, keys binary, places binary, strings binary, bytes binary"


def _row(r: int, bucket: int, *arrays: np.ndarray) -> pa.RecordBatch:
    names = [x.split()[0] for x in _CUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([bucket], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], names=names)


def _cut_segments(ranges: int):
    """Segments of shared anchors, by range. Of equal segments in a tile only those of the smallest id travel; the others go at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: list[list[np.ndarray]] = [[], []]
        ready: list[np.ndarray] | None = None
        now = None
        for batch in _by_bucket(batches):
            bucket = batch.column("bucket")[0].as_py()
            if bucket != now:
                now, lists, ready = bucket, [[], []], None
            kinds = np.asarray(batch.column("kind"))
            texts = int(np.searchsorted(kinds, 1))
            for k, name in enumerate(("shared", "hot")):
                lists[k] += [np.frombuffer(x, dtype=np.uint64) for x in batch.column(name).slice(0, texts).to_pylist()]
            if texts == batch.num_rows or not (lists[0] or lists[1]):
                continue
            if ready is None:
                ready = [np.sort(np.concatenate(x)) if x else np.zeros(0, dtype=np.uint64) for x in lists]
            batch = batch.slice(texts)
            ids_of, keys_of = np.asarray(batch.column("id")), np.asarray(batch.column("key"))
            for pieces, starts, strings, anchors, doc, base, _, data, offsets in _tiles([batch]):
                plain, hot = _has(ready[0], anchors), _has(ready[1], anchors)
                single = starts[hot]
                if len(single):
                    n = strings[hot]
                    single = np.repeat(single, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    own = pieces[single] * _ODD[0] ^ pieces[single + PIECE] * _ODD[1] ^ pieces[single + DEPTH - PIECE] * _ODD[2]
                    anchors = np.concatenate([anchors[plain], own])
                    doc = np.concatenate([doc[plain], np.repeat(doc[hot], n)])
                    starts, strings = np.concatenate([starts[plain], single]), np.concatenate([strings[plain], np.ones(len(single), dtype=np.int64)])
                else:
                    anchors, doc, starts, strings = anchors[plain], doc[plain], starts[plain], strings[plain]
                if not len(starts):
                    continue
                sums = np.concatenate([[0], np.cumsum(pieces * _powers(len(pieces)), dtype=np.uint64)])
                content = (sums[starts + strings + DEPTH - PIECE] - sums[starts]) * _powers(len(pieces), True)[starts]
                order = np.lexsort((ids_of[doc], content, anchors))
                anchors, content, doc, starts, strings = anchors[order], content[order], doc[order], starts[order], strings[order]
                new = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (content[1:] != content[:-1])])
                ids, keys, places = ids_of[doc], keys_of[doc], base + starts - offsets[doc]
                repeat = ids > ids[np.flatnonzero(new)[np.cumsum(new) - 1]]
                if repeat.any():
                    yield _row(-1, now, anchors[:0], ids[:0], keys[repeat], places[repeat], (places + strings + DEPTH - 1)[repeat], data[:0])
                left = np.flatnonzero(~repeat)
                where = _ranges_of(anchors[left], ranges)
                left = left[np.argsort(where, kind="stable")]
                cuts = np.searchsorted(np.sort(where), np.arange(ranges + 1))
                for r in np.flatnonzero(np.diff(cuts)).tolist():
                    own = left[cuts[r] : cuts[r + 1]]
                    yield _row(r, now, anchors[own], ids[own], keys[own], places[own], strings[own], data[base + _spread(starts[own], strings[own] + DEPTH - 1)])

    return run


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after another."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


_cache: dict[tuple[int, bool], np.ndarray] = {}


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers of an odd number, or of its inverse modulo 2**64."""
    if (n, inverse) not in _cache:
        if len(_cache) > 8:
            _cache.clear()
        base = np.full(n, pow(int(_ODD[1]), -1, 1 << 64) if inverse else int(_ODD[1]), dtype=np.uint64)
        base[:1] = 1
        _cache[n, inverse] = np.cumprod(base, dtype=np.uint64)
    return _cache[n, inverse]


def _sort_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a range: sorted together by anchor, about SORT_BYTES at a time; spans that go return to their buckets."""
    kinds = (np.uint64, np.int64, np.int64, np.int64, np.int64, np.uint8)
    for own in _by_range(batches):
        anchors, ids, keys, places, strings, data = (np.concatenate([np.frombuffer(x[k], dtype=t) for x in own]) for k, t in enumerate(kinds, 1))
        bucket = np.repeat(np.array([x[0] for x in own]), [len(x[1]) // 8 for x in own])
        del own
        lengths = strings + DEPTH - 1
        begins = np.cumsum(lengths) - lengths
        order = np.argsort(anchors, kind="stable")
        new = np.concatenate([[True], anchors[order][1:] != anchors[order][:-1]])
        before = np.cumsum(lengths[order]) - lengths[order]
        piece = np.maximum.accumulate(np.where(new, before // SORT_BYTES, 0))
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(order)]
        found: list[tuple] = []
        for a, b in zip(cuts, cuts[1:]):
            part = order[a:b]
            size = lengths[part] + 1
            starts = np.cumsum(size) - size
            text = np.zeros(int(size.sum()), dtype=np.uint8)
            text[_spread(starts, lengths[part])] = data[_spread(begins[part], lengths[part])]
            segment, first, end = _repeats(text, starts, strings[part], ids[part])
            segment = part[segment]
            found.append((bucket[segment], keys[segment], places[segment] + first, places[segment] + end))
        buckets, keys, first, end = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(buckets, kind="stable")
        none = np.zeros(0, dtype=np.int64)
        edges = np.flatnonzero(np.diff(buckets[order])) + 1
        for a, b in zip([0, *edges], [*edges, len(order)]):
            if b > a:
                part = order[a:b]
                yield _row(-1, int(buckets[part[0]]), none, none, keys[part], first[part], end[part], none)


_LEFT = "digest binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<long>>"
_LEFT_TYPES = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64())))


def _cut_out(texts_too: bool):
    """Unites a bucket's spans by text, and digests what is left of each text."""

    def left(raw: memoryview, spans: list[tuple[int, int]]) -> tuple:
        parts, at = [], 0
        for x, y in spans:
            parts.append(raw[at:x])
            at = y
        kept = b"".join([*parts, raw[at:]])
        gone = sum(y - x for x, y in spans)
        return len(raw), gone, len(spans), hashlib.sha256(kept).hexdigest(), kept if texts_too else None, [list(x) for x in spans] if texts_too else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, spans, ready = None, [], None
        for batch in _by_bucket(batches):
            bucket = batch.column("bucket")[0].as_py()
            if bucket != now:
                now, spans, ready = bucket, [], None
            first_text = int(np.searchsorted(np.asarray(batch.column("kind")), 1))
            spans += [[np.frombuffer(x, dtype=np.int64) for x in row] for row in zip(*(batch.column(x).slice(0, first_text).to_pylist() for x in ("keys", "places", "ends")))]
            batch = batch.slice(first_text)
            if not batch.num_rows:
                continue
            if ready is None:
                ready, spans = _united(spans), []
            for part in chunks([batch], batch.schema.get_field_index("text")):
                out = [(digest.as_py(), *left(memoryview(text.as_buffer()), ready.get(key, []))) for key, digest, text in zip(part.column("key").to_pylist(), part.column("digest"), part.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _LEFT_TYPES)], names=[x.split()[0] for x in _LEFT.split(", ")])

    return run


def _united(spans: list[list[np.ndarray]]) -> dict[int, list[tuple[int, int]]]:
    """By text: its spans, overlapping and touching ones as one, in order."""
    if not spans:
        return {}
    keys, first, end = (np.concatenate(x) for x in zip(*spans))
    order = np.lexsort((first, keys))
    out: dict[int, list[tuple[int, int]]] = {}
    for key, a, b in zip(keys[order].tolist(), first[order].tolist(), end[order].tolist()):
        own = out.setdefault(key, [])
        if own and a <= own[-1][1]:
            own[-1] = (own[-1][0], max(b, own[-1][1]))
        else:
            own.append((a, b))
    return out


# --- the operator -------------------------------------------------------------------------------------------------------------------


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts_too: bool = False, hot: int = HOT) -> DataFrame:
    """A row per document: (id, n_bytes, n_removed, n_spans, kept_sha256), and with ``texts_too`` kept, the bytes left, and spans, the pairs (start, end) of bytes removed."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    keyed = docs.select(F.col(id_col).cast("long").alias("row_id"), raw.alias("text")).withColumn("id", F.coalesce("row_id", F.lit(NO_ID))).withColumn("digest", F.unhex(F.sha2("text", 256)))
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    ranges, buckets = max(4, -(-total // RANGE_BYTES)), max(4, -(-total // BUCKET_BYTES))
    classes = keyed.groupBy("digest").agg(F.min("id").alias("id"), F.min_by("text", "id").alias("text"))
    texts = written(bounded(classes.select(F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket"), "digest", "id", F.monotonically_increasing_id().alias("key"), "text")))

    def with_texts(first: DataFrame, run, schema: str) -> DataFrame:
        """``run`` over each bucket: the rows of ``first``, then its texts."""
        return first.withColumn("kind", F.lit(0)).unionByName(texts.withColumn("kind", F.lit(1)), allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(tidied(run), schema)

    def by_range(df: DataFrame, run, schema: str) -> DataFrame:
        return df.repartitionById(ranges, F.col("range")).sortWithinPartitions("range").mapInArrow(tidied(run), schema)

    counted = texts.select("bucket", "text").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(_count_anchors(ranges)), "range int, bucket long, hashes binary, counts binary")
    shared = written(by_range(counted, _find_shared(hot), "bucket long, shared binary, hot binary"))
    cut = written(with_texts(shared, _cut_segments(ranges), _CUT))
    spans = written(by_range(cut.where("range >= 0"), _sort_segments, _CUT).unionByName(cut.where("range < 0")).select("bucket", "keys", "places", F.col("strings").alias("ends")))
    discard(shared, cut)
    left = written(with_texts(spans, _cut_out(texts_too), _LEFT))
    firsts = texts.select("digest", F.col("id").alias("first_id"))
    rows = keyed.select("row_id", "id", "digest").join(left.join(firsts, "digest"), "digest")
    repeats = (F.col("id") > F.col("first_id")) & (F.col("n_bytes") >= DEPTH)
    pick = lambda name, other: F.when(repeats, other).otherwise(F.col(name)).alias(name)
    kept = [pick("n_removed", F.col("n_bytes")), pick("n_spans", F.lit(1)), pick("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest()))]
    if texts_too:
        kept += [pick("kept", F.lit(b"")), pick("spans", F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes"))))]
    out = written(rows.select(F.col("row_id").alias(id_col), "n_bytes", *kept))
    discard(texts, spans, left)
    return out


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
blocks AS (SELECT doc_id, block, substring(h, 2 * block + 1, 598) AS part FROM (SELECT doc_id, unnest(range(0, n - 49, 250)) AS block, h FROM d WHERE n >= 50)),
starts AS (SELECT doc_id, block, unnest(range(0, least(250, length(part) // 2 - 49))) AS i, part FROM blocks),
strings AS (SELECT doc_id, block + i AS p, substring(part, 2 * i + 1, 100) AS s FROM starts),
firsts AS (SELECT s, min(doc_id) AS first_id FROM strings GROUP BY s),
gone AS (SELECT doc_id, p FROM strings JOIN firsts USING (s) WHERE first_id < doc_id),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS begins FROM gone),
numbered AS (SELECT doc_id, p, sum(begins) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY doc_id, run),
pieces AS (
    SELECT doc_id, a AS place, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM spans
    UNION ALL SELECT doc_id, n AS place, coalesce(last_b, 0), n FROM d LEFT JOIN (SELECT doc_id, max(b) AS last_b FROM spans GROUP BY doc_id) USING (doc_id)
),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY place, x) AS k FROM pieces JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
