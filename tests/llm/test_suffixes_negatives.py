"""Repeated strings against a table of all strings, hard negatives against all pairs; the sorting kernel against plain sorting."""

import hashlib
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmix.llm import negatives, suffixes


# --- suffixes -----------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(40))
def test_order_and_common_prefixes(seed):
    rng = random.Random(seed)
    letters, n, depth = rng.choice([1, 2, 3, 8, 250]), rng.randint(1, 400), rng.choice([4, 50])
    raw = bytes(rng.randrange(letters) for _ in range(n))
    raw = ((raw[:5] * 80)[:n] if seed % 3 == 0 else raw) + b"\0"
    text, wanted = np.frombuffer(raw, np.uint8), np.array([rng.random() < 0.6 for _ in raw])
    wanted[-1] = False
    order = suffixes.sorted_suffixes(text, wanted, depth)
    assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
    heads = [(raw + bytes(depth))[p : p + depth] for p in order]
    assert heads == sorted(heads)
    assert suffixes.common_prefixes(text, order, depth).tolist() == [len(os.path.commonprefix([x, y])) for x, y in zip(heads, heads[1:])]


def test_only_suffixes_smaller_than_their_successors_are_sorted_directly():
    assert suffixes.smaller_than_next(np.frombuffer(b"mississippi\0", np.uint8)).tolist() == [s < t for s, t in zip([b"mississippi\0"[i:] for i in range(12)], [b"mississippi\0"[i:] for i in range(1, 12)])] + [True]


def plainly(rows):
    """(n_bytes, n_removed, n_spans, kept bytes) by a table of all strings; null ids are the largest."""
    rows = [(math.inf if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in rows:
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = min(i, first.get(t[p : p + 50], math.inf))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        out.append((len(t), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1])), bytes(c for c, g in zip(t, gone) if not g)))
    return out


def sample_rows(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(2, 9))) for _ in range(60)] + ["ä", "漢字", "👍🏽", "\x00\x00"]
    passages = [" ".join(rng.choices(words, k=rng.randint(8, 40))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [rng.choice([" ".join(rng.choices(words, k=rng.randint(1, 30))), rng.choice(passages)]) for _ in range(rng.randint(0, 6))]
        rows.append((rng.choice([i, i // 2, -i]), "\n".join(parts)))
    rows += [(None, rows[3][1]), (None, passages[0]), (None, passages[0] + "x"), (500, None), (501, ""), (502, "x" * 49), (503, "x" * 50), (504, "x" * 5000), (505, "x" * 51 + "y"), rows[5], (rows[5][0], rows[6][1])]
    rows += [(600 + k, passages[1] + str(k) + passages[2]) for k in range(40)] + [(700, (passages[3] + " ") * 300), (701, passages[3] * 2)]
    return rows


@pytest.mark.parametrize("seed,hot,tile", [(1, None, None), (2, 3, None), (3, 20, 777), (4, 0, 4096)])
def test_like_a_table_of_all_strings(spark, monkeypatch, seed, hot, tile):
    if tile:  # the session's workers are forked from a daemon, so closures carry these values, not the module
        monkeypatch.setattr(suffixes, "SORT_BYTES", tile)
    rows = sample_rows(seed)
    docs = spark.createDataFrame([(i, t, "k", 1, b"d") for i, t in rows], "doc_id long, text string, key string, bucket int, digest binary").repartition(5)
    got = suffixes.cut_repeats(docs, texts_too=True, **({} if hot is None else {"hot": hot})).collect()
    want = sorted((str(i), n, gone, spans, hashlib.sha256(kept).hexdigest(), kept) for (i, _), (n, gone, spans, kept) in zip(rows, plainly(rows)))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got) == want
    for r in got:
        assert len(r.spans) == r.n_spans and sum(b - a for a, b in r.spans) == r.n_removed


def test_tiles_don_t_matter():
    import pyarrow as pa

    texts = [(t or "").encode() for _, t in sample_rows(7)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.binary())})

    def strings(tile):
        suffixes.TILE, before = tile, suffixes.TILE
        try:
            found = []
            for _, starts, counts, anchors, doc, base, _, data, offsets in suffixes._tiles([batch]):
                found += [(int(d), int(base + s + k - offsets[d]), int(a), bytes(data[base + s + k : base + s + k + 50])) for s, n, a, d in zip(starts, counts, anchors, doc) for k in range(n)]
            return found
        finally:
            suffixes.TILE = before

    whole = strings(1 << 20)
    assert [(d, p, t) for d, p, _, t in whole] == [(d, p, t[p : p + 50]) for d, t in enumerate(texts) for p in range(len(t) - 49)]
    assert strings(100) == strings(333) == whole
    assert len({t: a for _, _, a, t in whole}) == len({(a, t) for _, _, a, t in whole})  # equal strings have equal anchors


# --- hard negatives -----------------------------------------------------------------------------------------------------------------


def all_pairs(rows, every, positives, negatives_, low, high):
    whole = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            v = [int(math.floor(max(min(x * 256, 1 << 27), -(1 << 27)))) for x in v]
            whole[i] = min(whole.get(i, (str(label), v)), (str(label), v))
    out = set()
    for a, (label, q) in whole.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, own == label) for i, (own, v) in whole.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fits = [(t, i) for t, i, same in scored if not same and low * -s <= 100 * -t <= high * -s][:negatives_]
            out |= {(a, p, k, i, -s, -t) for k, (t, i) in enumerate(fits, 1)}
    return out


def vectors(seed, n=900, width=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = [(i, int(rng.integers(0, 4)), (centres[rng.integers(0, 6)] + 0.4 * rng.normal(size=width)).astype(np.float32).tolist()) for i in range(-100, n)]
    rows += [(n + k, k % 4, rows[7][2]) for k in range(250)]  # a vector that repeats
    rows += [(5000, None, rows[0][2]), (5010, 1, None), (5020, 1, [1.0, None]), (5030, 1, [float("nan")] * width), (5040, 1, [float("inf")]), (None, 1, rows[0][2]), (5050, 2, []), (5060, 2, [3.0]), (5070, 3, [9.0] * (width + 3)), (5080, 1, [3e38] * width)]
    return [*rows, rows[3], rows[3], (rows[3][0], rows[3][1] + 1, rows[3][2])]


@pytest.mark.parametrize("seed,shape", [(1, (5, 10, 30, 90)), (2, (2, 3, 80, 100)), (3, (40, 1, -50, 130))])
def test_like_all_pairs(spark, seed, shape):
    rows = vectors(seed)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, label int, embedding array<float>, id string, block int, kind int")
    scaled = df.withColumn("vector", negatives.scaled(F.col("embedding"), 256))
    got = [tuple(r) for r in negatives.mine(scaled, F.col("id") % 20 == 0, positives=shape[0], negatives=shape[1], low=shape[2], high=shape[3]).collect()]
    assert len(got) == len(set(got)) and set(got) == all_pairs(rows, 20, *shape)


def test_nothing_to_mine(spark):
    none = spark.createDataFrame([], "vec_id long, label int, vector array<int>")
    assert negatives.mine(none, F.col("id") % 2 == 0).count() == 0
    alone = spark.createDataFrame([(0, 1, [3]), (1, 2, [2]), (2, 1, [])], "vec_id long, label int, vector array<int>")
    assert negatives.mine(alone, F.col("id") == 1).count() == 0
    got = negatives.mine(alone, F.col("id") == 0).collect()
    assert got == []  # the positive's score is 0, the negative's is not


def test_brackets_hold_and_prune():
    rng = np.random.default_rng(4)
    x = np.floor(256 * np.concatenate([c + 0.05 * rng.normal(size=(300, 16)) for c in rng.normal(size=(8, 16))]))
    pivots = negatives._Pivots(x[::150], float((x**2).sum(axis=1).max()))
    q = x[5:2400:240]
    least, most = pivots.brackets(q, pivots.of_rows(x))
    scores = q @ x.T
    assert (least <= scores).all() and (scores <= most).all()
    tenth = np.partition(least, -10, axis=1)[:, -10:].min(axis=1)
    assert (most >= tenth[:, None]).mean() < 0.3  # most rows of other clusters are never scored
