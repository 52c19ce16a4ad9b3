"""Exact Jaccard self-join of n-gram sets by vertical partitioning.

First n-grams are counted by hash range: a task sees all uses of its n-grams, counts in how many sets each occurs, and drops those that
occur once, which no two sets share. A set that keeps too few n-grams can be similar to nothing. This gives the global order: by the
number of sets, then by hash. It is cut into fragments, and every set with it. Two similar sets share one of their rarest n-grams, their
heads (prefix filter). A pair that does is a candidate. Its partial overlap is counted in the heads first, where what may follow bounds
the whole overlap; pairs that can't reach it go. For the others partial overlaps are counted fragment by fragment and summed per pair.

Equal sets are one node. To join a large group of near copies without all its pairs, nodes first link to one leader each, which is
verified; after that only pairs between different components can matter, and all of these that share a prefix n-gram are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmix.llm.batches import bounded, chunks, tidied
from strandmix.llm.components import components
from strandmix.llm.sized import counted, sized_join
from strandmix.llm.storage import discard, written

#: Words of an n-gram; bits of its hash that are kept; least number of hash ranges; bytes of input, as its files store it, for each; n-grams of a block.
WORDS, BITS, FRAGMENTS, FRAGMENT_BYTES, BLOCK = 5, 53, 64, 4 << 20, 1 << 19
#: Sets from which on an n-gram counts as most frequent; n-grams that wait in a task.
FREQUENT, PENDING = 255, 3_000_000
#: Where the global order is cut: numbers of sets at which a fragment begins; the last, of most frequent n-grams, is cut by hash into 8.
PIVOTS = np.array([3, 4, 6, 10, 20, 60, FREQUENT])
CACHE = 60_000
#: What a source says of its size that doesn't know it is more than this.
UNKNOWN_BYTES = 1 << 55
#: Stands for a null id inside.
NO_ID = -(1 << 63)

_seen: dict[bytes, int] = {}


def _word(word: bytes) -> int:
    if len(_seen) >= CACHE:
        _seen.clear()
    h = _seen[word] = xxhash.xxh3_64_intdigest(word)
    return h


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes, of 64 bits, of each text; A-Z are lower-cased, and words stand between ASCII white space."""
    split = [(x or "").encode("utf-8", "surrogatepass").lower().split() for x in texts]
    counts = np.array([len(x) for x in split], dtype=np.int64)
    get = _seen.get
    flat = np.fromiter((get(w) or _word(w) for words in split for w in words), dtype=np.uint64, count=int(counts.sum()))
    mixed = flat[: max(0, len(flat) - WORDS + 1)].copy()
    for k in range(1, WORDS):
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed += flat[k : k + len(mixed)]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(29)
    out, at = [], 0
    for words, n in zip(split, counts.tolist()):
        if n >= WORDS:
            out.append(np.unique(mixed[at : at + n - WORDS + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 5)] if n else [], dtype=np.uint64))
        at += n
    return out


def _six(values: np.ndarray) -> bytes:
    """The low 48 bits of each value, as bytes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


_BLOCKS = "fragment int, nodes binary, sizes binary, counts binary, grams binary"
_SEGMENTS = "kind int, node long, n int, doc long, text long, proof long, grams binary, ranks binary"
_SETS = "kind int, node long, n int, part int, shared int, typical int, grams array<long>"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(x, type=_TYPES[t]) for x, t in zip(zip(*rows), types)], names=list(names))


def _cut_into_fragments(fragments: int, seed: int):
    """Sets of a block of documents, cut into fragments: one row for each fragment of a block, and one (below 0) with its documents.

    A set's node is 64 bits of a digest; 64 of another one prove that sets of one node are equal.
    """
    shift = np.uint64(BITS - (fragments.bit_length() - 1))

    def block(docs: list[tuple[int, ...]], sets: dict[int, np.ndarray], sizes: dict[int, int]) -> Iterator[tuple]:
        ids, texts, nodes, proofs, ns = (np.array(x, dtype=np.int64) for x in zip(*docs))
        yield -1 - int(nodes[0]) % fragments, nodes.tobytes(), ns.astype("<i4").tobytes(), ids.tobytes(), texts.tobytes() + proofs.tobytes()
        keys = [x for x in sets if len(sets[x])]
        if not keys:
            return
        grams = np.concatenate([sets[x] for x in keys])
        owner = np.repeat(np.arange(len(keys)), [len(sets[x]) for x in keys])
        where = (grams >> shift).astype(np.int32)
        order = np.argsort(where, kind="stable")
        grams, owner, where = grams[order], owner[order], where[order]
        all_nodes, all_sizes = np.array(keys, dtype=np.int64), np.array([sizes[x] for x in keys], dtype="<i4")
        ends = np.searchsorted(where, np.arange(fragments + 1))
        for f, (a, b) in enumerate(zip(ends, ends[1:])):
            if b > a:
                own, counts = np.unique(owner[a:b], return_counts=True)
                yield f, all_nodes[own].tobytes(), all_sizes[own].tobytes(), counts.astype("<i4").tobytes(), _six(grams[a:b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, sets, sizes, total = [], {}, {}, 0
        for part in chunks(batches):
            for doc, text, found in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), shingle_sets(part.column(1).to_pylist())):
                n, raw = len(found), found.tobytes()
                node = xxhash.xxh3_64_intdigest(raw, seed << 32 | n & 0xFFFFFFFF) - (1 << 63)
                docs.append((NO_ID if doc is None else doc, text, node, xxhash.xxh64_intdigest(raw, seed) - (1 << 63), n))
                if node not in sets:
                    sets[node], sizes[node] = np.unique(found >> np.uint64(64 - BITS)), n
                    total += n
            if total >= BLOCK:
                yield _rows(_BLOCKS, list(block(docs, sets, sizes)))
                docs, sets, sizes, total = [], {}, {}, 0
        if docs:
            yield _rows(_BLOCKS, list(block(docs, sets, sizes)))

    return run


class _Fragment:
    """The n-grams of one fragment as they come: what is frequent already leaves at once, so what waits is bounded by distinct n-grams.

    Owners are kept once per set, not once per n-gram, until n-grams that nobody shares are gone.
    """

    def __init__(self):
        self.grams, self.nodes, self.sizes, self.counts, self.waiting = [], [], [], [], 0
        self.frequent = np.zeros(0, dtype=np.uint64)

    def add(self, grams, nodes, sizes, counts) -> Iterator[tuple]:
        for held, x in ((self.grams, grams), (self.nodes, nodes), (self.sizes, sizes), (self.counts, counts)):
            held.append(x)
        self.waiting += len(grams)
        if self.waiting >= PENDING:
            yield from self.settle(last=False)

    def settle(self, last: bool = True) -> Iterator[tuple]:
        """Segments of n-grams that more than one set has; without ``last`` only of those that are most frequent already."""
        if not self.waiting:
            return
        grams = np.concatenate(self.grams)
        nodes, sizes, ends = np.concatenate(self.nodes), np.concatenate(self.sizes), np.cumsum(np.concatenate(self.counts))
        self.grams, self.nodes, self.sizes, self.counts, self.waiting = [], [], [], [], 0
        order = np.argsort(grams, kind="stable")
        ranked = grams[order]
        starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        counts = np.diff(np.append(starts, len(ranked)))
        ranks = np.minimum(counts, FREQUENT).astype(np.uint8)
        if len(self.frequent):
            ranks[np.isin(ranked[starts], self.frequent)] = FREQUENT
        if not last:
            self.frequent = np.union1d(self.frequent, ranked[starts[ranks == FREQUENT]])
        ranks = np.repeat(ranks, counts)
        out = ranks >= (2 if last else FREQUENT)
        if not last:
            keep = np.sort(order[~out])
            owners = np.searchsorted(ends, keep, side="right")
            own, uses = np.unique(owners, return_counts=True)
            self.grams, self.nodes, self.sizes, self.counts, self.waiting = [grams[keep]], [nodes[own]], [sizes[own]], [uses], len(keep)
        order, grams, rank = order[out], ranked[out], ranks[out]
        del ranked, ranks, out
        owners = np.searchsorted(ends, order, side="right")
        nodes, sizes = nodes[owners], sizes[owners]
        del order, owners, ends
        order = np.lexsort((grams, sizes, nodes))
        grams, nodes, sizes, rank = grams[order], nodes[order], sizes[order], rank[order]
        del order
        new = np.ones(len(grams), dtype=bool)
        same = (nodes[1:] == nodes[:-1]) & (sizes[1:] == sizes[:-1])
        new[1:] = ~(same & (grams[1:] == grams[:-1]))
        first = np.ones(len(grams), dtype=bool)
        first[1:] = ~same
        starts = np.flatnonzero(first)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(grams)]):
            pick = slice(a, b) if new[a:b].all() else a + np.flatnonzero(new[a:b])
            yield 1, int(nodes[a]), int(sizes[a]), None, grams[pick].astype("<u8").tobytes(), rank[pick].tobytes()


def _count_in_fragments(fragments: int):
    """Per hash range: the segments of n-grams that several sets share, with the number of sets that have them, up to FREQUENT."""
    shift = np.uint64(BITS - (fragments.bit_length() - 1))
    segment = lambda x: (*x[:4], None, None, *x[4:])

    def found(batches) -> Iterator[tuple]:
        at, fragment = None, _Fragment()
        for batch in batches:
            for f, nodes, sizes, counts, grams in zip(*(x.to_pylist() for x in batch.columns)):
                nodes, sizes = np.frombuffer(nodes, dtype="<i8"), np.frombuffer(sizes, dtype="<i4")
                if f < 0:
                    texts, proofs = np.frombuffer(grams, dtype="<i8").reshape(2, -1).tolist()
                    yield from ((0, *x, None, None) for x in zip(nodes.tolist(), sizes.tolist(), np.frombuffer(counts, dtype="<i8").tolist(), texts, proofs))
                    continue
                if f != at:
                    yield from map(segment, fragment.settle())
                    at, fragment = f, _Fragment()
                counts = np.frombuffer(counts, dtype="<i4")
                yield from map(segment, fragment.add(_from_six(grams) | np.uint64(f) << shift, nodes, sizes, counts))
        yield from map(segment, fragment.settle())

    return _batched(found, _SEGMENTS)


def _batched(found, schema: str, size: int = 8_000):
    def run(batches):
        out = []
        for row in found(batches):
            out.append(row)
            if len(out) >= size:
                yield _rows(schema, out)
                out = []
        if out:
            yield _rows(schema, out)

    return run


def _fragments_of(grams: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The fragment of the global order that each n-gram lies in."""
    found = np.searchsorted(PIVOTS, ranks, side="right")
    return np.where(found == len(PIVOTS), len(PIVOTS) + (grams >> np.uint64(BITS - 3)).astype(np.int64), found)


def _gather_sets(percent: int):
    """Per node, from its segments: nothing if too few n-grams are shared; else its head (kind 1) and its n-grams by fragment (kind 2).

    n-grams stand in the global order: by the number of sets, then by hash.
    """

    def one(node, n, parts) -> Iterator[tuple]:
        grams, ranks = np.concatenate([np.frombuffer(x[0], dtype="<u8") for x in parts]), np.concatenate([np.frombuffer(x[1], dtype=np.uint8) for x in parts])
        if 100 * len(grams) < percent * n:
            return
        order = np.lexsort((grams, ranks))
        grams, ranks = grams[order], ranks[order]
        if len(np.unique(grams)) < len(grams):
            first = np.sort(np.unique(grams, return_index=True)[1])
            grams, ranks = grams[first], ranks[first]
        if 100 * len(grams) < percent * n:
            return
        prefix = n - -(-percent * n // 100) + 1 - (n - len(grams))
        yield 1, node, n, None, len(grams), int(1000 * ranks.sum(dtype=np.int64) / n), grams[:prefix].astype(np.int64)
        where = _fragments_of(grams, ranks)
        for k in np.unique(where).tolist():
            yield 2, node, n, k, None, None, np.sort(grams[where == k]).astype(np.int64)

    def found(batches) -> Iterator[tuple]:
        at, parts = None, []
        for batch in batches:
            for node, n, grams, ranks in zip(*(x.to_pylist() for x in batch.columns)):
                if (node, n) != at:
                    if parts:
                        yield from one(*at, parts)
                    at, parts = (node, n), []
                parts.append((grams, ranks))
        if parts:
            yield from one(*at, parts)

    return _batched(found, _SETS, 2000)


def _verified(pairs: DataFrame, prefixes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough.

    First their heads are compared. A common n-gram that isn't in both heads lies behind one of them, the one that ends first in the
    global order; so at most the larger of what follows the two heads can add to the overlap there. Pairs that can't reach what they
    need go. Overlaps of the others are counted by fragment and summed per pair; both sides' sizes come with the fragments.
    """
    enough = lambda overlap: (100 + percent) * overlap >= percent * (F.col("n_a") + F.col("n_b"))
    side = lambda df, x, *more: df.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), *more, F.col("grams").alias(f"grams_{x}"))
    tail = lambda x: (F.col("shared") - F.size("grams")).alias(f"tail_{x}")
    given, rows = counted(pairs.distinct())
    heads = sized_join(side(prefixes, "a", tail("a")), given, "a", "inner", rows).join(side(prefixes, "b", tail("b")).hint("merge"), "b")
    near, rows = counted(heads.where(enough(F.size(F.array_intersect("grams_a", "grams_b")) + F.greatest("tail_a", "tail_b"))).select("a", "b"))
    discard(given)
    both = sized_join(side(sets, "a", "part"), near, "a", "inner", rows).join(side(sets, "b", "part").hint("merge"), ["b", "part"])
    overlap = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("shared"))
    total = overlap.groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))
    out = written(total.where(enough(F.col("shared"))).select("a", "b"))
    discard(near)
    return out


def _leaders(prefixes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): each node with the leader that most of its prefix n-grams name, where the two are similar.

    An n-gram's leader is its most typical node, with the most frequent n-grams: of a text and its edited copies, the text.
    """
    uses = prefixes.select("node", "typical", F.explode("grams").alias("gram"))
    lead = uses.groupBy("gram").agg(F.max(F.struct("typical", "node")).alias("leader"), F.count("*").alias("uses")).where("uses > 1").select("gram", F.col("leader.node").alias("leader"))
    named = uses.select("node", "gram").join(lead.hint("merge"), "gram").where("node != leader").groupBy("node", "leader").count()
    best = named.groupBy("node").agg(F.max(F.struct(F.col("count"), F.col("leader"))).alias("best"))
    return _verified(best.select(F.col("node").alias("a"), F.col("best.leader").alias("b")), prefixes, sets, percent)


def _links_between(prefixes: DataFrame, group: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Similar pairs of nodes in different groups; ``group`` has (node, root) for nodes that aren't their own root.

    Of a pair, b is the larger set (the larger node of equals). Sets of n and m n-grams need an overlap of p (n + m) / (100 + p). At their
    first shared n-gram, it and what follows it in each set's order, of n-grams that any set shares, must suffice for that: this bounds
    the sizes of partners by place. a enters for all size classes in its bounds, b for its own. Pairs of groups are found before pairs
    of nodes, so a group's nodes are never paired with each other.
    """
    groups, n_groups = counted(group)
    uses = sized_join(prefixes, groups, "node", "left", n_groups).withColumn("root", F.coalesce("root", "node"))
    uses = uses.select("node", "root", "n", "shared", F.posexplode("grams").alias("at", "gram"))
    mixed = uses.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("gram")
    some = written(uses.join(mixed.hint("merge"), "gram"))
    # The largest partner with which this can be the first shared n-gram: only what follows it in the order can be shared too.
    bound = some.withColumn("most", F.floor((100 + percent) * (F.col("shared") - F.col("at")) / percent - F.col("n")).cast("long"))
    size_class = lambda x: F.floor(F.ln(x.cast("double")) / F.lit(float(np.log(1.1)))).cast("int")
    biggest = F.least(F.floor(100 * F.col("n") / percent), F.col("most"))
    indexed = bound.where(F.col("most") >= F.col("n"))
    left = indexed.select("gram", F.col("root").alias("r"), F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("most").alias("most_a"), F.explode(F.sequence(size_class(F.col("n")), size_class(biggest))).alias("class"))
    right = bound.where(100 * F.col("most") >= percent * F.col("n")).select("gram", size_class(F.col("n")).alias("class"), F.col("root").alias("s"), F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("most").alias("most_b"))
    by_root = left.groupBy("gram", "class", "r").agg(F.min("n_a").alias("least_a"), F.max("most_a").alias("top_a"))
    to_root = right.groupBy("gram", "class", "s").agg(F.min("n_b").alias("least_b"), F.max("most_b").alias("top_b"))
    pairs = by_root.join(to_root.hint("merge"), ["gram", "class"]).where("r != s AND least_b <= top_a AND least_a <= top_b").select("gram", "class", "r", "s", "least_b", "top_b")
    near = pairs.join(left.hint("merge"), ["gram", "class", "r"]).where("n_a <= top_b AND least_b <= most_a").drop("least_b", "top_b")
    fits = ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))) & (F.col("n_b") <= F.col("most_a")) & (F.col("n_a") <= F.col("most_b"))
    found = near.join(right.hint("merge"), ["gram", "class", "s"]).where(fits)
    out = _verified(found.select("a", "b"), prefixes, sets, percent)
    discard(some, groups)
    return out


def _fragments_for(kept: DataFrame) -> int:
    """Hash ranges for the input's size, which a plan's sources know from their files; where one doesn't, texts are measured."""
    leaves = kept._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    if size >= UNKNOWN_BYTES:
        size = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(FRAGMENTS, 1 << (size // FRAGMENT_BYTES).bit_length())


def _sets_of(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, table): each input row with its node and size; sets that may be similar to others, as heads and fragments."""
    spark = docs.sparkSession
    kept = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    fragments = _fragments_for(kept)
    tasks = max(fragments, int(spark.conf.get("spark.sql.shuffle.partitions")))
    seed = 0
    while True:
        blocks = kept.select("id", "text", F.xxhash64("text").alias("key")).mapInArrow(tidied(_cut_into_fragments(fragments, seed)), _BLOCKS)
        dealt = blocks.repartitionById(tasks, F.expr("if(fragment < 0, -1 - fragment, fragment)")).sortWithinPartitions("fragment")
        segments = written(dealt.mapInArrow(tidied(_count_in_fragments(fragments)), _SEGMENTS))
        rows = written(segments.where("kind = 0").select("node", "n", F.nullif(F.col("doc"), F.lit(NO_ID)).alias("doc"), "text", "proof"))
        clash = rows.groupBy("node").agg(F.min("n").alias("n"), F.max("n").alias("m"), F.min("proof").alias("p"), F.max("proof").alias("q")).where("n != m OR p != q")
        if clash.isEmpty():
            break
        # Different sets of one node, which hardly ever happens: once more with other digests.
        discard(segments, rows)
        seed += 1
    by_node = segments.where("kind = 1").select("node", "n", "grams", "ranks").repartition(tasks, "node").sortWithinPartitions("node", "n")
    table = written(by_node.mapInArrow(tidied(_gather_sets(percent)), _SETS))
    discard(segments)
    return rows, table


def _linked(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, tuple[DataFrame, DataFrame], DataFrame, int]:
    """(rows, links, component of nodes that have links, number of these): links (a, b) of nodes with their leaders, and those between groups."""
    rows, table = _sets_of(docs, id_col, text_col, percent)
    prefixes, sets = table.where("kind = 1").select("node", "n", "shared", "typical", "grams"), table.where("kind = 2").select("node", "n", "part", "grams")
    leaders = _leaders(prefixes, sets, percent)
    parent = leaders.select(F.col("a").alias("node"), F.col("b").alias("up"))
    higher = parent.select(F.col("node").alias("up"), F.col("up").alias("root"))
    group = written(parent.join(higher, "up", "left").select("node", "up", F.coalesce("root", "up").alias("root")))
    between = _links_between(prefixes, group.select("node", "root"), sets, percent)
    discard(table)

    # Roots that have leaders themselves, and links between groups, join groups to components.
    root_of = group.select("node", "root")
    chains = group.select(F.col("root").alias("src")).distinct().join(root_of.select(F.col("node").alias("src"), F.col("root").alias("dst")), "src").select("src", "dst")
    rooted = between.join(root_of.select(F.col("node").alias("a"), F.col("root").alias("r")), "a", "left").join(root_of.select(F.col("node").alias("b"), F.col("root").alias("s")), "b", "left")
    edges = written(chains.union(rooted.select(F.coalesce("r", "a").alias("src"), F.coalesce("s", "b").alias("dst"))).distinct())
    # Nodes without a row here, roots among them, are their own components.
    node_of, joined = root_of.select("node", F.col("root").alias("component")), None
    if not edges.isEmpty():
        joined = components(edges)
        node_of = root_of.join(joined.select(F.col("node").alias("root"), F.col("component").alias("further")), "root", "left").select("node", F.coalesce("further", "root").alias("component"))
        node_of = node_of.union(joined.join(root_of.select("node"), "node", "left_anti").select("node", "component"))
    every, n = counted(node_of)
    discard(edges, group, *([joined] if joined else []))
    return rows, (leaders, between), every, n


def _rows_by_component(rows: DataFrame, every: DataFrame, n: int) -> DataFrame:
    return sized_join(rows, every, "node", "left", n).withColumn("component", F.coalesce("component", "node"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per input row: n_shingles and component_id, the smallest id that links reach.

    Two rows link when 100 * overlap >= percent * union of their n-gram sets. A text of fewer words than an n-gram is one n-gram; a
    null, empty or blank text has none, and links with nothing. Rows with null ids link like others; a component of null ids only has
    a null id. Repeated rows link with each other, and each is returned. Texts are read whole.

    n-grams are compared by 53 bits of a hash, sets by two digests of 64 bits.
    """
    rows, links, every, n = _linked(docs, id_col, text_col, percent)
    discard(*links)
    rows_of = _rows_by_component(rows, every, n).select("doc", "n", "component")
    empty = rows_of.where("n = 0").select("doc", "n", F.col("doc").alias("first"))
    full = rows_of.where("n > 0")
    several, n_several = counted(full.groupBy("component").agg(F.min("doc").alias("first"), F.count("*").alias("rows")).where("rows > 1").select("component", "first"))
    out = sized_join(full, several, "component", "left", n_several).select("doc", "n", F.coalesce("first", "doc").alias("first")).unionByName(empty)
    return out.select(F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("first").alias("component_id"))


def representative_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(a, b) ids of verified links between classes of equal sets, each class by its smallest id; a < b, or null where a class has no id.

    Each class is linked to the leader of its group, and all links between classes of different groups are given; what links within a
    group besides follows from no pair here, as a group of n near copies may have n * n of them. Together with membership (equal sets,
    and ``jaccard_join``'s components) no link between groups is lost.
    """
    rows, (leaders, between), every, _ = _linked(docs, id_col, text_col, percent)
    discard(every)
    links = leaders.union(between)
    first = written(rows.where("n > 0").groupBy("node").agg(F.min("doc").alias("first")))
    named = links.join(first.select(F.col("node").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("node").alias("b"), F.col("first").alias("y")), "b")
    return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row of ``docs`` of each component, that of the smallest id, with its columns as they are; rows without words all stay.

    Rows are told apart by id and text, so rows that repeat an id with other texts are judged each, and rows without an id link like
    others and give way to one with an id. Of rows that are equal in both, one stays, that with the smallest columns as JSON. Only ids
    and digests are shuffled unless very many rows go, beyond what may be broadcast.
    """
    rows, links, every, n = _linked(docs, id_col, text_col, percent)
    discard(*links)
    key = F.struct(F.col("doc").isNull().alias("none"), F.coalesce("doc", F.lit(NO_ID)).alias("odd_id"), F.col("text").alias("odd_text"))
    full = _rows_by_component(rows, every, n).where("n > 0").select("component", key.alias("key")).groupBy("component", "key").count()
    one, n_one = counted(full.groupBy("component").agg(F.min("key").alias("first"), F.sum("count").alias("rows")).where("rows > 1"))
    odd, n_odd = counted(sized_join(full, one.select("component", "first"), "component", "inner", n_one).where("key != first OR count > 1").select("key.odd_id", "key.odd_text", (F.col("key") == F.col("first")).alias("stays")))
    # Rows travel as one column, so that their names can't clash with the ids.
    whole = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("odd_id"), F.xxhash64(F.col(text_col).cast("string")).alias("odd_text"))
    kept = sized_join(whole, odd.select("odd_id", "odd_text"), ["odd_id", "odd_text"], "left_anti", n_odd).select("row.*")
    repeated, m = counted(odd.where("stays").select("odd_id", "odd_text"))
    again = sized_join(whole, repeated, ["odd_id", "odd_text"], "left_semi", m)
    return kept.unionByName(again.groupBy("odd_id", "odd_text").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, gram FROM (
  SELECT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
