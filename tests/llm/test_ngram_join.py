import random
from collections import defaultdict

import numpy as np
import pytest

from strandmix.llm import ngram_join as J
from strandmix.llm.components import components

SPACE = " \t\n\v\f\r"


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACE:
            if word:
                out.append(word)
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return out + [word] if word else out


def brute(docs):
    sets = []
    for _, text in docs:
        w = words_of(text)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: 10**18)
    for i, (doc, _) in enumerate(docs):
        least[root(i)] = min(least[root(i)], doc)
    return sorted((doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(docs))


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    make = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, base, texts = make(50), make(120), []
    for k in range(n):
        kind = k % 6
        if kind == 0:  # near copies of one text, some too far from it
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 7])):
                text[rng.randrange(len(text))] = rng.choice(vocab)
        elif kind == 1:  # a common passage in short texts
            text = make(rng.randrange(4, 30)) + passage + make(rng.randrange(0, 10))
        elif kind == 2 and texts:  # copies of copies
            text = list(rng.choice(texts))
            for _ in range(rng.randrange(3)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(vocab)
        elif kind == 3:
            text = make(rng.randrange(0, 9))
        else:
            text = make(rng.randrange(10, 90))
        texts.append(text)
    sep = lambda: rng.choice([" ", "  ", "\n", "\t"])
    return [(int(i), "".join(w.upper() + sep() if rng.random() < 0.1 else w + sep() for w in t)) for i, t in zip(rng.sample(range(10**6), n), texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_like_all_pairs(spark, seed):
    docs = corpus(seed)
    got = J.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got)) == brute(docs)


@pytest.mark.parametrize("pending,frequent", [(10**9, 255), (60, 3), (200, 5)])
def test_fragments_settle_alike_however_much_waits(monkeypatch, pending, frequent):
    monkeypatch.setattr(J, "PENDING", pending)
    monkeypatch.setattr(J, "FREQUENT", frequent)
    rng, fragment, entries, out = np.random.default_rng(0), J._Fragment(), [], []
    for block in range(20):
        counts = rng.integers(1, 12, 10)
        nodes, sizes = np.arange(block * 10, block * 10 + 10), np.full(10, 7, dtype="<i4")
        grams = np.concatenate([np.sort(rng.choice(60, c, replace=False)) for c in counts]).astype(np.uint64)
        entries += list(zip(grams.tolist(), np.repeat(nodes, counts).tolist()))
        out += list(fragment.add(grams, nodes, sizes, counts))
    out += list(fragment.settle())
    uses = defaultdict(int)
    for g, _ in entries:
        uses[g] += 1
    found = [(int(g), node, int(rank)) for _, node, _, _, grams, ranks in out for g, rank in zip(np.frombuffer(grams, "<u8"), np.frombuffer(ranks, np.uint8))]
    assert sorted(found) == sorted((g, n, min(uses[g], frequent)) for g, n in entries if uses[g] >= 2)


def test_hash_is_of_the_words():
    a, b = J.shingle_sets(["A b  c d\te F", "a b c d e f"])
    assert (a == b).all() and len(a) == 2
    assert [len(x) for x in J.shingle_sets([None, "", " \n", "x", "x y z", "a a a a a a a a"])] == [0, 0, 0, 1, 1, 1]


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 100), (200, 201), (201, 201)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert {got[k] for k in (*range(41), 100, 101)} == {0} and got[200] == got[201] == 200


def stock_documents(n, seed=5):
    """Documents of 20 of 50 stock sentences: much in common, nothing linked."""
    rng = random.Random(seed)
    stock = [" ".join(f"s{k}w{rng.randrange(10**6)}" for _ in range(10)) for k in range(50)]
    return [(k, " ".join(rng.sample(stock, 20))) for k in range(n)]


def test_few_pairs_of_templated_documents_are_counted_whole(spark, monkeypatch):
    docs = stock_documents(2000) + [(5000, stock_documents(1)[0][1] + " end"), (6000, "solitary words of a text " * 9)]
    seen = []
    counted = J.counted
    monkeypatch.setattr(J, "counted", lambda df: seen.append((df.columns, x := counted(df))) or x)
    got = {r.doc_id: r.component_id for r in J.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {k: 0 if k == 5000 else k for k, _ in docs}
    pairs = [x[1][1] for x in seen if x[0] == ["a", "b"]]
    assert len(pairs) == 4 and pairs[1] + pairs[3] < (pairs[0] + pairs[2]) / 10


def test_sets_of_one_digest_are_told_apart(spark, monkeypatch):
    docs = [(k, f"{w} of a short text") for k, w in enumerate(["one", "two", "three", "one"])]
    real, tries = J._cut_into_fragments, []

    def cut(fragments, seed):
        tries.append(seed)
        if seed:
            return real(fragments, seed)
        run = real(fragments, seed)

        def same_nodes(batches):
            import pyarrow as pa

            for batch in run(batches):
                rows = batch.to_pylist()
                for r in rows:
                    r["nodes"] = b"\0" * len(r["nodes"])
                yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

        return same_nodes

    monkeypatch.setattr(J, "_cut_into_fragments", cut)
    got = sorted(map(tuple, J.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()))
    assert got == [(0, 1, 0), (1, 1, 1), (2, 1, 2), (3, 1, 0)] and tries == [0, 1]


@pytest.mark.parametrize("small", [500_000, 0])
def test_links_of_representatives_span_the_components(spark, monkeypatch, small):
    from strandmix.llm import sized

    monkeypatch.setattr(sized, "SMALL", small)
    docs = corpus(3, 150)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    sets = {doc: frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w := words_of(text)) >= 5 else frozenset([tuple(w)] if w else []) for doc, text in docs}
    first = {}
    for doc in sorted(sets, reverse=True):
        first[sets[doc]] = doc
    links = [tuple(r) for r in J.representative_links(df).collect()]
    assert all(a < b and first[sets[a]] == a and first[sets[b]] == b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for a, b in links)
    parent = {d: first[s] if s else d for d, s in sets.items()}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    assert sorted((d, len(sets[d]), root(d)) for d in sets) == brute(docs)
    groups = {doc: c for doc, _, c in brute(docs)}
    assert sorted(r.doc_id for r in J.keep_one(df).collect()) == sorted({c for c in groups.values()})


def test_the_shared_folder_is_left_clean(spark, tmp_path):
    import os

    from strandmix.llm.storage import shared_folder

    folder = f"{shared_folder(spark)}/strandmix"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    J.jaccard_join(spark.createDataFrame(corpus(4, 60), "doc_id long, text string")).collect()
    sizes = {x: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{folder}/{x}") for f in fs) for x in set(os.listdir(folder)) - before}
    assert len(sizes) <= 4  # what the result itself reads


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from strandmix.llm import storage

    def session(master, folder=None):
        context = SimpleNamespace(master=master, applicationId=f"x-{master}", getConf=lambda: SimpleNamespace(get=lambda k: None))
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: folder), sparkContext=context)

    assert storage.shared_folder(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert storage.shared_folder(session("local[4]")) == storage.shared_folder(session("local[4]"))
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            storage.shared_folder(session(master))
