"""Byte-level BPE by forced boundaries.

A byte pair that occurs inside no vocabulary token can never be bridged by a merge, so every such pair in a text marks a certain
cut. Words of the public split pattern are cut there, the fragments are encoded one by one, and their ids are concatenated.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmix.llm.batches import bounded, byte_signs, map_text, tidied

#: Words and fragments that a worker remembers at most.
CACHE = 300_000


class ForcedBpe:
    """Encoder and decoder of one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, special: dict[str, int]):
        self.ranks, self.special = ranks, special
        self.bytes_of = {v: k for k, v in ranks.items()} | {v: k.encode() for k, v in special.items()}
        self.inside = np.zeros((256, 256), dtype=bool)
        for token in ranks:
            if len(token) > 1:
                codes = np.frombuffer(token, dtype=np.uint8)
                self.inside[codes[:-1], codes[1:]] = True
        self.bridged = self.inside.tobytes()
        self.split = regex.compile(pattern)
        self.special_split = regex.compile("|".join(f"({regex.escape(x)})" for x in special)) if special else None
        self.merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.fragments: dict[bytes, list[int]] = {}
        self.words: dict[str, tuple[int, str, bytes]] = {}

    def cuts(self, data: bytes) -> list[bytes]:
        """The fragments of a word: certain cuts lie between bytes that stand together in no token."""
        if not data:
            return []
        bridged = self.bridged
        at = [k for k, (a, b) in enumerate(zip(data, data[1:]), 1) if not bridged[a << 8 | b]]
        return [data[a:b] for a, b in zip([0, *at], [*at, len(data)])]

    def word(self, word: str) -> list[int]:
        """Ids of one word of the split pattern."""
        out: list[int] = []
        for piece in self.cuts(word.encode()):
            ids = self.fragments.get(piece)
            if ids is None:
                if len(self.fragments) >= CACHE:
                    self.fragments.clear()
                whole = self.ranks.get(piece)
                ids = self.fragments[piece] = [whole] if whole is not None else list(self.merge(piece))
            out += ids
        return out

    def parts(self, text: str):
        """Pieces of the text: words, and strings of special tokens."""
        if self.special_split is None:
            yield False, text
            return
        last = 0
        for m in self.special_split.finditer(text):
            yield False, text[last : m.start()]
            yield True, m[0]
            last = m.end()
        yield False, text[last:]

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        out: list[int] = []
        for special, part in self.parts(text):
            if special:
                out.append(self.special[part])
            else:
                for word in self.split.findall(part):
                    out += self.word(word)
        return out

    def decode(self, ids) -> str:
        """The text of ids, special tokens kept; broken UTF-8 becomes the replacement character."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and of the decoded text; the words' ids and bytes are remembered between texts."""
        seen, n, ids, raw = self.words, 0, [], []
        for special, part in self.parts(text):
            for word in [part] if special else self.split.findall(part):
                known = None if special else seen.get(word)
                if known is None:
                    found = [self.special[word]] if special else self.word(word)
                    known = (len(found), ",".join(map(str, found)), b"".join(map(self.bytes_of.__getitem__, found)))
                    if not special and len(word) <= 64:
                        if len(seen) >= CACHE:
                            seen.clear()
                        seen[word] = known
                n += known[0]
                ids.append(known[1])
                raw.append(known[2])
        text = b"".join(raw).decode("utf-8", errors="replace")
        return n, hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ForcedBpe:
    """The encoder of a byte-level tokenizer file (vocabulary, merges, added tokens), kept by the worker.

    ``pattern`` splits text before the merges. ValueError for files whose ids aren't in the order of their merges, or whose added
    tokens strip or need blanks.
    """
    with open(path, encoding="utf-8") as lines:
        given = json.load(lines)
    shown = {c: bytes([b]) for b, c in enumerate(byte_signs())}
    special = {x["content"]: x["id"] for x in given["added_tokens"]}
    ranks = {b"".join(map(shown.__getitem__, token)): k for token, k in given["model"]["vocab"].items() if token not in special}
    pairs = (x.split(" ") if isinstance(x, str) else x for x in given["model"]["merges"])
    made = [given["model"]["vocab"][a + b] for a, b in pairs]
    if made != sorted(made) or any(x[y] for x in given["added_tokens"] for y in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: merges out of order, or added tokens with conditions")
    return ForcedBpe(ranks, pattern, special)


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: number of ids, digest of the ids, digest of the decoded text.

    ``path`` is a tokenizer file that every executor has, as part of an installed package. A null text counts as empty: no ids,
    digests of the empty string. Ids of documents may be null or repeat; each row is encoded on its own. Nothing is shuffled, and a
    worker holds about two megabytes of text and CACHE words.
    """

    def rows(ids, texts):
        bpe = load(path, pattern)
        found = [bpe.digest(x or "") for x in texts]
        return {"n_tokens": [x[0] for x in found], "ids_sha256": [x[1] for x in found], "decoded_sha256": [x[2] for x in found]}

    return map_text(docs, id_col, text_col, rows, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its ids as an array; a null text has none."""

    def rows(ids, texts):
        bpe = load(path, pattern)
        return {"ids": pa.array([bpe.encode(x or "") for x in texts], type=pa.list_(pa.int32()))}

    return map_text(docs, id_col, text_col, rows, "ids array<int>")


def decode_ids(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row with the text of its ids, special tokens kept; null ids give null, an id of no token an error."""

    def run(batches):
        bpe = load(path, pattern)
        for part in batches:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else bpe.decode(x) for x in part.column(1).to_pylist()], type=pa.string())], names=[id_col, "text"])

    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return bounded(kept).mapInArrow(tidied(run), f"{id_col} long, text string")
