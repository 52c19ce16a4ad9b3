"""Vector bin packing of token sequences.

An example is a vector: tokens, segments, loss-bearing tokens. A sequence has a capacity in each of them. The dot-product heuristic
fills one sequence at a time: of the waiting examples that fit, it takes the one whose vector, in shares of the capacities, has the
largest dot product with what is left. Examples that may be cut fill the rest of a sequence exactly.

Of a piece of a document those tokens bear loss that make a pair with the one before for the first time in the piece: what repeats itself
is only read. Of a conversation the assistant's tokens do, and its turns are segments.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmix.llm.batches import bounded, byte_signs, chunks, tidied

#: Examples that wait in a task, and tokens of a sequence.
POOL, SEQUENCE = 1024, 2048
#: Words that a task remembers, about 150 MB with their ids; most tasks don't meet so many.
CACHE = 600_000
#: Stands behind a word's last byte. Signs that the tokenizer splits from a letter or digit before them.
END = b"\xff"
SIGNS = ".,;:!?*#$%&|<>()[]{}/+=\"-_"


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence."""

    tokens: int = SEQUENCE
    segments: int = 8
    #: Most short texts have more in their tokens, most long ones less, so that both are needed to fill a sequence.
    loss_tokens: int = SEQUENCE * 7 // 8


#: Of whole conversations: half of a sequence may bear loss, and some turns have none.
DIALOGUE = Limits(SEQUENCE, 16, SEQUENCE // 2)


def loss_bearing(ids: np.ndarray) -> int:
    """Tokens of a piece that make a pair with the one before for the first time; a beginning never has more than the whole."""
    if len(ids) < 2:
        return 0
    pairs = np.sort(ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:].astype(np.uint64))
    return 1 + int(np.count_nonzero(pairs[1:] != pairs[:-1]))


@dataclass
class Packer:
    """Packs examples of one task as they come; holds at most POOL of them.

    With ``cut`` an example may be split anywhere, and ``loss_of`` gives the loss-bearing tokens of a piece. Long examples first give
    whole sequences; a sequence with one segment left, or with room for no whole example, takes the beginning of the longest one. What
    is left at the end, or a sequence that is full in segments or loss before it is in tokens, is dealt into sequences of a power of
    two, which need no padding. Without ``cut`` examples say their segments and loss, and a sequence closes when nothing fits.
    """

    limits: Limits = field(default_factory=Limits)
    cut: bool = True
    pool: int = POOL
    loss_of: Callable = len

    def __post_init__(self):
        self.caps = np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens], dtype=float)
        self.items: list = [None] * self.pool
        self.sizes = np.full((self.pool, 3), np.inf)
        self.free = list(range(self.pool))[::-1]
        self.sequences = 0

    def add(self, key, start: int, ids, loss: int | None = None, segments: int = 1) -> Iterator[tuple]:
        """Take an example; yields the pieces of sequences that it completes, as (key, start, ids, sequence, offset)."""
        if self.cut:
            while len(ids) >= self.caps[0] or self.loss_of(ids) >= self.caps[2]:
                n = self._reach(ids, self.caps[0], self.caps[2])
                yield from self._close([(key, start, ids[:n])])
                start, ids = start + n, ids[n:]
            if not len(ids):
                return
            loss = self.loss_of(ids)
        else:
            loss = len(ids) if loss is None else loss
            if (np.array([len(ids), segments, loss]) > self.caps).any():
                yield from self._close([(key, start, ids)])
                return
        self._wait(key, start, ids, segments, loss)
        while not self.free:
            yield from self._sequence()

    def finish(self) -> Iterator[tuple]:
        """The sequences of what still waits."""
        while len(self.free) < self.pool:
            yield from self._sequence()

    def _reach(self, ids, tokens: float, loss: float) -> int:
        """Length of the longest beginning within both limits, one at least."""
        low, high = 1, max(1, min(len(ids), int(tokens)))
        if self.loss_of(ids[:high]) <= loss:
            return high
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.loss_of(ids[:middle]) <= loss else (low, middle - 1)
        return low

    def _wait(self, key, start, ids, segments, loss):
        at = self.free.pop()
        self.items[at] = (key, start, ids)
        self.sizes[at] = (len(ids), segments, loss)

    def _take(self, at):
        item, self.items[at] = self.items[at], None
        self.sizes[at] = np.inf
        self.free.append(at)
        return item

    def _sequence(self):
        left, chosen, shares = self.caps.copy(), [], self.sizes / self.caps
        while not self.cut or left[1] > 1:
            fits = (self.sizes <= left).all(axis=1)
            if not fits.any():
                break
            at = int(np.argmax(np.where(fits, np.where(fits[:, None], shares, 0.0) @ (left / self.caps), -1.0)))
            left -= self.sizes[at]
            chosen.append(self._take(at))
        if self.cut and left[0] >= 1 and left[1] >= 1 and left[2] >= 1 and len(self.free) < self.pool:
            at = int(np.argmax(np.where(np.isfinite(self.sizes[:, 0]), self.sizes[:, 0], -1.0)))
            key, start, ids = self._take(at)
            n = self._reach(ids, left[0], left[2])
            chosen.append((key, start, ids[:n]))
            if n < len(ids):
                self._wait(key, start + n, ids[n:], 1, self.loss_of(ids[n:]))
        yield from self._close(chosen)

    def _close(self, chosen):
        total = sum(len(x[2]) for x in chosen)
        sizes = [total] if not self.cut or total == self.limits.tokens else [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
        offset, left = 0, sizes.pop(0) if sizes else 0
        for key, start, ids in chosen:
            while len(ids):
                if not left:
                    self.sequences += 1
                    offset, left = 0, sizes.pop(0)
                piece, ids = ids[:left], ids[left:]
                yield key, start, piece, self.sequences, offset
                start, offset, left = start + len(piece), offset + len(piece), left - len(piece)
        self.sequences += 1


def _letters(vocab: dict[str, int], tokenizer):
    """A function from a lower-case word's bytes and END to its ids, or None where the vocabulary has no word ends."""
    if not any(x.endswith("</w>") for x in vocab):
        return None
    shown = {c: b for b, c in enumerate(byte_signs())}
    ranks = {bytes([b]): 1 << 30 | b for b in range(256)}
    for token, k in vocab.items():
        core, end = (token[:-4], END) if token.endswith("</w>") and len(token) > 4 else (token, b"")
        if all(c in shown for c in core):
            ranks[bytes(shown[c] for c in core) + end] = k
    return tiktoken.Encoding("words", pat_str="x", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class Words:
    """Ids of white-space separated words under one tokenizer; its normaliser and split must keep white space apart."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # Words of letters alone are merged by ranks, a byte that UTF-8 lacks standing for the word's end.
        vocab = json.loads(self.tokenizer.to_str())["model"]["vocab"]
        self.merge = _letters(vocab, self.tokenizer)
        # Texts with special tokens, or with the separators that only Python takes for white space, are encoded whole.
        self.special = [*(x.content for x in self.tokenizer.get_added_tokens_decoder().values()), "\x1c", "\x1d", "\x1e", "\x1f"]
        self.forget()

    def forget(self):
        """Give up the words that are remembered, and their memory."""
        self.at: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 20, dtype=np.uint32), 0
        self.starts, self.sizes = np.zeros(CACHE * 2, dtype=np.int64), np.zeros(CACHE * 2, dtype=np.int64)

    def _learn(self, words: list[str]):
        """Remember words. Signs that end a word are a piece of their own after a letter or digit, so the rest may be known already."""
        at, parts = self.at, []
        for word in words:
            core = word.rstrip(SIGNS)
            parts.append((core, word[len(core) :]) if core and len(core) < len(word) and core[-1].isalnum() else (word, ""))
        new = [x for x in dict.fromkeys(chain.from_iterable(parts)) if x and x not in at]
        merge = self.merge
        found = [merge(w.encode() + END) if w.isascii() and w.isalpha() else merge(unicodedata.normalize("NFC", w).lower().encode() + END) if w.isalpha() and "Σ" not in w else None for w in new] if merge else [None] * len(new)
        rest = [k for k, x in enumerate(found) if x is None]
        for k in range(0, len(rest), 4096):
            for at_, ids in zip(rest[k : k + 4096], self.tokenizer.encode_batch_fast([new[x] for x in rest[k : k + 4096]], add_special_tokens=False)):
                found[at_] = ids.ids
        if new:
            self._store(new, np.fromiter(map(len, found), dtype=np.int64, count=len(new)), np.fromiter(chain.from_iterable(found), dtype=np.uint32))
        both = [(core + tail, at[core], at[tail]) for core, tail in parts if tail]
        if both:
            cores, tails = (np.array([x[k] for x in both]) for k in (1, 2))
            pairs = np.stack([cores, tails], axis=1).ravel()
            self._store([x[0] for x in both], self.sizes[cores] + self.sizes[tails], self._gather(pairs)[0])

    def _store(self, words: list[str], sizes: np.ndarray, ids: np.ndarray):
        n, total = len(self.at), len(words) + len(self.at)
        if total > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * total), np.resize(self.sizes, 2 * total)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        self.flat[self.used : self.used + len(ids)] = ids
        ends = np.cumsum(sizes)
        self.starts[n:total], self.sizes[n:total] = self.used + ends - sizes, sizes
        self.at.update(zip(words, range(n, total)))
        self.used += len(ids)

    def _gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and where each word's end."""
        sizes = self.sizes[index]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[index] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], ends

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, as the tokenizer gives them for the whole text."""
        if len(self.at) > CACHE:
            self.forget()
        out: list = [None] * len(texts)
        split: list[list[str]] = []
        where: list[int] = []
        for k, text in enumerate(texts):
            text = text or ""
            if any(x in text for x in self.special):
                out[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            else:
                # Lower case first makes more words alike; a final sigma is the one letter that Python lowers by its place.
                split.append((text if "Σ" in text else text.lower()).split())
                where.append(k)
        at = self.at
        counts = [len(x) for x in split]
        every = list(chain.from_iterable(split))
        index = np.fromiter(map(at.get, every, repeat(-1)), dtype=np.int64, count=len(every))
        missing = np.flatnonzero(index < 0).tolist()
        if missing:
            self._learn(list(dict.fromkeys([every[k] for k in missing])))
            index[missing] = [at[every[k]] for k in missing]
        every, ends = self._gather(index)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        for k, a, b in zip(where, bounds, bounds[1:]):
            out[k] = every[a:b]
        return out


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    """The tokenizer of a file, kept by the worker."""
    return Words(path)


SCHEMA = "{id} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _batch(pieces: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64()] * 7
    return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*pieces), types)], names=names)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document in a sequence: its place in the document and in the sequence, and a checksum of its ids.

    Each input partition is packed on its own as it is read, so nothing is shuffled, and a task that runs again gives the same
    pieces. A null text counts as empty: only its end id. Rows with null or repeated ids are packed each. No sequence needs
    padding: it has ``limits.tokens`` ids or a power of two, pieces of at most ``limits.segments`` documents, and at most
    ``limits.loss_tokens`` loss-bearing ids. Sequence ids are unique in the result and not dense.
    """
    limits = limits or Limits()
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    names = [x.split()[0] for x in SCHEMA.format(id=id_col).split(", ")]

    def run(batches):
        packer, base, out = Packer(limits, cut=True, loss_of=loss_bearing), TaskContext.get().partitionId() << 36, []

        def rows(pieces):
            for (doc, n), start, ids, sequence, offset in pieces:
                out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, base + sequence, offset))

        encoder = words(tokenizer_path)
        for part in chunks(batches):
            for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(end_id)).astype(np.uint32)
                rows(packer.add((doc, len(ids)), 0, ids))
            if len(out) >= 5000:
                yield _batch(out, names)
                out.clear()
        # Workers outlive their tasks, and other stages need the memory.
        encoder.forget()
        rows(packer.finish())
        if out:
            yield _batch(out, names)

    return bounded(kept).mapInArrow(tidied(run), SCHEMA.format(id=id_col))


def pack_examples(examples: DataFrame, id_col: str, tokens_col: str, loss_col: str, limits: Limits | None = None, segments_col: str | None = None) -> DataFrame:
    """Instruction examples, whole, under all three limits: one row per example with its sequence and offset.

    ``tokens_col``, ``loss_col`` and ``segments_col`` are the example's counts, segments 1 without a column; nulls and negative ones
    count as 0. An example beyond a limit by itself gets a sequence of its own. One without tokens has sequence null. Null and repeated
    ids are packed each. Partitions are packed on their own, in order of the examples, so a task that runs again gives the same rows.
    """
    limits = limits or Limits()
    count = lambda c, y: F.greatest(F.coalesce(c.cast("long"), F.lit(0)), F.lit(0)).alias(y)
    kept = examples.select(F.col(id_col).cast("string").alias("id"), count(F.col(tokens_col), "n"), count(F.col(loss_col), "loss"), count(F.col(segments_col) if segments_col else F.lit(1), "segments"))
    names, types = [id_col, "n_tokens", "n_loss", "n_segments", "sequence_id", "offset"], (pa.string(), *[pa.int64()] * 5)

    def run(batches):
        packer, base = Packer(limits, cut=False), TaskContext.get().partitionId() << 36

        def batch(pieces):
            found = [(*key, None if sequence is None else base + sequence, offset) for key, _, _, sequence, offset in pieces]
            return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*found), types)], names=names)

        for part in batches:
            out = []
            for key, n, loss, segments in zip(*(x.to_pylist() for x in part.columns)):
                row = (key, n, loss, segments)
                out += packer.add(row, 0, range(n), loss, segments) if n else [(row, 0, None, None, None)]
            if out:
                yield batch(out)
        if out := list(packer.finish()):
            yield batch(out)

    return kept.sortWithinPartitions("id", "n", "loss", "segments").mapInArrow(tidied(run), f"{id_col} string, n_tokens long, n_loss long, n_segments long, sequence_id long, offset long")


def pack_conversations(turns: DataFrame, tokenizer_path: str, end_id: int = 1, limits: Limits = DIALOGUE, id_col: str = "conv_id", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Whole conversations in sequences: an example is a conversation, its segments are its turns, the assistant's ids bear loss.

    A turn has its text's ids and ``end_id``; a null text is empty, a null role isn't the assistant's. Turns without a conversation's id
    are one conversation. Counts combine before they are shuffled, so a conversation of any number of turns is one row by then.
    """
    kept = turns.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(role_col).cast("string") == "assistant", F.lit(False)).alias("loss"))

    def run(batches):
        encoder = words(tokenizer_path)
        for part in chunks(batches):
            n = [len(x) + 1 for x in encoder.encode(part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, type=pa.int64()), part.column(2)], names=["id", "n", "loss"])
        encoder.forget()

    counted = bounded(kept).mapInArrow(tidied(run), "id string, n long, loss boolean")
    examples = counted.groupBy("id").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("loss"), F.col("n")).otherwise(0)).alias("loss"), F.count("*").alias("turns"))
    packed = pack_examples(examples, "id", "n", "loss", limits, "turns")
    kind = dict(turns.dtypes)[id_col]
    return packed.select(F.col("id").cast(kind).alias(id_col), "n_tokens", "n_loss", "n_segments", "sequence_id", "offset")
