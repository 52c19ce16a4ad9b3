"""Language by unigrams over a fixed public vocabulary, all segmentations summed.

A word's probability in a language is the sum over its segmentations of the product of its pieces' probabilities, found by the forward
algorithm. Piece probabilities are learned by expectation maximisation; a text's score is the sum of its words' log probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmix.llm.batches import bounded, chunks, map_text
from strandmix.llm.sampling import crc_mod, hashed_share

#: Labelled documents of each language that a fit takes; words that a worker remembers; rounds of the fit.
PER_LANGUAGE, CACHE, ROUNDS = 600, 500_000, 2
#: Words longer than this are summed in logarithms; those longer than LONG in blocks of so many characters, are not remembered and don't teach.
LINEAR, LONG, BLOCK = 24, 64, 2048
#: Probability of a character that is no piece, and the weight that each piece starts with.
UNKNOWN, PRIOR = 1e-7, 0.02

_LETTER = re.compile(r"[^\W\d_]")
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces by a rolling hash of their characters."""

    def __init__(self, pieces: list[str]):
        pieces = sorted({x for x in pieces if x})
        #: The longest piece bounds every segment of a word.
        self.longest = max(map(len, pieces), default=1)
        hashes = np.array([self._hash(x) for x in pieces], dtype=np.uint64)
        order = np.argsort(hashes)
        self.size, self.hashes, self.ids = len(pieces), hashes[order], order.astype(np.int64)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def spans(self, words: list[str]) -> list[np.ndarray]:
        """For words of one length: by span length, the piece at each place, or ``size`` where there is none."""
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), n).astype(np.uint64) + np.uint64(1)
        out, h = [], codes
        for s in range(1, min(n, self.longest) + 1):
            if s > 1:
                h = h[:, :-1] * _BASE + codes[:, s - 1 :]
            if not len(self.hashes):
                out.append(np.zeros(h.shape, dtype=np.int64))
                continue
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            out.append(np.where(self.hashes[at] == h, self.ids[at], self.size))
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a model file, kept by the worker; lower-cased, as words are."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Vocabulary([model.id_to_piece(k).lower() for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))])


def _by_length(words: list[str]):
    groups: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        groups.setdefault(len(word), []).append(k)
    for n, members in sorted(groups.items()):
        step = max(1, (1 << 17) // n)
        for k in range(0, len(members), step):
            yield n, members[k : k + step]


def _span_probabilities(spans: list[np.ndarray], table: np.ndarray) -> list[np.ndarray]:
    """table: probabilities by piece and language, the last row zeros. Single characters have UNKNOWN at least."""
    found = [table[x] for x in spans]
    found[0] = np.maximum(found[0], UNKNOWN)
    return found


def _steps(spans: list[np.ndarray], size: int) -> list[list[tuple[int, np.ndarray | None]]]:
    """By place: the lengths of pieces that end there in any of the words, and which words (None: all). Long pieces are rare."""
    n = spans[0].shape[1]
    ends: list[list[tuple[int, np.ndarray | None]]] = [[] for _ in range(n + 1)]
    for s, at in enumerate(spans, 1):
        if s == 1:
            for j in range(1, n + 1):
                ends[j].append((1, None))
            continue
        hit = at != size
        for j in np.flatnonzero(hit.any(axis=0)).tolist():
            ends[j + s].append((s, None if 4 * np.count_nonzero(hit[:, j]) > len(hit) else np.flatnonzero(hit[:, j])))
    return ends


def _alphas(p: list[np.ndarray], steps, linear: bool) -> list[np.ndarray]:
    """Probability of each beginning of the words, or its logarithm; ``p`` has the spans' alike."""
    shape, n = p[0][:, 0].shape, p[0].shape[1]
    alpha = [np.ones(shape) if linear else np.zeros(shape)]
    for j in range(1, n + 1):
        total = alpha[j - 1] * p[0][:, j - 1] if linear else alpha[j - 1] + p[0][:, j - 1]
        for s, rows in steps[j][1:]:
            if rows is None:
                total = total + alpha[j - s] * p[s - 1][:, j - s] if linear else np.logaddexp(total, alpha[j - s] + p[s - 1][:, j - s])
            elif linear:
                total[rows] += alpha[j - s][rows] * p[s - 1][rows, j - s]
            else:
                total[rows] = np.logaddexp(total[rows], alpha[j - s][rows] + p[s - 1][rows, j - s])
        alpha.append(total)
    return alpha


def _in_scale(spans, table, linear: bool) -> list[np.ndarray]:
    p = _span_probabilities(spans, table)
    if linear:
        return p
    with np.errstate(divide="ignore"):
        return [np.log(x) for x in p]


def forward_long(vocab: Vocabulary, table: np.ndarray, word: str) -> np.ndarray:
    """The same sum for one word of any length: only the last ``longest`` beginnings are kept, as numbers that are scaled every few characters.

    Memory is that of a block's spans, whatever the word's length, besides the word itself.
    """
    longest, languages, n = vocab.longest, table.shape[1], len(word)
    alpha = np.zeros((longest + BLOCK, languages))
    alpha[longest - 1] = 1.0
    scale = np.zeros(languages)
    for a in range(0, n, BLOCK):
        m, first = min(BLOCK, n - a), max(0, a - longest + 1)
        spans = vocab.spans([word[first : a + m]])
        # weights[i, k]: of the piece that ends behind character a + i and has longest - k characters.
        weights = np.zeros((m, longest, languages))
        for s, at in enumerate(spans, 1):
            p = table[at[0]]
            if s == 1:
                p = np.maximum(p, UNKNOWN)
            ends = first + np.arange(len(p)) + s - 1 - a
            inside = ends >= 0
            weights[ends[inside], longest - s] = p[inside]
        for i in range(m):
            np.einsum("kl,kl->l", alpha[i : i + longest], weights[i], out=alpha[i + longest])
            if i % 8 == 7 or i == m - 1:
                top = alpha[i + longest].copy()
                alpha[i + 1 : i + longest + 1] /= top
                scale += np.log(top)
        alpha[:longest] = alpha[m : m + longest].copy()
    return scale + np.log(alpha[longest - 1])


def forward(vocab: Vocabulary, table: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word in each language, all segmentations summed. Words have one character at least."""
    out = np.zeros((len(words), table.shape[1]))
    for k, word in enumerate(words):
        if len(word) > LONG:
            out[k] = forward_long(vocab, table, word)
    short = [k for k, word in enumerate(words) if len(word) <= LONG]
    for n, members in _by_length([words[k] for k in short]):
        members = [short[k] for k in members]
        linear = n <= LINEAR
        spans = vocab.spans([words[k] for k in members])
        last = _alphas(_in_scale(spans, table, linear), _steps(spans, vocab.size), linear)[n]
        out[members] = np.log(last) if linear else last
    return out


def expected(vocab: Vocabulary, table: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language, over all segmentations of all words, in logarithms for long ones."""
    total = np.zeros((vocab.size + 1, table.shape[1]))
    for n, members in _by_length(words):
        linear = n <= LINEAR
        spans = vocab.spans([words[k] for k in members])
        p, steps = _in_scale(spans, table, linear), _steps(spans, vocab.size)
        alpha = _alphas(p, steps, linear)
        beta = [np.zeros_like(alpha[0]) if linear else np.full_like(alpha[0], -np.inf) for _ in range(n)] + [np.ones_like(alpha[0]) if linear else np.zeros_like(alpha[0])]
        weight = counts[members]
        for j in range(n, 0, -1):
            for s, rows in steps[j]:
                at = slice(None) if rows is None else rows
                if linear:
                    ahead = p[s - 1][at, j - s] * beta[j][at]
                    beta[j - s][at] += ahead
                    use = alpha[j - s][at] * ahead * weight[at] / alpha[n][at]
                else:
                    ahead = p[s - 1][at, j - s] + beta[j][at]
                    beta[j - s][at] = np.logaddexp(beta[j - s][at], ahead)
                    use = np.exp(alpha[j - s][at] + ahead - alpha[n][at]) * weight[at]
                for k in range(table.shape[1]):
                    total[:, k] += np.bincount(spans[s - 1][at, j - s], weights=use[:, k], minlength=vocab.size + 1)
    return total


@dataclass
class LanguageModel:
    """Languages and their piece probabilities; the last row of the table stands for no piece."""

    languages: list[str]
    table: np.ndarray
    _at: dict[str, int] = field(default_factory=dict, repr=False)
    _known: np.ndarray | None = field(default=None, repr=False)

    def texts(self, vocab: Vocabulary, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; ``und`` and 0 where there is no letter or no language."""
        if self._known is None or len(self._at) > CACHE:
            self._at, self._known = {}, np.zeros((0, len(self.languages)))
        with_letters = [bool(x and self.languages and _LETTER.search(x)) for x in texts]
        split = [x.lower().split() if ok else [] for x, ok in zip(texts, with_letters)]
        at = self._at
        new = list(dict.fromkeys(w for words in split for w in words if len(w) < LONG and w not in at))
        if new:
            rows = forward(vocab, self.table, ["▁" + w for w in new])
            at.update(zip(new, range(len(self._known), len(self._known) + len(new))))
            self._known = np.concatenate([self._known, rows])
        names, scores = [], []
        for words, ok in zip(split, with_letters):
            if not ok:
                names.append("und")
                scores.append(0.0)
                continue
            known = [w for w in words if len(w) < LONG]
            total = self._known[np.fromiter(map(at.__getitem__, known), dtype=np.int64, count=len(known))].sum(axis=0)
            for word in words if len(known) < len(words) else ():
                if len(word) >= LONG:
                    total = total + forward_long(vocab, self.table, "▁" + word)
            best = int(np.argmax(total))
            names.append(self.languages[best])
            scores.append(float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum()))
        return names, scores


def learn(vocab: Vocabulary, languages: list[str], words: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> LanguageModel:
    """Expectation maximisation from equal probabilities. counts: by word and language."""
    table = np.full((vocab.size + 1, len(languages)), 1.0 / max(1, vocab.size))
    table[-1] = 0
    for _ in range(rounds if words else 0):
        uses = expected(vocab, table, ["▁" + w for w in words], counts)[:-1] + PRIOR
        table = np.concatenate([uses / uses.sum(axis=0), np.zeros((1, len(languages)))])
    return LanguageModel(languages, table)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches):
        uses = Counter((w, lang) for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for w in text.lower().split() if len(w) < LONG)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in uses], pa.string()), pa.array([x for _, x in uses], pa.string()), pa.array(list(uses.values()), pa.int64())], names=["word", "lang", "n"])


def train(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from about ``per_language`` documents of each language, chosen by a hash among those with crc32(id) mod 4 other than 2.

    Only the sample's word counts come to the driver, a few tens of MB at most; words of LONG characters or more, which are runs without
    blanks rather than words, stay away. Words are split and lower-cased as prediction does. Null texts, languages and ids teach
    nothing. Languages are classes: their number is that of the labels, which is taken to be small.
    """
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    kept = kept.where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_mod("id", 4) != 2))
    chosen, counts = hashed_share(kept, "id", "lang", per_language)
    got = bounded(chosen.select("lang", "text")).mapInArrow(_word_counts, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n")).collect()
    languages = sorted(counts)
    where = {x: k for k, x in enumerate(languages)}
    every = sorted({r[0] for r in got})
    at = {x: k for k, x in enumerate(every)}
    table = np.zeros((len(every), len(languages)))
    for word, lang, n in got:
        table[at[word], where[lang]] = n
    return learn(vocabulary(vocabulary_path), languages, every, table)


def identify(docs: DataFrame, model: LanguageModel, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: held_out, lang_pred and score, from the whole text and nothing else.

    A null text, or one without letters, is ``und`` with score 0; held_out is null for a null id. Equal scores go to the first
    language in order. Nothing is shuffled; the table, of a fixed size for each language, goes to the executors.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.table.astype(np.float64)))
    state: dict[str, LanguageModel] = {}

    def rows(ids, texts):
        if "model" not in state:
            state["model"] = LanguageModel(*sent.value)
        names, scores = state["model"].texts(vocabulary(vocabulary_path), texts)
        return {"lang_pred": names, "score": scores}

    found = map_text(docs, id_col, text_col, rows, "lang_pred string, score double")
    return found.select(id_col, (crc_mod(id_col, 4) == 2).alias("held_out"), "lang_pred", "score")
