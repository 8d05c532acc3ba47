"""Token counts of a unigram vocabulary: Viterbi over Aho-Corasick matches, without the pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import arrow_limits

SPACE = "▁"
WORDS_KEPT = 400_000
WORD_CHARS = 64     # a longer word is counted whenever it comes
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores, and the penalty below the lowest score for an unknown character.

    A vocabulary of a file keeps the file (``model``), whose normalizer says what becomes
    of white space.  With ``byte_pieces`` an unknown character stands as the pieces of
    its UTF-8 bytes.
    """

    pieces: tuple[tuple[str, float], ...]
    penalty: float = 10.0
    model: bytes = b""
    byte_pieces: bool = False

    @staticmethod
    def from_sentencepiece(path: str) -> Vocabulary:
        """The ordinary pieces of a sentencepiece file with the scores it gives them.

        The scores of a BPE file are the ranks of its merges; they stand in for unigram scores.
        """
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = (i for i in range(sp.get_piece_size())
               if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)))
        has_bytes = sum(sp.is_byte(i) for i in range(sp.get_piece_size())) == 256
        return Vocabulary(tuple((sp.id_to_piece(i), sp.get_score(i)) for i in ids), model=sp.serialized_model_proto(),
                          byte_pieces=has_bytes)


class Counter:
    """Best score and number of pieces of a string.

    Of two ways to an end with one score the one with the longer last piece holds (a
    later start must be strictly better), and a character that is no piece by itself may
    stand as unknown; unknown characters next to each other are one piece, or one piece a
    byte if the vocabulary has byte pieces.
    """

    def __init__(self, vocab: Vocabulary):
        self.auto = ahocorasick.Automaton()
        for piece, score in vocab.pieces:
            self.auto.add_word(piece, (len(piece), score))
        if len(self.auto):
            self.auto.make_automaton()
        self.single = {p for p, _ in vocab.pieces if len(p) == 1}
        self.unknown = min((s for _, s in vocab.pieces), default=0.0) - vocab.penalty
        self.bytes = vocab.byte_pieces
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p, _ in vocab.pieces)      # no piece goes on over a space mark
        self.lines = self.bytes and not any("\n" in p and len(p) > 1 for p, _ in vocab.pieces)     # nor over a line break
        self.file = sentencepiece.SentencePieceProcessor(model_proto=vocab.model) if vocab.model else None
        self.known: dict[str, tuple[int, float]] = {}

    def viterbi(self, s: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation of a string; one left-to-right pass."""
        n = len(s)
        score, count, unk = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        if len(self.auto):
            for end, (size, sc) in self.auto.iter(s):
                ends[end + 1].append((size, sc))
        for end in range(1, n + 1):
            best = None
            for size, sc in sorted(ends[end], reverse=True):
                x = sc + score[end - size]
                if best is None or x > best:
                    best, count[end], unk[end] = x, count[end - size] + 1, False
            if s[end - 1] not in self.single:
                x = self.unknown + score[end - 1]
                if best is None or x > best:
                    size = len(s[end - 1].encode()) if self.bytes else not unk[end - 1]
                    best, count[end], unk[end] = x, count[end - 1] + size, True
            score[end] = best
        return count[n], score[n]

    def chunk(self, s: str) -> tuple[int, float]:
        """(pieces, score) of a string that no piece leaves; ``WORDS_KEPT`` of at most ``WORD_CHARS`` are kept."""
        got = self.known.get(s)
        if got is None:
            if self.lines and "\n" in s and s != "\n":
                parts = [self.chunk(t) for t in re.split("(\n)", s) if t]
                got = sum(n for n, _ in parts), sum(x for _, x in parts)
            else:
                got = self.viterbi(s)
            if len(s) <= WORD_CHARS:
                if len(self.known) > WORDS_KEPT:
                    self.known = {}
                self.known[s] = got
        return got

    def words(self, words: list[str]) -> list[tuple[int, float]]:
        return [self.chunk(SPACE + w) if w else (0, 0.0) for w in words]

    def text(self, s: str) -> tuple[int, float]:
        """(pieces, score) of a whole normalized text, cut before each run of space marks if no piece goes on over one."""
        parts = [self.chunk(t) for t in _CHUNK.findall(s)] if self.cuts else [self.viterbi(s)]
        return sum(n for n, _ in parts), sum(x for _, x in parts)

    def batch(self, text: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and scores of the texts of a batch, once a distinct word of it."""
        if self.file:
            text = pa.array([self.file.normalize(t) for t in text.to_pylist()], pa.large_string())
            words = pc.split_pattern(text, SPACE)
        else:
            words = pc.ascii_split_whitespace(text)
        flat = words.flatten()
        limits = words.offsets.to_numpy()
        limits = limits - limits[0]
        odd = np.zeros(0, int)
        if self.file and len(text):     # texts that do not begin with a mark or have marks in runs or at the end
            empty = pc.binary_length(flat).to_numpy() == 0
            empty[limits[:-1]] ^= True
            odd = np.flatnonzero(np.add.reduceat(empty, limits[:-1])) if self.cuts else np.arange(len(text))
        if len(odd) == len(text):
            got = [self.text(t) for t in text.to_pylist()]
            return np.array([n for n, _ in got], np.int64), np.array([x for _, x in got], float)
        coded = flat.dictionary_encode()
        each = coded.indices.to_numpy()
        got = np.array(self.words(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), float).reshape(-1, 2)
        n = np.diff(np.concatenate([[0], np.cumsum(got[each, 0].astype(np.int64))])[limits])
        score = np.array([got[each[lo:hi], 1].sum() for lo, hi in zip(limits[:-1], limits[1:])], float)
        for i in odd.tolist():
            n[i], score[i] = self.text(text[i].as_py())
        return n, score


def count_tokens(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, score): pieces of every whole text and the score of the best segmentation.

    The text of a file's vocabulary is what the file's normalizer makes of it: every
    space and line break is kept unless it says otherwise, and an empty text has 0
    tokens.  With a vocabulary of no file, words are cut at ASCII white space, which is
    dropped, and each begins with the space mark, as pieces that hold that mark only at
    their start (or nothing else) need; a blank text has 0 tokens.  A null text has 0
    tokens and score 0.  Of segmentations with equal scores the one whose last piece is
    longest wins, as in the unigram libraries.  Repeated rows and null ids are counted one by one; no
    rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(vocab)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for b in batches:
            n, score = counter.batch(pc.fill_null(b.column(1).cast(pa.large_string()), ""))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(score)], names=["id", "n_tokens", "score"])

    out = src.mapInArrow(run, f"id {kind}, n_tokens long, score double")
    return out.withColumnRenamed("id", id_col)
