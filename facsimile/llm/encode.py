"""Token ids of whole texts with the tokenizers library, one call for each distinct piece of a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

PIECES_KEPT = 400_000   # pieces a worker remembers, of
PIECE_BYTES = 48        # bytes at most; a longer one is encoded whenever it comes
PER_CALL = 1_000        # pieces encoded in one call of the library

#: Letters and digits that normalisation neither joins to a neighbour nor takes apart: ASCII and Latin up to U+024F without U+0130.
_PLAIN = "0-9A-Za-zÀ-ÖØ-öø-įı-ɏ"
_MARKS = "!-/:-@\\[-`{-~"
_WORD = f"^[{_PLAIN}]+[{_MARKS}]*$"
_HEAD = f"^[{_PLAIN}]+"
_TAIL = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def _gather(pool: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` one after the other."""
    end = np.cumsum(size)
    return pool[np.repeat(first - end + size, size) + np.arange(end[-1] if len(end) else 0)]


class WordEncoder:
    """Encodes batches of texts with a tokenizer that never merges across white space.

    Such a tokenizer (it drops white space before its merges, lower-cases, and takes runs
    of letters and runs of other signs apart) gives a text the ids of its white-space
    separated words, one after the other; and a word of plain letters and digits with
    ASCII signs behind it the ids of the lower-cased letters, then of the signs.  Any
    other word goes through the library whole.  Words are cut at ASCII white space only,
    which such a tokenizer always drops.  ``check`` compares with the plain call.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self._forget()

    def _forget(self) -> None:
        self.pieces = pa.array([], pa.large_string())
        self.first = self.size = np.zeros(0, np.int64)
        self.used = np.zeros(0, bool)
        self.pool = np.zeros(0, "<u4")

    def _library(self, words: list[str], one_piece: bool) -> tuple[list[np.ndarray], list[int]]:
        """(ids, ids of each word) of words that hold no ASCII white space."""
        out, size = [], []
        for i in range(0, len(words), PER_CALL):
            part = words[i:i + PER_CALL]
            joined = " ".join(part)
            if one_piece:
                ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
                last = np.flatnonzero(self.ends[ids])
                if len(last) == len(part):
                    out.append(ids)
                    size += np.diff(last, prepend=-1).tolist()
                    continue
            enc = self.tokenizer.encode(joined, add_special_tokens=False)
            starts = np.fromiter((o[0] for o in enc.offsets), np.int64, len(enc.offsets))
            cut = np.searchsorted(starts, np.cumsum([0, *(len(w) + 1 for w in part)]))
            out.append(np.array(enc.ids, "<u4"))
            size += np.diff(cut).tolist()
        return out, size

    def _learned(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each piece) of pieces not remembered."""
        words = new.to_pylist()
        # like pieces next to each other are still in the library's own memory
        order = sorted(range(len(words)), key=words.__getitem__)
        letters = [i for i in order if words[i].isalpha()]
        others = [i for i in order if not words[i].isalpha()]
        ids, size = [], []
        for part, one_piece in ((letters, True), (others, False)):
            got = self._library([words[i] for i in part], one_piece)
            ids += got[0]
            size += got[1]
        flat = np.concatenate([np.zeros(0, "<u4"), *ids])
        n, first = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at = np.array(letters + others, np.int64)
        n[at] = size
        first[at] = np.cumsum(size) - size
        return _gather(flat, first, n), n

    def _look_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, first, size) of distinct pieces, those not known encoded and remembered."""
        at = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy()
        fresh = at < 0
        new = pieces.filter(pa.array(fresh))
        flat, n = self._learned(new)
        first, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        known = ~fresh
        first[known], size[known] = self.first[at[known]], self.size[at[known]]
        self.used[at[known]] = True
        first[fresh], size[fresh] = len(self.pool) + np.cumsum(n) - n, n
        pool = np.concatenate([self.pool, flat])
        short = pc.binary_length(new).to_numpy() <= PIECE_BYTES
        if len(self.pieces) + short.sum() > PIECES_KEPT:        # those not met again since the last time go
            keep = np.flatnonzero(self.used) if 2 * self.used.sum() < PIECES_KEPT else np.zeros(0, np.int64)
            old = self.pool, self.first[keep], self.size[keep]
            words = self.pieces.take(pa.array(keep))
            self._forget()
            if len(keep) + short.sum() <= PIECES_KEPT:
                self._remember(words, *old)
        if short.sum() <= PIECES_KEPT:
            self._remember(new.filter(pa.array(short)), flat, (np.cumsum(n) - n)[short], n[short])
        return pool, first, size

    def _remember(self, words: pa.Array, pool: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        own = _gather(pool, first, size)
        self.pieces = pa.concat_arrays([self.pieces, words])
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.used = np.concatenate([self.used, np.zeros(len(size), bool)])
        self.pool = np.concatenate([self.pool, own])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, limits of each text in them); a null text is empty."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = words.flatten().dictionary_encode()
        limits, each = words.offsets.to_numpy(), coded.indices.to_numpy()
        limits = limits - limits[0]
        distinct = coded.dictionary
        plain = pc.match_substring_regex(distinct, _WORD)
        core = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(distinct, _TAIL)), distinct)
        tail = pc.if_else(plain, pc.replace_substring_regex(distinct, _HEAD, ""), "")
        both = pa.concat_arrays([core, tail.cast(pa.large_string()), pa.array([""], pa.large_string())]).dictionary_encode()
        pool, first, size = self._look_up(both.dictionary)
        piece = both.indices.to_numpy()[:-1].reshape(2, -1).T
        pool = _gather(pool, first[piece].ravel(), size[piece].ravel())    # of distinct words now
        size = size[piece].sum(1)
        n = size[each]
        out = _gather(pool, (np.cumsum(size) - size)[each], n), np.concatenate([[0], np.cumsum(n)])[limits]
        del words, coded, distinct, each, plain, core, tail, both
        pa.default_memory_pool().release_unused()       # a worker that waits keeps little
        return out

    def check(self, text: str) -> bool:
        plain = self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.encode(pa.array([text]))[0].tolist() == plain


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
