"""Token ids of whole texts with a tokenizer file of the tokenizers library.

Splitting into pre-tokens looks at neighbours only across white space, so a text is cut where that
can't matter, each distinct piece is encoded once per Python worker, and a text's ids are the pieces'
ids in order. Cutting, finding the distinct pieces of a slice and putting the ids together work on
whole Arrow columns; only pieces that are new to the worker reach the library.

Where texts are cut. Byte-level files keep white space, and a run of it belongs to the word after it by
its last character alone, if that is a space; so a cut stands before a run, before its last character,
and after that where it is no space. Files with word ends drop white space, so every run of it parts
two pieces. Only the six ASCII white space characters count for this; a text with any other character
that some notion takes for white space is cut before single spaces between visible ASCII characters
alone. All files part letters from other characters, unless an apostrophe stands there; so a cut stands
between an ASCII letter and another visible ASCII character. A text that holds the string of an added
token is one piece.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cadenza.llm.common import text_bytes

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Visible ASCII characters but letters and the apostrophe.
_MARK = _VISIBLE & ~_LETTER
_MARK[0x27] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Characters beyond those six that Unicode or Python count as white space.
_OTHER_SPACES = "[\x1c-\x1f\u0085  ᠎ -​    　﻿]"


class Encoder:
    """Ids of texts. `word_level`: white space separates and is dropped, as in word_bpe files;
    otherwise it is part of pieces, as in byte-level files. The strings of added tokens in a text are
    these tokens, as the library has it. Pieces are remembered in two generations of at most `most`:
    a full one becomes the old one, from which pieces that are met again come back."""

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.word_level = bool(self.tokenizer.model.end_of_word_suffix)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4")
        #: what stands between pieces that are encoded together, and its one id
        self.between = " 0 " if self.word_level else "\n"
        self.between_id = self.tokenizer.encode(self.between, add_special_tokens=False).ids[0]
        self.mark = self.between.strip(" ")
        #: the model alone, for words of ASCII letters; a leading space is the letter that stands for it
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = WhitespaceSplit()
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        # those found in normalised text may be written in other cases
        self.any_case = any(t.normalized for t in added)
        self.added_strings = [t.content for t in added]
        self.added = re.compile("|".join(map(re.escape, self.added_strings)) or "(?!)", re.IGNORECASE if self.any_case else 0)
        vocabulary = self.tokenizer.get_vocab()
        suffix = self.tokenizer.model.end_of_word_suffix or ""
        #: whether an id ends a word, and how many bytes it stands for
        self.ends_word, self.n_bytes = np.zeros(max(vocabulary.values()) + 1, bool), np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.ends_word[k] = bool(suffix) and token.endswith(suffix)
            self.n_bytes[k] = len(token) - len(suffix) * int(self.ends_word[k])
        self.most = most
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    # ---- cutting ----

    def _whole(self, column: pa.Array) -> np.ndarray:
        """Which texts hold the string of an added token."""
        out = np.zeros(len(column), bool)
        for s in self.added_strings:
            out |= pc.match_substring(column, s, ignore_case=self.any_case).to_numpy(zero_copy_only=False)
        return out

    def pieces(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts in order, and each text's first place in them (rows + 1 entries).
        The column has no nulls."""
        data, at = text_bytes(column)
        n = len(data)
        if not n:
            return pa.array([], pa.large_string()), np.zeros(len(at), np.int64)
        whole = self._whole(column)
        other = pc.match_substring_regex(column, _OTHER_SPACES).to_numpy(zero_copy_only=False) & ~whole
        space = _SPACE[data]
        cut = np.zeros(n + 1, bool)
        letter, mark = _LETTER[data], _MARK[data]
        cut[1:-1] = letter[:-1] & mark[1:] | mark[:-1] & letter[1:]
        odd = other | whole
        if self.word_level:
            if whole.any():
                inside = np.repeat(whole, np.diff(at))
                space &= ~inside
                cut[:-1] &= ~inside
                data = np.where(inside, data, _LOWER[data])
            else:
                data = _LOWER[data]
            word = ~space
            cut[1:-1] |= space[:-1]
            cut[at] = True
            begin = np.flatnonzero(cut[:-1] & word)
            # a text that starts with white space has its first word after it
            kept = np.cumsum(word) - word
            offsets = np.append(kept[begin], int(word.sum()))
            data, row_at = data[word], np.searchsorted(begin, at)
        else:
            word = ~space
            last = np.zeros(n, bool)  # the last character of a run that a word follows
            last[:-1] = space[:-1] & word[1:]
            last[at[1:][np.diff(at) > 0] - 1] = False
            first = space.copy()
            first[1:] &= word[:-1]
            cut[:-1] |= first | last
            cut[1:] |= last & (data != 0x20)
            if odd.any():
                inside = np.repeat(odd, np.diff(at))
                single = np.zeros(n, bool)
                visible = _VISIBLE[data]
                single[1:-1] = (data[1:-1] == 0x20) & visible[:-2] & visible[2:]
                single[at[:-1][np.diff(at) > 0]] = False
                single[at[1:][np.diff(at) > 0] - 1] = False
                cut[:-1] = np.where(inside, single & np.repeat(other, np.diff(at)), cut[:-1])
            cut[at] = True
            offsets = np.flatnonzero(cut)
            row_at = np.searchsorted(offsets, at)
        data = np.ascontiguousarray(data)
        return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]), row_at

    # ---- pieces that are new ----

    def _alone(self, pieces: list[str]) -> None:
        for k in range(0, len(pieces), 1000):
            some = pieces[k : k + 1000]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[p] = np.array(e.ids, self.dtype).tobytes()

    def _store(self, pieces: list[str], ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        data, width = ids.tobytes(), self.dtype.itemsize
        self.known.update(zip(pieces, map(data.__getitem__, map(slice, (begin * width).tolist(), (end * width).tolist())), strict=True))

    def _joined(self, text: str, plain: bool = False) -> np.ndarray:
        return np.array((self.plain if plain else self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _together(self, pieces: list[str]) -> None:
        """Words in one call, with a separator of one known id between them."""
        for k in range(0, len(pieces), 500):
            some = pieces[k : k + 500]
            ids = self._joined(self.between.join(some))
            cuts = np.flatnonzero(ids == self.between_id)
            if len(cuts) != len(some) - 1:
                self._alone(some)
            else:
                self._store(some, ids, np.append(0, cuts + 1), np.append(cuts, len(ids)))

    def _in_a_row(self, pieces: list[str], by_bytes: bool, plain: bool = False) -> None:
        """Words that part without help: the bytes of the tokens, or their word ends, tell where one
        stops. plain: of ASCII letters, lower case at word level, after a space at byte level."""
        for k in range(0, len(pieces), 1000):
            some = pieces[k : k + 1000]
            if plain and not self.word_level:
                ids = self._joined("".join(some).replace(" ", " \u0120")[1:], True)
            else:
                ids = self._joined((" " if self.word_level else "").join(some), plain)
            if by_bytes:
                place = np.cumsum(self.n_bytes[ids])
                want = np.cumsum(np.fromiter(map(len, map(str.encode, some)), np.int64, len(some)))
                end = np.searchsorted(place, want) + 1
                fits = len(ids) and place[-1] == want[-1] and (place[np.minimum(end, len(ids)) - 1] == want).all()
            else:
                end = np.flatnonzero(self.ends_word[ids]) + 1
                fits = len(end) == len(some)
            if fits:
                self._store(some, ids, np.append(0, end[:-1]), end)
            else:
                self._together(some)

    def _learn(self, pieces: list[str]) -> None:
        plain, row, ends, together, alone = [], [], [], [], []
        for p in pieces:
            w = p if self.word_level else p[1:] if p[:1] == " " else ""
            if w.isascii() and w.isalpha() and (not self.word_level or w.islower()):
                plain.append(p)
                continue
            words = p.split()
            if len(words) != 1 or self.added.search(p):
                alone.append(p)
            elif self.word_level:
                if len(words[0]) != len(p):
                    alone.append(p)
                elif p.isascii():
                    row.append(p)
                elif p.isalpha():
                    ends.append(p)
                else:
                    (alone if self.mark in p else together).append(p)
            elif len(words[0]) == len(p):
                together.append(p)
            elif len(words[0]) == len(p) - 1 and p[0] == " ":
                row.append(p)
            else:
                alone.append(p)
        self._in_a_row(plain, True, plain=True)
        self._in_a_row(row, True)
        self._in_a_row(ends, False)
        self._together(together)
        self._alone(alone)

    # ---- whole texts ----

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and each text's first place in them (rows + 1 entries); a
        null text is empty. The column should come in slices of some MB."""
        column = column.cast(pa.large_string()).fill_null("")
        pieces, row_at = self.pieces(column)
        if not len(pieces):
            return np.zeros(0, self.dtype), row_at
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found = list(map(self.known.get, distinct))
        gaps = [k for k, f in enumerate(found) if f is None]
        new = []
        for k in gaps:
            p = distinct[k]
            if (f := self.old.get(p)) is not None:
                self.known[p] = f
            else:
                new.append(p)
        self._learn(new)
        for k in gaps:
            found[k] = self.known[distinct[k]]
        if len(self.known) > self.most:
            self.old, self.known = self.known, {}
        flat = np.frombuffer(b"".join(found), self.dtype)
        length = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        which = coded.indices.to_numpy()
        n = length[which]
        ends = np.append(0, np.cumsum(n))
        place = np.repeat((np.cumsum(length) - length)[which] - ends[:-1], n)
        place += np.arange(int(ends[-1]))
        return flat[place], ends[row_at]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and Python worker. Executors run one task a core, so the library's own
    threads are turned off."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
