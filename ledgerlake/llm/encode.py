"""Whole texts to token ids by a public tokenizer, each distinct piece encoded once per worker.

Both tokenizers cut a text at white space before they merge anything, so a text's ids are the
ids of its pieces, one after the other. The texts of a chunk lie in one buffer; its pieces are
spans between the places where a cut is certain, each with the space that leads it. Arrow
numbers the distinct ones, and only these are looked up in a bounded cache and encoded by the
tokenizers library where they are missing; ids are then gathered for all pieces at once. Texts
that hold the beginning of an added token go to the library whole."""

from __future__ import annotations

import gc
import os
from itertools import chain

import numpy as np
import pyarrow as pa

from ledgerlake.llm.common import kept, number_pieces, text_buffer

#: Pieces kept in a worker, about 150 bytes each.
CACHE_ENTRIES = 1_000_000
#: Bytes of text that are cut into pieces together: the more, the fewer distinct pieces a token.
ENCODED_BYTES = 4 << 20
#: Pieces above this length are encoded but not kept.
LONG_PIECE = 64

_BYTES = np.arange(256)
#: By byte: white space, and what else Python or a regular expression may take for it; ASCII letters;
#: ASCII marks other than the apostrophe, which a tokenizer may join with what follows.
_BLANK = np.isin(_BYTES, [*range(9, 14), *range(28, 33)])
_LETTER = np.isin(_BYTES | 32, range(97, 123)) & (_BYTES < 128)
_MARK = (_BYTES > 32) & (_BYTES < 127) & ~_LETTER & ~np.isin(_BYTES, [39, *range(48, 58)])


def _grown(a: np.ndarray, size: int) -> np.ndarray:
    return a if size <= len(a) else np.concatenate([a, np.zeros(max(size, 2 * len(a)) - len(a), a.dtype)])


class Store:
    """Pieces, and the ids of all of them in one array."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.begins, self.lengths, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)
        self.n = self.used = 0

    def add(self, pieces: list[bytes], lengths: np.ndarray, ids: np.ndarray) -> None:
        n, used = self.n + len(pieces), self.used + len(ids)
        self.begins, self.lengths, self.ids = _grown(self.begins, n), _grown(self.lengths, n), _grown(self.ids, used)
        self.begins[self.n : n], self.lengths[self.n : n], self.ids[self.used : used] = self.used + np.cumsum(lengths) - lengths, lengths, ids
        self.place.update(zip(pieces, range(self.n, n)))
        self.n, self.used = n, used

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each place has, and all of them."""
        lengths = self.lengths[places].astype(np.int64)
        at = np.repeat(self.begins[places] - (np.cumsum(lengths) - lengths), lengths)
        at += np.arange(len(at))
        return lengths, self.ids[at]


class Encoder:
    """mode 'dropped': the tokenizer drops white space and lower-cases; a space or line feed is a cut.
    mode 'leading': byte-level pieces start with their space; a cut is before a single
    space between two other characters that are no white space."""

    def __init__(self, path: str, mode: str, entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if mode not in ("dropped", "leading"):
            raise ValueError(mode)
        self.entries, self.lead, self.tokenizer = entries, mode == "leading", Tokenizer.from_file(path)
        #: the pieces met lately, and those met before them, which come back when they are met again
        self.young, self.old = Store(), Store()
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[:1] if self.lead else []
        #: the first two bytes of added tokens
        self.marks = {x.content.encode()[:2] for x in self.tokenizer.get_added_tokens_decoder().values()}
        #: by id: the token begins (leading) or ends (dropped) a run of letters in a joined text
        self.edge = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.edge[i] = token.startswith("Ġ") if self.lead else token.endswith("</w>")

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin: at a space (see the class), between a letter and an ASCII mark on either
        side, as both tokenizers keep runs of letters and runs of marks apart, and in mode 'leading'
        around a line feed between two characters that are no white space. And the data, in mode
        'dropped' with line feeds as spaces and A-Z lower-cased where no combining mark can tell:
        lower and upper case do not compose alike with all of them."""
        n, whole = len(data), np.zeros(len(offsets) - 1, bool)
        text_of = lambda at: np.searchsorted(offsets, at, "right") - 1
        for mark in self.marks:
            found = data[: n - len(mark) + 1] == mark[0]
            if len(mark) > 1:
                found &= data[1:] == mark[1]
            whole[text_of(np.flatnonzero(found))] = True
        before, after = np.concatenate([data[:1], data[:-1]]), np.concatenate([data[1:], data[-1:]])
        two = np.concatenate([data[:2], data[:-2]])
        # letters of ASCII, and those that are 0xC3 and another byte, but for two signs
        ends_letter = _LETTER[before] | ((two == 0xC3) & (before != 0x97) & (before != 0xB7))
        is_letter = _LETTER[data] | ((data == 0xC3) & (after != 0x97) & (after != 0xB7))
        cut = (_MARK[data] & ends_letter) | (_MARK[before] & is_letter)
        if self.lead:
            at = np.flatnonzero((data == 32) | (data == 10))
            three = data[np.maximum(at - 3, 0)]
            # white space beyond ASCII: 0xC2 and one byte, or three bytes from 0xE1, 0xE2 or 0xE3; no cut beside any of these
            beside = _BLANK[before[at]] | _BLANK[after[at]] | (two[at] == 0xC2) | ((three >= 0xE1) & (three <= 0xE3) & (before[at] >= 0x80)) | (after[at] == 0xC2) | ((after[at] >= 0xE1) & (after[at] <= 0xE3))
            # nor where the character begins or ends a text
            edges = np.concatenate([offsets[:-1], offsets[1:] - 1])
            at = at[~beside]
            at = at[~np.isin(at, edges[(edges >= 0) & (edges < n)])]
            cut[at] = True
            cut[at[data[at] == 10] + 1] = True
        else:
            cut |= (data == 32) | (data == 10)
            plain = whole.copy()
            plain[text_of(np.flatnonzero((data == 0xCC) | (data == 0xCD)))] = True
            upper, feed = (data >= 65) & (data <= 90), data == 10
            for i in np.flatnonzero(plain):
                upper[offsets[i] : offsets[i + 1]] = False
            for i in np.flatnonzero(whole):
                feed[offsets[i] : offsets[i + 1]] = False
            data = data + (upper.view(np.uint8) << 5) + 22 * feed.view(np.uint8)
        for i in np.flatnonzero(whole):
            cut[offsets[i] : offsets[i + 1]] = False
        cut[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        return np.flatnonzero(cut), data

    def _joined(self, text: str, n: int, pieces: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of runs of letters that go to the library as one text, since making an encoding costs
        more than the merges; None if the places where the runs meet are not as many as they."""
        (e,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(e.ids, np.uint32)
        if pieces[0][:1] != " ":  # with line feeds between
            feeds = np.flatnonzero(ids == self.feed)
            if len(feeds) != n - 1:
                return None
            lengths = np.diff(np.concatenate([[-1], feeds, [len(ids)]])) - 1
            return lengths, np.delete(ids, feeds)
        at = np.flatnonzero(self.edge[ids])
        if len(at) != n:
            return None
        return np.diff(np.append(at, len(ids))) if self.lead else np.diff(np.append(-1, at)), ids

    def _encode(self, pieces: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct pieces by the library: (pieces in some order, how many ids each has, the ids)."""
        texts = [x.decode() for x in pieces]
        spaced, bare, other = [], [], []
        for x in texts:
            (spaced if x[:1] == " " and x[1:].isalpha() else bare if self.lead and x.isalpha() else other).append(x)
        order, lengths, ids = [], [], []
        for group, glue in ((spaced, ""), (bare, "\n")):
            found = self._joined(glue.join(group), len(group), group) if group else None
            if found:
                order += group
                lengths.append(found[0])
                ids.append(found[1])
            else:
                other += group
        each = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
        lengths.append(np.fromiter(map(len, each), np.int64, len(each)))
        ids.append(np.fromiter(chain.from_iterable(each), np.uint32, int(lengths[-1].sum())))
        return [x.encode() for x in order + other], np.concatenate(lengths), np.concatenate(ids)

    def _places(self, pieces: list[bytes]) -> np.ndarray:
        """Where the pieces are among the young ones; those that are not get a place there."""
        if len(self.young.place) + len(pieces) > self.entries // 2:
            self.old, self.young = self.young, Store()
        young, old = self.young, self.old
        found = list(map(young.place.get, pieces))
        if None in found:
            missing = [x for x, at in zip(pieces, found) if at is None]
            if back := [x for x in missing if x in old.place]:
                young.add(back, *old.gather(np.fromiter(map(old.place.__getitem__, back), np.int64, len(back))))
                missing = [x for x in missing if x not in old.place]
            if missing:
                young.add(*self._encode(missing))
            found = list(map(young.place.__getitem__, pieces))
        return np.array(found, np.int64)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, each followed by end if there is one; and where
        each text's begin, one more for the end of the last. Null is empty."""
        # nothing here is cyclic, so the cycle collector need not walk the pieces
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._all(texts, end)
        finally:
            if collecting:
                gc.enable()

    def _all(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        n, (data, offsets) = len(texts), text_buffer(texts)
        if len(data):
            starts, data = self.cuts(data, offsets)
            distinct, number = number_pieces(data, starts)
            places = self._places(distinct)  # first: it may begin a new store
            lengths, ids = self.young.gather(places[number])
            at = np.append(0, np.cumsum(lengths))[np.searchsorted(starts, offsets)]
            for x in distinct:
                if len(x) > LONG_PIECE:
                    self.young.place.pop(x, None)
        else:
            ids, at = np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        if end is None:
            return ids, at
        at = at + np.arange(n + 1)
        out, own = np.full(len(ids) + n, end, np.uint32), np.ones(len(ids) + n, bool)
        own[at[1:] - 1] = False
        out[own] = ids
        return out, at


OWNER = "encode"


def encoder(path: str, mode: str, entries: int = CACHE_ENTRIES) -> Encoder:
    """One per worker, so that its cache serves all tasks of the operator."""
    return kept(OWNER, (path, mode, entries), lambda: Encoder(path, mode, entries))
