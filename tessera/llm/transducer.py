"""Byte-pair-encoding merges compiled, on demand, into a deterministic finite-state transducer.

The encoding of a word is determined left to right by one fact about merge-rank BPE: a token sequence is *the* encoding of
its text if and only if every adjacent pair of its tokens re-encodes to that same pair.  So every prefix of a word has
exactly one last token, and a state needs to remember only the positions where a longer token may still be open:

    state = ((open token prefix, tokens that may still complete it, tokens there minus tokens here), ...)

The tokens that may complete an open prefix are those that stand next to the token before it; an open prefix with none is
dropped, and words that leave the same possibilities share a state.

Reading a symbol moves to the next state and changes the number of tokens of the prefix by a fixed amount; that amount is
the annotation of the transition (it is negative where a longer token swallows several shorter ones).  States and
transitions are made when a text first needs them and are kept in flat arrays, so that a batch of words is read by one
gather per symbol position.  The table is emptied when it passes ``max_states``: memory is bounded whatever the texts hold.

Words longer than ``CHUNK`` symbols are cut into chunks that are read side by side.  A chunk gets a state map: for some entry
states, its exit state and the tokens that it adds.  The maps of a word's chunks are composed by a parallel prefix scan
(map composition is associative: log2 of the number of chunks doubling steps, all chunks at once).  The first chunk is
entered in the start state alone; which states an inner chunk may be entered in is learned from the symbols before it, read
from two places, and where the scan arrives in a state that a map lacks, the map is extended by it and the scan repeated.
The composed result is exact whatever the guesses were.
"""

from __future__ import annotations

import json
from array import array

import numpy as np

#: Symbols of a chunk, and symbols read before it to learn its entry states.
CHUNK, WARM = 256, 64
#: A prefix of more tokens than this keeps the token before it in the state, not the list of tokens that may complete it.
LISTED = 24
#: Answers about pairs of tokens that are kept (a power of two); a new one takes the place of another.
ASKED = 1 << 18


def byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable Latin-1 stands for itself, the rest from U+0100 upwards."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """``path``: a tokenizers JSON file with a byte-level BPE model.  Symbols are bytes; 256 + byte closes a word where the
    model marks word ends."""

    def __init__(self, path: str, max_states: int = 60_000):
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, alphabet = model.get("end_of_word_suffix") or "", byte_alphabet()
        self.marks_end = bool(suffix)

        def symbols(token: str) -> str:
            last = bool(suffix) and token.endswith(suffix)
            body = [alphabet[c] for c in (token[: -len(suffix)] if last else token)]
            if last:
                body[-1] += 256
            return "".join(chr(0x100 + s) for s in body)

        def known(token: str) -> bool:
            return all(c in alphabet for c in (token.removesuffix(suffix) if suffix else token))

        names = {symbols(t): i for t, i in model["vocab"].items() if known(t)}
        merges = [tuple(map(symbols, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        self.bpe = BPE(vocab=names, merges=merges)
        self.tokens = names
        self.length = np.ones(max(names.values()) + 1, np.int32)
        for t, i in names.items():
            self.length[i] = len(t)
        self.longer: dict[str, tuple[int, ...] | None] = {}  # proper prefix -> its tokens, None for more than LISTED
        for t, i in names.items():
            for k in range(1, len(t)):
                if (found := self.longer.get(t[:k], ())) is not None:
                    self.longer[t[:k]] = (*found, i) if len(found) < LISTED else None
        self.spelled = {i: t for t, i in names.items()}
        self.open: dict[tuple[str, int], tuple] = {}
        self.asked = array("q", [-1]) * ASKED
        self.max_states = max_states
        self._clear()

    def _clear(self) -> None:
        self.width = 64
        self.column = np.full(512, -1, np.int32)
        self.symbol_of: list[int] = []
        self.states: list[tuple] = [(("", -1, 0),)]
        self.number = {self.states[0]: 0}
        self.entries: dict[tuple, tuple] = {}  # what several states hold is held once
        self._rows(self.max_states + self.max_states // 4, self.width)

    def _rows(self, n: int, width: int) -> None:
        """Tables for n states; memory is touched only where a transition is made.  ``next`` holds states plus 1, 0 is none."""
        old = (self.next, self.delta, self.last) if len(self.states) > 1 else ()
        self.next, self.delta, self.last = np.zeros((n, width), np.int32), np.zeros((n, width), np.int16), np.full(n, -1, np.int32)
        self.width = width
        if old:
            made = min(len(self.states), len(old[0]))
            for new, was in zip((self.next, self.delta), old, strict=False):
                new[:made, : was.shape[1]] = was[:made]
            self.last[:made] = old[2][:made]

    def _adjacent(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, are what their joint text encodes to (left -1: the word's start)."""
        key = (left + 1) << 20 | right
        slot = (key * 0x9E3779B97F4A7C15 >> 40) % ASKED
        if (known := self.asked[slot]) >> 1 != key:
            text = self.spelled[right] if left < 0 else self.spelled[left] + self.spelled[right]
            ok = [t.id for t in self.bpe.tokenize(text)] == ([right] if left < 0 else [left, right])
            self.asked[slot] = known = key << 1 | ok
        return bool(known & 1)

    def _left(self, prefix: str, before) -> int | tuple:
        """The tokens that may complete ``prefix``: listed, or as the token that they have to stand next to."""
        if isinstance(before, tuple):
            return tuple(c for c in before if len(self.spelled[c]) > len(prefix) and self.spelled[c].startswith(prefix))
        if (tokens := self.longer[prefix]) is None:
            return before
        if (left := self.open.get((prefix, before))) is None:
            if len(self.open) > 100_000:
                self.open.clear()
            left = self.open[prefix, before] = tuple(c for c in tokens if self._adjacent(before, c))
        return left

    def _make(self, state: int, column: int) -> None:
        x = chr(0x100 + self.symbol_of[column])
        grown, token, step = [], -1, 0
        for spelled, before, rel in self.states[state]:
            longer, listed = spelled + x, isinstance(before, tuple)
            if token < 0 and (c := self.tokens.get(longer, -1)) >= 0 and (c in before if listed else self._adjacent(before, c)):
                token, step = c, rel + 1
            if longer in self.longer and (left := self._left(longer, before)) != ():
                grown.append((longer, left, rel))
        if token < 0:
            raise ValueError("a symbol without a token")
        key = tuple(self.entries.setdefault(e, e) for e in (*((s, b, r - step) for s, b, r in grown), ("", token, 0)))
        if (to := self.number.get(key)) is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            if to >= len(self.next):
                self._rows(to + to // 4, self.width)
            self.last[to] = token
        self.next[state, column], self.delta[state, column] = to + 1, step

    def _columns(self, symbols: np.ndarray) -> np.ndarray:
        seen = np.flatnonzero(np.bincount(symbols, minlength=512))
        for s in seen[self.column[seen] < 0]:
            self.column[s] = len(self.symbol_of)
            self.symbol_of.append(int(s))
        if (more := len(self.symbol_of) - self.width) > 0:
            self._rows(len(self.next), self.width + -(-more // 32) * 32)
        return self.column[symbols]

    def _read(self, columns, starts, lengths, entry, last):
        """Exit states and counts of lanes; ``last``, if given, gets the last token at each symbol."""
        order = np.argsort(-lengths, kind="stable")
        at, state, count = starts[order], entry[order].astype(np.int64), np.zeros(len(order), np.int64)
        active = len(order) - np.searchsorted(lengths[order][::-1], np.arange(1, (lengths.max() if len(order) else 0) + 1))
        for k, m in enumerate(active):
            where = at[:m] + k
            key = state[:m] * self.width + columns[where]
            to = self.next.ravel()[key] - 1
            if (to < 0).any():
                for missing in np.unique(key[to < 0]):
                    self._make(*divmod(int(missing), self.width))
                to = self.next.ravel()[key] - 1
            count[:m] += self.delta.ravel()[key]
            state[:m] = to
            if last is not None:
                last[where] = self.last[to]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def read(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, want_last: bool = False):
        """Tokens of each word ``symbols[start:end]``; with ``want_last``, also the last token of each word's prefixes."""
        if len(self.states) > self.max_states:
            self._clear()
        columns = self._columns(symbols)
        last = np.full(len(symbols), -1, np.int32) if want_last else None
        lengths = ends - starts
        n_chunks = np.maximum(-(-lengths // CHUNK), 1)
        if len(n_chunks) == 0 or n_chunks.max() == 1:
            _, count = self._read(columns, starts, lengths, np.zeros(len(starts), np.int64), last)
            return count, last
        word = np.repeat(np.arange(len(starts)), n_chunks)
        part = np.arange(len(word)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
        c_start = starts[word] + part * CHUNK
        c_length = np.minimum(ends[word] - c_start, CHUNK)
        entry, exits, count = self._state_maps(columns, c_start, c_length, part)
        while True:
            came, total = _scanned(entry, exits, count, part)
            lost = np.flatnonzero((came < 0) & (np.append(0, came[:-1]) >= 0))
            if not len(lost):
                break
            states = exits[lost - 1, came[lost - 1]]
            if (entry[lost] >= 0).all(axis=1).any():
                entry, exits, count = (np.pad(x, ((0, 0), (0, 1)), constant_values=v) for x, v in ((entry, -1), (exits, -1), (count, 0)))
            free = (entry[lost] < 0).argmax(axis=1)
            entry[lost, free] = states
            exits[lost, free], count[lost, free] = self._read(columns, c_start[lost], c_length[lost], states, None)
        if want_last:
            self._read(columns, c_start, c_length, entry[np.arange(len(came)), came], last)
        return total[np.cumsum(n_chunks) - 1], last

    def _state_maps(self, columns, starts, lengths, part):
        """(entry states, exit states, tokens) of each chunk, one column for each known entry (-1: none)."""
        inner = np.flatnonzero(part > 0)
        entry = np.full((len(starts), 2), -1, np.int64)
        entry[part == 0, 0] = 0
        for d, warm in enumerate((WARM, WARM // 2)):
            entry[inner, d], _ = self._read(columns, starts[inner] - warm, np.full(len(inner), warm), np.zeros(len(inner), np.int64), None)
        entry[entry[:, 0] == entry[:, 1], 1] = -1
        exits, count = np.full_like(entry, -1), np.zeros_like(entry)
        for d in range(2):
            known = np.flatnonzero(entry[:, d] >= 0)
            exits[known, d], count[known, d] = self._read(columns, starts[known], lengths[known], entry[known, d], None)
        return entry, exits, count

    def ids(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all words in order, and how many each word has."""
        count, last = self.read(symbols, starts, ends, True)
        out = np.empty(int(count.sum()), np.uint32)
        slot, at, live = np.cumsum(count), ends.copy(), np.flatnonzero(ends > starts)
        while len(live):
            token = last[at[live] - 1]
            slot[live] -= 1
            out[slot[live]] = token
            at[live] -= self.length[token]
            live = live[at[live] > starts[live]]
        return out, count


def _scanned(entry: np.ndarray, exits: np.ndarray, count: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which entry each chunk is entered by, -1 where its map lacks it; tokens of its word up to its end).

    ``part``: a chunk's place in its word.  Maps are held as indices of the next chunk's entries and composed by doubling.
    """
    to = np.full_like(entry, -1)
    for d in range(entry.shape[1]):
        same = (exits[:-1, d, None] == entry[1:]) & (exits[:-1, d, None] >= 0)
        to[:-1, d] = np.where(same.any(axis=1), same.argmax(axis=1), -1)
    count, step = count.copy(), 1
    while step <= part.max(initial=0):
        later = np.flatnonzero(part >= step)
        before, tokens = to[later - step], count[later - step]
        own = np.take_along_axis(to[later], np.maximum(before, 0), 1), np.take_along_axis(count[later], np.maximum(before, 0), 1)
        to[later], count[later] = np.where(before >= 0, own[0], -1), tokens + own[1]
        step *= 2
    came = np.where(part == 0, 0, np.append(0, to[:-1, 0]))
    return came, count[:, 0]
