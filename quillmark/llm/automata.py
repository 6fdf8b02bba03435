"""Finite-state pre-tokenizers over code points, run by state maps, and lexicon transducers that annotate boundaries with tokens.

A pre-tokenizer is a deterministic transducer: reading a character, it moves to a state and emits marks, "a token starts here" and "a token started at
the character before". A text is cut into blocks; for each block the map from every start state to its end state is computed at once, maps are composed
by a parallel prefix scan, and a last pass runs each block from its now known start state. Most blocks forget their start state within a few characters;
from there on one run stands for all.

A lexicon is the second transducer: a path spells a pre-token, its final transition emits that token sequence (or its length). It is compiled as its
paths are met: a vocabulary's byte-pair merges give every possible word a path, so they can't all be written out beforehand.
"""

from __future__ import annotations

import os
import unicodedata
from itertools import chain, repeat

import numpy as np

from .kernels import U, mix

# Character classes.
L, STMD, RR, VV, LL, EE, N, O, APOS, SP, WS, END = range(12)
# States: the token (or pending part of one) that the last character belongs to.
Q0, QL, QN, QO, QA, QAR, QAV, QAL, QS1, QSN, QW1, QWN = range(12)
HERE, BEFORE = 1, 2
STATES = 12

#: White space of the pattern \s, code points.
SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point."""
    if not _classes:
        kind = {"L": L, "N": N}
        t = np.fromiter((kind.get(unicodedata.category(chr(i))[0], O) for i in range(0x110000)), np.uint8, 0x110000)
        t[SPACES] = WS
        t[0x20] = SP
        t[ord("'")] = APOS
        for chars, c in (("stmd", STMD), ("r", RR), ("v", VV), ("l", LL), ("e", EE)):
            t[[ord(x) for x in chars]] = c
        _classes.append(t)
    return _classes[0]


def machine(keep_spaces: bool, long_numbers: bool) -> tuple[np.ndarray, np.ndarray]:
    """next state and marks by (class, state).

    Tokens are, in this order of choice: an apostrophe with s, t, re, ve, m, ll or d; a run of letters; a run of numbers (or one: long_numbers False);
    a run of what is neither, nor blank; with keep_spaces, each of the last three may have one space before it, and blanks left over are tokens, a run
    giving up its last character to what follows it. Without keep_spaces a run of blanks is marked as a token and left to the caller to drop.
    """
    letters = (L, STMD, RR, VV, LL, EE)
    nxt, marks = np.zeros((12, STATES), np.uint8), np.zeros((12, STATES), np.uint8)
    for c in range(12):
        for q in range(STATES):
            to, out = None, 0
            pending = q in (QAR, QAV, QAL)
            if q == QA and c == STMD:
                to = Q0
            elif q == QA and c in (RR, VV, LL):
                to = {RR: QAR, VV: QAV, LL: QAL}[c]
            elif (q == QAR and c == EE) or (q == QAV and c == EE) or (q == QAL and c == LL):
                to = Q0
            else:
                p = q
                if pending:  # the apostrophe was a token, its letter starts a word
                    out |= BEFORE
                    p = QL
                blank = p in (QS1, QSN, QW1, QWN)
                if c == END:
                    to, out = Q0, out | HERE
                elif c in (SP, WS):
                    if not keep_spaces:
                        to = QW1
                        out |= 0 if p == QW1 else HERE
                    elif blank:
                        to = QSN if c == SP else QWN
                    else:
                        to, out = (QS1 if c == SP else QW1), out | HERE
                else:
                    kind = QL if c in letters else QN if c == N else QO
                    if blank and keep_spaces:
                        if p == QS1:
                            to = kind
                        elif p == QSN:
                            to, out = kind, out | BEFORE
                        else:
                            out |= HERE | (BEFORE if p == QWN else 0)
                            to = QA if c == APOS else kind
                    elif p in (QL, QN, QO) and kind == p and (p != QN or long_numbers):
                        to = kind
                    elif p == QA and kind == QO:
                        to = QO
                    else:
                        out |= HERE
                        to = QA if c == APOS else kind
            nxt[c, q], marks[c, q] = to, out
    return nxt, marks


def run(cls: np.ndarray, nxt: np.ndarray, marks: np.ndarray, block: int = 64, probe: int = 12) -> np.ndarray:
    """The marks of each character, from state Q0."""
    n = len(cls)
    nb = -(-n // block)
    padded = np.full(nb * block, END, np.uint8)
    padded[:n] = cls
    cols = np.ascontiguousarray(padded.reshape(nb, block).T).astype(np.uint16) * STATES
    step, out = nxt.ravel(), marks.ravel()
    # Maps from start state to end state: all states at first, then one run for the blocks in which they have met.
    maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8)[:, None], (STATES, nb)).copy()
    for j in range(probe):
        maps = step[cols[j] + maps]
    apart = np.flatnonzero((maps != maps[0]).any(axis=0))
    one, rest = maps[0].copy(), maps[:, apart].copy()
    for j in range(probe, block):
        one = step[cols[j] + one]
        if len(apart):
            rest = step[cols[j][apart] + rest]
    maps[:] = one
    maps[:, apart] = rest
    # Prefix scan: after it, maps[:, b] leads from the start of the text to the end of block b.
    shift = 1
    while shift < nb:
        maps[:, shift:] = np.take_along_axis(maps[:, shift:], maps[:, :-shift], axis=0)
        if (maps[:, shift:] == maps[0, shift:]).all():
            break  # constant maps compose to themselves
        shift *= 2
    state = np.zeros(nb, np.uint8)
    state[1:] = maps[Q0, :-1]
    got = np.empty((block, nb), np.uint8)
    for j in range(block):
        at = cols[j] + state
        got[j] = out[at]
        state = step[at]
    return np.ascontiguousarray(got.T).ravel()[:n]


class ShortWords:
    """A table from byte strings of 1 to 16 bytes to numbers, for whole arrays of them: open addressing, keys compared whole (both ends and the length)."""

    MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

    def __init__(self, places: int = 1 << 17):
        self.first, self.last = np.zeros(places, U), np.zeros(places, U)
        self.length, self.number = np.zeros(places, np.uint8), np.zeros(places, np.int32)
        self.used = 0

    @classmethod
    def keys(cls, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first eight bytes, last eight of those with more, length) of spans of at most 16 bytes; data has eight bytes to spare at its end."""
        at = np.ndarray((max(len(data) - 7, 0),), U, data, strides=(1,))
        n = ends - starts
        return at[starts] & cls.MASKS[np.minimum(n, 8)], np.where(n > 8, at[np.maximum(ends - 8, 0)], U(0)), n.astype(np.uint8)

    def _places(self, first: np.ndarray, last: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (mix(first ^ (last + length) * U(0x9E3779B97F4A7C15)) & U(len(self.length) - 1)).astype(np.int64)

    def find(self, first: np.ndarray, last: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Each key's number, or -1."""
        out = np.full(len(first), -1, np.int64)
        todo, at = np.arange(len(first)), self._places(first, last, length)
        while len(todo):
            same = (self.first[at] == first[todo]) & (self.last[at] == last[todo]) & (self.length[at] == length[todo])
            out[todo[same]] = self.number[at[same]]
            go = ~same & (self.length[at] != 0)
            todo, at = todo[go], (at[go] + 1) & (len(self.length) - 1)
        return out

    def add(self, first: np.ndarray, last: np.ndarray, length: np.ndarray, number: np.ndarray) -> None:
        """Keys that differ, none of which the table has."""
        if 2 * (self.used + len(first)) > len(self.length):
            old = np.flatnonzero(self.length)
            kept = self.first[old], self.last[old], self.length[old], self.number[old]
            self.__init__(1 << (2 * (self.used + len(first))).bit_length())
            self.add(*kept)
        self.used += len(first)
        todo, at = np.arange(len(first)), self._places(first, last, length)
        while len(todo):
            free = np.flatnonzero(self.length[at] == 0)
            p, one = np.unique(at[free], return_index=True)
            won = todo[free[one]]
            self.first[p], self.last[p], self.length[p], self.number[p] = first[won], last[won], length[won], number[won]
            go = np.ones(len(todo), bool)
            go[free[one]] = False
            todo, at = todo[go], (at[go] + 1) & (len(self.length) - 1)


class Lexicon:
    """Emissions of words (byte strings): token counts, and the ids themselves if asked, as the library has them for the word alone.

    Words are their own keys, so none is taken for another. All is forgotten beyond `most` words or `room` bytes of them. marked: the vocabulary marks the
    ids that end a pre-token (`</w>`), so that many simple words are encoded as one text and told apart by those marks.
    """

    def __init__(self, path: str, ids: bool, most: int = 500_000, room: int = 1 << 24, marked: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.ids, self.most, self.room, self.marked = Tokenizer.from_file(path), ids, most, room, marked
        if marked:
            self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
            self.ends[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.short, self.long = ShortWords(), {}
        self.counts = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.pool, self.used, self.n, self.bytes = np.zeros(1 << 20 if self.ids else 1, np.uint32), 0, 0, 0

    def emit(self, words: list[str], simple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the library's ids of all words end to end, how many each has). simple: pre-tokens of each word, if all are known."""
        if len(simple):
            flat = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
            last, inner = np.flatnonzero(self.ends[flat]), np.cumsum(simple)
            if len(last) == inner[-1]:
                return flat, np.diff(last[inner - 1] + 1, prepend=0)
        found = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum())) if self.ids else np.zeros(0, np.uint32), n

    def _learn(self, words: list[bytes]) -> None:
        """Number new words, n and on, and keep what the library emits for them."""
        texts = [w.decode() for w in words]
        if self.marked:  # simple words go the quick way, and first, in this order in `words` too
            inner = np.fromiter(map(pre_tokens_of, texts), np.int64, len(texts))
            order = np.argsort(inner == 0, kind="stable")
            words[:] = [words[i] for i in order.tolist()]
            texts, inner = [texts[i] for i in order.tolist()], inner[order][: np.count_nonzero(inner)]
        else:
            inner = np.zeros(0, np.int64)
        while len(self.counts) < self.n + len(words):
            self.counts, self.starts = np.concatenate([self.counts, np.zeros_like(self.counts)]), np.concatenate([self.starts, np.zeros_like(self.starts)])
        cuts = sorted({*range(0, len(words), 4096), len(inner), len(words)})
        for i, j in zip(cuts, cuts[1:]):
            flat, n = self.emit(texts[i:j], inner[i:j])
            at = slice(self.n, self.n + len(n))
            self.counts[at] = n
            if self.ids:
                while len(self.pool) < self.used + len(flat):
                    self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
                self.pool[self.used : self.used + len(flat)] = flat
                self.starts[at] = self.used + np.cumsum(n) - n
                self.used += len(flat)
            self.n += len(n)

    def slots(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A place in counts (and starts) for each span of the UTF-8 text raw, until the next call."""
        slot = np.full(len(starts), -1, np.int64)
        data = np.frombuffer(raw + bytes(8), np.uint8)
        long = ends - starts > 16
        few = np.flatnonzero(~long)
        key = ShortWords.keys(data, starts[few], ends[few])
        slot[few] = self.short.find(*key)
        many = np.flatnonzero(long)
        texts = [raw[a:b] for a, b in zip(starts[many].tolist(), ends[many].tolist())]
        slot[many] = np.fromiter(map(self.long.get, texts, repeat(-1)), np.int64, len(texts))
        miss = np.flatnonzero(slot < 0)
        if not len(miss):
            return slot
        met: dict[bytes, int] = {}
        for i, a, b in zip(miss.tolist(), starts[miss].tolist(), ends[miss].tolist()):
            met.setdefault(raw[a:b], i)
        size = sum(map(len, met))
        if self.n and (self.n + len(met) > self.most or self.bytes + size > self.room):
            self.forget()
            return self.slots(raw, starts, ends)
        self.bytes += size
        words = list(met)
        number = np.arange(self.n, self.n + len(words))
        self._learn(words)
        at = np.array([met[w] for w in words])
        new_long = long[at]
        self.long.update(zip([words[i] for i in np.flatnonzero(new_long).tolist()], number[new_long].tolist()))
        brief = at[~new_long]
        self.short.add(*ShortWords.keys(data, starts[brief], ends[brief]), number[~new_long])
        again = np.flatnonzero(slot[few] < 0)
        slot[few[again]] = self.short.find(*(k[again] for k in key))
        late = [i for i, t in enumerate(texts) if slot[many[i]] < 0]
        slot[many[late]] = [self.long[texts[i]] for i in late]
        return slot


#: Capital letters under U+0250 whose lower case is two characters.
_TWO = "İŉ"
_MARKS = ".,;:!?)]}\"#"


def pre_tokens_of(word: str) -> int:
    """2 for letters of Latin with marks at the end, 1 without these; 0: can't tell."""
    core = word.rstrip(_MARKS)
    return (1 + (len(core) < len(word))) if core.isalpha() and (core.isascii() or (max(core) < "\u0250" and not any(c in core for c in _TWO))) else 0


class PreTokenizer:
    """Cuts texts into pre-tokens with a machine."""

    def __init__(self, keep_spaces: bool, long_numbers: bool):
        self.keep_spaces = keep_spaces
        self.nxt, self.marks = machine(keep_spaces, long_numbers)

    def spans(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """(the joined text, pre-token starts and ends in it, index of each pre-token's text)."""
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = classes()[points]
        ends_at = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        cls[ends_at] = END
        m = run(cls, self.nxt, self.marks)
        begin = (m & HERE) != 0
        begin[:-1] |= (m[1:] & BEFORE) != 0
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(points))
        head = cls[starts]
        keep = head != END
        if not self.keep_spaces:
            keep &= (head != SP) & (head != WS)
        starts, ends = starts[keep], ends[keep]
        return joined, starts, ends, np.searchsorted(ends_at, starts)

    def counts(self, texts: list[str], lexicon: Lexicon) -> np.ndarray:
        """How many tokens the lexicon emits for each text's pre-tokens."""
        joined, starts, ends, doc = self.spans(texts)
        raw = joined.encode()
        if len(raw) > len(joined):
            head = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
            place = np.append(np.flatnonzero(head), len(raw))
            starts, ends = place[starts], place[ends]
        slot = lexicon.slots(raw, starts, ends)
        return np.bincount(doc, lexicon.counts[slot], len(texts)).astype(np.int64)


def split_special(texts: list[str], special: dict[str, int]) -> tuple[list[str], list[int], list[tuple[int, int]]]:
    """Texts cut at strings that the library takes as one token each, leftmost first: (pieces, text of each piece, (pieces before it, id) of each string)."""
    import re

    rule = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
    pieces, owner, found = [], [], []
    for i, t in enumerate(texts):
        at = 0
        for m in rule.finditer(t):
            pieces.append(t[at : m.start()])
            owner.append(i)
            found.append((len(pieces), special[m[0]]))
            at = m.end()
        pieces.append(t[at:])
        owner.append(i)
    return pieces, owner, found
