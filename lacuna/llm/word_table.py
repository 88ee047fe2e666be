"""Token ids of words, each different word encoded once by a worker and then looked up in arrays.

A text is cut where the tokenizer cuts it in any case: at blanks and line breaks, and between a letter and
the marks that end its word. What lies between is looked up by its bytes, read as three 64-bit
numbers, for all words of many texts at once; only words not met before go to the tokenizer. It is the
file's as it is, so the string of a special token in a text is that token.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

#: Different words a worker keeps; when there are more it begins anew.
KEPT = 1_500_000
#: Longer words are encoded each time they come up.
WIDTH = 24
#: Words encoded in one call.
GROUP = 512

_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x0A]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Marks that are cut off a word: no apostrophe, and nothing that stands in the string of a special token.
MARKS = b'.,;:!?%&#$*)"'
#: Second bytes after 0xC3 that make a letter: all but the signs for times and divided by.
_LATIN = np.zeros(256, bool)
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
_PRIMES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def marks(but: str = "") -> np.ndarray:
    """Which bytes are marks that may be cut off a word; those of ``but`` are not."""
    out = np.zeros(256, bool)
    out[[b for b in MARKS if chr(b) not in but]] = True
    return out


def cut(data: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes, which end in a line break."""
    breaks = _BREAK[data]
    inside = ~breaks
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.r_[0, edge]
    starts, ends = edge[::2], edge[1::2]
    # From the last byte of each word back to the first of the marks it ends with.
    ending = np.flatnonzero(mark[data[ends - 1]])
    at, begin = ends[ending] - 1, starts[ending]
    going = np.arange(len(at))
    while len(going):
        going = going[at[going] > begin[going]]
        going = going[mark[data[at[going] - 1]]]
        at[going] -= 1
    one, two = data[np.maximum(at - 1, 0)], data[np.maximum(at - 2, 0)]
    letter = _LETTER[one] & (at - 1 >= begin) | (two == 0xC3) & _LATIN[one] & (at - 2 >= begin)
    cuts = at[letter]
    # Stable sorts merge what is in order already.
    return np.sort(np.r_[starts, cuts], kind="stable"), np.sort(np.r_[ends, cuts], kind="stable")


def _hashes(keys: np.ndarray) -> np.ndarray:
    hashes = keys[:, 0] * _PRIMES[0] ^ (keys[:, 1] + _PRIMES[2]) * _PRIMES[1]
    hashes ^= (hashes >> np.uint64(29)) + keys[:, 2] * _PRIMES[2]
    return (hashes ^ keys[:, 3]) * _PRIMES[0]


def _word_ends(tokenizer) -> np.ndarray | None:
    """Which ids end a word, where the tokenizer's file marks them by a suffix and spells every byte, so
    that each word has one such id, its last. None for other files."""
    from tokenizers.pre_tokenizers import ByteLevel

    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    known = tokenizer.get_vocab()
    if not suffix or not all(c in known and c + suffix in known for c in ByteLevel.alphabet()):
        return None
    out = np.zeros(1 + max(known.values()), bool)
    out[[k for token, k in known.items() if token.endswith(suffix)]] = True
    return out


class WordTable:
    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.mark = marks("".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values()))
        self.word_ends = _word_ends(self.tokenizer)
        self.clear()

    def clear(self) -> None:
        self.size = self.used = 0  # words, and ids of all words
        self.keys = np.zeros((1 << 12, 4), np.uint64)
        self.starts, self.counts = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, self.dtype)
        self.slots = np.full(1 << 13, -1, np.int32)  # a word stands at the first bits of its hash or behind

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words end to end, and how many each has; words of letters are joined by blanks and
        encoded together."""
        plain = [k for k, w in enumerate(words) if w.isalpha()]
        rest = [k for k, w in enumerate(words) if not w.isalpha()]
        found: list[tuple[np.ndarray, np.ndarray, list[int]]] = []
        for k in range(0, len(plain), GROUP):
            group = plain[k : k + GROUP]
            made = self._together(" ".join([words[j] for j in group]), len(group))
            if made is None:
                rest += group  # some word is more than one to the tokenizer
            else:
                found.append((*made, group))
        each = [x.ids for x in self.tokenizer.encode_batch_fast([words[k] for k in rest], add_special_tokens=False)]
        sizes = np.array([len(x) for x in each], np.int64)
        found.append((np.fromiter(chain.from_iterable(each), self.dtype, int(sizes.sum())), sizes, rest))
        ids, counts = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]).astype(np.int64)
        order = np.argsort(np.concatenate([np.array(x[2], np.int64) for x in found]))
        begin = (np.cumsum(counts) - counts)[order]
        counts = counts[order]
        offsets = np.cumsum(counts) - counts
        return ids[np.repeat(begin - offsets, counts) + np.arange(len(ids))], counts

    def _together(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of ``n`` words of letters, and how many each has; None if they are not so many to the tokenizer."""
        if self.word_ends is not None:  # without places in the text, which cost more than the ids
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.word_ends[ids])
            return (ids, np.diff(ends, prepend=-1)) if len(ends) == n and ends[-1] + 1 == len(ids) else None
        made = self.tokenizer.encode(text, add_special_tokens=False)
        at = made.word_ids
        if None in at or not at or at[-1] + 1 != n:
            return None
        return np.array(made.ids, self.dtype), np.bincount(at, minlength=n)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _found(self, hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The word of each key; -1 where there is none."""
        out = np.full(len(hashes), -1, np.int64)
        at, left = self._places(hashes), np.arange(len(hashes))
        while len(left):
            word = self.slots.take(at)
            same = self.keys.take(np.maximum(word, 0), axis=0) == keys
            same = (same.view(np.uint32)[:, 0] == 0x01010101) & (word >= 0)  # all four
            out[left[same]] = word[same]
            more = np.flatnonzero((word >= 0) & ~same)
            left, keys, at = left[more], keys[more], at[more] + 1 & len(self.slots) - 1
        return out

    def _place(self, hashes: np.ndarray, words: np.ndarray) -> None:
        """Words that are not in the table to its free slots."""
        at = self._places(hashes)
        while len(words):
            free = self.slots[at] < 0
            self.slots[at[free]] = words[free]  # of several for one slot the last stays
            left = np.flatnonzero(self.slots[at] != words)
            words, at = words[left], at[left] + 1 & len(self.slots) - 1

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has."""
        raw = b"\n".join([*texts, bytes(WIDTH)])  # room to read past the last word
        data = np.frombuffer(raw, np.uint8)
        size = len(raw) - WIDTH
        if not size:
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        starts, ends = cut(data[:size], self.mark)
        lengths = ends - starts
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the 8 bytes from every place on
        keys = [eight[starts + 8 * k] & _MASKS[np.clip(lengths - 8 * k, 0, 8)] for k in range(3)]
        keys = np.stack([*keys, lengths.astype(np.uint64)], axis=1)  # a word may end in zero bytes
        hashes = _hashes(keys)

        short = np.flatnonzero(lengths <= WIDTH)
        word = np.full(len(lengths), -1, np.int64)
        word[short] = self._found(hashes[short], keys[short])
        new = short[word[short] < 0]
        if len(new):
            if self.size > KEPT:
                self.clear()
                new = short
            _, first = np.unique(hashes[new], return_index=True)
            self._add(raw, hashes, keys, new[first], starts, ends)
            word[new] = self._found(hashes[new], keys[new])
        known = word >= 0
        counts = np.where(known, self.counts[word], 0)
        begin = self.starts[word]
        pool = self.ids[: self.used]
        one_by_one = np.flatnonzero(~known)  # long words, and words whose hash another word has
        if len(one_by_one):
            words = [raw[starts[k] : ends[k]].decode(errors="replace") for k in one_by_one]
            different = dict(zip(dict.fromkeys(words), range(len(words))))
            back = [different[w] for w in words]
            found, sizes = self.encode_words(list(different))
            counts[one_by_one] = sizes[back]
            begin[one_by_one] = len(pool) + (np.cumsum(sizes) - sizes)[back]
            pool = np.concatenate([pool, found])
        offsets = np.cumsum(counts) - counts
        ids = pool[np.repeat(begin - offsets, counts) + np.arange(int(counts.sum()))]
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        sums = np.r_[0, np.cumsum(counts)]
        upto = sums[np.searchsorted(starts, text_ends, "left")]
        return ids, np.diff(np.r_[0, upto])

    def _room(self, name: str, need: int) -> np.ndarray:
        """An array with room for so many rows; it grows by half, so words are seldom copied."""
        kept = getattr(self, name)
        if need > len(kept):
            more = np.zeros((max(need, len(kept) + len(kept) // 2) - len(kept), *kept.shape[1:]), kept.dtype)
            setattr(self, name, np.concatenate([kept, more]))
        return getattr(self, name)

    def _add(self, raw: bytes, hashes, keys, which, starts, ends) -> None:
        """Words with different hashes, in order of these."""
        found, counts = self.encode_words([raw[starts[k] : ends[k]].decode(errors="replace") for k in which])
        words = np.arange(self.size, self.size + len(which))
        self.size += len(which)
        self._room("keys", self.size)[words] = keys[which]
        self._room("starts", self.size)[words] = self.used + np.cumsum(counts) - counts
        self._room("counts", self.size)[words] = counts
        self._room("ids", self.used + len(found))[self.used : self.used + len(found)] = found
        self.used += len(found)
        if 2 * self.size > len(self.slots):
            self.slots = np.full(1 << (4 * self.size).bit_length(), -1, np.int32)
            self._place(_hashes(self.keys[: self.size]), np.arange(self.size))
        else:
            self._place(hashes[which], words)


_WORKER: dict[str, WordTable] = {}


def word_table(file: str) -> WordTable:
    """The table this Python worker has built so far."""
    if file not in _WORKER:
        _WORKER[file] = WordTable(file)
    return _WORKER[file]
