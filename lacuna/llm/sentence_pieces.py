"""Sampled subword segmentations: forward filtering, backward sampling over the piece lattice.

Every way to spell a text in pieces is a path through its lattice; a path's weight is the product of
its pieces' weights. The forward pass sums the weights of all paths to each place; the backward pass
walks from the end and draws each piece with its share of that sum, so whole segmentations come out
with exactly their probability. The draws are hashes of the row key, the place of the part in its
text and the step, so a row gets the same pieces wherever and whenever it is encoded.

A text is cut where no piece of the vocabulary reaches across, and the parts are sampled alone; a
part's lattice is kept and used again wherever the part comes up. All work is done for many texts at
once, in arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of a piece: its rank in the model to the power -SHARPNESS. Higher: fewer, commoner pieces.
SHARPNESS = 1.0
#: A longer stretch without a cut is cut there, so that a lattice is bounded.
LONGEST = 2_048
#: Lattices of parts of up to so many characters are kept by a worker; when there are more states
#: than this it begins anew.
KEPT_CHARS, KEPT_STATES = 32, 1 << 19
#: Characters encoded at once.
SLICE = 1 << 16

#: Kinds of characters.
OTHER, LETTER, BLANK, BREAK = range(4)

_BASES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_POWERS: dict = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator, for each number."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(chars: np.ndarray, base: np.uint64, ends: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` characters up to each end."""
    out = np.zeros(len(ends), np.uint64)
    for k in range(n):
        out = out * base + chars[ends - (n - 1 - k)]
    return out


def _part_hashes(chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray, base: np.uint64) -> np.ndarray:
    """A hash of each part, from prefix sums of a polynomial modulo 2**64; parts of up to
    ``KEPT_CHARS`` characters are too short for its known weakness (which takes 2**11)."""
    n = len(chars)
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        size = max(n, SLICE + (SLICE >> 2))
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        _POWERS[base] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)]) for b in (base, inverse))
    up, down = _POWERS[base]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((chars + np.uint64(1)) * up[:n], dtype=np.uint64)])
    return _mixed((sums[starts + sizes] - sums[starts]) * down[starts])


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Some stretches of an array end to end."""
    offsets = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - offsets, sizes) + np.arange(int(sizes.sum()))]


class Pieces:
    """The vocabulary of a SentencePiece model, with blanks written as blanks."""

    def __init__(self, model_file: str, sharpness: float = SHARPNESS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = model.get_piece_size()
        self.byte_ids = np.zeros(256, np.int32)
        self.share: dict[str, tuple[int, float]] = {}
        spelled: list[bytes] = []
        for k in range(self.size):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = k
                spelled.append(bytes([value]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                spelled.append(b"")
            else:
                piece = piece.replace("▁", " ")
                self.share[piece] = (k, (2.0 - model.get_score(k)) ** -sharpness)
                spelled.append(piece.encode())
        self.byte_share = (2.0 + self.size) ** -sharpness
        self.pool = np.frombuffer(b"".join(spelled), np.uint8)
        self.pool_size = np.array([len(x) for x in spelled], np.int64)
        self.pool_from = np.cumsum(self.pool_size) - self.pool_size

        # Kinds of characters; beyond the basic plane all are ``OTHER``.
        self.kinds = np.zeros(1 << 16, np.uint8)
        self.kinds[[k for k in range(1 << 16) if chr(k).isalpha()]] = LETTER
        self.kinds[0x20], self.kinds[0x0A] = BLANK, BREAK
        # Letters that some piece has before a non-letter; and is there a piece the other way round?
        joined = _chars("\n".join(self.share))
        old, new = self._kinds(joined)[:-1], self._kinds(joined)[1:]
        self.odd = np.zeros(1 << 16, bool)
        self.odd[joined[:-1][(old == LETTER) & (new == OTHER)]] = True
        self.letters_apart = not ((old == OTHER) & (new == LETTER)).any()

        # Pieces by length: their hashes in order, a second hash to be sure, their ids and shares.
        self.longest = max(map(len, self.share))
        self.by_length = []
        for n in range(1, self.longest + 1):
            own = [(p, *v) for p, v in self.share.items() if len(p) == n]
            if own:
                chars = _chars("".join(p for p, _, _ in own))
                ends = np.arange(n - 1, len(chars), n)
                one, two = (_hashes(chars, base, ends, n) for base in _BASES)
                order = np.argsort(one)
                ids, shares = np.array([k for _, k, _ in own], np.int32), np.array([w for _, _, w in own])
                self.by_length.append((n, one[order], two[order], ids[order], shares[order]))

    def _kinds(self, chars: np.ndarray) -> np.ndarray:
        return np.where(chars < 1 << 16, self.kinds[np.minimum(chars, 0xFFFF)], OTHER)

    def cut(self, chars: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where the parts of texts begin (texts end to end, each from its place in ``begins``): before
        blanks, around line breaks and, where the vocabulary allows it, between letters and others."""
        if not len(chars):
            return np.zeros(0, np.int64)
        kinds = self._kinds(chars)
        old, new = kinds[:-1], kinds[1:]
        edge = (old == BREAK) | (new == BREAK) | (new == BLANK) & (old != BLANK)
        if self.letters_apart:
            apart = (old <= LETTER) & (new <= LETTER) & (old != new)
            edge |= apart & ~((old == LETTER) & self.odd[np.minimum(chars[:-1], 0xFFFF)])
        mark = np.r_[True, edge]
        mark[begins] = True
        starts = np.flatnonzero(mark)
        sizes = np.diff(np.r_[starts, len(chars)])
        more = [np.arange(starts[k] + LONGEST, starts[k] + sizes[k], LONGEST) for k in np.flatnonzero(sizes > LONGEST)]
        return np.sort(np.concatenate([starts, *more])) if more else starts

    def matches(self, chars: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Every piece inside a part: the place of its last character, its length, id and share.
        ``first`` says where the part of each character begins."""
        found = []
        places = np.arange(len(chars))
        bare = np.ones(len(chars), bool)
        for n, one, two, ids, shares in self.by_length:
            ends = places[places - first >= n - 1]
            at = np.minimum(np.searchsorted(one, hashed := _hashes(chars, _BASES[0], ends, n)), len(one) - 1)
            hit = one[at] == hashed
            ends, at = ends[hit], at[hit]
            sure = two[at] == _hashes(chars, _BASES[1], ends, n)
            ends, at = ends[sure], at[sure]
            found.append((ends, np.full(len(ends), n), ids[at], shares[at]))
            if n == 1:
                bare[ends] = False
        ends = np.flatnonzero(bare)  # characters without a piece are spelled in bytes
        wide = 1 + sum((chars[ends] >= limit).astype(np.int64) for limit in (0x80, 0x800, 0x10000))
        found.append((ends, np.ones(len(ends), np.int64), (self.size + chars[ends]).astype(np.int32), self.byte_share**wide))
        return tuple(np.concatenate(x) for x in zip(*found))

    def with_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Ids with bare characters (numbered from the vocabulary's size on) spelled in byte pieces, and
        how many ids each of them has become; None if none has."""
        bare = np.flatnonzero(ids >= self.size)
        if not len(bare):
            return ids, None
        spelled = [self.byte_ids[list(chr(int(c)).encode(errors="replace"))] for c in ids[bare] - self.size]
        many = np.ones(len(ids), np.int64)
        many[bare] = own = np.array([len(x) for x in spelled])
        out = np.repeat(ids, many)
        first = (np.cumsum(many) - many)[bare]
        flat = np.concatenate(spelled)
        out[np.repeat(first - (np.cumsum(own) - own), own) + np.arange(len(flat))] = flat
        return out, many

    def spell(self, rows: pa.Array) -> list[bytes | None]:
        """The bytes of each row of ids, some rows at a time."""
        null = rows.is_null().to_numpy(zero_copy_only=False)
        sizes = np.where(null, 0, rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        ids = rows.flatten().to_numpy(zero_copy_only=False)
        upto = np.r_[0, np.cumsum(sizes)]
        out: list[bytes | None] = []
        while len(out) < len(sizes):
            k = len(out)
            stop = max(k + 1, int(np.searchsorted(upto, upto[k] + SLICE, "right")) - 1)
            part = ids[upto[k] : upto[stop]]
            raw = _gathered(self.pool, self.pool_from[part], self.pool_size[part]).tobytes()
            ends = np.r_[0, np.cumsum(self.pool_size[part])][upto[k : stop + 1] - upto[k]].tolist()
            out += [None if n else raw[a:b] for a, b, n in zip(ends[:-1], ends[1:], null[k:stop])]
        return out


class Lattices:
    """The sampling tables of text parts.

    A state is a place in a part. The choices of a state are the pieces that end there, the longest
    first, with the state each comes from; ``upto`` is the running share of its choices. Parts are
    known by 128 bits of hashes.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.one, self.two = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # in order of the first
        self.stop_of = np.zeros(0, np.int64)  # the first state of each kept part
        self.states = self.choices = 0
        self.first = np.zeros(1 << 15, np.int32)  # the first choice of each state
        self.upto, self.origin, self.piece = np.zeros(1 << 16), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)

    def _grow(self, states: int, choices: int) -> None:
        for name, need in (("first", states), ("upto", choices), ("origin", choices), ("piece", choices)):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(need, len(old) + len(old) // 4) - len(old), old.dtype)]))

    def add(self, chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Forward filtering of parts (end to end), all together: first every place where a piece
        ends, then the masses of the first place of all parts, of the second, and so on. Returns the
        first state of each part."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        first_char = np.cumsum(sizes) - sizes
        first_state = first_char + np.arange(len(sizes))  # a part has a state more than characters
        end, length, piece, share = self.pieces.matches(chars, first_char[owner])
        state = end + 1 + owner[end]
        depth = end + 1 - first_char[owner[end]]
        order = np.argsort((depth * (len(chars) + len(sizes) + 1) + state) * (self.pieces.longest + 1) - length)
        state, depth, length, piece, share = (x[order] for x in (state, depth, length, piece, share))

        mass = np.zeros(len(owner) + len(sizes))
        mass[first_state] = 1.0
        shares = np.empty(len(state))
        begins = np.flatnonzero(np.r_[True, state[1:] != state[:-1]])
        stops = np.r_[begins[1:], len(state)]
        rounds = np.searchsorted(depth[begins], np.arange(1, int(sizes.max()) + 2))
        for r, (a, b) in enumerate(zip(rounds[:-1], rounds[1:])):
            if a == b:
                continue
            groups, at = begins[a:b], slice(int(begins[a]), int(stops[b - 1]))
            part_of = mass[state[at] - length[at]] * share[at]
            total = np.add.reduceat(part_of, groups - groups[0])
            shares[at] = part_of / np.repeat(total, stops[a:b] - groups)
            mass[state[groups]] = total
            low = state[groups[total < 1e-150]]
            if len(low):  # only shares count: keep the last places in range
                back = np.unique((low[:, None] - np.arange(min(self.pieces.longest, r + 2))).ravel())
                mass[back] *= 1e150

        running = np.cumsum(shares)
        running -= np.repeat(running[begins] - shares[begins], stops - begins)
        running[stops - 1] = 1.0
        self._grow(self.states + len(mass), self.choices + len(state))
        new = slice(self.choices, self.choices + len(state))
        self.upto[new], self.origin[new], self.piece[new] = running, self.states + state - length, piece
        self.first[self.states + state[begins]] = self.choices + begins
        self.choices += len(state)
        self.states += len(mass)
        return self.states - len(mass) + first_state

    def states_of(self, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The first state of each part, new parts being added."""
        if self.states > KEPT_STATES:
            self.clear()
        one, two = (_part_hashes(chars, starts, sizes, base) for base in _BASES)
        short = sizes <= KEPT_CHARS
        at, known = self._known(one, two, short)
        new = np.flatnonzero(short & ~known)
        if len(new):
            _, pick = np.unique(one[new], return_index=True)
            which = new[pick]
            stop = self.add(_gathered(chars, starts[which], sizes[which]), sizes[which])
            place = np.searchsorted(self.one, one[which])  # both are in order
            self.one, self.two = np.insert(self.one, place, one[which]), np.insert(self.two, place, two[which])
            self.stop_of = np.insert(self.stop_of, place, stop)
            at, known = self._known(one, two, short)
        stop = self.stop_of[at] if len(self.stop_of) else np.zeros(len(at), np.int64)
        rest = np.flatnonzero(~known)  # long parts, each for itself, and parts that share a first hash
        if len(rest):
            stop[rest] = self.add(_gathered(chars, starts[rest], sizes[rest]), sizes[rest])
        return stop

    def _known(self, one: np.ndarray, two: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.one):
            return np.zeros(len(one), np.int64), np.zeros(len(one), bool)
        at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        return at, short & (self.one[at] == one) & (self.two[at] == two)

    def sample(self, stop: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling: numbers of all pieces, and how many each part has. A number from the
        size of the vocabulary on is a character to be spelled in bytes."""
        at = stop + sizes
        active = np.arange(len(stop))
        steps = []
        turn = np.zeros(1, np.uint64)
        counts = np.zeros(len(stop), np.int64)
        while len(active):
            turn += _MIX[2]
            draw = (_mixed(keys[active] + turn) >> np.uint64(11)).astype(np.float64) / 2.0**53
            choice = self.first[at[active]].astype(np.int64)
            behind = np.flatnonzero(self.upto[choice] <= draw)
            while len(behind):
                choice[behind] += 1
                behind = behind[self.upto[choice[behind]] <= draw[behind]]
            steps.append((active, self.piece[choice]))
            counts[active] += 1
            at[active] = self.origin[choice]
            active = active[at[active] > stop[active]]
        last = np.cumsum(counts) - 1
        out = np.zeros(int(counts.sum()), np.int32)
        for k, (who, piece) in enumerate(steps):  # drawn from the end of a part to its start
            out[last[who] - k] = piece
        return out, counts


def sample_ids(lattices: Lattices, texts: list[str | None], keys: list[int | None], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The sampled ids of all texts end to end, and how many each has."""
    row_keys = _mixed(np.array([k or 0 for k in keys], np.int64).view(np.uint64) ^ np.uint64(seed % 2**64))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    done = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE or k == len(texts) - 1:
            found.append(_slice_ids(lattices, texts[done : k + 1], row_keys[done : k + 1]))
            done, size = k + 1, 0
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _slice_ids(lattices: Lattices, texts: list[str | None], row_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(t or "") for t in texts], np.int64)
    chars = _chars("".join(t for t in texts if t))
    begins = np.cumsum(lengths) - lengths
    starts = lattices.pieces.cut(chars, begins[lengths > 0])
    sizes = np.diff(np.r_[starts, len(chars)])
    text = np.searchsorted(begins + lengths, starts, "right")
    per_text = np.bincount(text, minlength=len(texts))
    place = np.arange(len(starts)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    keys = _mixed(row_keys[text] + place.astype(np.uint64) * _MIX[0])
    ids, counts = lattices.sample(lattices.states_of(chars, starts, sizes), sizes, keys)
    ends = np.r_[0, np.cumsum(counts)][np.cumsum(per_text)]
    ids, many = lattices.pieces.with_bytes(ids)
    if many is not None:
        ends = np.r_[0, np.cumsum(many)][ends]
    return ids, np.diff(np.r_[0, ends])


_WORKER: dict = {}


def _lattices(model_file: str, sharpness: float) -> Lattices:
    """The tables this Python worker has built so far."""
    at = (model_file, sharpness)
    if at not in _WORKER:
        _WORKER[at] = Lattices(Pieces(model_file, sharpness))
    return _WORKER[at]


def encoded(text: Column, key: Column, model_file: str, seed: int = 0, sharpness: float = SHARPNESS) -> Column:
    """A sampled segmentation of each whole text, as ``array<int>`` of piece ids.

    The same key, text and seed give the same ids everywhere. A null or empty text gives no ids; a
    null key counts as one key of its own; repeated rows get equal ids. Characters without a piece,
    and the piece mark itself, are spelled in byte pieces, so nothing is lost. A stretch of more
    than ``LONGEST`` characters without a cut is cut there.
    """

    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        ids, counts = sample_ids(_lattices(model_file, sharpness), texts.to_pylist(), keys.to_pylist(), seed)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids, pa.int32()))

    # Marked so that Spark evaluates it once per row, wherever the ids are used after.
    return F.arrow_udf(run, "array<int>").asNondeterministic()(text, F.xxhash64(key))


def decoded(ids: Column, model_file: str) -> Column:
    """The text of ids: pieces and bytes end to end. Null ids give null."""

    def run(rows: pa.Array) -> pa.Array:
        texts = _lattices(model_file, SHARPNESS).pieces.spell(rows)
        return pa.array([None if t is None else t.decode(errors="replace") for t in texts], pa.string())

    return F.arrow_udf(run, "string").asNondeterministic()(ids)
