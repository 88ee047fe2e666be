"""Removal of repeated passages, by super-k-mers.

A window is a run of ``width`` words. Its minimiser is one of its words, chosen by an order of words
that does not depend on where the window stands, so equal windows have equal minimisers. Consecutive
windows with the same minimiser travel together, as one string of their words, to the bucket of that
minimiser. There every window is spelled out as a hash of its words, and Spark's sort, which spills,
brings equal windows together with the earliest first; all but that one are repeats.

The order puts long words first: they are rarer, so no bucket is that of a word every text has. What
one task meets several times as the same string is sent once, and the later ones are repeats at once:
a passage in a third of all documents reaches its bucket once per task.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

WIDTH = 20
#: Bytes of text looked at at once.
SLICE = 1 << 22
#: Repeats gathered by a task before they are joined to spans.
GATHERED = 1 << 20
#: Strings a task remembers as sent, those it has met more than once.
REMEMBERED = 1 << 17
#: Bits of the filter that tells rows with repeats from rows without: at most 32 MB.
FILTER_BITS = 1 << 28

_PRIMES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_LAST = (1 << 63) - 1  # stands for a null id: later than others


def normalised(texts: list[str | None]) -> list[bytes]:
    """The words of each text, joined by one blank."""
    return [b" ".join((t or "").encode().split()) for t in texts]


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray, keys: tuple[int, ...] = ()) -> np.ndarray:
    """A 64-bit hash of each word; ``raw`` goes on for 24 bytes after the last. With ``keys`` (four odd
    numbers) the hash is another one, which nobody can foresee who does not know them."""
    lengths = ends - starts
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    factors = [np.uint64(k) for k in keys] or [_PRIMES[0], _PRIMES[1], _PRIMES[0], _PRIMES[2]]
    out = lengths.astype(np.uint64) * factors[3]
    for k in range(3):
        out = (out ^ (eight[starts + 8 * k] & _MASKS[np.clip(lengths - 8 * k, 0, 8)])) * factors[k]
        out ^= out >> np.uint64(32)
    for k in np.flatnonzero(lengths > 24).tolist():
        out[k] = xxhash.xxh64_intdigest(raw[starts[k] : ends[k]], keys[0] if keys else 0)
    return out


def _words(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised texts end to end; starts and ends of all words; the first word of each text (and,
    last, the number of words)."""
    raw = b" ".join([*texts, bytes(24)])
    data = np.frombuffer(raw, np.uint8)[: len(raw) - 24]
    gaps = np.flatnonzero(data == 0x20)
    starts = np.r_[0, gaps[:-1] + 1] if len(gaps) else np.zeros(0, np.int64)
    real = gaps > starts  # an empty text leaves an empty word
    counts = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
    return raw, starts[real], gaps[real], np.r_[0, np.cumsum(counts)]


def _priority(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The order of words: by length (up to 15 bytes, longer first), then by hash."""
    return (hashes >> np.uint64(4)) | (np.uint64(15) - np.minimum(lengths, 15).astype(np.uint64)) << np.uint64(60)


def super_kmers(texts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """(text, first word in it, number of words, minimiser, bytes) of every super-k-mer."""
    raw, starts, ends, first = _words(texts)
    n = len(starts)
    if n < width:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), [])
    order = _priority(word_hashes(raw, starts, ends), ends - starts)
    # The least word in the window that begins at each word.
    low = order[: n - width + 1].copy()
    for k in range(1, width):
        np.minimum(low, order[k : n - width + 1 + k], out=low)
    text = np.searchsorted(first, np.arange(n - width + 1), "right") - 1
    inside = np.flatnonzero(first[text + 1] - np.arange(n - width + 1) >= width)
    if not len(inside):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), [])
    new = np.r_[True, (low[inside][1:] != low[inside][:-1]) | (text[inside][1:] != text[inside][:-1])]
    begin = inside[new]
    stop = inside[np.r_[np.flatnonzero(new)[1:], len(inside)] - 1] + width  # after the last window's last word
    strings = [raw[a:b] for a, b in zip(starts[begin].tolist(), ends[stop - 1].tolist())]
    return text[begin], begin - first[text[begin]], stop - begin, low[begin], strings


KMERS = "key bigint, id bigint, tag bigint, at int, n int, words binary"
KMER_NAMES = [c.split()[0] for c in KMERS.split(", ")]


def _cut(width: int):
    """Rows to super-k-mers. One that the task has sent before for an earlier place has no ``words``:
    all its windows are repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, tuple[int, int]] = {}

        def found(ids: list[int], tags: list[int], texts: list[bytes]) -> pa.RecordBatch:
            text, at, n, key, strings = super_kmers(texts, width)
            seen: set[bytes] = set()
            for s in strings:
                if s in seen and len(sent) < REMEMBERED:
                    sent.setdefault(s, (_LAST, _LAST))
                seen.add(s)
            words: list[bytes | None] = list(strings)
            for k, s in enumerate(strings):
                before = sent.get(s)
                if before is not None:
                    place = (ids[text[k]], int(at[k]))
                    if before < place:
                        words[k] = None
                    else:
                        sent[s] = place
            columns = [
                pa.array(key.view(np.int64)),
                pa.array([ids[k] for k in text.tolist()], pa.int64()),
                pa.array([tags[k] for k in text.tolist()], pa.int64()),
                pa.array(at, pa.int32()),
                pa.array(n, pa.int32()),
                pa.array(words, pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, KMER_NAMES)

        for batch in batches:
            ids, tags = batch.column("id").to_pylist(), batch.column("tag").to_pylist()
            texts = normalised(batch.column("text").to_pylist())
            begin = size = 0
            for k, t in enumerate(texts):
                size += len(t)
                if size >= SLICE or k == len(texts) - 1:
                    yield found(ids[begin : k + 1], tags[begin : k + 1], texts[begin : k + 1])
                    begin, size = k + 1, 0

    return run


#: In place of a window's hash: a super-k-mer known as a repeat, whose number of words follows.
KNOWN = -(1 << 63)
WINDOWS = "h1 bigint, h2 bigint, id bigint, tag bigint, at int"
WINDOW_NAMES = [c.split()[0] for c in WINDOWS.split(", ")]


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (base, inverse))


def window_hashes(
    hashes: np.ndarray, begins: np.ndarray, width: int, other: np.ndarray | None = None, base: int | None = None
) -> np.ndarray:
    """128-bit hashes of the windows that begin at some words, from prefix sums of two polynomials. The
    second 64 bits come from ``other`` hashes of the words and an odd ``base``, where they are given."""
    out = []
    lanes = (hashes, hashes if other is None else other)
    bases = (_PRIMES[0], _PRIMES[1] if base is None else np.uint64(base))
    for words, factor, mix in zip(lanes, bases, _PRIMES[2:]):
        up, down = _powers(factor | np.uint64(1), len(words))
        own = (words ^ (words >> np.uint64(31))) * mix
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up[:-1], dtype=np.uint64)])
        value = (sums[begins + width] - sums[begins]) * down[begins]
        value = (value ^ (value >> np.uint64(29))) * _PRIMES[3]
        out.append(value ^ (value >> np.uint64(32)))
    return np.stack(out, axis=1)


def _spelled(width: int):
    """Super-k-mers to their windows. Words are hashed twice, the second time under keys drawn for this
    run, so that no text can be made up beforehand whose windows collide."""
    keys = tuple(secrets.randbits(64) | 1 for _ in range(4))
    base = secrets.randbits(64) | 1

    def windows(words: list[bytes], ids: np.ndarray, tags: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        raw, starts, ends, first = _words(words)
        counts = np.diff(first) - width + 1
        owner = np.repeat(np.arange(len(words)), counts)
        within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        one, two = word_hashes(raw, starts, ends), word_hashes(raw, starts, ends, keys)
        found = window_hashes(one, first[owner] + within, width, two, base).view(np.int64)
        return [np.maximum(found[:, 0], KNOWN + 1), found[:, 1], ids[owner], tags[owner], at[owner] + within]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 5_000):
                part = batch.slice(k, 5_000)
                words = part.column("words").to_pylist()
                columns = [part.column(c).to_numpy().astype(np.int64) for c in ("id", "tag", "at")]
                known = np.array([w is None for w in words])
                rows = [np.full(int(known.sum()), KNOWN), part.column("n").to_numpy()[known], *(c[known] for c in columns)]
                if not known.all():
                    new = windows([w for w in words if w is not None], *(c[~known] for c in columns))
                    rows = [np.concatenate(x) for x in zip(rows, new)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.astype(np.int32 if k == 4 else np.int64)) for k, a in enumerate(rows)], WINDOW_NAMES
                )

    return run


SPANS = "id bigint, tag bigint, start int, end int"


def _spans(ids: np.ndarray, tags: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """Word ranges of rows, those that touch made one."""
    order = np.lexsort((begins, tags, ids))
    ids, tags, begins, ends = ids[order], tags[order], begins[order], ends[order]
    if len(ids):
        other = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])
        row = np.cumsum(np.r_[0, other])
        far = int(ends.max()) + 1
        reach = np.maximum.accumulate(row * far + ends) - row * far
        new = np.flatnonzero(np.r_[True, other | (begins[1:] > reach[:-1])])
        ids, tags, begins, ends = ids[new], tags[new], begins[new], np.maximum.reduceat(ends, new)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())],
        ["id", "tag", "start", "end"],
    )


def _later(width: int):
    """Windows in order to the spans of those that start later than the first of equal ones, and of
    what is known to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.zeros((4, 0), np.int64)  # the first of the windows that equal the last one seen
        gathered: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy().astype(np.int64) for c in ("h1", "h2", "id", "at")]
            h1, h2, ids, at = (np.concatenate(x) for x in zip(first, rows))
            new = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            begin = np.repeat(new, np.diff(np.r_[new, len(h1)]))
            known = h1 == KNOWN
            repeat = known | (ids != ids[begin]) | (at != at[begin])
            repeat[: first.shape[1]] = False
            first = np.array([x[begin[-1:]] for x in (h1, h2, ids, at)])
            tags = batch.column("tag").to_numpy()[repeat[len(h1) - batch.num_rows :]]
            start = at[repeat]
            gathered.append((ids[repeat], tags, start, start + np.where(known[repeat], h2[repeat], width)))
            size += len(tags)
            if size >= GATHERED:
                yield _spans(*(np.concatenate(x) for x in zip(*gathered)))
                gathered, size = [], 0
        if gathered:
            yield _spans(*(np.concatenate(x) for x in zip(*gathered)))

    return run


def repeated_spans(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """``rows(id, tag, text)`` to ``(id, tag, spans)``: for each row with repeats the word ranges (end
    excluded, in order of start) that windows found earlier cover. ``tag`` tells texts of one id apart."""
    kmers = rows.mapInArrow(_cut(width), KMERS)
    # A super-k-mer known as a repeat needs no bucket: any task will do.
    bucket = F.when(F.col("words").isNull(), F.xxhash64("id", "at")).otherwise(F.col("key"))
    windows = kmers.withColumn("key", bucket).repartition("key").mapInArrow(_spelled(width), WINDOWS)
    later = windows.sortWithinPartitions("h1", "h2", "id", "at").mapInArrow(_later(width), SPANS)
    return stage(later.groupBy("id", "tag").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")))


def _removed(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without the words in spans: number of words, number removed, and the rest, joined by blanks."""
    total, gone, kept = [], [], []
    for text, ranges in zip(texts.to_pylist(), spans.to_pylist()):
        words = (text or "").encode().split()
        rest, at = [], 0
        for r in ranges or ():
            rest += words[at : max(at, r["start"])]
            at = max(at, r["end"])
        rest += words[at:]
        total.append(len(words))
        gone.append(len(words) - len(rest))
        kept.append(b" ".join(rest).decode())
    return pa.StructArray.from_arrays(
        [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["n_words", "n_removed", "kept"]
    )


def _slot(tag: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(tag), F.lit(bits))


def _membership(tags: DataFrame) -> tuple[int, np.ndarray]:
    """A bitmap of the hashes of ``tags(tag)``: two bytes per row, at most ``FILTER_BITS`` in all. It is
    built in blocks of 4 KB by a partial aggregate."""
    rows, bits = tags.count(), 1 << 18
    while bits < min(16 * rows, FILTER_BITS):
        bits *= 2
    slot = tags.select((_slot(F.col("tag"), bits) + 1).alias("slot"))  # Spark's bitmaps count from 1
    found = F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    blocks = slot.groupBy(F.bitmap_bucket_number("slot").alias("block")).agg(found)
    out = np.zeros((bits // 8 // 4096 + 2, 4096), np.uint8)
    for row in blocks.toLocalIterator():
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return bits, out


def without_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n_words, n_removed, kept``, the text without repeats.

    Words are what white space parts. A word goes if a window of ``width`` words over it has the same
    words as a window that starts earlier: in a row with a smaller id, or further up in a row of the
    same id. All windows are judged on the texts as they came in. A null text has no words, a text of
    fewer than ``width`` words no window. A null id comes after all others, and all null ids are one.
    Rows that share an id count as one document: windows at the same place in both are not repeats
    of each other, so rows that agree in id and text get the same result. An empty table gives no
    rows.

    Nothing depends on how the input is read: a row is known by its id and a hash of its text. Only
    rows that may have repeats (by a bitmap of bounded size) are shuffled with their text to meet
    their spans; all others pass straight through.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("id"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("tag"),
        F.col(text_col).alias("text"),
        F.col(id_col).cast("bigint").alias("own_id"),
    )
    spans = repeated_spans(rows.select("id", "tag", "text"), width)
    bits, blocks = _membership(spans.select("tag"))
    sent = docs.sparkSession.sparkContext.broadcast(blocks)

    def marked(slots: pa.Array) -> pa.Array:
        at = slots.to_numpy(zero_copy_only=False).astype(np.int64)
        # Blocks are numbered from 1 and hold 32,768 bits each, the lowest bit of a byte first.
        byte = sent.value[at // 32768 + 1, at % 32768 // 8]
        return pa.array((byte >> (at % 8).astype(np.uint8) & 1).astype(bool))

    flagged = rows.withColumn("maybe", F.arrow_udf(marked, "boolean")(_slot(F.col("tag"), bits)))
    kind = "struct<n_words: bigint, n_removed: bigint, kept: string>"
    removed = F.arrow_udf(_removed, kind)
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    alone = flagged.where("not maybe").select("own_id", removed("text", none).alias("r"))
    joined = flagged.where("maybe").join(spans, ["id", "tag"], "left").select("own_id", removed("text", "spans").alias("r"))
    return alone.unionByName(joined).select(F.col("own_id").alias("id"), "r.n_words", "r.n_removed", "r.kept")
