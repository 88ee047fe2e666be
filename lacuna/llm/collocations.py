"""Phrase collocations, counted by multikey quicksort of suffix pointers.

Every word of a piece begins a suffix, of which the first words matter. Suffixes are partitioned three
ways by their first word, the equal part by the second, and so on to the longest phrase; how many
suffixes an equal part holds is how often its phrase occurs, and a part too small for a candidate is
abandoned. In each task this folds the suffixes it has met; then they travel, those with one leading
word together, and the same sort over what met gives the counts of the whole corpus.

Words too rare for any candidate are known from a first count, and end a suffix as a stop does. A
leading word that very many suffixes share is dealt out by the words behind it as well. Its phrases
come as partial counts where they are shorter than the longest, and Spark adds them up. So does it
with the parts of a group that a task cannot hold at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitmaps import bitmap_of
from .common import stage
from .samples import coded

#: Different words a task counts before it sends them on.
COUNTED = 400_000
#: Bytes of text whose suffixes are folded at once.
SLICE = 8 << 20
#: Suffixes sorted at once after they have travelled.
GATHERED = 400_000
#: A leading word with more suffixes than this, and than a share of all, is dealt out.
HOT, HOT_SHARE = 1 << 16, 2_048
#: Parts in which the best phrases of a language are first looked for.
PARTS = 64

#: What ends a piece, and the blanks between words.
STOPS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: In texts: A-Z in lower case, a line break for every stop, a blank for a tab.
_TABLE = bytes.maketrans(STOPS + b"\t", b"\n" * len(STOPS) + b" ")
SEED = 42
#: Mixes the hashes of the words behind a leading word.
_MIX = np.uint64(0x9E3779B97F4A7C15)


def multikey_quicksort(
    words: np.ndarray, at: np.ndarray, weights: np.ndarray, least: list[int]
) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """Equal partitions of the suffixes of ``words`` (numbers; 0 ends a suffix) that begin ``at`` some
    places and stand for ``weights`` suffixes each.

    Returns two lists, by depth: a suffix of every partition that agrees in so many words and its
    weight, if that is ``least[depth - 1]`` or more; and the same for the suffixes that end after so many
    words. All partitions of a depth are split in step, each around the word of its middle suffix, into a
    smaller, an equal and a larger part. A part that can give no result any more is abandoned.
    """
    found, ended = [], [(at[:0], weights[:0])]
    group = np.zeros(len(at), np.int64)
    for depth in range(len(least)):
        enough = min(least[depth:])
        nodes, ends, equal, base = [], [], [], 0
        while len(at):
            key = words[at + depth]
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            size = np.diff(np.r_[first, len(at)])
            index = np.repeat(np.arange(len(first)), size)
            middle = first + size // 2
            pivots = key[middle]
            pivot = pivots[index]
            same = key == pivot
            total = np.bincount(index[same], weights[same], len(first)).astype(np.int64)
            going = pivots > 0
            shown = going & (total >= least[depth])
            nodes.append((at[middle[shown]], total[shown]))
            ends.append((at[middle[~going]], total[~going]))
            if depth + 1 < len(least):
                alive = np.flatnonzero(same & (going & (total >= min(least[depth + 1 :])))[index])
                equal.append((at[alive], weights[alive], base + index[alive]))
                base += len(first)
            side = 2 * index + (key > pivot)
            other = ~same
            rest = np.bincount(side[other], weights[other], 2 * len(first))
            other &= (rest >= enough)[side]
            order = np.concatenate([np.flatnonzero(other & (side % 2 == k)) for k in (0, 1)])
            at, weights, group = at[order], weights[order], side[order]
        none = np.zeros(0, np.int64)
        found.append(tuple(np.concatenate(x) for x in zip((none, none), *nodes)))
        if depth:
            ended.append(tuple(np.concatenate(x) for x in zip((none, none), *ends)))
        at, weights, group = (np.concatenate(x) for x in zip((none, none, none), *equal))
    return found, ended[1:]


def _numbered(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text in which stops are line breaks, as numbers from 1 on, and 0 for a stop; and
    the different words."""
    parts = pc.split_pattern(pa.array([text.replace(b"\n", b" \n ")], pa.large_binary()), b" ").flatten().dictionary_encode()
    found = parts.dictionary.to_pylist()
    number = np.zeros(len(found), np.int64)
    real = np.array([w not in (b"", b"\n") for w in found], bool)
    number[real] = 1 + np.arange(int(real.sum()))
    blank = np.array([w == b"" for w in found], bool)
    codes = parts.indices.to_numpy(zero_copy_only=False)
    return number[codes[~blank[codes]]], [w for w, r in zip(found, real) if r]


def _language(lang: Column) -> Column:
    return F.coalesce(lang, F.lit("und"))


def _clean(text: str | None) -> bytes:
    return (text or "").encode().lower().translate(_TABLE)


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often a task meets each word of each language."""
    counts: dict[str, Counter] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            columns = [[lang] * len(found), [w.decode() for w in found], list(found.values())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())],
                ["lang", "phrase", "f"],
            )
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts.setdefault(lang, Counter()).update(_clean(text).split())
        if sum(map(len, counts.values())) > COUNTED:
            yield from sent()
    yield from sent()


def word_counts(rows: DataFrame) -> DataFrame:
    """``lang, phrase, f`` of all single words of ``rows(lang, text)``, written once."""
    each = rows.mapInArrow(_counted_words, "lang string, phrase string, f bigint")
    return stage(each.groupBy("lang", "phrase").agg(F.sum("f").alias("f")))


ROUTED = "lang string, lead string, salt int, tails string, counts array<int>"


def _suffixes(longest: int, frequent: Broadcast, hot: Broadcast):
    """Texts to folded suffixes: for each leading word the words behind it, and how many suffixes had them."""

    def folded(lang: str, texts: list[bytes]) -> pa.RecordBatch:
        codes, distinct = _numbered(b"\n".join(texts))
        seed = xxhash.xxh64_intdigest(lang.encode(), SEED)
        hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in distinct], np.uint64)
        known = np.flatnonzero(frequent.value.may_hold(hashes.view(np.int64)))
        number = np.zeros(len(distinct) + 1, np.int64)
        number[known + 1] = 1 + np.arange(len(known))
        names = pa.array([b"", *(distinct[k] for k in known.tolist())], pa.binary())
        hashes = np.r_[np.uint64(0), hashes[known]]
        salts = np.array([1, *(hot.value.get(h, 1) for h in hashes[1:].view(np.int64).tolist())], np.uint64)
        words = np.concatenate([number[codes], np.zeros(longest, np.int64)])
        at = np.flatnonzero((words[:-1] > 0) & (words[1:] > 0))
        full, ended = multikey_quicksort(words, at, np.ones(len(at), np.int64), [1] * longest)
        leaves = [(*x, k + 1) for k, x in enumerate(ended) if k] + [(*full[-1], longest)]
        at = np.concatenate([x[0] for x in leaves])
        n = np.concatenate([x[1] for x in leaves])
        size = np.repeat([x[2] for x in leaves], [len(x[0]) for x in leaves])

        behind = [np.where(size > k, words[np.minimum(at + k, len(words) - 1)], 0) for k in range(1, longest)]
        mixed = np.zeros(len(at), np.uint64)
        for w in behind:
            mixed = (mixed ^ hashes[w]) * _MIX
            mixed ^= mixed >> np.uint64(29)
        lead = words[at]
        salt = np.where(salts[lead] > 1, (mixed % salts[lead]).astype(np.int64), -1)
        order = np.lexsort((salt, lead))
        lead, salt, n = lead[order], salt[order], n[order]
        # Shorter tails end in blanks, which a reader skips.
        tails = pc.binary_join_element_wise(*(names.take(pa.array(w[order])) for w in behind), b" ")
        first = np.flatnonzero(np.r_[True, (lead[1:] != lead[:-1]) | (salt[1:] != salt[:-1])]) if len(lead) else lead
        offsets = pa.array(np.r_[first, len(lead)], pa.int32())
        columns = [
            pa.array([lang] * len(first), pa.string()),
            names.take(pa.array(lead[first])).cast(pa.string()),
            pa.array(salt[first], pa.int32()),
            pc.binary_join(pa.ListArray.from_arrays(offsets, tails), b"\n").cast(pa.string()),
            pa.ListArray.from_arrays(offsets, pa.array(n, pa.int32())),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ROUTED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                waiting.setdefault(lang, []).append(_clean(text))
                size += len(waiting[lang][-1]) + 1
                if size >= SLICE:
                    for key, texts in waiting.items():
                        yield folded(key, texts)
                    waiting, size = {}, 0
        for key, texts in waiting.items():
            yield folded(key, texts)

    return run


PHRASES = "lang string, phrase string, words int, f bigint"


def _phrases(rows: list[tuple], least: list[int]) -> pa.RecordBatch:
    """Routed rows (lang, lead, salt, tails, counts) to the phrases of two words or more that they have
    often enough."""
    longest = len(least)
    leads, lead_names = coded((r[0], r[1]) for r in rows)
    lead = np.repeat(leads.astype(np.int64), [len(r[4]) for r in rows]) + 1
    codes, distinct = _numbered("\n".join(r[3] for r in rows).encode() + b"\n")
    stops = np.flatnonzero(codes == 0)
    begins = np.r_[0, stops[:-1] + 1]
    # One line of numbers per suffix, with a 0 behind.
    lines = np.zeros((len(lead), longest + 1), np.int64)
    lines[:, 0] = lead
    for k in range(1, longest):
        has = begins + k - 1 < stops
        lines[has, k] = codes[begins[has] + k - 1]
    weights = np.concatenate([r[4] for r in rows]).astype(np.int64)
    words = lines.ravel()
    found, _ = multikey_quicksort(words, np.arange(len(lead)) * (longest + 1), weights, least)
    names = np.array(["", *(w.decode() for w in distinct)], object)
    langs, firsts = (np.array([x[k] for x in lead_names], object) for k in (0, 1))
    out: list[list] = [[], [], [], []]
    for depth, (at, n) in enumerate(found[1:], 2):
        phrase = firsts[words[at] - 1]
        for k in range(1, depth):
            phrase = phrase + " " + names[words[at + k]]
        for column, values in zip(out, (langs[words[at] - 1], phrase, np.full(len(at), depth), n)):
            column += values.tolist()
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["lang", "phrase", "words", "f"])


def _gathered(longest: int, least: int):
    """Routed rows of a partition, in order of their key, to phrases. What belongs together is counted at
    once and what is too rare dropped, but where a key was dealt out or is more than a task holds: that
    gives partial counts."""
    most = max(least, 1)
    whole = [least] * longest
    dealt = [1] * (longest - 1) + [most]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[bool, list[tuple]] = {False: [], True: []}
        sizes = {False: 0, True: 0}
        current: list[tuple] = []
        key, size, partial = None, 0, False
        for batch in batches:
            counts = batch.column("counts")
            split = counts.offsets.to_numpy().tolist()
            values = counts.values.to_numpy()
            pieces = (values[a:b] for a, b in zip(split[:-1], split[1:]))
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), pieces):
                if row[:3] != key:
                    if partial and current:
                        yield _phrases(current, [1] * longest)
                    elif current:
                        salted = key[2] >= 0
                        ready[salted] += current
                        sizes[salted] += size
                        if sizes[salted] >= GATHERED:
                            yield _phrases(ready[salted], dealt if salted else whole)
                            ready[salted], sizes[salted] = [], 0
                    key, current, size, partial = row[:3], [], 0, False
                current.append(row)
                size += len(row[4])
                if size >= GATHERED:
                    yield _phrases(current, [1] * longest)
                    current, size, partial = [], 0, True
        if partial and current:
            yield _phrases(current, [1] * longest)
        elif current:
            ready[key[2] >= 0] += current
        for salted, rows in ready.items():
            if rows:
                yield _phrases(rows, dealt if salted else whole)

    return run


def phrase_counts(rows: DataFrame, words: DataFrame, longest: int = 3, least: int = 10) -> DataFrame:
    """``lang, phrase, words, f`` of all phrases of 2 to ``longest`` words that occur ``least`` times or
    more in ``rows(lang, text)``; ``words`` are their word counts. Written once."""
    spark = rows.sparkSession
    context = spark.sparkContext
    total = words.agg(F.sum("f")).first()[0] or 0
    share = max(HOT, total // HOT_SHARE)
    key = F.xxhash64("lang", "phrase").alias("key")
    often = words.where(F.col("f") >= least)
    frequent = context.broadcast(bitmap_of(often.select(key)))
    # At most HOT_SHARE words have that large a share.
    hot = {r["key"]: int(r["n"]) for r in words.where(F.col("f") > share).select(key, F.ceil(F.col("f") / share).alias("n")).collect()}
    routed = rows.mapInArrow(_suffixes(longest, frequent, context.broadcast(hot)), ROUTED)
    keys = ["lang", "lead", "salt"]
    met = routed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_gathered(longest, least), PHRASES)
    found = met.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return stage(found)


def _part(first: Column, last: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, last - first + 1), " ")


def _scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Phrases with the counts of both parts at their worst cut, and its score."""
    parts = words.select("lang", "phrase", "f").unionByName(phrases.select("lang", "phrase", "f"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select(
        "lang", "phrase", "words", "f", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("words")).alias("right")
    )
    left = parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    both = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])

    def exact(c: str) -> Column:  # counts below 10**15: no product passes 38 digits
        return F.col(c).cast("decimal(15,0)")

    both = both.withColumn("top", (exact("f") * exact("f") * F.lit(1_000_000).cast("decimal(7,0)")))
    both = both.withColumn("bottom", exact("l") * exact("r")).withColumn("score", F.expr("top div bottom"))
    worst = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return both.groupBy("lang", "phrase", "words", "f").agg(worst).select("lang", "phrase", "words", "f", "cut.l", "cut.r", "cut.score")


def _inside(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, longer``: phrases that lie inside longer ones, and the largest count of those."""
    size = F.col("words")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda k: _part(k, k + n - 1)),
        )
    )
    subs = phrases.where(size > 2).select("lang", "f", F.explode(spans).alias("phrase"))
    return subs.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(
    docs: DataFrame,
    longest: int = 3,
    least: int = 10,
    covered: int = 50,
    top: int = 2_000,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A-Z count as a-z. Texts are cut at stops and line breaks, words parted by blanks and tabs. A
    candidate is a run of 2 to ``longest`` words that occurs ``least`` times or more (``a``); of its cuts
    in two the one with the lowest floor(1,000,000 * a * a / (l * r)) counts, the earliest among equals,
    where ``l`` and ``r`` are how often its parts occur; ``n`` counts all words of the language. A
    candidate inside a longer one that has ``covered`` percent of its occurrences or more is dropped.
    Ranks go by score, then ``a``, both falling, then by the phrase's bytes.

    A null language is ``und``, a null text empty. Repeated rows count repeatedly. A language without
    candidates has no rows, nor has an empty table. Other columns are not looked at. A text may be
    longer than what is sorted at once: it is then a slice of its own.
    """
    if longest < 2:
        raise ValueError(f"a phrase has two words or more: {longest}")
    rows = docs.select(_language(F.col(lang_col)).alias("lang"), F.col(text_col).alias("text"))
    words = word_counts(rows)
    phrases = phrase_counts(rows, words, longest, least)
    often = words.where(F.col("f") >= least)
    kept = _scored(phrases, often).join(_inside(phrases), ["lang", "phrase"], "left")
    kept = stage(kept.where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("f"))))
    # In parts first: what a language's last window sorts is bounded by PARTS * top.
    best = [F.desc("score"), F.desc("f"), F.asc("phrase")]
    in_part = Window.partitionBy("lang", "part").orderBy(*best)
    rank = Window.partitionBy("lang").orderBy(*best)
    first = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first = first.withColumn("place", F.row_number().over(in_part)).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(rank).cast("bigint")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
