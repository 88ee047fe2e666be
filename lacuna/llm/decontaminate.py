"""Benchmark decontamination: each training shard is indexed, and test phrases are searched in it.

A shard is one Arrow batch of documents. Its words become numbers in the alphabet of the test
phrases; words no phrase has are separators, and stretches shorter than the shortest phrase cannot
hold one and are left out. Over the rest an FM-index is built; backward search through its wavelet
ranks finds how often each phrase occurs, sampled suffix places tell where, and the spans found are
merged per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, stage, unpacked
from .fm_index import FMIndex

WINDOW = 13
#: Different windows searched in one pass over the documents, and so the size of what is broadcast.
WINDOWS = 1 << 20

#: Word characters: lower-case letters, digits and all beyond ASCII; A-Z are lowered, the rest parts words.
_LOWER = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

FOUND = "struct<n_words: bigint, spans: array<struct<start: int, end: int>>, items: array<string>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def windows_of(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Every window of the items once, as its words joined by blanks, with the items that have it.

    An item with fewer words is one window; one without words has none.
    """

    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            words = words_of(text)
            out.append([b" ".join(words[k : k + width]).decode() for k in range(max(1, len(words) - width + 1))] if words else [])
        return pa.array(out, pa.list_(pa.string()))

    windows = F.explode(F.arrow_udf(cut, "array<string>")(F.col(text_col)))
    each = items.select(F.col(id_col).cast("string").alias("item"), windows.alias("phrase"))
    return each.groupBy("phrase").agg(F.collect_set("item").alias("items"))


class Phrases:
    """Windows as rows of word numbers, right-aligned, and the items of each."""

    def __init__(self, windows: list[tuple[str, list[str]]]):
        vocabulary: dict[bytes, int] = {}
        rows = [[vocabulary.setdefault(w, len(vocabulary) + 1) for w in phrase.encode().split()] for phrase, _ in windows]
        self.vocabulary = vocabulary
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.matrix = np.zeros((len(rows), int(self.lengths.max())), np.int32)
        for k, row in enumerate(rows):
            self.matrix[k, self.matrix.shape[1] - len(row) :] = row
        self.shortest = int(self.lengths.min())
        names = sorted({i for _, items in windows for i in items})
        at = {name: k for k, name in enumerate(names)}
        self.names = np.array(names, object)
        self.item_of = np.array([at[i] for _, items in windows for i in items], np.int64)
        self.item_from = np.concatenate([[0], np.cumsum([len(items) for _, items in windows])])

    def search(self, shard: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the joined words of the shard, length, window) of every occurrence."""
        get, sizes = self.vocabulary.get, [len(words) for words in shard]
        numbers = np.zeros(sum(sizes) + len(sizes), np.int32)  # a separator after each document
        k = 0
        for words, n in zip(shard, sizes):
            numbers[k : k + n] = [get(w, 0) for w in words]
            k += n + 1
        known = np.r_[False, numbers > 0, False]
        starts, ends = np.flatnonzero(known[1:] & ~known[:-1]), np.flatnonzero(known[:-1] & ~known[1:])
        wide = ends - starts >= self.shortest
        starts, ends = starts[wide], ends[wide]
        if not len(starts):
            return (np.zeros(0, np.int64),) * 3
        # The stretches that stay, each with the separator after it; places[i] is where i came from.
        sizes = ends - starts + 1
        offsets = np.cumsum(sizes) - sizes
        places = np.arange(int(sizes.sum())) - np.repeat(offsets - starts, sizes)
        index = FMIndex(numbers[np.minimum(places, len(numbers) - 1)] * (places < np.repeat(ends, sizes)))
        low, high = index.search(self.matrix, self.lengths)
        hits = high - low
        window = np.repeat(np.arange(len(hits)), hits)
        rows = np.arange(len(window)) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(low, hits)
        return places[index.locate(rows)], self.lengths[window], window


def _search(phrases):
    """Documents of one batch to their words, merged spans and items."""

    def run(texts: pa.Array) -> pa.Array:
        shard = [words_of(t) for t in texts.to_pylist()]
        sizes = np.array([len(w) for w in shard], np.int64)
        offsets = np.cumsum(sizes + 1) - (sizes + 1)
        total = int((sizes + 1).sum())
        known: Phrases | None = phrases.value if phrases else None
        place, length, window = known.search(shard) if known and total else (np.zeros(0, np.int64),) * 3
        # Merge: +1 where an occurrence begins, -1 where it ends; a span is where the sum is positive.
        cover = np.zeros(total + 1, np.int32)
        np.add.at(cover, place, 1)
        np.add.at(cover, place + length, -1)
        inside = np.r_[False, cover.cumsum() > 0]
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        spans: list[list] = [[] for _ in shard]
        doc = np.searchsorted(offsets, starts, "right") - 1
        for d, s, e in zip(doc.tolist(), (starts - offsets[doc]).tolist(), (ends - offsets[doc]).tolist()):
            spans[d].append({"start": s, "end": e})
        items: list[list] = [[] for _ in shard]
        if len(place):
            many = known.item_from[window + 1] - known.item_from[window]
            at = np.repeat(known.item_from[window] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            doc = np.repeat(np.searchsorted(offsets, place, "right") - 1, many)
            for pair in np.unique(doc * len(known.names) + known.item_of[at]).tolist():
                items[pair // len(known.names)].append(known.names[pair % len(known.names)])
        return pa.StructArray.from_arrays(
            [
                pa.array(sizes, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array(items, pa.list_(pa.string())),
            ],
            ["n_words", "spans", "items"],
        )

    return run


def _blocks(windows: DataFrame, size: int) -> Iterator[Phrases]:
    """The windows in blocks of at most ``size``, each read by the driver on its own."""
    block: list = []
    for row in windows.toLocalIterator():
        block.append((row["phrase"], row["items"]))
        if len(block) == size:
            yield Phrases(block)
            block = []
    if block:
        yield Phrases(block)


def _joined(a: Column, b: Column) -> Column:
    """The findings of two passes as one: spans merged, items united, both in order."""
    spans = F.array_sort(F.concat(a["spans"], b["spans"]))
    empty = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    merged = F.aggregate(
        spans,
        empty,
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.try_element_at(done, F.lit(-1))["start"].alias("start"),
                        F.greatest(F.try_element_at(done, F.lit(-1))["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    items = F.array_sort(F.array_union(a["items"], b["items"]))
    return F.struct(a["n_words"].alias("n_words"), merged.alias("spans"), items.alias("items"))


def _with_findings(rows: DataFrame, text: Column, items: DataFrame, width: int, block: int, **item_cols: str) -> DataFrame:
    """Add a column ``f`` of what the benchmark's windows hit in a text: ``n_words``, merged ``spans`` of
    word places (end excluded) and ``items``, the ids (as strings, in order) of items that occur.

    The benchmark is searched in blocks of at most ``block`` windows, one pass over the texts each,
    and rows are written between passes: what a task holds of the benchmark is one block.
    """
    context = rows.sparkSession.sparkContext
    names = {"id_col": "item_id", "text_col": "text"} | item_cols
    searched = False
    for phrases in _blocks(windows_of(items, width=width, **names), block):
        new = F.arrow_udf(_search(context.broadcast(phrases)), FOUND)(text)
        rows = stage(rows).withColumn("f", _joined(F.col("f"), new)) if searched else rows.withColumn("f", new)
        searched = True
    return rows if searched else rows.withColumn("f", F.arrow_udf(_search(None), FOUND)(text))


def findings(
    docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", width=WINDOW, block=WINDOWS, **item_cols: str
) -> DataFrame:
    """One row per document: ``id, n_words, spans, items, n_hit, contaminated``.

    A document is contaminated when at least one word in twenty is inside an occurrence. A null or
    empty text has no words and no hits, an item without words no window, an empty benchmark hits
    nothing. An item with a null id still hits, but is not among the ``items``. Repeated rows come
    repeatedly; nothing is shuffled but the benchmark's windows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = _with_findings(rows, F.col("text"), items, width, block, **item_cols)
    f = F.col("f")
    return found.select("id", "f.n_words", "f.spans", "f.items", n_hit(f).alias("n_hit"), contaminated(f).alias("contaminated"))


def n_hit(found: Column) -> Column:
    return F.aggregate(found["spans"], F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def contaminated(found: Column) -> Column:
    return (n_hit(found) > 0) & (20 * n_hit(found) >= found["n_words"])


def keep_clean(docs: DataFrame, items: DataFrame, text_col="text", width=WINDOW, block=WINDOWS, **item_cols: str) -> DataFrame:
    """The documents that are not contaminated (see :func:`findings`), as they came."""
    found = _with_findings(packed(docs), F.col(f"row.`{text_col}`"), items, width, block, **item_cols)
    return unpacked(found.where(~contaminated(F.col("f"))), docs)
