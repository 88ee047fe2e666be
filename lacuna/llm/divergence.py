"""Source divergence audit: how far the sources of a language are apart, and by which terms.

A first pass counts in how many documents of its language each term stands, and keeps the terms that
are frequent enough. Perfect hashes of the kept terms, in shards with their keys, are broadcast; the
second pass looks every term up, verifies it against the stored key, and counts it in the slot of its
group. What is broadcast at once is bounded: of a larger vocabulary the shards are sent in blocks, and
the texts are read once for each block.

Pairs of sources are compared slot by slot: a task has some slots of a language, for all its sources,
and gives the sums over these slots.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .perfect_hash import PerfectHash, hashed, shard_of
from .samples import coded

#: Terms of one shard, and bytes of the shards broadcast at once.
SHARD, BLOCK_BYTES = 1 << 15, 32 << 20
#: Different terms a task counts before it sends them on.
COUNTED = 400_000
#: Bytes of text counted at once, and slots of all groups a task holds.
SLICE, DENSE = 4 << 20, 1 << 22
#: Numbers of a table of sources by slots that one task compares.
CELLS = 1 << 21
UNIT = 1_000_000_000

#: In texts: A-Z in lower case, a blank for every other character that is no letter and below 128.
_TABLE = bytes((c | 0x20 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c > 0x7F else 0x20) for c in range(256))


def _terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def _documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents a task meets each term of each language."""
    counts: dict[str, Counter] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            columns = [
                pa.array([lang] * len(found), pa.string()),
                pa.array([t.decode() for t in found], pa.string()),
                pa.array(list(found.values()), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "docs"])
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts.setdefault(lang, Counter()).update(set(_terms(text)))
        if sum(map(len, counts.values())) > COUNTED:
            yield from sent()
    yield from sent()


def kept_terms(rows: DataFrame, least: int) -> DataFrame:
    """``lang, term`` of the terms in ``least`` or more documents of their language; written once."""
    each = rows.mapInArrow(_documents_with, "lang string, term string, docs bigint")
    found = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))
    return stage(found.where(F.col("docs") >= least).select("lang", "term"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms with the shard of their language."""
    for batch in batches:
        terms = [t.encode() for t in batch.column("term").to_pylist()]
        parts = batch.column("parts").to_numpy()
        shard = hashed(terms)[:, 0] % parts.astype(np.uint64) if terms else np.zeros(0)
        columns = [batch.column("lang"), pa.array(shard.astype(np.int32)), batch.column("term")]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "shard", "term"])


def _built(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The perfect hash of one shard's terms."""
    made = PerfectHash([t.encode() for batch in rows for t in batch.column("term").to_pylist()])
    columns = [[key[0].as_py()], [key[1].as_py()], [len(made)], [pickle.dumps(made)]]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], ["lang", "shard", "n", "hash"])


def perfect_hashes(kept: DataFrame) -> DataFrame:
    """``lang, shard, n, first, parts, size, hash``: the shards of each language, and the slot of the
    language at which a shard's slots begin. About ``SHARD`` terms are in a shard; written once."""
    parts = kept.groupBy("lang").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))
    numbered = kept.join(parts, "lang").mapInArrow(_numbered, "lang string, shard int, term string")
    shards = stage(numbered.groupBy("lang", "shard").applyInArrow(_built, "lang string, shard int, n bigint, hash binary"))
    # One row per shard: a language's shards are few against its terms.
    along = Window.partitionBy("lang").orderBy("shard")
    places = shards.select("lang", "shard", (F.sum("n").over(along) - F.col("n")).alias("first"))
    return shards.join(places, ["lang", "shard"]).join(parts, "lang").withColumn("size", F.octet_length("hash"))


class Shards:
    """The broadcast shards of a block, by language."""

    def __init__(self) -> None:
        self.parts: dict[str, int] = {}
        self.slots: dict[str, int] = {}  # slots of the language that this block may give
        self.hashes: dict[tuple[str, int], tuple[int, bytes]] = {}
        self.read: dict[tuple[str, int], PerfectHash] = {}

    def add(self, lang: str, shard: int, parts: int, first: int, n: int, data: bytes) -> None:
        self.parts[lang] = parts
        self.slots[lang] = max(self.slots.get(lang, 0), first + n)
        self.hashes[lang, shard] = (first, data)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"read": {}}

    def look_up(self, lang: str, terms: list[bytes]) -> np.ndarray:
        """The slot of each term in its language; -1 where this block does not know it."""
        out = np.full(len(terms), -1, np.int64)
        if lang not in self.parts or not terms:
            return out
        hashes = hashed(terms)
        shards = shard_of(hashes, self.parts[lang])
        for shard in np.unique(shards).tolist():
            if (lang, shard) not in self.hashes:
                continue
            first, data = self.hashes[lang, shard]
            if (lang, shard) not in self.read:
                self.read[lang, shard] = pickle.loads(data)
            which = np.flatnonzero(shards == shard)
            found = self.read[lang, shard].slots([terms[k] for k in which.tolist()], hashes[which])
            out[which] = np.where(found >= 0, found + first, -1)
        return out


COUNTS = "lang string, source string, slot bigint, n bigint"


def _recount(sent: Broadcast):
    """Texts to how often each group has each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: Shards = sent.value
        dense: dict[tuple[str, str], np.ndarray] = {}
        waiting: dict[str, list[tuple[str, bytes]]] = {}
        held = size = 0

        def emptied() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in dense.items():
                slot = np.flatnonzero(counts)
                names = [pa.array([x] * len(slot), pa.string()) for x in (lang, source)]
                columns = [*names, pa.array(slot, pa.int64()), pa.array(counts[slot], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "slot", "n"])
            dense.clear()

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal held
            for lang, texts in waiting.items():
                width = shards.slots.get(lang, 0)
                if not width:
                    continue
                words = [t.split() for _, t in texts]
                codes, distinct = coded(w for found in words for w in found)
                slots = shards.look_up(lang, distinct)[codes]
                groups, names = coded(s for s, _ in texts)
                group = np.repeat(groups, [len(w) for w in words])
                for k, source in enumerate(names):
                    if (lang, source) not in dense:
                        if held + width > DENSE and dense:
                            yield from emptied()
                            held = 0
                        dense[lang, source] = np.zeros(width, np.int64)
                        held += width
                    own = slots[group == k] if len(names) > 1 else slots
                    found, n = np.unique(own[own >= 0], return_counts=True)
                    dense[lang, source][found] += n
            waiting.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                waiting.setdefault(lang, []).append((source, (text or "").encode().translate(_TABLE)))
                size += len(waiting[lang][-1][1]) + 64
                if size >= SLICE:
                    yield from counted()
                    size = 0
        yield from counted()
        yield from emptied()

    return run


def group_counts(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """``lang, source, slot, n``: how often the kept terms occur in each group; written once."""
    context = rows.sparkSession.sparkContext
    counts: list[DataFrame] = []
    block, size = Shards(), 0

    def recounted() -> None:
        each = rows.mapInArrow(_recount(context.broadcast(block)), COUNTS)
        counts.append(stage(each.groupBy("lang", "source", "slot").agg(F.sum("n").alias("n"))))

    for r in shards.select("lang", "shard", "parts", "first", "n", "hash", "size").orderBy("lang", "shard").toLocalIterator():
        if size and size + r["size"] > BLOCK_BYTES:
            recounted()
            block, size = Shards(), 0
        block.add(r["lang"], r["shard"], r["parts"], r["first"], r["n"], r["hash"])
        size += r["size"]
    if size or not counts:
        recounted()
    found = counts[0]
    for more in counts[1:]:  # slots of other shards: no row of one is in another
        found = found.unionByName(more)
    return found


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slots of a language with their terms."""
    for batch in batches:
        for lang, first, data in zip(*(batch.column(c).to_pylist() for c in ("lang", "first", "hash"))):
            keys = pickle.loads(data).keys
            columns = [
                pa.array([lang] * len(keys), pa.string()),
                pa.array(first + np.arange(len(keys)), pa.int64()),
                pa.array([k.decode() for k in keys], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "slot", "term"])


def _share(n: str, total: str, kept: str) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * kept)), exactly."""
    top = f"cast({UNIT} as decimal(10,0)) * cast({n} + 2 as decimal(19,0))"
    return F.expr(f"1 + ({top}) div cast({total} + 2 * {kept} as decimal(20,0))")


def _shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The same for arrays: long division by thousands, so that no product passes 64 bits."""
    share, rest = np.divmod(counts + 2, totals)
    for _ in range(3):
        rest = rest * 1_000
        share, rest = share * 1_000 + rest // totals, rest % totals
    return 1 + share


PAIRS = "lang string, one string, two string, value bigint"


def _compared(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of some slots of a language to sums over these slots, for each two sources. Every source
    has a row with slot -1, which brings the totals."""
    rows = pa.Table.from_batches(list(batches))
    names = rows.column("source").to_pylist()
    slot, n, total, kept, width = (rows.column(c).to_numpy() for c in ("slot", "n", "total", "kept", "width"))
    sources = sorted(names[k] for k in np.flatnonzero(slot < 0).tolist())
    number = {s: k for k, s in enumerate(sources)}
    owner = np.array([number[s] for s in names])
    first = int(key[1].as_py()) * int(width[0])
    counts = np.zeros((len(sources), max(0, min(int(width[0]), int(kept[0]) - first))), np.int64)
    real = slot >= 0
    counts[owner[real], slot[real] - first] = n[real]
    totals = np.zeros(len(sources), np.int64)
    totals[owner[~real]] = total[~real] + 2 * kept[~real]
    share = _shares(counts, np.maximum(totals, 1)[:, None])
    for k in range(len(sources) - 1):
        apart = share[k + 1 :] - share[k]
        value = (apart * apart // (share[k + 1 :] + share[k])).sum(axis=1)
        m = len(value)
        columns = [
            pa.array([key[0].as_py()] * m, pa.string()),
            pa.array([sources[k]] * m, pa.string()),
            pa.array(sources[k + 1 :], pa.string()),
            pa.array(value, pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "one", "two", "value"])


def audit(
    docs: DataFrame,
    least: int = 10,
    top: int = 10,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``lang, source, part, item, value, rank``: what sets the sources of a language apart.

    Terms are runs of letters a-z (A-Z count as such) and characters beyond ASCII. A language keeps the
    terms in ``least`` or more of its documents, V of them. A group is a source in a language. A term
    that a group has ``n`` times has there the share p = 1 + floor(10**9 * (n + 2) / (N + 2 V)), where N
    counts all kept terms of the group; q is the share in the whole language. Two shares are
    f = floor((p - q)**2 / (p + q)) apart.

    Part ``pair``: for each other source of the language the sum of f over all kept terms. Part ``term``:
    the first ``top`` of the group's terms with p > q, by f. Ranks go by value, falling, then by the
    item's bytes. All numbers are exact.

    Null texts, languages and sources count as empty ones. Repeated rows count repeatedly; a group
    without terms has pairs, a language with one source none, an empty table no rows. Other columns are
    not looked at.
    """

    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    rows = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), F.col(text_col).alias("text"))
    kept = kept_terms(rows, least)
    shards = stage(perfect_hashes(kept))
    counts = stage(group_counts(rows, shards))
    terms = shards.select("lang", "first", "hash").mapInArrow(_terms_of, "lang string, slot bigint, term string")

    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = stage(
        rows.groupBy("lang", "source").agg(F.count("*").alias("rows"))
        .join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"))
    )

    # One row per language, written, so that Spark knows how few they are and does not shuffle counts
    # by language. Some slots of a language and all its sources make one table; the more sources, the
    # fewer slots.
    width = F.greatest(F.lit(16), F.least(F.lit(4_096), F.floor(CELLS / F.count("*"))))
    langs = stage(groups.groupBy("lang").agg(F.max("kept").alias("kept"), F.sum("total").alias("all_total"), width.alias("width")))
    chunks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("kept") / F.col("width")) - 1))
    marks = groups.join(langs.select("lang", "width"), "lang").withColumn("chunk", F.explode(chunks))
    names = ["lang", "chunk", "source", "slot", "n", "total", "kept", "width"]
    marks = marks.withColumns({"slot": F.lit(-1).cast("bigint"), "n": F.lit(0).cast("bigint")}).select(*names)
    placed = counts.join(langs.select("lang", "kept", "width"), "lang").withColumn("total", F.lit(0).cast("bigint"))
    placed = placed.withColumn("chunk", F.floor(F.col("slot") / F.col("width"))).select(*names)
    sums = placed.unionByName(marks).groupBy("lang", "chunk").applyInArrow(_compared, PAIRS)
    sums = stage(sums.groupBy("lang", "one", "two").agg(F.sum("value").alias("value")))
    ways = [F.struct(F.col(a).alias("source"), F.col(b).alias("item")) for a, b in (("one", "two"), ("two", "one"))]
    pairs = sums.select("lang", F.explode(F.array(*ways)).alias("way"), "value")
    pairs = pairs.select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")

    whole = counts.groupBy("lang", "slot").agg(F.sum("n").alias("all_n"))
    known = whole.join(terms, ["lang", "slot"]).join(langs.select("lang", "all_total"), "lang")
    each = counts.join(groups, ["lang", "source"]).join(known, ["lang", "slot"])
    each = each.withColumn("p", _share("n", "total", "kept")).withColumn("q", _share("all_n", "all_total", "kept"))
    each = each.where("p > q").withColumn("value", F.expr("((p - q) * (p - q)) div (p + q)"))
    best = each.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = [df.withColumn("rank", F.row_number().over(order)) for df in (pairs, best)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))
