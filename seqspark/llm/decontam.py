"""Benchmark decontamination by a distributed positional inverted index.

The index is dealt by document: a segment holds the postings (document, position) of its documents' tokens, sorted by
term, and is a row of a table. A query looks up its terms in each segment, takes the rarest term's postings, shifts them
by the term's offset and intersects them with the shifted postings of the next rarest, and so on. No term's postings are
ever gathered from all segments, so that a very frequent word costs each segment its own part only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import WORD_BYTES, stored, utf8, word_chunks


def words_of(data: bytes) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text after A-Z are lower-cased."""
    return [w for words in word_chunks(data, WORD_BYTES) for w in words]


SEGMENT = "segment bigint, doc_ids array<bigint>, rows array<bigint>, n_words array<int>, terms array<bigint>, starts array<int>, docs array<int>, positions array<int>"
KINDS = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3]


def text_hash() -> Column:
    return F.xxhash64("text")


def term_of(word: bytes) -> int:
    """A term's number: 63 bits of its XXH64, never 0."""
    return xxhash.xxh64_intdigest(word) >> 1 | 1


def indexer(docs: DataFrame, vocabulary: set[bytes] | None = None, segment_words: int = 1 << 18) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What makes SEGMENTs of the rows of data_of(docs), one after another: no more than one is held at a time.

    A segment has about segment_words words: doc_ids, rows (a hash of the text) and n_words; terms, sorted, where the
    postings of each start, and the postings' documents (by place in doc_ids) and positions, sorted within a term.

    All words have postings; with a vocabulary only its words have, and other words count alone. A null text has no words;
    a text of more words than a segment is a segment of its own.
    """
    held = docs.sparkSession.sparkContext.broadcast(None if vocabulary is None else {w: term_of(w) for w in vocabulary})
    names = [x.split()[0] for x in SEGMENT.split(", ")]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, made, first_id = held.value, 0, TaskContext.get().partitionId() << 32
        ids: list = []
        rows: list[int] = []
        sizes: list[int] = []
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def segment() -> pa.RecordBatch:
            term, doc, position = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
            order = np.argsort(term, kind="stable")
            terms, starts = np.unique(term[order], return_index=True)
            row = (first_id + made, ids, rows, sizes, terms, starts, doc[order], position[order])
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, KINDS, strict=True)], names)

        total = 0
        for batch in (b.slice(lo, 256) for b in batches for lo in range(0, len(b), 256)):
            for doc_id, own, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "data")), strict=True):
                n = 0
                for words in word_chunks(data, WORD_BYTES):
                    numbers = map(term_of, words) if known is None else map(known.get, words, repeat(0))
                    terms = np.fromiter(numbers, np.int64, len(words))
                    at = np.flatnonzero(terms)
                    parts.append((terms[at], np.full(len(at), len(ids), np.int32), (at + n).astype(np.int32)))
                    n += len(words)
                ids.append(doc_id)
                rows.append(own)
                sizes.append(n)
                total += n
                if total >= segment_words or len(ids) >= 1 << 16:
                    yield segment()
                    ids, rows, sizes, parts, total, made = [], [], [], [], 0, made + 1
        if ids:
            yield segment()

    return index


def data_of(docs: DataFrame) -> DataFrame:
    """What is indexed of docs: doc_id, row (a hash of the text) and data."""
    return docs.select(F.col("doc_id").cast("long"), text_hash().alias("row"), utf8().alias("data"))


def build_index(docs: DataFrame, vocabulary: set[bytes] | None = None, segment_words: int = 1 << 18) -> DataFrame:
    """The segments of indexer(), a row each."""
    return data_of(docs).mapInArrow(indexer(docs, vocabulary, segment_words), SEGMENT)


def stored_index(docs: DataFrame, vocabulary: set[bytes] | None = None) -> DataFrame:
    """The segments as a table. A segment takes some MB, and Spark reads a row group of such rows at once: one has four."""
    return stored(build_index(docs, vocabulary), "index", **{"parquet.block.row.count.limit": "4"})


@dataclass
class Segment:
    """A segment's postings as numpy arrays; a posting is document << 32 | position."""

    terms: np.ndarray
    starts: np.ndarray
    postings: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, k: int) -> Segment:
        sizes, terms, starts, docs, positions = (
            batch.column(c)[k].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_words", "terms", "starts", "docs", "positions")
        )
        return cls(terms, np.append(starts, len(docs)), docs << 32 | positions, sizes)

    def counts(self, terms: np.ndarray) -> np.ndarray:
        """The number of postings of each of the terms."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, np.diff(self.starts)[at], 0)

    def of_term(self, term: int) -> np.ndarray:
        k = np.searchsorted(self.terms, term)
        return self.postings[self.starts[k] : self.starts[k + 1]]


def _in(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_values, wanted)
    return (at < len(sorted_values)) & (sorted_values[np.minimum(at, len(sorted_values) - 1)] == wanted)


def phrase(segment: Segment, terms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Where the terms stand one after another: postings of the first. order: their places, the rarest first."""
    found = segment.of_term(terms[order[0]])
    found = found[(found & 0xFFFFFFFF) >= order[0]] - order[0]
    for at in order[1:]:
        if not len(found):
            break
        found = found[_in(segment.of_term(terms[at]), found + at)]
    return found


def _near(postings: np.ndarray, places: np.ndarray, reach: int) -> np.ndarray:
    """Those of the sorted postings that are up to reach words away from one of the sorted places in the same text."""
    low = np.searchsorted(postings, np.maximum((places & 0xFFFFFFFF) - reach, 0) | places >> 32 << 32)
    high = np.maximum(np.searchsorted(postings, places + reach, "right"), low)
    marks = np.bincount(low, minlength=len(postings) + 1) - np.bincount(high, minlength=len(postings) + 1)
    return postings[np.cumsum(marks[:-1]) > 0]


def proximity(segment: Segment, terms: np.ndarray, order: np.ndarray, within: int) -> np.ndarray:
    """Where the shortest stretches of a text begin that hold all of the different terms, in any order, in up to within
    words: those in which no shorter stretch does. order: the terms' places, the rarest first.

    Only what is near the rarest term's postings is looked at, which changes the work, not the answer.
    """
    places = segment.of_term(terms[order[0]])
    lists = [places]
    for term in dict.fromkeys(terms[order[1:]].tolist()):
        if term == terms[order[0]]:
            continue
        lists.append(_near(segment.of_term(term), places, within - 1))
        places = _near(places, lists[-1], within - 1)
        if not len(places):
            return places
    ends = np.unique(np.concatenate(lists))
    begins = ends.copy()
    for own in lists:
        at = np.searchsorted(own, ends, "right") - 1
        begins = np.where(at >= 0, np.minimum(begins, own[at]), -1)
    fits = (begins >> 32 == ends >> 32) & (ends - begins < within)
    return np.unique(begins[fits])


@dataclass(frozen=True)
class Queries:
    """Queries as arrays of places in terms, one array for each length, and the items that have each of them."""

    words: frozenset[bytes]
    terms: np.ndarray
    by_length: list[tuple[np.ndarray, list[list[str]]]]

    @classmethod
    def windows(cls, items: Iterable[tuple[str, bytes]], size: int) -> Queries:
        """Every window of size consecutive words of each item; an item of fewer words, but not none, is one window."""
        vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for name, data in items:
            own = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(data)]
            n = min(size, len(own))
            for k in range(len(own) - n + 1 if own else 0):
                found.setdefault(n, {}).setdefault(tuple(own[k : k + n]), set()).add(name)
        arrays = [(np.array(list(w), np.int64), [sorted(x) for x in w.values()]) for _, w in sorted(found.items())]
        return cls(frozenset(vocabulary), np.array([term_of(w) for w in vocabulary], np.int64), arrays)


def ask(segment: Segment, queries: Queries, within: int | None = None) -> Iterator[tuple[list[str], int, np.ndarray]]:
    """Items, length and matches of each query that the segment answers: phrases, or proximity matches."""
    counts = segment.counts(queries.terms)
    for windows, items in queries.by_length:
        rare = counts[windows]
        possible = np.flatnonzero((rare > 0).all(axis=1))
        for k, order in zip(possible, np.argsort(rare[possible], axis=1, kind="stable"), strict=True):
            terms = queries.terms[windows[k]]
            found = phrase(segment, terms, order) if within is None else proximity(segment, terms, order, within)
            if len(found):
                yield items[k], windows.shape[1], found


MARKS = "segment bigint, doc_ids array<bigint>, rows array<bigint>, n_words array<int>, hit binary, item_docs array<int>, item_names array<string>"


def marker(docs: DataFrame, queries: Queries) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What makes MARKS of segments: which of their words an occurrence of a query covers, as bits, and which items occur
    where."""
    held = docs.sparkSession.sparkContext.broadcast(queries)
    kinds = [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.string())]
    names = [x.split()[0] for x in MARKS.split(", ")]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                segment = Segment.of(batch, k)
                first = np.concatenate([[0], np.cumsum(segment.sizes)])
                change, pairs = np.zeros(first[-1] + 1, dtype=np.int32), set()
                for items, length, found in ask(segment, held.value):
                    doc = found >> 32
                    at = first[doc] + (found & 0xFFFFFFFF)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + length, -1)
                    pairs.update((int(d), item) for d in np.unique(doc) for item in items)
                bits = np.packbits(np.cumsum(change[:-1]) > 0).tobytes()
                row = (bits, [d for d, _ in sorted(pairs)], [i for _, i in sorted(pairs)])
                own = batch.select(["segment", "doc_ids", "rows", "n_words"]).slice(k, 1).columns
                yield pa.RecordBatch.from_arrays([*own, *(pa.array([x], t) for x, t in zip(row, kinds, strict=True))], names)

    return search


def mark(index: DataFrame, queries: Queries) -> DataFrame:
    """MARKS of each segment."""
    return index.mapInArrow(marker(index, queries), MARKS)


HITS = "doc_id bigint, row bigint, n_words bigint, n_hit bigint, items array<string>"


def count_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """HITS of each document by the MARKS of its segment. Marks of one segment must follow one another; one segment's
    bits are held at a time."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
    names = [x.split()[0] for x in HITS.split(", ")]
    held, hit, items = None, np.zeros(0, np.uint8), {}

    def done() -> pa.RecordBatch:
        _, ids, rows, sizes = held
        first = np.concatenate([[0], np.cumsum(sizes)])
        so_far = np.concatenate([[0], np.cumsum(np.unpackbits(hit, count=first[-1]), dtype=np.int64)])
        out = (ids, rows, sizes, so_far[first[1:]] - so_far[first[:-1]], [sorted(items.get(d, ())) for d in range(len(sizes))])
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)

    for batch in batches:
        for k in range(len(batch)):
            segment = batch.column("segment")[k].as_py()
            if held is None or segment != held[0]:
                if held is not None:
                    yield done()
                sizes = batch.column("n_words")[k].values.to_numpy(zero_copy_only=False).astype(np.int64)
                held = (segment, batch.column("doc_ids")[k].values, batch.column("rows")[k].values, sizes)
                hit, items = np.zeros(-(-int(sizes.sum()) // 8), np.uint8), {}
            hit = hit | np.frombuffer(batch.column("hit")[k].as_py(), np.uint8)
            for d, item in zip(batch.column("item_docs")[k].as_py(), batch.column("item_names")[k].as_py(), strict=True):
                items.setdefault(d, set()).add(item)
    if held is not None:
        yield done()


def counted(marks: DataFrame) -> DataFrame:
    return marks.mapInArrow(count_marks, HITS)


NEAR = "doc_id bigint, item string, position bigint"


def near_searcher(docs: DataFrame, queries: Queries, within: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What makes NEAR of segments: proximity matches, the first places of the shortest stretches of up to within words
    that hold all words of a query, in any order. What documents share a segment makes no difference."""
    held = docs.sparkSession.sparkContext.broadcast(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                ids = batch.column("doc_ids")[k].as_py()
                for items, _, found in ask(Segment.of(batch, k), held.value, within):
                    for item in items:
                        columns = [pa.array([ids[d] for d in found >> 32], pa.int64()), pa.array([item] * len(found)), pa.array(found & 0xFFFFFFFF)]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item", "position"])

    return search


def search_near(index: DataFrame, queries: Queries, within: int) -> DataFrame:
    """NEAR of all segments."""
    return index.mapInArrow(near_searcher(index, queries, within), NEAR)


def blocks_of(benchmark: DataFrame, size: int, block_bytes: int) -> tuple[int, Iterator[Queries]]:
    """The number of blocks of about block_bytes of items, and each block's windows; what is held at once is bounded.
    Repeated rows are taken once."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), utf8().alias("data")).distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // block_bytes))
    blocks = (rows.where(F.pmod(F.xxhash64("item", "data"), F.lit(n)) == k).collect() for k in range(n))
    return n, (Queries.windows(((r["item"], bytes(r["data"])) for r in block), size) for block in blocks)


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 13, per: int = 20, block_bytes: int = 1 << 24, vocabulary: set[bytes] | None = None
) -> DataFrame:
    """doc_id, row (a hash of the text), n_words, n_hit, items (sorted names), contaminated, a row for each row of docs.

    A window is size consecutive words of an item; an item of fewer words, but not none, is one window. A document's
    word inside any occurrence of a window is hit; the document is contaminated if a word is hit and n_hit is at least
    a per-th of n_words. Null texts have no words; a null item_id is an empty name, and items of one name are one item.

    The index has the postings of all words, or of the vocabulary's if one is given, which must then hold all words of
    the benchmark. The benchmark is broadcast in blocks of up to block_bytes, one after another. One block asks each
    segment as soon as it is made, and the index is not stored; for several it is, and their marks are brought together
    by segment.
    """
    n, blocks = blocks_of(benchmark, size, block_bytes)
    if n == 1:
        index, search = indexer(docs, vocabulary), marker(docs, next(blocks))
        found = data_of(docs).mapInArrow(lambda batches: count_marks(search(index(batches))), HITS)
    else:
        index = stored_index(docs, vocabulary)
        marks = reduce(DataFrame.unionByName, [stored(mark(index, queries), "marks") for queries in blocks])
        found = counted(marks.repartition("segment").sortWithinPartitions("segment"))
    n_hit, n_words = F.col("n_hit"), F.col("n_words")
    return found.withColumn("contaminated", (n_hit > 0) & (per * n_hit >= n_words))


def near_items(docs: DataFrame, benchmark: DataFrame, size: int = 13, within: int = 26, block_bytes: int = 1 << 24) -> DataFrame:
    """doc_id, item: the items that have a window (as in contamination()) whose words all stand, in any order, in some
    stretch of up to within words of the document; each pair once, for rows of one doc_id together. As there, the index is
    stored for several blocks only."""
    n, blocks = blocks_of(benchmark, size, block_bytes)
    if n == 1:
        index, search = indexer(docs), near_searcher(docs, next(blocks), within)
        found = data_of(docs).mapInArrow(lambda batches: search(index(batches)), NEAR)
        return stored(found.select("doc_id", "item").distinct(), "near")
    index = stored_index(docs)
    found = [stored(search_near(index, queries, within).select("doc_id", "item").distinct(), "near") for queries in blocks]
    return reduce(DataFrame.unionByName, found).distinct()


def keep_clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs, with all columns, that are not contaminated. Verdicts go by doc_id and a hash of the text."""
    found = contamination(docs, benchmark, **how).where("contaminated")
    bad = found.select(F.col("doc_id").alias("bad_id"), F.col("row").alias("bad_row")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"), F.col("doc_id").cast("long").alias("id"), text_hash().alias("own"))
    clean = rows.join(bad, (F.col("own") == F.col("bad_row")) & F.col("id").eqNullSafe(F.col("bad_id")), "left_anti")
    return clean.select(*[F.col(f"held.`{c}`") for c in docs.columns])
