"""Near copies by the Jaccard similarity of word shingles: SimHash and min-hash candidates, each checked exactly.

Sets of shingles whose SimHash fingerprints are linked by anchors (simhash.py) make a bucket. Two bits of 64 find sets that
share almost all; at a similarity of 0.8 about ten bits differ, which no covering code reaches with a bounded number of
visits. So a set also has 32 min-hash fingerprints, each of five minima: two sets of similarity J share one with probability
1 - (1 - J^5)^32, at J = 0.8 all but 3 in a million, and sets that share one make a bucket as well.

A bucket's pairs are not formed. First each of its sets is compared with the one that shares most buckets with others, often
the text that the copies were made of and the same in most of their buckets, and with
three more, chosen anew in each bucket, if it is not yet connected with them, which asks for a number of pairs that grows with
the sets and connects most of what is alike. Only sets that are not connected
with the bucket's largest component then meet the others of their buckets. Everywhere only sets whose sketches agree become a
pair: the low four bits of each of the 160 minima, of which sets of similarity J share J + (1 - J) / 16 in the mean. A pair passes down to 4.5 standard deviations below the mean at the wanted similarity, which loses about 3 pairs
in a million of just that similarity. What passes is checked exactly.

Sketches can't tell 0.7 from 0.8, so that a bucket of many edited copies of a text would still give most of its pairs. What
edits bring into a copy is in few other ones: in large buckets the shingles are counted, and rare ones are joined. Two sets
share no more than what either has besides its rare shingles, and the rare ones that they have in common. Of the former they
share no more than the lesser count in each of 64 cells that shingles are dealt to by hash, which tells edits in different
places apart. Pairs for which that is too little are left out, which loses none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import floor, sqrt
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import discard, stored, utf8, word_chunks
from seqspark.llm.components import connected_components
from seqspark.llm.simhash import SEED, first_rows, majority, ones_of, print_labels, row_hash

#: Fingerprints of a set, and minima of a fingerprint.
BANDS, MINIMA = 32, 5
#: Buckets of more sets are large, and a shingle is rare if no more of their sets have it.
CROWD, RARE = 32, 16
#: Cells that the shingles of a set that are not rare are counted in, a power of two.
CELLS = 64
_XOR, _TIMES = (np.random.default_rng(SEED + k).integers(0, 1 << 64, (BANDS * MINIMA, 1), dtype=np.uint64) for k in (0, 1))


def shingles(data: bytes, shingle: int = 5) -> np.ndarray:
    """The sorted hashes of the text's shingles of words, A-Z lower-cased; a text of fewer words has one, of them all."""
    found, last = [], []
    for words in word_chunks(data.lower()):
        words = last + words
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(shingle)), strict=False)]
        last = words[len(hashes) :]
        found.append(np.array(hashes, dtype=np.uint64))
    if last and not any(map(len, found)):
        found = [np.array([xxhash.xxh64_intdigest(b" ".join(last), SEED)], dtype=np.uint64)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The set's least values under each of the hash functions; none of an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[lo : lo + 2048] ^ _XOR) * (_TIMES | np.uint64(1))).min(axis=1))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """The fingerprints of a set, from its minima."""
    return np.array([xxhash.xxh64_intdigest(m.tobytes(), k) for k, m in enumerate(least.reshape(-1, MINIMA))], dtype=np.uint64)


def sketch(least: np.ndarray) -> np.ndarray:
    """The low four bits of the minima, sixteen in a word."""
    low = (least & np.uint64(15)).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).view(np.uint64)


def agreeing(a: str | Column, b: str | Column) -> Column:
    """How many of the minima agree in their low four bits."""

    def differing(k: int) -> Column:
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        any_bit = reduce(Column.bitwiseOR, (F.shiftright(x, n) for n in (1, 2, 3)), x)
        return F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))

    return F.lit(BANDS * MINIMA) - reduce(add, map(differing, range(BANDS * MINIMA // 16)))


def least_agreeing(similarity: tuple[int, int]) -> int:
    """How many minima of a pair of at least that similarity agree, but for about 3 pairs in a million."""
    over, under = similarity
    share, n = (15 * over / under + 1) / 16, BANDS * MINIMA
    return floor(n * share - 4.5 * sqrt(n * share * (1 - share)))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def sets_of(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, row (a hash of doc_id and text), set (a hash of the set of shingles), n (its size), fp (its SimHash),
    keys (its min-hash fingerprints) and sketch, for each row."""

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                sets = [shingles(d.as_py(), shingle) for d in part.column("data")]
                least = [minima(s) for s in sets]
                ids = _signed([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets])
                columns = [part.column("doc_id"), part.column("row"), ids, pa.array(map(len, sets), pa.int64()), _signed([majority(ones_of(s), len(s)) for s in sets]), _lists([bands(m) for m in least]), _lists([sketch(m) for m in least])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "set", "n", "fp", "keys", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long"), row_hash().alias("row"), utf8().alias("data"))
    return rows.mapInArrow(hash_all, "doc_id long, row long, set long, n long, fp long, keys array<long>, sketch array<long>")


def shingles_of(asked: DataFrame, docs: DataFrame, sets: DataFrame, shingle: int) -> DataFrame:
    """set, held: the shingles of the sets of asked, read from a text of each."""

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column("set"), _lists([shingles(d.as_py(), shingle) for d in part.column("data")])], ["set", "held"])

    rows = asked.distinct().join(sets.select("set", "row"), "set")
    texts = docs.select(row_hash().alias("row"), utf8().alias("data")).join(rows, "row").dropDuplicates(["set"]).select("set", "data")
    return stored(texts.mapInArrow(hash_all, "set long, held array<long>"), "shingles")


def near(pairs: DataFrame, docs: DataFrame, sets: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """Those of pairs (a, b) whose sets' Jaccard similarity is at least the fraction, by their texts."""
    ends = [pairs.select(F.col(x).alias("set")).distinct() for x in "ab"]
    held = shingles_of(ends[0].unionByName(ends[1]), docs, sets, shingle)
    left, right = (held.select(F.col("set").alias(x), F.col("held").alias(f"of_{x}")) for x in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    found = stored(pairs.join(left, "a").join(right, "b").where(enough(both, F.size("of_a"), F.size("of_b"), similarity)).select("a", "b"), "near")
    discard(held)
    return found


def with_heads(known: DataFrame, heads: range, likely) -> DataFrame:
    """a, b: each set of known (key, set, n, label, sketch, met) with those of so many sets of its bucket that have another
    label and are likely near it. The first head of a bucket is the set that meets most others, in all its buckets; the
    further ones are chosen anew in each bucket."""
    order = [F.xxhash64("key", "set", F.lit(k)) if k else -F.col("met") for k in heads]
    own = [F.min(F.struct(o.alias("order"), "set", "n", "label", "sketch")).alias(f"head{k}") for k, o in zip(heads, order, strict=True)]
    chosen = known.groupBy("key").agg(*own, F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")

    def asks(head: Column) -> Column:
        return (F.col("label") != head["label"]) & likely(F.col("n"), head["n"], F.col("sketch"), head["sketch"])

    met = known.join(chosen, "key")
    if len(heads) == 1:
        asked = met.where(asks(F.col(f"head{heads[0]}"))).select("set", F.col(f"head{heads[0]}.set").alias("head"))
    else:
        found = F.filter(F.array(*[F.col(f"head{k}").dropFields("order") for k in heads]), asks)
        asked = met.select("set", F.explode(F.array_distinct(F.transform(found, lambda head: head["set"]))).alias("head"))
    return asked.select(F.least("set", "head").alias("a"), F.greatest("set", "head").alias("b"))


def rare_shingles(held: DataFrame, most: int = RARE) -> DataFrame:
    """set, shingle, times: of held (set, held) the shingles that no more sets have, and how many have each. A task that
    finds a shingle in more of its sets says so in one row."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                values = part.column("held").flatten().to_numpy()
                sets = np.repeat(part.column("set").to_numpy(), part.column("held").value_lengths().to_numpy())
                found, place, times = np.unique(values, return_inverse=True, return_counts=True)
                few, many = times[place] <= most, times > most
                columns = [np.append(sets[few], np.zeros(many.sum(), np.int64)), np.append(values[few], found[many]), np.append(np.ones(few.sum(), np.int64), times[many])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["set", "shingle", "times"])

    told = stored(held.mapInArrow(own, "set long, shingle long, times long"), "told")
    rare = told.groupBy("shingle").agg(F.sum("times").alias("times")).where(F.col("times") <= most)
    found = stored(told.select("set", "shingle").join(rare, "shingle").select("set", "shingle", "times"), "rare")
    discard(told)
    return found


def enough(shared: Column, m: Column, n: Column, similarity: tuple[int, int]) -> Column:
    """Whether sets of m and n shingles that share so many reach the similarity."""
    over, under = similarity
    return (over + under) * shared >= over * (m + n)


def cells_of(held: DataFrame, rare: DataFrame) -> DataFrame:
    """set, cells: how many shingles that are not rare each set of held (set, held) has in each of the cells that their
    hashes are dealt to, and common, their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for held, rare in zip(batch.column("held"), batch.column("rare"), strict=True):
                values = held.values.to_numpy()
                if rare.is_valid:
                    values = values[~np.isin(values, rare.values.to_numpy())]
                found.append(np.bincount(values & (CELLS - 1), minlength=CELLS))
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * CELLS)
            cells = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("set"), cells, pa.array([int(f.sum()) for f in found], pa.int64())], ["set", "cells", "common"])

    own = rare.groupBy("set").agg(F.collect_list("shingle").alias("rare"))
    return held.join(own, "set", "left").select("set", "held", "rare").mapInArrow(count, "set long, cells array<int>, common long")


def shared_at_most(a: str, b: str) -> Column:
    """How many shingles sets with such cells share at most, of those that are counted there."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), add)


def with_rare(crowd: DataFrame, rare: DataFrame, similarity: tuple[int, int], alike, likely) -> DataFrame:
    """a, b: the sets of different components that have a rare shingle in common, may share enough and are likely near.
    crowd has set, n, label, sketch, common, the number of its shingles that are not rare, and cells."""
    own = rare.where("times > 1").select("set", "shingle").join(crowd.drop("cells", "sketch"), "set")
    other = own.select("shingle", *[F.col(c).alias(f"other_{c}") for c in ("set", "n", "label", "common")])
    met = own.join(other, "shingle").where("set < other_set AND label <> other_label").where(alike(F.col("n"), F.col("other_n")))
    pairs = met.groupBy("set", "other_set", "n", "other_n", "common", "other_common").agg(F.count("*").alias("both"))
    may = pairs.where(enough(F.least("common", "other_common") + F.col("both"), F.col("n"), F.col("other_n"), similarity))
    other = crowd.select(*[F.col(c).alias(f"other_{c}") for c in ("set", "cells", "sketch")])
    drawn = may.join(crowd.select("set", "cells", "sketch"), "set").join(other, "other_set")
    found = drawn.where(likely(F.col("n"), F.col("other_n"), F.col("sketch"), F.col("other_sketch")) & enough(shared_at_most("cells", "other_cells") + F.col("both"), F.col("n"), F.col("other_n"), similarity))
    return found.select(F.col("set").alias("a"), F.col("other_set").alias("b"))


def with_others(open_: DataFrame, similarity: tuple[int, int], likely) -> DataFrame:
    """a, b: each set outside its bucket's main component with those of other components that are likely near it, and that
    may share enough without a rare shingle in common. open_ has common and cells, null for sets without a large bucket."""
    other = open_.select("key", *[F.col(c).alias(f"other_{c}") for c in ("set", "n", "label", "common", "cells", "sketch")])
    apart = (F.col("label") != F.col("other_label")) & ((F.col("other_label") == F.col("main")) | (F.col("set") < F.col("other_set")))
    sizes = F.col("n"), F.col("other_n")
    unknown = F.col("common").isNull() | F.col("other_common").isNull()
    coarse = unknown | enough(F.least("common", "other_common"), *sizes, similarity)
    fine = unknown | enough(shared_at_most("cells", "other_cells"), *sizes, similarity)
    met = open_.where("label <> main").join(other, "key")
    pairs = met.where(apart & coarse & likely(*sizes, F.col("sketch"), F.col("other_sketch")) & fine)
    return pairs.select(F.least("set", "other_set").alias("a"), F.greatest("set", "other_set").alias("b"))


def with_more(labels: DataFrame, more: DataFrame) -> DataFrame:
    """set, label: the components when links (a, b) of more are added to those that gave labels (set, label). Only the
    components that more joins are labelled anew, so that the links before are not gone through again."""
    one, two = (labels.select(F.col("set").alias(x), F.col("label").alias(f"of_{x}")) for x in "ab")
    ends = more.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = connected_components(ends.where("a <> b").distinct()).select(F.col("node"), F.col("label").alias("least"))
    old = labels.join(joined, labels["label"] == joined["node"], "left").select("set", F.coalesce("least", "label").alias("label"))
    new = joined.join(labels.select(F.col("set").alias("node")), "node", "left_anti").select(F.col("node").alias("set"), F.col("least").alias("label"))
    return old.unionByName(new)


def components(docs: DataFrame, own: DataFrame, shingle: int, similarity: tuple[int, int], heads: int = 4) -> DataFrame:
    """set, label: the component of each set that is near another one. heads: with how many sets of a bucket all of it
    are compared at first, two at least."""
    over, under = similarity
    sets = own.groupBy("set").agg(*[F.first(c).alias(c) for c in ("n", "fp", "keys", "sketch")], F.min("row").alias("row"))
    sets = stored(sets.where("n > 0"), "sets")
    linked = print_labels(sets.select("fp").distinct()).withColumnRenamed("label", "print")
    buckets = sets.join(linked, "fp", "left").select("set", "n", F.explode(F.array_append("keys", F.xxhash64(F.lit("fp"), F.coalesce("print", "fp")))).alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    # as with the visits, Spark takes the buckets to be as large as the sets that make them
    together = stored(buckets.join(shared.hint("merge"), "key"), "together")
    met = together.groupBy("set").agg(F.sum("size").alias("met")).join(sets.select("set", "sketch"), "set")
    placed = stored(together.drop("size").join(met, "set"), "placed")
    discard(together)

    def alike(m: Column, n: Column) -> Column:
        return under * F.least(m, n) >= over * F.greatest(m, n)

    def likely(m: Column, n: Column, one: Column, two: Column) -> Column:
        return alike(m, n) & (agreeing(one, two) >= least_agreeing(similarity))

    # one of the heads first, then the others for what it has left apart
    asked = stored(with_heads(placed.withColumn("label", F.col("set")), range(1), likely).distinct(), "asked")
    links = near(asked, docs, sets, shingle, similarity)
    first = stored(connected_components(links).select(F.col("node").alias("set"), "label"), "labels")

    def with_labels(labels: DataFrame) -> DataFrame:
        return stored(placed.join(labels, "set", "left").withColumn("label", F.coalesce("label", "set")), "known")

    known = with_labels(first)
    also = stored(with_heads(known, range(1, heads), likely).distinct().join(asked, ["a", "b"], "left_anti"), "asked")
    discard(known)
    joined = near(also, docs, sets, shingle, similarity)
    labels = stored(with_more(first, joined), "labels")
    known = with_labels(labels)
    discard(placed)
    by_label = known.groupBy("key", "label").agg(F.count("*").alias("size"))
    mixed = by_label.groupBy("key").agg(F.max(F.struct("size", "label")).alias("most"), F.count("*").alias("labels"), F.sum("size").alias("size")).where("labels > 1")
    open_ = stored(known.join(mixed.select("key", F.col("most.label").alias("main"), "size"), "key"), "open")
    discard(known)
    crowd = open_.where(F.col("size") > CROWD).select("set", "n", "label", "sketch").dropDuplicates(["set"])
    held = shingles_of(crowd.select("set"), docs, sets, shingle)
    rare = rare_shingles(held)
    crowd = stored(crowd.join(cells_of(held, rare), "set"), "crowd")
    discard(held)
    weighed = open_.join(crowd.select("set", "common", "cells"), "set", "left")
    others = with_others(weighed, similarity, likely).unionByName(with_rare(crowd, rare, similarity, alike, likely))
    rest = stored(others.distinct().join(asked.unionByName(also), ["a", "b"], "left_anti"), "rest")
    for table in (open_, crowd, rare):
        discard(table)
    more = near(rest, docs, sets, shingle, similarity)
    found = stored(with_more(labels, more), "components")
    for table in (sets, asked, also, first, labels, links, joined, rest, more):
        discard(table)
    return found


def keep_first(docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows of docs, with all columns, that stand for their components: the smallest doc_id, null last, and one of
    the rows that share it. Texts are linked if the Jaccard similarity of their sets of shingles is at least the
    fraction; those without words are one component."""
    own = stored(sets_of(docs, shingle), "own")
    labels = components(docs, own, shingle, similarity)
    labelled = own.select("doc_id", "row", "set").join(labels, "set", "left").withColumn("label", F.coalesce("label", "set"))
    return first_rows(docs, labelled)
