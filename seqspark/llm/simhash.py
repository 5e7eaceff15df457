"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits are cut into blocks, each with a perfect code: every word of a block lies within the code's
covering radius of exactly one codeword. The codewords' products are the anchors. A fingerprint's home is the anchor
within the radius; besides, it visits every anchor within the radius plus the threshold. Two fingerprints that differ in
up to the threshold meet at the home of either, where they are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import stored, utf8, word_chunks
from seqspark.llm.components import connected_components

SEED = 42


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """The SimHash of the text's shingles of words, A-Z lower-cased: a bit is 1 if set in over half the hashes.

    A text of fewer words has one shingle, of them all; one without words has fingerprint zero.
    """
    ones, n, last = np.zeros(64, dtype=np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in word_chunks(data.lower()):
        words = last + words
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(shingle)), strict=False)]
        last = words[len(hashes) :]
        if hashes:
            ones += ones_of(np.array(hashes, dtype=np.uint64))
            n += len(hashes)
    if not n:
        return digest(b" ".join(last), SEED) if last else 0
    return majority(ones, n)


def ones_of(hashes: np.ndarray, at_once: int = 1 << 14) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set, the highest bit first. Bits are counted as bytes, eight to a
    64-bit addition, over up to 255 hashes at a time."""
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), at_once):
        bits = np.unpackbits(hashes[lo : lo + at_once].astype(">u8").view(np.uint8)).view(np.uint64).reshape(-1, 8)
        sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)
        ones += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return ones


def majority(ones: np.ndarray, n: int) -> int:
    """The fingerprint of n hashes: the bits that over half of them set."""
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, row (a hash of doc_id and text) and fp, the fingerprint as a signed long, for each row of docs."""

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(d, shingle) for d in batch.column("data").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(fps)], ["doc_id", "row", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), row_hash().alias("row"), utf8().alias("data"))
    return rows.mapInArrow(hash_all, "doc_id long, row long, fp long")


def row_hash() -> Column:
    return F.xxhash64("doc_id", "text")


@dataclass(frozen=True)
class Code:
    """A perfect binary code by the columns of its parity check, with its covering radius."""

    columns: tuple[int, ...]
    radius: int

    @property
    def length(self) -> int:
        return len(self.columns)

    @cached_property
    def syndromes(self) -> tuple[np.ndarray, np.ndarray]:
        """Syndromes of the low 12 bits of a word and of the others."""

        def of(columns: tuple[int, ...]) -> np.ndarray:
            out = np.zeros(1, dtype=np.int64)
            for c in columns:
                out = np.concatenate([out, out ^ c])
            return out

        return of(self.columns[:12]), of(self.columns[12:])

    def syndrome(self, word: np.ndarray) -> np.ndarray:
        low, high = self.syndromes
        return low[(word & np.uint64(len(low) - 1)).astype(np.int64)] ^ high[(word >> np.uint64(12)).astype(np.int64) if len(high) > 1 else 0]

    def moves(self, threshold: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """By syndrome: the word that leads home, and for each excess of the radius the differences from home to the
        codewords at that distance, filled up with zeros."""
        size = 1 << max(self.columns).bit_length()
        home = np.full(size, -1, dtype=np.int64)
        far: list[list[list[int]]] = [[[] for _ in range(size)] for _ in range(threshold)]
        for weight in range(self.radius + threshold + 1):
            for at in combinations(range(self.length), weight):
                word, s = sum(1 << i for i in at), 0
                for i in at:
                    s ^= self.columns[i]
                if weight <= self.radius:
                    if home[s] >= 0:
                        raise ValueError("the code is not perfect")
                    home[s] = word
                else:
                    far[weight - self.radius - 1][s].append(word)
        if (home < 0).any():
            raise ValueError("the code does not cover all words")
        tables = []
        for by_syndrome in far:
            table = np.zeros((size, max(map(len, by_syndrome))), dtype=np.uint64)
            for s, words in enumerate(by_syndrome):
                table[s, : len(words)] = [w ^ int(home[s]) for w in words]
            tables.append(table)
        return home.astype(np.uint64), tables


def repetition(n: int) -> Code:
    """n odd: all zeros or all ones."""
    return Code(((1 << n - 1) - 1, *(1 << i for i in range(n - 1))), n // 2)


def hamming(r: int) -> Code:
    return Code(tuple(range(1, 1 << r)), 1)


def golay() -> Code:
    """The binary Golay code of length 23, by its generator polynomial."""
    columns, x = [], 1
    for _ in range(23):
        columns.append(x)
        x <<= 1
        if x >> 11:
            x ^= 0b110001110101
    return Code(tuple(columns), 3)


#: One bit that is its own codeword.
FREE = Code((0,), 0)
#: 2^28 anchors, and 2^38.
COARSE = (golay(), golay(), repetition(5), repetition(5), repetition(5), repetition(3))
FINE = (golay(), golay(), hamming(4), FREE, FREE, FREE)


@dataclass(frozen=True)
class Covering:
    """The anchors within reach of fingerprints of 64 bits."""

    codes: tuple[Code, ...] = COARSE
    threshold: int = 2
    blocks: tuple = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        if sum(c.length for c in self.codes) != 64 or not 1 <= self.threshold <= 2:
            raise ValueError("the codes' lengths make 64 bits, and the threshold is 1 or 2")
        shift, blocks, tables = 0, [], {}
        for code in self.codes:
            if code not in tables:
                tables[code] = code.moves(self.threshold)
            blocks.append((code, np.uint64(shift), *tables[code]))
            shift += code.length
        object.__setattr__(self, "blocks", tuple(blocks))

    def anchors(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, k) anchors and whether each is one; column 0 is home. All are within radius plus threshold."""
        home, single, double, block_of = fps.copy(), [], [], []
        for k, (code, shift, to_home, tables) in enumerate(self.blocks):
            s = code.syndrome(fps >> shift & np.uint64((1 << code.length) - 1))
            home ^= to_home[s] << shift
            single.append(tables[0][s] << shift)
            block_of += [k] * tables[0].shape[1]
            if self.threshold > 1:
                double.append(tables[1][s] << shift)
        ones = np.concatenate(single, axis=1)
        moves = [np.zeros((len(fps), 1), np.uint64), ones, *double]
        if self.threshold > 1:
            pairs = [(a, b) for a, b in combinations(range(len(block_of)), 2) if block_of[a] != block_of[b]]
            left, right = ones[:, [a for a, _ in pairs]], ones[:, [b for _, b in pairs]]
            moves.append(np.where((left != 0) & (right != 0), left ^ right, np.uint64(0)))
        all_moves = np.concatenate(moves, axis=1)
        there = all_moves != 0
        there[:, 0] = True
        return home[:, None] ^ all_moves, there


def links(prints: DataFrame, covering: Covering) -> DataFrame:
    """a, b: each pair of different fingerprints within the threshold, once. prints has distinct, non-null fp."""

    def place(only_home: bool):
        def at_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, len(batch), 4096):
                    fps = batch.column("fp").slice(lo, 4096).to_numpy().view(np.uint64)
                    anchors, there = covering.anchors(fps)
                    if only_home:
                        anchors, there = anchors[:, :1], there[:, :1]
                    own = np.broadcast_to(fps[:, None], there.shape)[there]
                    yield pa.RecordBatch.from_arrays([pa.array(anchors[there].view(np.int64)), pa.array(own.view(np.int64))], ["anchor", "fp"])

        return at_anchors

    prints = prints.select("fp").repartition("fp")  # a fingerprint's visits are many times its size, so all tasks take part
    homes = prints.mapInArrow(place(True), "anchor long, fp long").withColumnRenamed("fp", "a")
    visits = prints.mapInArrow(place(False), "anchor long, fp long").withColumnRenamed("fp", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= covering.threshold)
    # Spark takes the visits to be as large as the fingerprints that make them, and would send them all to the driver for a broadcast
    return homes.join(visits.hint("merge"), "anchor").where(near).select("a", "b")


def print_labels(prints: DataFrame, threshold: int = 2, codes: tuple[Code, ...] = COARSE) -> DataFrame:
    """fp, label: the component of each fingerprint that is linked to another one. prints has distinct, non-null fp."""
    return connected_components(links(prints, Covering(codes, threshold))).withColumnRenamed("node", "fp")


def _grouped(docs: DataFrame, shingle: int, threshold: int, codes: tuple[Code, ...]) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints, and fp, label, first_id: each fingerprint's component and its smallest doc_id."""
    own = stored(fingerprints(docs, shingle), "fingerprints")
    prints = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    labels = print_labels(prints, threshold, codes)
    return own, prints.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = 3, threshold: int = 2, codes: tuple[Code, ...] = COARSE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id, a row for each row of docs.

    Fingerprints within the threshold are linked; component_id is the smallest doc_id that links reach. Texts without
    words (null, empty) have fingerprint zero and are linked like others. Rows with a null doc_id take part, but give
    no id; a component without ids has a null one. Equal fingerprints are made one first, so that copies cost nothing.
    Links do not depend on the codes; with more anchors (FINE) fewer fingerprints that are far apart meet at one, which
    pays above about 2^28 fingerprints.
    """
    own, known = _grouped(docs, shingle, threshold, codes)
    ids = known.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_print = stored(known.select("fp", "label").join(ids, "label").select("fp", "component_id"), "components")
    return own.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, threshold: int = 2, codes: tuple[Code, ...] = COARSE) -> DataFrame:
    """The rows of docs, with all columns, that stand for their components: the smallest doc_id, null last, and one of
    the rows that share it."""
    own, known = _grouped(docs, shingle, threshold, codes)
    return first_rows(docs, own.join(known.select("fp", "label"), "fp"))


def first_rows(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The first row of docs for each label; labelled has doc_id, row and label for each row of docs."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    kept = labelled.groupBy("label").agg(first).select(F.col("first.row").alias("first_row"), F.col("first.doc_id").alias("first_id"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"), F.col("doc_id").cast("long").alias("id"), row_hash().alias("row"))
    chosen = rows.join(kept, (F.col("row") == F.col("first_row")) & F.col("id").eqNullSafe(F.col("first_id")), "left_semi")
    one = chosen.withColumn("nth", F.expr("row_number() OVER (PARTITION BY row, id ORDER BY row)")).where("nth = 1")
    return one.select(*[F.col(f"held.`{c}`") for c in docs.columns])
