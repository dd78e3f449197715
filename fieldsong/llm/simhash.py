"""SimHash near-duplicates through an inverted index on positional bytes with count filtering.

Fingerprints of 64 bits are eight bytes at eight positions. Two that differ in at most d bits share at least
8 - d of them. Postings of one byte would hold a 256th of all fingerprints each, so a posting is four bytes at
once, at the positions of one of fourteen blocks. The blocks hold every three positions exactly once together, so
how many blocks a pair shares tells how many bytes it shares: all 14 for eight bytes, 7 for seven, 3 for six, at
most 1 for fewer. Each pair met in postings is tallied by blocks, pairs that reach the guaranteed minimum are
retained, and their differing bits verified.

Only distinct fingerprints are indexed, so copies never meet each other. Near copies of one text can be many within
two bits of each other: members of a posting that holds more than CROWDED are not paired but linked by way of the
numbers that are at most one bit from two of them (see _stars), which joins the same ones by a number of links that
grows with the members.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsong.llm.components import components
from fieldsong.llm.common import text_batches, written
from fieldsong.llm.words import ngram_runs

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Members of postings with more than this go the way of _stars.
CROWDED = 24
#: Blocks of four positions: with the position's number in binary as a point of a space over {0, 1}, its planes.
BLOCKS = [p for p in combinations(range(8), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]


def fingerprint_of(data: bytes, n: int) -> int:
    """The bits that are set in over half of the hashes of n-word shingles; ASCII case and white space don't count."""
    ones, total = np.zeros(64, dtype=np.int64), 0
    hashed = xxhash.xxh64_intdigest
    for shingles in ngram_runs(data.lower(), n):
        h = np.array([hashed(x, SEED) for x in shingles], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
    bits = np.packbits(ones * 2 > total, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """A text column's fingerprints as signed longs. Texts without words, null ones too, have 0."""
    text_batches()

    def read(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of((t.as_py() or "").encode(), shingle) for t in texts], pa.int64())

    return F.arrow_udf(read, "long")(text)


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _bytes_at(fp: Column, positions: tuple[int, ...]) -> Column:
    mask = sum(255 << 8 * k for k in positions)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def bits_apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def least_tally(max_bits: int) -> int:
    """Blocks that two fingerprints share at least if they differ in at most max_bits bytes."""
    return sum(not set(p) & set(range(max_bits)) for p in BLOCKS)


def _posting(at: int, positions: tuple[int, ...]) -> Column:
    return F.struct(F.lit(at).alias("at"), _bytes_at(F.col("fp"), positions).alias("held"))


def _stars(crowded: DataFrame, max_bits: int) -> DataFrame:
    """Links(a, b) that join any two of crowded(fp) at most max_bits apart, without pairing them, for 0 to 2 bits.

    Two fingerprints at most two bits apart have a meeting point: a number that is each of them with at most one
    bit turned. Each fingerprint calls at its 65 points, and all that call at one point, who are two bits apart
    at most, are linked to the smallest. With one bit, only those who call on each other are linked.
    """
    flips = [0, *((1 << k) - (1 << 64) if k == 63 else 1 << k for k in range(64))]
    turns = F.array(*[F.lit(x).cast("long") for x in (flips if max_bits else [0])])
    calls = crowded.select("fp", F.explode(F.transform(turns, lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    if max_bits < 2:
        return calls.join(crowded.select(F.col("fp").alias("host")), F.col("point") == F.col("host")).where("fp < host").select(F.col("fp").alias("a"), F.col("host").alias("b"))
    first = calls.groupBy("point").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    linked = calls.join(first, "point").where(F.col("fp") != F.col("least"))
    return linked.select(F.col("least").alias("a"), F.col("fp").alias("b")).where(bits_apart(F.col("a"), F.col("b")) <= max_bits)


def postings(fps: DataFrame) -> DataFrame:
    """fp, at (the block), held (its bytes), n: the written index, without postings of one member."""
    index = fps.select("fp", F.explode(F.array(*[_posting(k, p) for k, p in enumerate(BLOCKS)])).alias("posting")).select("fp", "posting.*")
    sizes = index.groupBy("at", "held").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return written(index.join(sizes, ["at", "held"]))


def tallied(index: DataFrame, max_bits: int) -> DataFrame:
    """Pairs (a, b) that meet in the postings, with tally, the blocks that they share, where it is enough for max_bits."""
    a, b = index.select("at", "held", F.col("fp").alias("a")), index.select(F.col("at").alias("b_at"), F.col("held").alias("b_held"), F.col("fp").alias("b"))
    met = a.join(b, (F.col("at") == F.col("b_at")) & (F.col("held") == F.col("b_held")) & (F.col("a") < F.col("b")))
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("tally")).where(F.col("tally") >= least_tally(max_bits))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links(a, b) between distinct fingerprints fps(fp): enough to join all that are at most max_bits apart.

    Two that share a crowded posting are joined by _stars; two that share none meet in all the blocks that they share,
    so their tally is whole.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("fingerprints are linked at 0, 1 or 2 differing bits")
    index = postings(fps)
    pairs = tallied(index.where(F.col("n") <= CROWDED), max_bits).where(bits_apart(F.col("a"), F.col("b")) <= max_bits)
    return pairs.select("a", "b").unionByName(_stars(index.where(F.col("n") > CROWDED).select("fp").distinct(), max_bits))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp (signed long), component_id for each row of docs.

    Fingerprints link at max_bits or fewer differing bits; component_id is the smallest doc_id that links reach,
    from equal fingerprints too. Texts without words, null ones too, have fingerprint 0 and are linked like any
    other. Null doc_ids count as larger than any; repeated rows are in one component. An empty table gives no
    rows. Other columns of docs are not read.
    """
    marked = written(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp")))
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    joined = components(links(classes.select("fp"), max_bits))  # fp, root: the smallest fingerprint of its component
    rooted = classes.join(joined, classes.fp == joined.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "rep")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_fp = rooted.join(least, "root").select(F.col("fp").alias("of_fp"), "component_id")
    return marked.join(of_fp, marked.fp == F.col("of_fp")).select("doc_id", "fp", "component_id")
