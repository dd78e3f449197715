"""Near copies by word shingles: the SimHash index and a prefix filter find candidates, exact Jaccard decides.

Exact copies are one text from the start. With shingles in one order for all texts, two sets that are alike enough
share one among the first few of each (prefix filter). Texts are brought together in rounds:

* The quick round compares each text with the first of the texts that share one of its first shingles, and with texts whose SimHash fingerprints the byte-position index links (see simhash). What passes the test joins most
  of a group, however large, by a few pairs a text.
* Where texts of different groups still share a first shingle, each is compared with the hub among them: the text that
  shares most with others, as the original of many copies does.
* The last round misses none: texts that share one of their first shingles and are in different groups still are
  brought together, as far as sizes, places and bitmaps allow the similarity. A group that is joined costs no pairs.

A text's bitmap says of each of BITS cells whether an odd number of its shingles fall into it. Two sets differ in at
least as many shingles as their bitmaps differ in bits, so that pairs are put aside without reading the sets. So few
bits tell nothing of long texts, of which any two that share a passage would have their sets compared; before that, each
pair meets by bitmaps with a cell for each shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldsong.llm.common import discard, fresh, tables_written, text_batches, written
from fieldsong.llm.components import components
from fieldsong.llm.simhash import MAX_BITS, SEED, links
from fieldsong.llm.words import ngram_runs

SHINGLE, SIMILARITY = 5, 0.8
#: Texts looked at for common shingles, and how many of these come last in the order of shingles; any order is right, this one is quick.
LOOKED_AT, COMMON = 20_000, 65_536
#: Bits of a text's bitmap; a power of two.
BITS = 512
#: Members of a posting of the prefix filter that are held against the others in one cell.
CELL = 512


def _hashes(data: bytes, n: int):
    """The text's shingles as 64-bit hashes, and how many bytes they have, a run at a time."""
    for shingles in ngram_runs(data.lower(), n):
        yield np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles], dtype="<u8"), np.fromiter(map(len, shingles), np.int64, len(shingles))


def _distinct(data: bytes, n: int) -> np.ndarray:
    """The text's distinct shingles as sorted 64-bit hashes."""
    parts = [np.unique(h) for h, _ in _hashes(data, n)]
    return np.unique(np.concatenate(parts)).view(np.int64) if parts else np.empty(0, np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def shingle_set(text: Column, n: int = SHINGLE) -> Column:
    """A text column's distinct n-word shingles as sorted 64-bit hashes; two shingles count as one if their hashes agree."""

    def read(texts: pa.Array) -> pa.Array:
        return _lists([_distinct((t.as_py() or "").encode(), n) for t in texts])

    return F.arrow_udf(read, "array<long>")(text)


def least_overlap(size: int, share: float) -> int:
    """The least whole number that is at least share of size, safe from rounding."""
    return int(np.ceil(size * share - 1e-6))


def sketch(text: Column, common: np.ndarray, n: int = SHINGLE, similarity: float = SIMILARITY) -> Column:
    """size (distinct shingles), shingles (as many of the first ones as similarity requires), own (how many of these are
    enough where the other text is not smaller), rare (how many are not common), bits, wide (the bitmap with a cell and
    more for each shingle, empty if bits is that), fp (SimHash) of a text column.

    The order is by place in common (64-bit hashes, the commonest last), before them all others, the longest first and
    then by hash: texts share short shingles, of common words, by chance, the more the larger the table is. Texts
    without words have the one shingle 0, the size 0 and the fingerprint 0.
    """
    text_batches()
    by_hash = np.argsort(common, kind="stable")
    ordered = common[by_hash]
    fields = ["size", "own", "rare", "shingles", "bits", "wide", "fp"]
    packed = lambda odd: np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")

    def of(data: bytes) -> tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray, int]:
        ones, total, parts = np.zeros(64, np.int64), 0, []
        for h, length in _hashes(data, n):
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(h)
            h, at = np.unique(h, return_index=True)
            parts.append((h, length[at]))
        if not total:
            return 0, 1, 1, np.zeros(1, np.int64), np.zeros(BITS // 64, np.int64), np.empty(0, np.int64), 0
        h, length = map(np.concatenate, zip(*parts))
        if len(parts) > 1:
            h, at = np.unique(h, return_index=True)
            length = length[at]
        cells = max(BITS, 1 << (len(h) - 1).bit_length())
        odd = np.bincount((h % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
        bits, wide = packed(odd.reshape(-1, BITS).sum(axis=0) & 1), packed(odd if cells > BITS else odd[:0])
        h = h.view(np.int64)
        rank = np.zeros(len(h), np.int64)
        if len(ordered):
            at = np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)
            rank = np.where(ordered[at] == h, by_hash[at] + 1, 0)
        most, own = (len(h) - least_overlap(len(h), x) + 1 for x in (similarity, 2 * similarity / (1 + similarity)))
        first = np.lexsort((h, -length, rank))[:most]
        fp = np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0]
        return len(h), own, int((rank[first] == 0).sum()), h[first], bits, wide, int(fp)

    def read(texts: pa.Array) -> pa.Array:
        got = [of((t.as_py() or "").encode()) for t in texts]
        size, own, rare, shingles, bits, wide, fp = map(list, zip(*got)) if got else [[]] * 7
        columns = [pa.array(size, pa.int32()), pa.array(own, pa.int32()), pa.array(rare, pa.int32()), _lists(shingles), _lists(bits), _lists(wide), pa.array(fp, pa.int64())]
        return pa.StructArray.from_arrays(columns, fields)

    return F.arrow_udf(read, "size int, own int, rare int, shingles array<long>, bits array<long>, wide array<long>, fp long")(text)


def common_shingles(docs: DataFrame, text: str, shingle: int) -> np.ndarray:
    """64-bit hashes of shingles that several of some different texts have, the commonest last."""
    every = max(1, docs.count() // LOOKED_AT)
    spot = F.xxhash64(F.lit(2), F.col(text))
    some = docs.where(F.pmod(spot, F.lit(every)) == 0).select(F.col(text).alias("text"), spot.alias("spot")).dropDuplicates(["spot"])
    each = some.select(F.explode(shingle_set(F.col("text"), shingle)).alias("token"))
    rows = each.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "token").limit(COMMON).select("token").toArrow()
    return rows["token"].to_numpy()[::-1].copy()


def _can_be(m: Column, n: Column, x: Column, y: Column, similarity: float) -> Column:
    """Whether sets of m and n shingles with the bitmaps x and y can have the similarity."""
    apart = sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(BITS // 64)), F.lit(0))
    return _sizes_can_be(m, n, similarity) & (apart <= _most_apart(m, n, similarity))


def _sizes_can_be(m: Column, n: Column, similarity: float) -> Column:
    return F.least(m, n) >= F.greatest(m, n) * similarity - 1e-6


def _most_apart(m: Column, n: Column, similarity: float) -> Column:
    return (m + n) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _wide_apart(x: Column, y: Column) -> Column:
    """Bits in which the bitmaps x and y differ, whose numbers of bits are powers of two: the larger one is folded to the smaller."""
    cells = F.least(F.size(x), F.size(y))
    folded = lambda z: F.transform(F.sequence(F.lit(0), cells - 1), lambda k: F.aggregate(F.sequence(k, F.size(z) - 1, cells), F.lit(0).cast("long"), lambda s, i: s.bitwiseXOR(F.get(z, i))))
    return F.aggregate(F.zip_with(folded(x), folded(y), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def quick_pairs(texts: DataFrame, shared: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts that can have the similarity, a few a text: see the module's first round."""
    stars = shared.select("rep", F.col("first").alias("at")).where("rep != at")
    of_fp = written(texts.groupBy("fp").agg(F.min("rep").alias("at")))
    same = texts.select("rep", "fp").join(of_fp, "fp").where("rep != at").select("rep", "at")
    a, b = of_fp.select(F.col("fp").alias("a"), F.col("at").alias("rep")), of_fp.select(F.col("fp").alias("b"), "at")
    near = links(of_fp.select("fp"), MAX_BITS).join(a, "a").join(b, "b").select("rep", "at").where("rep != at")
    return _possible(stars.unionByName(same).unionByName(near), texts, similarity)


def _possible(found: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of found(rep, at) that can have the similarity by their sizes and bitmaps."""
    pairs = found.select(F.least("rep", "at").alias("a"), F.greatest("rep", "at").alias("b")).distinct()
    left = texts.select(F.col("rep").alias("a"), F.col("size").alias("m"), F.col("bits").alias("x"))
    right = texts.select(F.col("rep").alias("b"), F.col("size").alias("n"), F.col("bits").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(_can_be(F.col("m"), F.col("n"), F.col("x"), F.col("y"), similarity)).select("a", "b").distinct()


def _rooted(postings: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """postings with the root of each text's group, and those tokens, with their number of texts, that several groups have."""
    rooted = postings.join(groups, F.col("rep") == F.col("node"), "left").select("token", "rep", F.coalesce("root", "rep").alias("root"))
    spread = rooted.groupBy("token").agg(F.min("root").alias("least"), F.max("root").alias("largest"), F.count(F.lit(1)).alias("n")).where("least < largest")
    return rooted, spread.select("token", "n")


def hub_pairs(texts: DataFrame, postings: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """The written pairs (a, b) of texts and the hubs of their tokens, in another group, that can have the similarity."""
    rooted, spread = _rooted(postings, groups)
    open_ = written(rooted.join(spread, "token"))
    discard()
    weight = open_.groupBy("rep").agg(F.sum("n").alias("weight"))
    hubs = open_.join(weight, "rep").groupBy("token").agg(F.max(F.struct("weight", "rep", "root")).alias("hub"))
    met = open_.join(hubs, "token").where(F.col("root") != F.col("hub.root")).select("rep", F.col("hub.rep").alias("at"))
    pairs = written(_possible(met, texts, similarity))
    discard(open_)
    return pairs


def missed(texts: DataFrame, postings: DataFrame, early: DataFrame, similarity: float) -> DataFrame:
    """The written pairs (a, b) of texts of different groups that can have the similarity: all that have it are there.

    postings(token, rep): the first shingles that several texts have; early(node, root): the groups so far.
    """
    rooted, spread = _rooted(postings, early)
    cells = F.ceil(F.col("n") / CELL).cast("int")
    between = rooted.join(spread.select("token", cells.alias("cells")), "token")
    about = texts.select("rep", "size", "own", "shingles", "bits")
    open_ = written(between.join(about, "rep").withColumn("pos", (F.array_position("shingles", F.col("token")) - 1).cast("int")).drop("shingles"))
    discard()
    x = open_.where("pos < own").select("token", F.pmod(F.xxhash64("rep", "size"), F.col("cells")).cast("int").alias("cell"), F.col("rep").alias("x"), F.col("root").alias("x_root"), F.col("size").alias("m"), F.col("pos").alias("i"), F.col("bits").alias("x_bits"))
    y = open_.select(F.col("token").alias("y_token"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("y_cell"), F.col("rep").alias("y"), F.col("root").alias("y_root"), F.col("size").alias("n"), F.col("pos").alias("j"), F.col("bits").alias("y_bits"))
    # x is the smaller set; past the place where they meet first there must be enough left of both.
    smaller = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("x") < F.col("y")))
    left = F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) >= (F.col("m") + F.col("n")) * (similarity / (1 + similarity)) - 1e-6
    met = (F.col("token") == F.col("y_token")) & (F.col("cell") == F.col("y_cell")) & (F.col("x_root") != F.col("y_root"))
    close = _can_be(F.col("m"), F.col("n"), F.col("x_bits"), F.col("y_bits"), similarity)
    pairs = written(x.join(y, met & smaller & left & close).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    discard(open_)
    return pairs


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / F.greatest(F.lit(1), F.size(a) + F.size(b) - both))


def _members(keys: DataFrame) -> DataFrame:
    """bucket, cells: bitmaps of 32,768 bits that hold a bit for each row of keys(key), of 64 bits a row in all."""
    cells = 64 * max(1, keys.count())
    at = F.pmod("key", F.lit(cells))
    return keys.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"), F.lit(cells).alias("of")).groupBy("bucket", "of").agg(F.bitmap_construct_agg("bit").alias("cells"))


def _maybe(rows: DataFrame, key: Column, members: DataFrame) -> DataFrame:
    """rows whose key is among members, and about one in 64 of the others; rows are not shuffled."""
    of = members.select("of").first()
    if of is None:
        return rows.limit(0)
    at = F.pmod(key, F.lit(of["of"]))
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col("cells"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = rows.join(F.broadcast(members.select("bucket", "cells")), F.bitmap_bucket_number(at) == F.col("bucket"))  # eight bytes a member
    return held.where(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1).select(*rows.columns)


def _alike(docs: DataFrame, texts: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The written pairs (a, b) whose sets of shingles have the similarity. docs(doc_id, digest_a, text).

    Wide bitmaps leave few pairs that are not alike. Texts stay where they are read: bitmaps tell, but for some too
    many, which ones these pairs need, so that only the sets of these are shuffled.
    """
    wide = F.when(F.size("wide") > 0, F.col("wide")).otherwise(F.col("bits"))
    left, right = (texts.select(F.col("rep").alias(k), F.col("digest_a").alias(f"{k}_digest"), F.col("size").alias(m), wide.alias(x)) for k, m, x in ("amx", "bny"))
    both = pairs.join(left, "a").join(right, "b").where(_sizes_can_be(F.col("m"), F.col("n"), similarity))
    marked = written(both.where(_wide_apart(F.col("x"), F.col("y")) <= _most_apart(F.col("m"), F.col("n"), similarity)).select("a", "a_digest", "b", "b_digest"))
    key = lambda i, d: F.xxhash64(F.lit(3), i, d)
    members = written(_members(marked.select(key("a", "a_digest").alias("key")).union(marked.select(key("b", "b_digest"))).distinct()))
    own = _maybe(docs.select("doc_id", "digest_a", "text"), key("doc_id", "digest_a"), members)
    sets = written(own.select(F.col("doc_id").alias("rep"), "digest_a", shingle_set(F.col("text"), shingle).alias("shingles")))
    discard(members)
    once = sets
    if not sets.groupBy("rep", "digest_a").count().where("count > 1").isEmpty():  # rows of one document and text
        once = sets.dropDuplicates(["rep", "digest_a"])
    left, right = (once.select(F.col("rep").alias(x), F.col("digest_a").alias(f"{x}_digest"), F.col("shingles").alias(f"{x}_set")) for x in "ab")
    alike = written(marked.join(left, ["a", "a_digest"]).join(right, ["b", "b_digest"]).where(jaccard(F.col("a_set"), F.col("b_set")) >= similarity).select("a", "b"))
    discard(sets, marked)
    return alike


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, digest_a, digest_b (of the text), component_id: the smallest doc_id that near copies lead to.

    Equal texts are linked, and texts whose sets of shingles (64-bit hashes) have a Jaccard similarity of at least
    similarity. ASCII case and white space don't count. Null texts are as empty ones; texts without words are alike.
    Rows with null doc_ids take no part in links to other texts. Rows of one doc_id are one document, whatever their
    texts. One row a row of docs; an empty table gives none. Other columns of docs are not read.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("digest_a"), F.xxhash64(F.lit(1), whole).alias("digest_b"), F.col(text).alias("text"))
    common = common_shingles(plain, "text", shingle)
    first = Window.partitionBy("digest_a", "digest_b").orderBy(F.col("doc_id").asc_nulls_last())
    sketched = plain.select("doc_id", "digest_a", "digest_b", sketch(F.col("text"), common, shingle, similarity).alias("sketch"))
    texts = written(sketched.withColumn("nth", F.row_number().over(first)).where("nth = 1").select(F.col("doc_id").alias("rep"), "digest_a", "digest_b", "sketch.*"))
    discard()
    live = texts.where("rep is not null")
    # Common shingles are taken for shared; the postings of others are small, so that a window may count them.
    of_token = Window.partitionBy("token")
    rare = live.select("rep", F.explode(F.slice("shingles", 1, F.col("rare"))).alias("token"))
    counted = rare.select("rep", "token", F.min("rep").over(of_token).alias("first"), F.max("rep").over(of_token).alias("last"))
    shared = written(counted.where("first < last").drop("last"))
    discard()
    found = written(quick_pairs(live, shared, similarity))
    discard()
    quick = _alike(plain, live, found, shingle, similarity)
    early = components(quick)
    often = live.select("rep", F.explode(F.expr("slice(shingles, rare + 1, size(shingles) - rare)")).alias("token"))
    postings = shared.select("token", "rep").unionByName(often.select("token", "rep"))
    around = hub_pairs(live, postings, early, similarity)
    early = components(early.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_alike(plain, live, around, shingle, similarity)))
    rest = missed(live, postings, early, similarity)
    discard(shared, found, quick, around)
    late = _alike(plain, live, rest, shingle, similarity)
    roots = components(early.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late))
    joined = texts.join(roots, texts.rep == roots.node, "left").select(F.col("digest_a").alias("t_a"), F.col("digest_b").alias("t_b"), F.coalesce("root", "rep").alias("component_id"))
    return plain.drop("text").join(joined, (F.col("digest_a") == F.col("t_a")) & (F.col("digest_b") == F.col("t_b"))).select("doc_id", "digest_a", "digest_b", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without all but one document of each group of near copies: the one with the smallest doc_id.

    All columns are kept. Rows that repeat a doc_id and a text are one document.
    """
    a, b, k_id, k_a, k_b = (fresh(docs, c) for c in ("own_digest_a", "own_digest_b", "kept_id", "kept_a", "kept_b"))
    whole = F.coalesce(F.col(text), F.lit(""))
    with tables_written() as tables:
        groups = near_copies(docs, doc_id, text, **how)
    kept = written(groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias(k_id), F.col("digest_a").alias(k_a), F.col("digest_b").alias(k_b)).agg(F.count(F.lit(1)).alias("n_rows")))
    discard(*tables)
    rows = docs.withColumn(a, F.xxhash64(whole)).withColumn(b, F.xxhash64(F.lit(1), whole))
    stay = rows.join(kept.drop("n_rows"), (F.col(a) == F.col(k_a)) & (F.col(b) == F.col(k_b)) & F.col(doc_id).eqNullSafe(F.col(k_id)), "left_semi")
    if not kept.where("n_rows > 1").isEmpty():
        stay = stay.dropDuplicates([doc_id, a, b])
    return stay.select(*docs.columns)
