"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

The turns of both conversations of a pair are laid side by side by their numbers. The first place where they
differ is a minimum over places, so conversations are never gathered to be compared. What stands before it is
the longest common prefix, rendered once as the prompt; the rest of each side is its completion. A completion's
mask says which of its characters are learned: what the assistant says, with the mark that ends its turn.

A rendered turn is its header, its text and an end mark. The opening of a mark within a role or text is broken
by a space, so that no text can pass for a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsong.llm.common import numbered, written

LEARNED_ROLE = "assistant"
OPENING, BROKEN = "<|", "< |"
#: Turn numbers that one row holds; longer conversations come in parts, so that no row grows without bound.
PART_TURNS = 512
LAST = 2**62


def _clean(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit(OPENING), F.lit(BROKEN))


def _rows(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, place (turn number; null ones come last), role, text."""
    rows = turns.select(F.col(conv_id).alias("conv"), F.coalesce(F.col(turn).cast("long"), F.lit(LAST)).alias("place"), F.col(role).alias("role"), F.col(text).alias("text"))
    return rows.where(F.col("conv").isNotNull())


def _entries(rows: DataFrame) -> DataFrame:
    """conv, place, nth (of the rows with that number, by role, then text), role, text: each once."""
    held = rows.groupBy("conv", "place").agg(F.sort_array(F.collect_set(F.struct("role", "text"))).alias("said"))
    return held.select("conv", "place", F.posexplode("said").alias("nth", "one")).select("conv", "place", "nth", "one.role", "one.text")


def pair_by_opening(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """pair_id, chosen_id, rejected_id: conversations in the order of their first turn's MD5, two by two.

    Conversations that open alike stand side by side and are paired with each other; of a pair the first, by
    that order and then by conv_id, is the chosen one. With an odd number the last pair has no rejected one.
    """
    first = _rows(turns, conv_id, turn, role, text).groupBy("conv").agg(F.min(F.struct("place", "role", "text")).alias("first"))
    said = F.concat(F.coalesce("first.role", F.lit("")), F.lit("\n"), F.coalesce("first.text", F.lit("")))
    opened = first.select("conv", F.md5(said).alias("opening"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = numbered(opened, [F.col("opening"), F.col("conv")], parts, "seat")
    odd = F.col("seat") % 2 == 1
    pairs = order.groupBy(F.expr("seat div 2").alias("pair_id"))
    return pairs.agg(F.max(F.when(~odd, F.col("conv"))).alias("chosen_id"), F.max(F.when(odd, F.col("conv"))).alias("rejected_id"))


def preference_turns(turns: DataFrame, pairs: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """pair_id, chosen_id, rejected_id, place, nth, kind (prompt, chosen or rejected), head, body, learned: the pairs' turns rendered, one a row."""
    ids = F.array(F.struct(F.lit("chosen").alias("side"), F.col("chosen_id").alias("conv")), F.struct(F.lit("rejected").alias("side"), F.col("rejected_id").alias("conv")))
    own = ["pair_id", "chosen_id", "rejected_id"]
    sides = pairs.select(*own, F.explode(ids).alias("one")).select(*own, "one.side", F.col("one.conv").alias("s_conv"))
    entries = _entries(_rows(turns, conv_id, turn, role, text))
    laid = written(sides.join(entries, F.col("s_conv") == F.col("conv")).drop("s_conv", "conv"))
    said = F.sha2(F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}), 256)
    places = laid.groupBy("pair_id", "place", "nth").agg(F.count(F.lit(1)).alias("n"), F.min(said).alias("low"), F.max(said).alias("high"))
    apart = places.where("n < 2 or low != high").groupBy(F.col("pair_id").alias("d_pair")).agg(F.min(F.struct("place", "nth")).alias("differs"))
    joined = laid.join(apart, F.col("pair_id") == F.col("d_pair"), "left")
    common = F.col("differs").isNull() | (F.struct("place", "nth") < F.col("differs"))
    kind = F.when(common, F.lit("prompt")).otherwise(F.col("side"))
    head = F.concat(F.lit(OPENING), _clean(F.col("role")), F.lit("|>\n"))
    body = F.concat(_clean(F.col("text")), F.lit("<|end|>\n"))
    learned = ~common & F.coalesce(F.col("role") == LEARNED_ROLE, F.lit(False))
    return joined.where(~(common & (F.col("side") == "rejected"))).select(*own, "place", "nth", kind.alias("kind"), head.alias("head"), body.alias("body"), learned.alias("learned"))


def _of_kind(kind: str) -> Column:
    return F.filter("pieces", lambda x: x["kind"] == kind)


def preference_records(turns: DataFrame, pairs: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """pair_id, part, chosen_id, rejected_id, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask.

    turns has a row a turn, pairs(pair_id, chosen_id, rejected_id) a row a pair. A mask is the lengths in
    characters of the completion's runs, by turns not learned and learned, beginning with one not learned; runs
    may be of length 0, and all add up to the completion. Turns are common if number, role and text agree.

    Defined cases: rows that repeat count once; rows of one conversation with one turn number follow each other
    by role, then text; null turn numbers come last; null roles and texts are rendered as empty ones (but differ
    from them); rows with null conv_ids belong to no conversation. A side that is null or has no turns has an
    empty completion, and equal conversations are all prompt. A pair has a row for every part_turns turn
    numbers that it uses (part: turn number divided by that, whole), and always one with part 0; the parts, in
    order, joined, make the whole. Empty tables give no rows. Columns of turns but the four are
    not read.
    """
    own = ["pair_id", "chosen_id", "rejected_id"]
    rendered = preference_turns(turns, pairs, conv_id, turn, role, text)
    blank = pairs.select(*own, F.lit(0).cast("long").alias("place"), F.lit(0).alias("nth"), F.lit("none").alias("kind"), F.lit("").alias("head"), F.lit("").alias("body"), F.lit(False).alias("learned"))
    piece = F.struct("place", "nth", "head", "body", "learned", "kind")
    parts = rendered.unionByName(blank).groupBy(*own, F.expr(f"place div {int(part_turns)}").alias("part")).agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    of = {k: _of_kind(k) for k in ("prompt", "chosen", "rejected")}
    shown = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat(x["head"], x["body"])), "")
    run = lambda x: F.when(x["learned"], F.array(F.length(x["head"]), F.length(x["body"]))).otherwise(F.array(F.length(x["head"]) + F.length(x["body"]), F.lit(0)))
    mask = lambda xs: F.flatten(F.transform(xs, run))
    return parts.select(
        "pair_id", "part", "chosen_id", "rejected_id", F.size(of["prompt"]).cast("long").alias("prompt_turns"), shown(of["prompt"]).alias("prompt"),
        shown(of["chosen"]).alias("chosen"), mask(of["chosen"]).alias("chosen_mask"), shown(of["rejected"]).alias("rejected"), mask(of["rejected"]).alias("rejected_mask"),
    )


def paired_by_opening(turns: DataFrame) -> DataFrame:
    """preference_records of all conversations, paired by their openings; masks as text, lengths joined by commas."""
    made = preference_records(turns, written(pair_by_opening(turns)))
    return made.select(*[F.array_join(c, ",").alias(c) if c.endswith("_mask") else F.col(c) for c in made.columns])
