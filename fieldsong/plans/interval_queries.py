"""Queries on intervals and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsong.functions import units
from fieldsong.operators import align, intervals, summary
from fieldsong.plans.adapters import DET, detections, table

BY = ["rec", "species"]


def _r(df: DataFrame, *names: str) -> DataFrame:
    """Rounded; times as whole milliseconds, which both engines cut alike."""
    return df.withColumns({c: F.floor(F.col(c) * 1000).cast("long") if c in ("s", "e") else F.round(c, 4) for c in names})


def presence_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join gaps up to an hour, drop what is shorter than half an hour, and report each day."""
    joined = intervals.join_gaps(detections(spark, sf_dir), BY, 3600.0, "cert")
    return summary.certainty_by_bin(intervals.drop_short(joined, 1800.0), BY, 86400.0).select(*BY, "bin", "max_cert", "n")


def _islands(cond: str, order: str = "s, ord") -> str:
    return f"""w AS (SELECT *, max(e) OVER (PARTITION BY rec, species ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM det),
g AS (SELECT *, sum(CASE WHEN pm IS NULL OR {cond} THEN 1 ELSE 0 END) OVER (PARTITION BY rec, species ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS isl FROM w),
m AS (SELECT rec, species, isl, min(s) AS s, max(e) AS e, avg(cert) AS cert, count(*) AS pieces FROM g GROUP BY rec, species, isl)"""


def merge_overlap_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(intervals.merge_overlapping(detections(spark, sf_dir), BY), "s", "e")


def merge_overlap_certainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(intervals.merge_overlapping(detections(spark, sf_dir), BY, "cert"), "s", "e", "cert")


def join_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(intervals.join_gaps(detections(spark, sf_dir), BY, 3600.0), "s", "e")


def join_gaps_certainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(intervals.join_gaps(detections(spark, sf_dir), BY, 3600.0, "cert"), "s", "e", "cert")


def delete_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(intervals.drop_short(detections(spark, sf_dir), 6000.0).select("ord", "rec", "species", "s", "e"), "s", "e")


def split_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(intervals.split_long(detections(spark, sf_dir), 20000.0).select("ord", "piece", "s", "e"), "s", "e")


def split_to_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(intervals.split_to_chunks(detections(spark, sf_dir), 9000.0).select("ord", "chunk", "cs", "ce"), "cs", "ce")


def regular_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec"), F.pmod("o_orderkey", F.lit(600)).cast("double").alias("duration"))
    return intervals.regular_segments(files, 10.0, 60.0).select("rec", "s", "e")


def rle_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of days with detections, by recorder."""
    det = detections(spark, sf_dir)
    days = det.select("rec", F.floor(F.col("s") / 86400).cast("long").alias("day"))
    spine = days.groupBy("rec").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("rec", F.explode(F.sequence("a", "b")).alias("day"))
    flagged = spine.join(days.distinct().withColumn("on", F.lit(1)), ["rec", "day"], "left").withColumn("on", F.coalesce("on", F.lit(0)))
    return intervals.run_lengths(flagged, ["rec"], "day", "on", 1.0)


def active_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return intervals.longest_run(ev, ["user_id"], ["ts", "event_id"], F.col("value") >= 50, 0.5)


def overlap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlap_counts(detections(spark, sf_dir), BY, own=True).select("ord", "rec", "species", "overlaps")


def clip_to_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit(1704844800.0)
    return _r(intervals.clip_to_page(detections(spark, sf_dir), day, day + 86400).select("ord", "s", "e"), "s", "e")


def union_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = detections(spark, sf_dir)
    return _r(intervals.union_segments(det.where("cert = 100"), det.where("cert = 50"), BY), "s", "e")


def presence_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = detections(spark, sf_dir).where("cert >= 90")
    return summary.presence(detections(spark, sf_dir), det, det)


def certainty_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.overview(detections(spark, sf_dir), ["rec"], 86400.0)


def file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = detections(spark, sf_dir)
    return summary.file_status(det, det.where("species = 'error'"))


def discretise_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence of purchases in each hour up to the end of a recorder's last detection."""
    every = detections(spark, sf_dir).select("rec", "species", (F.col("s") - 1704067200).alias("s"), (F.col("e") - 1704067200).alias("e"))
    files = every.groupBy("rec").agg(F.max("e").alias("duration"))
    return summary.discretised(files, every.where("species = 'purchase'").select("rec", "s", "e"), ["rec"], 3600.0)


def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = detections(spark, sf_dir)
    n = F.col("e") - F.col("s")
    return _r(det.groupBy("rec").agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.median(n).alias("median"), F.avg(n).alias("mean"), F.count(F.lit(1)).alias("n")), "shortest", "longest", "median", "mean")


def frequency_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(summary.frequency_range(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice", 64000), "f1", "f2")


def survey_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = detections(spark, sf_dir).withColumn("day", F.floor(F.col("s") / 86400).cast("long"))
    return det.rollup("rec", "day").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cert") < 100).alias("to_review"), F.count_distinct("species").alias("kinds"))


def calltype_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).groupBy("species", "cert").agg(F.count(F.lit(1)).alias("n"))


def day_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.where(units.in_day_window(units.second_of_day(F.col("ts")), F.lit(28800), F.lit(61200))).select("event_id")


def day_window_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.where(units.in_day_window(units.second_of_day(F.col("ts")), F.lit(61200), F.lit(28800))).select("event_id")


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Detections of recorders of even and odd number, neighbours in number as a pair."""
    det = detections(spark, sf_dir)
    even = det.where("rec % 2 = 0").select((F.col("rec") / 2).cast("long").alias("pair"), "ord", "s", "e")
    odd = det.where("rec % 2 = 1").select(((F.col("rec") - 1) / 2).cast("long").alias("pair"), F.col("ord").alias("ord2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return even, odd


PAIRS = """a AS (SELECT rec // 2 AS pair, ord, s, e FROM det WHERE rec % 2 = 0), b AS (SELECT rec // 2 AS pair, ord AS ord2, s AS s2, e AS e2 FROM det WHERE rec % 2 = 1)"""


def overlap_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(align.overlap_seconds(*_two(spark, sf_dir), ["pair"], 86400.0, 300.0), "overlap")


def shift_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds in common of neighbouring recorders at each of 601 shifts of ten minutes."""
    return _r(align.shift_overlaps(*_two(spark, sf_dir), ["pair"], 300, 600.0, 86400.0), "overlap")


def best_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.best_shift(align.shift_overlaps(*_two(spark, sf_dir), ["pair"], 300, 600.0, 86400.0), ["pair"])
    return _r(found.select("pair", "shift", "overlap"), "overlap")


def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    return _r(align.best_match(a, b, ["pair"], ["ord"], 86400.0).select("ord", "ord2", "overlap"), "overlap")


def noise_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views that touch no purchase of the same recorder."""
    det = detections(spark, sf_dir)
    truth = det.where("species = 'purchase'").select("rec", F.col("s").alias("s2"), F.col("e").alias("e2"))
    return align.not_touching(det.where("species = 'view'"), truth, ["rec"], ["ord", "rec"], 86400.0).select("ord", "rec")


def unannotated_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of a month that none of a recorder's detections touches, joined where they meet."""
    det = detections(spark, sf_dir).select("rec", ((F.col("s") - 1704067200) / 3600).alias("s2"), ((F.col("e") - 1704067200) / 3600).alias("e2"))
    spine = det.select("rec").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(719))))
    free = align.uncovered_seconds(spine, det, ["rec"], 24.0).select("rec", F.col("t").cast("double").alias("s"), (F.col("t") + 1.0).alias("e"), F.col("t").alias("ord"))
    return intervals.join_gaps(free, ["rec"], 0.0).select("rec", "s", "e", "pieces")


def annotation_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and recorders of detections of certainty 50 and more, without as many of those that are not 50; all recorders."""
    det = detections(spark, sf_dir)
    return det.where("cert >= 50").select("species", "rec").exceptAll(det.where("cert != 50").select("species", "rec"))


def next_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each recorder, the first detection after the tenth of January that is not certain."""
    det = detections(spark, sf_dir).where((F.col("s") > 1704844800.0) & (F.col("cert") < 100))
    return det.groupBy("rec").agg(F.min_by("ord", F.struct("s", "ord")).alias("ord"))


_BEST = "JOIN b USING (pair) WHERE least(e, e2) > greatest(s, s2)"
_SHIFT = f"""{DET}, {PAIRS}, m AS (SELECT pair, CAST(floor(s * 1000) AS BIGINT) AS s, CAST(floor(e * 1000) AS BIGINT) AS e, CAST(floor(s2 * 1000) AS BIGINT) AS s2, CAST(floor(e2 * 1000) AS BIGINT) AS e2 FROM a JOIN b USING (pair)),
x AS (SELECT *, unnest(range(greatest(-300, (s2 - e) // 600000 - 1), least(300, (e2 - s) // 600000 + 1) + 1)) AS shift FROM m WHERE s2 - e <= 180000000 AND e2 - s >= -180000000),
o AS (SELECT pair, shift, CAST(sum(least(e + shift * 600000, e2) - greatest(s + shift * 600000, s2)) AS BIGINT) / 1000.0::DOUBLE AS overlap
 FROM x WHERE least(e + shift * 600000, e2) > greatest(s + shift * 600000, s2) GROUP BY pair, shift)"""

SQL = {
    "presence_by_day": f"""WITH {DET}, {_islands('s - pm > 3600')},
k AS (SELECT rec, species, cert, unnest(range(CAST(floor(s / 86400) AS BIGINT), CAST(ceil(e / 86400) AS BIGINT))) AS bin FROM m WHERE e - s >= 1800)
SELECT rec, species, bin, round(max(cert), 6) AS max_cert, count(*) AS n FROM k GROUP BY rec, species, bin""",
    "merge_overlap_strict": f"WITH {DET}, {_islands('s >= pm', 's, e')} SELECT rec, species, CAST(floor((s) * 1000) AS BIGINT) AS s, CAST(floor((e) * 1000) AS BIGINT) AS e, pieces FROM m",
    "merge_overlap_certainty": f"WITH {DET}, {_islands('s >= pm')} SELECT rec, species, CAST(floor((s) * 1000) AS BIGINT) AS s, CAST(floor((e) * 1000) AS BIGINT) AS e, round(cert, 4) AS cert, pieces FROM m",
    "join_gaps": f"WITH {DET}, {_islands('s - pm > 3600')} SELECT rec, species, CAST(floor((s) * 1000) AS BIGINT) AS s, CAST(floor((e) * 1000) AS BIGINT) AS e, pieces FROM m",
    "join_gaps_certainty": f"WITH {DET}, {_islands('s - pm > 3600')} SELECT rec, species, CAST(floor((s) * 1000) AS BIGINT) AS s, CAST(floor((e) * 1000) AS BIGINT) AS e, round(cert, 4) AS cert, pieces FROM m",
    "delete_short": f"WITH {DET} SELECT ord, rec, species, CAST(floor((s) * 1000) AS BIGINT) AS s, CAST(floor((e) * 1000) AS BIGINT) AS e FROM det WHERE e - s >= 6000",
    "split_long": f"""WITH {DET}, n AS (SELECT *, greatest(1, CAST(ceil((e - s) / 20000.0) AS INT)) AS n FROM det),
p AS (SELECT *, CAST(unnest(range(n)) AS INT) AS piece FROM n)
SELECT ord, piece, CAST(floor((s + piece * ((e - s) / n)) * 1000) AS BIGINT) AS s, CAST(floor((s + (piece + 1) * ((e - s) / n)) * 1000) AS BIGINT) AS e FROM p""",
    "split_to_chunks": f"""WITH {DET}, c AS (SELECT *, unnest(range(CAST(floor(s / 9000) AS BIGINT), CAST(floor(e / 9000) AS BIGINT) + 1)) AS chunk FROM det),
x AS (SELECT ord, chunk, greatest(s - chunk * 9000.0, 0) AS cs, least(e - chunk * 9000.0, 9000) AS ce FROM c)
SELECT ord, chunk, round(cs, 4) AS cs, round(ce, 4) AS ce FROM x WHERE ce > cs""",
    "regular_segments": "SELECT rec, CAST(i AS DOUBLE) AS s, i + 10.0::DOUBLE AS e FROM (SELECT o_orderkey AS rec, unnest(range(0, o_orderkey % 600, 60)) AS i FROM orders)",
    "rle_presence": f"""WITH {DET}, d AS (SELECT DISTINCT rec, CAST(floor(s / 86400) AS BIGINT) AS day FROM det),
r AS (SELECT rec, day, day - row_number() OVER (PARTITION BY rec ORDER BY day) AS run FROM d)
SELECT rec, CAST(min(day) AS DOUBLE) AS s, max(day) + 1.0::DOUBLE AS e FROM r GROUP BY rec, run""",
    "active_length": """WITH f AS (SELECT user_id, CASE WHEN value >= 50 THEN 1 ELSE 0 END AS flag, sum(CASE WHEN value >= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
r AS (SELECT user_id, run, sum(flag) AS n FROM f GROUP BY user_id, run) SELECT user_id, CAST(max(n) AS DOUBLE) * 0.5 AS active FROM r GROUP BY user_id""",
    "overlap_count": f"""WITH {DET}, p AS (SELECT *, row_number() OVER (PARTITION BY rec, species ORDER BY s, ord) AS pos FROM det)
SELECT i.ord, i.rec, i.species, i.pos - 1 - coalesce((SELECT max(j.pos) FROM p j WHERE j.rec = i.rec AND j.species = i.species AND j.pos < i.pos AND j.e <= i.s), 0)
 + (SELECT coalesce(min(j.pos) FILTER (j.s >= i.e), max(j.pos) + 1) - i.pos - 1 FROM p j WHERE j.rec = i.rec AND j.species = i.species AND j.pos >= i.pos) AS overlaps FROM p i""",
    "clip_to_page": f"WITH {DET} SELECT ord, CAST(floor((greatest(s, 1704844800.0)) * 1000) AS BIGINT) AS s, CAST(floor((least(e, 1704931200.0)) * 1000) AS BIGINT) AS e FROM det WHERE e > 1704844800.0 AND s < 1704931200.0",
    "union_segments": f"""WITH {DET}, u AS (SELECT rec, species, s, e, cert = 50 AS side FROM det WHERE cert IN (50, 100)),
o AS (SELECT *, min(side) OVER (PARTITION BY rec, species) = max(side) OVER (PARTITION BY rec, species) AS alone FROM u),
w AS (SELECT *, max(e) OVER (PARTITION BY rec, species ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM o WHERE NOT alone),
g AS (SELECT *, sum(CASE WHEN pm IS NULL OR s >= pm THEN 1 ELSE 0 END) OVER (PARTITION BY rec, species ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM w)
SELECT rec, species, CAST(floor((min(s)) * 1000) AS BIGINT) AS s, CAST(floor((max(e)) * 1000) AS BIGINT) AS e FROM g GROUP BY rec, species, isl UNION ALL SELECT rec, species, CAST(floor(s * 1000) AS BIGINT), CAST(floor(e * 1000) AS BIGINT) FROM o WHERE alone""",
    "presence_absence": f"""WITH {DET}, d AS (SELECT * FROM det WHERE cert >= 90), f AS (SELECT DISTINCT rec FROM det), p AS (SELECT DISTINCT species FROM d),
t AS (SELECT rec, species, max(cert) AS cert FROM d GROUP BY rec, species)
SELECT f.rec, p.species, CASE WHEN t.cert IS NULL THEN 'No' ELSE 'Yes' END AS present, coalesce(t.cert, 0) AS max_cert FROM f CROSS JOIN p LEFT JOIN t ON t.rec = f.rec AND t.species = p.species""",
    "certainty_overview": f"""WITH {DET}, b AS (SELECT rec, cert, unnest(range(CAST(floor(s / 86400) AS BIGINT), CAST(floor(e / 86400) AS BIGINT) + 1)) AS bin FROM det)
SELECT rec, bin, count(*) FILTER (cert = 0) AS unsure, count(*) FILTER (cert = 100) AS certain, count(*) FILTER (cert > 0 AND cert < 100) AS possible,
CASE WHEN count(*) FILTER (cert = 0) > 0 THEN 'red' WHEN count(*) FILTER (cert > 0 AND cert < 100) > 0 THEN 'yellow' ELSE 'green' END AS colour FROM b GROUP BY rec, bin""",
    "file_status": f"""WITH {DET}, l AS (SELECT rec, min(cert) AS least FROM det WHERE species = 'error' GROUP BY rec)
SELECT rec, CASE WHEN least IS NULL THEN -1 WHEN least = 0 THEN 0 WHEN least < 100 THEN 1 ELSE 2 END AS status FROM (SELECT DISTINCT rec FROM det) LEFT JOIN l USING (rec)""",
    "discretise_presence": f"""WITH {DET}, h AS (SELECT DISTINCT rec, unnest(range(CAST(floor((s - 1704067200) / 3600) AS BIGINT), CAST(ceil((e - 1704067200) / 3600) AS BIGINT))) AS bin FROM det WHERE species = 'purchase'),
sp AS (SELECT rec, unnest(range(CAST(ceil((max(e) - 1704067200) / 3600) AS BIGINT))) AS bin FROM det GROUP BY rec)
SELECT sp.rec, sp.bin, CASE WHEN h.rec IS NULL THEN 0 ELSE 1 END AS present FROM sp LEFT JOIN h ON h.rec = sp.rec AND h.bin = sp.bin""",
    "segment_summary": f"WITH {DET} SELECT rec, round(min(e - s), 4) AS shortest, round(max(e - s), 4) AS longest, round(median(e - s), 4) AS median, round(avg(e - s), 4) AS mean, count(*) AS n FROM det GROUP BY rec",
    "frequency_range": """WITH g AS (SELECT l_returnflag, l_linestatus, min(l_quantity) AS f1, median(l_extendedprice) AS mid, avg(l_extendedprice) AS mean FROM lineitem GROUP BY ALL),
c AS (SELECT *, CASE WHEN 64000 < 2 * mid + 50 THEN 31950.0::DOUBLE ELSE mid END AS cut FROM g)
SELECT l_returnflag, l_linestatus, round(f1, 4) AS f1, round(CASE WHEN cut < f1 THEN mean ELSE cut END, 4) AS f2 FROM c""",
    "survey_rollup": f"""WITH {DET}, d AS (SELECT *, CAST(floor(s / 86400) AS BIGINT) AS day FROM det)
SELECT rec, day, count(*) AS n, count(*) FILTER (cert < 100) AS to_review, count(DISTINCT species) AS kinds FROM d GROUP BY ROLLUP (rec, day)""",
    "calltype_counts": f"WITH {DET} SELECT species, cert, count(*) AS n FROM det GROUP BY species, cert",
    "day_window": "SELECT event_id FROM events WHERE hour(ts) * 3600 + minute(ts) * 60 + second(ts) BETWEEN 28800 AND 61200",
    "day_window_wrap": "SELECT event_id FROM events WHERE hour(ts) * 3600 + minute(ts) * 60 + second(ts) >= 61200 OR hour(ts) * 3600 + minute(ts) * 60 + second(ts) <= 28800",
    "overlap_seconds": f"WITH {DET}, {PAIRS} SELECT pair, round(sum(least(e + 300, e2) - greatest(s + 300, s2)), 4) AS overlap FROM a JOIN b USING (pair) WHERE least(e + 300, e2) > greatest(s + 300, s2) GROUP BY pair",
    "shift_overlaps": f"WITH {_SHIFT} SELECT pair, CAST(shift AS INT) AS shift, round(overlap, 4) AS overlap FROM o",
    "best_shift": f"WITH {_SHIFT} SELECT pair, CAST(shift AS INT) AS shift, round(overlap, 4) AS overlap FROM o QUALIFY row_number() OVER (PARTITION BY pair ORDER BY round(overlap, 6) DESC, shift) = 1",
    "best_match": f"WITH {DET}, {PAIRS} SELECT ord, ord2, round(least(e, e2) - greatest(s, s2), 4) AS overlap FROM a {_BEST} QUALIFY row_number() OVER (PARTITION BY ord ORDER BY least(e, e2) - greatest(s, s2) DESC, ord2) = 1",
    "noise_segments": f"WITH {DET} SELECT ord, rec FROM det a WHERE species = 'view' AND NOT EXISTS (SELECT 1 FROM det b WHERE b.species = 'purchase' AND b.rec = a.rec AND a.s <= b.e AND a.e >= b.s)",
    "unannotated_hours": f"""WITH {DET}, h AS (SELECT rec, unnest(range(720)) AS t FROM (SELECT DISTINCT rec FROM det)),
f AS (SELECT rec, t FROM h WHERE NOT EXISTS (SELECT 1 FROM det b WHERE b.rec = h.rec AND (b.s - 1704067200) / 3600 <= h.t + 1 AND (b.e - 1704067200) / 3600 >= h.t)),
r AS (SELECT rec, t, t - row_number() OVER (PARTITION BY rec ORDER BY t) AS run FROM f)
SELECT rec, CAST(min(t) AS DOUBLE) AS s, max(t) + 1.0::DOUBLE AS e, count(*) AS pieces FROM r GROUP BY rec, run""",
    "annotation_diff": f"WITH {DET} SELECT species, rec FROM det WHERE cert >= 50 EXCEPT ALL SELECT species, rec FROM det WHERE cert <> 50",
    "next_annotation": f"WITH {DET} SELECT rec, ord FROM det WHERE s > 1704844800.0 AND cert < 100 QUALIFY row_number() OVER (PARTITION BY rec ORDER BY s, ord) = 1",
}
QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}
