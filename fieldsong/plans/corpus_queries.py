"""Queries on collections of recordings, cleaning and node tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsong.functions import nodes as node_functions
from fieldsong.operators import cleaning, corpus, intervals, labels, signal, wavelets, wind
from fieldsong.plans.adapters import DET, LABELLED, SPECTRA, detections, labelled, spectra, table
from fieldsong.plans.signal_queries import HOP, _frames, _signals

FS = 16000


def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certain purchases of each recorder, with those that have none."""
    det = detections(spark, sf_dir)
    return corpus.segment_counts(det, det.where("species = 'purchase' and cert = 100"), ["rec"])


def typical_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.typical_lengths(detections(spark, sf_dir), ["species", "cert"]).withColumn("median", F.round("median", 4))


def new_regular_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A minute in five of each order's duration, where no minute of every quarter of an hour is."""
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec"), F.pmod("o_orderkey", F.lit(3600)).cast("double").alias("duration"))
    return corpus.new_segments(intervals.regular_segments(files, 60.0, 300.0), intervals.regular_segments(files, 60.0, 900.0), ["rec"]).select("rec", "s", "e")


def protocol_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec"), F.pmod("o_orderkey", F.lit(3)).cast("int").alias("page"), F.pmod("o_orderkey", F.lit(900)).cast("double").alias("duration"))
    return corpus.protocol_marks(pages, 20.0, 120.0, 10.0).select("rec", "page", "s", "e")


def windowed_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of eight bins, four apart, whose mean energy is high, and the seconds that they touch if one starts every half."""
    e = spectra(spark, sf_dir).withColumn("energy", F.col("x") * F.col("x"))
    windows = corpus.windows_over(e, ["vec_id"], "k", "energy", 8, 4, 0.02)
    return corpus.windows_to_seconds(windows, ["vec_id"], 0.5, F.lit(8.0))


def best_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each label the ten bins, as nodes, of the largest mean, in the band from 500 to 6000 Hz."""
    r = spectra(spark, sf_dir).where("k < 62").groupBy("label", F.col("k").alias("node")).agg(F.round(F.avg("x"), 9).alias("r"))
    bands = spark.range(62).select(F.col("id").cast("int").alias("node"), (F.col("id") * 120.0).alias("f_lo"), (F.col("id") * 120.0 + 120).alias("f_hi"))
    return corpus.best_nodes(r, ["label"], bands, 500.0, 6000.0)


def node_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each part's size and its double, without negative ones, in trees over twice and half the rate."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size"), F.col("p_size") + 1, F.col("p_size") * 2).alias("nodes"), F.array(F.col("p_size"), F.lit(7)).alias("negative"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return p.select("p_partkey", text(corpus.without_negative(F.col("nodes"), F.col("negative"))).alias("kept"), text(corpus.renumbered(F.col("nodes"), True)).alias("up"), text(corpus.renumbered(F.col("nodes"), False)).alias("down"))


def picture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(corpus.y_of(F.col("p_retailprice"), 100.0, 1500.0, 128), 6).alias("y"))


def signal_to_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.signal_to_noise(spectra(spark, sf_dir), ["vec_id"], "k", "x", 0, 32, 16).withColumn("snr", F.round("snr", 6))


def autocovariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spectra(spark, sf_dir)
    return corpus.lagged_products(x, x, ["vec_id"], "k", "x", 4).withColumn("cov", F.round("cov", 9))


def lags_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag at which each vector and the one after it agree best."""
    x = spectra(spark, sf_dir)
    return corpus.best_lag(corpus.lagged_products(x, x.withColumn("vec_id", F.col("vec_id") - 1), ["vec_id"], "k", "x", 8), ["vec_id"])


def spectral_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roll-off of each spectrum's magnitudes, and the contrast of its four bands."""
    a = spectra(spark, sf_dir).select("vec_id", "k", F.abs("x").alias("m"))
    bands = corpus.contrast(a, ["vec_id"], F.floor(F.col("k") / 16).cast("int"), "k", "m").withColumn("contrast", F.round("contrast", 6))
    return bands.join(corpus.rolloff(a, ["vec_id"], "k", "m"), "vec_id")


def noisy_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spectra(spark, sf_dir)
    noise = x.where("vec_id = 0").select("k", F.col("x").alias("noise"))
    return corpus.with_noise(x.select("vec_id", "k", "x"), noise, ["vec_id"], "k", "x").withColumn("x", F.round("x", 9))


def one_hot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(corpus.one_hot(F.col("label"), 10).cast("array<string>"), "").alias("classes"))


def cluster_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call types by the kind of certainty; uncertain detections were deleted, purchases are in no cluster."""
    det = detections(spark, sf_dir).select("ord", "rec", "species").withColumn("calltype", F.lit("none"))
    chosen = detections(spark, sf_dir).where("species != 'purchase'").select("ord", F.when(F.col("cert") > 0, F.concat(F.lit("c"), F.col("cert").cast("string"))).alias("cluster"))
    return corpus.applied_clusters(det, chosen, "ord")


def clusters_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of odd ids of label 2 go to 5, label 4 is deleted, 7 goes to a new one; ids are compact again."""
    c = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("cluster"))
    moved = F.when(F.col("cluster") == 2, 5).when(F.col("cluster") == 7, 11)
    chosen = ((F.col("cluster") == 2) & (F.col("vec_id") % 2 == 1)) | F.col("cluster").isin(4, 7)
    return corpus.moved_to(c, chosen, moved)


def free_cluster_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("Cluster_"), (F.col("p_size") - 1).cast("string")).alias("name"))
    return corpus.free_name(names)


def recogniser_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as subfilters: a brand's are of one species."""
    f = table(spark, sf_dir, "part").select(F.col("p_brand").alias("species"), F.col("p_type").alias("calltype"), F.array(F.col("p_size"), F.col("p_size") + 3).alias("time_range"), F.array(F.col("p_retailprice"), F.col("p_retailprice") * 2).alias("freq_range"))
    got = corpus.recogniser_summary(f)
    return got.select("species", "least_length", "longest", F.round("least_frequency", 4).alias("least_frequency"), F.round("most_frequency", 4).alias("most_frequency"), F.array_join("calltypes", ";").alias("calltypes"))


def predicted_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", corpus.predicted_class([F.col("embedding")[k].cast("double") for k in range(3)], [0.05, 0.1, 0.15]).alias("class"))


def label_queries_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorder's day with clicks and purchases read as the two bats, and certain labels as calls that are passes, half certain ones as calls that feed."""
    bat = lambda x: F.when(x["species"] == "click", "Long-tailed bat").when(x["species"] == "purchase", "Short-tailed bat").otherwise(x["species"])
    call = lambda x: F.when(x["certainty"] == 100, "pass").when(x["certainty"] == 50, "feed")
    made = F.transform("labels", lambda x: F.struct(bat(x).alias("species"), x["certainty"].alias("certainty"), call(x).alias("calltype"), x["filter"].alias("filter")))
    lab = labelled(spark, sf_dir).withColumn("labels", made)
    keys = F.array_join(F.transform(labels.keys_with_calltypes(F.col("labels")), lambda x: F.concat_ws(":", x["species"], x["calltype"])), ";")
    return lab.select(
        "rec", "day", F.coalesce(labels.has_calltype(F.col("labels"), "Long-tailed bat", "pass"), F.lit(False)).alias("typed"), labels.calltype_of(F.col("labels"), "Long-tailed bat").alias("calltype"),
        keys.alias("keys"), labels.bat_category(F.col("labels")).alias("category"),
    )


def paged_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 24 bins that overlap by 4, with the seconds of each bin's value as a column, and the column of an eleventh of a second a bin."""
    from fieldsong.functions import units

    paged = intervals.frame_pages(spectra(spark, sf_dir).select("vec_id", "k", "x"), "k", 24, 4)
    return paged.select("vec_id", "k", "page", F.round(units.to_seconds(F.col("k") + F.col("x"), FS, HOP), 8).alias("t"), F.round(units.to_column(F.col("k") / 11, FS, HOP), 6).alias("col"))


def butterworth_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean squares of each recording's band from 1 to 4 kHz, both ways and one way."""
    return cleaning.butterworth_levels(_signals(spark, sf_dir), 1000.0, 4000.0).drop("page")


def impulses_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cleaning.impulses_masked(_signals(spark, sf_dir), percentile=70.0, share=0.4)
    return got.select("file_id", F.size(F.filter("samples", lambda x: x == 0)).alias("silent"))


def envelope_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.envelope_segments(_frames(spark, sf_dir), 0.025, 0.5)


def syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.syllable_segments(_frames(spark, sf_dir), HOP / FS, 0.5, 0.2, 0.001, 3)


def pitch_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loud stretches whose pitch is from 8 to 100 Hz, the recordings read at 1280 Hz."""
    slow = _signals(spark, sf_dir).withColumn("fs", F.lit(1280))
    found = cleaning.envelope_segments(_frames(spark, sf_dir), HOP / 1280, 0.5).select("file_id", "s", "e")
    return cleaning.in_pitch_range(found, signal.pitch(slow, 128, 0.9), 8.0, 100.0, 4.0)


def predicted_wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wind under two leaves of a tree of five levels, by the others' energies."""
    energies = wavelets.node_energies(_signals(spark, sf_dir), [0, *range(31, 63)], 0.004, wavelets.daubechies(2))
    return wind.predicted(energies, node_functions.node_bands(spark, 5, FS), [36, 41])


_A = "a AS (SELECT vec_id, k, x - avg(x) OVER (PARTITION BY vec_id) AS v, count(*) OVER (PARTITION BY vec_id) AS n FROM sp)"
SQL = {
    "segment_counts": f"WITH {DET} SELECT rec, count(*) FILTER (species = 'purchase' AND cert = 100) AS n FROM det GROUP BY rec",
    "typical_lengths": f"WITH {DET} SELECT species, cert, count(*) AS n, round(median(e - s), 4) AS median FROM det GROUP BY species, cert",
    "new_regular_segments": "SELECT o_orderkey AS rec, CAST(i AS DOUBLE) AS s, i + 60.0::DOUBLE AS e FROM (SELECT o_orderkey, unnest(range(0, o_orderkey % 3600, 300)) AS i FROM orders) WHERE i % 900 <> 0",
    "protocol_marks": """WITH p AS (SELECT o_orderkey AS rec, CAST(o_orderkey % 3 AS INT) AS page, o_orderkey % 900 AS d, CASE WHEN o_orderkey % 3 > 0 THEN 10 ELSE 0 END AS f FROM orders),
m AS (SELECT *, unnest(range(f, d, 120)) AS i FROM p) SELECT rec, page, CAST(i AS DOUBLE) AS s, CAST(least(d, i + 20) AS DOUBLE) AS e FROM m""",
    "windowed_presence": f"""WITH {SPECTRA}, w AS (SELECT vec_id, win, avg(x * x) AS m FROM sp, (SELECT unnest(range(16)) AS win) WHERE k >= win * 4 AND k < win * 4 + 8 GROUP BY vec_id, win)
SELECT DISTINCT vec_id, unnest(range(CAST(floor(win * 0.5) AS BIGINT), least(CAST(ceil(win * 0.5 + 1) AS BIGINT), 8))) AS t FROM w WHERE m > 0.02""",
    "best_nodes": f"""WITH {SPECTRA}, r AS (SELECT label, CAST(k AS INT) AS node, round(avg(x), 9) AS r FROM sp WHERE k < 62 GROUP BY label, k),
b AS (SELECT label, node, row_number() OVER (PARTITION BY label ORDER BY r DESC, node) AS rank FROM r WHERE node >= 14 AND node * 120.0 < 6000 AND node * 120.0 + 120 > 500)
SELECT label, node, CAST(row_number() OVER (PARTITION BY label ORDER BY floor(log2(node + 2)) DESC, rank) AS INT) AS nth FROM b WHERE rank <= 10""",
    "node_lists": """WITH p AS (SELECT p_partkey, p_size, unnest([p_size, p_size + 1, p_size * 2]) AS n, unnest([1, 2, 3]) AS i FROM part),
l AS (SELECT *, CAST(floor(log2(n + 1)) AS INT) AS lv, n + 1 - (1 << CAST(floor(log2(n + 1)) AS INT)) AS pos FROM p),
g AS (SELECT p_partkey, string_agg(CAST(n AS VARCHAR), ',' ORDER BY i) AS every, string_agg(CAST(n AS VARCHAR), ',' ORDER BY i) FILTER (n <> p_size AND n <> 7 AND NOT (i = 3 AND n = p_size + 1)) AS kept,
 string_agg(CAST((2 << lv) - 1 + pos AS VARCHAR), ',' ORDER BY i) AS up, string_agg(CAST((1 << (lv - 1)) - 1 + pos AS VARCHAR), ',' ORDER BY i) FILTER (n > 0 AND pos * 2 < (1 << lv)) AS down FROM l GROUP BY p_partkey)
SELECT p_partkey, coalesce(kept, every) AS kept, up, coalesce(down, '') AS down FROM g""",
    "picture_rows": "SELECT p_partkey, round(CASE WHEN p_retailprice > 1500 THEN -100.0 ELSE (p_retailprice - 100) * 128 / 1400.0 END, 6) AS y FROM part",
    "signal_to_noise": f"WITH {SPECTRA} SELECT vec_id, round(10 * log10(avg(x * x) FILTER (k < 16) / avg(x * x) FILTER (k >= 32 AND k < 48)), 6) AS snr FROM sp GROUP BY vec_id",
    "autocovariances": f"""WITH {SPECTRA}, {_A} SELECT a.vec_id, CAST(b.k - a.k AS INT) AS lag, round(sum(a.v * b.v) / max(a.n), 9) AS cov FROM a JOIN a b ON a.vec_id = b.vec_id AND abs(a.k - b.k) <= 4 GROUP BY a.vec_id, b.k - a.k""",
    "lags_between": f"""WITH {SPECTRA}, {_A}, c AS (SELECT a.vec_id, CAST(b.k - a.k AS INT) AS lag, sum(a.v * b.v) / max(a.n) AS cov FROM a JOIN a b ON a.vec_id + 1 = b.vec_id AND abs(a.k - b.k) <= 8 GROUP BY a.vec_id, b.k - a.k)
SELECT vec_id, lag FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(cov, 9) DESC, abs(lag), lag) = 1""",
    "spectral_shape": f"""WITH {SPECTRA}, m AS (SELECT vec_id, k, CAST(k // 16 AS INT) AS band, abs(x) AS m FROM sp),
u AS (SELECT *, row_number() OVER (PARTITION BY vec_id, band ORDER BY m, k) AS up, count(*) OVER (PARTITION BY vec_id, band) AS n, sum(m) OVER (PARTITION BY vec_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto, sum(m) OVER (PARTITION BY vec_id) AS total FROM m),
c AS (SELECT vec_id, band, round(10 * log10((avg(m) FILTER (up > n - floor(n * 0.25)) + 1e-10) / (avg(m) FILTER (up <= floor(n * 0.25)) + 1e-10)), 6) AS contrast FROM u GROUP BY vec_id, band)
SELECT vec_id, band, contrast, bin FROM c JOIN (SELECT vec_id, CAST(min(k) AS INT) AS bin FROM u WHERE upto >= 0.85 * total GROUP BY vec_id) USING (vec_id)""",
    "noisy_spectra": f"""WITH {SPECTRA}, z AS (SELECT k, x AS noise FROM sp WHERE vec_id = 0)
SELECT vec_id, CAST(k AS INT) AS k, round(x + (0.2 + 0.6 * (CAST(('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0)) * noise, 9) AS x FROM sp JOIN z USING (k)""",
    "one_hot_labels": "SELECT vec_id, repeat('0', CAST(label AS INT)) || '1' || repeat('0', CAST(9 - label AS INT)) AS classes FROM embeddings",
    "cluster_names": f"WITH {DET} SELECT ord, rec, species, CASE WHEN species = 'purchase' THEN 'none' ELSE 'c' || cert END AS calltype FROM det WHERE species = 'purchase' OR cert > 0",
    "clusters_edited": """WITH m AS (SELECT vec_id, CASE WHEN label = 2 AND vec_id % 2 = 1 THEN 5 WHEN label = 7 THEN 11 ELSE label END AS c FROM embeddings WHERE label <> 4)
SELECT vec_id, CAST(dense_rank() OVER (ORDER BY c) - 1 AS INT) AS cluster FROM m""",
    "free_cluster_name": "SELECT 'Cluster_' || min(i) AS name FROM (SELECT unnest(range(1000)) AS i) WHERE i NOT IN (SELECT p_size - 1 FROM part)",
    "recogniser_summary": "SELECT p_brand AS species, min(p_size) AS least_length, max(p_size + 3) AS longest, round(min(p_retailprice), 4) AS least_frequency, round(max(p_retailprice * 2), 4) AS most_frequency, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS calltypes FROM part GROUP BY p_brand",
    "predicted_classes": """WITH s AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings)
SELECT vec_id, CAST(CASE WHEN a >= greatest(b, c) THEN (CASE WHEN a >= 0.05 THEN 0 ELSE -1 END) WHEN b >= c THEN (CASE WHEN b >= 0.1 THEN 1 ELSE -1 END) ELSE (CASE WHEN c >= 0.15 THEN 2 ELSE -1 END) END AS INT) AS class FROM s""",
    "label_queries_of_day": f"""WITH {LABELLED}, x AS (SELECT rec, day, CASE x.species WHEN 'click' THEN 'Long-tailed bat' WHEN 'purchase' THEN 'Short-tailed bat' ELSE x.species END AS species, x.certainty AS c,
  CASE x.certainty WHEN 100 THEN 'pass' WHEN 50 THEN 'feed' END AS call, x.species AS old FROM (SELECT rec, day, unnest(labels) AS x FROM lab))
SELECT rec, day, coalesce(bool_or(species = 'Long-tailed bat' AND call = 'pass'), false) AS typed, max(call) FILTER (species = 'Long-tailed bat') AS calltype, string_agg(concat_ws(':', species, call), ';' ORDER BY old) AS keys,
  CASE WHEN bool_or(species = 'Long-tailed bat' AND c = 100) AND bool_or(species = 'Short-tailed bat' AND c = 100) THEN 'Both' WHEN bool_or(species = 'Long-tailed bat' AND c = 100) THEN 'Long Tail'
  WHEN bool_or(species = 'Short-tailed bat' AND c = 100) THEN 'Short Tail' WHEN bool_or(species IN ('Long-tailed bat', 'Short-tailed bat')) THEN 'Possible' ELSE 'Non-bat' END AS category FROM x GROUP BY rec, day""",
    "paged_samples": f"""WITH {SPECTRA}, p AS (SELECT *, k // 24 AS page FROM sp UNION ALL SELECT *, k // 24 + 1 FROM sp WHERE k % 24 >= 20)
SELECT vec_id, CAST(k AS INT) AS k, page, round((k + x) * 32 / 16000.0::DOUBLE, 8) AS t, round(k / 11.0::DOUBLE * 16000 / 32, 6) AS col FROM p""",
}
QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}
