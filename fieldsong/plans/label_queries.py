"""Queries on labels, evaluation and spectra, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldsong.functions import nodes, units
from fieldsong.operators import evaluate, labels, wavelets
from fieldsong.plans.adapters import DET, LABELLED, SPECTRA, detections, labelled, spectra, table


def _texts(df: DataFrame) -> DataFrame:
    """Labels as text, alike in both engines."""
    one = lambda x: F.concat(x["species"], F.lit(":"), x["certainty"].cast("int").cast("string"))
    return df.select("rec", "day", F.array_join(F.transform("labels", one), ",").alias("labels"))


def species_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).where(labels.has_species(F.col("labels"), "purchase")).select("rec", "day")


def review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("rec", "day", labels.needs_review(F.col("labels"), 50).alias("review"))


def label_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(labelled(spark, sf_dir).withColumn("labels", labels.confirm(F.col("labels"), "view")))


def label_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(labelled(spark, sf_dir).withColumn("labels", labels.question(F.col("labels"))))


def label_wipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(labelled(spark, sf_dir).withColumn("labels", labels.wipe(F.col("labels"), "click")).where(F.size("labels") > 0))


def label_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(labelled(spark, sf_dir).withColumn("labels", labels.remove(F.col("labels"), "click")))


def label_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(labelled(spark, sf_dir).withColumn("labels", labels.rename(F.col("labels"), "error", "fault")))


def label_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(labelled(spark, sf_dir).withColumn("labels", labels.add_label(F.col("labels"), "signup", 50.0)))


def label_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewers' verdicts on views: by day, green, yellow, red or none."""
    colour = F.element_at(F.array(*map(F.lit, ("green", "yellow", "red", "none"))), (F.pmod("day", F.lit(4)) + 1).cast("int"))
    return _texts(labelled(spark, sf_dir).withColumn("labels", labels.verdict(F.col("labels"), "view", colour)))


def label_certain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).where(labels.all_certain(F.col("labels"), "view")).select("rec", "day")


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose labels a verdict changes."""
    df = labelled(spark, sf_dir)
    return df.where(labels.changed(F.col("labels"), labels.question(F.col("labels")))).select("rec", "day")


def merge_identical_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days in a row with the same species, as one."""
    df = labelled(spark, sf_dir).select("rec", "day", F.array_join(labels.keys(F.col("labels")), ",").alias("names"))
    run = df.withColumn("run", F.col("day") - F.row_number().over(Window.partitionBy("rec", "names").orderBy("day")))
    return run.groupBy("rec", "names", "run").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day")).drop("run")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, truth = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return truth.join(docs.select("doc_id", "source", "n_chars"), "doc_id").select("source", (F.col("quality") == 1).alias("truth"), F.least(F.col("n_chars") / 10000.0, F.lit(1.0)).alias("score"))


def confusion_fbeta(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluate.confusion(_scored(spark, sf_dir), ["source"], F.col("truth"), F.col("score") >= 0.1)
    return got.withColumns({c: F.round(c, 6) for c in ("recall", "precision", "fbeta")})


GRID = [k / 20 for k in range(1, 20)]


def threshold_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluate.threshold_counts(_scored(spark, sf_dir), ["source"], F.col("truth"), F.col("score"), GRID)
    return got.withColumns({c: F.round(c, 6) for c in ("tpr", "fpr")})


def network_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.network_thresholds(threshold_roc(spark, sf_dir), ["source"])


def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.majority(table(spark, sf_dir, "events"), ["user_id"], "event_type")


def cluster_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("found", F.floor("value").cast("int") % 5)
    return evaluate.cluster_agreement(ev, "event_type", "found").select(*[F.round(c, 6).alias(c) for c in ("homogeneity", "completeness", "v_measure", "adjusted_rand")])


def point_biserial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.point_biserial(spectra(spark, sf_dir), ["k"], "x", F.col("label") == 1).select("k", F.round("r", 6).alias("r"))


def top_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 bins that go with label 1 most."""
    r = point_biserial(spark, sf_dir)
    return r.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("r")), "k"))).where("rank <= 15")  # one row a bin


def level_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bin's share, in percent, of the energy of its level; levels are bins 0, 1-2, 3-6 and so on."""
    e = spectra(spark, sf_dir).select(F.col("vec_id").alias("file_id"), F.lit(0).alias("page"), F.col("k").alias("node"), F.lit(0).alias("win"), (F.col("x") * F.col("x")).alias("energy"))
    return wavelets.level_shares(e).select(F.col("file_id").alias("vec_id"), F.col("node").alias("k"), "level", F.round("share", 6).alias("share"))


def window_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = spectra(spark, sf_dir)
    return sp.groupBy("vec_id", F.floor(F.col("k") / 7).cast("int").alias("win")).agg(F.round(F.avg(F.col("x") * F.col("x")), 8).alias("energy"))


def energy_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the bins from five before to five after, over ten; bins nearer to an end have none."""
    near = Window.partitionBy("vec_id").orderBy("k").rowsBetween(-5, 5)
    n = F.count(F.lit(1)).over(Window.partitionBy("vec_id"))
    sp = spectra(spark, sf_dir).withColumn("curve", F.sum("x").over(near) / 10).withColumn("n", n)
    return sp.where((F.col("k") >= 5) & (F.col("k") < F.col("n") - 5)).select("vec_id", "k", F.round("curve", 6).alias("curve"))


def quiet_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tenth of each label's frames that has the least energy, rounded half to even."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 9).alias("energy"))
    by = Window.partitionBy("label")
    ranked = e.withColumn("nth", F.row_number().over(by.orderBy("energy", "vec_id"))).withColumn("n", F.count(F.lit(1)).over(by))
    return ranked.where(F.col("nth") <= F.bround(F.col("n") * 0.1)).select("label", "vec_id")


def bat_file_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select((F.floor(F.col("vec_id") / 3)).cast("long").alias("file"), F.abs(F.col("embedding")[0].cast("double") * 4).alias("l"), F.abs(F.col("embedding")[1].cast("double") * 4).alias("s"))
    got = evaluate.bat_label(e, ["file"], F.least("l", F.lit(1.0)), F.least("s", F.lit(1.0)), 30.0, 50.0)
    return got.withColumns({c: F.round(c, 4) for c in ("l_mean", "s_mean", "l_best", "s_best")})


def wiener_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.abs("x") + 1e-9
    return spectra(spark, sf_dir).groupBy("vec_id").agg(F.round(F.avg(F.ln(x)) - F.ln(F.avg(x)), 6).alias("entropy"))


def shannon_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("x") * F.col("x")
    return spectra(spark, sf_dir).where("x != 0").groupBy("vec_id").agg(F.round(F.sum(-e * F.ln(e)), 6).alias("entropy"))


def robust_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins at which a spectrum's energy, summed up, reaches 5, 25, 50, 75 and 95 percent."""
    e = spectra(spark, sf_dir).withColumn("energy", F.col("x") * F.col("x"))
    upto = F.sum("energy").over(Window.partitionBy("vec_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("energy").over(Window.partitionBy("vec_id"))
    e = e.withColumn("upto", F.round(upto, 9))
    return e.groupBy("vec_id").agg(*[F.min(F.when(F.col("upto") >= p / 100, F.col("k"))).alias(f"q{p}") for p in (5, 25, 50, 75, 95)])


def loudest_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra(spark, sf_dir).groupBy("vec_id").agg(F.min_by("k", F.struct(-F.abs("x"), "k")).alias("k"))


def frame_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of a spectrum: centroid, bandwidth, flatness of its energies, and zero crossings of its elements."""
    sp = spectra(spark, sf_dir).withColumn("p", F.col("x") * F.col("x") + 1e-12).withColumn("was", F.lag("x").over(Window.partitionBy("vec_id").orderBy("k")))
    m = F.sum(F.col("k") * F.col("p")) / F.sum("p")
    agg = sp.groupBy("vec_id").agg(m.alias("centroid"), (F.sum(F.col("k") * F.col("k") * F.col("p")) / F.sum("p")).alias("second"), (F.exp(F.avg(F.ln("p"))) / F.avg("p")).alias("flatness"), F.count_if((F.col("was") < 0) != (F.col("x") < 0)).alias("crossings"))
    return agg.select("vec_id", F.round("centroid", 5).alias("centroid"), F.round(F.sqrt(F.col("second") - F.col("centroid") * F.col("centroid")), 5).alias("bandwidth"), F.round("flatness", 5).alias("flatness"), "crossings")


def mel_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    hz = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(units.hz_to_mel(hz), 6).alias("mel"), F.round(units.mel_to_hz(units.hz_to_mel(hz)), 6).alias("hz"))


def bark_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    hz = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(units.hz_to_bark(hz), 6).alias("bark"), F.round(units.bark_to_hz(units.hz_to_bark(hz)), 6).alias("hz"))


def mel_bands(spark: SparkSession, count: int, bins: int, top: float) -> DataFrame:
    """k, band, weight: triangles evenly spaced in mel over bins from 0 to top Hz, each of unit area."""
    edge = lambda n: units.mel_to_hz(F.lit(0.0) + n * units.hz_to_mel(F.lit(top)) / (count + 1))
    grid = spark.range(count).select(F.col("id").cast("int").alias("band")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    f = F.col("k") * (top / (bins - 1))
    lo, mid, hi = edge(F.col("band")), edge(F.col("band") + 1), edge(F.col("band") + 2)
    weight = F.when((f >= lo) & (f <= mid), (f - lo) / (mid - lo)).when((f > mid) & (f <= hi), (hi - f) / (hi - mid)).otherwise(0.0)
    grid = grid.withColumn("raw", weight)
    area = F.sum("raw").over(Window.partitionBy("band"))
    return grid.select("k", "band", F.when(area == 0, 0.0).otherwise(F.col("raw") / area).alias("weight"))


def filterbank_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as spectra of 64 bins up to 8 kHz through 12 mel bands."""
    bank = F.broadcast(mel_bands(spark, 12, 64, 8000.0).where("weight > 0"))  # 12 x 64 rows at most
    return spectra(spark, sf_dir).join(bank, "k").groupBy("vec_id", "band").agg(F.round(F.sum(F.abs("x") * F.col("weight")), 6).alias("y"))


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as recorders, with rates that grow with their size."""
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 200 + 8000).alias("rate"))


def node_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.bands_of(_rates(spark, sf_dir), ["p_partkey"], "rate", 5)


def nodes_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes of each recorder overlap 1000 to 2500 Hz, and their sum."""
    found = nodes.overlapping(node_bands(spark, sf_dir), 1000.0, 2500.0)
    return found.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum("node").alias("nodes"))


def random_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty orders drawn by hash, the same each time."""
    return table(spark, sf_dir, "orders").select("o_orderkey").orderBy(F.md5(F.col("o_orderkey").cast("string")), "o_orderkey").limit(50)


def _listed(body: str) -> str:
    return f"WITH {LABELLED} SELECT rec, day, array_to_string(list_transform({body}, lambda x: x.species || ':' || CAST(CAST(x.certainty AS INT) AS VARCHAR)), ',') AS labels FROM lab"


_SET = "lambda x: CASE WHEN {cond} THEN {{'species': x.species, 'certainty': {to}}} ELSE x END"
_CONFIRM = "list_transform(labels, " + _SET.format(cond="x.species = 'view' AND x.certainty < 100", to="100.0::DOUBLE") + ")"
_QUESTION = "list_transform(labels, " + _SET.format(cond="{who}x.certainty = 100", to="50.0::DOUBLE") + ")"
_DONT = "[{'species': 'Don''t Know', 'certainty': 0.0::DOUBLE}]"
_REMOVE = "CASE WHEN len(list_filter(labels, lambda x: x.species <> '{0}')) = 0 THEN " + _DONT + " ELSE list_filter(labels, lambda x: x.species <> '{0}') END"
_Q_ALL, _Q_VIEW = _QUESTION.replace("{who}", ""), _QUESTION.replace("{who}", "x.species = 'view' AND ")
_REMOVED = lambda name: _REMOVE.replace("{0}", name)
_SCORED = "sc AS (SELECT source, quality = 1 AS truth, least(n_chars / 10000.0::DOUBLE, 1.0) AS score FROM labels JOIN documents USING (doc_id))"
_ROC = f"""{_SCORED}, th AS (SELECT unnest(range(1, 20)) / 20.0::DOUBLE AS threshold),
roc AS (SELECT source, threshold, count(*) FILTER (truth AND score >= threshold) AS tp, count(*) FILTER (NOT truth AND score >= threshold) AS fp,
count(*) FILTER (NOT truth AND score < threshold) AS tn, count(*) FILTER (truth AND score < threshold) AS fn FROM sc CROSS JOIN th GROUP BY source, threshold),
r AS (SELECT *, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS tpr, round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS fpr FROM roc)"""
_BISERIAL = f"""{SPECTRA}, bi AS (SELECT k, avg(x) FILTER (label = 1) AS m1, avg(x) FILTER (label <> 1) AS m0, stddev_pop(x) AS sd, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label <> 1) AS n0 FROM sp GROUP BY k),
pb AS (SELECT CAST(k AS INT) AS k, round(coalesce((m1 - m0) / nullif(sd, 0) * sqrt(n0 * n1) / (n0 + n1), 0), 6) AS r FROM bi)"""
_BANDS = """nd AS (SELECT CAST(node AS INT) AS node, CAST(floor(log2(node + 1)) AS INT) AS level FROM (SELECT unnest(range(63)) AS node)),
p0 AS (SELECT *, node + 1 - (1 << level) AS p FROM nd), p1 AS (SELECT *, xor(p, p >> 1) AS a FROM p0), p2 AS (SELECT *, xor(a, a >> 2) AS b FROM p1), p3 AS (SELECT *, xor(b, b >> 4) AS c FROM p2),
nb AS (SELECT p_partkey, node, level, c / (1 << level) * 0.5::DOUBLE * (p_size * 200 + 8000) AS f_lo, (c + 1) / (1 << level) * 0.5::DOUBLE * (p_size * 200 + 8000) AS f_hi FROM p3 CROSS JOIN part)"""
_MEL = "(700 * (exp(({0}) * (1125 * ln(1 + 8000.0::DOUBLE / 700)) / 13 / 1125) - 1))"

SQL = {
    "species_filter": f"WITH {LABELLED} SELECT rec, day FROM lab WHERE len(list_filter(labels, lambda x: x.species = 'purchase')) > 0",
    "review_gate": f"WITH {LABELLED} SELECT rec, day, len(list_filter(labels, lambda x: x.certainty <= 50)) > 0 AS review FROM lab",
    "label_confirm": _listed(_CONFIRM),
    "label_question": _listed(_Q_ALL),
    "label_wipe": _listed("list_filter(labels, lambda x: x.species <> 'click')") + " WHERE len(list_filter(labels, lambda x: x.species <> 'click')) > 0",
    "label_remove": _listed(_REMOVED("click")),
    "label_rename": _listed("list_transform(labels, lambda x: CASE WHEN x.species = 'error' THEN {'species': 'fault', 'certainty': x.certainty} ELSE x END)"),
    "label_add": _listed("CASE WHEN len(list_filter(labels, lambda x: x.species = 'signup')) > 0 THEN labels ELSE list_concat(labels, [{'species': 'signup', 'certainty': 50.0::DOUBLE}]) END"),
    "label_verdict": _listed(f"CASE day % 4 WHEN 0 THEN {_CONFIRM} WHEN 1 THEN {_Q_VIEW} WHEN 2 THEN {_REMOVED('view')} ELSE labels END"),
    "label_certain": f"WITH {LABELLED} SELECT rec, day FROM lab WHERE len(list_filter(labels, lambda x: x.species = 'view' AND x.certainty < 100)) = 0",
    "corrections": f"WITH {LABELLED} SELECT rec, day FROM lab WHERE len(list_filter(labels, lambda x: x.certainty = 100)) > 0",
    "merge_identical_labels": f"""WITH {LABELLED}, n AS (SELECT rec, day, array_to_string(list_transform(labels, lambda x: x.species), ',') AS names FROM lab),
r AS (SELECT *, day - row_number() OVER (PARTITION BY rec, names ORDER BY day) AS run FROM n) SELECT rec, names, min(day) AS first_day, max(day) AS last_day FROM r GROUP BY rec, names, run""",
    "confusion_fbeta": f"""WITH {_SCORED}, c AS (SELECT source, count(*) FILTER (truth AND score >= 0.1) AS tp, count(*) FILTER (NOT truth AND score >= 0.1) AS fp, count(*) FILTER (NOT truth AND score < 0.1) AS tn, count(*) FILTER (truth AND score < 0.1) AS fn FROM sc GROUP BY source),
d AS (SELECT *, tp / nullif(tp + fn, 0)::DOUBLE AS recall, tp / nullif(tp + fp, 0)::DOUBLE AS precision FROM c)
SELECT source, tp, fp, tn, fn, round(recall, 6) AS recall, round(precision, 6) AS precision, round(5 * recall * precision / nullif(recall + 4 * precision, 0), 6) AS fbeta FROM d""",
    "threshold_roc": f"WITH {_ROC} SELECT * FROM r",
    "network_thresholds": f"WITH {_ROC} SELECT source, arg_min(threshold, ((1 - tpr) * (1 - tpr) + fpr * fpr, threshold)) AS lower, coalesce(min(threshold) FILTER (fpr = 0), max(threshold)) AS upper FROM r GROUP BY source",
    "majority_vote": "SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY user_id, event_type QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) = 1",
    "cluster_agreement": """WITH x AS (SELECT event_type AS t, CAST(floor(value) AS INT) % 5 AS c, count(*)::DOUBLE AS n FROM events GROUP BY ALL),
tt AS (SELECT t, sum(n) AS n FROM x GROUP BY t), cc AS (SELECT c, sum(n) AS n FROM x GROUP BY c), a AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS p, sum(n * ln(n)) AS b FROM x),
b AS (SELECT sum(n * (n - 1) / 2) AS p, sum(n * ln(n)) AS b FROM tt), d AS (SELECT sum(n * (n - 1) / 2) AS p, sum(n * ln(n)) AS b FROM cc),
m AS (SELECT (ln(a.n) + a.b / a.n - b.b / a.n - d.b / a.n) AS mi, ln(a.n) - b.b / a.n AS ht, ln(a.n) - d.b / a.n AS hc, a.p AS pairs, b.p * d.p / (a.n * (a.n - 1) / 2) AS ex, (b.p + d.p) / 2 AS mo FROM a, b, d)
SELECT round(mi / ht, 6) AS homogeneity, round(mi / hc, 6) AS completeness, round(2 * (mi / ht) * (mi / hc) / (mi / ht + mi / hc), 6) AS v_measure, round((pairs - ex) / (mo - ex), 6) AS adjusted_rand FROM m""",
    "point_biserial": f"WITH {_BISERIAL} SELECT k, r FROM pb",
    "top_nodes": f"WITH {_BISERIAL} SELECT k, r, CAST(row_number() OVER (ORDER BY abs(r) DESC, k) AS INT) AS rank FROM pb QUALIFY rank <= 15",
    "level_energies": f"WITH {SPECTRA}, l AS (SELECT vec_id, CAST(k AS INT) AS k, CAST(floor(log2(k + 1)) AS INT) AS level, x * x AS energy FROM sp) SELECT vec_id, k, level, round(100 * energy / sum(energy) OVER (PARTITION BY vec_id, level), 6) AS share FROM l",
    "window_energy": f"WITH {SPECTRA} SELECT vec_id, CAST(k // 7 AS INT) AS win, round(avg(x * x), 8) AS energy FROM sp GROUP BY vec_id, k // 7",
    "energy_curve": f"WITH {SPECTRA}, c AS (SELECT vec_id, CAST(k AS INT) AS k, sum(x) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) / 10 AS curve, count(*) OVER (PARTITION BY vec_id) AS n FROM sp) SELECT vec_id, k, round(curve, 6) AS curve FROM c WHERE k >= 5 AND k < n - 5",
    "quiet_frames": """WITH e AS (SELECT label, vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 9) AS energy FROM embeddings),
r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY energy, vec_id) AS nth, count(*) OVER (PARTITION BY label) AS n FROM e) SELECT label, vec_id FROM r WHERE nth <= round_even(n * 0.1, 0)""",
    "bat_file_label": """WITH e AS (SELECT vec_id // 3 AS file, least(abs(CAST(embedding[1] AS DOUBLE) * 4), 1.0) AS l, least(abs(CAST(embedding[2] AS DOUBLE) * 4), 1.0) AS s FROM embeddings),
f AS (SELECT file, avg(l) * 100 AS l_mean, avg(s) * 100 AS s_mean, list_sum(list_slice(list_reverse_sort(list(l)), 1, 3)) / 3 * 100 AS l_best, list_sum(list_slice(list_reverse_sort(list(s)), 1, 3)) / 3 * 100 AS s_best FROM e GROUP BY file)
SELECT file, round(l_mean, 4) AS l_mean, round(s_mean, 4) AS s_mean, round(l_best, 4) AS l_best, round(s_best, 4) AS s_best,
CASE WHEN l_mean >= 30 AND l_best >= 50 AND ((s_mean < 30 AND s_best < 50) OR (s_mean >= 30 AND s_best >= 50)) THEN 100 WHEN (l_mean >= 30 OR l_best >= 50) AND s_mean < 30 THEN 50 WHEN l_mean >= 30 AND s_mean >= 30 THEN 50 END AS long_tailed,
CASE WHEN s_mean >= 30 AND s_best >= 50 AND ((l_mean < 30 AND l_best < 50) OR (l_mean >= 30 AND l_best >= 50)) THEN 100 WHEN (s_mean >= 30 OR s_best >= 50) AND l_mean < 30 THEN 50 WHEN s_mean >= 30 AND l_mean >= 30 THEN 50 END AS short_tailed FROM f""",
    "wiener_entropy": f"WITH {SPECTRA} SELECT vec_id, round(avg(ln(abs(x) + 1e-9)) - ln(avg(abs(x) + 1e-9)), 6) AS entropy FROM sp GROUP BY vec_id",
    "shannon_entropy": f"WITH {SPECTRA} SELECT vec_id, round(sum(-x * x * ln(x * x)), 6) AS entropy FROM sp WHERE x <> 0 GROUP BY vec_id",
    "robust_frequencies": f"""WITH {SPECTRA}, u AS (SELECT vec_id, CAST(k AS INT) AS k, round(sum(x * x) OVER (PARTITION BY vec_id ORDER BY k ROWS UNBOUNDED PRECEDING) / sum(x * x) OVER (PARTITION BY vec_id), 9) AS upto FROM sp)
SELECT vec_id, min(k) FILTER (upto >= 0.05) AS q5, min(k) FILTER (upto >= 0.25) AS q25, min(k) FILTER (upto >= 0.5) AS q50, min(k) FILTER (upto >= 0.75) AS q75, min(k) FILTER (upto >= 0.95) AS q95 FROM u GROUP BY vec_id""",
    "loudest_bin": f"WITH {SPECTRA} SELECT vec_id, CAST(k AS INT) AS k FROM sp QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, k) = 1",
    "frame_features": f"""WITH {SPECTRA}, p AS (SELECT vec_id, k, x, x * x + 1e-12 AS p, lag(x) OVER (PARTITION BY vec_id ORDER BY k) AS was FROM sp),
a AS (SELECT vec_id, sum(k * p) / sum(p) AS centroid, sum(k * k * p) / sum(p) AS second, exp(avg(ln(p))) / avg(p) AS flatness, count(*) FILTER ((was < 0) <> (x < 0)) AS crossings FROM p GROUP BY vec_id)
SELECT vec_id, round(centroid, 5) AS centroid, round(sqrt(second - centroid * centroid), 5) AS bandwidth, round(flatness, 5) AS flatness, crossings FROM a""",
    "mel_scale": "SELECT p_partkey, round(1125 * ln(1 + p_retailprice / 700), 6) AS mel, round(700 * (exp(ln(1 + p_retailprice / 700)) - 1), 6) AS hz FROM part",
    "bark_scale": """WITH b AS (SELECT p_partkey, 26.81::DOUBLE * p_retailprice / (1960 + p_retailprice) - 0.53::DOUBLE AS b FROM part), c AS (SELECT p_partkey, CASE WHEN b < 2 THEN b + 0.15::DOUBLE / (2 - b) WHEN b > 20.1 THEN b + 0.22::DOUBLE * (b - 20.1::DOUBLE) ELSE b END AS b FROM b),
z AS (SELECT *, CASE WHEN b < 2 THEN (b - 0.3::DOUBLE) / 0.85::DOUBLE WHEN b > 20.1 THEN (b + 4.422::DOUBLE) / 1.22::DOUBLE ELSE b END AS z FROM c) SELECT p_partkey, round(b, 6) AS bark, round(1960 * (z + 0.53::DOUBLE) / (26.28::DOUBLE - z), 6) AS hz FROM z""",
    "filterbank_apply": f"""WITH {SPECTRA}, g AS (SELECT band, k, k * 8000.0::DOUBLE / 63 AS f, {_MEL.format('band')} AS lo, {_MEL.format('band + 1')} AS mid, {_MEL.format('band + 2')} AS hi FROM (SELECT unnest(range(12)) AS band), (SELECT unnest(range(64)) AS k)),
r AS (SELECT band, k, CASE WHEN f >= lo AND f <= mid THEN (f - lo) / (mid - lo) WHEN f > mid AND f <= hi THEN (hi - f) / (hi - mid) ELSE 0 END AS raw FROM g),
w AS (SELECT band, k, raw / sum(raw) OVER (PARTITION BY band) AS weight, raw FROM r)
SELECT vec_id, CAST(band AS INT) AS band, round(sum(abs(x) * weight), 6) AS y FROM sp JOIN w USING (k) WHERE raw > 0 GROUP BY vec_id, band""",
    "node_bands": f"WITH {_BANDS} SELECT * FROM nb",
    "nodes_in_range": f"WITH {_BANDS} SELECT p_partkey, count(*) AS n, CAST(sum(node) AS BIGINT) AS nodes FROM nb WHERE f_lo < 2500 AND f_hi > 1000 GROUP BY p_partkey",
    "random_files": "SELECT o_orderkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 50",
}
QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_") and k != "mel_bands"}
