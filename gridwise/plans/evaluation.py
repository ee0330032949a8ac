"""Measures of rankings and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwise.functions import grid, scores
from gridwise.operators import ranking, spatial
from gridwise.plans.base import Entry, registered
from gridwise.plans.domain import PIXELS, ctes, tiles, view
from gridwise.plans.spatials import _D, _SEG, _T

ENTRIES: dict[str, Entry] = {}


@registered(ENTRIES, f"""{ctes("judged")}, r AS (SELECT truth, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / CAST(2 AS DOUBLE) AS r FROM judged), s AS (SELECT CAST(sum(truth) AS BIGINT) AS p, count(*) AS n, sum(r * truth) AS sr FROM r)
SELECT p AS n_pos, n - p AS n_neg, round((sr - p * (p + 1) / CAST(2 AS DOUBLE)) / (p * (n - p)), 6) AS auc FROM s""")
def auc_average_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranking.auc(view(spark, d, "judged"), "score", "truth").select("n_pos", "n_neg", F.round("auc", 6).alias("auc"))


@registered(ENTRIES, f"""{ctes("judged")}, t AS (SELECT truth, row_number() OVER (ORDER BY score DESC, id) AS n FROM judged), k AS (SELECT unnest([20, 50, 100]) AS k)
SELECT k::INTEGER AS k, CAST(sum(truth) AS BIGINT) AS hits, avg(truth) AS precision FROM k JOIN t ON n <= k GROUP BY k""")
def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    j = view(spark, d, "judged")
    a, b, c = (ranking.precision_at(j, k, [F.desc("score"), F.col("id")], "truth") for k in (20, 50, 100))
    return a.unionByName(b).unionByName(c)


@registered(ENTRIES, f"""{ctes("cand")}, h AS (SELECT CASE WHEN area_m2 >= 20000 THEN '20k+' WHEN area_m2 >= 5000 THEN '5k-20k' WHEN area_m2 >= 2000 THEN '2k-5k' WHEN area_m2 >= 1000 THEN '1k-2k' END AS b, CAST(confidence >= 0.6 AS INT) AS hit FROM cand), n AS (SELECT unnest(['1k-2k', '2k-5k', '5k-20k', '20k+', 'none']) AS bucket)
SELECT bucket, count(b) AS installations, coalesce(CAST(sum(hit) AS BIGINT), 0) AS detected, avg(hit) AS recall FROM n LEFT JOIN h ON bucket = b GROUP BY bucket""")
def recall_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "cand").withColumn("hit", (F.col("confidence") >= 0.6).cast("int"))
    return ranking.recall_by(c, grid.area_bucket(F.col("area_m2")), "hit", ["1k-2k", "2k-5k", "5k-20k", "20k+", "none"])


@registered(ENTRIES, f"""{ctes("judged")}, a AS (SELECT id, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER () AS ra, (rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER () AS rb FROM judged)
SELECT id, round(ra, 6) AS score_pct, round(rb, 6) AS chars_pct, round((ra + rb) / 2, 6) AS fused FROM a""")
def pct_rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    j = ranking.average_ranks(ranking.average_ranks(view(spark, d, "judged"), "score", "a"), "n_chars", "b")
    return j.select("id", F.round("a_pct", 6).alias("score_pct"), F.round("b_pct", 6).alias("chars_pct"), F.round((F.col("a_pct") + F.col("b_pct")) / 2, 6).alias("fused"))


@registered(ENTRIES, f"""WITH {PIXELS}, c AS (SELECT a.p AS p1, b.p AS p2 FROM px a JOIN px b ON a.id = b.id AND a.k = 63 - b.k)
SELECT round(p1, 1) AS bin, count(*) AS n, round(avg(p1), 6) AS first, round(avg(p2), 6) AS second, round(avg(sqrt(p1 * p2)), 6) AS geometric, round(avg((p1 + p2) / 2), 6) AS mean, round(avg(greatest(p1, p2)), 6) AS max, round(avg(p1 * (CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * p2)), 6) AS gated FROM c GROUP BY 1""")
def fusion_variants(spark: SparkSession, d: str) -> DataFrame:
    """Each pixel fused with the one at its tile's opposite end, by bins of the first."""
    z = tiles(spark, d).select(F.explode(F.arrays_zip(F.col("px").alias("p1"), F.reverse("px").alias("p2"))).alias("z")).select("z.p1", "z.p2")
    f = scores.fusions(F.col("p1"), F.col("p2"))
    return z.groupBy(F.round("p1", 1).alias("bin")).agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(k) for k, c in f.items()))


@registered(ENTRIES, f"""WITH {PIXELS}, c AS (SELECT CASE WHEN a.k % 16 = 0 THEN -1 WHEN a.id % 3 = 0 AND a.p > 0.6 THEN 1 ELSE 0 END AS gt, a.p AS p1, b.p AS p2 FROM px a JOIN px b ON a.id = b.id AND a.k = 63 - b.k), t AS (SELECT unnest([20, 30, 40, 50, 60, 70]) / CAST(100 AS DOUBLE) AS thr),
v AS (SELECT gt, 'geometric' AS combo, sqrt(p1 * p2) AS p FROM c UNION ALL SELECT gt, 'first', p1 FROM c UNION ALL SELECT gt, 'second', p2 FROM c UNION ALL SELECT gt, 'mean', (p1 + p2) / 2 FROM c UNION ALL SELECT gt, 'max', greatest(p1, p2) FROM c UNION ALL SELECT gt, 'gated', p1 * (CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * p2) FROM c),
m AS (SELECT combo, thr, count(*) FILTER (WHERE gt = 1 AND round(p, 6) >= thr) AS tp, count(*) FILTER (WHERE gt = 0 AND round(p, 6) >= thr) AS fp, count(*) FILTER (WHERE gt = 1 AND round(p, 6) < thr) AS fn FROM v, t GROUP BY 1, 2)
SELECT combo, thr, tp, fp, fn, round(tp / greatest(tp + fp + fn, 1)::DOUBLE, 6) AS iou, row_number() OVER (PARTITION BY combo ORDER BY round(tp / greatest(tp + fp + fn, 1)::DOUBLE, 6) DESC, thr DESC) = 1 AS best FROM m""")
def fusion_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Each alone and four fusions by six thresholds, counted in one pass over the pixels."""
    thresholds = [0.2, 0.3, 0.4, 0.5, 0.6, 0.7]
    z = tiles(spark, d).select("id", F.posexplode(F.arrays_zip(F.col("px").alias("p1"), F.reverse("px").alias("p2"))).alias("k", "z")).select("id", "k", "z.p1", "z.p2")
    gt = F.when(F.col("k") % 16 == 0, -1).when((F.col("id") % 3 == 0) & (F.col("p1") > 0.6), 1).otherwise(0)
    f = scores.fusions(F.col("p1"), F.col("p2"))
    count = lambda c, t, truth, above: F.count_if((F.col("gt") == truth) & ((F.round(c, 6) >= t) if above else (F.round(c, 6) < t)))
    cells = [F.struct(F.lit(k).alias("combo"), F.lit(t).alias("thr"), count(c, t, 1, True).alias("tp"), count(c, t, 0, True).alias("fp"), count(c, t, 1, False).alias("fn")) for k, c in f.items() for t in thresholds]
    m = z.withColumn("gt", gt).agg(F.array(*cells).alias("m")).select(F.inline("m"))
    m = m.withColumn("iou", F.round(F.col("tp") / F.greatest(F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1)).cast("double"), 6))
    top = m.groupBy(F.col("combo").alias("c")).agg(F.max(F.struct("iou", "thr")).alias("top"))
    return m.join(top, F.col("combo") == F.col("c")).select("combo", "thr", "tp", "fp", "fn", "iou", (F.col("thr") == F.col("top.thr")).alias("best"))


@registered(ENTRIES, f"""WITH {PIXELS}, c AS (SELECT CASE WHEN k % 16 = 0 THEN -1 WHEN id % 3 = 0 AND p > 0.6 THEN 1 ELSE 0 END AS gt, CAST(p >= 0.5 AS INT) AS pr FROM px), n AS (SELECT count(*) FILTER (WHERE gt = 1 AND pr = 1) AS tp, count(*) FILTER (WHERE gt = 0 AND pr = 1) AS fp, count(*) FILTER (WHERE gt = 1 AND pr = 0) AS fn FROM c)
SELECT tp, fp, fn, round(tp / greatest(tp + fp + fn, 1)::DOUBLE, 6) AS iou, round(2 * tp / greatest(2 * tp + fp + fn, 1)::DOUBLE, 6) AS f1 FROM n""")
def pixel_confusion_iou_f1(spark: SparkSession, d: str) -> DataFrame:
    z = tiles(spark, d).select("id", F.posexplode("px").alias("k", "p"))
    gt = F.when(F.col("k") % 16 == 0, -1).when((F.col("id") % 3 == 0) & (F.col("p") > 0.6), 1).otherwise(0)
    c = ranking.confusion(z.select(gt.alias("gt"), (F.col("p") >= 0.5).cast("int").alias("pr")), "gt", "pr")
    return c.select("tp", "fp", "fn", F.round("iou", 6).alias("iou"), F.round("f1", 6).alias("f1"))


@registered(ENTRIES, f"""{ctes("cand")} SELECT status, count(*) AS n, round(avg(confidence), 6) AS mean, round(stddev_samp(confidence), 6) AS std, min(confidence) AS least, round(quantile_cont(confidence, 0.25), 6) AS q25, round(quantile_cont(confidence, 0.5), 6) AS q50, round(quantile_cont(confidence, 0.75), 6) AS q75, max(confidence) AS most FROM cand GROUP BY status""")
def describe_by_status(spark: SparkSession, d: str) -> DataFrame:
    t = ranking.described(view(spark, d, "cand"), "status", "confidence")
    return t.select("status", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "least", "q25", "q50", "q75", "most")))


@registered(ENTRIES, f"""{ctes("judged")}, v AS (SELECT 'score' AS variant, score AS s, truth, id FROM judged UNION ALL SELECT 'chars', CAST(n_chars AS DOUBLE), truth, id FROM judged UNION ALL SELECT 'product', score * n_chars, truth, id FROM judged),
r AS (SELECT variant, truth, rank() OVER (PARTITION BY variant ORDER BY s) + (count(*) OVER (PARTITION BY variant, s) - 1) / CAST(2 AS DOUBLE) AS r, row_number() OVER (PARTITION BY variant ORDER BY s DESC, id) AS n FROM v), a AS (SELECT variant, CAST(sum(truth) AS BIGINT) AS p, count(*) AS n, sum(r * truth) AS sr, avg(CASE WHEN n <= 20 THEN truth END) AS p20 FROM r GROUP BY variant)
SELECT variant, round((sr - p * (p + 1) / CAST(2 AS DOUBLE)) / (p * (n - p)), 6) AS auc, p20 FROM a""")
def ranking_variants(spark: SparkSession, d: str) -> DataFrame:
    """Area under the curve and precision at 20 of three rankings of the same rows."""
    j = view(spark, d, "judged").withColumn("chars", F.col("n_chars").cast("double")).withColumn("product", F.col("score") * F.col("n_chars"))
    rows = [ranking.auc(j, s, "truth").crossJoin(ranking.precision_at(j, 20, [F.desc(s), F.col("id")], "truth")).select(F.lit(s).alias("variant"), F.round("auc", 6).alias("auc"), F.col("precision").alias("p20")) for s in ("score", "chars", "product")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@registered(ENTRIES, f"""{ctes("cand")}, n AS (SELECT kind, status, count(*) AS n FROM cand GROUP BY ALL) SELECT kind, status, n, round(n / CAST(sum(n) OVER (PARTITION BY kind) AS DOUBLE), 6) AS share FROM n""")
def status_value_counts(spark: SparkSession, d: str) -> DataFrame:
    n = view(spark, d, "cand").groupBy("kind", "status").agg(F.count("*").alias("n"))
    total = n.groupBy(F.col("kind").alias("k")).agg(F.sum("n").alias("t"))
    return n.join(total, F.col("kind") == F.col("k")).select("kind", "status", "n", F.round(F.col("n") / F.col("t").cast("double"), 6).alias("share"))


@registered(ENTRIES, f"""{ctes("judged")}, r AS (SELECT truth, row_number() OVER (ORDER BY score, id DESC) - 1 AS n FROM judged) SELECT CAST(sum(truth) AS BIGINT) AS n_pos, count(*) - CAST(sum(truth) AS BIGINT) AS n_neg, round((avg(CASE WHEN truth = 1 THEN n END) - (sum(truth) - 1) / CAST(2 AS DOUBLE)) / (count(*) - sum(truth)), 6) AS auc FROM r""")
def auc_ordinal_rank(spark: SparkSession, d: str) -> DataFrame:
    """The area by plain ranks, equal scores by id."""
    return ranking.ordinal_auc(view(spark, d, "judged"), "score", "truth", [F.col("id")]).select("n_pos", "n_neg", F.round("auc", 6).alias("auc"))


@registered(ENTRIES, f"""{ctes("judged")}, r AS (SELECT truth, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / CAST(2 AS DOUBLE) AS r FROM judged), s AS (SELECT CAST(sum(truth) AS BIGINT) AS p, count(*) - CAST(sum(truth) AS BIGINT) AS q, count(*) AS n, sum(r * truth) AS sr FROM r), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM judged GROUP BY score))
SELECT p AS n_pos, q AS n_neg, sr - p * (p + 1) / CAST(2 AS DOUBLE) AS u, round((sr - p * (p + 1) / CAST(2 AS DOUBLE) - p * q / CAST(2 AS DOUBLE) - 0.5) / sqrt(p * q / CAST(12 AS DOUBLE) * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM s, t""")
def mann_whitney_u(spark: SparkSession, d: str) -> DataFrame:
    """The rank sum statistic of the good documents' scores and its normal deviate; the tests hold the chance that goes with it."""
    return ranking.mann_whitney(view(spark, d, "judged"), "score", "truth").select("n_pos", "n_neg", F.col("u").cast("double").alias("u"), F.round("z", 6).alias("z"))


@registered(ENTRIES, f"""{ctes("cand")}, g AS (SELECT * FROM cand WHERE status IN (SELECT status FROM cand GROUP BY status HAVING count(*) >= 20)) SELECT status, round(quantile_cont(area_m2, 0.5), 6) AS q_50, round(quantile_cont(area_m2, 0.9), 6) AS q_90, round(quantile_cont(area_m2, 0.99), 6) AS q_99 FROM g GROUP BY status""")
def quantiles_by_class(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of the areas of classes that have at least 20 rows."""
    from gridwise.operators import dataset

    q = ranking.quantiles(dataset.frequent(view(spark, d, "cand"), "status"), "area_m2", [0.5, 0.9, 0.99], "status")
    return q.select("status", *(F.round(c, 6).alias(c) for c in ("q_50", "q_90", "q_99")))


@registered(ENTRIES, f"""{ctes("cand")} SELECT id, confidence FROM (SELECT id, confidence, row_number() OVER (ORDER BY confidence DESC, id) - 1 AS n FROM cand WHERE confidence < 0.49 OR confidence > 0.51) WHERE n % 7 = 0""")
def off_plateau_every_seventh(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh candidate by score, without those on the plateau of undecided scores."""
    c = view(spark, d, "cand").where(~F.col("confidence").between(0.49, 0.51))
    return ranking.every_nth(c, 7, "confidence", [F.col("id")]).select("id", "confidence")


_TOWERS = f"""{ctes("cand", "nodes", "subs", "lines")}, h AS (SELECT DISTINCT a.id FROM cand a, subs b WHERE {_D} <= 3000), nn AS (SELECT a.id, min(round({_D}, 1)) AS tower FROM cand a, nodes b GROUP BY a.id), rc AS (SELECT a.id, count(*) AS n_ring FROM cand a, nodes b WHERE {_D} BETWEEN 150 AND 1000 GROUP BY a.id),
prs AS (SELECT c.id, {_SEG} AS d FROM (SELECT c.id, c.x, c.y, l.id AS lid, {_T} AS t FROM cand c, lines l) c JOIN lines l ON l.id = c.lid), nl AS (SELECT id, min(round(d, 1)) AS line FROM prs GROUP BY id),
f AS (SELECT c.id, c.confidence AS conf, (h.id IS NOT NULL)::INT AS truth, CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * exp(-tower / 2000) AS pt, CAST(0.75 AS DOUBLE) + CAST(0.25 AS DOUBLE) * least(coalesce(n_ring, 0), 4) / CAST(4 AS DOUBLE) AS pr, CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * exp(-line / 2000) AS pl FROM cand c LEFT JOIN h ON h.id = c.id JOIN nn ON nn.id = c.id LEFT JOIN rc ON rc.id = c.id JOIN nl ON nl.id = c.id),
v AS (SELECT id, truth, unnest(['conf', 'conf*tower', 'conf*isolated', 'conf*line', 'conf*tower*isolated']) AS variant, round(unnest([conf, conf * pt, conf * pr, conf * pl, conf * pt * pr]), 9) AS s FROM f)"""


@registered(ENTRIES, f"""{_TOWERS}, r AS (SELECT variant, truth, rank() OVER (PARTITION BY variant ORDER BY s) + (count(*) OVER (PARTITION BY variant, s) - 1) / CAST(2 AS DOUBLE) AS r, row_number() OVER (PARTITION BY variant ORDER BY s DESC, id) AS n FROM v), a AS (SELECT variant, CAST(sum(truth) AS BIGINT) AS p, count(*) AS n, sum(r * truth) AS sr, avg(CASE WHEN n <= 20 THEN truth END) AS p20, avg(CASE WHEN n <= 50 THEN truth END) AS p50 FROM r GROUP BY variant)
SELECT variant, round((sr - p * (p + 1) / CAST(2 AS DOUBLE)) / (p * (n - p)), 6) AS auc, p20, p50 FROM a""")
def tower_variants(spark: SparkSession, d: str) -> DataFrame:
    """Five rankings of the candidates by priors from towers and lines, against sites near them."""
    c = spatial.marked(view(spark, d, "cand").select("id", "x", "y", "confidence"), view(spark, d, "subs").select("id", "x", "y"), 3000.0, "hit")
    nodes = view(spark, d, "nodes").select("id", "x", "y")
    c = spatial.nearest(c, nodes, 500.0).withColumnRenamed("near_dist", "tower").drop("near_id")
    c = spatial.nearest(spatial.ring_counts(c, nodes, 150.0, 1000.0), view(spark, d, "lines").drop("voltage_v"), 500.0)
    conf, tower, isolated, line = F.col("confidence"), scores.half_prior(F.col("tower")), scores.isolated(F.col("n_ring")), scores.half_prior(F.col("near_dist"))
    variants = {"conf": conf, "conf*tower": conf * tower, "conf*isolated": conf * isolated, "conf*line": conf * line, "conf*tower*isolated": conf * tower * isolated}
    return ranking.compared(c.withColumn("truth", F.col("hit").cast("int")), variants, "truth", [20, 50], F.col("id"))
