"""Queries of the relational families: scans and sinks (A), projections and filters (B), joins (C), aggregates (E), ranks (F), sorting (G), sets (H) and scalar functions (I)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.functions.names import cache_tag, family, norm_key, normalize_species, real_binomial, safe_tag, severity_key, significance
from driftloom.functions.vectors import unit
from driftloom.plans.base import clean_bank, correlation, records, rounded, shifted_bank, sql_unit, with_clean, with_rec, with_units
from driftloom.registry import query
from driftloom.sources import archives
from driftloom.sources.archives import named_parts, with_fallback
from driftloom.sources.store import fresh_folder, table



def avg6(c: str | Column) -> Column:
    return rounded(F.avg(c))


# ---- A: scans and sinks ----


@query("a1_partition_scan", with_units("SELECT dataset, backbone, tag, count(*) AS n FROM shifted WHERE dataset = 'D1' AND backbone = 'B2' AND tag = 'blend_0_9' GROUP BY ALL"))
def partition_scan(spark: SparkSession, d: str) -> DataFrame:
    """A written bank, partitioned by its key; the filter prunes folders."""
    path = fresh_folder(spark)
    shifted_bank(spark, d).write.mode("overwrite").partitionBy("backbone", "dataset", "tag").parquet(path)
    return spark.read.parquet(path).filter("dataset = 'D1' AND backbone = 'B2' AND tag = 'blend_0_9'").groupBy("dataset", "backbone", "tag").agg(F.count("*").alias("n"))


@query("a2_channel_layout", with_clean("SELECT vec_id, backbone, round(x[1], 6) AS first, len(x) AS channels FROM clean"))
def channel_layout(spark: SparkSession, d: str) -> DataFrame:
    """A wide vector as (token, channel): the second axis is the channel, as a spatial bank stores it."""
    return clean_bank(spark, d).select("vec_id", "backbone", rounded(F.col("x")[0]).alias("first"), F.size("x").cast("long").alias("channels"))


@query("a3_unit_scan", with_clean(f"SELECT dataset, backbone, vec_id, round(u[16], 6) AS last FROM (SELECT *, {sql_unit('x')} AS u FROM clean)"))
def unit_scan(spark: SparkSession, d: str) -> DataFrame:
    return clean_bank(spark, d).select("dataset", "backbone", "vec_id", rounded(unit(F.col("x"))[15]).alias("last"))


@query("a6_csv_round_trip", with_rec("SELECT dataset, backbone, perturbation, severity, drift, acc_drop FROM rec"))
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_folder(spark)
    rows = records(spark, d).select("dataset", "backbone", "perturbation", "severity", "drift", "acc_drop")
    rows.write.mode("overwrite").option("header", True).csv(path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("a7_checkpoint_union", with_rec("SELECT dataset, backbone, count(*) AS n FROM rec WHERE dataset <> 'D2' GROUP BY ALL"))
def checkpoint_union(spark: SparkSession, d: str) -> DataFrame:
    """Only complete checkpoints count: an anti join takes out pairs with a missing condition (here all of one dataset's)."""
    base = records(spark, d)
    parts = base.filter("dataset <> 'D2'").unionByName(base.filter("dataset = 'D2' AND perturbation <> 'roll'"))
    expected = base.select("perturbation", "severity").distinct()
    pairs = base.select("dataset", "backbone").distinct()
    missing = pairs.crossJoin(F.broadcast(expected)).join(parts, ["dataset", "backbone", "perturbation", "severity"], "left_anti")  # dimensions only
    return parts.join(missing, ["dataset", "backbone"], "left_anti").groupBy("dataset", "backbone").agg(F.count("*").alias("n"))


@query("a8_json_scan", "SELECT event_type, count(*) AS n, count(k) AS with_key FROM (SELECT event_type, json_extract_string(props, '$.k') AS k FROM events) GROUP BY event_type")
def json_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k")).groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("with_key"))


@query("a9_discover_names", with_rec("SELECT DISTINCT backbone, dataset, tag, perturbation AS parsed FROM rec"))
def discover_names(spark: SparkSession, d: str) -> DataFrame:
    """File names back to their keys: the longest known dataset first, the rest is the tag."""
    names = records(spark, d).select(F.concat_ws("_", "backbone", "dataset", "tag").alias("name")).distinct()
    part = lambda i: F.regexp_extract("name", r"^(B\d+)_(D\d+)_((\w+?)_[\d_]+)$", i)
    return names.select(part(1).alias("backbone"), part(2).alias("dataset"), part(3).alias("tag"), part(4).alias("parsed"))


@query("a9_longest_names", with_rec("""SELECT name, arg_max(known, length(known)) AS dataset, CASE WHEN length(name) > max(length(known)) THEN substr(name, max(length(known)) + 2) END AS rest
FROM (SELECT DISTINCT dataset || CASE backbone WHEN 'B0' THEN '' WHEN 'B1' THEN '_x1' WHEN 'B2' THEN '_x10' ELSE '0' END || '_' || tag AS name FROM rec) n
LEFT JOIN (SELECT dataset AS known FROM rec UNION SELECT dataset || '_x1' FROM rec UNION SELECT dataset || '_x10' FROM rec) k ON starts_with(name, known) AND (length(name) = length(known) OR substr(name, length(known) + 1, 1) = '_') GROUP BY name"""))
def longest_names(spark: SparkSession, d: str) -> DataFrame:
    """Names to their datasets, of which some begin others: the longest that ends at an underscore, or none."""
    r = records(spark, d)
    more = F.when(F.col("backbone") == "B0", "").when(F.col("backbone") == "B1", "_x1").when(F.col("backbone") == "B2", "_x10").otherwise("0")
    names = r.select(F.concat("dataset", more, F.lit("_"), "tag").alias("name")).distinct()
    known = r.select(F.explode(F.array(F.col("dataset"), F.concat("dataset", F.lit("_x1")), F.concat("dataset", F.lit("_x10")))).alias("dataset"))
    return named_parts(names, known)


@query("a12_array_archives", with_clean("SELECT backbone || '_' || dataset || '_clean' AS archive, label, count(*) AS n, round(avg(x[3]), 6) AS third FROM clean WHERE dataset <> 'D2' GROUP BY ALL"))
def array_archives(spark: SparkSession, d: str) -> DataFrame:
    """Every bank written as an archive of arrays and read again: two of three datasets, two of its members."""
    path = fresh_folder(spark)
    bank = clean_bank(spark, d).select(F.concat_ws("_", "backbone", "dataset", F.lit("clean")).alias("archive"), F.col("x").alias("features"), F.col("label").alias("labels"), F.col("vec_id").cast("string").alias("paths"))
    archives.write(bank.repartition("archive"), path)
    wanted = [f"B{b}_D{k}_clean" for b in range(4) for k in range(2)]
    rows = archives.read(spark, path, ["archive", "features", "labels"]).filter(F.col("archive").isin(wanted))
    return rows.groupBy("archive", F.col("labels").alias("label")).agg(F.count("*").alias("n"), rounded(F.avg(F.col("features")[2])).alias("third"))


@query("a1_newest_bank", with_clean("SELECT dataset, backbone, count(*) AS n, sum(version) AS versions FROM (SELECT *, CASE WHEN dataset = 'D0' THEN 4 ELSE 2 END AS version FROM clean) GROUP BY ALL"))
def newest_bank(spark: SparkSession, d: str) -> DataFrame:
    """Banks of a newer store, and of the older one those that it lacks: here one dataset has been moved already."""
    bank = clean_bank(spark, d).select("dataset", "backbone", "vec_id")
    newer = bank.filter("dataset = 'D0'").withColumn("version", F.lit(4))
    found = with_fallback(newer, bank.withColumn("version", F.lit(2)), ["dataset", "backbone"])
    return found.groupBy("dataset", "backbone").agg(F.count("*").alias("n"), F.sum("version").alias("versions"))


@query("a11_generator", "SELECT i AS id, 'D' || (i % 3) AS dataset, ('0x' || substr(md5('gen|' || i), 1, 8))::BIGINT % 1000 / 1000.0::DOUBLE AS value FROM range(1000) t(i)")
def generator(spark: SparkSession, d: str) -> DataFrame:
    """Seeded demo rows: the hash of the id, not a generator's state, so any task gives the same."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit("gen|"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long")
    return spark.range(1000).select("id", F.concat(F.lit("D"), F.col("id") % 3).alias("dataset"), (h % 1000 / F.lit(1000.0)).alias("value"))


@query("a15_provenance", with_rec("SELECT 'records' AS name, count(*) AS n, sha256(string_agg(tag || '/' || dataset || '/' || backbone, ',' ORDER BY tag || '/' || dataset || '/' || backbone)) AS digest FROM rec"))
def provenance(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("/", "tag", "dataset", "backbone")
    return records(spark, d).agg(F.lit("records").alias("name"), F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(key)), ","), 256).alias("digest"))


# ---- B: projections, filters, predicates ----


@query("b1_b2_project_filter", with_rec("SELECT dataset, backbone, tag, drift FROM rec WHERE perturbation = 'blend' AND dataset <> 'D0'"))
def project_filter(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).filter((F.col("perturbation") == "blend") & (F.col("dataset") != "D0")).select("dataset", "backbone", "tag", "drift")


@query("b3_point_lookup", with_rec("SELECT drift, accuracy FROM rec WHERE dataset = 'D1' AND backbone = 'B1' AND perturbation = 'add' AND severity = '0.3'"))
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).filter("dataset = 'D1' AND backbone = 'B1' AND perturbation = 'add' AND severity = '0.3'").select("drift", "accuracy")


@query("b4_isin", with_rec("SELECT tag, count(*) AS n FROM rec WHERE perturbation IN ('add', 'roll') GROUP BY tag"))
def isin(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).filter(F.col("perturbation").isin("add", "roll")).groupBy("tag").agg(F.count("*").alias("n"))


@query("b5_b6_expression_filter", with_rec("SELECT dataset, backbone, tag FROM rec WHERE (drift > 0.05 AND failure = 1) OR tag LIKE 'roll%' OR starts_with(tag, 'scale')"))
def expression_filter(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).filter(F.expr("drift > 0.05 AND failure = 1") | F.col("tag").startswith("roll") | F.col("tag").startswith("scale")).select("dataset", "backbone", "tag")


_GAPS = "CASE WHEN severity = '0.3' THEN NULL ELSE drift END"


@query("b7_dropna", with_rec("SELECT dataset, backbone, tag, drift FROM rec WHERE severity <> '0.3' AND severity <> '0.6'"))
def dropna(spark: SparkSession, d: str) -> DataFrame:
    """NaN and infinities become null first: Spark counts NaN as a value."""
    v = F.when(F.col("severity") == "0.3", F.lit(float("nan"))).when(F.col("severity") == "0.6", F.lit(float("inf"))).otherwise(F.col("drift"))
    rows = records(spark, d).select("dataset", "backbone", "tag", v.alias("drift"))
    return rows.withColumn("drift", F.when(~F.isnan("drift") & (F.abs("drift") != float("inf")), F.col("drift"))).dropna(subset=["drift"])


@query("b8_fillna_median", with_rec(f"SELECT dataset, backbone, tag, round(coalesce({_GAPS}, (SELECT median({_GAPS}) FROM rec)), 6) AS drift FROM rec"))
def fillna_median(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d).select("dataset", "backbone", "tag", F.when(F.col("severity") != "0.3", F.col("drift")).alias("drift"))
    return rows.crossJoin(F.broadcast(rows.agg(F.median("drift").alias("m")))).select("dataset", "backbone", "tag", rounded(F.coalesce("drift", "m")).alias("drift"))  # one row


@query("b9_derived_columns", with_rec("SELECT dataset, backbone, tag, round(1 - drift, 6) AS stability, round(-acc_drop, 6) AS gain FROM rec"))
def derived(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).withColumns({"stability": rounded(1 - F.col("drift")), "gain": rounded(-F.col("acc_drop"))}).select("dataset", "backbone", "tag", "stability", "gain")


@query("b10_to_numeric", with_rec("SELECT tag, TRY_CAST(CASE WHEN perturbation = 'add' THEN 'severe' ELSE severity END AS DOUBLE) AS level, count(*) AS n FROM rec GROUP BY ALL"))
def to_numeric(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("perturbation") == "add", F.lit("severe")).otherwise(F.col("severity"))
    return records(spark, d).groupBy("tag", text.try_cast("double").alias("level")).agg(F.count("*").alias("n"))


@query("b11_row_mask", with_rec(f"SELECT count(*) AS n, round(corr({_GAPS}, acc_drop), 6) AS r FROM rec WHERE {_GAPS} IS NOT NULL"))
def row_mask(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d).withColumn("x", F.when(F.col("severity") != "0.3", F.col("drift"))).filter(F.col("x").isNotNull() & F.col("acc_drop").isNotNull())
    return rows.agg(F.count("*").alias("n"), rounded(correlation("x", "acc_drop")).alias("r"))


@query("b12_classes_with_two", "SELECT label, n FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label) WHERE n >= 2")
def classes_with_two(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n")).filter("n >= 2")


@query("b13_case_labels", with_rec("SELECT dataset, backbone, tag, CASE WHEN acc_drop > 0.2 THEN 'fails' WHEN acc_drop > 0.05 THEN 'degrades' ELSE 'holds' END AS verdict, CASE WHEN drift < 0.001 THEN '***' WHEN drift < 0.01 THEN '**' WHEN drift < 0.05 THEN '*' ELSE 'n.s.' END AS stars FROM rec"))
def case_labels(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("acc_drop") > 0.2, "fails").when(F.col("acc_drop") > 0.05, "degrades").otherwise("holds")
    return records(spark, d).select("dataset", "backbone", "tag", verdict.alias("verdict"), significance(F.col("drift")).alias("stars"))


# ---- C: joins ----


@query("c1_left_join", with_rec("SELECT a.dataset, a.backbone, a.tag, a.drift, b.knn1 FROM rec a LEFT JOIN (SELECT * FROM rec WHERE knn1 > 0.02) b ON a.dataset = b.dataset AND a.backbone = b.backbone AND a.perturbation = b.perturbation AND a.severity = b.severity"))
def left_join(spark: SparkSession, d: str) -> DataFrame:
    key = ["dataset", "backbone", "perturbation", "severity"]
    r = records(spark, d)
    return r.select(*key, "tag", "drift").join(r.filter("knn1 > 0.02").select(*key, "knn1"), key, "left").select("dataset", "backbone", "tag", "drift", "knn1")


@query("c2_prefix_join", with_rec("SELECT r.dataset, r.backbone, r.tag, m.mean_drift FROM rec r LEFT JOIN (SELECT dataset, backbone, round(avg(drift), 6) AS mean_drift FROM rec WHERE dataset <> 'D2' GROUP BY ALL) m ON r.dataset = m.dataset AND r.backbone = m.backbone"))
def prefix_join(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    m = r.filter("dataset <> 'D2'").groupBy("dataset", "backbone").agg(avg6("drift").alias("mean_drift"))
    return r.join(m, ["dataset", "backbone"], "left").select("dataset", "backbone", "tag", "mean_drift")


@query("c3_combine_first", with_rec("SELECT a.dataset, a.backbone, a.tag, coalesce(b.drift, a.drift) AS drift FROM rec a LEFT JOIN (SELECT dataset, backbone, tag, round(drift * 2, 9) AS drift FROM rec WHERE perturbation = 'add') b ON a.dataset = b.dataset AND a.backbone = b.backbone AND a.tag = b.tag"))
def combine_first(spark: SparkSession, d: str) -> DataFrame:
    key = ["dataset", "backbone", "tag"]
    r = records(spark, d)
    new = r.filter("perturbation = 'add'").select(*key, F.round(F.col("drift") * 2, 9).alias("drift_new"))
    return r.join(new, key, "left").select(*key, F.coalesce("drift_new", "drift").alias("drift"))


@query("c4_self_join", with_rec("SELECT a.dataset AS source, b.dataset AS target, a.backbone, a.tag, round(a.accuracy - b.accuracy, 6) AS gap FROM rec a LEFT JOIN rec b ON a.backbone = b.backbone AND a.tag = b.tag AND a.dataset <> b.dataset"))
def self_join(spark: SparkSession, d: str) -> DataFrame:
    a = records(spark, d).select(F.col("dataset").alias("source"), "backbone", "tag", F.col("accuracy").alias("x"))
    b = records(spark, d).select(F.col("dataset").alias("target"), "backbone", "tag", F.col("accuracy").alias("y"))
    return a.alias("a").join(b.alias("b"), (F.col("a.backbone") == F.col("b.backbone")) & (F.col("a.tag") == F.col("b.tag")) & (F.col("source") != F.col("target")), "left").select("source", "target", "a.backbone", "a.tag", rounded(F.col("x") - F.col("y")).alias("gap"))


@query("c5_inner_join_suffixes", with_rec("SELECT a.dataset, a.tag, a.drift AS drift_a, b.drift AS drift_b FROM rec a JOIN rec b ON a.dataset = b.dataset AND a.tag = b.tag AND a.backbone = 'B0' AND b.backbone = 'B1'"))
def inner_join(spark: SparkSession, d: str) -> DataFrame:
    one = lambda b, s: records(spark, d).filter(F.col("backbone") == b).select("dataset", "tag", F.col("drift").alias(f"drift_{s}"))
    return one("B0", "a").join(one("B1", "b"), ["dataset", "tag"])


@query("c6_aggregate_to_detail", with_rec("SELECT dataset, backbone, tag, round(drift - avg(drift) OVER (PARTITION BY dataset), 6) AS above_mean FROM rec"))
def aggregate_to_detail(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("dataset", "backbone", "tag", rounded(F.col("drift") - F.avg("drift").over(Window.partitionBy("dataset"))).alias("above_mean"))


@query("c7_five_key_join", with_rec("SELECT a.dataset, a.backbone, a.tag, b.acc_drop FROM rec a LEFT JOIN rec b ON a.dataset = b.dataset AND a.backbone = b.backbone AND a.perturbation = b.perturbation AND a.severity = b.severity AND a.tag = b.tag AND b.failure = 1"))
def five_keys(spark: SparkSession, d: str) -> DataFrame:
    key = ["dataset", "backbone", "perturbation", "severity", "tag"]
    r = records(spark, d)
    return r.select(*key).join(r.filter("failure = 1").select(*key, "acc_drop"), key, "left").select("dataset", "backbone", "tag", "acc_drop")


@query("c8_lookup_join", with_rec("SELECT r.dataset, r.tag, v.camera FROM rec r JOIN (VALUES ('D0', 'scanner'), ('D1', 'phone')) v(dataset, camera) ON r.dataset = v.dataset WHERE backbone = 'B0'"))
def lookup_join(spark: SparkSession, d: str) -> DataFrame:
    cameras = spark.createDataFrame([("D0", "scanner"), ("D1", "phone")], "dataset string, camera string")
    return records(spark, d).filter("backbone = 'B0'").join(F.broadcast(cameras), "dataset").select("dataset", "tag", "camera")  # two fixed rows


@query("c9_paired_join", with_units("SELECT dataset, backbone, tag, count(*) AS n FROM pairs GROUP BY ALL"))
def paired_join(spark: SparkSession, d: str) -> DataFrame:
    bank = clean_bank(spark, d).select("dataset", "backbone", "vec_id")
    return shifted_bank(spark, d).join(bank, ["dataset", "backbone", "vec_id"]).groupBy("dataset", "backbone", "tag").agg(F.count("*").alias("n"))


@query("c10_semi_anti", "SELECT 'labelled' AS kind, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'unlabelled', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    one = lambda how, kind: docs.join(labels, "doc_id", how).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return one("left_semi", "labelled").union(one("left_anti", "unlabelled"))


@query("c12_unordered_pairs", with_rec("SELECT a.backbone AS x, b.backbone AS y, round(corr(a.drift, b.drift), 6) AS r FROM rec a JOIN rec b ON a.dataset = b.dataset AND a.tag = b.tag AND a.backbone < b.backbone GROUP BY ALL"))
def unordered_pairs(spark: SparkSession, d: str) -> DataFrame:
    a = records(spark, d).select("dataset", "tag", F.col("backbone").alias("x"), F.col("drift").alias("dx"))
    b = records(spark, d).select("dataset", "tag", F.col("backbone").alias("y"), F.col("drift").alias("dy"))
    return a.join(b, ["dataset", "tag"]).filter("x < y").groupBy("x", "y").agg(rounded(correlation("dx", "dy")).alias("r"))


@query("c14_map_fallback", "SELECT p_partkey, coalesce(a.g, b.g, 'other') AS grp FROM part LEFT JOIN (VALUES ('Brand#11', 'one')) a(k, g) ON p_brand = a.k LEFT JOIN (VALUES ('STANDARD', 'two'), ('PROMO', 'three')) b(k, g) ON split_part(p_type, ' ', 1) = b.k")
def map_fallback(spark: SparkSession, d: str) -> DataFrame:
    a = spark.createDataFrame([("Brand#11", "one")], "ka string, ga string")
    b = spark.createDataFrame([("STANDARD", "two"), ("PROMO", "three")], "kb string, gb string")
    p = table(spark, d, "part")
    return p.join(F.broadcast(a), p.p_brand == a.ka, "left").join(F.broadcast(b), F.split("p_type", " ")[0] == b.kb, "left").select("p_partkey", F.coalesce("ga", "gb", F.lit("other")).alias("grp"))  # fixed rows


@query("c15_grid", with_rec("SELECT a.dataset, b.backbone, c.tag FROM (SELECT DISTINCT dataset FROM rec) a, (SELECT DISTINCT backbone FROM rec) b, (SELECT DISTINCT tag FROM rec) c"))
def grid(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return r.select("dataset").distinct().crossJoin(r.select("backbone").distinct()).crossJoin(r.select("tag").distinct())  # dimensions only


@query("c16_present_for_all", with_rec("SELECT dataset, tag FROM rec WHERE NOT (backbone = 'B3' AND perturbation = 'roll') GROUP BY dataset, tag HAVING count(DISTINCT backbone) = (SELECT count(DISTINCT backbone) FROM rec)"))
def present_for_all(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    need = r.agg(F.countDistinct("backbone").alias("need"))
    have = r.filter("NOT (backbone = 'B3' AND perturbation = 'roll')").groupBy("dataset", "tag").agg(F.countDistinct("backbone").alias("have"))
    return have.crossJoin(F.broadcast(need)).filter("have = need").select("dataset", "tag")  # one row


# ---- E: aggregates ----


@query("e1_group_means", with_rec("SELECT dataset, backbone, round(avg(drift), 6) AS drift, round(avg(acc_drop), 6) AS acc_drop FROM rec GROUP BY ALL"))
def group_means(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy("dataset", "backbone").agg(avg6("drift").alias("drift"), avg6("acc_drop").alias("acc_drop"))


@query("e2_named_aggregates", with_rec("SELECT perturbation, round(avg(drift), 6) AS mean, round(stddev_samp(drift), 6) AS std, count(*) AS size, count(DISTINCT dataset) AS datasets, max(drift) AS most, min(drift) AS least FROM rec GROUP BY perturbation"))
def named_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy("perturbation").agg(avg6("drift").alias("mean"), rounded(F.stddev_samp("drift")).alias("std"), F.count("*").alias("size"), F.countDistinct("dataset").alias("datasets"), F.max("drift").alias("most"), F.min("drift").alias("least"))


@query("e3_coverage", with_rec("SELECT backbone, count(*) AS n, count_if(drift > 0.05) AS kept, round(count_if(drift > 0.05) / count(*), 6) AS coverage FROM rec GROUP BY backbone"))
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy("backbone").agg(F.count("*").alias("n"), F.count_if(F.col("drift") > 0.05).alias("kept")).withColumn("coverage", rounded(F.col("kept") / F.col("n")))


@query("e4_custom_aggregates", with_rec("SELECT backbone, round(100 * stddev_samp(drift) / avg(drift), 6) AS cv_pct, round(1.96 * stddev_samp(drift) / sqrt(count(*)), 6) AS ci, round(max(drift) - min(drift), 6) AS spread, arg_min(tag, dataset || tag) AS first_tag FROM rec GROUP BY backbone"))
def custom_aggregates(spark: SparkSession, d: str) -> DataFrame:
    s = F.stddev_samp("drift")
    return records(spark, d).groupBy("backbone").agg(rounded(100 * s / F.avg("drift")).alias("cv_pct"), rounded(1.96 * s / F.sqrt(F.count("*"))).alias("ci"), rounded(F.max("drift") - F.min("drift")).alias("spread"), F.min_by("tag", F.concat("dataset", "tag")).alias("first_tag"))


@query("e5_median", with_rec("SELECT dataset, round(avg(drift), 6) AS mean, round(stddev_samp(drift), 6) AS std, round(median(drift), 6) AS median FROM rec GROUP BY dataset"))
def medians(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy("dataset").agg(avg6("drift").alias("mean"), rounded(F.stddev_samp("drift")).alias("std"), rounded(F.median("drift")).alias("median"))


@query("e6_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("e7_distinct_count", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def distinct_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"))


_SIGN = "sign(round(acc_drop - 0.05, 9))::INT"


@query("e8_mode_of_signs", with_rec(f"SELECT backbone, arg_max(s, n * 10 - s) AS mode, round(max(n) / sum(n), 6) AS agreement FROM (SELECT backbone, {_SIGN} AS s, count(*) AS n FROM rec WHERE {_SIGN} <> 0 GROUP BY ALL) GROUP BY backbone"))
def mode_of_signs(spark: SparkSession, d: str) -> DataFrame:
    s = records(spark, d).select("backbone", F.signum(F.round(F.col("acc_drop") - 0.05, 9)).cast("int").alias("s")).filter("s <> 0")
    n = s.groupBy("backbone", "s").agg(F.count("*").alias("n"))
    return n.groupBy("backbone").agg(F.max_by("s", F.struct("n", -F.col("s"))).alias("mode"), rounded(F.max("n") / F.sum("n")).alias("agreement"))


@query("e9_pivot", with_rec("SELECT tag, " + ", ".join(f"round(avg(CASE WHEN backbone = 'B{b}' THEN drift END), 6) AS b{b}" for b in range(4)) + " FROM rec GROUP BY tag"))
def pivot(spark: SparkSession, d: str) -> DataFrame:
    p = records(spark, d).groupBy("tag").pivot("backbone", [f"B{b}" for b in range(4)]).agg(avg6("drift"))
    return p.select("tag", *[F.col(f"B{b}").alias(f"b{b}") for b in range(4)])


@query("e10_two_levels", with_rec("SELECT perturbation, round(avg(m), 6) AS mean_of_means FROM (SELECT backbone, perturbation, avg(drift) AS m FROM rec GROUP BY ALL) GROUP BY perturbation"))
def two_levels(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy("backbone", "perturbation").agg(F.avg("drift").alias("m")).groupBy("perturbation").agg(avg6("m").alias("mean_of_means"))


@query("e11_means_and_corr", with_rec("SELECT round(corr(a, b), 6) AS r FROM (SELECT backbone, avg(acc_drop) AS a, avg(knn5) AS b FROM rec GROUP BY backbone)"))
def means_and_corr(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy("backbone").agg(F.avg("acc_drop").alias("a"), F.avg("knn5").alias("b")).agg(rounded(correlation("a", "b")).alias("r"))


@query("e12_quantiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 4) AS lo, round(quantile_cont(l_extendedprice, 0.975), 4) AS hi FROM lineitem GROUP BY l_returnflag")
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    found = exact_quantiles(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", {"lo": 0.025, "hi": 0.975})
    return found.select("l_returnflag", rounded(F.col("lo"), 4).alias("lo"), rounded(F.col("hi"), 4).alias("hi"))


def exact_quantiles(rows: DataFrame, key: str, value: str, points: dict[str, float]) -> DataFrame:
    """key and one interpolated quantile for each of ``points``: counts by bins of value first, then by value within the few bins that hold the places asked for.

    Bins follow the logarithm and NaN comes last; a bin of any size is right, a large one is only slower. No task gets a group's values.
    """
    v = F.col("_v")
    rows = rows.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v"))
    rows = rows.withColumn("_bin", F.when(F.isnan(v), F.lit(2**62)).otherwise(F.floor(F.signum(v) * F.log1p(F.abs(v)) * 256)).cast("long"))
    groups = rows.select("_k").distinct()
    bins = rows.filter("_v IS NOT NULL").groupBy("_k", "_bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("_k")
    bins = bins.withColumns({"last": F.sum("n").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "total": F.sum("n").over(w)})
    place = lambda q: F.lit(q) * (F.col("total") - 1)
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("point"), place(q).alias("place"), side(place(q)).cast("long").alias("at")) for name, q in points.items() for side in (F.floor, F.ceil)])).alias("a")
    wanted = bins.select("_k", "_bin", (F.col("last") - F.col("n")).alias("before"), "last", asked).select("_k", "_bin", "before", "last", "a.*").filter("before <= at AND at < last").drop("last").distinct()
    near = rows.alias("r").join(F.broadcast(wanted.alias("w")), F.col("r._k").eqNullSafe(F.col("w._k")) & (F.col("r._bin") == F.col("w._bin")))  # two rows for each group and point
    counts = near.filter("_v IS NOT NULL").groupBy("w._k", "point", "place", "at", "before", "_v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("_k", "point", "at").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("before")
    at = counts.withColumn("upto", upto).filter("upto - n <= at AND at < upto")
    part = F.when(F.floor("place") == F.ceil("place"), v).otherwise(F.when(F.col("at") == F.floor("place"), F.ceil("place") - F.col("place")).otherwise(F.col("place") - F.floor("place")) * v)
    found = at.groupBy(F.col("_k").alias("_g")).agg(*[F.sum(F.when(F.col("point") == name, part)).alias(name) for name in points])
    return groups.join(found, F.col("_k").eqNullSafe(F.col("_g")), "left").select(F.col("_k").alias(key), *points)


@query("e13_higher_quantile", with_rec("SELECT backbone, list_sort(list(drift))[ceil(0.9 * (count(*) - 1))::INT + 1] AS q90 FROM rec GROUP BY backbone"))
def higher(spark: SparkSession, d: str) -> DataFrame:
    s = F.array_sort(F.collect_list("drift"))
    return records(spark, d).groupBy("backbone").agg(s[F.ceil(F.lit(0.9) * (F.count("*") - 1)).cast("int")].alias("q90"))


@query("e14_weighted_mean", with_rec("SELECT tag, round(sum(n * accuracy) / sum(n), 6) AS weighted FROM rec GROUP BY tag"))
def weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy("tag").agg(rounded(F.sum(F.col("n") * F.col("accuracy")) / F.sum("n")).alias("weighted"))


@query("e15_standardised_difference", with_rec("SELECT round((avg(drift) FILTER (failure = 1) - avg(drift) FILTER (failure = 0)) / sqrt((var_samp(drift) FILTER (failure = 1) + var_samp(drift) FILTER (failure = 0)) / 2), 6) AS smd FROM rec"))
def smd(spark: SparkSession, d: str) -> DataFrame:
    of = lambda f, v: f(F.when(F.col("failure") == v, F.col("drift")))
    return records(spark, d).agg(rounded((of(F.avg, 1) - of(F.avg, 0)) / F.sqrt((of(F.var_samp, 1) + of(F.var_samp, 0)) / 2)).alias("smd"))


@query("e17_confusion", with_rec("SELECT count_if(drift > 0.05 AND failure = 1) AS tp, count_if(drift > 0.05 AND failure = 0) AS fp, count_if(drift <= 0.05 AND failure = 0) AS tn, count_if(drift <= 0.05 AND failure = 1) AS fn FROM rec"))
def confusion(spark: SparkSession, d: str) -> DataFrame:
    alarm, bad = F.col("drift") > 0.05, F.col("failure") == 1
    return records(spark, d).agg(F.count_if(alarm & bad).alias("tp"), F.count_if(alarm & ~bad).alias("fp"), F.count_if(~alarm & ~bad).alias("tn"), F.count_if(~alarm & bad).alias("fn"))


@query("e18_histogram", with_units("SELECT floor((1 - cos) / 0.05)::BIGINT AS bin, count(*) AS n FROM pairs GROUP BY ALL HAVING count(*) >= 30"))
def histogram(spark: SparkSession, d: str) -> DataFrame:
    from driftloom.plans.base import paired

    return paired(spark, d).groupBy(F.floor((1 - F.col("cos")) / 0.05).alias("bin")).agg(F.count("*").alias("n")).filter("n >= 30")


# ---- F: ranks and windows ----


def ordinal(value: str, keys: list[str], tie: list[str], descending: bool = True) -> Column:
    c = F.col(value)
    return F.row_number().over(Window.partitionBy(*keys).orderBy(c.desc() if descending else c.asc(), *tie))


def average_rank(value: str, keys: list[str]) -> Column:
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


@query("f1_mean_rank", with_rec("SELECT backbone, round(avg(r), 6) AS mean_rank FROM (SELECT backbone, row_number() OVER (PARTITION BY dataset, tag ORDER BY accuracy DESC, backbone) AS r FROM rec) GROUP BY backbone"))
def mean_rank(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).withColumn("r", ordinal("accuracy", ["dataset", "tag"], ["backbone"])).groupBy("backbone").agg(avg6("r").alias("mean_rank"))


@query("f2_kendall_ranks", with_rec("SELECT dataset, tag, backbone, row_number() OVER (PARTITION BY dataset, tag ORDER BY drift DESC, backbone) AS r FROM rec"))
def kendall_ranks(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("dataset", "tag", "backbone", ordinal("drift", ["dataset", "tag"], ["backbone"]).alias("r"))


@query("f3_average_rank", with_rec("SELECT dataset, backbone, tag, rank() OVER (PARTITION BY backbone ORDER BY accuracy) + (count(*) OVER (PARTITION BY backbone, accuracy) - 1) / 2.0::DOUBLE AS r FROM rec"))
def average_ranks(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("dataset", "backbone", "tag", average_rank("accuracy", ["backbone"]).alias("r"))


@query("f4_ordinal_spearman", with_rec("SELECT backbone, round(corr(a, b), 6) AS rho FROM (SELECT backbone, row_number() OVER (PARTITION BY backbone ORDER BY drift, dataset, tag) AS a, row_number() OVER (PARTITION BY backbone ORDER BY acc_drop, dataset, tag) AS b FROM rec) GROUP BY backbone"))
def ordinal_spearman(spark: SparkSession, d: str) -> DataFrame:
    tie = ["dataset", "tag"]
    r = records(spark, d).withColumns({"a": ordinal("drift", ["backbone"], tie, False), "b": ordinal("acc_drop", ["backbone"], tie, False)})
    return r.groupBy("backbone").agg(rounded(correlation("a", "b")).alias("rho"))


@query("f5_rank_in_row", with_rec("SELECT dataset, tag, arg_min(backbone, r) AS best, arg_max(backbone, r) AS worst FROM (SELECT *, row_number() OVER (PARTITION BY dataset, tag ORDER BY accuracy DESC, backbone) AS r FROM rec) GROUP BY ALL"))
def rank_in_row(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).withColumn("r", ordinal("accuracy", ["dataset", "tag"], ["backbone"]))
    return r.groupBy("dataset", "tag").agg(F.min_by("backbone", "r").alias("best"), F.max_by("backbone", "r").alias("worst"))


@query("f6_cumulative_counts", with_rec("SELECT DISTINCT drift, sum(failure) OVER w AS tp, sum(1 - failure) OVER w AS fp FROM rec WINDOW w AS (ORDER BY drift DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def cumulative_counts(spark: SparkSession, d: str) -> DataFrame:
    w = Window.orderBy(F.col("drift").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    by = records(spark, d).groupBy("drift").agg(F.sum("failure").alias("p"), F.sum(1 - F.col("failure")).alias("q"))
    return by.select("drift", F.sum("p").over(w).alias("tp"), F.sum("q").over(w).alias("fp"))


@query("f7_group_residual", with_rec("SELECT dataset, backbone, tag, round(drift - avg(drift) OVER (PARTITION BY perturbation), 5) AS residual FROM rec"))
def group_residual(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("dataset", "backbone", "tag", rounded(F.col("drift") - F.avg("drift").over(Window.partitionBy("perturbation")), 5).alias("residual"))


@query("f8_halves", "SELECT label, count_if(r <= n // 2) AS first_half, count_if(r > n // 2) AS second_half FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings) GROUP BY label")
def halves(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("label")
    r = table(spark, d, "embeddings").select("label", F.row_number().over(w.orderBy("vec_id")).alias("r"), F.floor(F.count("*").over(w) / 2).alias("h"))
    return r.groupBy("label").agg(F.count_if(F.col("r") <= F.col("h")).alias("first_half"), F.count_if(F.col("r") > F.col("h")).alias("second_half"))


@query("f9_lag_delta", with_rec("SELECT dataset, backbone, tag, round(drift - lag(drift) OVER (PARTITION BY dataset, backbone ORDER BY tag), 6) AS delta FROM rec"))
def lag_delta(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("dataset", "backbone").orderBy("tag")
    return records(spark, d).select("dataset", "backbone", "tag", rounded(F.col("drift") - F.lag("drift").over(w)).alias("delta"))


# ---- G: sort, limit, top-k ----


@query("g1_g6_sorted_head", with_rec("SELECT dataset, backbone, tag, drift FROM rec ORDER BY drift DESC, dataset, backbone, tag LIMIT 10"))
def sorted_head(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: sort and limit become one bounded operator."""
    return records(spark, d).select("dataset", "backbone", "tag", "drift").orderBy(F.col("drift").desc(), "dataset", "backbone", "tag").limit(10)


@query("g2_by_absolute", with_rec("SELECT backbone, r, row_number() OVER (ORDER BY abs(r) DESC, backbone) AS place FROM (SELECT backbone, round(corr(drift, acc_drop), 6) AS r FROM rec GROUP BY backbone)"))
def by_absolute(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).groupBy("backbone").agg(rounded(correlation("drift", "acc_drop")).alias("r"))
    return r.select("backbone", "r", F.row_number().over(Window.orderBy(F.abs("r").desc(), "backbone")).alias("place"))


_ORDER = {"scale": 0, "add": 1, "roll": 2, "blend": 3}


@query("g3_category_order", with_rec("SELECT perturbation, row_number() OVER (ORDER BY o) AS place, n FROM (SELECT perturbation, count(*) AS n FROM rec GROUP BY 1) JOIN (VALUES " + ", ".join(f"('{k}', {v})" for k, v in _ORDER.items()) + ") v(p, o) ON perturbation = p"))
def category_order(spark: SparkSession, d: str) -> DataFrame:
    order = spark.createDataFrame(list(_ORDER.items()), "perturbation string, o int")
    n = records(spark, d).groupBy("perturbation").agg(F.count("*").alias("n")).join(F.broadcast(order), "perturbation")  # fixed rows
    return n.select("perturbation", F.row_number().over(Window.orderBy("o")).alias("place"), "n")


@query("g4_argmax_row", with_rec("SELECT backbone, arg_max(tag, drift) AS worst_tag, max(drift) AS worst FROM rec GROUP BY backbone"))
def argmax_row(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy("backbone").agg(F.max_by("tag", "drift").alias("worst_tag"), F.max("drift").alias("worst"))


@query("g5_g7_first_k", "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 3")
def first_k(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, d, "embeddings").select("label", "vec_id", F.row_number().over(w).alias("r")).filter("r <= 3").drop("r")


@query("g8_ranking_string", with_rec("SELECT dataset, string_agg(backbone, ' > ' ORDER BY m DESC, backbone) AS ranking FROM (SELECT dataset, backbone, round(avg(accuracy), 9) AS m FROM rec GROUP BY ALL) GROUP BY dataset"))
def ranking_string(spark: SparkSession, d: str) -> DataFrame:
    m = records(spark, d).groupBy("dataset", "backbone").agg(rounded(F.avg("accuracy"), 9).alias("m"))
    s = F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), "backbone")))
    return m.groupBy("dataset").agg(F.array_join(F.transform(s, lambda x: x["backbone"]), " > ").alias("ranking"))


# ---- H: sets ----


@query("h1_union_all", with_rec("SELECT tag, count(*) AS n FROM (SELECT tag FROM rec UNION ALL SELECT tag FROM rec WHERE failure = 1) GROUP BY tag"))
def union_all(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return r.select("tag").unionByName(r.filter("failure = 1").select("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("h2_keep_last", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def keep_last(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    return table(spark, d, "orders").withColumn("k", F.row_number().over(w)).filter("k = 1").select("o_custkey", "o_orderkey", "o_totalprice")


_SPECIES = "SELECT 'D' || (vec_id % 3) AS dataset, 's' || (label + vec_id % 3) AS species FROM embeddings"


def _species(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.concat(F.lit("D"), F.col("vec_id") % 3).alias("dataset"), F.concat(F.lit("s"), F.col("label") + F.col("vec_id") % 3).alias("species"))


@query("h3_intersection", f"SELECT species FROM ({_SPECIES}) WHERE dataset = 'D0' INTERSECT SELECT species FROM ({_SPECIES}) WHERE dataset = 'D2'")
def intersection(spark: SparkSession, d: str) -> DataFrame:
    s = _species(spark, d)
    return s.filter("dataset = 'D0'").select("species").intersect(s.filter("dataset = 'D2'").select("species"))


@query("h4_jaccard_of_sets", f"WITH s AS (SELECT DISTINCT * FROM ({_SPECIES})), n AS (SELECT dataset, count(*) AS n FROM s GROUP BY ALL) SELECT a.dataset AS x, b.dataset AS y, count(*) AS shared, any_value(na.n + nb.n) - count(*) AS united, round(count(*) / (any_value(na.n + nb.n) - count(*)), 6) AS jaccard FROM s a JOIN s b ON a.species = b.species AND a.dataset < b.dataset JOIN n na ON na.dataset = a.dataset JOIN n nb ON nb.dataset = b.dataset GROUP BY a.dataset, b.dataset")
def set_jaccard(spark: SparkSession, d: str) -> DataFrame:
    s = _species(spark, d).distinct()
    n = s.groupBy("dataset").agg(F.count("*").alias("n"))
    a, b = s.withColumnRenamed("dataset", "x"), s.withColumnRenamed("dataset", "y")
    shared = a.join(b, "species").filter("x < y").groupBy("x", "y").agg(F.count("*").alias("shared"))
    both = shared.join(n.select(F.col("dataset").alias("x"), F.col("n").alias("nx")), "x").join(n.select(F.col("dataset").alias("y"), F.col("n").alias("ny")), "y")
    return both.select("x", "y", "shared", (F.col("nx") + F.col("ny") - F.col("shared")).alias("united")).withColumn("jaccard", rounded(F.col("shared") / F.col("united")))


@query("h5_difference", f"SELECT species FROM ({_SPECIES}) WHERE dataset = 'D2' EXCEPT SELECT species FROM ({_SPECIES}) WHERE dataset = 'D0'")
def difference(spark: SparkSession, d: str) -> DataFrame:
    s = _species(spark, d)
    return s.filter("dataset = 'D2'").select("species").subtract(s.filter("dataset = 'D0'").select("species"))


@query("h6_distinct_pairs", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


# ---- I: scalar functions ----

_VALUES = ("2.0", "0.10", "mild", "12", "0.05", "1e-3", "severe", "30.50", "1e-7", "1234.56789", "0.000123456789", "-0.25", "1e-4", "2.5e9", "0.3000001")
_KEYS = ("2", "0.1", "mild", "12", "0.05", "0.001", "severe", "30.5", "1e-07", "1234.57", "0.000123457", "-0.25", "0.0001", "2500000000", "0.3")


@query("i1_severity_key", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in zip(_VALUES, _KEYS, strict=True)) + ") v(raw, key)")
def severity_keys(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in _VALUES], "raw string").select("raw", severity_key(F.col("raw")).alias("key"))


_TAGS = (("gaussian_blur", "12", "blur_12"), ("illumination", "0.5", "brightness_0_5"), ("red_channel_shift", "20", "color_shift_20"), ("resize", "2.0", "resize_2_0"), ("compound", "mild", "compound_mild"), ("compound_field", "severe", "compound_field_severe"), ("contrast", "0.25", "contrast_0_25"), ("rotation", "90", "rotation_90"), ("scratch", "3", "scratch_3"), ("jpeg", "30", "jpeg_30"), ("defocus_blur", "5", "defocus_5"), ("shot_noise", "60", "shot_noise_60"))


@query("i2_cache_tag", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _TAGS) + ") v(name, value, tag)")
def cache_tags(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([t[:2] for t in _TAGS], "name string, value string").select("name", "value", cache_tag(F.col("name"), F.col("value")).alias("tag"))


_FAMILIES = ("gaussian_blur", "illumination", "red_channel_shift", "resize", "compound", "compound_field", "contrast", "rotation", "scratch", "jpeg", "defocus_blur", "shot_noise")


@query("i3_family", "SELECT * FROM (VALUES " + ", ".join(f"('{t[2]}', '{f}')" for t, f in zip(_TAGS, _FAMILIES, strict=True)) + ") v(tag, family)")
def families(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(t[2],) for t in _TAGS], "tag string").select("tag", family(F.col("tag")).alias("family"))


_NAMES = (("  Pinus_sylvestris L.", "pinus sylvestris l", "pinus sylvestris l.", True), ("Fagus-Sylvatica", "fagus sylvatica", "fagus sylvatica", False), ("Quercus ÉLONGATA", "quercus elongata", "quercus élongata", False), ("Abies", "abies", "abies", False), ("Ulmus  Šmithœ/ﬁlia (Řř.)", "ulmus smith filia rr", "ulmus  šmithœ/ﬁlia (řř.)", False), ("Acer: O'Brien\tő", "acer obrien o", "acer: o'brien\tő", False))


@query("i4_i5_i6_species_names", "SELECT * FROM (VALUES " + ", ".join("('{}', '{}', '{}', {})".format(*[str(x).replace("'", "''") for x in row]) for row in _NAMES) + ") v(name, species, key, binomial)")
def species_names(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("name")
    return spark.createDataFrame([(t[0],) for t in _NAMES], "name string").select("name", normalize_species(n).alias("species"), norm_key(n).alias("key"), real_binomial(F.regexp_replace(F.trim(n), "_", " ")).alias("binomial"))


@query("i7_safe_tag", "SELECT doc_id, substr(regexp_replace(source || '/' || lang || '#' || doc_id, '[^A-Za-z0-9_-]', '_', 'g'), 1, 60) AS tag FROM documents")
def safe_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", safe_tag(F.concat("source", F.lit("/"), "lang", F.lit("#"), F.col("doc_id").cast("string"))).alias("tag"))


@query("i8_parent_folder", "SELECT DISTINCT p_brand AS parent, 'root/new/' || p_size AS moved FROM (SELECT p_brand, p_size FROM part)")
def parent_folder(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat_ws("/", F.lit("root"), "p_brand", F.col("p_size").cast("string"))
    parts = F.split("path", "/")
    return table(spark, d, "part").select(path.alias("path")).select(F.element_at(parts, -2).alias("parent"), F.concat_ws("/", F.element_at(parts, -3), F.lit("new"), F.element_at(parts, -1)).alias("moved")).distinct()


@query("i9_pair_names", with_rec("SELECT DISTINCT least(a.dataset, b.dataset) || '<->' || greatest(a.dataset, b.dataset) AS pair, a.dataset || '->' || b.dataset AS direction, a.dataset AS source FROM rec a JOIN rec b ON a.dataset <> b.dataset"))
def pair_names(spark: SparkSession, d: str) -> DataFrame:
    a = records(spark, d).select(F.col("dataset").alias("s")).distinct()
    both = a.crossJoin(a.withColumnRenamed("s", "t")).filter("s <> t")  # the few datasets
    named = both.select(F.concat_ws("<->", F.least("s", "t"), F.greatest("s", "t")).alias("pair"), F.concat_ws("->", "s", "t").alias("direction"))
    return named.withColumn("source", F.split("direction", "->")[0])


@query("i10_figure_group", with_rec("SELECT DISTINCT tag, CASE WHEN perturbation IN ('blend', 'roll') THEN 'mixing' ELSE 'intensity' END AS figure, CASE perturbation WHEN 'blend' THEN 100 WHEN 'add' THEN 200 WHEN 'roll' THEN 300 ELSE 400 END + severity::DOUBLE AS place FROM rec"))
def figure_group(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("perturbation")
    place = F.when(p == "blend", 100).when(p == "add", 200).when(p == "roll", 300).otherwise(400) + F.col("severity").cast("double")
    return records(spark, d).select("tag", F.when(p.isin("blend", "roll"), "mixing").otherwise("intensity").alias("figure"), place.alias("place")).distinct()


@query("i11_relative_drop", with_rec("SELECT dataset, backbone, tag, round(acc_clean - accuracy, 6) AS accuracy_drop, round(CASE WHEN acc_clean < 1e-10 THEN 0 ELSE (acc_clean - accuracy) / acc_clean END, 6) AS relative_drop FROM rec"))
def relative_drop(spark: SparkSession, d: str) -> DataFrame:
    drop = F.col("acc_clean") - F.col("accuracy")
    return records(spark, d).select("dataset", "backbone", "tag", rounded(drop).alias("accuracy_drop"), rounded(F.when(F.col("acc_clean") < 1e-10, 0.0).otherwise(drop / F.col("acc_clean"))).alias("relative_drop"))


@query("i13_math", with_rec("SELECT dataset, backbone, tag, round(log2(1 + drift), 6) AS l, round(exp(-drift), 6) AS e, round(sqrt(drift), 6) AS s, round(greatest(least(drift, 0.1), 0.01), 6) AS c, sign(acc_drop)::INT AS g FROM rec"))
def math(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("drift")
    return records(spark, d).select("dataset", "backbone", "tag", rounded(F.log2(1 + x)).alias("l"), rounded(F.exp(-x)).alias("e"), rounded(F.sqrt(x)).alias("s"), rounded(F.greatest(F.least(x, F.lit(0.1)), F.lit(0.01))).alias("c"), F.signum("acc_drop").cast("int").alias("g"))


@query("i14_stable_seeds", "SELECT vec_id, md5('7|' || vec_id) AS m, sha256('7|' || vec_id) AS s, ('0x' || substr(md5('7|' || vec_id), 1, 8))::BIGINT AS seed FROM embeddings")
def stable_seeds(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("7|"), F.col("vec_id").cast("string"))
    return table(spark, d, "embeddings").select("vec_id", F.md5(text).alias("m"), F.sha2(text, 256).alias("s"), F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long").alias("seed"))


@query("i15_json_encode", with_rec("SELECT tag, '{\"tag\":\"' || tag || '\",\"n\":' || count(*) || '}' AS json, string_agg(backbone || ':' || dataset, ';' ORDER BY backbone || ':' || dataset) AS pairs FROM rec GROUP BY tag"))
def json_encode(spark: SparkSession, d: str) -> DataFrame:
    g = records(spark, d).groupBy("tag").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "backbone", "dataset"))), ";").alias("pairs"))
    return g.select("tag", F.to_json(F.struct("tag", "n")).alias("json"), "pairs")


@query("i16_label_encode", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part")
def label_encode(spark: SparkSession, d: str) -> DataFrame:
    """Codes from the distinct labels alone; the rows are joined to that small table and never sorted as a whole."""
    p = table(spark, d, "part")
    codes = p.select("p_brand").distinct().withColumn("code", F.row_number().over(Window.orderBy("p_brand")) - 1)
    return p.join(codes, "p_brand").select("p_partkey", "code")


