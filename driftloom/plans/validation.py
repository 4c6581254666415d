"""Validation queries (V), the table function, sinks that commit as a whole, and the remaining scans."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.plans.base import SHIFTS, clean_bank, correlation, records, rounded, shifted_bank, with_clean, with_rec, with_units
from driftloom.plans.metrics import _F1, CURVE, _auc_sql, average_precision, best_f1, roc_auc, scored
from driftloom.registry import query
from driftloom.sources.store import fresh_folder, table

#: Columns and least rows that written tables must have.
SPECS = (("records", ("dataset", "backbone", "tag", "drift", "acc_drop"), 84), ("bank", ("dataset", "backbone", "vec_id", "label", "x"), 100))


@query("v1_table_specs", "SELECT * FROM (VALUES ('records', true, true), ('bank', true, true)) v(name, has_columns, enough_rows)")
def table_specs(spark: SparkSession, d: str) -> DataFrame:
    found = {"records": records(spark, d), "bank": clean_bank(spark, d)}
    out = None
    for name, columns, least in SPECS:
        row = found[name].agg(F.lit(name).alias("name"), F.lit(set(columns) <= set(found[name].columns)).alias("has_columns"), (F.count("*") >= least).alias("enough_rows"))
        out = row if out is None else out.unionByName(row)
    return out


@query("v2_bank_integrity", with_clean("SELECT dataset, backbone, count(*) AS n, count_if(label IS NULL) AS no_label, count_if(len(x) <> 16) AS bad_length, count(*) - count(DISTINCT vec_id) AS repeated FROM clean GROUP BY ALL"))
def bank_integrity(spark: SparkSession, d: str) -> DataFrame:
    return clean_bank(spark, d).groupBy("dataset", "backbone").agg(F.count("*").alias("n"), F.count_if(F.col("label").isNull()).alias("no_label"), F.count_if(F.size("x") != 16).alias("bad_length"), (F.count("*") - F.countDistinct("vec_id")).alias("repeated"))


@query("v3_recomputed", with_rec("SELECT count(*) AS n, count_if(abs((acc_clean - accuracy) - acc_drop) > 1e-8) AS wrong_drop, count_if((acc_drop > 0.2)::INT <> failure) AS wrong_failure FROM rec"))
def recomputed(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return r.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("acc_clean") - F.col("accuracy") - F.col("acc_drop")) > 1e-8).alias("wrong_drop"), F.count_if((F.col("acc_drop") > 0.2).cast("int") != F.col("failure")).alias("wrong_failure"))


@query("v4_mmd_identity", with_rec("SELECT count(*) AS n, 0 AS violations FROM rec"))
def mmd_identity(spark: SparkSession, d: str) -> DataFrame:
    from driftloom.operators.detectors import CAP, mmd_terms
    from driftloom.plans.shift import KEY, _sides

    t = mmd_terms(_sides(spark, d), KEY, 2 * CAP)
    bad = F.abs(F.greatest(F.col("k_aa") + F.col("k_bb") - 2 * F.col("k_ab"), F.lit(0.0)) - F.col("mmd2")) > 1e-12
    return t.agg(F.count("*").alias("n"), F.count_if(bad).cast("int").alias("violations"))


@query("v5_row_counts", with_rec("SELECT count(*) AS records, count(DISTINCT tag) AS conditions, count(DISTINCT backbone) * count(DISTINCT dataset) * count(DISTINCT tag) = count(*) AS complete FROM rec"))
def row_counts(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return r.agg(F.count("*").alias("records"), F.countDistinct("tag").alias("conditions"), (F.countDistinct("backbone") * F.countDistinct("dataset") * F.countDistinct("tag") == F.count("*")).alias("complete"))


@query("v6_relabel", "SELECT vec_id, dense_rank() OVER (ORDER BY name) - 1 AS label FROM (SELECT vec_id, CASE label WHEN 3 THEN 'c1' WHEN 7 THEN 'c2' ELSE 'c' || label END AS name FROM embeddings)")
def relabel(spark: SparkSession, d: str) -> DataFrame:
    """Old names to new ones by a fixed map; a name with two targets is an error; codes are made anew from the sorted names."""
    overrides = spark.createDataFrame([("c3", "c1"), ("c7", "c2")], "name string, new string")
    if overrides.groupBy("name").agg(F.countDistinct("new").alias("n")).filter("n > 1").count():
        raise ValueError("a label has two new names")
    rows = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("c"), "label").alias("name")).join(F.broadcast(overrides), "name", "left")  # two fixed rows
    named = rows.select("vec_id", F.coalesce("new", "name").alias("name"))
    names = named.agg(F.array_sort(F.collect_set("name")).alias("names"))  # the few classes
    return named.crossJoin(F.broadcast(names)).select("vec_id", (F.array_position("names", F.col("name")) - 1).cast("long").alias("label"))


@query("v7_mapping_check", "SELECT CASE WHEN label < 4 THEN 'direct' WHEN label < 8 THEN 'parent' ELSE 'missing' END AS kind, count(*) AS n FROM embeddings GROUP BY 1")
def mapping_check(spark: SparkSession, d: str) -> DataFrame:
    """Each row's way to a name: its own key, its parent's, or none."""
    own = spark.createDataFrame([(i, f"s{i}") for i in range(4)], "label int, own string")
    parent = spark.createDataFrame([(i, f"p{i}") for i in range(4, 8)], "label int, parent string")
    e = table(spark, d, "embeddings").select("label").join(F.broadcast(own), "label", "left").join(F.broadcast(parent), "label", "left")  # fixed rows
    return e.groupBy(F.when(F.col("own").isNotNull(), "direct").when(F.col("parent").isNotNull(), "parent").otherwise("missing").alias("kind")).agg(F.count("*").alias("n"))


@query("v9_without_dataset", with_rec("SELECT count(*) AS n, round(corr(drift, acc_drop), 6) AS r, round(avg(failure), 6) AS failure_rate FROM rec WHERE dataset <> 'D1'"))
def without_dataset(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).filter("dataset <> 'D1'").agg(F.count("*").alias("n"), rounded(correlation("drift", "acc_drop")).alias("r"), rounded(F.avg("failure")).alias("failure_rate"))


class RocPoints:
    """Table function: the points of a ROC curve from arrays of scores and labels."""

    def eval(self, scores: list, labels: list) -> Iterator[tuple[float, float, float]]:
        pos = sum(labels)
        neg = len(labels) - pos
        tp = fp = 0
        rows = sorted(zip(scores, labels, strict=True), reverse=True)
        for i, (s, y) in enumerate(rows):
            tp += y
            fp += 1 - y
            if i + 1 == len(rows) or rows[i + 1][0] != s:
                yield float(s), fp / max(neg, 1), tp / max(pos, 1)


@query("u1_roc_points_udtf", with_rec("") + CURVE + "SELECT detector, score, (fp / n)::DOUBLE AS fpr, (tp / p)::DOUBLE AS tpr FROM cv")
def roc_points(spark: SparkSession, d: str) -> DataFrame:
    """A Python table function beside the records of each detector (as many as there are conditions)."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("roc_points", udtf(RocPoints, returnType="score double, fpr double, tpr double"))
    scored(spark, d).groupBy("detector").agg(F.collect_list(F.struct("score", "failure")).alias("r")).select("detector", F.col("r.score").alias("s"), F.col("r.failure").alias("f")).createOrReplaceTempView("roc_input")
    return spark.sql("SELECT detector, p.score, p.fpr, p.tpr FROM roc_input, LATERAL roc_points(s, f) p")


@query("m_all_detectors", with_rec("") + CURVE + f", a AS ({_auc_sql('detector', 1)}), p AS (SELECT detector, round(sum(dp / p * tp / (tp + fp)), 6) AS avg_precision FROM cv GROUP BY detector), f AS (SELECT detector, round(f1, 6) AS best_f1, score AS best_threshold FROM (SELECT *, round({_F1}, 12) AS f1, row_number() OVER (PARTITION BY detector ORDER BY round({_F1}, 12) DESC, score) AS k FROM cv) WHERE k = 1) SELECT a.detector, auc, count, avg_precision, best_f1, best_threshold FROM a JOIN p ON a.detector = p.detector JOIN f ON a.detector = f.detector")
def all_detectors(spark: SparkSession, d: str) -> DataFrame:
    """The detector table: AUC, average precision, best F1 and its threshold."""
    return roc_auc(spark, d).join(average_precision(spark, d), "detector").join(best_f1(scored(spark, d), ["detector"]).withColumn("best_f1", rounded(F.col("best_f1"))), "detector")


@query("a4_first_existing_root", "SELECT count(*) AS n FROM embeddings")
def first_existing(spark: SparkSession, d: str) -> DataFrame:
    """The first of several roots that exists, asked of the file system that Spark uses."""
    for root in (f"{d}/no_such_folder", d):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/embeddings.parquet")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.read.parquet(f"{root}/embeddings.parquet").agg(F.count("*").alias("n"))
    raise FileNotFoundError(d)


@query("a5_binary_scan", None)
def binary_scan(spark: SparkSession, d: str) -> DataFrame:
    """Files as rows, with the label from the parent folder's rank; contents are read only if asked for."""
    files = spark.read.format("binaryFile").load(f"{d}/n*.parquet")
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file"), "length")


@query("a10_nested_scan", "SELECT vec_id, CAST(embedding[9] AS DOUBLE) AS second_row_first FROM embeddings")
def nested_scan(spark: SparkSession, d: str) -> DataFrame:
    """A map as rows of cells, as heatmap banks hold it, written and read nested."""
    path = fresh_folder(spark)
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice(F.col("embedding").cast("array<double>"), r * 8 + 1, 8))
    table(spark, d, "embeddings").select("vec_id", rows.alias("map")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select("vec_id", F.col("map")[1][0].alias("second_row_first"))


@query("a12_a14_committed_write", with_rec("SELECT perturbation, count(*) AS n FROM rec GROUP BY perturbation"))
def committed_write(spark: SparkSession, d: str) -> DataFrame:
    """A partitioned write appears as a whole: readers look for the marker of Spark's commit."""
    path = fresh_folder(spark)
    records(spark, d).write.mode("overwrite").partitionBy("perturbation").parquet(path)
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        raise RuntimeError("the write was not committed")
    return spark.read.parquet(path).groupBy("perturbation").agg(F.count("*").alias("n"))


@query("c13_ordered_pairs", with_rec("SELECT a.dataset AS x, b.dataset AS y, count(*) AS n, round(avg(a.drift - b.drift), 6) AS gap FROM rec a JOIN rec b ON a.backbone = b.backbone AND a.tag = b.tag AND a.dataset <> b.dataset GROUP BY ALL"))
def ordered_pairs(spark: SparkSession, d: str) -> DataFrame:
    a = records(spark, d).select("backbone", "tag", F.col("dataset").alias("x"), F.col("drift").alias("u"))
    b = records(spark, d).select("backbone", "tag", F.col("dataset").alias("y"), F.col("drift").alias("v"))
    return a.join(b, ["backbone", "tag"]).filter("x <> y").groupBy("x", "y").agg(F.count("*").alias("n"), rounded(F.avg(F.col("u") - F.col("v"))).alias("gap"))


@query("e16_group_vector_mean", with_clean("SELECT dataset, backbone, label, count(*) AS n, round(avg(x[1]), 6) AS m1, round(avg(x[8]), 6) AS m8 FROM clean GROUP BY ALL"))
def group_vector_mean(spark: SparkSession, d: str) -> DataFrame:
    """The vector summariser as a typed aggregate, combined before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    m = clean_bank(spark, d).groupBy("dataset", "backbone", "label").agg(F.count("*").alias("n"), vector_to_array(Summarizer.mean(array_to_vector("x"))).alias("m"))
    return m.select("dataset", "backbone", "label", "n", rounded(F.col("m")[0]).alias("m1"), rounded(F.col("m")[7]).alias("m8"))


@query("v_shift_coverage", with_units("SELECT dataset, backbone, tag, count(*) AS n, count(DISTINCT vec_id) AS ids FROM shifted GROUP BY ALL"))
def shift_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every condition: each has one for every clean vector. A vector's conditions are counted in one row, not each in its own."""
    tags = [f"{name}_{severity.replace('.', '_')}" for name, severity, _ in SHIFTS]
    by = shifted_bank(spark, d).groupBy("dataset", "backbone", "vec_id").agg(*[F.count_if(F.col("tag") == t).alias(t) for t in tags])
    each = by.unpivot(["dataset", "backbone", "vec_id"], tags, "tag", "rows").filter("rows > 0")
    return each.groupBy("dataset", "backbone", "tag").agg(F.sum("rows").alias("n"), F.count("vec_id").alias("ids"))
