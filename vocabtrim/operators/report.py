"""Result files, run logs and method comparison.

Everything here is a DataFrame job over files: CSVs are read with an explicit
schema, logs with ``wholetext`` (one row per file), and reports are written
with the DataFrame writer (``partitionBy`` per task where useful).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import locale_double, size_to_number

# Method columns of the two-header summary file, by position
# (train column, test column; None = the file has no train column for it).
SUMMARY_METHODS = [
    ("NO PRUNING", 2, 3), ("TRAIN TOKENS ONLY", 4, 5), ("RANDOM", 6, 7), ("CLUSTERING", 8, 9),
    ("FREQUENCY", 10, 11), ("ATTENTION", 12, 13), ("IMPORTANCE", 14, 15),
    ("FREQUENCY_OOV", None, 16), ("IMPORTANCE_OOV", None, 17),
]
SUMMARY_WIDTH = 19


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The two-header, comma-decimal summary file -> long ``(dataset, method, split, value)``.

    Columns are mapped by position (the first header row is one field longer
    than the data rows); header rows have an empty first field and drop out;
    missing trailing fields and unparsable values become 0.0 (P13).
    """
    schema = ", ".join(f"_c{i} string" for i in range(SUMMARY_WIDTH))
    raw = spark.read.csv(path, schema=schema, header=False, quote='"', mode="PERMISSIVE")
    rows = raw.filter(F.col("_c0").isNotNull() & (F.col("_c0") != ""))
    parts = [F.struct(F.lit("PAPER").alias("method"), F.lit("test").alias("split"),
                      locale_double(F.col("_c1")).alias("value"))]
    for method, tr, te in SUMMARY_METHODS:
        if tr is not None:
            parts.append(F.struct(F.lit(method).alias("method"), F.lit("train").alias("split"),
                                  locale_double(F.col(f"_c{tr}")).alias("value")))
        parts.append(F.struct(F.lit(method).alias("method"), F.lit("test").alias("split"),
                              locale_double(F.col(f"_c{te}")).alias("value")))
    return rows.select(F.col("_c0").alias("dataset"), F.explode(F.array(*parts)).alias("r")) \
               .select("dataset", "r.method", "r.split", "r.value")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern names anything, on whatever file system it lies."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(conf).globStatus(p))


def read_many_csv(spark: SparkSession, paths: Sequence[str], schema: str | None = None) -> DataFrame | None:
    """Read several CSV files with headers and union them by column name;
    paths that do not exist (on any Hadoop file system) are skipped, columns missing in a
    file are NULL.  With ``schema`` all files are one scan and no job infers types."""
    found = [p for p in paths if _exists(spark, p)]
    if not found:
        return None
    if schema:
        return spark.read.csv(found, header=True, schema=schema).withColumn("source_file", F.input_file_name())
    out = None
    for p in found:
        df = spark.read.csv(p, header=True, inferSchema=True).withColumn("source_file", F.lit(p))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def choose_logs(spark: SparkSession, root: str, tasks: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """The log of each task under ``root``: ``(task, path)``, null if there is none.

    ``patterns`` are relative paths in which ``{task}`` stands for the task and ``*`` for any
    characters of one name, the best first.  Among several logs of the best pattern that
    has any, the latest is taken, then the first by name.  Only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root) \
                 .select("path", F.col("modificationTime").alias("time"))
    found = []
    for i, p in enumerate(patterns):
        part = lambda x: "[^/]*".join(re.escape(y) for y in x.split("*"))
        before, after = p.split("{task}", 1)
        # later places of {task} must repeat the first
        regex = "/" + part(before) + "([^/]+?)" + part(after).replace(re.escape("{task}"), r"\1") + "$"
        found.append(F.struct(F.lit(i).alias("pattern"), F.regexp_extract("path", regex, 1).alias("task")))
    named = files.select("path", "time", F.explode(F.array(*found)).alias("m")).select("path", "time", "m.*")
    best = (named.filter(F.col("task") != "").join(tasks.select("task").distinct(), "task", "left_semi")
                 .groupBy("task").agg(F.min_by("path", F.struct("pattern", -F.unix_micros("time"), "path")).alias("path")))
    return tasks.select("task").distinct().join(best, "task", "left")


def scan_chosen_logs(spark: SparkSession, chosen: DataFrame) -> DataFrame:
    """The chosen logs ``(task, path, text)``; the other files are not opened."""
    paths = chosen.filter(F.col("path").isNotNull())
    listed = [r["path"] for r in paths.select("path").distinct().collect()]  # one a task
    if not listed:
        return spark.createDataFrame([], "task string, path string, text string")
    # both columns are file URIs, spelled with one or three slashes
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    logs = spark.read.text(listed, wholetext=True).select(plain(F.input_file_name()).alias("_p"), F.col("value").alias("text"))
    return paths.withColumn("_p", plain(F.col("path"))).join(logs, "_p").select("task", "path", "text")


def scan_logs(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per run log ``(path, text)``."""
    return spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"),
                                                           F.col("value").alias("text"))


# Numbers, section titles and metric names as run logs write them (here and in
# the patterns of parse_logs).
NUM = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
NUM_LEGACY = r"([0-9.]+)"


def parse_logs(logs: DataFrame, strict_legacy: bool = False) -> DataFrame:
    """Metrics of each log -> long ``(path, metric, value)``.

    ``eval_<m>: v`` -> ``val_<m>`` (last occurrence wins); pairs ``<m>: v`` in the
    test section -> ``test_<m>``; ``<Type> parameter reduction: v%`` in the
    parameter section -> ``<type>_param_reduction``; the first
    ``Vocabulary reduction: v%`` -> ``vocab_reduction``.  Sections end at a blank
    line, or also at the next ``===`` header unless ``strict_legacy`` (which also
    keeps the unsigned number pattern).  A value that is no number is NULL.
    """
    num = NUM_LEGACY if strict_legacy else NUM
    end = r"(?=\n\n|\Z)" if strict_legacy else r"(?=\n\n|\n[^\n]*===|\Z)"
    t = F.col("text")
    val = logs.select("path", F.posexplode(F.regexp_extract_all(t, F.lit(rf"eval_(\w+): {num}"), 0)).alias("i", "m"))
    val = val.select("path", "i", F.concat(F.lit("val_"), F.regexp_extract("m", rf"eval_(\w+): {num}", 1)).alias("metric"),
                     F.regexp_extract("m", rf"eval_(\w+): {num}", 2).try_cast("double").alias("value"))
    test_sec = F.regexp_extract(t, rf"(?s)=== Test Set Evaluation Results ===\n(.*?){end}", 1)
    tst = logs.select("path", F.posexplode(F.regexp_extract_all(test_sec, F.lit(rf"(\w+): {num}"), 0)).alias("i", "m"))
    tst = tst.select("path", (F.col("i") + 1_000_000).alias("i"),
                     F.concat(F.lit("test_"), F.regexp_extract("m", rf"(\w+): {num}", 1)).alias("metric"),
                     F.regexp_extract("m", rf"(\w+): {num}", 2).try_cast("double").alias("value"))
    par_sec = F.regexp_extract(t, rf"(?s)=== Parameter Reduction Statistics ===\n(.*?){end}", 1)
    par = logs.select("path", F.posexplode(F.regexp_extract_all(par_sec, F.lit(rf"(\w+) parameter reduction: {num}%"), 0))
                      .alias("i", "m"))
    par = par.select("path", (F.col("i") + 2_000_000).alias("i"),
                     F.concat(F.lower(F.regexp_extract("m", rf"(\w+) parameter reduction: {num}%", 1)),
                              F.lit("_param_reduction")).alias("metric"),
                     F.regexp_extract("m", rf"(\w+) parameter reduction: {num}%", 2).try_cast("double").alias("value"))
    voc = logs.select("path", F.lit(3_000_000).alias("i"), F.lit("vocab_reduction").alias("metric"),
                      F.regexp_extract(t, rf"Vocabulary reduction: {num}%", 1).alias("_v")) \
              .filter(F.col("_v") != "").select("path", "i", "metric", F.col("_v").try_cast("double").alias("value"))
    allm = val.unionByName(tst).unionByName(par).unionByName(voc)
    # last occurrence wins within a metric name (position order)
    return allm.groupBy("path", "metric").agg(F.max_by("value", "i").alias("value"))


def run_summary(metrics: DataFrame, key: str = "task") -> DataFrame:
    """One row per run: the test metrics with the parameter reductions
    (missing reductions -> 0), pivoted to columns."""
    names = ["total_param_reduction", "embedding_param_reduction", "model_only_param_reduction", "vocab_reduction"]
    wide = metrics.groupBy(key).pivot("metric").agg(F.first("value"))
    for n in names:
        if n not in wide.columns:
            wide = wide.withColumn(n, F.lit(0.0))
    return wide.fillna(0.0, subset=names)


def write_csv(df: DataFrame, path: str, by: Sequence[str] | None = None, mode: str = "overwrite") -> None:
    """CSV with a header, one folder per ``by`` value when given."""
    w = df.write.mode(mode).option("header", True)
    if by:
        w = w.partitionBy(*by)
    w.csv(path)


def write_predictions(df: DataFrame, path: str, regression: bool, value: str = "pred") -> None:
    """One prediction per line in example order; ``%d`` for labels, ``%.6f``
    for regression scores (the format follows the task type)."""
    fmt = F.format_string("%.6f", F.col(value).cast("double")) if regression else \
        F.format_string("%d", F.col(value).cast("long"))
    df.orderBy("example_id").select(fmt.alias("value")).write.mode("overwrite").text(path)


def write_encoded(df: DataFrame, path: str) -> None:
    """Encoded rows (``input_ids, attention_mask, labels``) as parquet."""
    df.write.mode("overwrite").parquet(path)


def format_report(df: DataFrame, int_cols: Sequence[str] = (), dec_cols: Sequence[str] = ()) -> DataFrame:
    """Thousands separators for counts, two decimals for percentages."""
    out = df
    for c in int_cols:
        out = out.withColumn(c, F.format_number(F.col(c).cast("double"), 0))
    for c in dec_cols:
        out = out.withColumn(c, F.format_number(F.col(c).cast("double"), 2))
    return out


def report_rows(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), sep: str = " & ", end: str = " \\\\") -> DataFrame:
    """The columns of a row joined into one line of report text, ``(by..., line)``; a
    missing value is empty."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return df.select(*by, F.concat(F.concat_ws(sep, *cells), F.lit(end)).alias("line"))


def wide_summary(drops: DataFrame, methods: Sequence[str], baseline: str = "NO PRUNING") -> DataFrame:
    """M15's table: ``dataset, size`` and for each method ``<method>_performance`` and, but for
    the baseline, ``<method>_drop`` (of rows ``dataset, size, method, value, drop_pp``)."""
    p = drops.groupBy("dataset", "size").pivot("method", list(methods)).agg(F.first("value").alias("v"), F.first("drop_pp").alias("d"))
    name = lambda m: m.lower().replace(" ", "_")
    cols = [F.col(f"`{m}_v`").alias(f"{name(m)}_performance") for m in methods]
    cols += [F.col(f"`{m}_d`").alias(f"{name(m)}_drop") for m in methods if m != baseline]
    return p.select("dataset", "size", *cols)


def split_pivot(stats: DataFrame, values: Sequence[str], splits: Sequence[str], key: str = "task",
                split_col: str = "split") -> DataFrame:
    """One row per ``key``; ``<value>_<split>`` = mean of the value in that split."""
    p = stats.groupBy(key).pivot(split_col, list(splits)).agg(*[F.avg(v).alias(v) for v in values])
    ren = {f"{s}_{v}": f"{v}_{s.lower()}" for s in splits for v in values}
    return p.select(key, *[F.col(c).alias(ren.get(c, c)) for c in p.columns if c != key])


def performance_drop(results: DataFrame, baseline: str = "NO PRUNING", split: str = "test") -> DataFrame:
    """Per dataset and method, ``(baseline - method) * 100`` percentage points,
    plus the difference to the published (``PAPER``) value."""
    r = results.filter(F.col("split") == split)
    base = r.filter(F.col("method") == baseline).select("dataset", F.col("value").alias("_b"))
    paper = r.filter(F.col("method") == "PAPER").select("dataset", F.col("value").alias("_p"))
    m = r.filter(F.col("method") != "PAPER").join(base, "dataset", "left").join(paper, "dataset", "left")
    return m.select("dataset", "method", "value",
                    F.when(F.col("method") != baseline, (F.col("_b") - F.col("value")) * 100).alias("drop_pp"),
                    ((F.col("value") - F.col("_p")) * 100).alias("vs_paper_pp"))


def with_sizes(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Attach the dataset size string (``N/A`` when unknown)."""
    sizes = tasks.select(F.upper(F.split("task", "-").getItem(0)).alias("dataset"), "size").dropDuplicates(["dataset"])
    return results.join(sizes, "dataset", "left").withColumn("size", F.coalesce("size", F.lit("N/A")))


def order_by_baseline(results: DataFrame, baseline: str = "NO PRUNING") -> DataFrame:
    """Datasets ranked by the baseline's value (descending); other rows follow."""
    from .ordering import with_row_number
    base = results.filter(F.col("method") == baseline).select("dataset", F.col("value").alias("_b")).distinct()
    rk = with_row_number(base, [F.col("_b").desc(), F.col("dataset").asc()], name="order").drop("_b")
    return results.join(rk, "dataset", "left")


def size_correlation(results: DataFrame, x: str, y: str, by: str = "method") -> DataFrame:
    """Per group, correlation and the degree-1 fit ``y = slope * x + intercept``."""
    slope = F.try_divide(F.covar_pop(y, x), F.var_pop(x))
    return results.groupBy(by).agg(safe_corr(x, y).alias("corr"), slope.alias("slope"),
                                   (F.avg(y) - slope * F.avg(x)).alias("intercept"),
                                   F.count(F.lit(1)).alias("n"))


def safe_corr(x: str, y: str):
    """Pearson correlation, NULL (not an error) when either side is constant
    (``corr`` raises on a zero variance under ANSI mode)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def log10_size(size: str = "size"):
    s = size_to_number(F.col(size))
    return F.when(s > 0, F.log10(s))
