"""One Spark query per operator, over the tables of a scale factor folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.text import tokens
from logloom.operators import aggregates, filters, iforest, joins, paging, textcluster, windows
from logloom.operators.normalize import normalize
from logloom.plans import analytics, dashboard, listings
from logloom.plans.ingest import ingest
from logloom.session import materialize, scratch_path
from logloom.sources import logs, tables
from logloom.schemas import LOG_ENTRIES, columns, project
from logloom.streaming import jobs

from . import views

Query = Callable[[SparkSession, str], DataFrame]

START, END = datetime(2024, 1, 10), datetime(2024, 1, 20, 12)
YEAR = 2024
CHUNK = 5000

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def files(spark, sf_dir):
    return views.view(spark, sf_dir, views.LOG_FILES)


def entries(spark, sf_dir):
    return views.view(spark, sf_dir, views.LOG_ENTRIES)


def parsed(spark, sf_dir, sql=views.RAW_LOGS):
    return normalize(views.view(spark, sf_dir, sql), reference_year=YEAR)


def hourly(spark, sf_dir):
    return windows.window_features(entries(spark, sf_dir), START, END, minutes=60)


def scored_hours(spark, sf_dir):
    """Hourly windows in the shape of the anomaly table, scored by their error rate."""
    return hourly(spark, sf_dir).select(
        "window_start", "window_end", (-F.col("error_rate")).alias("score"), F.col("error_rate").alias("anomaly_score")
    )


def errors(spark, sf_dir):
    return filters.error_messages(entries(spark, sf_dir))


def error_tokens(spark, sf_dir):
    return textcluster.tokenize(textcluster.fold_messages(errors(spark, sf_dir)))


def labelled(spark, sf_dir):
    """Error messages with TF-IDF vectors and a label that does not come from K-Means."""
    tokenized, vocab, _ = textcluster.prepare(errors(spark, sf_dir))
    vectors = textcluster.tfidf_vectors(tokenized, vocab)
    return vectors.withColumn("label", (F.length("message") % 4).cast("int")), vocab


def fixed_clusters(spark, sf_dir):
    return textcluster.cluster_table(*labelled(spark, sf_dir))


def write_log_files(spark, sf_dir):
    """The raw lines as text files of 5,000 lines each, in the shared folder."""
    path = scratch_path(spark, "raw-logs")
    lines = views.view(spark, sf_dir, views.RAW_LOGS)
    chunked = lines.select(F.floor(F.col("event_id") / CHUNK).alias("chunk"), "event_id", "raw_line")
    ordered = chunked.repartition("chunk").sortWithinPartitions("chunk", "event_id")
    ordered.select("chunk", "raw_line").write.partitionBy("chunk").text(path)
    return path


def chunk_of(path):
    return F.regexp_extract(path, "chunk=([0-9]+)", 1).cast("bigint").alias("chunk")


# Scans, sources, sinks


@query
def scan_raw(spark, sf_dir):
    return logs.read_logs(spark, write_log_files(spark, sf_dir)).select(chunk_of(F.col("stored_path")), "raw_line")


@query
def line_numbers(spark, sf_dir):
    lines = logs.with_line_number(logs.read_logs(spark, write_log_files(spark, sf_dir)))
    return lines.select(chunk_of(F.col("stored_path")), "line_number", "raw_line")


@query
def line_numbers_resplit(spark, sf_dir):
    """Lines read in small splits, then counted and numbered under the usual settings."""
    lines, size = logs.read_logs(spark, write_log_files(spark, sf_dir)), "spark.sql.files.maxPartitionBytes"
    usual = spark.conf.get(size)
    spark.conf.set(size, "100000")
    try:
        placed = logs.place_lines(lines)
    finally:
        spark.conf.set(size, usual)
    return logs.with_line_number(placed).select(chunk_of(F.col("stored_path")), "line_number", "raw_line")


@query
def admit_files(spark, sf_dir):
    accepted, refused = logs.admit_files(files(spark, sf_dir), max_mb=200)
    both = accepted.withColumn("admitted", F.lit(True)).unionByName(refused.withColumn("admitted", F.lit(False)))
    return both.select("id", "filename", "size_bytes", "admitted")


@query
def log_files(spark, sf_dir):
    listed = files(spark, sf_dir)
    tags = listed.where(F.col("source").isNotNull()).select(
        "filename", "source", "environment", F.lit("text").alias("log_type")
    )
    found = listed.select("id", "filename", "uploaded_at").withColumn("stored_path", F.col("filename"))
    return project(logs.register_files(found, tags), "log_files")


@query
def refused_files(spark, sf_dir):
    """Every file is too large: the batch job and the stream record why."""
    source, found = write_log_files(spark, sf_dir), []
    for origin in ("batch", "stream"):
        root = scratch_path(spark, "store")
        if origin == "batch":
            ingest(spark, source, root, max_mb=0)
        else:
            jobs.stream_ingest(spark, source, root, scratch_path(spark, "progress"), max_mb=0).awaitTermination()
        files_known = tables.load(spark, root, "log_files")
        found.append(files_known.select(F.lit(origin).alias("origin"), chunk_of(F.col("stored_path")), "status", "error"))
    return found[0].unionByName(found[1])


@query
def idempotent_new_rows(spark, sf_dir):
    arrived = entries(spark, sf_dir)
    stored = filters.by_level(arrived, "ERROR")
    return joins.new_entries(arrived.unionByName(arrived), stored).select("log_file_id", "line_number", "message")


@query
def file_summary(spark, sf_dir):
    return aggregates.file_summary(entries(spark, sf_dir))


@query
def replace_range(spark, sf_dir):
    every = windows.window_features(entries(spark, sf_dir), minutes=60)
    columns = ["window_start", "window_end", "total_count"]
    old = every.select(*columns, F.lit("old").alias("origin"))
    new = hourly(spark, sf_dir).select(*columns, F.lit("new").alias("origin"))
    return tables.replace_anomalies(old, new, filters.naive(START), filters.naive(END))


@query
def replaced_clusters(spark, sf_dir):
    """Clusters published after others: the earlier ones are gone."""
    root = scratch_path(spark, "store")
    found = fixed_clusters(spark, sf_dir).withColumns(
        {"pipeline_run_id": F.lit("run-1"), "created_at": F.lit(None).cast("timestamp_ntz")}
    )
    found = materialize(found, "clusters")
    tables.replace_clusters(found.withColumn("count", F.lit(0).cast("bigint")), root)
    tables.replace_clusters(found, root)
    return tables.load(spark, root, "error_clusters").drop("pipeline_run_id", "created_at")


@query
def analytics_totals(spark, sf_dir):
    """A run over a time range, run again: what is stored agrees with its record and covers every error."""
    root, every = scratch_path(spark, "store"), entries(spark, sf_dir)
    options = {"start": START, "end": END, "minutes": 60, "restarts": 2}
    analytics.run_analytics(spark, root, every, **options)
    run = analytics.run_analytics(spark, root, every, **options).first()
    found, clusters = tables.load(spark, root, "anomalies"), tables.load(spark, root, "error_clusters")
    outside = (F.col("window_start") < filters.naive(START)) | (F.col("window_start") > filters.naive(END))
    stored = found.agg(F.count("*").alias("anomalies"), F.count_if(outside).alias("outside"))
    summed = clusters.agg(F.count("*").alias("clusters"), F.sum("count").alias("messages"), F.min("first_seen").alias("first_seen"))
    return summed.withColumns({c: F.lit(v) for c, v in stored.first().asDict().items()}).select(
        F.lit(run["status"]).alias("status"),
        (F.col("anomalies") == run["anomalies_detected"]).alias("anomalies_agree"),
        (F.col("clusters") == run["clusters_created"]).alias("clusters_agree"),
        "outside",
        "messages",
        "first_seen",
    )


@query
def run_record(spark, sf_dir):
    root = scratch_path(spark, "store")
    found = aggregates.total(filters.by_level(entries(spark, sf_dir), "error")).first()["total"]
    args = (spark, root, "run-1", "manual", filters.utc_now())
    analytics.record_run(*args)
    analytics.record_run(*args, "failed", anomalies=found, error="x" * 3000)
    runs = tables.load(spark, root, "pipeline_runs")
    return runs.select(
        "trigger", "status", "anomalies_detected", F.length("error").cast("bigint").alias("error_length"),
        (F.col("finished_at") >= F.col("started_at")).alias("finished"),
    )


@query
def ingest_batch(spark, sf_dir):
    source, root = write_log_files(spark, sf_dir), scratch_path(spark, "store")
    ingest(spark, source, root, reference_year=YEAR)
    ingest(spark, source, root, reference_year=YEAR)
    return stored_entries(spark, root)


@query
def ingest_changed_file(spark, sf_dir):
    """The first file is written anew, with every other line, at its old path, and ingested again."""
    source, root = write_log_files(spark, sf_dir), scratch_path(spark, "store")
    ingest(spark, source, root, reference_year=YEAR)
    lines = views.view(spark, sf_dir, views.RAW_LOGS).where(f"event_id < {CHUNK} AND event_id % 2 = 0")
    fresh = scratch_path(spark, "raw-logs")
    lines.orderBy("event_id").coalesce(1).select("raw_line").write.text(fresh)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = fs.globStatus(path(f"{source}/chunk=0/part-*"))[0].getPath()
    fs.delete(old, False)
    fs.rename(fs.globStatus(path(f"{fresh}/part-*"))[0].getPath(), old)
    ingest(spark, source, root, reference_year=YEAR)
    return stored_entries(spark, root)


@query
def lossy_lines(spark, sf_dir):
    """Lines with bytes that are no UTF-8: each becomes one replacement character."""
    path = scratch_path(spark, "raw-logs")
    bad = F.expr("concat(event_type, cast(X'FF' as string), ' é ', cast(X'C3' as string))")
    spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(bad, F.lit(" "), F.col("event_id"))).write.text(path)
    return logs.read_logs(spark, path).select("raw_line")


def stored_entries(spark, root):
    stored = tables.load(spark, root, "log_entries")
    origin = tables.load(spark, root, "log_files").select(
        "id", chunk_of(F.col("stored_path")), F.col("status").alias("file_status"), "total_lines", "failed_lines"
    )
    return joins.join_files(stored, origin).select(
        "chunk", "line_number", "timestamp", "level", "service", "message", "raw_line", "parse_status",
        "parser_name", "file_status", "total_lines", "failed_lines",
    )


# Normalisation


@query
def normalize_all(spark, sf_dir):
    return parsed(spark, sf_dir)


def by_parser(name):
    def run(spark, sf_dir):
        found = parsed(spark, sf_dir).where(F.col("parser_name") == name)
        return found.select("event_id", "timestamp", "level", "service", "message", "parse_status", "parse_confidence")

    return run


QUERIES["normalize_json"] = by_parser("json_v1")
QUERIES["normalize_app"] = by_parser("app_v1")
QUERIES["normalize_android"] = by_parser("android_v1")
QUERIES["normalize_access"] = by_parser("access_v1")


@query
def failed_lines(spark, sf_dir):
    failed = parsed(spark, sf_dir).where(F.col("parse_status") == "failed")
    return failed.select("event_id", "raw_line", "parse_error", "parse_confidence", "parser_name")


@query
def normalize_android_brief(spark, sf_dir):
    return parsed(spark, sf_dir, views.BRIEF_LOGS).select(
        "event_id", "timestamp", "level", "service", "message", "parse_status", "parse_confidence", "parser_name"
    )


@query
def json_alias(spark, sf_dir):
    return parsed(spark, sf_dir, views.ALIAS_LOGS).select("event_id", "level", "service", "message")


@query
def json_ts(spark, sf_dir):
    return parsed(spark, sf_dir, views.TIME_LOGS).select("event_id", "timestamp", "parse_confidence")


@query
def json_confidence(spark, sf_dir):
    return parsed(spark, sf_dir, views.FIELD_LOGS).select("event_id", "parse_status", "parse_confidence")


# Filters, joins, pages


@query
def filter_time(spark, sf_dir):
    return filters.by_time(entries(spark, sf_dir), START, END)


@query
def filter_default_range(spark, sf_dir):
    return filters.by_time(entries(spark, sf_dir), *filters.default_range(end=END))


@query
def filter_level(spark, sf_dir):
    return filters.by_level(entries(spark, sf_dir), "warn")


@query
def filter_service(spark, sf_dir):
    return filters.by_service(entries(spark, sf_dir), "svc-7")


@query
def filter_source_env(spark, sf_dir):
    return filters.by_file_tags(entries(spark, sf_dir), files(spark, sf_dir), source="app", environment="staging")


@query
def filter_keyword(spark, sf_dir):
    return filters.by_keyword(entries(spark, sf_dir), "TIME_ut for%code 1")


@query
def filter_file(spark, sf_dir):
    return filters.by_file(entries(spark, sf_dir), 3)


def _filtered(spark, sf_dir):
    return filters.query_entries(
        entries(spark, sf_dir), files(spark, sf_dir),
        start=START, end=END, level="error", environment="prod", keyword="USER",
    )


@query
def entries_page(spark, sf_dir):
    return project(paging.newest_first(_filtered(spark, sf_dir), 10, 20), "log_entries")


@query
def entries_far_page(spark, sf_dir):
    every = entries(spark, sf_dir)
    far = every.count() - every.count() // 20
    return project(paging.newest_first(every, far, 100), "log_entries")


@query
def stored_far_page(spark, sf_dir):
    """The same page of stored entries, found by the counts of the days."""
    every, root = entries(spark, sf_dir), scratch_path(spark, "store")
    absent = {c: F.lit(None) for c in columns(LOG_ENTRIES) if c not in every.columns}
    tables.append_entries(every.withColumns(absent), root, "one", cluster_by_day=True)
    total = every.count()
    page = listings.stored_entries(spark, root, total - total // 20, 100)
    return page.items.select("log_file_id", "line_number", "timestamp", "level", "service", "message", "parse_status")


@query
def entries_total(spark, sf_dir):
    return aggregates.total(_filtered(spark, sf_dir))


@query
def page_count(spark, sf_dir):
    counted = aggregates.counts_by(entries(spark, sf_dir), "service")
    return counted.select("service", paging.page_count(F.col("count"), paging.DEFAULT_LIMIT).alias("pages"))


@query
def files_page(spark, sf_dir):
    return project(paging.newest_files(filters.list_files(files(spark, sf_dir), "processed"), 1, 4), "log_files")


@query
def file_by_id(spark, sf_dir):
    return project(filters.get_file(files(spark, sf_dir), 5), "log_files")


@query
def anomalies_page(spark, sf_dir):
    listed = filters.list_anomalies(scored_hours(spark, sf_dir), datetime(2024, 1, 12), datetime(2024, 1, 18))
    return project(paging.most_anomalous(listed, 5, 25), "anomalies")


@query
def clusters_page(spark, sf_dir):
    return project(paging.largest_clusters(fixed_clusters(spark, sf_dir), 1, 2), "error_clusters")


@query
def error_messages(spark, sf_dir):
    return filters.error_messages(entries(spark, sf_dir), START, END)


@query
def anomaly_drilldown(spark, sf_dir):
    bad = hourly(spark, sf_dir).where(F.col("error_rate") >= 0.25)
    found = joins.entries_in_windows(bad.select("window_start", "window_end"), entries(spark, sf_dir), minutes=60)
    return found.select("window_start", "id", "timestamp", "level", "service")


@query
def cascade_semi(spark, sf_dir):
    kept = filters.list_files(files(spark, sf_dir), "processed")
    return joins.drop_orphans(entries(spark, sf_dir), kept).select("id", "log_file_id", "line_number")


# Aggregates and windows


@query
def stats_totals(spark, sf_dir):
    return aggregates.totals(entries(spark, sf_dir), files(spark, sf_dir))


@query
def level_breakdown(spark, sf_dir):
    return aggregates.level_breakdown(entries(spark, sf_dir))


@query
def top_services(spark, sf_dir):
    return aggregates.top_services(entries(spark, sf_dir))


@query
def stats_summary(spark, sf_dir):
    return aggregates.stats_summary(entries(spark, sf_dir), files(spark, sf_dir))


@query
def window_features(spark, sf_dir):
    return windows.window_features(entries(spark, sf_dir), START, END)


@query
def window_features_hourly(spark, sf_dir):
    return hourly(spark, sf_dir)


@query
def log_timeline(spark, sf_dir):
    return windows.log_timeline(entries(spark, sf_dir))


@query
def score_histogram(spark, sf_dir):
    return windows.score_histogram(scored_hours(spark, sf_dir))


# Analytics


@query
def anomaly_scores(spark, sf_dir):
    scored = iforest.fit_score_iforest(hourly(spark, sf_dir))
    return scored.select("window_start", "window_end", *iforest.FEATURE_KEYS, "score_samples")


@query
def anomalies(spark, sf_dir):
    found = analytics.anomaly_rows(iforest.fit_score_iforest(windows.window_features(entries(spark, sf_dir), START, END)))
    return found.select("window_start", "window_end", "score", "anomaly_score", "features.*", "description")


def fixed_forest(windows_of: DataFrame) -> DataFrame:
    """Ten complete trees of depth three, cut at fixed parts of each measure's range, instead of drawn ones."""
    ends = windows_of.agg(
        F.array(*[F.min(k).cast("double") for k in iforest.FEATURE_KEYS]).alias("low"),
        F.array(*[F.max(k).cast("double") for k in iforest.FEATURE_KEYS]).alias("high"),
    ).first()
    low, high = (F.array(*map(F.lit, ends[c])) for c in ("low", "high"))
    nodes = windows_of.sparkSession.range(150).selectExpr("cast(id div 15 as int) AS tree", "cast(id % 15 as int) AS node")
    inner = F.col("node") < 7
    place, part = (F.col("tree") + F.col("node")) % 5, ((F.col("tree") * 7 + F.col("node") * 3) % 10 + 0.5) / 10
    return nodes.select(
        "tree",
        "node",
        F.when(inner, place).otherwise(-1).alias("feature"),
        F.when(inner, F.get(low, place) + part * (F.get(high, place) - F.get(low, place))).otherwise(0.0).alias("cut"),
        F.when(inner, 2 * F.col("node") + 1).otherwise(-1).alias("child"),
        F.when(inner, 0.0).otherwise(3 + F.col("node") % 4 * 0.75).alias("value"),
    )


def forest_scored(spark, sf_dir):
    found = materialize(hourly(spark, sf_dir), "hourly")
    return iforest.score_windows(found, fixed_forest(found), found.count())


@query
def forest_scores(spark, sf_dir):
    return forest_scored(spark, sf_dir).select("window_start", F.round("score_samples", 9).alias("score_samples"))


@query
def forest_anomalies(spark, sf_dir):
    scored = forest_scored(spark, sf_dir).withColumn("score_samples", F.round("score_samples", 9))
    found = analytics.anomaly_rows(materialize(scored, "scored"))
    rounded = [F.round(c, 8).alias(c) for c in ("score", "anomaly_score")]
    return found.select("window_start", "window_end", *rounded, "features.total_count", "features.error_rate")


@query
def cluster_nearest(spark, sf_dir):
    """Every error message with its copies, and whether no centre is nearer than that of its own cluster."""
    assigned, vocab = textcluster.assign_clusters(errors(spark, sf_dir))
    centers = materialize(textcluster.center_weights(assigned), "centers")
    lengths = centers.groupBy("label").agg(F.sum(F.col("weight") * F.col("weight")).alias("square"))
    labels = F.array(*[F.struct(F.lit(r["label"]).alias("to"), F.lit(r["square"]).alias("square")) for r in lengths.collect()])
    vector = F.unwrap_udt("features")
    parts = assigned.select("message", F.explode(F.arrays_zip(vector["indices"], vector["values"])).alias("e"))
    met = parts.join(F.broadcast(centers), F.col("e.indices") == F.col("index"))
    shared = met.groupBy("message", F.col("label").alias("to")).agg(F.sum(F.col("e.values") * F.col("weight")).alias("shared"))
    every = assigned.select("message", "copies", "label", F.explode(labels).alias("c")).select("message", "copies", "label", "c.*")
    far = F.col("square") - 2 * F.coalesce("shared", F.lit(0.0))
    each = every.join(shared, ["message", "to"], "left").withColumn("far", far)
    own = F.min(F.when(F.col("label") == F.col("to"), F.col("far")))
    return each.groupBy("message", "copies").agg((own <= F.min("far") + 1e-3).alias("nearest"))


@query
def anomaly_cut(spark, sf_dir):
    readings = views.events(spark, sf_dir).select("event_id", "value")
    flagged = iforest.flag_anomalies(readings, 0.1, "value")
    return flagged.select("event_id", F.round("score", 6).alias("score"))


@query
def anomaly_description(spark, sf_dir):
    text = iforest.describe_window(
        F.col("total_count"), F.col("error_rate"), F.col("error_count"), F.col("unique_services")
    )
    return hourly(spark, sf_dir).select("window_start", text.alias("description"))


@query
def term_df(spark, sf_dir):
    return textcluster.term_counts(error_tokens(spark, sf_dir))


@query
def term_df_documents(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = documents.select(F.lit(1).alias("copies"), tokens(F.col("text"), []).alias("tokens"))
    return textcluster.term_counts(rows)


@query
def tfidf_weights(spark, sf_dir):
    tokenized = error_tokens(spark, sf_dir)
    weights = textcluster.tfidf_weights(tokenized, textcluster.vocabulary(tokenized))
    return weights.select("message", "term", F.round("weight", 9).alias("weight"))


@query
def tfidf_conversations(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = turns.select("conv_id", "turn", F.lit(1).alias("copies"), tokens(F.col("text"), []).alias("tokens"))
    keyed = rows.withColumn("key", F.format_string("%d-%d", "conv_id", "turn"))
    weights = textcluster.tfidf_weights(keyed, textcluster.vocabulary(rows), "key")
    return weights.select("key", "term", F.round("weight", 9).alias("weight"))


@query
def cluster_k(spark, sf_dir):
    counted = aggregates.counts_by(errors(spark, sf_dir), "service")
    return counted.select("service", "count", textcluster.choose_k(F.col("count")).alias("k"))


@query
def error_cluster_assign(spark, sf_dir):
    assigned, _ = textcluster.assign_clusters(errors(spark, sf_dir))
    return assigned.select("message", "copies", "label")


@query
def error_clusters(spark, sf_dir):
    return project(analytics.cluster_rows(errors(spark, sf_dir)), "error_clusters")


@query
def cluster_table(spark, sf_dir):
    return fixed_clusters(spark, sf_dir)


@query
def cluster_keywords(spark, sf_dir):
    keywords = dashboard.keyword_list(F.col("keywords"))
    return fixed_clusters(spark, sf_dir).select("label", F.posexplode(keywords).alias("place", "keyword"))


@query
def run_analytics(spark, sf_dir):
    root = scratch_path(spark, "store")
    analytics.run_analytics(spark, root, entries(spark, sf_dir), "manual", START, END, minutes=60)
    return project(tables.load(spark, root, "pipeline_runs"), "pipeline_runs").drop("id")


# Dashboard


@query
def headline(spark, sf_dir):
    return dashboard.headline(entries(spark, sf_dir), files(spark, sf_dir))


@query
def level_share(spark, sf_dir):
    return dashboard.level_share(entries(spark, sf_dir))


@query
def anomaly_timeline(spark, sf_dir):
    return dashboard.anomaly_timeline(scored_hours(spark, sf_dir))


@query
def anomaly_rate_volume(spark, sf_dir):
    return dashboard.rate_and_volume(hourly(spark, sf_dir))


@query
def log_composition(spark, sf_dir):
    features = hourly(spark, sf_dir)
    return dashboard.log_composition(features, features.where(F.col("error_rate") > 0.3))


@query
def service_activity(spark, sf_dir):
    return dashboard.service_activity(hourly(spark, sf_dir))


@query
def top_clusters(spark, sf_dir):
    return dashboard.top_clusters(fixed_clusters(spark, sf_dir))


# Streaming


@query
def stream_ingest(spark, sf_dir):
    source, root = write_log_files(spark, sf_dir), scratch_path(spark, "store")
    run = jobs.stream_ingest(spark, source, root, scratch_path(spark, "progress"), reference_year=YEAR)
    run.awaitTermination()
    return stored_entries(spark, root)


@query
def stream_window_features(spark, sf_dir):
    schema = views.events(spark, sf_dir).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    features = jobs.stream_window_features(views.spark_view(spark, views.LOG_ENTRIES, stream), minutes=60)
    path = scratch_path(spark, "stream-windows")
    run = (
        features.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", scratch_path(spark, "progress"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(features.schema).parquet(path)


@query
def stream_late_windows(spark, sf_dir):
    """Every fiftieth entry arrives in a second batch; the hours it is too late for are counted again."""
    every = entries(spark, sf_dir).select("id", "timestamp", "level", "service")
    first, second, path, root = every.where("id % 50 <> 0"), every.where("id % 50 = 0"), scratch_path(spark, "arrived"), scratch_path(spark, "store")
    late_of = scratch_path(spark, "progress")
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(every.schema).parquet(path)
        jobs.stream_late_windows(stream, root, late_of, minutes=60).awaitTermination()
    features = windows.window_features(first, minutes=60)
    return jobs.repair_windows(features, jobs.late_windows(spark, root), every, minutes=60)
