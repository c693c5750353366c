"""Queries that write a relation in a file format and read it back: sinks and sources together, against the relation itself."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..sources import archives, files, tables
from . import sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sql.query("manifest_scan")(spark, sf_dir)
    text = [F.col(c).cast("string") for c in ("sample_token", "scene_token")]
    rows = m.select(*text, F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp"), "split", "domain_id", "domain_name", "location", "ego_speed", "agent_count", "teacher_loss", "teacher_uncertainty")
    sinks.write_jsonl(rows, path := sinks.scratch(spark, "manifest"))
    return tables.read_manifest(spark, path).select("sample_token", "timestamp", "split", "domain_id", "location", "ego_speed", "agent_count", "teacher_loss", "teacher_uncertainty", "metadata")


def label_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("sample_token"), F.col("quality").cast("string").alias("domain_label"))
    lines = labels.select("sample_token", F.when(F.col("sample_token").endswith("7"), F.lit(None)).otherwise(F.col("domain_label")).alias("domain_label"), F.concat(F.lit("c"), "domain_label").alias("cluster_label"))
    sinks.write_jsonl(lines, a := sinks.scratch(spark, "labels"))
    sinks.write_csv(labels, b := sinks.scratch(spark, "labels") + ".csv")
    by_line, by_csv = tables.read_labels(spark, a), tables.read_label_sidecar(spark, b)
    return by_line.withColumn("way", F.lit("lines")).unionByName(by_csv.withColumn("way", F.lit("csv")))


def submission_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sql.query("map_submission")(spark, sf_dir)
    vector = F.array(F.array(F.col("lo_x"), F.lit(0.0)), F.array(F.col("hi_x"), F.lit(1.0)))
    lines = p.select((F.col("line") % 20).cast("string").alias("token"), vector.alias("vector"), (F.col("line") / 1000).alias("score"), "label")
    packed = sinks.map_submission(lines).select(F.col("token").alias("key"), F.struct("vectors", "scores", "labels").alias("value"))
    # one document, as the format asks for: bounded by the number of evaluated frames
    doc = packed.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("results"))).alias("value"))
    doc.coalesce(1).write.text(path := sinks.scratch(spark, "submission"))
    return tables.read_submission(spark, path).select("token", F.col("place").cast("long").alias("place"), F.round("score", 6).alias("score"), "label", F.size("vector").cast("long").alias("points"))


def eval_log_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    line = F.format_string("{'obj_col': 0.5, 'obj_box_col': %s, 'L2': %s}", F.round("value", 2).cast("string"), F.col("event_id").cast("string"))
    noise = F.when(F.col("event_type") == "view", F.lit("step 12, loss 0.5")).otherwise(line)
    logs = e.select(F.col("user_id").alias("user"), noise.alias("value"), "event_id").repartition("user").sortWithinPartitions("user", "event_id")
    logs.select("user", "value").write.partitionBy("user").text(path := sinks.scratch(spark, "logs"))
    got = files.read_eval_log(spark, path)
    return got.select(F.regexp_extract("file", "user=([0-9]+)", 1).cast("long").alias("user_id"), "l2", "obj_col", F.round("obj_box_col", 2).alias("obj_box_col"))


def episode_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sql.query("reward_cost")(spark, sf_dir).select("episode", "reward")
    sinks.append_jsonl(e, path := sinks.scratch(spark, "episodes"), ["episode", "reward"])
    sinks.append_jsonl(e.filter("reward > 0").withColumn("episode", F.col("episode") + 1_000_000), path, ["episode", "reward"])
    old = tables.read_jsonl(spark, path, "episode long, reward double")
    new = e.filter("reward < 0").withColumn("reward", F.lit(0.0))
    sinks.replace(spark, sinks.upsert(old, new, "episode"), out := sinks.scratch(spark, "episodes"))
    return spark.read.parquet(out)


def info_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sql.query("manifest_scan")(spark, sf_dir)
    infos = m.select(F.col("sample_token").alias("token"), F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp"), "scene_token")
    return files.read_infos(infos, 3)


def _packed(pages: DataFrame, folder: str) -> None:
    """Pages as members of 16 gzip tar archives, some pages in two of them; a task writes an archive, member by member."""
    k = F.col("page_id") % 16
    places = F.array_distinct(F.array(k, F.when(F.col("page_id") % 5 == 0, (k + 3) % 16).otherwise(k)))
    rows = pages.withColumn("k", F.explode(places)).select(F.col("k").cast("int").alias("k"), F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("member"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("body"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import tarfile

        now, stack, n = None, contextlib.ExitStack(), 0
        for b in batches:
            for key, name, body in zip(*(b.column(c).to_pylist() for c in ("k", "member", "body")), strict=True):
                if key != now:
                    stack.close()
                    fs, path = archives.located(f"{folder}/a{key:02d}.tgz")
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = stack.enter_context(tarfile.open(fileobj=stack.enter_context(fs.open_output_stream(path, compression=None)), mode="w|gz"))
                    now = key
                info = tarfile.TarInfo(name)
                info.size = len(body)
                out.addfile(info, io.BytesIO(body))
                n += 1
        stack.close()
        yield pa.RecordBatch.from_pydict({"n": [n]})

    rows.repartition("k").sortWithinPartitions("k", "member").mapInArrow(write, "n long").collect()


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages packed into archives, found again by an index in waves, and unpacked: where each is, and its bytes."""
    pages = _table(spark, sf_dir, "pages")
    _packed(pages, folder := sinks.scratch(spark, "archives"))
    required = pages.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("member"))
    out = sinks.scratch(spark, "unpacked")
    archives.extract(spark, folder, out, required, progress := sinks.scratch(spark, "progress"), wave=4)
    found, _ = archives.index(spark, folder, required, f"{progress}/index")
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(out).select(F.concat(F.lit("pages/"), F.regexp_extract("path", "([^/]*)$", 1)).alias("member"), F.sha2("content", 256).alias("sha256"))
    return found.join(whole, "member").select("member", F.regexp_extract("archive", "([^/]*)$", 1).alias("archive"), "length", "sha256")


QUERIES = {f.__name__: f for f in (archive_members, scan_jsonl, label_sidecar, submission_scan, eval_log_metrics, episode_upsert, info_stride)}

_manifest = sql.oracle("manifest_scan")
ORACLES = {
    "archive_members": "SELECT 'pages/' || page_id AS member, 'a' || lpad(CAST(least(page_id % 16, CASE WHEN page_id % 5 = 0 THEN (page_id % 16 + 3) % 16 ELSE page_id % 16 END) AS VARCHAR), 2, '0') || '.tgz' AS archive, CAST(strlen(coalesce(html, '')) AS BIGINT) AS length, sha256(coalesce(html, '')) AS sha256 FROM pages",
    "scan_jsonl": f"SELECT CAST(sample_token AS VARCHAR) AS sample_token, epoch_us(ts) AS timestamp, split, domain_id, location, ego_speed, agent_count, teacher_loss, teacher_uncertainty, '{{}}' AS metadata FROM ({_manifest}) m",
    "label_sidecar": "SELECT CAST(doc_id AS VARCHAR) AS sample_token, CASE WHEN doc_id % 10 = 7 THEN 'c' ELSE '' END || CAST(quality AS VARCHAR) AS label, 'lines' AS way FROM labels UNION ALL SELECT CAST(doc_id AS VARCHAR), CAST(quality AS VARCHAR), 'csv' FROM labels",
    "submission_scan": "SELECT CAST(vec_id % 20 AS VARCHAR) AS token, row_number() OVER (PARTITION BY vec_id % 20 ORDER BY vec_id DESC) - 1 AS place, round(vec_id / 1000.0, 6)::DOUBLE AS score, label, 2::BIGINT AS points FROM embeddings",
    "eval_log_metrics": "SELECT user_id, max(event_id)::DOUBLE AS l2, 0.5::DOUBLE AS obj_col, round(arg_max(value, event_id), 2) AS obj_box_col FROM events WHERE event_type <> 'view' GROUP BY user_id",
    "episode_upsert": f"SELECT episode, CASE WHEN reward < 0 THEN 0.0::DOUBLE ELSE reward END AS reward FROM ({sql.oracle('reward_cost')}) r UNION ALL SELECT episode + 1000000, reward FROM ({sql.oracle('reward_cost')}) r WHERE reward > 0",
    "info_stride": f"SELECT token, timestamp, scene_token FROM (SELECT sample_token AS token, epoch_us(ts) AS timestamp, scene_token, row_number() OVER (ORDER BY ts, sample_token) AS rn FROM ({_manifest}) m) t WHERE (rn - 1) % 3 = 0",
}
