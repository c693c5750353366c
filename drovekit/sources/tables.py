"""Line and document readers: manifests, labels, target scores, selections, token lists, submissions, raw tables.

Every reader takes any path that Spark reads and gives a DataFrame. Schemas are explicit, so that
a scan needs one pass; a line that isn't JSON raises.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "sample_token string, scene_token string, timestamp long, split string, domain_id int, domain_name string, location string, weather_tag string, time_tag string, route_cmd string, ego_speed double, agent_count int, feature_path string, teacher_loss double, teacher_uncertainty double, metadata string"
TARGETS = "sample_token string, split string, domain_label string, domain_source string, heuristic_name string, target_score double, feature_values map<string,double>, score_terms map<string,double>, fallback_used boolean, config_hash string"
SELECTION = "baseline string, score_source string, budget_ratio double, budget_mode string, budget_count int, split string, selected_count int, selected_tokens array<string>, selection_hash string, domain_budget map<string,int>, domain_counts map<string,int>"
VECTORS = "map<string,struct<vectors:array<array<array<double>>>,scores:array<double>,labels:array<int>>>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per line that isn't blank. Nested values of a string column stay JSON text."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document per file: one row, or one per element of a list."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def unique(df: DataFrame, *key: str) -> DataFrame:
    """df, once its key is known to be unique; raises with an example otherwise."""
    twice = df.groupBy(*key).count().filter("count > 1").first()
    if twice is not None:
        raise ValueError(f"{', '.join(key)} isn't unique: {tuple(twice)[:-1]} is there {twice['count']} times")
    return df


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Samples by their token; a missing metadata is an empty object, a repeated token raises."""
    rows = read_jsonl(spark, path, MANIFEST)
    return unique(rows.withColumn("metadata", F.coalesce("metadata", F.lit("{}"))), "sample_token")


def absolute(path: Column, root: str) -> Column:
    """A relative path under a root; an absolute one, or one with a scheme, as it is."""
    return F.when(path.startswith("/") | path.contains("://"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def resolved(rows: DataFrame, name: str, default: str = "default") -> Column:
    """A label: the column of that name, else the path in metadata (with or without its prefix), else the default; empty is none."""
    path = name.removeprefix("metadata.")
    found = [F.col(name).cast("string")] if name in rows.columns else []
    if "metadata" in rows.columns:
        found.append(F.get_json_object("metadata", "$." + path))
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in found), F.lit(default))


def _last(rows: DataFrame, *values: str) -> DataFrame:
    """Of rows (token, ..., _file, _line) the last of each token."""
    return rows.groupBy("sample_token").agg(*(F.max_by(v, F.struct("_file", "_line")).alias(v) for v in values))


def read_labels(spark: SparkSession, path: str, field: str = "domain_label") -> DataFrame:
    """(sample_token, label) of JSON lines: the field, else cluster_label, else cluster_id. Rows without a token or
    a label go; the last of a token's rows counts."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    get = lambda k: F.nullif(F.get_json_object("value", f"$.{k}"), F.lit(""))
    rows = lines.select(get("sample_token").alias("sample_token"), F.coalesce(*map(get, dict.fromkeys((field, "cluster_label", "cluster_id")))).alias("label"), "_file", F.struct("_start", "_id").alias("_line"))
    return _last(rows.dropna(subset=["sample_token", "label"]), "label")


def read_label_sidecar(spark: SparkSession, path: str, field: str = "domain_label") -> DataFrame:
    """(sample_token, label) of a CSV file with a header, JSON lines, or a JSON document: token to label, token to row, or a list of rows."""
    if path.endswith(".csv"):
        rows = spark.read.option("header", True).csv(path)
        return rows.select("sample_token", F.col(field).alias("label")).dropna().filter("label != ''")
    if path.endswith(".jsonl"):
        return read_labels(spark, path, field)
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    listed = F.from_json("value", "array<string>")
    lists = text.filter(F.col("value").startswith("[")).select(F.posexplode(listed).alias("_at", "row"))
    lists = lists.select(F.get_json_object("row", "$.sample_token").alias("sample_token"), F.get_json_object("row", f"$.{field}").alias("label"), "_at")
    maps = text.filter(F.col("value").startswith("{")).select(F.explode(F.from_json("value", "map<string,string>")).alias("sample_token", "row"))
    label = F.when(F.col("row").startswith("{"), F.get_json_object("row", f"$.{field}")).otherwise(F.col("row"))
    both = lists.unionByName(maps.select("sample_token", label.alias("label"), F.lit(0).alias("_at")))
    return both.dropna(subset=["sample_token", "label"]).filter("label != ''").groupBy("sample_token").agg(F.max_by("label", "_at").alias("label"))


def labelled(rows: DataFrame, labels: DataFrame, default: str = "default") -> DataFrame:
    """rows with label: their own of (sample_token, label), else the default."""
    return rows.join(labels, "sample_token", "left").withColumn("label", F.coalesce("label", F.lit(default)))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Target scores; the label falls back on the heuristic's name, then on 'default'."""
    empty = F.lit("")
    rows = read_jsonl(spark, path, TARGETS)
    return rows.withColumn("domain_label", F.coalesce(F.nullif("domain_label", empty), F.nullif("heuristic_name", empty), F.lit("default")))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(sample_token) of a text file, one to a line; blank lines go."""
    return spark.read.text(path).select(F.trim("value").alias("sample_token")).filter("sample_token != ''")


def read_selections(spark: SparkSession, folder: str) -> DataFrame:
    """Selection documents of a folder with their file names, in that order."""
    return read_document(spark, f"{folder.rstrip('/')}/*.json", SELECTION).withColumn("file", F.element_at(F.split("_metadata.file_path", "/"), -1)).orderBy("file")


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """(token, place, vector, score, label) of a map submission {results: {token: {vectors, scores, labels}}}."""
    one = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<results:{VECTORS}>")["results"]).alias("token", "r"))
    lines = F.posexplode(F.arrays_zip(F.col("r.vectors").alias("vector"), F.col("r.scores").alias("score"), F.col("r.labels").alias("label")))
    return one.select("token", lines.alias("place", "x")).select("token", "place", "x.vector", "x.score", "x.label")


def read_raw_tables(spark: SparkSession, folder: str, names: tuple[str, ...] = ("scene", "log", "sample", "sample_data")) -> dict[str, DataFrame]:
    """The unpacked raw tables of a folder, one JSON list each; a table that isn't there raises."""
    kinds = {"scene": "token string, name string, log_token string, nbr_samples int", "log": "token string, location string", "sample": "token string, scene_token string, timestamp long, data map<string,string>", "sample_data": "token string, sample_token string, filename string, is_key_frame boolean, prev string"}
    return {n: read_document(spark, f"{folder.rstrip('/')}/{n}.json", kinds[n]) for n in names}


def read_config(path: str, schema: str) -> dict:
    """A JSON (or, with that library, YAML) configuration on the driver; its schema tag must be the given one."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        data = yaml.safe_load(text)
    else:
        data = json.loads(text)
    if not isinstance(data, dict) or data.get("schema") != schema:
        raise ValueError(f"{path} isn't a configuration of schema {schema}")
    return data


def required_files(tables: dict[str, DataFrame]) -> DataFrame:
    """(sample_token, filename): key frames of the samples, by their table and by the samples' own map of data."""
    data = tables["sample_data"]
    key = F.col("is_key_frame") | F.col("filename").startswith("samples/")
    own = tables["sample"].select(F.col("token").alias("sample_token"), F.explode(F.map_values("data")).alias("token")).join(data.select("token", "filename"), "token").select("sample_token", "filename")
    joined = data.filter(key).join(tables["sample"].select(F.col("token").alias("sample_token")), "sample_token", "left_semi").select("sample_token", "filename")
    return joined.union(own).distinct()


def sweeps(data: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, hop, token, filename): what the prev links of sample data lead to from the start tokens, up to a number of hops."""
    links = data.select("token", "filename", F.nullif("prev", F.lit("")).alias("prev"))
    now = starts.select(F.col("token").alias("start"), F.col("token").alias("at"))
    found = []
    for hop in range(1, hops + 1):
        back = now.join(links.select(F.col("token").alias("at"), "prev"), "at").dropna(subset=["prev"])
        now = back.select("start", F.col("prev").alias("at"))
        found.append(now.join(links.select(F.col("token").alias("at"), "filename"), "at").select("start", F.lit(hop).alias("hop"), F.col("at").alias("token"), "filename"))
    return reduce(DataFrame.unionByName, found)
