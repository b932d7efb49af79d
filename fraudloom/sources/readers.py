"""Readers. Every schema is explicit; nothing is inferred from data."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

L = F.lit
DETECTOR = "struct<score:double,confidence:double,status:string,reasons:array<string>>"
SCORES_SCHEMA = (
    "id string, label string, y int, attack_type string, generator string, split string, doc_type string, latency_ms double, "
    f"detectors map<string,{DETECTOR}>, per_detector_latency_ms map<string,double>"
)
SESSIONS_SCHEMA = (
    "session string, subject string, label int, source string, strategy string, dwells array<double>, flights array<double>, "
    "n_keys int, backspaces int, printable int, span_s double, keys array<struct<key:string,down:double,up:double,field:string>>, _corrupt_record string"
)
ENV = "struct<timezone:string,timezone_offset_min:int,languages:array<string>,screen_w:int,screen_h:int,webdriver:boolean,hardware_concurrency:int,user_agent:string,country:string>"
TELEMETRY_SCHEMA = (
    "session string, form_loaded_at double, submitted_at double, declared_country string, "
    "keys array<struct<key:string,down:double,up:double,field:string>>, mouse array<struct<t:double,x:double,y:double>>, "
    "focus array<struct<field:string,index:int,in:double,out:double>>, paste array<struct<field:string,t:double,length:int>>, "
    f"env {ENV}"
)
TABLES = {
    "submissions": "submission_id string, merchant_id string, external_ref string, status string, selfie_path string, video_path string, id_doc_path string, label string, attack_type string, source string, claimed_name string, claimed_id_number string, claimed_dob string, extra map<string,string>, created_at timestamp",
    "verdicts": f"submission_id string, final_score double, verdict string, abstained boolean, reasons array<string>, detector_breakdown map<string,{DETECTOR}>, heatmaps map<string,string>, explanation string, attack_pattern string, generator_guess string, latency_ms double, fusion_model string, policy_snapshot map<string,string>, decided_at timestamp",
    "face_embeddings": "submission_id string, merchant_id string, kind string, claimed_name string, vector array<float>, created_at timestamp",
    "asset_hashes": "submission_id string, kind string, phash string, content_hash string, created_at timestamp",
    "behavioral_sessions": "token string, submission_id string, merchant_id string, features map<string,double>, event_count bigint, user_agent string, created_at timestamp",
    "audit_events": "id bigint, submission_id string, actor string, event string, payload string, created_at timestamp",
}


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """SRC7: the base tables of a deployment, parquet with fixed schemas."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in TABLES.items()}


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: scored packets, as a JSON array or as JSON lines.

    One array file is one task by format, so a large corpus should be JSON lines.
    """
    multi = not path.rstrip("/").endswith((".jsonl", ".ndjson"))
    return spark.read.schema(SCORES_SCHEMA).json(path, multiLine=multi)


def read_sessions_jsonl(spark: SparkSession, path: str, count_bad: bool = False) -> DataFrame:
    """SRC2: typing sessions; malformed lines are skipped, or kept in _corrupt_record to be counted."""
    rows = spark.read.schema(SESSIONS_SCHEMA).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return rows if count_bad else rows.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_keystroke_tsv(spark: SparkSession, folder: str) -> DataFrame:
    """SRC3: one tab-separated file per participant; the id is the file name up to '_'."""
    schema = "PARTICIPANT_ID string, TEST_SECTION_ID string, SENTENCE string, USER_INPUT string, KEYSTROKE_ID string, PRESS_TIME string, RELEASE_TIME string, LETTER string, KEYCODE string"
    raw = spark.read.schema(schema).csv(f"{folder}/*_keystrokes.txt", sep="\t", header=True, enforceSchema=True, quote="")
    who = F.get(F.split(F.col("_metadata.file_name"), "_"), 0)
    press, release = F.col("PRESS_TIME").try_cast("double"), F.col("RELEASE_TIME").try_cast("double")
    return raw.select(
        F.concat(L("aalto::"), who).alias("subject"), F.coalesce("TEST_SECTION_ID", L("")).alias("section"), press.alias("press"), release.alias("release"), F.col("KEYCODE").alias("keycode"), F.col("LETTER").alias("letter")
    ).filter(press.isNotNull() & release.isNotNull() & ~F.isnan(press) & ~F.isnan(release))


def read_cmu_wide(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: hold (H.*) and up-down (UD.*) columns to arrays in milliseconds; DD.* is dropped."""
    header = spark.read.text(path).limit(1).first()[0].split(",")
    names = [h.strip().strip('"') for h in header]
    raw = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path, header=True, enforceSchema=True)
    take = lambda prefix: F.array_compact(F.array(*[F.col(f"`{n}`").try_cast("double") * 1000.0 for n in names if n.startswith(prefix)]))
    n_keys = sum(n.startswith("H.") for n in names)
    return raw.select(
        "subject", F.col("sessionIndex").cast("int").alias("session_index"), (F.col("sessionIndex").cast("int") * 100000 + F.col("rep").cast("int")).alias("rep"), take("H.").alias("dwells"), take("UD.").alias("flights"), L(n_keys).alias("n_keys")
    )


def read_pair_protocol(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: a folds/per-class header, then per fold `per_class` same and `per_class` different lines.

    The fold is positional, so line order is made explicit; the protocol is one small file.
    """
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("pos", "line"))
    head = F.split(F.trim("line"), r"\s+")
    sizes = lines.filter("pos = 0").select(F.get(head, 0).cast("int").alias("folds"), F.get(head, 1).cast("int").alias("per_class"))
    f = F.split(F.trim("line"), r"\s+")
    body = lines.filter("pos > 0").crossJoin(F.broadcast(sizes)).select("pos", f.alias("f"), "folds", "per_class")  # one row
    same = F.size("f") == 3
    pick = lambda who, shot: F.concat(who, L("_"), F.lpad(shot, 4, "0"))
    return body.filter(F.size("f").isin(3, 4)).select(
        F.col("pos").alias("pair_id"),
        F.floor((F.col("pos") - 1) / (2 * F.col("per_class"))).cast("int").alias("fold"),
        same.cast("int").alias("label"),
        pick(F.get("f", 0), F.get("f", 1)).alias("photo_a"),
        F.when(same, pick(F.get("f", 0), F.get("f", 2))).otherwise(pick(F.get("f", 2), F.get("f", 3))).alias("photo_b"),
    )


def read_labelled_balanced(df: DataFrame, columns: list[str], label: str, n: int, seed: int = 0) -> DataFrame:
    """SRC8: pruned columns and at most n rows per class (row_number <= n prunes before the shuffle)."""
    w = Window.partitionBy(label).orderBy(F.xxhash64(*columns, L(seed)), *columns)
    return df.select(*columns, label).withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def hash_assets(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """SRC9: SHA-256 of whole files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("content_hash"))


def events_of_aalto(rows: DataFrame) -> DataFrame:
    """Per participant and section: key count, for `aalto_sessionise`."""
    return rows.groupBy("subject", "section").agg(F.count(L(1)).alias("n_keys"))
