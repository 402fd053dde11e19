"""Queries over manifests, audit chains, sinks and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberflow import schemas
from timberflow.operators import dedup, integrity, sinks, snapshots
from timberflow.operators.versions import Versions
from timberflow.plans import adapter
from timberflow.plans.catalog import query
from timberflow.plans.incident_queries import _DET, NOW, stored_incidents
from timberflow.plans.oracle import EV, rfc3339 as rfc3339_sql
from timberflow.session import materialize, scratch_path

# Order of a user's audit records.
ORDER = ["time", "event_id"]

# --- manifests --------------------------------------------------------------------------------------------


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest entries with the documents as the files."""
    docs = adapter.table(spark, folder, "documents")
    path = F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(
        path.alias("path"), F.octet_length("text").cast("bigint").alias("size"), F.sha2("text", 256).alias("sha256"), "lang"
    )


_ENTRIES = """WITH RECURSIVE entries AS (
    SELECT lang || '/' || doc_id || '.txt' AS path, strlen(text)::BIGINT AS size, sha256(text) AS sha256, lang
    FROM documents)"""
_ROOT = "sha256(string_agg(path || chr(0) || size || chr(0) || lower(sha256) || chr(10), '' ORDER BY path))"


@query("int_root_digest", _ENTRIES + f"SELECT {_ROOT} AS root_digest FROM entries")
def int_root_digest(spark, folder):
    return integrity.root_digest(_entries(spark, folder))


@query(
    "int_store_digest",
    _ENTRIES
    + """SELECT sha256(string_agg(split_part(path, '/', 2) || chr(0) || sha256 || chr(10), ''
      ORDER BY split_part(path, '/', 2))) AS root_digest FROM entries""",
)
def int_store_digest(spark, folder):
    return integrity.store_digest(_entries(spark, folder))


_FILED: dict[tuple[str, str], str] = {}


def _filed(spark: SparkSession, folder: str) -> str:
    """All documents as text files of a hundred ids each, by language, written once per application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _FILED:
        path = scratch_path(spark, "files")
        part = F.floor(F.col("doc_id") / 100).cast("bigint").alias("part")
        rows = adapter.table(spark, folder, "documents").select("lang", part, "doc_id", "text")
        ordered = rows.repartition("lang", "part").sortWithinPartitions("lang", "part", "doc_id").drop("doc_id")
        ordered.write.partitionBy("lang", "part").text(path)
        _FILED[key] = path
    return _FILED[key]


def _named_files(manifest: DataFrame) -> DataFrame:
    """The manifest with each file named by its folder, as file names are drawn at random."""
    return manifest.withColumn("path", F.regexp_extract("path", r"^(lang=[^/]+/part=\d+)/", 1))


_FILES = """WITH files AS (
    SELECT 'lang=' || lang || '/part=' || doc_id // 100 AS path, sum(strlen(text) + 1)::BIGINT AS size,
      sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS sha256, lang FROM documents GROUP BY lang, doc_id // 100)"""


@query("int_manifest", _FILES + "SELECT path, size, sha256 FROM files")
def int_manifest(spark, folder):
    """Size and digest of files; those above 64 kB are hashed as streams."""
    return _named_files(integrity.file_manifest(spark, _filed(spark, folder), whole_bytes=65_536))


@query(
    "int_verify_files",
    _FILES
    + """SELECT 'gone/' || path || ': no such file' AS finding FROM files WHERE lang = 'de'
    UNION ALL SELECT path || ': size ' || size || ', expected 0' FROM files WHERE lang = 'fr'
    UNION ALL SELECT path || ': SHA-256 mismatch' FROM files WHERE lang = 'es'
    UNION ALL SELECT 'manifest root digest mismatch'""",
)
def int_verify_files(spark, folder):
    """Manifest with files too many, wrong sizes and wrong digests, against the files there are."""
    root = _filed(spark, folder)
    manifest = materialize(integrity.file_manifest(spark, root))
    of = lambda lang: F.col("path").startswith(f"lang={lang}/")
    wrong = manifest.withColumns(
        {
            "size": F.when(of("fr"), 0).otherwise(F.col("size")),
            "sha256": F.when(of("es"), F.sha2("path", 256)).otherwise(F.col("sha256")),
        }
    )
    gone = manifest.filter(of("de")).withColumn("path", F.concat(F.lit("gone/"), "path"))
    found = integrity.verify_files(spark, root, wrong.unionByName(gone), "0" * 64)
    return found.withColumn("finding", F.regexp_replace("finding", r"/part-[^/:]+\.txt", ""))


@query(
    "int_verify_entries",
    _ENTRIES
    + """SELECT path || ': no such file' AS finding FROM entries WHERE lang = 'de'
    UNION ALL SELECT path || ': size ' || size + 1 || ', expected ' || size FROM entries WHERE lang = 'fr'
    UNION ALL SELECT path || ': SHA-256 mismatch' FROM entries WHERE lang = 'fr'
    UNION ALL SELECT 'manifest root digest mismatch'""",
)
def int_verify_entries(spark, folder):
    """Files of one language lost, those of another changed."""
    manifest = _entries(spark, folder)
    changed = F.col("lang") == "fr"
    current = manifest.filter(F.col("lang") != "de").select(
        "path",
        F.when(changed, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(changed, F.sha2("path", 256)).otherwise(F.col("sha256")).alias("sha256"),
    )
    return integrity.verify_entries(manifest.drop("lang"), current, "0" * 64)


@query(
    "int_manifest_check",
    _ENTRIES
    + """, broken AS (SELECT CASE WHEN lang = 'de' THEN '../' || path WHEN lang = 'es' THEN lang ELSE path END AS path,
      CASE WHEN lang = 'fr' THEN -size ELSE size END AS size, lang FROM entries)
    SELECT path, CASE WHEN lang = 'de' THEN 'unsafe path "' || path || '"' WHEN lang = 'es' THEN 'duplicate path "es"'
      ELSE 'negative size for "' || path || '"' END AS violation FROM broken WHERE lang IN ('de', 'es', 'fr')
    UNION ALL SELECT NULL, 'unsupported manifest version 2' UNION ALL SELECT NULL, 'invalid root digest'""",
)
def int_manifest_check(spark, folder):
    lang = F.col("lang")
    broken = _entries(spark, folder).withColumns(
        {
            "path": F.when(lang == "de", F.concat(F.lit("../"), "path")).when(lang == "es", lang).otherwise(F.col("path")),
            "size": F.when(lang == "fr", -F.col("size")).otherwise(F.col("size")),
        }
    )
    return integrity.check_manifest(broken.drop("lang"), "0" * 64, version=2)


# --- audit chains -----------------------------------------------------------------------------------------


def _actions(spark: SparkSession, folder: str) -> DataFrame:
    """One audit record per event, one chain per user."""
    events = adapter.table(spark, folder, "events")
    details = F.create_map(
        F.lit("props"), F.col("props"), F.lit("event"), F.col("event_id").cast("string")
    )
    return events.select(
        F.col("user_id").alias("chain"),
        F.col("ts").alias("time"),
        F.col("event_type").alias("action"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("subject"),
        details.alias("details"),
        "event_id",
    )


_DIGEST = (
    "sha256({0} || chr(0) || "
    + rfc3339_sql("ts")
    + " || chr(0) || event_type || chr(0) || 'user ' || user_id || chr(0) || {1} || chr(0) || "
    "'event' || chr(0) || event_id || chr(0) || 'props' || chr(0) || props || chr(0))"
)
_CHAIN = f"""WITH RECURSIVE placed AS (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
  sealed AS (
    SELECT *, '' AS previous, {_DIGEST.format('place', "''")} AS digest FROM placed WHERE place = 1
    UNION ALL
    SELECT p.*, s.digest, {_DIGEST.replace('epoch_us(ts)', 'epoch_us(p.ts)').replace('strftime(ts', 'strftime(p.ts')
      .replace('event_type', 'p.event_type').replace('user_id', 'p.user_id').replace('event_id', 'p.event_id')
      .replace('|| props ||', '|| p.props ||').format('p.place', 's.digest')}
    FROM sealed s JOIN placed p ON p.user_id = s.user_id AND p.place = s.place + 1)
"""


def _sealed(spark: SparkSession, folder: str) -> DataFrame:
    """Chains sealed in two steps, the second on top of the first."""
    actions = _actions(spark, folder)
    early = F.col("time") < F.lit("2024-01-16").cast("timestamp")
    first = materialize(integrity.seal_chain(actions.filter(early), "chain", ORDER))
    last = integrity.last_records(first, "chain")
    return materialize(first.unionByName(integrity.seal_chain(actions.filter(~early), "chain", ORDER, last)))


@query(
    "int_seal_chain",
    _CHAIN + "SELECT user_id AS chain, ts AS time, place AS sequence, previous, digest FROM sealed",
)
def int_seal_chain(spark, folder):
    return _sealed(spark, folder).select("chain", "time", "sequence", "previous", "digest")


@query(
    "int_verify_audit",
    _CHAIN
    + """, changed AS (SELECT *, event_type = 'purchase' AS retold, event_type = 'signup' AS cut FROM sealed),
    found AS (SELECT user_id AS chain, place AS position, CASE WHEN cut THEN 'record ' || place || ' previous digest mismatch'
      ELSE 'record ' || place || ' digest mismatch' END AS finding FROM changed WHERE cut OR retold)
    SELECT *, position = min(position) OVER (PARTITION BY chain) AS "first" FROM found""",
)
def int_verify_audit(spark, folder):
    """Chains in which purchases were renamed and the links of sign-ups cut."""
    audit = _sealed(spark, folder).withColumn("position", F.col("sequence"))
    tampered = audit.withColumns(
        {
            "action": F.when(F.col("action") == "purchase", "gift").otherwise(F.col("action")),
            "previous": F.when(F.col("action") == "signup", "none").otherwise(F.col("previous")),
        }
    )
    return integrity.verify_audit(tampered, ["chain"])


# --- sinks and snapshots ----------------------------------------------------------------------------------


@query("sink_events", EV + "SELECT id, ts AS timestamp, level, source, message, fingerprint FROM ev")
def sink_events(spark, folder):
    """Events written in time order to a new folder and read back."""
    path = scratch_path(spark, "events")
    sinks.save_events(adapter.events(spark, folder), path)
    return spark.read.parquet(path).select("id", "timestamp", "level", "source", "message", "fingerprint")


@query(
    "sink_csv",
    EV
    + f"""SELECT {rfc3339_sql('ts')} AS timestamp, level, source, message, id, fingerprint,
      'k=' || k || ';volatile.event_id=' || (line - 1) AS fields FROM ev""",
)
def sink_csv(spark, folder):
    path = scratch_path(spark, "export-csv")
    sinks.export_csv(adapter.events(spark, folder), path)
    columns = ["timestamp", "level", "source", "message", "id", "fingerprint", "fields"]
    return spark.read.schema(", ".join(f"{name} string" for name in columns)).option("header", True).csv(path, escape='"')


@query(
    "sink_json",
    EV + f"SELECT id, {rfc3339_sql('ts')} AS timestamp, level, source, message, k, fingerprint, line FROM ev",
)
def sink_json(spark, folder):
    path = scratch_path(spark, "export-json")
    sinks.export_events_json(adapter.events(spark, folder), path)
    types = {**schemas.EVENTS, "timestamp": "string", "ingested_at": "string"}
    rows = spark.read.schema(schemas.ddl(types)).json(path)
    return rows.select("id", "timestamp", "level", "source", "message", F.col("fields")["k"].alias("k"), "fingerprint", "line")


@query(
    "sink_incidents_json",
    _DET + f'SELECT id, {rfc3339_sql("first_seen")} AS first_seen, n AS count, len(ids) AS events FROM inc',
)
def sink_incidents_json(spark, folder):
    path = scratch_path(spark, "export-incidents")
    sinks.export_incidents_json(stored_incidents(spark, folder), path)
    rows = spark.read.schema("id string, first_seen string, count bigint, event_ids array<string>").json(path)
    return rows.select("id", "first_seen", "count", F.size("event_ids").cast("bigint").alias("events"))


def _store(spark: SparkSession, folder: str) -> str:
    store = scratch_path(spark, "store")
    snapshots.save_store(adapter.events(spark, folder), stored_incidents(spark, folder), store)
    return store


@query(
    "snap_create",
    _DET
    + """SELECT 'before' AS name, TIMESTAMP '2024-01-31' AS created, 1::BIGINT AS generation, (SELECT count(*) FROM events) AS events,
      (SELECT count(*) FROM inc) AS incidents, (SELECT min(ts) FROM events) AS earliest,
      (SELECT max(ts) FROM events) AS latest, 'none' AS root_digest, 'events,incidents' AS files""",
)
def snap_create(spark, folder):
    return snapshots.create_snapshot(spark, _store(spark, folder), "before", NOW, "none")


@query(
    "snap_restore",
    EV + "SELECT ts AS time, id, source, level, fingerprint, 0::BIGINT AS mismatches FROM ev",
)
def snap_restore(spark, folder):
    """Store cut to its first half after a snapshot, cleaned up and then restored: the index again lists all events."""
    store = _store(spark, folder)
    versions = Versions(spark, store)
    snapshots.create_snapshot(spark, store, "before", NOW)
    half = versions.events().filter(F.col("timestamp") < "2024-01-16")
    snapshots.save_store(half, versions.incidents(), store)
    snapshots.cleanup(spark, store)
    snapshots.restore_snapshot(spark, store, "before")
    events, index = versions.events(), versions.index()
    wrong = dedup.index_mismatches(events, dedup.positioned_index(index)).agg(F.count("*").alias("mismatches"))
    return index.withColumn("_one", F.lit(1)).join(wrong.withColumn("_one", F.lit(1)), "_one").drop("_one")
