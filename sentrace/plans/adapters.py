"""Activity logs derived from the driver tables, as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrace.functions.columns import week_of

INCIDENT_VALUE = 200.0  # a purchase of at least this value marks an incident of its user


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_USER = "concat('U', lpad(CAST({} AS STRING), 6, '0'))"
_USER_ID = _USER.format("user_id")
_FILE_SUFFIX = """CASE event_id % 6 WHEN 0 THEN '.exe' WHEN 1 THEN '.docx' WHEN 2 THEN '.pdf'
    WHEN 3 THEN '.zip' WHEN 4 THEN '.rar' ELSE '.txt' END"""


def _log(spark: SparkSession, sf_dir: str, types: tuple[str, ...], *columns: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin(*types))
    return events.selectExpr("event_id AS id", "ts AS date", f"{_USER_ID} AS user_id", *columns)


def logon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(
        spark,
        sf_dir,
        ("signup", "error"),
        "concat('PC-', event_id % 2) AS pc",
        "if(event_type = 'signup', 'Logon', 'Logoff') AS activity",
    )


def device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir, ("click",), "if(event_id % 2 = 0, 'Connect', 'Disconnect') AS activity")


def http(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = "concat(if(event_id % 3 = 0, 'https', 'http'), '://site', event_id % 17, '.example.com/p/', event_id)"
    return _log(spark, sf_dir, ("view",), f"if(event_id % 11 = 0, NULL, {url}) AS url")


def email(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = f"concat({_USER_ID}, '@dtaa.com')"
    return _log(
        spark,
        sf_dir,
        ("purchase",),
        f"CASE event_id % 3 WHEN 0 THEN {own} WHEN 1 THEN concat('x', event_id, '@mail.example') END AS to_addr",
        f"if(event_id % 5 = 0, {own}, NULL) AS cc_addr",
        "CAST(NULL AS STRING) AS bcc_addr",
        f"if(event_id % 4 = 0, 'other@dtaa.com', {own}) AS from_addr",
        "CAST(floor(value * 100) AS BIGINT) AS size",
        "event_id % 4 AS attachments",
    )


def file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir, ("purchase",), f"concat('f', event_id, {_FILE_SUFFIX}) AS filename")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each user at its last event of each week."""
    role = """CASE event_type WHEN 'click' THEN 'ITAdmin' WHEN 'view' THEN 'Engineer'
        WHEN 'error' THEN 'Technician' WHEN 'signup' THEN 'Accountant' ELSE 'Salesman' END"""
    return (
        table(spark, sf_dir, "events")
        .selectExpr(f"{_USER_ID} AS user_id", "date_trunc('week', ts) AS _week", "ts", "event_id", "event_type")
        .groupBy("user_id", "_week")
        .agg(F.expr("max(struct(ts, event_id, event_type)) AS _last"))
        .select("user_id", "_week", "_last.*")
        .selectExpr("user_id", f"{week_of('_week')} AS week", f"{role} AS role", "concat('D', event_id % 4) AS department")
    )


def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        f"{_USER.format('c_custkey')} AS user_id",
        "c_custkey % 50 AS o",
        "c_custkey % 47 AS c",
        "c_custkey % 43 AS e",
        "c_custkey % 41 AS a",
        "c_custkey % 37 AS n",
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One incident per very large purchase: three days before it to five days after it."""
    return (
        table(spark, sf_dir, "events")
        .where(f"event_type = 'purchase' AND value >= {INCIDENT_VALUE}")
        .selectExpr(
            f"{_USER_ID} AS user_id",
            "CAST(1 + event_id % 3 AS INT) AS scenario",
            "ts - INTERVAL 3 DAYS AS inc_start",
            "ts + INTERVAL 5 DAYS AS inc_end",
        )
    )


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored and labelled rows: (id, score, label)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return documents.join(labels, "doc_id").selectExpr(
        "doc_id AS id", "CAST(n_chars AS DOUBLE) AS score", "toxic AS label"
    )


_USER_SQL = "concat('U', lpad(CAST(user_id AS VARCHAR), 6, '0'))"

# The same views for the SQL check.
VIEWS = {
    "logon": f"""SELECT event_id AS id, ts AS date, {_USER_SQL} AS user_id,
        concat('PC-', CAST(event_id % 2 AS VARCHAR)) AS pc,
        CASE WHEN event_type = 'signup' THEN 'Logon' ELSE 'Logoff' END AS activity
        FROM events WHERE event_type IN ('signup', 'error')""",
    "device": f"""SELECT event_id AS id, ts AS date, {_USER_SQL} AS user_id,
        CASE WHEN event_id % 2 = 0 THEN 'Connect' ELSE 'Disconnect' END AS activity
        FROM events WHERE event_type = 'click'""",
    "http": f"""SELECT event_id AS id, ts AS date, {_USER_SQL} AS user_id,
        CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat(CASE WHEN event_id % 3 = 0 THEN 'https' ELSE 'http' END,
            '://site', CAST(event_id % 17 AS VARCHAR), '.example.com/p/', CAST(event_id AS VARCHAR)) END AS url
        FROM events WHERE event_type = 'view'""",
    "email": f"""SELECT event_id AS id, ts AS date, {_USER_SQL} AS user_id,
        CASE WHEN event_id % 3 = 0 THEN concat({_USER_SQL}, '@dtaa.com')
             WHEN event_id % 3 = 1 THEN concat('x', CAST(event_id AS VARCHAR), '@mail.example') END AS to_addr,
        CASE WHEN event_id % 5 = 0 THEN concat({_USER_SQL}, '@dtaa.com') END AS cc_addr,
        CAST(NULL AS VARCHAR) AS bcc_addr,
        CASE WHEN event_id % 4 = 0 THEN 'other@dtaa.com' ELSE concat({_USER_SQL}, '@dtaa.com') END AS from_addr,
        CAST(floor(value * 100) AS BIGINT) AS size, event_id % 4 AS attachments
        FROM events WHERE event_type = 'purchase'""",
    "file": f"""SELECT event_id AS id, ts AS date, {_USER_SQL} AS user_id,
        concat('f', CAST(event_id AS VARCHAR), CASE event_id % 6 WHEN 0 THEN '.exe' WHEN 1 THEN '.docx'
            WHEN 2 THEN '.pdf' WHEN 3 THEN '.zip' WHEN 4 THEN '.rar' ELSE '.txt' END) AS filename
        FROM events WHERE event_type = 'purchase'""",
    "snapshots": f"""SELECT user_id, week, role, department FROM (
        SELECT {_USER_SQL} AS user_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week,
            CASE event_type WHEN 'click' THEN 'ITAdmin' WHEN 'view' THEN 'Engineer' WHEN 'error' THEN 'Technician'
                WHEN 'signup' THEN 'Accountant' ELSE 'Salesman' END AS role,
            concat('D', CAST(event_id % 4 AS VARCHAR)) AS department,
            row_number() OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts DESC, event_id DESC) AS rn
        FROM events) s WHERE rn = 1""",
    "traits": """SELECT concat('U', lpad(CAST(c_custkey AS VARCHAR), 6, '0')) AS user_id, c_custkey % 50 AS o,
        c_custkey % 47 AS c, c_custkey % 43 AS e, c_custkey % 41 AS a, c_custkey % 37 AS n FROM customer""",
    "incidents": f"""SELECT {_USER_SQL} AS user_id, CAST(1 + event_id % 3 AS INTEGER) AS scenario,
        ts - INTERVAL 3 DAY AS inc_start, ts + INTERVAL 5 DAY AS inc_end
        FROM events WHERE event_type = 'purchase' AND value >= {INCIDENT_VALUE}""",
    "scored": """SELECT doc_id AS id, CAST(n_chars AS DOUBLE) AS score, toxic AS label
        FROM documents JOIN labels USING (doc_id)""",
}
