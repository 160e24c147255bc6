"""Feature fitting, encoding, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrace.operators import features as X
from sentrace.operators.sequences import sequences
from sentrace.plans.base import history, stored, with_views
from sentrace.sources.roles import ROLE_UNITS, RoleMap, role_map, role_units
from sentrace.storage import scratch_path

ALL_FEATURES = [*X.NUMERIC_FEATURES, *X.OPTIONAL_FEATURES]
CLIP = 99.0
LENGTH = 100
# A map without Salesman, so that the data hold an unknown role.
PARTIAL = RoleMap(
    role_map().unit_order, {r: u for r, u in role_map().role_to_unit.items() if r != "Salesman"}, "Administration"
)


def _fit(s, d, clip=100.0, **options):
    return X.fit_features(stored(s, d, "enriched"), clip_percentile=clip, **options)


def _long(df):
    pairs = ", ".join(f"'{c}', round(CAST({c} AS DOUBLE), 9)" for c in ALL_FEATURES)
    return df.selectExpr("session_id", f"stack({len(ALL_FEATURES)}, {pairs}) AS (feature, value)")


def _encoded(s, d, mode):
    model = _fit(s, d, role_mode=mode, role_map=PARTIAL)
    names = ", ".join(f"'{c}'" for c in model.categories)
    return (
        X.encode_roles(stored(s, d, "enriched"), model)
        .selectExpr("session_id", "posexplode(role_vector) AS (pos, flag)")
        .selectExpr("session_id", "pos", f"element_at(array({names}), pos + 1) AS category", "flag")
    )


def _parameters(model, spark):
    return model.table(spark).selectExpr(
        "position",
        "feature",
        "kind",
        *[f"round({c}, 9) AS {c}" for c in ("median", "q1", "q3", "lo", "hi", "pad")],
    )


def _roundtrip(s, d):
    path = scratch_path(s, "feature-model")
    _fit(s, d, CLIP, role_mode="units", role_map=PARTIAL).save(s, path)
    return _parameters(X.FeatureModel.load(s, path), s)


def _vectors(s, d):
    rows = stored(s, d, "enriched")
    model = _fit(s, d, role_mode="units", role_map=role_map())
    return X.feature_vector(rows, model).selectExpr("session_id", "posexplode(features) AS (pos, v)").selectExpr(
        "session_id", "pos", "round(v, 9) AS value"
    )


def _sparse(s, d):
    rows = stored(s, d, "enriched")
    found = X.sparse_vector(rows, _fit(s, d), X.role_dictionary(rows))
    entries = found.selectExpr("session_id", "sparse.size AS size", "inline(arrays_zip(sparse.indices, sparse.values))")
    return entries.selectExpr("session_id", "size", "indices AS position", "round(values, 9) AS value").where("value <> 0")


def _sequences(s, d):
    rows = stored(s, d, "enriched")
    model = X.fit_features(rows)
    vectors = X.feature_vector(rows, model).withColumn("features", F.transform("features", lambda x: F.round(x, 9)))
    return (
        sequences(vectors, LENGTH, model.padding)
        .selectExpr("session_id", "user_id", "posexplode(arrays_zip(mask, seq)) AS (step, _at)")
        .selectExpr("session_id", "user_id", "step", "_at.mask AS mask", *[f"_at.seq[{i}] AS {f}" for i, f in enumerate(model.names)])
    )


QUERIES = {
    "fit_features": lambda s, d: _parameters(_fit(s, d, CLIP, role_mode="units", role_map=PARTIAL), s),
    "feature_model_roundtrip": _roundtrip,
    "impute": lambda s, d: _long(X.impute(stored(s, d, "enriched"), _fit(s, d))),
    "robust_scale": lambda s, d: _long(X.robust_scale(stored(s, d, "enriched"), _fit(s, d))),
    "clip_scaled": lambda s, d: _long(X.clip_scaled(stored(s, d, "enriched"), _fit(s, d, CLIP))),
    "encode_roles": lambda s, d: _encoded(s, d, "roles"),
    "encode_role_units": lambda s, d: _encoded(s, d, "units"),
    "feature_vector": _vectors,
    "sparse_vector": _sparse,
    "role_dictionary": lambda s, d: X.role_dictionary(stored(s, d, "enriched")),
    "sequences": _sequences,
    "role_units": lambda s, d: X.role_unit_lookup(history(s, d), role_units(s))
    .groupBy("role", "unit")
    .count()
    .withColumnRenamed("count", "snapshots"),
    "unknown_roles": lambda s, d: X.unknown_roles(history(s, d), role_units(s, PARTIAL)),
}


def _struct(feature: str, position: int) -> str:
    return f"{{'feature': '{feature}', 'position': {position}, 'value': CAST({feature} AS DOUBLE)}}"


_STRUCTS = ", ".join(_struct(f, i) for i, f in enumerate(ALL_FEATURES))
LONG = f"SELECT session_id, unnest([{_STRUCTS}], recursive := true) FROM enriched"
FITTED = """SELECT feature, position, median, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2,
    quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.01) AS low, quantile_cont(v, 0.99) AS high
    FROM (SELECT feature, position, median, coalesce(value, median) AS v
        FROM long JOIN (SELECT feature, median(value) AS median FROM long GROUP BY feature) USING (feature))
    GROUP BY feature, position, median"""
SCALE = "(CASE WHEN q3 = q1 THEN 1.0 ELSE q3 - q1 END)"
SCALED = f"(coalesce(value, median) - median) / {SCALE}"


def fitted_views(body: str, *names: str) -> str:
    text = with_views(*(names or ("enriched",)), body="SELECT 1")
    ctes = text[: text.rindex("SELECT 1")].rstrip()
    return f"{ctes},\nlong AS ({LONG}),\nfitted AS ({FITTED})\n{body}"


def _unit_case(mapping: RoleMap) -> str:
    cases = " ".join(f"WHEN '{r}' THEN '{u}'" for r, u in mapping.role_to_unit.items())
    default = f"'{mapping.default_unit}'" if mapping.default_unit else "NULL"
    return f"CASE WHEN role IS NULL THEN NULL ELSE CASE role {cases} ELSE {default} END END"


_UNIT_ROWS = ", ".join(f"('{u}', {i})" for i, u in enumerate(role_map().unit_order))
_MAP_ROWS = ", ".join(f"('{r}', '{u}')" for u in ROLE_UNITS["unit_order"] for r in ROLE_UNITS[u])
_N = len(ALL_FEATURES)
_PARAMETERS = f"""
    SELECT CAST(position AS INTEGER) AS position, feature, 'numeric' AS kind, round(median, 9) AS median,
        round(q1, 9) AS q1, round(q3, 9) AS q3, round((low - q2) / {SCALE}, 9) AS lo,
        round((high - q2) / {SCALE}, 9) AS hi, CAST(0 AS DOUBLE) AS pad FROM fitted
    UNION ALL SELECT CAST({_N} + i AS INTEGER), 'role_' || unit, 'role', NULL, NULL, NULL, NULL, NULL,
        CAST(0 AS DOUBLE) FROM (VALUES {_UNIT_ROWS}) AS u(unit, i)"""

ORACLE = {
    "fit_features": fitted_views(_PARAMETERS),
    "feature_model_roundtrip": fitted_views(_PARAMETERS),
    "impute": fitted_views(
        "SELECT session_id, feature, round(coalesce(value, median), 9) AS value FROM long JOIN fitted USING (feature)"
    ),
    "robust_scale": fitted_views(
        f"SELECT session_id, feature, round({SCALED}, 9) AS value FROM long JOIN fitted USING (feature)"
    ),
    "clip_scaled": fitted_views(
        f"""SELECT session_id, feature, round(least(greatest({SCALED}, (low - q2) / {SCALE}),
            (high - q2) / {SCALE}), 9) AS value FROM long JOIN fitted USING (feature)"""
    ),
    "encode_roles": with_views(
        "enriched",
        body="""SELECT session_id, CAST(pos AS INTEGER) AS pos, category,
            CAST(CASE WHEN role = category THEN 1 ELSE 0 END AS DOUBLE) AS flag
            FROM enriched, (SELECT role AS category, row_number() OVER (ORDER BY role) - 1 AS pos
                FROM (SELECT DISTINCT role FROM enriched WHERE role IS NOT NULL))""",
    ),
    "encode_role_units": with_views(
        "enriched",
        body=f"""SELECT session_id, CAST(i AS INTEGER) AS pos, unit AS category,
            CAST(CASE WHEN {_unit_case(PARTIAL)} = unit THEN 1 ELSE 0 END AS DOUBLE) AS flag
            FROM enriched, (VALUES {_UNIT_ROWS}) AS u(unit, i)""",
    ),
    "feature_vector": fitted_views(
        f"""SELECT session_id, CAST(fitted.position AS INTEGER) AS pos, round({SCALED}, 9) AS value
                FROM long JOIN fitted USING (feature)
            UNION ALL SELECT session_id, CAST({_N} + i AS INTEGER),
                CAST(CASE WHEN {_unit_case(role_map())} = unit THEN 1 ELSE 0 END AS DOUBLE)
                FROM enriched, (VALUES {_UNIT_ROWS}) AS u(unit, i)"""
    ),
    "role_dictionary": with_views(
        "enriched",
        body="""SELECT role, row_number() OVER (ORDER BY encode(role)) - 1 AS place
            FROM (SELECT DISTINCT role FROM enriched WHERE role IS NOT NULL)""",
    ),
    "sparse_vector": fitted_views(
        f"""SELECT session_id, {_N} + (SELECT count(DISTINCT role) FROM enriched) AS size, position, value FROM (
            SELECT session_id, CAST(fitted.position AS BIGINT) AS position, round({SCALED}, 9) AS value
                FROM long JOIN fitted USING (feature)
            UNION ALL SELECT session_id, {_N} + place, CAST(1 AS DOUBLE) FROM enriched JOIN (
                SELECT role, row_number() OVER (ORDER BY encode(role)) - 1 AS place
                FROM (SELECT DISTINCT role FROM enriched WHERE role IS NOT NULL)) USING (role))
            WHERE value <> 0"""
    ),
    "sequences": None,
    "role_units": with_views(
        "history",
        body=f"""SELECT h.role, m.unit, count(*) AS snapshots FROM history h
            LEFT JOIN (VALUES {_MAP_ROWS}) AS m(role, unit) ON h.role = m.role GROUP BY h.role, m.unit""",
    ),
    "unknown_roles": with_views(
        "history", body="SELECT DISTINCT role FROM history WHERE role = 'Salesman'"
    ),
}

_WIDE = ", ".join(f"max(CASE WHEN feature = '{f}' THEN round({SCALED}, 9) END) AS {f}" for f in ALL_FEATURES)
ORACLE["sequences"] = fitted_views(
    f"""SELECT r.session_id, r.user_id, CAST(s.step AS INTEGER) AS step,
        CAST(CASE WHEN p.n IS NULL THEN 0 ELSE 1 END AS INTEGER) AS mask,
        {', '.join(f"coalesce(p.{f}, 0.0) AS {f}" for f in ALL_FEATURES)}
    FROM (SELECT session_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY start_time, session_id) AS n
          FROM enriched) r
    CROSS JOIN (SELECT unnest(range({LENGTH})) AS step) s
    LEFT JOIN (SELECT e.session_id, e.user_id, n, {', '.join(ALL_FEATURES)} FROM
            (SELECT session_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY start_time, session_id) AS n
             FROM enriched) e
            JOIN (SELECT session_id, {_WIDE} FROM long JOIN fitted USING (feature) GROUP BY session_id) w
                USING (session_id)) p
        ON p.user_id = r.user_id AND p.n = r.n - ({LENGTH - 1} - s.step)"""
)


def prepared_sql(split: str, keys: str, fit: str) -> str:
    """Check of prepared data: for each session and feature the values of all steps, each times its step.

    ``split`` gives the labelled sessions with their split, ``fit`` the rows that medians and quartiles come from.
    """
    structs = f"unnest([{_STRUCTS}], recursive := true)"
    frame = f"PARTITION BY {keys}, feature ORDER BY nr ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW"
    return with_views(
        "labelled",
        body=f""", placed AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY start_time, session_id) AS nr
            FROM ({split}) WHERE split IS NOT NULL),
        long AS (SELECT session_id, {structs} FROM ({fit})),
        fitted AS ({FITTED}),
        cells AS (SELECT session_id, user_id, split, label_user, label_session, nr, {structs} FROM placed),
        scaled AS (SELECT c.*, {SCALED} AS x FROM cells c JOIN fitted USING (feature))
        SELECT session_id, user_id, split, label_user, label_session, CAST({LENGTH} AS INTEGER) AS steps,
            CAST(least({LENGTH}, nr) AS INTEGER) AS real_steps, feature,
            round(({LENGTH} - nr) * sum(x) OVER w + sum(nr * x) OVER w, 5) AS total
        FROM scaled WINDOW w AS ({frame})""",
    ).replace("\n, placed AS", ",\nplaced AS", 1)
