"""Feature fitting and transformation: impute, robust-scale, clip, one-hot, vector."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrace.functions.columns import text_literal
from sentrace.operators.ordered import ordinal
from sentrace.operators.quantiles import exact_quantiles, unpivot

# Fixed: base features in vector order.
NUMERIC_FEATURES = [
    "duration_minutes",
    "start_hour",
    "day_of_week",
    "is_weekend",
    "is_after_hours",
    "device_event_count",
    "usb_connect_count",
    "usb_disconnect_count",
    "http_request_count",
    "unique_domains",
    "email_count",
    "emails_sent",
    "emails_received",
    "total_attachments",
    "total_email_size",
    "external_email_count",
    "file_copy_count",
    "exe_copy_count",
    "doc_copy_count",
    "pdf_copy_count",
    "archive_copy_count",
    "total_actions",
    "action_density",
]

# Fixed: features used when the enrichment has added them.
OPTIONAL_FEATURES = [
    "is_admin",
    "role_changed_this_month",
    "dept_changed_this_month",
    "user_terminated",
    "openness",
    "conscientiousness",
    "extraversion",
    "agreeableness",
    "neuroticism",
]

ROLE_MODES = ("none", "roles", "units")

MODEL_SCHEMA = (
    "position int, feature string, kind string, median double, q1 double, q3 double, "
    "lo double, hi double, pad double"
)


@dataclass
class FeatureModel:
    """Fitted parameters: one record per vector position, and how roles are encoded."""

    rows: list[dict]
    role_mode: str = "none"
    role_to_unit: dict[str, str] = field(default_factory=dict)
    default_unit: str | None = None

    @property
    def numeric(self) -> list[dict]:
        return [r for r in self.rows if r["kind"] == "numeric"]

    @property
    def categories(self) -> list[str]:
        return [r["feature"].removeprefix("role_") for r in self.rows if r["kind"] == "role"]

    @property
    def names(self) -> list[str]:
        return [r["feature"] for r in self.rows]

    @property
    def padding(self) -> list[float]:
        return [r["pad"] for r in self.rows]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [tuple(r[c.split()[0]] for c in MODEL_SCHEMA.split(", ")) for r in self.rows], MODEL_SCHEMA
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """Write parameters and role map as two small Parquet tables."""
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/parameters")
        roles = [(role, unit) for role, unit in self.role_to_unit.items()]
        meta = [(self.role_mode, self.default_unit, roles)]
        schema = "role_mode string, default_unit string, roles array<struct<role:string,unit:string>>"
        spark.createDataFrame(meta, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/roles")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureModel:
        rows = [r.asDict() for r in spark.read.parquet(f"{path}/parameters").orderBy("position").collect()]
        meta = spark.read.parquet(f"{path}/roles").first()
        return cls(rows, meta["role_mode"], {r["role"]: r["unit"] for r in meta["roles"]}, meta["default_unit"])


def present_features(columns: Sequence[str], names: Sequence[str] | None = None, optional: bool = True) -> list[str]:
    """Base features that exist, then the optional ones that exist."""
    absent = [f for f in (names or []) if f not in columns]
    if absent:
        warnings.warn(f"features that the data do not have are left out: {', '.join(absent)}", stacklevel=2)
    found = [f for f in (names or NUMERIC_FEATURES) if f in columns]
    if optional:
        found += [f for f in OPTIONAL_FEATURES if f in columns]
    if not found:
        raise ValueError("no numeric feature column found")
    return found


def role_categories(df: DataFrame) -> list[str]:
    """Sorted distinct roles, one per vector position."""
    return sorted(r["role"] for r in df.where("role IS NOT NULL").select("role").distinct().collect())


def _quantiles(df: DataFrame, features: Sequence[str], fractions: Sequence[float]) -> dict:
    rows = exact_quantiles(unpivot(df, features), fractions).collect()
    return {(r["feature"], r["p"]): r["quantile"] for r in rows}


def fit_features(
    df: DataFrame,
    names: Sequence[str] | None = None,
    *,
    optional: bool = True,
    role_mode: str = "none",
    categories: Sequence[str] | None = None,
    role_map: object | None = None,
    clip_percentile: float = 100.0,
) -> FeatureModel:
    """Medians and quartiles of every feature; the driver sees one record per feature.

    ``role_map`` (for role_mode 'units') has ``unit_order``, ``role_to_unit`` and
    ``default_unit``. Quantiles of scaled values follow from those of imputed values,
    because scaling keeps order and is linear.
    """
    role_mode = (role_mode or "none").strip().lower()
    if role_mode not in ROLE_MODES:
        raise ValueError(f"role_mode must be one of {ROLE_MODES}")
    features = present_features(df.columns, names, optional)
    fractions = [0.25, 0.5, 0.75]
    if clip_percentile < 100.0:
        fractions += [(100.0 - clip_percentile) / 100.0, clip_percentile / 100.0]
    found = _quantiles(df, features, fractions)
    medians = {f: found.get((f, 0.5), 0.0) for f in features}
    # Imputed values move the quartiles of those features that had something missing.
    text = {f: f"count_if({f} IS NULL OR isnan(CAST({f} AS DOUBLE)))" for f in features}
    missing = df.agg(*[F.expr(f"{t} AS {f}") for f, t in text.items()]).first().asDict()
    holed = [f for f in features if missing[f]]
    if holed:
        imputed = df.selectExpr(*[f"{t} AS {f}" for f, t in _imputed({f: medians[f] for f in holed}).items()])
        found.update(_quantiles(imputed, holed, fractions))
    rows = []
    for position, f in enumerate(features):
        q1, mid, q3 = (found.get((f, p), medians[f]) for p in (0.25, 0.5, 0.75))
        scale = (q3 - q1) or 1.0
        lo = hi = None
        if clip_percentile < 100.0:
            lo, hi = ((found.get((f, p), medians[f]) - mid) / scale for p in fractions[3:])
        rows.append(
            {
                "position": position,
                "feature": f,
                "kind": "numeric",
                "median": medians[f],
                "q1": q1,
                "q3": q3,
                "lo": lo,
                "hi": hi,
                "pad": 0.0,  # the scaled median
            }
        )
    role_to_unit, default_unit = {}, None
    if role_mode != "none" and "role" in df.columns:
        if role_mode == "units":
            if role_map is None:
                raise ValueError("role_mode 'units' needs a role map")
            categories, role_to_unit = list(role_map.unit_order), dict(role_map.role_to_unit)
            default_unit = role_map.default_unit
        elif categories is None:
            categories = role_categories(df)
        else:
            categories = sorted(categories)
        for category in categories:
            rows.append(
                {
                    "position": len(rows),
                    "feature": f"role_{category}",
                    "kind": "role",
                    "median": None,
                    "q1": None,
                    "q3": None,
                    "lo": None,
                    "hi": None,
                    "pad": 0.0,
                }
            )
    return FeatureModel(rows, role_mode, role_to_unit, default_unit)


def _number(value: float) -> str:
    return f"{value!r}D"


def _imputed(medians: dict[str, float]) -> dict[str, str]:
    return {
        f: f"CASE WHEN isnan(CAST({f} AS DOUBLE)) THEN {_number(m)} "
        f"ELSE coalesce(CAST({f} AS DOUBLE), {_number(m)}) END"
        for f, m in medians.items()
    }


def _scaled(model: FeatureModel) -> dict[str, str]:
    out = {}
    for row, text in zip(model.numeric, _imputed({r["feature"]: r["median"] for r in model.numeric}).values()):
        scale = (row["q3"] - row["q1"]) or 1.0
        out[row["feature"]] = f"({text} - {_number(row['median'])}) / {_number(scale)}"
    return out


def _clipped(model: FeatureModel) -> dict[str, str]:
    out = _scaled(model)
    for row in model.numeric:
        if row["lo"] is not None:
            f = row["feature"]
            out[f] = f"least(greatest({out[f]}, {_number(row['lo'])}), {_number(row['hi'])})"
    return out


def _replace(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expressions[c]} AS {c}" if c in expressions else c for c in df.columns])


def impute(df: DataFrame, model: FeatureModel) -> DataFrame:
    """NULL and NaN become the fitted median; every feature becomes DOUBLE."""
    return _replace(df, _imputed({r["feature"]: r["median"] for r in model.numeric}))


def robust_scale(df: DataFrame, model: FeatureModel) -> DataFrame:
    """(x - median) / (q3 - q1), with 1 for a zero range."""
    return _replace(df, _scaled(model))


def clip_scaled(df: DataFrame, model: FeatureModel) -> DataFrame:
    """Scaled features cut to the fitted percentiles, if the model has them."""
    return _replace(df, _clipped(model))


def _one_hot(model: FeatureModel) -> str:
    """The one-hot array as SQL text: the role's place in the list of categories is looked up once."""
    if model.role_mode == "units":
        lookup = "CAST(NULL AS STRING)"
        if model.role_to_unit:
            pairs = ", ".join(f"{text_literal(r)}, {text_literal(u)}" for r, u in model.role_to_unit.items())
            lookup = f"element_at(map({pairs}), trim(role))"
        category = lookup
        if model.default_unit is not None:
            category = f"CASE WHEN role IS NOT NULL THEN coalesce({lookup}, {text_literal(model.default_unit)}) END"
    else:
        category = "role"
    if not model.categories:
        return "CAST(array() AS ARRAY<DOUBLE>)"
    names = f"array({', '.join(map(text_literal, model.categories))})"
    place = f"coalesce(array_position({names}, {category}), 0L)"
    return (
        f"transform(array({place}), p -> transform(sequence(1L, {len(model.categories)}L), "
        "i -> CASE WHEN i = p THEN 1D ELSE 0D END))[0]"
    )


def encode_roles(df: DataFrame, model: FeatureModel) -> DataFrame:
    """Adds ``role_vector``: one-hot by role, or by unit if the model maps roles to units.

    Unknown and missing roles give zeros, except unknown ones with a default unit.
    """
    return df.selectExpr("*", f"{_one_hot(model)} AS role_vector")


encode_role_units = encode_roles


def feature_vector(df: DataFrame, model: FeatureModel) -> DataFrame:
    """Adds ``features ARRAY<DOUBLE>`` in the order of ``model.names``."""
    numbers = f"array({', '.join(_clipped(model).values())})"
    vector = f"concat({numbers}, {_one_hot(model)})" if model.categories else numbers
    return df.selectExpr("*", f"{vector} AS features")


def role_dictionary(df: DataFrame) -> DataFrame:
    """(role, place): the distinct roles with their places (from 0) in byte order.

    Counts of the roles' leading bytes, summed in order, tell where each group of roles begins, so
    no task sorts all roles and none reaches the driver.
    """
    roles = df.where("role IS NOT NULL").select("role").distinct()
    sliced = roles.selectExpr("role", "substring(hex(role), 1, 12) AS _slice")
    return ordinal(sliced, [], ["role"], "_slice").selectExpr("role", "_n - 1 AS place")


def sparse_vector(df: DataFrame, model: FeatureModel, dictionary: DataFrame) -> DataFrame:
    """Adds ``sparse STRUCT<size, indices, values>``: the entries of the feature vector that are not 0.

    The scaled numeric features come first, then one position for each role of ``dictionary``
    (see :func:`role_dictionary`), however many there are: a row holds one entry for its
    role at most. Roles that are missing or not in the dictionary have none. ``model`` is
    fitted without roles. The dictionary is joined; it is broadcast only if it is measured small.
    """
    width = len(model.numeric)
    numbers = ", ".join(f"struct(CAST({i} AS BIGINT) AS i, {text} AS v)" for i, text in enumerate(_clipped(model).values()))
    own = f"CASE WHEN _place IS NULL THEN array() ELSE array(struct({width} + _place AS i, 1D AS v)) END"
    total = dictionary.agg(F.count("*")).scalar()
    placed = df.join(dictionary.selectExpr("role AS _role", "place AS _place"), F.expr("role = _role"), "left")
    entries = placed.withColumn("_roles", total).selectExpr(
        *df.columns, "_roles", f"filter(concat(array({numbers}), {own}), e -> e.v <> 0) AS _entries"
    )
    return entries.selectExpr(*df.columns, f"struct({width} + _roles AS size, _entries.i AS indices, _entries.v AS values) AS sparse")


def dense_vector(sparse: str) -> str:
    """A sparse struct as an array of all its values."""
    return f"transform(sequence(0L, {sparse}.size - 1), i -> coalesce(get({sparse}.values, CAST(array_position({sparse}.indices, i) - 1 AS INT)), 0D))"


def unknown_roles(df: DataFrame, roles: DataFrame) -> DataFrame:
    """Roles in the data that the map does not hold."""
    present = df.where("role IS NOT NULL").select("role").distinct()
    return present.join(roles.select("role").distinct(), "role", "left_anti")


def role_unit_lookup(df: DataFrame, roles: DataFrame, default_unit: str | None = None) -> DataFrame:
    """Adds ``unit`` by joining the role table on the trimmed role."""
    pairs = roles.selectExpr("role AS _role", "unit AS _unit")
    unit = "_unit" if default_unit is None else f"coalesce(_unit, {text_literal(default_unit)})"
    return (
        df.join(pairs, F.expr("trim(role) = _role"), "left")
        .selectExpr(*df.columns, f"CASE WHEN role IS NOT NULL THEN {unit} END AS unit")
    )
