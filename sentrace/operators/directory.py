"""Directory snapshots: change flags, latest rows, and joins to sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrace.functions.columns import period_of, struct_of, text_literal
from sentrace.operators.ordered import previous_in_order

# Fixed: trait column -> name in the session features.
TRAIT_NAMES = {
    "o": "openness",
    "c": "conscientiousness",
    "e": "extraversion",
    "a": "agreeableness",
    "n": "neuroticism",
}


def snapshot_changes(
    snapshots: DataFrame,
    *,
    user: str = "user_id",
    period: str = "ldap_month",
    attrs: dict[str, str] | None = None,
    slice_chars: int = 4,
) -> DataFrame:
    """Previous value and change flag per attribute, last period, termination flag.

    ``attrs`` maps an attribute to the prefix of its flag. A NULL after a known value is a
    change. A user whose last period is not the last one of the data is terminated.
    Periods are sortable text; their first ``slice_chars`` characters cut long histories.
    """
    attrs = attrs or {"role": "role", "department": "dept"}
    sliced = snapshots.withColumn("_slice", F.substring(period, 1, slice_chars))
    previous = previous_in_order(sliced, [user], [period], "_slice", {f"prev_{a}": a for a in attrs})
    flags = [
        f"prev_{a} IS NOT NULL AND NOT ({a} <=> prev_{a}) AS {prefix}_changed" for a, prefix in attrs.items()
    ]
    last = snapshots.groupBy(user).agg(F.expr(f"max({period}) AS last_{period}"))
    final = snapshots.agg(F.max(period)).scalar()
    return (
        previous.drop("_slice")
        .selectExpr("*", *flags)
        .join(last, user, "left")
        .withColumn("is_terminated", F.col(f"last_{period}") < final)
    )


def snapshot_latest(history: DataFrame, *, user: str = "user_id", period: str = "ldap_month") -> DataFrame:
    """The row of the last period of each user."""
    row = struct_of(c for c in history.columns if c != user)
    return history.groupBy(user).agg(F.expr(f"max_by({row}, {period}) AS _row")).select(user, "_row.*")


def enrich_directory(
    features: DataFrame,
    history: DataFrame,
    *,
    session_period: str | None = None,
    period: str = "ldap_month",
    admin_role: str = "ITAdmin",
    carried: tuple[str, ...] = ("role", "department", "business_unit", "supervisor"),
) -> DataFrame:
    """Directory state of the period the session began in."""
    known = [c for c in carried if c in history.columns]
    facts = history.selectExpr(
        "user_id",
        f"{period} AS _period",
        *known,
        "role_changed",
        "dept_changed",
        "prev_role",
        "is_terminated",
        f"last_{period}",
    )
    keyed = features.selectExpr("*", f"{session_period or period_of('start_time')} AS _period")
    return keyed.join(facts, ["user_id", "_period"], "left").selectExpr(
        *features.columns,
        *known,
        f"CASE WHEN role = {text_literal(admin_role)} THEN 1 ELSE 0 END AS is_admin",
        "coalesce(role_changed, false) AS role_changed_this_month",
        "coalesce(dept_changed, false) AS dept_changed_this_month",
        "prev_role",
        "coalesce(is_terminated, false) AS user_terminated",
        f"last_{period}",
    )


def enrich_directory_latest(
    features: DataFrame,
    latest: DataFrame,
    *,
    admin_role: str = "ITAdmin",
    carried: tuple[str, ...] = ("role", "department", "business_unit"),
) -> DataFrame:
    """Fallback without history: the last known directory row of the user."""
    known = [c for c in carried if c in latest.columns]
    return features.join(latest.select("user_id", *known, "is_terminated"), "user_id", "left").selectExpr(
        *features.columns,
        *known,
        f"CASE WHEN role = {text_literal(admin_role)} THEN 1 ELSE 0 END AS is_admin",
        "coalesce(is_terminated, false) AS user_terminated",
    )


def enrich_traits(features: DataFrame, traits: DataFrame) -> DataFrame:
    named = traits.selectExpr("user_id", *[f"{c} AS {name}" for c, name in TRAIT_NAMES.items()])
    return features.join(named, "user_id", "left")


def directory_summary(features: DataFrame) -> DataFrame:
    return features.agg(
        F.expr("count(DISTINCT role) AS distinct_roles"),
        F.expr("count_if(role_changed_this_month) AS sessions_with_role_change"),
        F.expr("count_if(user_terminated) AS sessions_by_terminated"),
    )
