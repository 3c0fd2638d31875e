"""Checks of rows: which rules a row breaks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegate.config import CATEGORIES, RISKS
from framegate.functions.geometry import is_normalized

IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"


def finite(c: str) -> Column:
    """A number that is there, neither NaN nor infinite."""
    v = F.col(c).cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))


def _given(c: str) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def label_rules() -> dict[str, Column]:
    """Rule name -> what must hold of a label."""
    action = F.col("category").isin("action_success", "action_failure")
    times, texts = ("before_timestamp", "after_timestamp"), ("action_text", "expected_result")
    given = [*map(finite, times), *map(_given, texts)]
    return {
        "event_id": F.coalesce(F.col("event_id").rlike(IDENTIFIER), F.lit(False)),
        "case_id": F.coalesce(F.col("case_id").rlike(IDENTIFIER), F.lit(False)),
        "times": finite("start_s") & finite("end_s") & (F.col("start_s") >= 0) & (F.col("end_s") >= F.col("start_s")),
        "tolerance": finite("tolerance") & (F.col("tolerance") >= 0),
        "category": F.col("category").isin(*CATEGORIES),
        "risk": F.col("risk").isin(*RISKS),
        "region": F.col("region").isNull() | is_normalized(F.col("region")),
        "action_fields": F.when(action, given[0] & given[1] & given[2] & given[3]).otherwise(~(given[0] | given[1] | given[2] | given[3])),
        "action_order": ~action | ~(given[0] & given[1]) | (F.col("before_timestamp") < F.col("after_timestamp")),
    }


_F = "({0} IS NOT NULL AND NOT isnan({0}) AND NOT isinf({0}))"
_G = "coalesce(trim({0}) <> '', false)"
_ACTION = "category IN ('action_success', 'action_failure')"
_REGION = "coalesce(region.x >= 0 AND region.y >= 0 AND region.width > 0 AND region.height > 0 AND region.x + region.width <= 1 + 1e-9 AND region.y + region.height <= 1 + 1e-9, false)"
_FIELDS = [_F.format("before_timestamp"), _F.format("after_timestamp"), _G.format("action_text"), _G.format("expected_result")]
_RULES_SQL = {
    "event_id": "coalesce(regexp_full_match(event_id, '[A-Za-z0-9][A-Za-z0-9._-]*'), false)", "case_id": "coalesce(regexp_full_match(case_id, '[A-Za-z0-9][A-Za-z0-9._-]*'), false)",
    "times": f"{_F.format('start_s')} AND {_F.format('end_s')} AND start_s >= 0 AND end_s >= start_s", "tolerance": f"{_F.format('tolerance')} AND tolerance >= 0", "category": f"category IN {CATEGORIES}", "risk": f"risk IN {RISKS}", "region": f"region IS NULL OR {_REGION}",
    "action_fields": f"CASE WHEN {_ACTION} THEN {' AND '.join(_FIELDS)} ELSE {' AND '.join('NOT ' + f for f in _FIELDS)} END", "action_order": f"NOT {_ACTION} OR NOT ({_FIELDS[0]} AND {_FIELDS[1]}) OR before_timestamp < after_timestamp",
}
LABEL_SQL = "SELECT label_id, unnest(list_filter([" + ", ".join(f"CASE WHEN NOT coalesce(({sql}), false) THEN '{name}' END" for name, sql in _RULES_SQL.items()) + "], lambda x: x IS NOT NULL)) AS rule FROM ({labels})"


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """A row per broken rule: key, rule. A rule that is neither true nor false counts as broken. One pass, no shuffle."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()])
    return df.select(key, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))


def strict(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """df as it is; an error that names the key and the rule when a row that breaks one is read."""
    problem = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit(f"{name} of "), F.col(key).cast("string"))) for name, ok in rules.items()])
    return df.where(F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean")).otherwise(True))
