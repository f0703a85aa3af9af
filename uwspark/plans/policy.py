"""Credit policy under a patch, and the scorecard blended with a model score."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, scoring
from . import oracle
from .bank import prepared
from .registry import query

OUT = ["account_id", "scorecard_score", "score", "pd", "grade_raw", "gate_passed", "grade", "decision"]

#: Some accounts have a model score, from low to high; the rest have none.
_MODEL = """SELECT account_id, CAST(310 + 67 * (account_id % 9) AS DOUBLE) AS model_score, 'model-a' AS model_source
  FROM {source} WHERE account_id % 4 <> 0"""


@query(
    "k02_model_blend",
    f"""SELECT account_id, model_source, model_score IS NOT NULL AS ml_blended, scorecard_score, score,
      greatest(0.3, round_even((850.0 - score) / 850.0 * 18.0, 1)) AS pd,
      CASE WHEN score >= 700 THEN 'LOW' WHEN score >= 550 THEN 'MEDIUM' ELSE 'HIGH' END AS grade_raw, score > 650 AS gate_passed,
      CASE WHEN score > 650 THEN 'LOW' ELSE 'HIGH' END AS grade, CASE WHEN score > 650 THEN 'APPROVED' ELSE 'REJECTED' END AS decision
    FROM (SELECT s.account_id, scorecard_score, model_score, model_source,
        CAST(greatest(300.0, least(900.0, round_even(CASE WHEN model_score IS NULL THEN card ELSE (1.0 - 0.45::DOUBLE) * card + 0.45::DOUBLE * model_score END, 0))) AS BIGINT) AS score
      FROM x_score s LEFT JOIN ({_MODEL.format(source="x_score")}) m USING (account_id))""",
)
def model_blend(spark, sf_dir):
    vector = features.underwriting_vector(prepared(spark, sf_dir))
    model = spark.sql(_MODEL.format(source="{v}"), v=vector.select("account_id"))
    return scoring.gated(scoring.credit_score(vector, model)).select("model_source", "ml_blended", *OUT)


#: Numbers as text are taken, unknown names and unreadable values are ignored.
PATCH = {"baseline": "700", "gate_threshold": "600", "grade_low_min": 720, "grade_medium_min": 500, "pd_floor": 0.5, "pd_scale_max": 20, "bounce_cap": "none", "colour": 1}


@query(
    "j03_patched_policy",
    f"""SELECT account_id, CAST(round_even(card, 0) AS BIGINT) AS scorecard_score, score, greatest(0.5, round_even((850.0 - score) / 850.0 * 20.0, 1)) AS pd,
      CASE WHEN score >= 720 THEN 'LOW' WHEN score >= 500 THEN 'MEDIUM' ELSE 'HIGH' END AS grade_raw, score > 600 AS gate_passed,
      CASE WHEN score > 600 THEN 'LOW' ELSE 'HIGH' END AS grade, CASE WHEN score > 600 THEN 'APPROVED' ELSE 'REJECTED' END AS decision
    FROM (SELECT *, CAST(greatest(300.0, least(900.0, round_even(card, 0))) AS BIGINT) AS score FROM
      (SELECT *, {oracle.SCORE_SQL.replace("740.0", "700.0")} AS card FROM
        (SELECT *, CASE WHEN avg_monthly_inflow > 0 THEN (avg_monthly_inflow - avg_monthly_debit) / avg_monthly_inflow ELSE -1.0 END AS sr FROM x_vector)))""",
)
def patched_policy(spark, sf_dir):
    cfg = scoring.DEFAULT.patched(PATCH)
    vector = features.underwriting_vector(prepared(spark, sf_dir))
    return scoring.gated(scoring.credit_score(vector, cfg=cfg), cfg).select(*OUT)
