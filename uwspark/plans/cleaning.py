"""Gather, clean, normalise, engineer and select: the statement preparation queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import fixed
from ..functions.columns import count_if, half_even
from ..operators import features, ledger
from ..sources import adapters
from ..staging import shared, stage
from . import oracle
from .registry import query


def cleaned(spark, sf_dir):
    """Surviving rows after recovery, staged for the feature branches."""
    build = lambda: ledger.cleaned_rows(ledger.clean_statement(adapters.bank_txn(spark, sf_dir)))
    return shared(spark, sf_dir, "cleaned", build)


@query("e03_amount_recovery", "SELECT account_id, seq, status, method, reason, imputed, amount, txn_type, balance FROM x_clean")
def recovery(spark, sf_dir):
    c = ledger.clean_statement(adapters.bank_txn(spark, sf_dir))
    return c.select(
        "account_id", "seq", "status", "method", "reason", "imputed",
        F.col("c_amount").alias("amount"), F.col("c_type").alias("txn_type"), F.col("c_balance").alias("balance"),
    )


@query(
    "e03_baseline_cleaning",
    """SELECT account_id, count(*) AS rows, CAST(count(*) FILTER (NOT coalesce(amount > 0, false)) AS BIGINT) AS dropped
    FROM x_bank GROUP BY 1""",
)
def baseline(spark, sf_dir):
    c = ledger.clean_statement(adapters.bank_txn(spark, sf_dir), recover=False)
    return c.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("rows"), count_if(F.col("status") == "dropped").alias("dropped")
    )


@query(
    "b27_narration_amount",
    f"""SELECT narration, TRY_CAST(replace(regexp_extract(narration, '{fixed.NARRATION_AMOUNT}', 1), ',', '') AS DOUBLE) AS amount,
      CASE WHEN {oracle._mentions(fixed.DEBIT_HINTS)} THEN 'DEBIT' WHEN {oracle._mentions(fixed.CREDIT_HINTS)} THEN 'CREDIT' END AS kind,
      count(*) AS n FROM x_bank GROUP BY ALL""",
)
def narration_amounts(spark, sf_dir):
    from ..functions.columns import guessed_type, narration_amount

    seen = adapters.bank_txn(spark, sf_dir).groupBy("narration").agg(F.count(F.lit(1)).alias("n"))
    return seen.select("narration", narration_amount("narration").alias("amount"), guessed_type("narration").alias("kind"), "n")


@query(
    "d24_cleaning_report",
    """SELECT account_id, count(*) AS total, CAST(count(*) FILTER (status = 'dropped') AS BIGINT) AS dropped,
      CAST(count(*) FILTER (status = 'recovered') AS BIGINT) AS recovered, CAST(count(*) FILTER (imputed) AS BIGINT) AS imputed,
      greatest(0, CAST(count(*) FILTER (status = 'dropped') AS BIGINT) - 25) AS truncated FROM x_clean GROUP BY 1""",
)
def report(spark, sf_dir):
    c = ledger.clean_statement(adapters.bank_txn(spark, sf_dir))
    dropped = count_if(F.col("status") == "dropped")
    return c.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("total"), dropped.alias("dropped"),
        count_if(F.col("status") == "recovered").alias("recovered"), count_if(F.col("imputed")).alias("imputed"),
        F.greatest(F.lit(0), dropped - 25).alias("truncated"),
    )


@query(
    "f05_first_dropped_rows",
    """SELECT account_id, seq, rk, narration, reason FROM
      (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY seq) AS rk FROM x_clean WHERE status = 'dropped') WHERE rk <= 25""",
)
def first_dropped(spark, sf_dir):
    c = ledger.clean_statement(adapters.bank_txn(spark, sf_dir)).where("status = 'dropped'")
    w = W.partitionBy("account_id").orderBy("seq")
    return (
        c.select("account_id", "seq", "narration", "reason")
        .withColumn("rk", F.row_number().over(w).cast("bigint"))
        .where("rk <= 25")
    )


@query(
    "d25_gathering_report",
    """SELECT s.account_id, CAST(count(b.account_id) AS BIGINT) AS rows, count(b.account_id) = 0 AS without_data
    FROM (SELECT s_suppkey AS account_id FROM supplier UNION SELECT -s_suppkey FROM supplier) s LEFT JOIN x_bank b USING (account_id) GROUP BY 1""",
)
def gathering(spark, sf_dir):
    acc = adapters.accounts(spark, sf_dir).select("account_id")
    selected = acc.unionByName(acc.select((-F.col("account_id")).alias("account_id"))).distinct()
    counts = adapters.bank_txn(spark, sf_dir).groupBy("account_id").agg(F.count(F.lit(1)).alias("rows"))
    return selected.join(counts, "account_id", "left").select(
        "account_id", F.coalesce("rows", F.lit(0)).alias("rows"), F.col("rows").isNull().alias("without_data")
    )


_FEATS = ", ".join(f"round({f}, 4) AS {f}" for f in fixed.BASE_FEATURES)


@query("d03_e04_session_features", f"SELECT account_id, {_FEATS} FROM x_feat")
def session_features(spark, sf_dir):
    f = features.session_features(cleaned(spark, sf_dir))
    return f.select("account_id", *[F.round(c, 4).alias(c) for c in fixed.BASE_FEATURES])


@query(
    "b13_b16_normalised_table",
    oracle.unpivot_sql("x_feat", fixed.BASE_FEATURES, oracle.NORMAL_COLS),
)
def normalised(spark, sf_dir):
    return features.normalised(features.session_features(cleaned(spark, sf_dir)), fixed.BASE_FEATURES)


@query(
    "b14_b16_engineered_table",
    oracle.unpivot_sql("x_feat_eng", fixed.ENGINEERED_FEATURES, oracle.NORMAL_COLS),
)
def engineered(spark, sf_dir):
    f = features.engineered(features.session_features(cleaned(spark, sf_dir)))
    return features.normalised(f, fixed.ENGINEERED_FEATURES)


@query(
    "e05_chunks",
    "SELECT account_id, CAST(chunk AS BIGINT) AS chunk, count(*) AS rows, min(seq) AS first_seq, max(seq) AS last_seq FROM x_chunks GROUP BY ALL",
)
def chunks(spark, sf_dir):
    c = features.chunked(cleaned(spark, sf_dir))
    return c.groupBy("account_id", "chunk").agg(
        F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


@query(
    "d18_e20_feature_ranking",
    "SELECT rank, feature, variance, rank <= 6 AS selected FROM x_ranking",
)
def ranking(spark, sf_dir):
    rows = stage(features.chunked(cleaned(spark, sf_dir)))
    samples = features.engineered(features.session_features(rows, ["account_id", "chunk"]))
    return features.feature_ranking(samples)


@query(
    "d10_duplicates",
    """SELECT account_id, CAST(exact_duplicates AS BIGINT) AS exact_duplicates, CAST(loose_duplicates AS BIGINT) AS loose_duplicates FROM
      (SELECT account_id, sum(n - 1) AS exact_duplicates FROM (SELECT account_id, narration, amount, txn_type, count(*) AS n FROM x_bank GROUP BY ALL) GROUP BY 1)
      JOIN (SELECT account_id, sum(n - 1) AS loose_duplicates FROM (SELECT account_id, lower(trim(narration)) AS t, round_even(amount, 2) AS a, count(*) AS n
        FROM x_bank GROUP BY ALL) GROUP BY 1) USING (account_id)""",
)
def duplicates(spark, sf_dir):
    return features.duplicate_rows(adapters.bank_txn(spark, sf_dir))


_SELECTED = ["balance_volatility", "credit_debit_ratio", "max_drawdown_pct", "large_tx_pct", "irregular_gap_score", "net_flow_ratio"]


@query(
    "k26_processed_rows",
    f"""SELECT account_id, round_even(avg_daily_balance, 0) AS adb, least(9.99, credit_debit_ratio) AS credit_debit,
      round_even(n / 30, 1) AS per_day, CAST(x AS BIGINT) AS exact_duplicates,
      round_even(({' + '.join(f"round_even({oracle.minmax_sql(n)}, 4)" for n in _SELECTED)}) / {len(_SELECTED)}, 3) AS norm_score
    FROM x_feat_eng JOIN (SELECT account_id, count(*) AS n FROM x_cleaned GROUP BY 1) USING (account_id)
    JOIN (SELECT account_id, sum(c - 1) AS x FROM (SELECT account_id, narration, amount, txn_type, count(*) AS c FROM x_cleaned GROUP BY ALL) GROUP BY 1) USING (account_id)""",
)
def processed(spark, sf_dir):
    rows = cleaned(spark, sf_dir)
    f = features.engineered(features.session_features(rows))
    sizes = rows.groupBy("account_id").agg(F.count(F.lit(1)).alias("rows"))
    return features.processed_row(f, features.duplicate_rows(rows), sizes, _SELECTED)


@query(
    "d23_noise_by_source",
    """SELECT account_id, round_even(worst, 0) AS cleanliness, CAST(least(95, greatest(1, round_even(100 - worst, 0))) AS BIGINT) AS noise,
      least(95, greatest(1, round_even(100 - worst, 0))) > 40 AS needs_recovery, worst_file FROM
      (SELECT account_id, min(clean) AS worst, arg_min(year, clean * 10000 + year) AS worst_file FROM
        (SELECT account_id, CAST(strftime(txn_date, '%Y') AS INTEGER) AS year, round_even(100.0 * count(balance) / count(*), 2) AS clean FROM x_bank GROUP BY ALL)
       GROUP BY 1)""",
)
def noise(spark, sf_dir):
    files = (
        adapters.bank_txn(spark, sf_dir)
        .groupBy("account_id", F.year("txn_date").alias("file"))
        .agg(half_even(100.0 * F.count("balance") / F.count(F.lit(1)), 2).alias("clean"))
    )
    worst = F.min("clean")
    level = F.least(F.lit(95.0), F.greatest(F.lit(1.0), half_even(100 - worst)))
    return files.groupBy("account_id").agg(
        half_even(worst).alias("cleanliness"), level.cast("bigint").alias("noise"), (level > 40).alias("needs_recovery"),
        F.min_by("file", F.struct("clean", "file")).alias("worst_file"),
    )
