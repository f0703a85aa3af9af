"""Run history, dashboard and corpus tables: upserts, latest-per-key, semi and anti joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import count_if, half_even


def keep_last(df: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    """One row per key, the last by `order`: a max over structs, combined before the shuffle."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def merge_corpus(base: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of corpus and batch, the batch winning on equal keys."""
    both = base.withColumn("_ord", F.lit(0)).unionByName(batch.withColumn("_ord", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, "_ord").drop("_ord")


def merge_report(base: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows added, skipped as already known, and the size after the merge; one row."""
    old = base.select(*keys).distinct().withColumn("_o", F.lit(1))
    new = batch.select(*keys).distinct().withColumn("_n", F.lit(1))
    j = old.join(new, list(keys), "full")
    return j.agg(
        count_if(F.col("_o").isNull()).alias("added"),
        count_if(F.col("_o").isNotNull() & F.col("_n").isNotNull()).alias("skipped_duplicates"),
        F.count(F.lit(1)).alias("total"),
    )


def corpus_stats(df: DataFrame, bank: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.countDistinct(bank).alias("banks"),
    )


def application_key(ref: str, holder: str, file_name: str, source: str) -> Column:
    """ref, else name, else file stem, else source, with a prefix saying which."""
    clean = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    typed, name, file = clean(ref), clean(holder), F.col(file_name)
    stem = F.lower(F.trim(F.regexp_replace(file, r"\.[^.]*$", "")))
    return (
        F.when((typed != "") & (typed != "applicant"), F.concat(F.lit("ref:"), typed))
        .when(name != "", F.concat(F.lit("name:"), name))
        .when(F.coalesce(file, F.lit("")) != "", F.concat(F.lit("file:"), stem))
        .otherwise(F.concat(F.lit("src:"), F.coalesce(F.col(source), F.lit("unknown"))))
    )


def entity() -> Column:
    """Statement, else applicant, else the run itself."""
    return F.coalesce("statement_id", -F.col("applicant_id"), -1000000 - F.col("id"))


def representative_runs(runs: DataFrame) -> DataFrame:
    """Latest risk-model run per entity among the real ones."""
    real = runs.where("data_source = 'UPLOADED_STATEMENT' and model_id = 'risk_model'")
    newest = real.groupBy(entity().alias("_e")).agg(F.max("id").alias("id")).select("id")
    return runs.join(newest, "id", "left_semi")


def dashboard(one: DataFrame, pending: DataFrame) -> DataFrame:
    """Headline figures in one row; `pending` is a one-row count."""
    k = one.agg(
        F.count(F.lit(1)).alias("analyzed"),
        F.coalesce(F.sum("transaction_count"), F.lit(0)).cast("bigint").alias("processed"),
        half_even(F.avg("credit_score"), 1).alias("avg_score"),
        F.coalesce(F.sum("anomaly_count"), F.lit(0)).cast("bigint").alias("anomalies"),
    )
    return k.withColumn("_one", F.lit(1)).join(pending.withColumn("_one", F.lit(1)), "_one").drop("_one")


def breakdown(one: DataFrame) -> DataFrame:
    """Counts by grade and by decision in one long table."""
    g = one.groupBy(F.lit("grade").alias("kind"), F.col("risk_grade").alias("value"))
    d = one.groupBy(F.lit("decision").alias("kind"), F.col("decision").alias("value"))
    n = F.count(F.lit(1)).alias("runs")
    return g.agg(n).unionByName(d.agg(n))


def pending_cases(evaluations: DataFrame, runs: DataFrame) -> DataFrame:
    open_ = evaluations.where("decision in ('CONDITIONAL APPROVAL', 'APPROVED WITH NOTES')")
    return open_.join(runs.select(F.col("id").alias("run_id"), "statement_id"), "run_id").agg(
        F.countDistinct("statement_id").alias("pending")
    )


def recent_runs(one: DataFrame, applicants: DataFrame, keep: int = 8) -> DataFrame:
    """The newest runs first cut to `keep`, then joined to their applicants."""
    newest = one.orderBy(F.col("id").desc()).limit(keep)
    a = applicants.select(F.col("id").alias("applicant_id"), F.col("name").alias("applicant_name"))
    return newest.join(a, "applicant_id", "left")


def orphan_applicants(applicants: DataFrame, statements: DataFrame, runs: DataFrame) -> DataFrame:
    ids = lambda d: d.select(F.col("applicant_id").alias("id"))
    return applicants.join(ids(statements), "id", "left_anti").join(ids(runs), "id", "left_anti")


def stray_runs(runs: DataFrame, applicants: DataFrame) -> DataFrame:
    """Runs without a statement whose applicant is named after a raw file (`stmt_...`)."""
    named = applicants.where(r"name like 'stmt\\_%'").select(F.col("id").alias("applicant_id"))
    return runs.where("statement_id is null").join(named, "applicant_id", "left_semi")


def backfill(cache: DataFrame, runs: DataFrame) -> DataFrame:
    """Cached runs whose (applicant, model) has no statement-less run yet."""
    known = runs.where("statement_id is null").select("applicant_id", "model_id").distinct()
    return cache.join(known, ["applicant_id", "model_id"], "left_anti")


def latest_run_of_latest_statement(statements: DataFrame, runs: DataFrame) -> DataFrame:
    """Per source: newest statement and its newest run, else the newest real run of all."""
    newest_stmt = statements.groupBy("source_id").agg(F.max("id").alias("statement_id"))
    per_stmt = runs.where("statement_id is not null").groupBy("statement_id").agg(F.max("id").alias("run_id"))
    fallback = runs.where("data_source = 'UPLOADED_STATEMENT'").agg(F.max("id").alias("any_run"))
    return (
        newest_stmt.join(per_stmt, "statement_id", "left")
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(fallback.withColumn("_one", F.lit(1))), "_one")
        .select("source_id", "statement_id", F.coalesce("run_id", "any_run").alias("run_id"))
    )


def with_model_version(runs: DataFrame, versions: DataFrame) -> DataFrame:
    v = versions.select(F.col("version").alias("_v"), F.col("id").alias("model_version_id"))
    number = F.regexp_extract("model_source", r"^dataset-v(\d+)$", 1).try_cast("int")
    return runs.withColumn("_v", number).join(v, "_v", "left").drop("_v")


def upsert_runs(runs: DataFrame) -> DataFrame:
    """One row per (statement, model), the newest; runs without a statement all stay."""
    linked = keep_last(runs.where("statement_id is not null"), ["statement_id", "model_id"], "id")
    return linked.unionByName(runs.where("statement_id is null"))


def test_history(runs: DataFrame) -> DataFrame:
    """One row per application: its models newest first, as a nested list."""
    newest = keep_last(runs, ["application_key", "model_id"], "id")
    # A handful of models per application.
    item = F.struct(F.col("id"), F.col("model_id"), F.col("credit_score"), F.col("decision"))
    return newest.groupBy("application_key").agg(
        F.max("id").alias("last_id"),
        F.count(F.lit(1)).alias("models"),
        F.sort_array(F.collect_list(item), asc=False).alias("history"),
    )


def star_tables(statements: DataFrame, txns: DataFrame, applicants: DataFrame) -> dict[str, DataFrame]:
    """Applicant, statement and transaction rows of a load.

    `statements`: account_id, account_holder, digest, parser, ...; known applicants are
    found by name, others get an id derived from the name.
    """
    names = statements.select("account_holder").where("account_holder is not null").distinct()
    known = applicants.select(F.col("name").alias("account_holder"), F.col("id").alias("applicant_id"))
    who = names.join(known, "account_holder", "left").withColumn(
        "applicant_id", F.coalesce("applicant_id", F.abs(F.xxhash64("account_holder")))
    )
    stmt = statements.join(who, "account_holder", "left")
    money = lambda c: F.col(c).cast("decimal(16,2)").alias(c)
    return {
        "applicants": who.select(F.col("applicant_id").alias("id"), F.col("account_holder").alias("name")),
        "statements": stmt,
        "transactions": txns.select(
            F.col("account_id").alias("statement_id"), "seq", "txn_date", "narration", "txn_type",
            money("amount"), money("balance"),
        ),
    }


def newest(df: DataFrame, order: str, keep: int) -> DataFrame:
    return df.orderBy(F.col(order).desc()).limit(keep)


def ranked_within(df: DataFrame, key: str, order: Column, keep: int) -> DataFrame:
    """First rows of each key; the rank filter turns into a per-task limit."""
    w = W.partitionBy(key).orderBy(order)
    return df.withColumn("rk", F.row_number().over(w).cast("bigint")).where(F.col("rk") <= keep)


def recent_activity(one: DataFrame, applicants: DataFrame, statements: DataFrame, keep: int = 8) -> DataFrame:
    """The newest runs with the best name there is for applicant and bank.

    Both joins are outer: a run may lack its applicant, its statement, or both.  The name falls back from
    the reference id to the applicant's name, the file name, the statement number and the run number;
    the bank from the applicant's to the file name and a dash.  Empty texts count as missing.
    """
    latest = newest(one, "id", keep)
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    a = applicants.select(F.col("id").alias("applicant_id"), text("ref_id").alias("_ref"), text("name").alias("_name"), text("bank_name").alias("_bank"))
    s = statements.select(F.col("id").alias("statement_id"), text("file_name").alias("_file"), F.lit(True).alias("_known"))
    number = F.when(F.col("_known"), F.concat(F.lit("Statement #"), F.col("statement_id").cast("string")))
    return (
        latest.join(a, "applicant_id", "left")
        .join(s, "statement_id", "left")
        .select(
            "id",
            F.coalesce("_ref", "_name", "_file", number, F.concat(F.lit("RUN-"), F.col("id").cast("string"))).alias("label"),
            F.coalesce("_bank", F.when(F.col("_known"), F.coalesce("_file", F.lit("-"))), F.lit("-")).alias("bank"),
            F.col("created_at").alias("date"),
            "transaction_count",
            "credit_score",
            "risk_grade",
            F.lit("ANALYZED").alias("status"),
        )
    )


def attached_evaluations(evaluations: DataFrame, statements: DataFrame, runs: DataFrame) -> DataFrame:
    """Evaluations with the run they belong to, the newest one per run.

    An evaluation (id, source_id, at) sees what was there when it was made: the newest statement of its source
    (id) with at most its time, and the newest run of that statement with at most its time; without one, the
    newest uploaded run of all.  Without any run it is dropped.  A later evaluation of a run replaces the
    earlier one (the higher id).

    One aggregate per key: statements and runs become steps of a source and of a statement, each holding what
    is newest from its time on, so an evaluation finds its step by the greatest time at or before its own.
    """
    steps = statements.groupBy("source_id", "at").agg(F.max("id").alias("id"))
    # what is newest at a step is a running maximum over the steps of one source, one row per time
    w = W.partitionBy("source_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    steps = steps.select("source_id", "at", F.max("id").over(w).alias("statement_id"))
    e = evaluations.select("id", "source_id", "at")
    found = _as_of(e, steps, "source_id", "statement_id")
    linked = runs.where("statement_id is not null").groupBy("statement_id", "at").agg(F.max("id").alias("id"))
    v = W.partitionBy("statement_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    run_steps = linked.select("statement_id", "at", F.max("id").over(v).alias("run_id"))
    own = _as_of(found, run_steps, "statement_id", "run_id")
    real = runs.where("data_source = 'UPLOADED_STATEMENT'").groupBy("at").agg(F.max("id").alias("id")).withColumn("_all", F.lit(1))
    # one row per day of the history
    u = W.partitionBy("_all").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    all_steps = real.select("_all", "at", F.max("id").over(u).alias("any_run"))
    out = _as_of_days(own, all_steps)
    out = out.withColumn("run_id", F.coalesce("run_id", "any_run")).where("run_id is not null")
    newest_of = out.groupBy("run_id").agg(F.max("id").alias("id"))
    return evaluations.join(newest_of, "id")


def _as_of(rows: DataFrame, steps: DataFrame, key: str, value: str) -> DataFrame:
    """Left as-of join: the value of the last step of the key at or before the time of each row.

    Rows and steps are laid on one time line per (key, month); the last step of the months before comes
    from one row per month, so a key is as many tasks as it has months.
    """
    month = F.trunc("at", "month").alias("_month")
    nowhere, rows = rows.where(F.col(key).isNull()), rows.where(F.col(key).isNotNull())
    line = rows.select(*rows.columns, month, F.lit(None).cast("bigint").alias("_v"), F.lit(1).alias("_row")).unionByName(
        steps.select(key, "at", month, F.col(value).cast("bigint").alias("_v"), F.lit(0).alias("_row")), allowMissingColumns=True
    )
    inside = W.partitionBy(key, "_month").orderBy("at", "_row").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(key).orderBy("_month").rowsBetween(W.unboundedPreceding, -1)
    carried = line.groupBy(key, "_month").agg(F.max("_v").alias("_m")).select(key, "_month", F.max("_m").over(before).alias("_c"))
    found = (
        line.withColumn(value, F.last("_v", ignorenulls=True).over(inside))
        .where("_row = 1")
        .join(carried, [key, "_month"], "left")
        .select(*rows.columns, F.coalesce(F.col(value), F.col("_c")).alias(value))
    )
    return found.unionByName(nowhere.withColumn(value, F.lit(None).cast("bigint")))


def _as_of_days(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """The same with the day as the only key: every day that has rows gets the value of its day."""
    days = rows.select("at").distinct().withColumn("_all", F.lit(1))
    known = _as_of(days, steps, "_all", "any_run").drop("_all")
    return rows.join(F.broadcast(known), "at", "left")
