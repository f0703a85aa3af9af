"""Sinks exercised on whole tables: what they wrote, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitor
from ..functions import fixed
from ..sources import sinks
from ..sources.adapters import read
from ..staging import folder, stage
from .registry import query
from .signals import metrics_of


@query(
    "a09_corpus_version",
    """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice ELSE 2 * o_totalprice END AS price FROM orders""",
)
def corpus_version(spark, sf_dir):
    """Second version of a corpus: the batch wins where both have a key, the first version stays readable."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"))
    root = folder(spark)
    none = o.where("false")
    first = sinks.write_corpus_version(none, o.where("o_orderkey % 3 <> 0"), ["o_orderkey"], root, 1)
    batch = o.where("o_orderkey % 3 <> 1").withColumn("price", 2 * F.col("price"))
    return sinks.write_corpus_version(first, batch, ["o_orderkey"], root, 2)


@query(
    "k25_children_rewritten",
    """SELECT o_orderkey AS id, CAST(year(o_orderdate) AS VARCHAR) AS run_date, CAST(CASE WHEN year(o_orderdate) >= 1996 THEN 2 ELSE 1 END AS INTEGER) AS written
    FROM orders WHERE year(o_orderdate) < 1996 OR o_orderkey % 4 = 0""",
)
def children_rewritten(spark, sf_dir):
    """A second write replaces the partitions it brings and leaves the others."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").cast("string").alias("run_date"))
    path = folder(spark)
    sinks.replace_children(rows.withColumn("written", F.lit(1)), path)
    sinks.replace_children(rows.where("run_date >= '1996' and id % 4 = 0").withColumn("written", F.lit(2)), path)
    return spark.read.parquet(path).select("id", F.col("run_date").cast("string").alias("run_date"), "written")


@query(
    "k23_events_appended",
    """SELECT event_id, event_type, false AS unstamped FROM events UNION ALL SELECT event_id, event_type, false FROM events WHERE event_id % 5 = 0""",
)
def events_appended(spark, sf_dir):
    """Two writes; a repeated event is another row, and every row has its time of writing."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type")
    path = folder(spark)
    sinks.append_events(e, path)
    sinks.append_events(e.where("event_id % 5 = 0"), path)
    return spark.read.parquet(path).select("event_id", "event_type", F.col("written_at").isNull().alias("unstamped"))


@query(
    "a12_profiles_by_domain",
    "SELECT 'upi' AS domain, * FROM x_prof_upi UNION ALL SELECT 'bbps' AS domain, * FROM x_prof_bbps",
)
def profiles_by_domain(spark, sf_dir):
    """Profiles of two domains in one table; the payment profile is first a wrong one and then rewritten."""
    path = folder(spark)

    def profile(d):
        m, key = metrics_of(spark, sf_dir, d)
        return stage(monitor.robust_profile(monitor.long_metrics(m, list(fixed.PATTERN_METRICS[d]), [key])))

    payments, bills = profile("upi"), profile("bbps")
    sinks.save_profile(bills, path, "upi")
    sinks.save_profile(bills, path, "bbps")
    sinks.save_profile(payments, path, "upi")
    parts = [sinks.load_profile(spark, path, d).withColumn("domain", F.lit(d)) for d in ("upi", "bbps")]
    return parts[0].unionByName(parts[1]).select("domain", *payments.columns)


@query("a13_frozen_table", "SELECT c_custkey, c_acctbal, 'a,b' AS selected_by_variance FROM customer WHERE c_custkey % 2 = 0")
def frozen_table(spark, sf_dir):
    """The first write wins; then the feature sink notes the selection on every row."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    path = folder(spark)
    sinks.write_once(c.where("c_custkey % 2 = 0"), path)
    frozen = sinks.write_once(c, path)
    out = folder(spark)
    sinks.write_feature_vectors(frozen, ["a", "b"], out)
    return spark.read.parquet(out)
