"""The driver's star-schema tables seen as ledgers, payment logs and tax returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.columns import half_even
from ..operators.scale import number_rows, spread_hot, with_block

# Narrations by part number modulo 16 (fixed values, in order).
NARRATIONS = [
    "NEFT ACME SALARY", "HOME LOAN EMI", "GST PAYMENT", "ATM CASH WITHDRAWAL", "RENT PAYMENT",
    "ELECTRICITY BILL", "BBPS PAYMENT", "UPI STORE @ybl", "TXN REVERSED", "ECS RETURN",
    "TDS INCOME TAX", "WATER BILL", "BROADBAND BILL", "MOBILE RECHARGE", "CASH WITHDRAWAL",
    "VENDOR PAYOUT RS.1,250.00",
]
MCC_CYCLE = ["5411", "5812", "5541", "7995", "6051", "5912"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("account_id"),
        F.col("s_acctbal").alias("opening_balance"),
        F.col("s_name").alias("account_holder"),
    )


def bank_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement row per line item; the account is the supplier."""
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("account_id"),
        F.to_date("l_shipdate").alias("txn_date"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_linestatus",
    )
    runs = {"_day": F.unix_date("txn_date"), "_slice": F.floor(F.col("l_orderkey") / 65536)}
    numbered = number_rows(
        spread_hot(lines, ["account_id"], runs),
        ["account_id"],
        list(runs),
        ["txn_date", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"],
    )
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    templates = F.array(*[F.lit(t) for t in NARRATIONS])
    balance = F.floor(
        F.col("l_extendedprice") * (F.col("l_discount") * 10 + 0.5) - 20000 * F.col("l_tax")
    ).cast("double")
    out = numbered.join(parts, "l_partkey").select(
        "account_id",
        "seq",
        "txn_date",
        F.concat_ws(
            " ", F.element_at(templates, (F.col("l_partkey") % 16 + 1).cast("int")), F.col("p_brand")
        ).alias("narration"),
        F.when(F.col("l_linestatus") == "O", "CREDIT").otherwise("DEBIT").alias("txn_type"),
        F.when(F.col("seq") % 17 != 16, F.col("l_extendedprice")).alias("amount"),
        F.when(F.col("seq") % 5 == 0, balance).alias("balance"),
    )
    return with_block(out)


def upi_txn(spark: SparkSession, sf_dir: str, shift_months: bool = False) -> DataFrame:
    """One mobile payment per event; the account is the user.

    `shift_months` spreads the single month of the source over six months.
    """
    ev = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("account_id"),
        "event_id",
        "ts",
        F.to_date("ts").alias("txn_date"),
        "event_type",
        F.col("value").alias("amount"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    if shift_months:
        ev = ev.withColumn("txn_date", F.add_months("txn_date", (F.col("event_id") % 6).cast("int")))
    runs = {"_day": F.unix_date(F.to_date("ts")), "_slice": F.hour("ts") * 60 + F.minute("ts")}
    ev = number_rows(
        spread_hot(ev, ["account_id"], runs), ["account_id"], list(runs), ["ts", "event_id"]
    )
    credit = F.col("event_type").isin("signup", "click")
    even = F.col("k") % 2 == 0
    cycle = F.array(*[F.lit(m) for m in MCC_CYCLE])
    return with_block(
        ev.select(
            "account_id",
            "seq",
            "txn_date",
            F.when(credit, "CREDIT").otherwise("DEBIT").alias("txn_type"),
            "amount",
            F.when(credit, F.concat(F.lit("p"), (F.col("k") % 15).cast("string"), F.lit("@upi"))).alias("payer_vpa"),
            F.when(~credit, F.concat(F.lit("m"), (F.col("k") % 20).cast("string"), F.lit("@upi"))).alias("payee_vpa"),
            F.when(even, "P2M").otherwise("P2P").alias("mode"),
            F.when(even, F.element_at(cycle, ((F.col("k") / 2).cast("int") % 6 + 1).cast("int"))).alias("mcc"),
            F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("status"),
        )
    )


def gst_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (gstin, period, return type), one wide nullable schema."""
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
        F.to_date("l_shipdate").alias("d"),
    )
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    buyers = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey"
    )
    sellers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    keys = ["l_suppkey", "month_start"]
    # The buyer is known before the lines move; they move once more, to the month of their seller, and every figure is taken there.
    base = (
        lines.join(orders.join(buyers, "o_custkey"), "l_orderkey")
        .join(sellers, "l_suppkey")
        .select(
            "l_suppkey",
            F.trunc("d", "month").alias("month_start"),
            net.alias("net"),
            "l_tax", "l_discount", "l_returnflag", "l_partkey", "o_custkey",
            (F.col("c_mktsegment") != "HOUSEHOLD").alias("b2b"),
            ((F.col("c_nationkey") != F.col("s_nationkey")) & (F.col("l_returnflag") == "A")).alias("export"),
        )
        .repartition(*keys)
    )
    kept = F.col("l_returnflag") != "R"
    itc = F.col("net") * F.col("l_tax") * F.col("l_discount") * 10

    def total(value, cond=None):
        picked = value if cond is None else F.when(cond, value)
        return half_even(F.coalesce(F.sum(picked), F.lit(0.0)), 4)

    buyer, part = W.partitionBy(*keys, "o_custkey"), W.partitionBy(*keys, "l_partkey")
    seen = base.withColumn("spent", F.sum("net").over(buyer)).withColumns(
        {
            "new_buyer": F.row_number().over(buyer.orderBy("o_custkey")) == 1,
            "new_part": F.row_number().over(part.orderBy("l_partkey")) == 1,
        }
    )
    wide = (
        seen.where("month_start is not null")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(F.when(kept, 1).otherwise(0)).alias("kept_rows"),
            total(F.col("net")).alias("taxable_value"),
            total(F.col("net"), F.col("b2b")).alias("b2b_value"),
            total(F.col("net"), ~F.col("b2b")).alias("b2c_value"),
            total(F.col("net"), F.col("export")).alias("export_value"),
            F.sum(F.when(F.col("b2b"), 1).otherwise(0)).cast("double").alias("b2b_invoice_count"),
            total(F.col("net"), kept).alias("outward_taxable_value"),
            total(F.col("net") * F.col("l_tax")).alias("outward_igst"),
            total(itc).alias("itc_total"),
            total(itc, ~kept).alias("itc_reversed"),
            total(F.col("net") * F.col("l_tax") * 0.5).alias("itc_available_total"),
            half_even(F.max("spent"), 4).alias("top_buyer_value"),
            F.count_if("new_buyer").alias("unique_buyer_count"),
            F.count_if("new_part").alias("parts"),
        )
        .withColumns(
            {
                "gstin": F.concat(F.lit("GST"), F.lpad(F.col("l_suppkey").cast("string"), 10, "0")),
                "period": F.date_format("month_start", "yyyy-MM"),
            }
        )
    )
    due = F.date_add(F.add_months("month_start", 1), 19)
    none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("date")
    fields = {
        "taxable_value": "GSTR1", "b2b_value": "GSTR1", "b2c_value": "GSTR1", "export_value": "GSTR1",
        "b2b_invoice_count": "GSTR1", "unique_buyer_count": "GSTR1", "top_buyer_value": "GSTR1",
        "outward_taxable_value": "GSTR3B", "outward_igst": "GSTR3B", "itc_total": "GSTR3B",
        "itc_reversed": "GSTR3B", "itc_available_total": "GSTR2B", "supplier_count": "GSTR2B",
    }
    src = {"supplier_count": F.col("parts")}

    def one(kind: str):
        cols = [F.lit(kind).alias("return_type")]
        cols.append((due if kind == "GSTR3B" else none_s).alias("due_date"))
        filed = F.date_add(due, (F.col("rows") % 7 - 3).cast("int"))
        cols.append((filed if kind == "GSTR3B" else none_s).alias("filing_date"))
        for name, owner in fields.items():
            value = src.get(name, F.col(name)).cast("double") if owner == kind else none_d
            cols.append(value.alias(name))
        return F.struct(*cols)

    exploded = wide.withColumn(
        "r",
        F.explode(
            F.filter(
                F.array(one("GSTR1"), one("GSTR3B"), one("GSTR2B")),
                lambda r: (r["return_type"] != "GSTR3B") | (F.col("kept_rows") > 0),
            )
        ),
    )
    return exploded.select("gstin", "period", "r.*")
