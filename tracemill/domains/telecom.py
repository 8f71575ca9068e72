"""Customers, lines and bills: lookups, usage, line states, roaming, refuelling, payment requests.

customers: customer_id, full_name, date_of_birth, phone_number, line_ids,
bill_ids; lines: line_id, phone_number, plan_id, status, suspension_start,
roaming_enabled, data_used_gb, data_refueling_gb; plans: plan_id,
data_limit_gb, refuel_price; bills: bill_id, customer_id, status, issue_date,
total_due.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.domains.common import apply_changes, rules
from tracemill.functions.values import cycle_end


def by_phone(customers: DataFrame, lines: DataFrame, phone: str) -> DataFrame:
    """Customers whose own number it is, or whose line has it."""
    hit = lines.where(F.col("phone_number") == phone).select("line_id")
    owned = customers.select("customer_id", F.explode("line_ids").alias("line_id")).join(hit, "line_id", "left_semi").select("customer_id").withColumn("by_line", F.lit(True)).distinct()
    return customers.join(owned, "customer_id", "left").where((F.col("phone_number") == phone) | F.col("by_line")).drop("by_line")


def by_name(customers: DataFrame, full_name: str, born: str) -> DataFrame:
    return customers.where((F.lower("full_name") == F.lower(F.lit(full_name))) & (F.col("date_of_birth") == born))


def bills_of(customers: DataFrame, bills: DataFrame, customer_id: str, limit: int = 12) -> DataFrame:
    """A customer's bills, newest first."""
    ids = customers.where(F.col("customer_id") == customer_id).select(F.explode("bill_ids").alias("bill_id"))
    return bills.join(ids, "bill_id", "left_semi").orderBy(F.desc("issue_date"), "bill_id").limit(limit)


def data_usage(customers: DataFrame, lines: DataFrame, plans: DataFrame, customer_id: str, line_id: str, today: str, same_year: bool = False) -> DataFrame:
    """Usage and limit of a line that the customer owns, and the end of the cycle."""
    owned = customers.where((F.col("customer_id") == customer_id) & F.array_contains("line_ids", line_id)).select(F.lit(line_id).alias("line_id"))
    d = lines.join(owned, "line_id", "left_semi").join(plans, "plan_id")
    return d.select("line_id", "data_used_gb", "data_limit_gb", "data_refueling_gb", cycle_end(F.lit(today).cast("date"), same_year).alias("cycle_end"))


def _owned(customers: DataFrame, lines: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (customer_id, line_id, ...) with the line, and whether the customer owns it."""
    own = customers.select("customer_id", F.explode("line_ids").alias("line_id")).withColumn("owned", F.lit(True))
    return requests.join(own, ["customer_id", "line_id"], "left").join(lines, "line_id", "left").withColumn("owned", F.coalesce("owned", F.lit(False)) & F.col("status").isNotNull())


def suspend_lines(customers: DataFrame, lines: DataFrame, requests: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    d = _owned(customers, lines, requests).withColumn("rule", rules((~F.col("owned"), "no_line"), (F.col("status") != "Active", "not_active")))
    d = d.select("line_id", "rule", F.lit("Suspended").alias("new_status"), F.lit(today).alias("new_suspension_start"))
    return apply_changes(lines, d, "line_id"), d.select("line_id", "rule")


def resume_lines(customers: DataFrame, lines: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    d = _owned(customers, lines, requests).withColumn("rule", rules((~F.col("owned"), "no_line"), (~F.col("status").isin("Suspended", "Pending Activation"), "not_suspended")))
    d = d.select("line_id", "rule", F.lit("Active").alias("new_status"), F.lit(None).cast("string").alias("new_suspension_start"))
    return apply_changes(lines, d, "line_id"), d.select("line_id", "rule")


def set_roaming(customers: DataFrame, lines: DataFrame, requests: DataFrame, on: bool) -> tuple[DataFrame, DataFrame]:
    """Lines that have the setting already stay and say so."""
    d = _owned(customers, lines, requests).withColumn("rule", rules((~F.col("owned"), "no_line"), (F.col("roaming_enabled") == F.lit(on), "already")))
    d = d.select("line_id", "rule", F.lit(on).alias("new_roaming_enabled"))
    return apply_changes(lines, d, "line_id"), d.select("line_id", "rule")


def request_payments(customers: DataFrame, bills: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests: customer_id, bill_id; one bill of a customer awaits payment at a time; a bill that is paid is not told apart."""
    waiting = bills.where("status = 'Awaiting Payment'").groupBy("customer_id").agg(F.count("*").alias("waiting"))
    d = requests.join(customers.select("customer_id", "bill_ids"), "customer_id", "left").join(waiting, "customer_id", "left")
    d = d.withColumn("rule", rules((F.col("bill_ids").isNull(), "no_customer"), (F.coalesce("waiting", F.lit(0)) > 0, "already_waiting"), (~F.array_contains("bill_ids", F.col("bill_id")), "no_bill")))
    d = d.select("bill_id", "rule", F.lit("Awaiting Payment").alias("new_status"))
    return apply_changes(bills, d, "bill_id"), d.select("bill_id", "rule")


def refuel(customers: DataFrame, lines: DataFrame, plans: DataFrame, bills: DataFrame, requests: DataFrame, today: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests: customer_id, line_id, gb. (lines, bills, outcomes): data is added, its price goes to the draft bill, made for next month if there is none."""
    d = _owned(customers, lines, requests).join(plans.select("plan_id", "refuel_price"), "plan_id", "left")
    d = d.withColumn("rule", rules((~F.col("owned"), "no_line"), (F.col("gb") <= 0, "amount"), (F.col("refuel_price").isNull(), "no_plan")))
    d = d.withColumn("charge", F.col("gb") * F.col("refuel_price")).withColumn("new_data_refueling_gb", F.col("data_refueling_gb") + F.col("gb"))
    due = d.where("rule = 'ok'").groupBy("customer_id").agg(F.sum("charge").alias("charge"))
    draft = bills.where("status = 'Draft'").groupBy("customer_id").agg(F.min("bill_id").alias("bill_id"))
    due = due.join(draft, "customer_id", "left")
    first = F.add_months(F.trunc(F.lit(today).cast("date"), "month"), 1)
    new = due.where("bill_id is null").select(F.concat(F.lit("B"), F.substring(F.sha2(F.concat_ws("|", "customer_id", F.lit(today)), 256), 1, 8)).alias("bill_id"), "customer_id", F.lit("Draft").alias("status"), first.cast(bills.schema["issue_date"].dataType).alias("issue_date"), F.col("charge").alias("total_due"))
    more = bills.join(due.where("bill_id is not null").select("bill_id", "charge"), "bill_id", "left")
    out = more.select(*[(F.col("total_due") + F.coalesce("charge", F.lit(0.0))).alias(c) if c == "total_due" else F.col(c) for c in bills.columns])
    return apply_changes(lines, d.select("line_id", "rule", "new_data_refueling_gb"), "line_id"), out.unionByName(new), d.select("line_id", "rule", "charge")


def sync_world(surroundings: DataFrame, customers: DataFrame, lines: DataFrame, plans: DataFrame, bills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(surroundings, bills) after both sides have told each other.

    Surroundings: user_id, phone_number, request_bill_id, request_amount,
    request_paid. The line's state tells whether the user may connect, roam and
    has used up the data; a request that is paid settles its bill and goes; a
    user without one gets the first bill that awaits payment in the customer's own list. Users
    without a number stay as they are; a number without a line or plan raises.
    """
    line = lines.join(plans.select("plan_id", "data_limit_gb"), "plan_id", "left").select(
        "phone_number",
        (F.col("status") == "Active").alias("line_active"),
        F.col("roaming_enabled").alias("roaming_allowed"),
        (F.col("data_used_gb") >= F.col("data_limit_gb") + F.col("data_refueling_gb")).alias("usage_exceeded"),
        "line_id",
        F.col("data_limit_gb").isNotNull().alias("has_plan"),
    )
    d = surroundings.join(line, "phone_number", "left")
    wrong = F.col("phone_number").isNotNull() & ~F.coalesce("has_plan", F.lit(False))
    d = d.withColumn("user_id", F.when(wrong, F.raise_error(F.concat(F.lit("no line or plan for "), F.col("phone_number"))).cast(surroundings.schema["user_id"].dataType)).otherwise(F.col("user_id")))
    settled = F.coalesce(F.col("request_paid"), F.lit(False)) & F.col("phone_number").isNotNull()
    paid = d.where(settled).select(F.col("request_bill_id").alias("bill_id"), F.lit("Paid").alias("paid_status")).distinct()
    after = bills.join(paid, "bill_id", "left").select(*[F.coalesce("paid_status", c).alias(c) if c == "status" else F.col(c) for c in bills.columns])
    owner = customers.select("customer_id", F.explode("line_ids").alias("line_id"))
    listed = customers.select(F.col("customer_id").alias("payer"), F.posexplode("bill_ids").alias("place", "bill_id"))
    waiting = after.where("status = 'Awaiting Payment'").select("bill_id", "total_due").join(listed, "bill_id")
    due = waiting.groupBy(F.col("payer").alias("customer_id")).agg(F.min(F.struct("place", "bill_id", "total_due")).alias("due"))
    d = d.join(owner, "line_id", "left").join(due, "customer_id", "left")
    keep = F.col("request_bill_id").isNotNull() & ~settled
    bill = lambda own, new: F.when(keep | F.col("phone_number").isNull(), F.col(own)).otherwise(F.col(new))
    out = d.select(
        "user_id", "phone_number", "line_active", "roaming_allowed", "usage_exceeded",
        bill("request_bill_id", "due.bill_id").alias("request_bill_id"),
        bill("request_amount", "due.total_due").alias("request_amount"),
        F.when(keep, F.coalesce("request_paid", F.lit(False))).when(F.col("phone_number").isNull(), F.col("request_paid")).when(F.col("due.bill_id").isNotNull(), False).alias("request_paid"),
    )
    return out, after
