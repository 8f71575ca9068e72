"""Retail orders: cancel, exchange, return, modify items, payment or address.

orders: order_id, user_id, status, cancel_reason, items array<struct<item_id,
product_id,price>>, payment_history array<struct<transaction_type,amount,
payment_method_id>>; methods: user_id, payment_method_id, source, balance;
variants: product_id, item_id, price, available.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.domains.common import apply_changes, move_balances, rules

#: The reasons for which an order may be cancelled.
REASONS = ("no longer needed", "ordered by mistake")
METHOD = ["user_id", "payment_method_id"]


def find_user(users: DataFrame, email: str | None = None, first: str | None = None, last: str | None = None, zip_code: str | None = None) -> DataFrame:
    """The first user by position with the address, or with name and zip code, whatever their case."""
    cond = F.lower("email") == F.lower(F.lit(email)) if email is not None else (F.lower("first_name") == F.lower(F.lit(first))) & (F.lower("last_name") == F.lower(F.lit(last))) & (F.col("zip") == zip_code)
    return users.where(cond).orderBy("pos").limit(1)


def _payment(kind: Column | str, amount: Column, method: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("transaction_type"), amount.cast("double").alias("amount"), method.alias("payment_method_id"))


def cancel_orders(orders: DataFrame, methods: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests: order_id, reason. (orders, methods, outcomes): payments are refunded, to gift cards at once."""
    d = requests.join(orders, "order_id", "left")
    d = d.withColumn("rule", rules((F.col("user_id").isNull(), "no_order"), (F.col("status") != "pending", "not_pending"), (~F.col("reason").isin(*REASONS), "reason")))
    refunds = F.transform("payment_history", lambda p: _payment("refund", p["amount"], p["payment_method_id"]))
    d = d.select("order_id", "user_id", "rule", F.lit("cancelled").alias("new_status"), F.col("reason").alias("new_cancel_reason"), F.concat("payment_history", refunds).alias("new_payment_history"), F.col("payment_history").alias("paid"))
    moves = d.where("rule = 'ok'").select("user_id", F.explode("paid").alias("p")).select("user_id", "p.payment_method_id", (-F.col("p.amount")).alias("amount"))
    return apply_changes(orders, d, "order_id"), move_balances(methods, moves, METHOD), d.select("order_id", "rule")


def _count_in(wanted: Column, have: Column) -> Column:
    """Whether each wanted item is there as many times as it is wanted."""
    many = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    return F.forall(wanted, lambda x: many(wanted, x) <= many(have, x))


def _swap(orders: DataFrame, methods: DataFrame, variants: DataFrame, requests: DataFrame, status: str, must_differ: bool) -> DataFrame:
    """Requests (order_id, item_ids, new_item_ids, payment_method_id) with order, price difference and rule."""
    d = requests.join(orders, "order_id", "left").join(methods.select(*METHOD, "source", "balance"), METHOD, "left")
    pairs = d.select("order_id", F.posexplode(F.arrays_zip("item_ids", "new_item_ids")).alias("k", "p"), "items").select("order_id", "k", "p.item_ids", "p.new_item_ids", F.get(F.filter("items", lambda i: i["item_id"] == F.col("p.item_ids")), F.lit(0)).alias("old"))
    v = variants.select("product_id", F.col("item_id").alias("new_item_ids"), F.col("price").alias("new_price"), "available")
    pairs = pairs.withColumn("product_id", F.col("old.product_id")).join(v, ["product_id", "new_item_ids"], "left")
    g = pairs.groupBy("order_id").agg(
        F.bool_and(F.coalesce("available", F.lit(False))).alias("at_hand"),
        F.bool_or(F.col("item_ids") == F.col("new_item_ids")).alias("same"),
        F.round(F.sum(F.col("new_price") - F.col("old.price")), 2).alias("difference"),
        F.sort_array(F.collect_list(F.struct("k", "item_ids", "new_item_ids", "new_price"))).alias("swaps"),
    )
    d = d.join(g, "order_id", "left")
    checks = [
        (F.col("user_id").isNull(), "no_order"),
        (F.col("status") != status, f"not_{status}"),
        (~_count_in(F.col("item_ids"), F.transform("items", lambda i: i["item_id"])), "items"),
        (F.size("item_ids") != F.size("new_item_ids"), "lengths"),
        (F.coalesce("same", F.lit(False)) if must_differ else F.lit(False), "same_item"),
        (~F.col("at_hand"), "not_available"),
        (F.col("source").isNull(), "no_method"),
        ((F.col("source") == "gift_card") & (F.col("balance") < F.col("difference")), "balance"),
    ]
    return d.withColumn("rule", rules(*checks))


def exchange_items(orders: DataFrame, methods: DataFrame, variants: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(orders, outcomes with the exchange) for delivered orders; prices are settled later."""
    d = _swap(orders, methods, variants, requests, "delivered", False)
    d = d.withColumn("new_status", F.lit("exchange requested"))
    out = d.select("order_id", "rule", F.sort_array("item_ids").alias("exchange_items"), F.sort_array("new_item_ids").alias("exchange_new_items"), "payment_method_id", "difference")
    return apply_changes(orders, d.select("order_id", "rule", "new_status"), "order_id"), out


def modify_items(orders: DataFrame, methods: DataFrame, variants: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(orders, methods, outcomes) for pending orders: the difference is paid or refunded, items change."""
    d = _swap(orders, methods, variants, requests, "pending", True)
    pay = _payment(F.when(F.col("difference") > 0, "payment").otherwise("refund"), F.abs("difference"), F.col("payment_method_id"))
    # Each swap takes the first item of its id; so the n-th swap of an id takes its n-th item.
    nth = lambda items, k: F.size(F.filter(F.slice(items, 1, k), lambda y: y["item_id"] == items[k]["item_id"]))
    hit = lambda i, k: F.get(F.filter("swaps", lambda s: s["item_ids"] == i["item_id"]), nth(F.col("items"), k))
    items = F.transform("items", lambda i, k: F.struct(F.coalesce(hit(i, k)["new_item_ids"], i["item_id"]).alias("item_id"), i["product_id"].alias("product_id"), F.coalesce(hit(i, k)["new_price"], i["price"]).alias("price")))
    d = d.withColumn("new_items", items).withColumn("new_status", F.lit("pending (item modified)")).withColumn("new_payment_history", F.concat("payment_history", F.array(pay)))
    moves = d.where("rule = 'ok'").select(*METHOD, F.col("difference").alias("amount"))
    return apply_changes(orders, d.select("order_id", "rule", "new_items", "new_status", "new_payment_history"), "order_id"), move_balances(methods, moves, METHOD), d.select("order_id", "rule", "difference")


def return_items(orders: DataFrame, methods: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests: order_id, item_ids, payment_method_id: the original method or a gift card."""
    d = requests.join(orders, "order_id", "left").join(methods.select(*METHOD, "source"), METHOD, "left")
    original = F.get("payment_history", F.lit(0))["payment_method_id"]
    d = d.withColumn("rule", rules((F.col("user_id").isNull(), "no_order"), (F.col("status") != "delivered", "not_delivered"), (F.col("source").isNull(), "no_method"), ((F.col("source") != "gift_card") & (F.col("payment_method_id") != original), "not_original"), (~_count_in(F.col("item_ids"), F.transform("items", lambda i: i["item_id"])), "items")))
    d = d.withColumn("new_status", F.lit("return requested"))
    return apply_changes(orders, d.select("order_id", "rule", "new_status"), "order_id"), d.select("order_id", "rule", F.sort_array("item_ids").alias("return_items"), "payment_method_id")


def modify_payment(orders: DataFrame, methods: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests: order_id, payment_method_id: the one payment of a pending order moves to another method."""
    d = requests.join(orders, "order_id", "left").join(methods.select(*METHOD, "source", "balance"), METHOD, "left")
    first = F.get("payment_history", F.lit(0))
    d = d.withColumn("amount", first["amount"]).withColumn("old", first["payment_method_id"])
    d = d.withColumn("rule", rules((F.col("user_id").isNull(), "no_order"), (~F.startswith("status", F.lit("pending")), "not_pending"), (F.col("source").isNull(), "no_method"), ((F.size("payment_history") != 1) | (first["transaction_type"] != "payment"), "payments"), (F.col("old") == F.col("payment_method_id"), "same_method"), ((F.col("source") == "gift_card") & (F.col("balance") < F.col("amount")), "balance")))
    d = d.withColumn("new_payment_history", F.concat("payment_history", F.array(_payment("payment", F.col("amount"), F.col("payment_method_id")), _payment("refund", F.col("amount"), F.col("old")))))
    ok = d.where("rule = 'ok'")
    moves = ok.select(*METHOD, "amount").unionByName(ok.select("user_id", F.col("old").alias("payment_method_id"), (-F.col("amount")).alias("amount")))
    return apply_changes(orders, d.select("order_id", "rule", "new_payment_history"), "order_id"), move_balances(methods, moves, METHOD), d.select("order_id", "rule")
