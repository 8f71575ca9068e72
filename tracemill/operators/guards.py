"""Guard queries of write operations: eligibility, vetoes, balances, device state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.values import age_days, money


def account_eligibility(accounts: DataFrame, today: str, least_days: int, user: str = "user_id") -> DataFrame:
    """Users with an open account that is old enough and none that is closed or below zero.

    Type and balance fall back to their older field names where those exist.
    """
    have = set(accounts.columns)
    first = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names if n in have])
    balance = money(first("current_holdings", "balance"))
    status = F.upper(F.col("status"))
    g = accounts.groupBy(user).agg(
        F.bool_or((status == "OPEN") & (age_days(F.col("date_opened"), today) >= least_days)).alias("seasoned"),
        F.bool_or((status == "CLOSED") | (balance < 0)).alias("barred"),
    )
    return g.select(user, (F.col("seasoned") & ~F.col("barred")).alias("eligible"), "seasoned", "barred")


def without_pending(base: DataFrame, key: str, *tables: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """Rows with no record in any table whose upper-case status is in its list."""
    for t, statuses in tables:
        base = base.join(t.where(F.upper("status").isin([s.upper() for s in statuses])).select(key), key, "left_anti")
    return base


def in_standing(c: Column, bad: Sequence[str]) -> Column:
    return ~F.coalesce(F.upper(c).isin([b.upper() for b in bad]), F.lit(False))


def order_guard(accounts: DataFrame, orders: DataFrame, cards: DataFrame, key: str, fee: Column, least: float = 25.0, most_cards: int = 1) -> DataFrame:
    """Each account with the first rule that an order breaks, or ``ok``."""
    pending = orders.where(F.upper("status") == "PENDING").groupBy(key).agg(F.count("*").alias("pending"))
    active = cards.where(F.upper("status") == "ACTIVE").groupBy(key).agg(F.count("*").alias("active"))
    d = accounts.join(pending, key, "left").join(active, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("pending", "active")})
    rule = (
        F.when(F.col("pending") > 0, "pending_order")
        .when(F.col("active") >= most_cards, "card_limit")
        .when(F.col("balance") < least, "minimum_balance")
        .when(fee > F.col("balance"), "fee_above_balance")
        .otherwise("ok")
    )
    return d.select(key, rule.alias("rule"))


def activation_guard(requests: DataFrame, accounts: DataFrame, tools: dict[str, str], tool: str) -> DataFrame:
    """``request_id, rule``: digits of the code and the expiry, reason and tool, the linked account. An account that is missing passes."""
    d = requests.join(accounts.select("account_id", F.upper("status").alias("account_status")), "account_id", "left")
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in tools.items() for x in kv]), F.col("issue_reason"))
    rule = (
        F.when(~F.coalesce(F.col("last4").rlike("^[0-9]{4}$"), F.lit(False)), "last4")
        .when(~F.coalesce(F.col("cvv").rlike("^[0-9]{3}$"), F.lit(False)), "cvv")
        .when(~F.coalesce(F.col("expiry").rlike("^(0[1-9]|1[0-2])/[0-9]{2}$"), F.lit(False)), "expiry")
        .when(~known.eqNullSafe(tool), "wrong_tool")
        .when(F.col("account_status").isNotNull() & (F.col("account_status") != "OPEN"), "account_not_open")
        .otherwise("ok")
    )
    return d.select("request_id", rule.alias("rule"))


def closure_fee(accounts: DataFrame, windows: DataFrame, today: str) -> DataFrame:
    """``account_id, fee, remaining, may_close``: a fee within the window of the type; what is left must be zero."""
    d = accounts.join(windows, "account_type", "left")
    early = age_days(F.col("date_opened"), today) < F.coalesce("window_days", F.lit(0))
    fee = F.when(early, F.coalesce("early_fee", F.lit(0.0))).otherwise(0.0)
    return d.select("account_id", fee.alias("fee"), F.round(F.col("balance") - fee, 2).alias("remaining"), (F.round(F.col("balance") - fee, 2) == 0).alias("may_close"))


def price_difference(old_items: Column, new_items: Column, prices: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Old and new items side by side: the sum of new less old prices, to cents."""
    pairs = requests.select(key, F.posexplode(F.arrays_zip(old_items.alias("o"), new_items.alias("n"))).alias("pos", "p")).select(key, "pos", "p.o", "p.n")
    p = lambda n: prices.select(F.col("item_id").alias(n), F.col("price").alias(f"price_{n}"))
    return pairs.join(p("o"), "o", "left").join(p("n"), "n", "left").groupBy(key).agg(F.round(F.sum(F.col("price_n") - F.col("price_o")), 2).alias("difference"))


def booking_guard(bookings: DataFrame, seats: DataFrame, balances: DataFrame, insurance: float = 30.0, bag: float = 50.0) -> DataFrame:
    """``booking_id, rule`` of all-or-nothing bookings.

    Bookings: booking_id, flights array, passengers, insured, paid_bags, payments
    array<struct<method,amount>>. Each payment is checked by itself against its
    method's balance, so a method listed twice is not summed.
    """
    legs = bookings.select("booking_id", "passengers", F.explode("flights").alias("flight")).join(seats, "flight", "left")
    g = legs.groupBy("booking_id").agg(F.bool_and(F.coalesce(F.col("available") >= F.col("passengers"), F.lit(False))).alias("seats"), F.sum("price").alias("fare"))
    pay = bookings.select("booking_id", F.explode("payments").alias("p")).select("booking_id", "p.*").join(balances, "method", "left")
    h = pay.groupBy("booking_id").agg(F.sum("amount").alias("paid"), F.bool_and(F.col("balance").isNull() | (F.col("balance") >= F.col("amount"))).alias("covered"))
    d = bookings.join(g, "booking_id", "left").join(h, "booking_id", "left")
    due = F.col("fare") * F.col("passengers") + F.when(F.col("insured"), F.col("passengers") * insurance).otherwise(0.0) + F.col("paid_bags") * bag
    rule = F.when(~F.coalesce("seats", F.lit(False)), "no_seats").when(F.abs(F.coalesce("paid", F.lit(0.0)) - due) >= 0.005, "payment_mismatch").when(~F.coalesce("covered", F.lit(True)), "balance").otherwise("ok")
    return d.select("booking_id", F.round(due, 2).alias("due"), rule.alias("rule"))


def mobile_data_works(d: Column) -> Column:
    """Whether nothing stops mobile data: airplane mode, no signal, no service, roaming abroad, data off, usage exceeded."""
    abroad = d["is_abroad"] & ~(d["roaming_enabled"] & d["roaming_allowed"])
    blocked = d["airplane_mode"] | (d["signal"] == "none") | (d["status"] == "no_service") | abroad | ~d["data_enabled"] | d["usage_exceeded"]
    return ~F.coalesce(blocked, F.lit(True))


#: Speed ranges by network in Mbit/s and factors by signal.
SPEEDS = {"2G": (0.1, 0.4), "3G": (1.0, 5.0), "4G": (10.0, 100.0), "5G": (50.0, 500.0)}
SIGNALS = {"none": 0.0, "poor": 0.2, "fair": 0.5, "good": 0.8, "excellent": 1.0}
BANDS = ((1, "Very Poor"), (5, "Poor"), (25, "Fair"), (100, "Good"))
PREFERENCES = {"4g_only": "4G", "3g_only": "3G", "2g_only": "2G"}


def speed_test(network: Column, signal: Column, slow_vpn: Column, saver: Column, works: Column | None = None) -> tuple[Column, Column]:
    """(speed, band): the middle of the network's range times the factors of signal, VPN and data saver; none without a connection."""
    mid = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, (a, b) in SPEEDS.items() for x in (k, (a + b) / 2)]), network), F.lit(0.0))
    factor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SIGNALS.items() for x in kv]), signal), F.lit(0.0))
    speed = F.round(mid * factor * F.when(slow_vpn, 0.1).otherwise(1.0) * F.when(saver, 0.2).otherwise(1.0), 2)
    band = F.lit("Excellent")
    for top, name in reversed(BANDS):
        band = F.when(speed < top, name).otherwise(band)
    works = F.lit(True) if works is None else works
    return F.when(works, speed), F.when(works, band).otherwise("No Connection")


def network_search(d: Column) -> Column:
    """status, network and signal after a search.

    An active SIM connects by preference: 5G if it has a signal, else 4G; or the
    one network asked for. No SIM, airplane mode, a broken access point and an
    inactive line leave no service.
    """
    level = lambda n: F.coalesce(F.try_element_at(d["signals"], n), F.lit("none"))
    only = F.try_element_at(F.create_map(*[F.lit(x) for kv in PREFERENCES.items() for x in kv]), d["preference"])
    network = F.when(d["preference"] == "4g_5g_preferred", F.when(level(F.lit("5G")) == "none", "4G").otherwise("5G")).otherwise(F.coalesce(only, F.lit("4G")))
    served = F.coalesce((d["sim"] == "active") & ~d["airplane_mode"] & ~d["apn_broken"] & d["line_active"], F.lit(False))
    return F.struct(F.when(served, "connected").otherwise("no_service").alias("status"), F.when(served, network).otherwise("none").alias("network"), F.when(served, level(network)).otherwise("none").alias("signal"))


def close_to(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return F.coalesce(F.abs(a - b) < eps, F.lit(False))
