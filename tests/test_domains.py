"""Domain operations: before and after, rules in order."""

from pyspark.sql import functions as F

from tracemill.domains import airline, retail, telecom

ORDERS = "order_id string, user_id string, status string, cancel_reason string, items array<struct<item_id:string,product_id:string,price:double>>, payment_history array<struct<transaction_type:string,amount:double,payment_method_id:string>>"


def tables(spark):
    pay = lambda m, a=100.0: [("payment", a, m)]
    items = [("i1", "p1", 10.0), ("i1", "p1", 10.0), ("i2", "p2", 20.0)]
    orders = spark.createDataFrame([("w1", "u", "pending", None, items, pay("gift")), ("w2", "u", "delivered", None, items, pay("card")), ("w3", "u", "pending", None, items, pay("card", 500.0))], ORDERS)
    methods = spark.createDataFrame([("u", "gift", "gift_card", 50.0), ("u", "card", "credit_card", None), ("u", "paypal", "paypal", None)], "user_id string, payment_method_id string, source string, balance double")
    variants = spark.createDataFrame([("p1", "i1", 10.0, True), ("p1", "i3", 15.5, True), ("p1", "i4", 90.0, True), ("p2", "i5", 5.0, False)], "product_id string, item_id string, price double, available boolean")
    return orders, methods, variants


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_retail(spark):
    orders, methods, variants = tables(spark)
    req = spark.createDataFrame([("w1", "no longer needed"), ("w2", "no longer needed"), ("w3", "bored"), ("zz", "no longer needed")], "order_id string, reason string")
    o, m, out = retail.cancel_orders(orders, methods, req)
    assert {k: r.rule for k, r in by(out, "order_id").items()} == {"w1": "ok", "w2": "not_pending", "w3": "reason", "zz": "no_order"}
    assert by(o, "order_id")["w1"].status == "cancelled" and len(by(o, "order_id")["w1"].payment_history) == 2 and by(o, "order_id")["w3"].status == "pending"
    assert by(m, "payment_method_id")["gift"].balance == 150.0
    req = spark.createDataFrame([("w2", ["i1", "i1"], ["i3", "i1"], "gift")], "order_id string, item_ids array<string>, new_item_ids array<string>, payment_method_id string")
    o, out = retail.exchange_items(orders, methods, variants, req)
    assert out.first().rule == "ok" and out.first().difference == 5.5 and by(o, "order_id")["w2"].status == "exchange requested"
    bad = [(["i1", "i1", "i1"], ["i3"] * 3, "gift", "items"), (["i1"], ["i3", "i3"], "gift", "lengths"), (["i2"], ["i5"], "gift", "not_available"), (["i1"], ["i4"], "gift", "balance"), (["i1"], ["i3"], "none", "no_method")]
    for items, new, method, rule in bad:
        assert retail.exchange_items(orders, methods, variants, spark.createDataFrame([("w2", items, new, method)], req.schema))[1].first().rule == rule
    o, m, out = retail.modify_items(orders, methods, variants, spark.createDataFrame([("w1", ["i1"], ["i3"], "gift")], req.schema))
    w1 = by(o, "order_id")["w1"]
    assert [i.item_id for i in w1["items"]] == ["i3", "i1", "i2"] and w1.status == "pending (item modified)" and w1.payment_history[1].amount == 5.5
    assert by(m, "payment_method_id")["gift"].balance == 44.5
    assert retail.modify_items(orders, methods, variants, spark.createDataFrame([("w1", ["i1"], ["i1"], "gift")], req.schema))[2].first().rule == "same_item"
    r = spark.createDataFrame([("w2", ["i2"], "paypal")], "order_id string, item_ids array<string>, payment_method_id string")
    assert retail.return_items(orders, methods, r)[1].first().rule == "not_original"
    o, out = retail.return_items(orders, methods, r.withColumn("payment_method_id", F.lit("gift")))
    assert out.first().rule == "ok" and by(o, "order_id")["w2"].status == "return requested"
    p = spark.createDataFrame([("w3", "gift"), ("w1", "card")], "order_id string, payment_method_id string")
    o, m, out = retail.modify_payment(orders, methods, p)
    assert {k: x.rule for k, x in by(out, "order_id").items()} == {"w3": "balance", "w1": "ok"} and by(m, "payment_method_id")["gift"].balance == 150.0
    users = spark.createDataFrame([("u1", "A@x.com", "Ann", "Lee", "1", 0), ("u2", "a@x.com", "ann", "LEE", "1", 1)], "user_id string, email string, first_name string, last_name string, zip string, pos int")
    assert retail.find_user(users, email="a@X.com").first().user_id == "u1" and retail.find_user(users, first="ANN", last="lee", zip_code="1").first().user_id == "u1"


FLIGHTS = "flight_number string, origin string, destination string, departure string, arrival string, dates map<string,struct<status:string,seats:map<string,int>,prices:map<string,double>>>"


def test_airline(spark):
    day = lambda s="available", n=3, p=100.0: (s, {"economy": n}, {"economy": p})
    flights = spark.createDataFrame(
        [
            ("F1", "A", "B", "08:00:00", "10:00:00", {"2024-05-09": day()}),
            ("F2", "B", "C", "11:00:00", "12:00:00", {"2024-05-09": day(), "2024-05-10": day()}),
            ("F3", "B", "C", "09:00:00", "10:00:00", {"2024-05-09": day()}),
            ("F4", "A", "B", "22:00:00", "01:00:00+1", {"2024-05-09": day("landed"), "2024-05-31": day()}),
            ("F5", "A", "B", "20:00:00", "01:00:00+1", {"2024-05-09": day()}),
        ],
        FLIGHTS,
    )
    assert [r.flight_number for r in airline.direct_flights(flights, "2024-05-09", "A", "B").orderBy("flight_number").collect()] == ["F1", "F5"]
    assert airline.direct_flights(flights, "2024-05-09", "B", leave_after="10:30:00").first().flight_number == "F2"
    got = {(r.first, r.second, r.second_date) for r in airline.one_stop_flights(flights, "A", "C", "2024-05-09").collect()}
    assert got == {("F1", "F2", "2024-05-09"), ("F5", "F2", "2024-05-10")}
    assert airline.flight_status(flights, "F4", "2024-05-09").first().status == "landed"
    res = spark.createDataFrame(
        [("R1", "u", "ok", "economy", [("F1", "2024-05-09", 80.0)], ["a", "b"], [("gift", 160.0)], 1, 0)],
        "reservation_id string, user_id string, status string, cabin string, flights array<struct<flight_number:string,date:string,price:double>>, passengers array<string>, payment_history array<struct<payment_id:string,amount:double>>, total_baggages int, nonfree_baggages int",
    )
    methods = spark.createDataFrame([("u", "gift", "gift_card", 120.0), ("u", "cert", "certificate", 500.0)], "user_id string, payment_id string, source string, balance double")
    c = airline.cancel_reservations(res, res.select("reservation_id")).first()
    assert c.status == "cancelled" and [p.amount for p in c.payment_history] == [160.0, -160.0]
    req = spark.createDataFrame([("R1", 3, 2, "gift")], "reservation_id string, total int, nonfree int, payment_id string")
    r, m, out = airline.update_baggages(res, methods, req)
    assert out.first().rule == "ok" and r.first().nonfree_baggages == 2 and by(m, "payment_id")["gift"].balance == 20.0
    assert airline.update_baggages(res, methods, req.withColumn("payment_id", F.lit("cert")))[2].first().rule == "certificate"
    assert airline.update_baggages(res, methods, req.withColumn("nonfree", F.lit(5)))[2].first().rule == "balance"
    legs = spark.createDataFrame([("R1", "economy", [("F1", "2024-05-09"), ("F2", "2024-05-09")], "gift")], "reservation_id string, new_cabin string, legs array<struct<flight_number:string,date:string>>, payment_id string")
    r, m, out = airline.update_flights(res, flights, methods.withColumn("balance", F.lit(1000.0)), legs)
    assert out.first().rule == "ok" and out.first().price == 200.0 and [f.price for f in r.first().flights] == [80.0, 100.0]
    names = spark.createDataFrame([("R1", ["x"])], "reservation_id string, names array<string>")
    assert airline.update_passengers(res, names)[1].first().rule == "count"
    more = spark.createDataFrame([("u", 5.0), ("u", 7.0), ("nobody", 1.0)], "user_id string, amount double")
    m, out = airline.send_certificates(methods, more, ["1", "2", "3"])
    assert m.count() == 4 and sorted(x.rule for x in out.collect()) == ["no_user", "ok", "ok"]


def test_telecom(spark):
    customers = spark.createDataFrame([("C1", "Ann Lee", "1990-01-01", "111", ["L1", "L2"], ["B1", "B2"]), ("C2", "Bob", "1980-01-01", "222", ["L3"], [])], "customer_id string, full_name string, date_of_birth string, phone_number string, line_ids array<string>, bill_ids array<string>")
    lines = spark.createDataFrame([("L1", "333", "P1", "Active", None, False, 5.0, 0.0), ("L2", "444", "P1", "Suspended", "2025-01-01", True, 1.0, 1.0), ("L3", "555", "PX", "Active", None, False, 0.0, 0.0)], "line_id string, phone_number string, plan_id string, status string, suspension_start string, roaming_enabled boolean, data_used_gb double, data_refueling_gb double")
    plans = spark.createDataFrame([("P1", 10.0, 2.0)], "plan_id string, data_limit_gb double, refuel_price double")
    bills = spark.createDataFrame([("B1", "C1", "Paid", "2025-01-01", 10.0), ("B2", "C1", "Draft", "2025-02-01", 5.0)], "bill_id string, customer_id string, status string, issue_date string, total_due double")
    assert [telecom.by_phone(customers, lines, p).first().customer_id for p in ("111", "444", "555")] == ["C1", "C1", "C2"]
    assert telecom.by_name(customers, "ann LEE", "1990-01-01").count() == 1
    assert [r.bill_id for r in telecom.bills_of(customers, bills, "C1", 1).collect()] == ["B2"]
    u = telecom.data_usage(customers, lines, plans, "C1", "L1", "2025-02-25").first()
    assert (u.data_limit_gb, str(u.cycle_end)) == (10.0, "2025-02-28") and telecom.data_usage(customers, lines, plans, "C2", "L1", "2025-02-25").count() == 0
    assert str(telecom.data_usage(customers, lines, plans, "C1", "L1", "2025-12-25", same_year=True).first().cycle_end) == "2024-12-31"
    req = spark.createDataFrame([("C1", "L1"), ("C1", "L2"), ("C2", "L1")], "customer_id string, line_id string")
    new, out = telecom.suspend_lines(customers, lines, req.where("customer_id = 'C1'"), "2025-02-25")
    assert by(out, "line_id")["L2"].rule == "not_active" and by(new, "line_id")["L1"].suspension_start == "2025-02-25"
    new, out = telecom.resume_lines(customers, lines, req.where("line_id = 'L2'"))
    assert by(new, "line_id")["L2"].status == "Active" and by(new, "line_id")["L2"].suspension_start is None
    assert telecom.resume_lines(customers, lines, req.where("customer_id = 'C2'"))[1].first().rule == "no_line"
    new, out = telecom.set_roaming(customers, lines, req.where("customer_id = 'C1'"), True)
    assert by(out, "line_id")["L2"].rule == "already" and by(new, "line_id")["L1"].roaming_enabled
    b, out = telecom.request_payments(customers, bills, spark.createDataFrame([("C1", "B1")], "customer_id string, bill_id string"))
    assert by(b, "bill_id")["B1"].status == "Awaiting Payment"
    assert telecom.request_payments(customers, b, spark.createDataFrame([("C1", "B2")], "customer_id string, bill_id string"))[1].first().rule == "already_waiting"
    gb = spark.createDataFrame([("C1", "L1", 3.0)], "customer_id string, line_id string, gb double")
    ln, bl, out = telecom.refuel(customers, lines, plans, bills, gb, "2025-02-25")
    assert out.first().charge == 6.0 and by(ln, "line_id")["L1"].data_refueling_gb == 3.0 and by(bl, "bill_id")["B2"].total_due == 11.0
    ln, bl, out = telecom.refuel(customers, lines, plans, bills.where("bill_id = 'B1'"), gb, "2025-02-25")
    assert bl.count() == 2 and [str(r.issue_date) for r in bl.where("status = 'Draft'").collect()] == ["2025-03-01"]
