"""Change operators against brute-force replays and hand-made edge frames."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from shopframe.operators import cart_fold as CF
from shopframe.operators import changes as G
from shopframe.operators import checkout as CO


def replay_cart(cart_rows, commands, stock):
    """Sequential reference replay of the cart rules (one request at a time)."""
    lines = {}
    for cid, uid, vid, q, gift in sorted(cart_rows):
        lines.setdefault((uid, vid), [q, gift, cid])
    out = {}
    for seq, uid, vid, op, n, gift in sorted(commands):
        k = (uid, vid)
        st = stock.get(vid)
        cur = lines.get(k)
        reason = None
        if op == "add":
            if n < 1:
                reason = "invalid_request"
            elif st is None:
                reason = "variant_not_found"
            elif cur is not None:
                if cur[0] + n > st:
                    reason = "stock_limit"
                else:
                    cur[0] += n
            elif n > st:
                reason = "insufficient_stock"
            else:
                lines[k] = [n, gift, None]
        elif op == "update":
            if cur is None or st is None:
                reason = "not_found"
            elif cur[0] + n < 1:
                reason = "below_minimum"
            elif cur[0] + n > st:
                reason = "stock_limit"
            else:
                cur[0] += n
        elif op == "remove":
            if cur is None:
                reason = "not_found"
            else:
                del lines[k]
        out[seq] = (reason is None, reason, lines[k][0] if k in lines else None)
    return out, {k: (v[0], v[1]) for k, v in lines.items()}


def more_lines(cart_rows):
    """Ids of stored rows beyond the first of their key."""
    first = {}
    for cid, user, variant, *_ in sorted(cart_rows):
        first.setdefault((user, variant), cid)
    return {r[0] for r in cart_rows} - set(first.values())


def test_cart_fold_same_for_every_threshold(spark):
    """Stored quantities of 0 and below, stock above 4,096, seq above 2**53,
    unknown variants, duplicate rows: split or not, one result,
    that of the replay."""
    import random
    rnd = random.Random(11)
    stock = {1: 10, 2: 100_000, 3: 0, 4: 5}
    variants = spark.createDataFrame(list(stock.items()), "id long, stock int")
    rows = [(10, 7, 1, 0, 0), (11, 7, 2, -3, 1), (12, 7, 2, 5, 0), (13, 8, 2, 99_990, 1), (14, 8, 4, 9, 0), (15, 9, 1, 2, 1)]
    cart = spark.createDataFrame(rows, "id long, user_id long, variant_id long, quantity long, is_gift int")
    cmds, seq = [], 9007199254740993
    for user, variant in ((7, 1), (7, 2), (8, 2), (8, 4), (8, 99), (7, 3)):
        for i in range(60):
            op = "update" if i < 6 else rnd.choice(["add", "update", "update", "remove"])
            n = 1 if i < 6 else rnd.choice([-4000, -2, -1, 0, 1, 3, 5000, 2**40])
            cmds.append((seq, user, variant, op, n, i % 2))
            seq += 1
    rnd.shuffle(cmds)
    frame = spark.createDataFrame(cmds, "seq long, user_id long, variant_id long, op string, qty long, is_gift int")
    exp_out, exp_state = replay_cart(rows, sorted(cmds), stock)
    for threshold, chunks in ((1, 1024), (3, 7), (10**9, 1024)):
        new, out = CF.apply_cart_commands(cart, frame, variants, hot_threshold=threshold, max_chunks=chunks)
        assert {r.seq: (r.accepted, r.reason, r.quantity_after) for r in out.collect()} == exp_out
        got = new.collect()
        assert {(r.user_id, r.variant_id): (r.quantity, r.is_gift) for r in got if r.id != 12} == exp_state
        assert {(r.id, r.quantity) for r in got} >= {(12, 5), (15, 2)}


def test_cart_fold_matches_replay_on_fixture(spark, t_small):
    cart = t_small["cart_items"]
    cmds = t_small["cart_commands"]
    variants = t_small["product_variants"]
    new, out = CF.apply_cart_commands(cart, cmds, variants, checkpoint=True)
    stock = {r.id: r.stock for r in variants.select("id", "stock").collect()}
    cart_rows = [(r.id, r.user_id, r.variant_id, r.quantity, r.is_gift) for r in cart.collect()]
    cmd_rows = [(r.seq, r.user_id, r.variant_id, r.op, r.qty, r.is_gift) for r in cmds.collect()]
    exp_out, exp_state = replay_cart(cart_rows, cmd_rows, stock)
    got = {r.seq: (r.accepted, r.reason, r.quantity_after) for r in out.collect()}
    assert got == exp_out
    got_state = {(r.user_id, r.variant_id): (r.quantity, r.is_gift) for r in new.collect() if r.id not in more_lines(cart_rows)}
    assert got_state == exp_state
    assert more_lines(cart_rows) <= {r.id for r in new.collect()}


def test_cart_fold_edge_cases(spark):
    variants = spark.createDataFrame([(1, 5), (2, 0)], "id long, stock int")
    cart = spark.createDataFrame([(10, 7, 1, 3, 0)], "id long, user_id long, variant_id long, quantity long, is_gift int")
    cmds = spark.createDataFrame([
        (1, 7, 1, "add", 2, 0),      # 3+2 = 5 = stock: ok
        (2, 7, 1, "add", 1, 0),      # 6 > 5: stock_limit
        (3, 7, 1, "update", -5, 0),  # 0 < 1: below_minimum
        (4, 7, 1, "remove", 0, 0),
        (5, 7, 1, "add", 2, 1),      # re-insert, gift from this command
        (6, 7, 2, "add", 1, 0),      # stock 0: insufficient
        (7, 7, 3, "add", 1, 0),      # unknown variant
        (8, 7, 1, "add", 0, 0),      # qty 0 invalid
        (9, 8, 1, "update", 1, 0),   # no line
    ], "seq long, user_id long, variant_id long, op string, qty int, is_gift int")
    new, out = CF.apply_cart_commands(cart, cmds, variants)
    got = {r.seq: (r.accepted, r.reason, r.quantity_after) for r in out.collect()}
    assert got == {1: (True, None, 5), 2: (False, "stock_limit", 5), 3: (False, "below_minimum", 5),
                   4: (True, None, None), 5: (True, None, 2), 6: (False, "insufficient_stock", None),
                   7: (False, "variant_not_found", None), 8: (False, "invalid_request", 2),
                   9: (False, "not_found", None)}
    rows = new.collect()
    assert len(rows) == 1 and rows[0].quantity == 2 and rows[0].is_gift == 1
    assert rows[0].id == 10 + 5  # max(existing id) + inserting seq


def test_wishlist_toggle_twice_and_existing(spark):
    wl = spark.createDataFrame([(1, 7, 100)], "id long, user_id long, product_id long")
    tog = spark.createDataFrame([(5, 7, 100), (6, 8, 200), (7, 8, 200), (8, 9, 300)],
                                "seq long, user_id long, product_id long")
    new, out = G.toggle_wishlist(wl, tog)
    assert sorted((r.user_id, r.product_id, r.id) for r in new.collect()) == [(9, 300, 9)]
    acts = {r.seq: r.action for r in out.collect()}
    assert acts == {5: "removed", 6: "added", 7: "removed", 8: "added"}


def test_stock_deltas_conserved(spark):
    v = spark.createDataFrame([(1, 5), (2, 3)], "id long, stock int")
    d = spark.createDataFrame([(1, -2), (1, 2), (2, -3)], "variant_id long, delta long")
    got = {r.id: r.stock for r in CO.apply_stock_deltas(v, d).collect()}
    assert got == {1: 5, 2: 0}


def test_message_validation_edges(spark):
    m = spark.createDataFrame([
        (1, "a", "a@b.co", None, "hi"), (2, "", "a@b.co", None, "hi"), (3, "a", "a@b.co", "12-34", "hi"),
        (4, "a", "ab.co", "9876543210", "hi"), (5, "  ", "a@b.co", "", "x")],
        "id long, name string, email string, phone string, message string")
    got = {r.id: r.reason for r in G.validate_messages(m).collect()}
    assert got == {1: None, 2: "missing_fields", 3: "bad_phone", 4: "bad_email", 5: None}


def test_upsert_products_keeps_images(spark):
    p = spark.createDataFrame([(1, "a", "d", "i1.jpg", "i2.jpg")],
                              "id long, name string, description string, image1 string, image2 string")
    req = spark.createDataFrame([(5, 1, "b", None, None, "n2.jpg")],
                                "seq long, id long, name string, description string, image1 string, image2 string")
    r = G.upsert_products(p, req).collect()[0]
    assert (r.name, r.description, r.image1, r.image2) == ("b", None, "i1.jpg", "n2.jpg")


def replay_checkout_fcfs(requests, cart_lines, stock):
    """Sequential COD checkout replay: requests in seq order, each user's
    cart checked line by line against the stock left, cart cleared on
    success."""
    stock = dict(stock)
    carts = {}
    for uid, cid, vid, q, name in sorted(cart_lines, key=lambda x: x[1]):
        carts.setdefault(uid, []).append((cid, vid, q, name))
    out = {}
    for seq, uid, bname, bphone in sorted(requests):
        if not bname or not bphone:
            out[seq] = "invalid_billing"
            continue
        lines = carts.get(uid)
        if not lines:
            out[seq] = "cart_empty"
            continue
        short = [ln for ln in lines if stock.get(ln[1], 0) < ln[2]]
        if short:
            out[seq] = "Insufficient stock for " + short[0][3]
            continue
        for _, vid, q, _ in lines:
            stock[vid] -= q
        carts[uid] = []
        out[seq] = None
    return out


def test_fcfs_checkout_matches_sequential_replay(spark):
    from shopframe.functions import pricing as R
    variants = spark.createDataFrame([(1, 1, 5), (2, 1, 2), (3, 2, 1)], "id long, product_id long, stock int")
    products = spark.createDataFrame([(1, "ring", "r.jpg"), (2, "chain", "c.jpg")],
                                     "id long, name string, image1 string")
    cart = spark.createDataFrame([
        (10, 1, 1, 3, 0), (11, 1, 2, 1, 0),      # user 1: 3 of v1, 1 of v2
        (12, 2, 1, 3, 0),                        # user 2: 3 of v1 -> short after user 1
        (13, 3, 2, 1, 0), (14, 3, 3, 1, 0),      # user 3: fits after 1 (v2 left 1)
        (15, 4, 3, 1, 0),                        # user 4: v3 taken by user 3
        (16, 5, 1, 2, 0),                        # user 5: v1 left 2 -> fits
    ], "id long, user_id long, variant_id long, quantity long, is_gift int")
    t = {"product_variants": variants.selectExpr("*", "CAST(NULL AS STRING) AS finish",
                                                 "CAST(NULL AS STRING) AS length_size",
                                                 "CAST(NULL AS STRING) AS width",
                                                 "CAST(NULL AS STRING) AS thickness",
                                                 "CAST(1 AS DECIMAL(10,2)) AS price"),
         "products": products, "cart_items": cart,
         "orders": spark.createDataFrame([(100,)], "id long")}
    reqs = [(1, 1, "a", "9"), (2, 2, "b", "9"), (3, 3, "c", "9"), (4, 4, "d", "9"), (5, 5, "e", "9"),
            (6, 1, "a", "9"), (7, 2, "b", "9"), (8, 6, "f", "9"), (0, 4, "", "9")]
    rdf = spark.createDataFrame(reqs, "seq long, user_id long, billing_name string, billing_phone string")
    for c in ("billing_city", "billing_state", "billing_pincode"):
        rdf = rdf.withColumn(c, F.lit("x"))
    res = CO.checkout(t, rdf, R.ts_literal("2024-01-01 00:00:00"), "cod", stock_policy="fcfs")
    got = {r.seq: r.reason for r in res["outcomes"].collect()}
    lines = [(r.user_id, r.id, r.variant_id, r.quantity, "ring" if r.variant_id in (1, 2) else "chain")
             for r in cart.collect()]
    exp = replay_checkout_fcfs(reqs, lines, {1: 5, 2: 2, 3: 1})
    assert got == exp
    assert got[1] is None and got[2].startswith("Insufficient") and got[6] == "cart_empty"


def test_fcfs_on_fixture_matches_replay(spark, t_small):
    from shopframe.functions import pricing as R
    reqs_df = t_small["checkout_requests"]
    res = CO.checkout(t_small, reqs_df, R.ts_literal("2024-02-01 00:00:00"), "cod", stock_policy="fcfs")
    got = {r.seq: r.reason for r in res["outcomes"].collect()}
    from shopframe.operators import carts as K
    cl = [(r.user_id, r.cart_id, r.variant_id, r.quantity, r.name) for r in K.cart_view(t_small).collect()]
    stock = {r.id: r.stock for r in t_small["product_variants"].collect()}
    reqs = [(r.seq, r.user_id, r.billing_name, r.billing_phone) for r in reqs_df.collect()]
    assert got == replay_checkout_fcfs(reqs, cl, stock)


def test_cart_fold_split_hot_keys_matches_replay(spark, t_small):
    """Every key with more than 2 commands goes through the chunked path."""
    cart = t_small["cart_items"]
    cmds = t_small["cart_commands"]
    variants = t_small["product_variants"]
    new, out = CF.apply_cart_commands(cart, cmds, variants, hot_threshold=2)
    stock = {r.id: r.stock for r in variants.select("id", "stock").collect()}
    cart_rows = [(r.id, r.user_id, r.variant_id, r.quantity, r.is_gift) for r in cart.collect()]
    cmd_rows = [(r.seq, r.user_id, r.variant_id, r.op, r.qty, r.is_gift) for r in cmds.collect()]
    exp_out, exp_state = replay_cart(cart_rows, cmd_rows, stock)
    got = {r.seq: (r.accepted, r.reason, r.quantity_after) for r in out.collect()}
    assert got == exp_out
    got_state = {(r.user_id, r.variant_id): (r.quantity, r.is_gift) for r in new.collect() if r.id not in more_lines(cart_rows)}
    assert got_state == exp_state
    assert more_lines(cart_rows) <= {r.id for r in new.collect()}


def test_cart_fold_one_hot_key(spark):
    """A single key with many commands, split into chunks, equals the replay."""
    import random
    rnd = random.Random(7)
    variants = spark.createDataFrame([(1, 6)], "id long, stock int")
    cart = spark.createDataFrame([(1, 9, 1, 2, 1)], "id long, user_id long, variant_id long, quantity long, is_gift int")
    rows = []
    for seq in range(2, 400):
        op = rnd.choice(["add", "add", "update", "remove"])
        q = rnd.choice([-2, -1, 1, 2, 3]) if op == "update" else rnd.choice([0, 1, 2, 3])
        rows.append((seq, 9, 1, op, q, seq % 2))
    cmds = spark.createDataFrame(rows, "seq long, user_id long, variant_id long, op string, qty int, is_gift int")
    exp_out, exp_state = replay_cart([(1, 9, 1, 2, 1)], rows, {1: 6})
    for max_chunks in (1024, 7):  # one command per chunk; ~57 commands per chunk
        new, out = CF.apply_cart_commands(cart, cmds, variants, hot_threshold=10, max_chunks=max_chunks)
        assert {r.seq: (r.accepted, r.reason, r.quantity_after) for r in out.collect()} == exp_out
        assert {(r.user_id, r.variant_id): (r.quantity, r.is_gift) for r in new.collect()} == exp_state


def test_fold_functions_ship_by_value():
    """Workers need not import the package: the fold's task functions are
    pickled by value."""
    from pyspark import cloudpickle
    assert CF.__name__ in cloudpickle.cloudpickle._PICKLE_BY_VALUE_MODULES
