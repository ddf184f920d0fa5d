"""Stock and addresses served in request order, against step-by-step replays."""

import random

import pytest

from shopframe.operators import changes as G
from shopframe.operators.addresses import take_addresses
from shopframe.operators.components import components
from shopframe.operators.contention import serve_in_order


def replay_stock(requests, lines, stock):
    left, gone, out = dict(stock), set(), {}
    for seq, user in sorted(requests):
        cart = sorted(x for x in lines if x[0] == user)
        if not cart:
            continue
        if user in gone:
            out[seq] = "cart_empty"
            continue
        short = next((x for x in cart if x[3] > left[x[2]]), None)
        out[seq] = None if short is None else f"Insufficient stock for {short[4]}"
        if short is None:
            gone.add(user)
            for _, _, v, q, _ in cart:
                left[v] -= q
    return out


def run_stock(spark, requests, lines, stock, **limits):
    frame = spark.createDataFrame([(*x, stock[x[2]]) for x in lines],
                                  "user_id long, cart_id long, variant_id long, quantity long, name string, stock int").repartition(5)
    asks = spark.createDataFrame(requests, "seq long, user_id long").repartition(3)
    rows = serve_in_order(asks, frame, **limits).collect()
    assert len({r.seq for r in rows}) == len(rows)
    return {r.seq: r.reason for r in rows}


def shop(rng, users, variants, most, popular=None):
    lines = []
    for u in range(users):
        chosen = rng.sample(range(variants), min(variants, rng.randint(1, 4)))
        if popular is not None and popular not in chosen:
            chosen.append(popular)
        lines += [(u, 100 * u + i, v, rng.randint(1, 4), f"n{v}") for i, v in enumerate(chosen)]
        if rng.random() < 0.1:          # a second line of one variant
            lines.append((u, 100 * u + 50, chosen[0], 1, f"n{chosen[0]}"))
    requests = [(s, rng.randrange(users)) for s in rng.sample(range(10 * users), 2 * users)]
    return requests, lines, {v: rng.randint(0, most) for v in range(variants)}


@pytest.mark.parametrize("limits", [{}, {"task_edges": 0}, {"task_lines": 0}, {"task_lines": 30, "task_edges": 0}])
def test_many_small_groups(spark, limits):
    """Components in one pass each, found by rounds, and decided in rounds."""
    requests, lines, stock = shop(random.Random(3), 120, 90, 9)
    assert run_stock(spark, requests, lines, stock, **limits) == replay_stock(requests, lines, stock)


@pytest.mark.parametrize("limits", [{}, {"task_lines": 0}])
def test_one_variant_in_every_cart(spark, limits):
    requests, lines, stock = shop(random.Random(5), 80, 20, 60, popular=3)
    got = run_stock(spark, requests, lines, stock, **limits)
    assert got == replay_stock(requests, lines, stock)
    assert any(r is None for r in got.values()) and any(r and "n3" in r for r in got.values())


def test_no_contention_and_no_request(spark):
    requests, lines, stock = shop(random.Random(6), 20, 10, 5)
    plenty = {v: 10**6 for v in stock}
    assert run_stock(spark, requests, lines, plenty) == replay_stock(requests, lines, plenty)
    assert run_stock(spark, [], lines, stock) == {}


def replay_addresses(holders, requests):
    book, out = [list(h) for h in holders], {}
    known = {u for u, _ in holders}
    for seq, user, address in sorted(requests):
        out[seq] = any(u != user and a == address for u, a in book)
        if not out[seq] and user in known:
            for row in book:
                if row[0] == user:
                    row[1] = address
    return out


def run_addresses(spark, holders, requests, **limits):
    h = spark.createDataFrame(holders, "user_id long, address string").repartition(3)
    r = spark.createDataFrame(requests, "seq long, user_id long, address string").repartition(4)
    rows = take_addresses(h, r, **limits).collect()
    assert len(rows) == len(requests)
    return {x.seq: x.taken for x in rows}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("limits", [{}, {"task_edges": 0}])
def test_addresses_in_turn(spark, seed, limits):
    """Random moves among few addresses, some shared, some users unknown."""
    rng = random.Random(seed)
    holders = [(u, f"a{rng.randrange(40)}" if u % 9 == 0 else f"a{u}") for u in range(60)]
    requests = [(s, rng.randrange(66), f"a{rng.randrange(90)}") for s in range(150)]
    assert run_addresses(spark, holders, requests, **limits) == replay_addresses(holders, requests)


def test_popular_address_ties_nobody_together(spark, monkeypatch):
    """A thousand users ask for one free address: the first has it, and the
    others meet no replay."""
    from shopframe.operators import addresses
    edges = []
    real = components
    monkeypatch.setattr(addresses, "components", lambda e, n: edges.append(e.count()) or real(e, n))
    holders = [(u, f"a{u}") for u in range(1000)]
    requests = [(1000 - u, u, "hot") for u in range(1000)]
    got = run_addresses(spark, holders, requests)
    assert got == replay_addresses(holders, requests) and edges == [0]


def test_address_given_up_is_free(spark):
    users = spark.createDataFrame([(1, "F", "L", "a@x", None, 0), (2, "F", "L", "b@x", None, 0), (3, "F", "L", None, None, 0)],
                                  "id long, first_name string, last_name string, email string, provider string, is_admin int")
    req = spark.createDataFrame([(1, 1, "F", "L", "c@x"), (2, 2, "F", "L", "A@x"), (3, 3, "F", "L", "b@x"), (4, 1, "F", "L", "a@x")],
                                "seq long, user_id long, first_name string, last_name string, email string")
    new, out = G.edit_users(users, req)
    assert {r.seq: r.reason for r in out.collect()} == {1: None, 2: None, 3: None, 4: "email_taken"}
    assert {r.id: r.email for r in new.collect()} == {1: "c@x", 2: "A@x", 3: "b@x"}


@pytest.mark.parametrize("small", [0, 1000])
def test_components(spark, small):
    pairs = [(i, i + 1) for i in range(300)] + [(501, 500), (500, 501), (7, 7), (900, 905), (905, 901), (None, 3)]
    hub = [(1000, 2000 + i) for i in range(500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs + hub, "a long, b long").repartition(6), small).collect()}
    want = {**{i: 0 for i in range(301)}, 500: 500, 501: 500, 900: 900, 901: 900, 905: 900, 1000: 1000}
    assert got == want | {2000 + i: 1000 for i in range(500)}
    assert components(spark.createDataFrame([], "a long, b long"), small).count() == 0
