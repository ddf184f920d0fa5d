"""Streams give the same final state as the batch operators on the same input."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shopframe.operators import cart_fold as CF
from shopframe.operators import changes as G
from shopframe.plans.registry import tables
from shopframe.streaming import streams as S
from shopframe.streaming.cart_state import page_count
from shopframe.streaming.changelog import ChangeLog
from tests.conftest import SF_SMALL

LINE = ["id", "user_id", "variant_id", "quantity", "is_gift"]
OUTCOME = ["seq", "user_id", "variant_id", "op", "accepted", "reason", "quantity_after"]


@pytest.fixture(scope="module")
def batch_cart(spark):
    t = tables(spark, SF_SMALL)
    lines, outcomes = CF.apply_cart_commands(t["cart_items"], t["cart_commands"], t["product_variants"])
    return sorted(lines.select(LINE).collect()), sorted(outcomes.select(OUTCOME).collect(), key=lambda r: r.seq)


def split_events(folder, parts):
    src = pq.read_table(f"{SF_SMALL}/events.parquet")
    size = -(-src.num_rows // parts)
    return [(src.slice(i * size, size), f"{folder}/events{'' if i == 0 else f'_{i + 1}'}.parquet") for i in range(parts)]


def outcomes_of(spark, out_dir):
    return sorted(spark.read.parquet(f"{out_dir}/outcomes").select(OUTCOME).collect(), key=lambda r: r.seq)


def test_cart_stream_equals_batch(spark, batch_cart, tmp_path):
    out = f"file://{tmp_path}/cart"
    got = S.cart_state_stream(spark, SF_SMALL, tables(spark, SF_SMALL), out_dir=out)
    assert sorted(got.select(LINE).collect()) == batch_cart[0]
    assert outcomes_of(spark, out) == batch_cart[1]


def test_cart_state_over_batches_and_restarts(spark, batch_cart, tmp_path):
    """Three files: two in batches of their own, the third after a restart
    that resumes from the store."""
    d, out, t = str(tmp_path), f"file://{tmp_path}/cart", tables(spark, SF_SMALL)
    files = split_events(d, 3)
    for part, path in files[:2]:
        pq.write_table(part, path)
    S.cart_state_stream(spark, d, t, max_files_per_trigger=1, out_dir=out)
    pq.write_table(*files[2])
    got = S.cart_state_stream(spark, d, t, max_files_per_trigger=1, out_dir=out)
    assert sorted(got.select(LINE).collect()) == batch_cart[0]
    assert outcomes_of(spark, out) == batch_cart[1]


def test_removed_lines_leave_the_store(spark, batch_cart, tmp_path):
    out = f"file://{tmp_path}/cart"
    S.cart_state_stream(spark, SF_SMALL, tables(spark, SF_SMALL), out_dir=out)
    held = {(r.user_id, r.variant_id): r.quantity for r in S.cart_lines(spark, out).collect()}
    last = {}
    for r in batch_cart[1]:
        last[r.user_id, r.variant_id] = r.quantity_after
    assert None in last.values()
    assert all(held.get(k) == q for k, q in last.items()) and None not in held.values()


def test_cart_lines_share_pages(spark, batch_cart, tmp_path, monkeypatch):
    """The store holds no more values than pages; lines of one page do not mix,
    and a restart keeps to the number of pages the stream began with."""
    d, out, t = str(tmp_path), f"file://{tmp_path}/cart", tables(spark, SF_SMALL)
    files = split_events(d, 2)
    for pages, (part, path) in zip((3, 5), files):
        pq.write_table(part, path)
        monkeypatch.setattr(S, "page_count", lambda n: pages)
        got = S.cart_state_stream(spark, d, t, max_files_per_trigger=1, out_dir=out)
    assert sorted(got.select(LINE).collect()) == batch_cart[0]
    assert outcomes_of(spark, out) == batch_cart[1]
    assert spark.read.format("statestore").load(f"{out}/_checkpoint", stateVarName="page").count() <= 3


def test_pages_follow_the_cart():
    assert [page_count(n) for n in (0, 10**6, 10**8)] == [4096, 4096, 390625]


def test_latest_status_stream_runs(spark):
    df = S.latest_status_stream(spark, SF_SMALL)
    assert df.count() == tables(spark, SF_SMALL)["orders"].count()


def test_logged_streams_over_several_micro_batches(spark, tmp_path):
    """Events split into two files, one file per trigger."""
    d = str(tmp_path)
    for part, path in split_events(d, 2):
        pq.write_table(part, path)
    t = tables(spark, SF_SMALL)
    for every in (1, 50):
        wl = S.wishlist_state_stream(spark, d, t, max_files_per_trigger=1, compact_every=every)
        tog = t["wishlist_events"].select(F.col("event_id").alias("seq"), "user_id", "product_id")
        batch, _ = G.toggle_wishlist(t["wishlist"], tog)
        assert sorted(wl.select("id", "user_id", "product_id").collect()) == sorted(batch.collect())
        subs = S.subscriber_dedup_stream(spark, d, max_files_per_trigger=1, compact_every=every)
        exp = (t["newsletter_subscribers"].groupBy(F.lower("email").alias("email_key")).agg(F.min("id").alias("id")))
        assert sorted(subs.select("email_key", "id").collect()) == sorted(exp.collect())


def rows(spark, epoch):
    return spark.createDataFrame([(k, epoch * 10 + k) for k in range(epoch % 4, 6)], "k long, v long").coalesce(1)


def table_after(epochs):
    out = {}
    for e in epochs:
        out |= {k: e * 10 + k for k in range(e % 4, 6)}
    return out


STEPS = ["_write", "_publish", "_clean"]


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("after", [False, True])
def test_log_survives_a_crash_at_any_step(spark, tmp_path, monkeypatch, step, after):
    """The step fails once in every batch, before or after its work; a reader
    sees the last published batch, and the replay completes it."""
    log = ChangeLog(spark, f"file://{tmp_path}/log", ["k"], compact_every=3)
    real, broken = getattr(ChangeLog, step), []

    def fails(self, *a):
        if after:
            real(self, *a)
        if broken:
            broken.pop()
            raise RuntimeError("lost")
        if not after:
            real(self, *a)

    monkeypatch.setattr(ChangeLog, step, fails)
    for e in range(8):
        broken.append(1)
        with pytest.raises(RuntimeError, match="lost"):
            log.append(rows(spark, e), e)
        published = e if step == "_clean" or (step == "_publish" and after) else e - 1
        seen = log.latest()
        assert ({} if seen is None else {r.k: r.v for r in seen.collect()}) == table_after(range(published + 1))
        log.append(rows(spark, e), e)
        assert {r.k: r.v for r in log.latest().collect()} == table_after(range(e + 1))


def test_log_folder_stays_bounded(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log", ["k"], compact_every=5)
    reader, most = None, 0
    for e in range(200):
        log.append(rows(spark, e), e)
        if reader is not None:              # a reader of the batch before
            assert {r.k: r.v for r in reader.collect()} == table_after(range(e)) if e % 7 == 0 else True
        reader = log.latest() if e % 7 == 6 else None
        most = max(most, sum(len(log.folder.names(n)) for n in ("log", "snapshot", "manifest")))
    assert most <= 5 + 2 + 2 + 1
    assert {r.k: r.v for r in log.latest().collect()} == table_after(range(200))


def test_logged_stream_replays_a_lost_batch(spark, tmp_path, monkeypatch):
    """A batch that fails after its write, or after it was published, is
    replayed from the state before it."""
    t = tables(spark, SF_SMALL)
    tog = t["wishlist_events"].select(F.col("event_id").alias("seq"), "user_id", "product_id")
    exp, _ = G.toggle_wishlist(t["wishlist"], tog)
    for step in STEPS[1:]:
        real, broken = getattr(ChangeLog, step), [1]

        def fails(self, *a, real=real, broken=broken):
            if broken:
                broken.pop()
                raise RuntimeError("lost")
            real(self, *a)
        with monkeypatch.context() as m:
            m.setattr(ChangeLog, step, fails)
            out = f"file://{tmp_path}/{step}"
            with pytest.raises(Exception, match="lost"):
                S.wishlist_state_stream(spark, SF_SMALL, t, compact_every=1, out_dir=out)
            wl = S.wishlist_state_stream(spark, SF_SMALL, t, compact_every=1, out_dir=out)
        assert sorted(wl.select("id", "user_id", "product_id").collect()) == sorted(exp.collect())


def test_cancellations_count_once_and_late_ones_are_kept(spark, tmp_path):
    """Orders in files by date, the oldest last: its requests come behind the
    watermark. Repeated requests of one order count once."""
    d, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    os.mkdir(d)
    src = pq.read_table(f"{SF_SMALL}/orders.parquet")
    src = src.sort_by("o_orderdate")
    third = src.num_rows // 3
    old, mid, new = src.slice(0, third), src.slice(third, third), src.slice(2 * third)
    for part, path in ((mid, "orders"), (new, "orders_2"), (old, "orders_3")):
        pq.write_table(part, f"{d}/{path}.parquet")
    for i, name in enumerate(("orders", "orders_2", "orders_3")):       # arrival goes by file time
        os.utime(f"{d}/{name}.parquet", (10**9 + i, 10**9 + i))
    got = S.valid_cancellations_stream(spark, d, max_files_per_trigger=1, out_dir=out)
    rows = got.collect()
    assert len({r.order_id for r in rows}) == len(rows) > 0
    t = tables(spark, SF_SMALL)
    asked = t["cancel_requests"].select("seq", "order_id", "user_id", "ts")
    from shopframe.sources import fixtures as X
    asked = asked.unionByName(X.project(spark.read.parquet(f"{SF_SMALL}/orders.parquet"), X.CANCEL_REPEATS, "o_orderkey % 6 = 1"))
    o = t["orders"].select(F.col("id").alias("order_id"), F.col("user_id").alias("owner"), "status", "created_at")
    ok = (asked.join(o, "order_id").where("owner = user_id AND status IN ('pending', 'confirmed') AND ts >= created_at "
                                          "AND ts <= created_at + INTERVAL 3 DAYS"))
    first = {r.order_id: r.seq for r in ok.groupBy("order_id").agg(F.min_by("seq", F.struct("ts", "seq")).alias("seq")).collect()}
    late = {(r.order_id, r.seq) for r in S.late_cancellations(spark, out).collect()}
    aged = {r.o_orderkey for r in spark.createDataFrame(old.select(["o_orderkey"]).to_pandas()).collect()}
    young = {r.o_orderkey for r in spark.createDataFrame(new.select(["o_orderkey"]).to_pandas()).collect()}
    assert {r.order_id: r.seq for r in rows if r.order_id not in aged} == {k: v for k, v in first.items() if k not in aged}
    assert not any(k in young for k, _ in late) and any(k in aged for k, _ in late)


def test_ranking_is_exact_after_every_batch(spark, tmp_path):
    d, t = str(tmp_path), tables(spark, SF_SMALL)
    for part, path in split_events(d, 4):
        pq.write_table(part, path)
    v = t["product_variants"].select(F.col("id").alias("variant_id"), "product_id")
    seen = []

    def check(ranking, epoch):
        totals = {r.product_id: r.total_added for r in ranking.log.latest().collect()}
        seen.append(ranking.top() == sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:5])
    got = S.most_carted_stream(spark, d, t, max_files_per_trigger=1, after_batch=check)
    assert seen == [True] * 4
    want = (t["cart_items"].join(v, "variant_id").groupBy("product_id").agg(F.sum("quantity").alias("n"))
            .orderBy(F.desc("n"), "product_id").limit(5).collect())
    assert [(r.id, r.total_added) for r in got.collect()] == [(r.product_id, r.n) for r in want]


def test_ranking_under_falling_totals(spark, tmp_path):
    """Totals that rise and fall: exact after every batch, and the totals are
    read again only when the candidates run out."""
    import random
    from shopframe.streaming.top_table import TopTable
    rng, totals = random.Random(2), {}
    ranking = TopTable(ChangeLog(spark, f"file://{tmp_path}/top", ["k"], 8), "v", 3, keep=4)
    for epoch in range(25):
        if epoch % 6 == 5:      # what leads falls
            changed = {k: rng.randint(0, 5) for k, _ in ranking.top()}
        else:
            changed = {k: max(0, totals.get(k, 0) + rng.randint(-20, 30)) for k in rng.sample(range(40), 6)}
        totals |= changed
        ranking.update(spark.createDataFrame(list(changed.items()), "k long, v long"), epoch)
        assert ranking.top() == sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:3]
    assert 0 < ranking.rebuilt < 15
