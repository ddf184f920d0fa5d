"""Structured Streaming versions of the shop's request flows.

Every stream reads the shop's events as a file stream, reuses the batch
operators (inside ``foreachBatch`` where the step is a table merge) and
writes its result under the cluster's shared checkpoint folder
(``spark.checkpoint.dir``), never a machine-local folder, and never into the
driver (no memory sink). Each query keeps its streaming checkpoint with its
output. A caller that names ``out_dir`` can restart the stream there: it
resumes from the last committed micro-batch. ``foreachBatch`` results are
published under the batch id (``changelog.ChangeLog``), once however often a
batch is replayed. Without ``out_dir`` every call starts anew in a folder of its
own.

``run_available_now`` drives a stream over everything available and returns
the result table as a batch DataFrame (used by the registered queries and the
tests).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import fixtures as X
from ..sources.folder import Folder
from .cart_state import LINE, OUTCOME, CartPage, page_count
from .changelog import COMPACT_EVERY, ChangeLog
from .top_table import TopTable

CANCEL_WINDOW = "3 days"


def new_run_dir(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")


def run_available_now(stream_writer_factory, out_dir: str) -> None:
    """Start a query built by ``stream_writer_factory(out_dir)`` with an
    availableNow trigger and wait for it."""
    q = stream_writer_factory(out_dir).trigger(availableNow=True).start()
    q.awaitTermination()
    exc = q.exception()
    if exc is not None:
        raise RuntimeError(str(exc))


def _log_each_batch(df: DataFrame, log: ChangeLog, transform=None):
    """Update-mode results: each micro-batch publishes the keys it changed."""
    def write(batch: DataFrame, epoch: int):
        log.append(batch if transform is None else transform(batch), epoch)
    return (df.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", f"{log.out_dir}/_checkpoint"))


def _table(log: ChangeLog, stream: DataFrame) -> DataFrame:
    """The log's table, empty before the first batch."""
    rows = log.latest()
    return log.spark.createDataFrame([], stream.schema) if rows is None else rows


# ------------------------------------------------------------------ S1 ------

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def cart_state_stream(spark: SparkSession, sf_dir: str, t, max_files_per_trigger: int | None = None,
                      out_dir: str | None = None) -> DataFrame:
    """Cart lines kept current from a stream of cart commands.

    The state store holds the line of each (user, variant), from the stored
    cart on, in pages (``cart_state.CartPage``); every command's outcome is
    appended to ``outcomes``. A line inserted by the stream gets ``max(stored id) + seq``
    like the batch operator. Returns the current cart: the lines in the store,
    and further stored rows of a duplicated key as they are."""
    out_dir = out_dir or new_run_dir(spark, "cart_state")
    key = ["user_id", "variant_id"]
    stock = t["product_variants"].select(F.col("id").alias("variant_id"), F.col("stock").cast("long").alias("stock"))
    commands = (X.project(X.raw_stream(spark, sf_dir, "events", max_files_per_trigger), X.CART_COMMANDS[2], X.CART_COMMANDS[1])
                .join(stock.hint("merge"), "variant_id", "left")
                .select(*[F.col(c).cast("long") for c in key], F.col("seq").cast("long"), "op", F.col("qty").cast("long"),
                        F.col("is_gift").cast("int"), "stock"))
    # The stored cart, one line per key (the lowest id of a duplicated key).
    stored = (t["cart_items"].groupBy(*key).agg(
        F.min("id").alias("id"), F.min_by("quantity", "id").alias("quantity"),
        F.min_by("is_gift", "id").alias("is_gift"))
        .select("id", *[F.col(c).cast("long") for c in key], F.col("quantity").cast("long"), F.col("is_gift").cast("int")))
    base, n = t["cart_items"].agg(F.coalesce(F.max("id"), F.lit(0)), F.count(F.lit(1))).first()      # two values
    folder = Folder(spark, out_dir)
    if not folder.exists("pages"):
        folder.publish("pages", str(page_count(n)))
    page = F.pmod(F.xxhash64(*key), F.lit(int(folder.read("pages")))).alias("page")
    pages = stored.groupBy(page).agg(F.to_json(F.collect_list(F.array(*[F.col(c).cast("long") for c in LINE]))).alias("lines"))
    outcomes = commands.select(page, "*").groupBy("page").transformWithState(
        CartPage(base), OUTCOME, "Append", "None", initialState=pages.groupBy("page"))

    def factory(d):
        return (outcomes.writeStream.outputMode("append").format("parquet").option("path", f"{d}/outcomes")
                .option("checkpointLocation", f"{d}/_checkpoint"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        run_available_now(factory, out_dir)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    others = (t["cart_items"].join(stored.select("id").hint("merge"), "id", "left_anti")
              .select("id", *key, F.col("quantity").cast("long"), F.col("is_gift").cast("int")))
    if not folder.names("_checkpoint/commits"):
        return stored.unionByName(others)
    return cart_lines(spark, out_dir).unionByName(others)


def cart_lines(spark: SparkSession, out_dir: str) -> DataFrame:
    """The cart in the state store of the stream at ``out_dir``."""
    pages = spark.read.format("statestore").option("stateVarName", "page").load(f"{out_dir}/_checkpoint")
    lines = pages.select(F.explode(F.from_json("value.lines", "array<array<long>>")).alias("line")).select(
        *[F.col("line")[i].alias(c) for i, c in enumerate(LINE)])
    return lines.select("id", "user_id", "variant_id", "quantity", F.col("is_gift").cast("int"))


# ------------------------------------------------------------------ S2 ------

def wishlist_state_stream(spark: SparkSession, sf_dir: str, t,
                          max_files_per_trigger: int | None = None,
                          compact_every: int = COMPACT_EVERY, out_dir: str | None = None) -> DataFrame:
    """Wishlist membership from a toggle stream: a streaming count (and
    last seq) per (user, product) in update mode; each batch turns the
    changed keys' running counts into membership rows against the stored
    wishlist and logs them. The final table is the latest row per key plus
    the stored rows no toggle touched."""
    out_dir = out_dir or new_run_dir(spark, "wishlist_state")
    toggles = X.project(X.raw_stream(spark, sf_dir, "events", max_files_per_trigger),
                        X.WISHLIST_EVENTS[2], X.WISHLIST_EVENTS[1])
    counts = toggles.groupBy("user_id", "product_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max("event_id").alias("_last"))
    stored = t["wishlist"]
    base = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_b")).scalar()
    key = ["user_id", "product_id"]

    def membership(batch: DataFrame) -> DataFrame:
        # Only the keys this batch changed: stored XOR odd number of toggles.
        cur = stored.select("id", *key)
        j = batch.join(cur, key, "left")
        present = F.col("id").isNotNull() != ((F.col("_n") % 2) == 1)
        return j.select(*key, F.when(present, base + F.col("_last")).alias("id"), present.alias("present"))

    log = ChangeLog(spark, out_dir, key, compact_every)
    run_available_now(lambda d: _log_each_batch(counts, log, membership), out_dir)
    touched = log.latest()
    if touched is None:
        return stored.select("id", *key)
    kept = stored.select("id", *key).join(touched.select(*key), key, "left_anti")
    return kept.unionByName(touched.where("present").select("id", *key))


# ------------------------------------------------------------------ S3 ------

def subscriber_dedup_stream(spark: SparkSession, sf_dir: str,
                            max_files_per_trigger: int | None = None,
                            compact_every: int = COMPACT_EVERY, out_dir: str | None = None) -> DataFrame:
    """S3: one subscription per e-mail (case-insensitive) from a signup
    stream; the earliest request (lowest id) wins. State holds one row per
    distinct e-mail, which is what the semantics require; update mode logs
    only the e-mails a batch changed."""
    out_dir = out_dir or new_run_dir(spark, "subscribers")
    subs = X.project(X.raw_stream(spark, sf_dir, "events", max_files_per_trigger),
                     X.NEWSLETTER[2], X.NEWSLETTER[1])
    firsts = subs.groupBy(F.lower("email").alias("email_key")).agg(
        F.min("id").alias("id"), F.min_by("email", "id").alias("email"),
        F.min_by("subscribed_at", "id").alias("subscribed_at"))
    log = ChangeLog(spark, out_dir, ["email_key"], compact_every)
    run_available_now(lambda d: _log_each_batch(firsts, log), out_dir)
    return _table(log, firsts)


# ------------------------------------------------------------------ S4 ------

def latest_status_stream(spark: SparkSession, sf_dir: str, out_dir: str | None = None) -> DataFrame:
    """Current status per order from the status-history stream
    (max_by over (created_at, id)); update mode logs the orders a batch
    changed."""
    out_dir = out_dir or new_run_dir(spark, "latest_status")
    o = X.raw_stream(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    hist = X.project(o, X.STATUS_HISTORY_FIRST).unionByName(
        X.project(o, X.STATUS_HISTORY_SECOND, "o_orderkey % 4 <> 0"))
    cur = hist.groupBy("order_id").agg(
        F.max_by("status", F.struct("created_at", "id")).alias("current_status"),
        F.max("created_at").alias("status_at"))
    log = ChangeLog(spark, out_dir, ["order_id"])
    run_available_now(lambda d: _log_each_batch(cur, log), out_dir)
    return _table(log, cur)


# ------------------------------------------------------------------ S5 ------

def valid_cancellations_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None,
                               compact_every: int = COMPACT_EVERY, out_dir: str | None = None) -> DataFrame:
    """Customer cancellations that arrive within 3 days of their order,
    by the order's owner, while the order is pending or confirmed: a
    stream-stream interval join with 3-day watermarks on both sides, so the
    join state is bounded by the window. The first valid request cancels its
    order, and later ones do not count: those of one micro-batch stand in order
    of time and ``seq``, and orders cancelled by an earlier batch are looked up
    in the log of results. Requests behind the watermark, which the join drops,
    are kept in a table of their own (``late_cancellations``)."""
    out_dir = out_dir or new_run_dir(spark, "cancellations")
    # Watermarks need TIMESTAMP event time; the wall-clock NTZ columns are
    # mapped through the session time zone (monotone, so order is kept).
    raw = X.raw_stream(spark, sf_dir, "orders", max_files_per_trigger)
    orders = (X.project(raw, X.SHOP_ORDERS[1])
              .select(F.col("id").alias("o_id"), F.col("user_id").alias("owner"), "status", "created_at",
                      F.col("created_at").cast("timestamp").alias("_o_et")))
    asked = X.project(raw, X.CANCEL_REQUESTS, "o_orderkey % 3 = 1").unionByName(
        X.project(raw, X.CANCEL_REPEATS, "o_orderkey % 6 = 1"))
    cancels = asked.withColumn("_c_et", F.col("ts").cast("timestamp"))
    joined = cancels.withWatermark("_c_et", CANCEL_WINDOW).join(
        orders.withWatermark("_o_et", CANCEL_WINDOW),
        (F.col("order_id") == F.col("o_id")) & (F.col("_c_et") >= F.col("_o_et"))
        & (F.col("_c_et") <= F.col("_o_et") + F.expr(f"INTERVAL {CANCEL_WINDOW}")),
        "inner")
    valid = (joined.where((F.col("owner") == F.col("user_id")) & F.col("status").isin("pending", "confirmed"))
             .select("seq", "order_id", "user_id", "ts", "created_at"))
    log = ChangeLog(spark, out_dir, ["order_id"], compact_every)

    def first_of_each(batch: DataFrame, epoch: int):
        rest = [c for c in batch.columns if c != "order_id"]
        first = batch.groupBy("order_id").agg(F.min_by(F.struct(*rest), F.struct("ts", "seq")).alias("r")).select("order_id", "r.*")
        done = log.latest()
        log.append(first if done is None else first.join(done, "order_id", "left_anti"), epoch)

    late = ChangeLog(spark, f"{out_dir}/late", ["seq"], compact_every)
    # Event times of both sides, for the watermark that the join goes by.
    times = cancels.select("seq", "order_id", "user_id", "ts", F.lit("c").alias("side"), F.col("_c_et").alias("et")).unionByName(
        orders.select(F.lit(None).cast("long").alias("seq"), F.col("o_id").alias("order_id"), F.col("owner").alias("user_id"),
                      F.col("created_at").alias("ts"), F.lit("o").alias("side"), F.col("_o_et").alias("et")))

    def behind(batch: DataFrame, epoch: int):
        now = late.manifest()
        if now and now["epoch"] >= epoch:
            return
        seen = dict((now or {}).get("note") or {})
        bound = min(seen.values()) if len(seen) == 2 else None
        limit = F.timestamp_micros(F.lit(bound)) - F.expr(f"INTERVAL {CANCEL_WINDOW}") if bound is not None else None
        for r in batch.groupBy("side").agg(F.max(F.unix_micros("et")).alias("m")).collect():       # two rows
            seen[r.side] = max(r.m, seen.get(r.side, r.m))
        rows = batch.where(F.col("side") == "c").where(F.col("et") < limit if limit is not None else F.lit(False))
        late.append(rows.select("seq", "order_id", "user_id", "ts"), epoch, seen)

    run_available_now(lambda d: valid.writeStream.foreachBatch(first_of_each)
                      .option("checkpointLocation", f"{d}/_checkpoint"), out_dir)
    run_available_now(lambda d: times.writeStream.foreachBatch(behind)
                      .option("checkpointLocation", f"{d}/late/_checkpoint"), out_dir)
    return _table(log, valid)


def late_cancellations(spark: SparkSession, out_dir: str) -> DataFrame | None:
    """Requests of the stream at ``out_dir`` that came behind the watermark."""
    return ChangeLog(spark, f"{out_dir}/late", ["seq"]).latest()


# ------------------------------------------------------------------ S6 ------

def most_carted_stream(spark: SparkSession, sf_dir: str, t, n: int = 5, max_files_per_trigger: int | None = None,
                       compact_every: int = COMPACT_EVERY, out_dir: str | None = None, after_batch=None) -> DataFrame:
    """Running most-carted products: cart additions (stream) joined to
    the catalog (static) and summed per product in update mode; every batch
    brings the changed products into the ranking (``top_table.TopTable``),
    whose first ``n`` are exact after it. ``after_batch(ranking, epoch)`` is
    called then."""
    out_dir = out_dir or new_run_dir(spark, "most_carted")
    items = X.project(X.raw_stream(spark, sf_dir, "events", max_files_per_trigger), X.CART_ITEMS[2], X.CART_ITEMS[1])
    v = t["product_variants"].select(F.col("id").alias("variant_id"), "product_id")
    p = t["products"].select(F.col("id").alias("product_id"), "name", "image1")
    sums = (items.join(v, "variant_id").join(p.select("product_id"), "product_id")
            .groupBy("product_id").agg(F.sum("quantity").cast("long").alias("total_added")))
    ranking = TopTable(ChangeLog(spark, out_dir, ["product_id"], compact_every), "total_added", n)

    def write(batch: DataFrame, epoch: int):
        ranking.update(batch, epoch)
        if after_batch:
            after_batch(ranking, epoch)
    run_available_now(lambda d: sums.writeStream.outputMode("update").foreachBatch(write)
                      .option("checkpointLocation", f"{d}/_checkpoint"), out_dir)
    first = spark.createDataFrame(ranking.top(), "product_id long, total_added long")
    return (first.join(p, "product_id").select(F.col("product_id").alias("id"), "name", "image1", "total_added")
            .orderBy(F.desc("total_added"), "id"))
