"""First-come-first-served stock by contention groups.

Requests compete only where variants are asked for beyond their stock. Users
whose carts share such a variant, directly or through others, form a group;
groups don't affect one another and are served at the same time, each request
by request in ``seq`` order in one streaming pass that keeps the stock left.
A group of more than ``TASK_LINES`` lines is too much for one task: its requests
are decided in parallel rounds (``decide_in_rounds``) with the same result.
"""

from __future__ import annotations

import sys as _sys

import pyarrow as pa
from pyspark import cloudpickle as _cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import components
from .paging import running_sums

TASK_LINES = 1_000_000      # lines of a group that one task serves
TASK_EDGES = 500_000        # edges (counted) that one task joins to groups


def _serve(batches):
    """Rows (group, seq, user, variant, quantity, name, stock) sorted by
    (group, seq, cart line): seq and reason (null: accepted)."""
    group, left, served = None, {}, set()
    seq, user, lines = None, None, []
    seqs, reasons = [], []

    def settle():
        if user in served:
            return "cart_empty"
        for variant, quantity, name, _ in lines:
            if quantity > left[variant]:
                return f"Insufficient stock for {name}" if name is not None else "Insufficient stock"
        for variant, quantity, _, _ in lines:
            left[variant] -= quantity
        served.add(user)
        return None

    for batch in batches:
        for g, s, u, variant, quantity, name, stock in zip(*[c.to_pylist() for c in batch.columns]):
            if s != seq or g != group:
                if lines:
                    seqs.append(seq)
                    reasons.append(settle())
                if g != group:
                    group, left, served = g, {}, set()
                seq, user, lines = s, u, []
            left.setdefault(variant, stock)
            lines.append((variant, quantity, name, stock))
        if len(seqs) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(reasons, pa.string())], names=["seq", "reason"])
            seqs, reasons = [], []
    if lines:
        seqs.append(seq)
        reasons.append(settle())
    if seqs:
        yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(reasons, pa.string())], names=["seq", "reason"])


def serve_in_order(requests: DataFrame, lines: DataFrame, task_lines: int = TASK_LINES,
                   task_edges: int = TASK_EDGES) -> DataFrame:
    """``requests``: (seq, user_id); ``lines``: (user_id, cart_id, variant_id,
    quantity, name, stock), the cart of each user and the opening stock. In
    ``seq`` order, a request is accepted when every line of the cart fits the
    stock left, which then falls by the cart's quantities and empties the cart.
    Returns (seq, reason): null, 'cart_empty' or the first short line."""
    asking = requests.select("user_id").distinct()
    lines = lines.join(asking, "user_id", "left_semi").withColumn("stock", F.coalesce(F.col("stock"), F.lit(0)).cast("long"))
    tight = (lines.groupBy("variant_id").agg(F.sum("quantity").alias("_asked"), F.max("stock").alias("_stock"))
             .where("_asked > _stock").select("variant_id"))
    tight = materialize(lines.join(tight, "variant_id", "left_semi").select(
        "user_id", "cart_id", "variant_id", F.col("quantity").cast("long").alias("quantity"), "name", "stock"))
    edges = tight.select((F.col("user_id").cast("long") * 2).alias("a"), (F.col("variant_id").cast("long") * 2 + 1).alias("b"))
    groups = components(edges, task_edges).where("node % 2 = 0").select(
        F.expr("node div 2").alias("user_id"), F.col("component").alias("group"))
    rows = materialize(requests.join(groups, "user_id").join(tight, "user_id").select(
        "group", "seq", "user_id", "cart_id", "variant_id", "quantity", "name", "stock"))
    large = materialize(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > task_lines).select("group"))
    if large.isEmpty():
        some = rows
    else:
        some = rows.join(large, "group", "left_anti")
    out = (some.repartition("group").sortWithinPartitions("group", "seq", "cart_id")
           .select("group", "seq", "user_id", "variant_id", "quantity", "name", "stock")
           .mapInArrow(_serve, "seq long, reason string"))
    if not large.isEmpty():
        out = out.unionByName(_large_groups(rows.join(large, "group", "left_semi")))
    first = requests.groupBy("user_id").agg(F.min("seq").alias("_first"))
    free = (requests.join(groups.select("user_id").distinct(), "user_id", "left_anti").join(first, "user_id")
            .select("seq", F.when(F.col("seq") > F.col("_first"), "cart_empty").alias("reason")))
    return out.unionByName(free)


def _large_groups(rows: DataFrame) -> DataFrame:
    """The same decisions for groups that are too much for a task. Stock only
    falls, so of a user's requests the first decides and the others follow."""
    rows = materialize(rows.join(rows.groupBy("user_id").agg(F.min("seq").alias("_first")), "user_id"))
    own = rows.where("seq = _first")
    decided = materialize(decide_in_rounds(own.select("seq", "variant_id", "quantity", "stock")))
    ok = own.select("seq", "user_id").distinct().join(decided.where("accepted").select("seq"), "seq", "left_semi") \
        .select("user_id", F.lit(True).alias("_ok"))
    rows = materialize(rows.join(ok, "user_id", "left"))
    # Accepted takes and rejected lines in one order per variant: the running
    # sum before a rejected line is the stock taken by then.
    takes = rows.where("_ok AND seq = _first").select(
        "variant_id", "seq", F.lit(-1).cast("long").alias("cart_id"), F.col("quantity").alias("_t"),
        F.lit(None).cast("long").alias("_q"), F.lit(None).cast("string").alias("name"), "stock")
    asks = rows.where("_ok IS NULL").select("variant_id", "seq", F.col("cart_id").cast("long"), F.lit(0).cast("long").alias("_t"),
                                            F.col("quantity").alias("_q"), "name", "stock")
    before = running_sums(takes.unionByName(asks), ["variant_id"], [F.col("seq").asc(), F.col("cart_id").asc()], ["_t"])
    short = (before.where("_q IS NOT NULL AND _t_cum + _q > stock").groupBy("seq")
             .agg(F.min_by("name", "cart_id").alias("_short")))
    text = F.when(F.col("_short").isNull(), F.lit("Insufficient stock")).otherwise(
        F.concat(F.lit("Insufficient stock for "), F.col("_short")))
    return rows.select("seq", "_first", "_ok").distinct().join(short, "seq", "left").select(
        "seq", F.when(F.col("_ok") & (F.col("seq") > F.col("_first")), "cart_empty").when(F.col("_ok").isNull(), text).alias("reason"))


def decide_in_rounds(lines: DataFrame) -> DataFrame:
    """``lines``: (seq, variant_id, quantity, stock) of competing requests.
    Returns (seq, accepted).

    With running sums per variant over the undecided and accepted requests in
    seq order, a pending request is surely accepted when it fits even if every
    earlier undecided request were accepted, and surely rejected when it does
    not fit counting only the accepted ones. The earliest pending request always
    meets one of the two, so every round decides at least one."""
    per = materialize(lines.groupBy("seq", "variant_id").agg(
        F.max("quantity").alias("_check"), F.sum("quantity").alias("_take"), F.max("stock").alias("_stock")))
    status = materialize(per.select("seq").distinct().withColumn("_st", F.lit("pending")))
    while not status.where("_st = 'pending'").isEmpty():
        # Only variants that still have an undecided request need new sums.
        open_ = per.join(status.where("_st = 'pending'"), "seq").select("variant_id").distinct()
        live = per.join(open_, "variant_id", "left_semi").join(status.where("_st <> 'rejected'"), "seq")
        live = live.withColumn("_acc", F.when(F.col("_st") == "accepted", F.col("_take")).otherwise(F.lit(0)))
        sums = running_sums(live.withColumn("_all", F.col("_take")), ["variant_id"], [F.col("seq").asc()], ["_acc", "_all"])
        verdict = sums.where("_st = 'pending'").groupBy("seq").agg(
            F.bool_and(F.col("_all_cum") - F.col("_all") + F.col("_check") <= F.col("_stock")).alias("_sure_ok"),
            F.bool_or(F.col("_acc_cum") - F.col("_acc") + F.col("_check") > F.col("_stock")).alias("_sure_bad"))
        status = materialize(status.join(verdict, "seq", "left").select("seq", F.when(F.col("_st") != "pending", F.col("_st"))
                             .when(F.col("_sure_bad"), "rejected").when(F.col("_sure_ok"), "accepted").otherwise("pending").alias("_st")))
    return status.select("seq", (F.col("_st") == "accepted").alias("accepted"))


# The pass is pickled by value: executors need pyarrow, not this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
