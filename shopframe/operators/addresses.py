"""E-mail addresses taken in request order.

An edit takes its address unless another user holds it, and gives the user's
former address up, which is then free for the next request. What can be told
without order is settled by joins; the rest is replayed request by request, in
one streaming pass per component of users and addresses:

* an address held by a user who asks for no other one stays taken;
* an address that nobody holds goes to the first user who asks for it, and stays
  taken when that user asks for no other one.

So a popular address costs its losers no replay, and does not tie the users who
ask for it together.
"""

from __future__ import annotations

import sys as _sys

import pyarrow as pa
from pyspark import cloudpickle as _cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import components

TASK_EDGES = 500_000        # edges (counted) that one task joins to components


def _replay(batches):
    """Rows (group, seq, user, address, known, sure) sorted by (group, seq),
    holders first (no seq): seq and taken of every request. ``known``: the user
    exists; ``sure``: the request is known to be accepted."""
    group, holders, at = None, {}, {}
    seqs, taken = [], []
    for batch in batches:
        for g, seq, user, address, known, sure in zip(*[c.to_pylist() for c in batch.columns]):
            if g != group:
                group, holders, at = g, {}, {}
            if seq is not None:
                refused = not sure and bool(holders.get(address, set()) - {user})
                seqs.append(seq)
                taken.append(refused)
                if refused or not known:
                    continue
                holders.get(at.get(user), set()).discard(user)
            holders.setdefault(address, set()).add(user)
            at[user] = address
        if len(seqs) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(taken, pa.bool_())], names=["seq", "taken"])
            seqs, taken = [], []
    if seqs:
        yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(taken, pa.bool_())], names=["seq", "taken"])


def take_addresses(holders: DataFrame, requests: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``holders``: (user_id, address), an address may have several; ``requests``:
    (seq, user_id, address). Returns (seq, taken): whether another user holds
    the address when the request's turn comes. A request of an unknown user is
    answered, but takes nothing."""
    req = materialize(requests.join(holders.select("user_id", F.col("address").alias("cur")), "user_id", "left"))
    asks = req.groupBy("user_id").agg(F.min("address").alias("_lo"), F.max("address").alias("_hi"), F.first("cur").alias("cur"))
    movers = materialize(asks.where("cur IS NOT NULL AND (_lo <> cur OR _hi <> cur)").select("user_id", "_lo", "_hi", "cur"))
    asked = req.select("address").distinct()
    held = holders.join(asked, "address", "left_semi").join(movers.select("user_id", F.lit(True).alias("_moves")), "user_id", "left")
    held = materialize(held.groupBy("address").agg(
        F.count(F.lit(1)).alias("_held"), F.count(F.when(F.col("_moves").isNull(), 1)).alias("_fixed"),
        F.min(F.when(F.col("_moves").isNull(), F.col("user_id"))).alias("_one")))
    req = req.join(held, "address", "left")
    fixed = F.coalesce((F.col("_fixed") > 1) | ((F.col("_fixed") == 1) & (F.col("_one") != F.col("user_id"))), F.lit(False))
    # The first user to ask for a free address, if asking for nothing else.
    first = (req.where("_held IS NULL AND cur IS NOT NULL").groupBy("address")
             .agg(F.min_by("user_id", "seq").alias("user_id"), F.min("seq").alias("_from")))
    winner = first.join(movers.where("_lo = _hi").select("user_id"), "user_id", "left_semi").withColumnRenamed("user_id", "_winner")
    req = materialize(req.withColumn("_refused", fixed).join(winner, "address", "left").select(
        "seq", "user_id", "address", "cur",
        F.when(F.col("_refused"), True).when(F.col("_winner") == F.col("user_id"), False)
        .when(F.col("_winner").isNotNull() & (F.col("seq") > F.col("_from")), True).alias("taken")))
    # Open requests, and those that are sure to be accepted: they give an address up.
    openly = req.where("taken IS NULL")
    current = movers.select("user_id", F.col("cur").alias("address")).join(
        openly.select("address").distinct(), "address", "left_semi")
    user, address = F.concat(F.lit("u"), F.col("user_id").cast("string")), F.concat(F.lit("a"), F.col("address"))
    edges = openly.select(user.alias("a"), address.alias("b")).unionByName(current.select(user.alias("a"), address.alias("b")))
    groups = components(edges, task_edges).where(F.col("node").startswith("u")).select(
        F.substring("node", 2, 40).cast("long").alias("user_id"), F.col("component").alias("group"))
    rows = req.where("taken IS NULL OR NOT taken").select(
        "seq", "user_id", "address", F.col("cur").isNotNull().alias("known"), F.col("taken").isNotNull().alias("sure"))
    start = current.select(F.lit(None).cast("long").alias("seq"), "user_id", "address", F.lit(True).alias("known"),
                           F.lit(True).alias("sure"))
    replayed = (rows.unionByName(start).join(groups, "user_id").select("group", "seq", "user_id", "address", "known", "sure")
                .repartition("group").sortWithinPartitions("group", F.col("seq").asc_nulls_first())
                .mapInArrow(_replay, "seq long, taken boolean"))
    return req.select("seq", F.col("taken").alias("_t")).join(replayed, "seq", "left").select(
        "seq", F.coalesce("_t", "taken").alias("taken"))


# The pass is pickled by value: executors need pyarrow, not this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
