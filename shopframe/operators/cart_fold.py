"""Cart commands (G1 add, G2 quantity change, G3 remove) applied in request
order per (user, variant).

A rejected command leaves the line unchanged, so the result is an ordered,
non-associative fold (``least(sum, stock)`` would be wrong). The fold runs as
a secondary-sort stream: Spark hash-partitions by the key and sorts each
partition by (key, initial row first, seq) with its spilling external sort;
``mapInArrow`` then walks the sorted Arrow batches once, carrying only the
current key's line between rows and batches. Memory per task is one batch
plus one line, whatever the size of a key's history, and no key's history is
gathered into an array or one Arrow group. A key with very many commands is
also split across tasks (``fold_cart_commands``), so even a key holding a
large share of all commands is not replayed by one task.

Rules (per command, against the line's current quantity ``q`` and the
variant's stock):
* add(n): n < 1 -> invalid_request; unknown variant -> variant_not_found;
  line exists: q + n > stock -> stock_limit, else q += n;
  no line: n > stock -> insufficient_stock, else insert (is_gift taken from
  this command).
* update(d): no line (or unknown variant) -> not_found; q + d < 1 ->
  below_minimum; q + d > stock -> stock_limit; else q += d.
* remove: no line -> not_found; else the line is deleted.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT_SCHEMA = ("row_kind string, user_id long, variant_id long, chunk long, seq long, op string, "
              "accepted boolean, reason string, inserted boolean, quantity long, is_gift int, "
              "cart_id long, inserted_by long")
OUT_COLS = ["row_kind", "user_id", "variant_id", "chunk", "seq", "op", "accepted", "reason", "inserted",
            "quantity", "is_gift", "cart_id", "inserted_by"]
OUT_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(),
             pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

# Keys with more commands than this are split into ordered chunks of at least
# this many commands that run in parallel; the result does not depend on it.
HOT_KEY_COMMANDS = 100_000
MAX_CHUNKS = 1024


def _rows(rows, columns, types):
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=columns)


def _decide(op, n, stock, qty):
    """One command on a line of quantity ``qty`` (None: no line): reason or None."""
    if op == "add":
        if n < 1:
            return "invalid_request"
        if stock is None:
            return "variant_not_found"
        if qty is None:
            return "insufficient_stock" if n > stock else None
        return "stock_limit" if qty + n > stock else None
    if op == "update":
        if qty is None or stock is None:
            return "not_found"
        if qty + n < 1:
            return "below_minimum"
        return "stock_limit" if qty + n > stock else None
    if op == "remove":
        return "not_found" if qty is None else None
    return "unknown_op"


def _fold(batches):
    """Stream (key, chunk)-sorted rows: an init row (_kind 0) then commands.
    Values are Python integers, exact at any size."""
    cur = None          # current (user_id, variant_id, chunk)
    qty = None          # current line quantity (None = no line)
    gift = None
    cid = None          # stored cart id (None once the line is re-inserted)
    ins = None          # seq of the command that inserted the line

    def state_row(key):
        return ("state", key[0], key[1], key[2], None, None, None, None, None, qty, gift, cid, ins)

    for batch in batches:
        out = []
        names = ("user_id", "variant_id", "_chunk", "_kind", "seq", "op", "qty", "is_gift", "stock", "cart_id")
        for u, v, c, kind, seq, op, n, g, stock, stored in zip(*[batch.column(x).to_pylist() for x in names]):
            key = (u, v, c)
            if key != cur:
                if cur is not None:
                    out.append(state_row(cur))
                cur, qty, gift, cid, ins = key, None, None, None, None
            if kind == 0:  # the line at the start of this key (or chunk)
                qty, gift, cid = n, g, stored
                continue
            reason, inserted = _decide(op, n, stock, qty), False
            if reason is None:
                if op == "remove":
                    qty, gift, cid, ins = None, None, None, None
                elif qty is None:
                    qty, gift, cid, ins, inserted = n, g, None, seq, True
                else:
                    qty += n
            out.append(("outcome", u, v, c, seq, op, reason is None, reason, inserted, qty, gift, None, None))
        if out:
            yield _rows(out, OUT_COLS, OUT_TYPES)
    if cur is not None:
        yield _rows([state_row(cur)], OUT_COLS, OUT_TYPES)


# A chunk of commands is a function from the line before it to the line after.
# For a start quantity q it is piecewise: on each interval of q the result is
# q + value (SHIFT), the quantity value (CONST) or no line (NONE). A separate
# pair gives the result for a start without a line. No bound on quantities.
SHIFT, CONST, NONE = 0, 1, 2


def _step(pieces, op, n, stock):
    """Apply one command to pieces [(lo or None, kind, value)], sorted by lo
    (None: unbounded below), each reaching to the next one's lo."""
    if op not in ("add", "update", "remove") or (op == "add" and n < 1) or (op != "remove" and stock is None):
        return pieces
    out = []
    for i, (lo, kind, value) in enumerate(pieces):
        if op == "remove":
            out.append((lo, NONE, 0))
            continue
        if kind != SHIFT:
            qty = value if kind == CONST else None
            if _decide(op, n, stock, qty) is None:
                out.append((lo, CONST, n if qty is None else qty + n))
            else:
                out.append((lo, kind, value))
            continue
        # Accepted for start quantities in [first, last].
        last = stock - n - value
        first = None if op == "add" else 1 - n - value
        hi = pieces[i + 1][0] if i + 1 < len(pieces) else None
        cuts = [lo, *sorted(x for x in {first, last + 1} - {None}
                            if (lo is None or x > lo) and (hi is None or x < hi))]
        for x in cuts:
            inside = (first is None or (x is not None and x >= first)) and (x is None or x <= last)
            out.append((x, SHIFT, value + n if inside else value))
    merged = out[:1]
    for p in out[1:]:
        if p[1:] != merged[-1][1:]:
            merged.append(p)
    return merged


def _chunk_functions(batches):
    """Per (key, chunk) of a hot key: its commands composed to one function."""
    columns = ["user_id", "variant_id", "_chunk", "_lo", "_kind", "_value", "_none"]
    types = [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64()]
    cur, pieces, none, rows = None, None, None, []

    def row():
        return (*cur, [p[0] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces], none)

    for batch in batches:
        names = ("user_id", "variant_id", "_chunk", "op", "qty", "stock")
        for u, v, c, op, n, stock in zip(*[batch.column(x).to_pylist() for x in names]):
            if (u, v, c) != cur:
                if cur is not None:
                    rows.append(row())
                cur, pieces, none = (u, v, c), [(None, SHIFT, 0)], None
            pieces = _step(pieces, op, n, stock)
            if _decide(op, n, stock, none) is None:
                none = None if op == "remove" else n if none is None else none + n
        if len(rows) >= 64:
            yield _rows(rows, columns, types)
            rows = []
    if cur is not None:
        rows.append(row())
    if rows:
        yield _rows(rows, columns, types)


def _walk_chunks(table: pa.Table) -> pa.Table:
    """One hot key: walk its chunk functions in order from the stored line;
    the start quantity (null: no line) of every chunk."""
    rows = sorted(table.to_pylist(), key=lambda r: r["_chunk"])
    q, starts = rows[0]["_q0"], []
    for r in rows:
        starts.append(q)
        if q is None:
            q = r["_none"]
        else:
            i = bisect_right(r["_lo"][1:], q)
            q = {SHIFT: q + r["_value"][i], CONST: r["_value"][i], NONE: None}[r["_kind"][i]]
    return pa.table({"user_id": [r["user_id"] for r in rows], "variant_id": [r["variant_id"] for r in rows],
                     "_chunk": [r["_chunk"] for r in rows], "_start": pa.array(starts, pa.int64())})


def _stream(rows: DataFrame, n: int) -> DataFrame:
    keys = ["user_id", "variant_id", "_chunk"]
    return (rows.repartition(n, *keys).sortWithinPartitions(*keys, "_kind", "seq")
            .mapInArrow(_fold, OUT_SCHEMA))


def _init_rows(init: DataFrame, chunk_col=None) -> DataFrame:
    chunk_col = F.lit(0) if chunk_col is None else chunk_col
    return init.select(F.lit(0).alias("_kind"), "user_id", "variant_id", chunk_col.cast("long").alias("_chunk"),
                       F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("op"),
                       F.col("qty").cast("long").alias("qty"), F.col("is_gift").cast("int").alias("is_gift"),
                       F.col("cart_id").cast("long").alias("cart_id"), F.lit(None).cast("long").alias("stock"))


def _cmd_rows(cmds: DataFrame, chunk_col=None) -> DataFrame:
    chunk_col = F.lit(0) if chunk_col is None else chunk_col
    return cmds.select(F.lit(1).alias("_kind"), "user_id", "variant_id", chunk_col.cast("long").alias("_chunk"),
                       "seq", "op", "qty", "is_gift", F.lit(None).cast("long").alias("cart_id"), "stock")


def fold_cart_commands(cart_items: DataFrame, commands: DataFrame, variants: DataFrame,
                       num_partitions: int | None = None,
                       hot_threshold: int = HOT_KEY_COMMANDS, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """Run the fold; returns outcome rows (one per command) and one state row
    per touched or stored key (quantity NULL = no line) with the final line.

    Only keys with a command pass through the fold; of a key stored more than
    once the line of lowest id is the one commands address.

    Keys with more than ``hot_threshold`` commands are split: their commands
    are numbered within the key (skew-safe, ``paging.number_rows``) and cut
    into at most ``max_chunks`` ordered chunks; each chunk is composed to one
    piecewise function of the start line in parallel, a per-key walk over the
    functions yields every chunk's exact start line, and the chunks then replay
    in parallel. The results are the same for every threshold."""
    from ..session import materialize
    from .paging import number_rows
    spark = commands.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["user_id", "variant_id"]
    stock = variants.select(F.col("id").alias("variant_id"), F.col("stock").cast("long").alias("stock"))
    # The stored line per key (a bag may hold duplicates: the lowest id is
    # the one the shop reads back).
    touched = commands.select(*key).distinct()
    init = (cart_items.join(touched, key, "left_semi").groupBy(*key).agg(
        F.min("id").alias("cart_id"),
        F.min_by("quantity", "id").cast("long").alias("qty"),
        F.min_by("is_gift", "id").cast("int").alias("is_gift")))
    cmds = (commands.join(stock, "variant_id", "left")
            .select("user_id", "variant_id", F.col("seq").cast("long"), "op", F.col("qty").cast("long"),
                    F.col("is_gift").cast("int"), "stock"))
    hot = (cmds.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_threshold)
           .join(init.select(*key, F.col("qty").alias("_q0")), key, "left")
           .select(*key, F.ceil(F.col("_n") / F.lit(max_chunks)).alias("_csize"), "_q0"))
    # At most (number of commands / hot_threshold) rows.
    hot = materialize(hot)
    if hot.isEmpty():
        return _stream(_init_rows(init).unionByName(_cmd_rows(cmds)), n)
    hot_keys = hot.select(*key)
    cold = _stream(_init_rows(init.join(hot_keys, key, "left_anti"))
                   .unionByName(_cmd_rows(cmds.join(hot_keys, key, "left_anti"))), n)
    hot_cmds = number_rows(cmds.join(hot, key, "inner"), [F.col("seq").asc()], key)
    hot_cmds = materialize(hot_cmds.withColumn(
        "_chunk", F.floor((F.col("position") - 1) / F.col("_csize")).cast("long")))
    functions = (hot_cmds.repartition(n, *key, "_chunk").sortWithinPartitions(*key, "_chunk", "seq")
                 .select("user_id", "variant_id", "_chunk", "op", "qty", "stock")
                 .mapInArrow(_chunk_functions, "user_id long, variant_id long, _chunk long, _lo array<long>, "
                                               "_kind array<int>, _value array<long>, _none long"))
    starts = (functions.join(hot.select(*key, "_q0"), key, "inner")
              .groupBy(*key).applyInArrow(_walk_chunks,
                                          "user_id long, variant_id long, _chunk long, _start long"))
    chunk_init = starts.select(*key, "_chunk", F.col("_start").alias("qty"),
                               F.lit(None).cast("int").alias("is_gift"), F.lit(None).cast("long").alias("cart_id"))
    hot_out = materialize(_stream(_init_rows(chunk_init, F.col("_chunk"))
                                  .unionByName(_cmd_rows(hot_cmds, F.col("_chunk"))), n))
    # The final line of a hot key: the last chunk's quantity; if the batch
    # (re)inserted it, gift and id come from the last insert, else from the
    # stored line.
    last = (hot_out.where(F.col("row_kind") == "state").groupBy(*key)
            .agg(F.max_by("quantity", "chunk").alias("quantity")))
    last_ins = (hot_out.where((F.col("row_kind") == "outcome") & F.col("inserted")).groupBy(*key)
                .agg(F.max("seq").alias("_ins_seq"), F.max_by("is_gift", "seq").alias("_ins_gift")))
    stored = init.join(hot_keys, key, "inner").select(*key, F.col("cart_id").alias("_cid"),
                                                      F.col("is_gift").alias("_gift"))
    hot_state = (last.join(last_ins, key, "left").join(stored, key, "left")
                 .select(F.lit("state").alias("row_kind"), *key, F.lit(None).cast("long").alias("chunk"),
                         F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("op"),
                         F.lit(None).cast("boolean").alias("accepted"), F.lit(None).cast("string").alias("reason"),
                         F.lit(None).cast("boolean").alias("inserted"), "quantity",
                         F.when(F.col("_ins_seq").isNotNull(), F.col("_ins_gift")).otherwise(F.col("_gift"))
                         .alias("is_gift"),
                         F.when(F.col("_ins_seq").isNull(), F.col("_cid")).alias("cart_id"),
                         F.col("_ins_seq").alias("inserted_by")))
    hot_outcomes = hot_out.where(F.col("row_kind") == "outcome")
    return cold.unionByName(hot_outcomes).unionByName(hot_state)


def apply_cart_commands(cart_items: DataFrame, commands: DataFrame, variants: DataFrame,
                        checkpoint: bool = False, hot_threshold: int = HOT_KEY_COMMANDS,
                        max_chunks: int = MAX_CHUNKS):
    """Returns ``(new_cart_items, outcomes)``.

    Rows of keys no command touched, and further stored rows of a touched key,
    stay as they are. A line inserted by the batch gets ``id = max(existing
    id) + seq`` of its inserting command, which is unique and needs no global
    row numbering."""
    folded = fold_cart_commands(cart_items, commands, variants, hot_threshold=hot_threshold,
                                max_chunks=max_chunks)
    if checkpoint:
        folded = folded.checkpoint(eager=True)
    # max(existing id) as a scalar subquery: one value, no join.
    base = cart_items.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_base")).scalar()
    state = folded.where((F.col("row_kind") == "state") & F.col("quantity").isNotNull())
    cols = ["id", "user_id", "variant_id", "quantity", "is_gift"]
    lines = state.select(F.coalesce("cart_id", base + F.col("inserted_by")).alias("id"), *cols[1:])
    key = ["user_id", "variant_id"]
    addressed = (cart_items.join(commands.select(*key).distinct(), key, "left_semi")
                 .groupBy(*key).agg(F.min("id").alias("id")).select("id"))
    rest = cart_items.join(addressed, "id", "left_anti").select(
        "id", *key, F.col("quantity").cast("long"), F.col("is_gift").cast("int"))
    new_cart = rest.unionByName(lines)
    outcomes = (folded.where(F.col("row_kind") == "outcome")
                .select("seq", "user_id", "variant_id", "op", "accepted", "reason",
                        F.col("quantity").alias("quantity_after")))
    return new_cart, outcomes


# The functions above run inside Python workers (mapInArrow / applyInArrow).
# Ship them by value, so workers need pyarrow but not this package
# on their import path.
from pyspark import cloudpickle as _cloudpickle  # noqa: E402
import sys as _sys  # noqa: E402

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
