"""Search for many queries in one job.

The searched texts are cut into grams of one to three characters, lower-cased;
the index is the distinct (gram, row id). A query is looked up through the gram
of its text that the fewest rows have: rows without it cannot match, so one
posting list holds all its matches. The rows found are then tested exactly, with
the predicate of the one-query operator, and ranked. Equal query texts are
searched once.

Wildcards that a user types (``%``, ``_``) stay wildcards in the LIKE searches;
only the characters between them are looked up. A query of wildcards alone is
looked up under the empty gram, which every row has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import catalog as C

GRAM = 3


def _grams(text: Column, sizes) -> Column:
    """Distinct grams of a text (null: none)."""
    def of(n):
        places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.substring(text, i, n))
    return F.array_distinct(F.flatten(F.array(*[of(n) for n in sizes])))


def gram_index(rows: DataFrame, id_col: str, texts: list[Column]) -> DataFrame:
    """(gram, id): the grams of the lower-cased texts of every row."""
    names = [f"_t{i}" for i in range(len(texts))]
    low = rows.select(F.col(id_col).alias("_id"), *[
        F.lower(F.coalesce(t.cast("string"), F.lit(""))).alias(n) for t, n in zip(texts, names)])
    grams = F.flatten(F.array(F.array(F.lit("")), *[_grams(F.col(n), range(1, GRAM + 1)) for n in names]))
    return low.select(F.explode(F.array_distinct(grams)).alias("gram"), F.col("_id").alias("id"))


def _query_grams(text: Column, wildcards: bool) -> Column:
    """The grams to look a query up by: the longest there are."""
    text = F.lower(text)
    parts = F.split(text, r"[%_\\]") if wildcards else F.array(text)

    def of(n):
        return F.flatten(F.transform(parts, lambda p: _grams(p, [n])))
    longest = F.lit(None).cast("array<string>")
    for n in range(1, GRAM + 1):
        longest = F.when(F.size(of(n)) > 0, of(n)).otherwise(longest)
    return F.array_distinct(F.coalesce(longest, F.array(F.lit(""))))


def candidates(index: DataFrame, texts: DataFrame, wildcards: bool) -> DataFrame:
    """``texts``: distinct query texts (q). (q, id) of the rows that have the
    rarest gram of the query."""
    asked = materialize(texts.select("q", F.explode(_query_grams(F.col("q"), wildcards)).alias("gram")))
    counts = (index.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram")
              .agg(F.count(F.lit(1)).alias("n")))
    # A gram that no row has is the rarest, and finds nothing.
    rarest = asked.join(counts, "gram", "left").groupBy("q").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0")
    rarest = materialize(rarest.select("q", "r.gram"))
    return rarest.join(index, "gram").select("q", "id")


def like_text(q: Column) -> Column:
    """A LIKE pattern in which a backslash before another character than a
    wildcard or a backslash means nothing."""
    return F.regexp_replace(q, r"\\(?=[^%_\\]|$)", "")


def _answer(queries: DataFrame, hits: DataFrame, order: list[Column], k: int | None) -> DataFrame:
    """Hits (q, ...) of distinct texts, the best ``k`` each, for every query
    (query_id, q)."""
    if k is not None:
        hits = hits.withColumn("position", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("position") <= k)
    return queries.join(hits, "q").drop("q")


def search_products_many(t, queries: DataFrame, mode: str = "live", index: DataFrame | None = None) -> DataFrame:
    """``catalog.search_products`` for every row of ``queries`` (query_id, q):
    its rows with the query_id and their ``position``. ``index``: a written
    ``product_index``."""
    index = product_index(t) if index is None else index
    asked = materialize(queries.select("query_id", F.trim(F.regexp_replace("q", r"^\s+|\s+$", "")).alias("q"))
                        .where(F.length("q") >= 2))
    found = candidates(index, asked.select("q").distinct(), True)
    fields = ["name", "category", "sub_category", "collection_name"]
    if mode == "live":
        rows = C.product_cards(t, columns=list(dict.fromkeys([*C.CARD_COLUMNS, *fields])))
    else:
        rows = t["products"].select("id", "image1", *fields)
    hits = found.join(rows, "id").withColumn("_like", like_text(F.col("q")))

    def like(c, pattern):
        return F.expr(f"coalesce({c} ILIKE {pattern}, false)")
    anywhere = "concat('%', _like, '%')"
    matches = like("name", anywhere)
    for c in fields[1:]:
        matches = matches | like(c, anywhere)
    hits = hits.where(matches)
    if mode == "live":
        rank = F.when(like("name", "concat(_like, '%')"), 1).otherwise(2)
        keep = C.CARD_COLUMNS
    else:
        rank = (F.when(like("name", anywhere), 1).when(like("collection_name", anywhere), 2)
                .when(like("category", anywhere), 3).otherwise(4))
        keep = ["id", "name", "image1", "category", "sub_category", "collection_name"]
    price = ["price"] if mode == "live" else []
    hits = hits.select("q", *dict.fromkeys([*keep, *price]), rank.alias("search_rank"))
    return _answer(asked, hits, [F.col("search_rank"), F.col("id")], 8 if mode == "live" else 12)


def product_index(t) -> DataFrame:
    """The index of the catalog search, to be written and used again."""
    return gram_index(t["products"], "id", [F.col(c) for c in ("name", "category", "sub_category", "collection_name")])


def search_rows_many(rows: DataFrame, id_col: str, fields: list[str], queries: DataFrame, joined: bool = True,
                     k: int | None = None) -> DataFrame:
    """The admin searches (B13-B18) for every row of ``queries`` (query_id, q):
    the rows whose fields contain the text, case-insensitively, with the
    query_id. ``joined``: the text may span fields (B13-B17); else it lies in
    one of them (B18). A query without text matches every row, as in the
    one-query searches. ``k``: only the first by id, with their ``position``."""
    if joined:
        texts = [F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])]
    else:
        texts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    asked = materialize(queries.select("query_id", F.coalesce("q", F.lit("")).alias("q")))
    found = candidates(gram_index(rows, id_col, texts), asked.select("q").distinct(), False)
    hits = found.withColumnRenamed("id", "_id").join(rows, F.col("_id") == F.col(id_col))
    hits = hits.where(reduce(lambda a, b: a | b, [F.contains(F.lower(x), F.lower(F.col("q"))) for x in texts]))
    return _answer(asked, hits, [F.col("_id")], k).drop("_id")
