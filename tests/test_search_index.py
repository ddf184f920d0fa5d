"""Many searches in one job give what the one-query operators give."""

import pytest
from pyspark.sql import functions as F

from shopframe.operators import admin as A
from shopframe.operators import catalog as C
from shopframe.operators import search_index as I

TEXTS = ["  HOT ", "an", "a", "", None, "ring", "Women", "o_e", "%%", "_o", "100%", "zzzz", "é", "r%g", "  ", "n e", "0001", "\\%", "\t ri "]


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([*enumerate(TEXTS), (50, "an"), (51, "ring")], "query_id long, q string").repartition(3)


@pytest.mark.parametrize("mode", ["live", "tiered"])
def test_catalog_search(t_small, queries, mode):
    rows = I.search_products_many(t_small, queries, mode).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.position)):
        got.setdefault(r.query_id, []).append((r.id, r.search_rank))
    for i, q in [*enumerate(TEXTS), (50, "an"), (51, "ring")]:
        want = [(r.id, r.search_rank) for r in C.search_products(t_small, q, mode).collect()]
        assert got.get(i, []) == want, q


def test_odd_texts(spark):
    """Null fields, names shorter than a gram, other scripts, a lone backslash."""
    products = spark.createDataFrame([(1, "ab", None, None, "x"), (2, None, "AB", "é", None), (3, "Éa", "b", None, None), (4, "a\\b", "", "", "")],
                                     "id long, name string, category string, sub_category string, collection_name string")
    products = products.withColumn("image1", F.lit("i"))
    queries = spark.createDataFrame([(1, "ab"), (2, "éa"), (3, "a\\b"), (4, "b_"), (5, "_b")], "query_id long, q string")
    got = sorted((r.query_id, r.id) for r in I.search_products_many({"products": products}, queries, "tiered").collect())
    assert got == [(1, 1), (1, 2), (2, 3), (3, 1), (3, 2), (5, 1), (5, 2), (5, 4)]


@pytest.mark.parametrize("k", [None, 3])
def test_admin_search(t_small, queries, k):
    users = t_small["users"]
    rows = I.search_rows_many(users, "id", ["id", "first_name", "last_name", "email"], queries, k=k).collect()
    messages = t_small["contact_messages"]
    said = I.search_rows_many(messages, "id", ["name", "email", "message"], queries, joined=False, k=k).collect()
    for i, q in enumerate(TEXTS):
        for got, want in ((rows, A.search_users(users, q)), (said, A.search_messages(messages, q))):
            ids = sorted(r.id for r in want.collect())
            assert sorted(r.id for r in got if r.query_id == i) == (ids if k is None else ids[:k]), q


def test_lookup_takes_the_rarest_gram(spark):
    rows = spark.createDataFrame([(i, f"common {'rare' if i == 7 else 'word'}") for i in range(50)], "id long, name string")
    texts = spark.createDataFrame([("common rare",), ("nothing like it",)], "q string")
    index = I.gram_index(rows, "id", [F.col("name")])
    assert [r.id for r in I.candidates(index, texts, False).collect()] == [7]
