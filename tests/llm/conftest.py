import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def odd_rows():
    """(doc_id, text): nulls, empty and blank texts, ties, repeated rows, near
    copies, shared passages, a very long text, other scripts."""
    rng = random.Random(5)
    a, b, c = (words(rng, 120) for _ in range(3))
    passage = words(rng, 60)
    long = " ".join(f"t{rng.randrange(10**9)}" for _ in range(30_000))
    line = "the quick brown fox jumps over the lazy dog and runs away into the wood"
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, a), (5, a), (6, a.replace(" ", "  ", 3)), (7, a[:-4] + " END"),
        (8, b + "\n" + passage + "\n" + c), (9, passage + " " + b), (10, c.upper()), (11, long), (12, long + " tail"),
        (12, long + " tail"), (None, passage), (None, None), (13, "one"), (14, "one"), (15, "two words"),
        (16, f"{line}\n{line}\n\n{line}!\n{line} too"), (17, line), (18, "x" * 200), (19, "x" * 130 + "y"),
        (20, "été où ça naïve Übergröße " * 12), (21, "été où ça naïve Übergröße " * 11 + "日本語のテキスト" * 9),
        (22, "日本語のテキスト" * 20), (23, "%%% $$$ ||| " * 30), (24, "a b c " * 40), (25, "12 345 !? ---"),
    ]


@pytest.fixture(scope="session")
def rows():
    return odd_rows()


@pytest.fixture(scope="session")
def odd(spark, rows):
    """The odd rows with more columns, named as the operators name their own."""
    more = "f long, cell long, id long, th long, bucket int, pos string, c0 string, key string, shard int, " \
           "`_copy` int, `a.b` int, `p_toxic` double, `_keep` long, rate double"
    data = [(d, t, "en" if d and d % 2 else None, f"s{(d or 0) % 3}" if d != 4 else None, len(t or ""),
             7, 7, 7, 7, 7, "p", "c", "k", 7, 7, 7, 0.7, 7, 0.7) for d, t in rows]
    return spark.createDataFrame(data, f"{SCHEMA}, {more}").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, 0), (8, 1, 1), (9, 0, 1), (10, 1, 0), (None, 1, 1), (13, None, 1),
                                  (4, 0, 0)], "doc_id long, quality int, toxic int")


def rows_of(df, *columns):
    """Rows as sorted tuples, None first."""
    got = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(got, key=lambda r: [(x is not None, x) for x in r])


def ordered(values):
    return sorted(values, key=lambda r: [(x is not None, x) for x in r])
