"""Merkle manifest of a dataset as a SHA midstate tree.

Every row is a leaf: the SHA-256 of its columns, each ``-`` when null and else
its UTF-8 byte count, ``:`` and the value. Within a source the leaves ascend by
id; every ``FANOUT`` consecutive nodes become the digest of their concatenated
hex digests until one is left, the source's subroot. The subroots, ordered by
source, likewise give the root.

A parent keeps a copy of its hash state before each child slot. To fold a
changed leaf, the state before its slot is resumed with the replacement and the
right siblings only; what that gives replaces the parent in its own parent.

How it is spread out:

1. Leaf digests (and those of changed rows) are computed where the text is, by
   Spark's own SHA-256; texts are never shuffled. Rows are numbered within their
   source by a range sort that splits a hot source over many tasks.
2. Blocks of ``FANOUT ** LEVELS`` consecutive leaves of a source are whole
   subtrees. One task builds a block and gives its root, so a source of any size
   is many small tasks.
3. The tree above the blocks, and that above the subroots, is built level by
   level with grouped lists of at most ``FANOUT`` digests; walking down again,
   every block learns its path: slot and children of each parent up to the root.
4. Blocks meet their path and build their states again; every leaf is proved and
   folded there, through the kept states of the block and of the path.

Edge cases: a null source comes first and is a source of its own; null ids come
first, rows of equal id are ordered by leaf, equal rows are leaves of their own;
null and empty texts are different leaves; a lone leaf is its own subroot and a
lone subroot the root, with no sibling (the proof of nothing is the digest of the
empty string); an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.paging import number_rows
from .common import materialize

FANOUT = 16
LEVELS = 3              # of a block: 4,096 leaves
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<slot:int,kids:string>>"
DIGEST = 64             # characters


def leaf_digest(columns: list[Column]) -> Column:
    """Hex SHA-256 of a row."""
    def field(c: Column) -> Column:
        s = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def group_key(source: Column) -> Column:
    """A source as a string without null that sorts as the sources do."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def leaves(docs: DataFrame, columns=COLUMNS, changed: dict[str, Column] | None = None, where: Column | None = None,
           id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(doc_id, g, idx, leaf, changed): every row's leaf, its place in its
    source and, for rows ``where`` some columns are ``changed``, the digest
    that the changed row would have."""
    own = {c: F.col(f"`{c}`") for c in columns}
    out = docs.select(own[id_col].alias("doc_id") if id_col in own else F.col(f"`{id_col}`").alias("doc_id"),
                      group_key(F.col(f"`{source_col}`")).alias("g"),
                      F.unhex(leaf_digest(list(own.values()))).alias("leaf"),
                      F.when(where, F.unhex(leaf_digest(list((own | changed).values())))).alias("changed")
                      if changed else F.lit(None).cast("binary").alias("changed"))
    # Written first: the range sort reads its input twice.
    placed = number_rows(materialize(out), [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()], ["g"])
    return placed.select("doc_id", "g", (F.col("position") - 1).alias("idx"), "leaf", "changed")


class Subtree:
    """Nodes of each level from the leaves up, and each parent's states before
    its child slots."""

    def __init__(self, nodes: list[bytes], fanout: int, depth: int):
        self.fanout, self.kids, self.states = fanout, [], []
        for _ in range(depth):
            runs = [nodes[lo:lo + fanout] for lo in range(0, len(nodes), fanout)]
            self.kids.append([b"".join(r) for r in runs])
            states, nodes = [], []
            for run in runs:
                h, before = hashlib.sha256(), []
                for x in run:
                    before.append(h.copy())
                    h.update(x)
                states.append(before)
                nodes.append(h.hexdigest().encode())
            self.states.append(states)
        self.root = nodes[0]

    def prove(self, i: int, proof) -> None:
        """Feed the siblings on the way up from leaf ``i`` to a hash."""
        for kids in self.kids:
            i, k = divmod(i, self.fanout)
            proof.update(kids[i][:k * DIGEST])
            proof.update(kids[i][(k + 1) * DIGEST:])

    def fold(self, i: int, digest: bytes) -> bytes:
        """The root if leaf ``i`` had this digest."""
        for kids, states in zip(self.kids, self.states):
            i, k = divmod(i, self.fanout)
            digest = resume(states[i][k], digest, kids[i][(k + 1) * DIGEST:])
        return digest


def resume(state, digest: bytes, right: bytes) -> bytes:
    h = state.copy()
    h.update(digest)
    h.update(right)
    return h.hexdigest().encode()


def natural_depth(n: int, fanout: int) -> int:
    depth = 0
    while n > 1:
        n, depth = -(-n // fanout), depth + 1
    return depth


def _blocks(batches):
    """Walk rows sorted by (g, block): yields (g, block, rows)."""
    key, rows = None, []
    for batch in batches:
        for r in zip(*[c.to_pylist() for c in batch.columns]):
            if r[:2] != key:
                if rows:
                    yield *key, rows
                key, rows = r[:2], []
            rows.append(r[2:])
    if rows:
        yield *key, rows


def _roots(fanout: int):
    """Rows (g, block, leaf): root and depth of each block."""
    def task(batches):
        for g, block, rows in _blocks(batches):
            depth = natural_depth(len(rows), fanout)
            tree = Subtree([r[0].hex().encode() for r in rows], fanout, depth)
            yield pa.RecordBatch.from_arrays(
                [pa.array([g]), pa.array([block], pa.int64()), pa.array([tree.root.decode()]), pa.array([depth], pa.int32())],
                names=["g", "idx", "digest", "depth"])
    return task


def climb(nodes: DataFrame, most: int, fanout: int = FANOUT) -> DataFrame:
    """``nodes``: (g, idx, digest, n), n being the number of nodes of g and
    ``most`` the largest. Returns (g, idx, path, root): the parents from each
    node to the root of its group."""
    parents, below = [], nodes
    while most > 1:
        runs = below.where("n > 1").groupBy("g", F.expr(f"idx div {fanout}").alias("up")).agg(
            F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("s"), F.max("n").alias("n"))
        runs = materialize(runs.select("g", "up", F.transform("s", lambda x: x["digest"]).alias("kids"),
                                       F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n")))
        parents.append(runs)
        below = runs.select("g", F.col("up").alias("idx"), F.sha2(F.array_join("kids", ""), 256).alias("digest"), "n")
        most = -(-most // fanout)
    none = F.array().cast(PATH)
    above = None
    for runs in reversed(parents):
        own = F.sha2(F.array_join("kids", ""), 256)
        if above is None:
            runs = runs.select("g", "up", "kids", none.alias("upper"), own.alias("root"))
        else:
            runs = runs.join(above.withColumnRenamed("idx", "up"), ["g", "up"], "left").select(
                "g", "up", "kids", F.coalesce("path", none).alias("upper"), F.coalesce("root", own).alias("root"))
        step = F.struct(F.col("slot"), F.array_join("kids", "").alias("kids"))
        above = runs.select("g", "up", "kids", "upper", "root", F.posexplode("kids").alias("slot", "_d")).select(
            "g", (F.col("up") * fanout + F.col("slot")).alias("idx"),
            F.concat(F.array(step), F.col("upper")).cast(PATH).alias("path"), "root")
    if above is None:
        return nodes.select("g", "idx", none.alias("path"), F.col("digest").alias("root"))
    return nodes.join(above, ["g", "idx"], "left").select(
        "g", "idx", F.coalesce("path", none).alias("path"), F.coalesce("root", "digest").alias("root"))


def block_paths(rows: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(g, block, depth, path, subroot, root, n_leaves) of each block of the
    leaves (g, idx, leaf)."""
    size = fanout ** levels
    cut = rows.select("g", F.expr(f"idx div {size}").alias("block"), "leaf", "idx")
    roots = materialize(cut.repartition("g", "block").sortWithinPartitions("g", "block", "idx")
                        .select("g", "block", "leaf").mapInArrow(_roots(fanout), "g string, idx long, digest string, depth int"))
    counts = materialize(roots.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    most = counts.agg(F.max("n").alias("n")).first().n or 0
    nodes = roots.join(counts, "g")
    # In a source of several blocks all leaves are equally deep.
    lifted = F.col("digest")
    for k in reversed(range(levels)):
        lifted = F.when((F.col("n") > 1) & (F.col("depth") <= k), F.sha2(lifted, 256)).otherwise(lifted)
    nodes = nodes.select("g", "idx", lifted.alias("digest"), "n",
                         F.when(F.col("n") > 1, F.lit(levels)).otherwise(F.col("depth")).alias("depth"))
    paths = materialize(climb(nodes, most, fanout).withColumnRenamed("root", "subroot"))
    subroots = number_rows(paths.where("idx = 0").select("g", "subroot"), [F.col("g").asc()])
    total = counts.count()
    top = climb(subroots.select(F.lit("").alias("g"), (F.col("position") - 1).alias("idx"),
                                F.col("subroot").alias("digest"), F.lit(total).cast("long").alias("n")), total, fanout)
    top = subroots.select(F.col("g").alias("of"), (F.col("position") - 1).alias("idx")).join(
        top.select("idx", F.col("path").alias("rest"), "root"), "idx")
    return (paths.join(nodes.select("g", "idx", "depth"), ["g", "idx"]).join(top.drop("idx"), F.col("g") == F.col("of"))
            .select("g", F.col("idx").alias("block"), "depth", F.concat("path", "rest").alias("path"), "subroot", "root"))


def manifest(docs: DataFrame, columns=COLUMNS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row per source: source, n_leaves, subroot and the root of all."""
    rows = leaves(docs, columns, id_col=id_col, source_col=source_col)
    counts = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n_leaves"))
    return block_paths(rows).where("block = 0").join(counts, "g").select(
        source_of("g").alias("source"), "n_leaves", "subroot", "root")


def source_of(g: str) -> Column:
    return F.when(F.col(g) != "", F.substring(g, 2, 1 << 30))


def _prove(fanout: int, id_type):
    """Rows (g, block, kind, doc_id, leaf, changed, depth, path, subroot,
    root) sorted by block, the block's path first."""
    def task(batches):
        for g, _, rows in _blocks(batches):
            *_, depth, path, subroot, root = rows[0]
            rows = rows[1:]
            tree = Subtree([r[2].hex().encode() for r in rows], fanout, depth)
            upper, rest = [], []
            for step in path:               # one kept state a parent
                k, kids = step["slot"], step["kids"].encode()
                h = hashlib.sha256()
                h.update(kids[:k * DIGEST])
                upper.append((h, kids[(k + 1) * DIGEST:]))
                rest += [kids[:k * DIGEST], kids[(k + 1) * DIGEST:]]
            rest = b"".join(rest)
            proofs, folds = [], []
            for i, r in enumerate(rows):
                proof = hashlib.sha256()
                tree.prove(i, proof)
                proof.update(rest)
                proofs.append(proof.hexdigest())
                digest = tree.fold(i, (r[2] if r[3] is None else r[3]).hex().encode())
                for state, right in upper:
                    digest = resume(state, digest, right)
                folds.append(digest.decode())
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([g] * n), pa.array([r[1] for r in rows], id_type), pa.array([r[2].hex() for r in rows]),
                 pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs), pa.array(folds)],
                names=["g", "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])
    return task


def prove(rows: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``rows`` as from ``leaves``. Per row: doc_id, leaf, subroot, root, the
    digest of its proof (all siblings up to the root, left to right), the root
    folded from its changed leaf (its own, where it has not changed), verified
    (whether the two roots are equal) and source."""
    size, kind = fanout ** levels, rows.schema["doc_id"].dataType
    paths = block_paths(rows, fanout, levels).select(
        "g", "block", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("binary").alias("leaf"),
        F.lit(None).cast("binary").alias("changed"), "depth", "path", "subroot", "root", F.lit(-1).cast("long").alias("idx"))
    own = rows.select("g", F.expr(f"idx div {size}").alias("block"), F.lit(1).alias("kind"), "doc_id",
                      "leaf", "changed", F.lit(None).cast("int").alias("depth"), F.lit(None).cast(PATH).alias("path"),
                      F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"), "idx")
    out = (paths.unionByName(own).repartition("g", "block").sortWithinPartitions("g", "block", "kind", "idx").drop("idx")
           .mapInArrow(_prove(fanout, to_arrow_type(kind)), f"g string, doc_id {kind.simpleString()}, leaf string, subroot string, root string, "
                                                                   "proof_sha256 string, folded_root string"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"), source_of("g").alias("source"))


def manifest_report(docs: DataFrame) -> DataFrame:
    """Proofs of all documents; in those whose id's CRC-32 five divides, the
    text's A-Z are lower-cased before folding."""
    picked = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return prove(leaves(docs, changed={"text": F.translate("text", UPPER, LOWER)}, where=picked)).drop("source")


def _oracle(levels: int = 5, top: int = 3, fanout: int = FANOUT) -> str:
    """The report in DuckDB SQL: trees of up to fanout ** levels leaves a source
    and fanout ** top sources."""
    def enc(text):
        cols = ["doc_id", "source", "lang", "n_chars", text]
        return " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
                           for c in cols)
    step = "CASE WHEN {0} % 2 = 1 THEN xor({0} // 2, 3988292384) ELSE {0} // 2 END"
    rounds = ", ".join(f"r{k} AS (SELECT i, {step.format('c')} AS c FROM r{k - 1})" for k in range(1, 9))
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    sql = [f"""WITH r0 AS (SELECT range AS i, range::BIGINT AS c FROM range(256)), {rounds},
tab AS (SELECT list(c ORDER BY i) AS t FROM r8),
raw AS (SELECT *, {enc('text')} AS e, {enc(low)} AS e2, doc_id::VARCHAR AS s FROM documents),
crc AS (SELECT raw.*, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(s, ''),
  lambda x: ascii(x)::BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a // 256)), 4294967295) AS k FROM raw, tab),
l0 AS (SELECT doc_id, coalesce('=' || source, '') AS g, sha256(e) AS h,
  CASE WHEN k % 5 = 0 THEN sha256(e2) ELSE sha256(e) END AS f FROM crc),
f0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, '' AS proof FROM l0),
n0 AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM f0)"""]

    def tree(node, fold, key, k):
        sql.append(f"""{node}{k} AS (SELECT {key}, i // {fanout} AS i, list(h ORDER BY i) AS kids, any_value(n) AS m,
  CASE WHEN any_value(n) > 1 THEN sha256(array_to_string(list(h ORDER BY i), '')) ELSE any_value(h) END AS h,
  (any_value(n) + {fanout - 1}) // {fanout} AS n FROM {node}{k - 1} GROUP BY {key}, i // {fanout})""")
        sql.append(f"""{fold}{k} AS (SELECT a.* EXCLUDE (i, f, proof), a.i // {fanout} AS i,
  CASE WHEN m > 1 THEN sha256(array_to_string(kids[1:a.i % {fanout}], '') || f ||
    array_to_string(kids[a.i % {fanout} + 2:], '')) ELSE f END AS f,
  CASE WHEN m > 1 THEN proof || array_to_string(kids[1:a.i % {fanout}], '') ||
    array_to_string(kids[a.i % {fanout} + 2:], '') ELSE proof END AS proof
  FROM {fold}{k - 1} a JOIN {node}{k} b ON a.{key} = b.{key} AND a.i // {fanout} = b.i)""")

    for k in range(1, levels + 1):
        tree("n", "f", "g", k)
    sql.append(f"u AS (SELECT 1 AS one, g, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n FROM n{levels})")
    sql.append("t0 AS (SELECT one, i, h, n FROM u)")
    sql.append(f"s0 AS (SELECT a.doc_id, a.h AS leaf, u.h AS subroot, 1 AS one, u.i, a.f, a.proof FROM f{levels} a JOIN u USING (g))")
    for k in range(1, top + 1):
        tree("t", "s", "one", k)
    return ",\n".join(sql) + f"""
SELECT doc_id, leaf, subroot, t{top}.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t{top}.h AS verified
FROM s{top}, t{top}"""


ORACLE_SQL = _oracle()
