"""Merkle manifest of a dataset: a hash tree a group, a tree over the groups, and a proof for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored, table

#: Children of a node.
FANOUT = 8
#: Levels that are made in one task; a block has FANOUT ** LEVELS nodes at most.
LEVELS = 4
#: Bytes of a node: a SHA-256 as lowercase hex.
WIDTH = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields one after another: `-` for null, else the count of UTF-8 bytes, `:` and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def height(n: int, fanout: int = FANOUT) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


class Block:
    """The nodes of one aligned block: a contiguous matrix of digests a level, a row of WIDTH bytes a node.

    Reshaped by the fanout a row is a run, whose hash is a node of the next level; where siblings stand follows from the
    number of the leaf alone."""

    def __init__(self, leaves: list[str], levels: int, fanout: int = FANOUT):
        self.fanout, self.n = fanout, len(leaves)
        self.levels = [self._matrix(leaves)]
        for _ in range(levels):
            below = self.levels[-1]
            whole = len(below) - len(below) % fanout
            runs = [*below[:whole].reshape(-1, fanout * WIDTH), *([below[whole:].reshape(-1)] if whole < len(below) else [])]
            self.levels.append(self._matrix([hashlib.sha256(r).hexdigest() for r in runs]))

    @staticmethod
    def _matrix(digests: list[str]) -> np.ndarray:
        return np.frombuffer("".join(digests).encode("ascii"), np.uint8).reshape(-1, WIDTH)

    def root(self) -> str:
        return self.levels[-1].tobytes().decode("ascii")

    def ways(self) -> Iterator[list[tuple[memoryview, memoryview]]]:
        """Of each leaf, level by level, the bytes that stand in its run before it and behind it."""
        bounds, node = [], np.arange(self.n)
        for level in self.levels[:-1]:
            start = node - node % self.fanout
            end = np.minimum(start + self.fanout, len(level))
            bounds.append((memoryview(level.reshape(-1)), (np.stack([start, node, node + 1, end], 1) * WIDTH).tolist()))
            node = node // self.fanout
        for i in range(self.n):
            yield [(row[at[i][0] : at[i][1]], row[at[i][2] : at[i][3]]) for row, at in bounds]


def _indexed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with ``g``) with ``pos``, their place from 0 within ``g`` in the order of the columns ``order`` (all of them named),
    and ``n``, the rows of ``g``. Rows are dealt by ranges and counted a range, so a group of any size is many tasks; equal
    rows are dealt by where they were read."""
    keys = ["g", *order, "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    dealt = stored(dealt.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}))
    runs = dealt.groupBy("g", "part").agg(F.count("*").alias("here"), F.min("seq").alias("first"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("g", "part", "first", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"), F.sum("here").over(Window.partitionBy("g")).alias("n"))
    return dealt.join(runs, ["g", "part"]).withColumn("pos", F.col("before") + F.col("seq") - F.col("first")).drop("part", "seq", "first", "before")


def _climb(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """From nodes (g, n, pos, digest, ...): the tables of nodes at every LEVELS levels, from the leaves up, and (g, digest) of the roots.

    One row of a block goes to the next table, so each is smaller by FANOUT ** LEVELS; the driver learns only the largest n."""
    size = fanout**LEVELS
    tables = [nodes]
    left = nodes.agg(F.max("n")).first()[0] or 0
    while left > 1:

        def up(block: pd.DataFrame) -> pd.DataFrame:
            block = block.sort_values("pos")
            made = Block(block["digest"].tolist(), min(LEVELS, height(int(block["n"].iloc[0]), fanout)), fanout)
            return pd.DataFrame({"g": block["g"].iloc[:1], "n": -(-block["n"].iloc[:1] // size), "pos": block["pos"].iloc[:1] // size, "digest": [made.root()]})

        at = tables[-1].select("g", "n", "pos", "digest", F.floor(F.col("pos") / size).alias("block"))
        tables.append(stored(at.groupBy("g", "block").applyInPandas(up, "g string, n long, pos long, digest string")))
        left = -(-left // size)
    return tables, tables[-1].where("pos = 0").select("g", "digest")


#: Above a block: the siblings before and behind, level by level up to the root, and the roots that stand there.
PATH = "path array<struct<a:string,b:string>>, subroot string, root string"


def _by_block(make: Callable, levels: int, fanout: int) -> Callable:
    def down(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos").reset_index(drop=True)
        block = Block(nodes["digest"].tolist(), min(levels, height(int(nodes["n"].iloc[0]), fanout)), fanout)
        return make(nodes, block, above.iloc[0])

    return down


def _descend(tables: list[DataFrame], tops: DataFrame, fanout: int, finish: Callable, schema: str) -> DataFrame:
    """From what stands above each root (g, PATH) down to the leaves: ``finish(leaves, block, above)`` makes the frame, of
    ``schema``, for a block of leaves. What stands above a block is sent once a block, not once a row."""
    size = fanout**LEVELS

    def inner(nodes: pd.DataFrame, block: Block, above: pd.Series) -> pd.DataFrame:
        own = [[{"a": str(a, "ascii"), "b": str(b, "ascii")} for a, b in way] for way in block.ways()]
        return pd.DataFrame({"g": nodes["g"], "block": nodes["pos"], "path": [[*x, *above["path"]] for x in own], "subroot": above["subroot"], "root": above["root"]})

    paths = tops.withColumn("block", F.lit(0).cast("long"))
    for depth in reversed(range(max(1, len(tables) - 1))):
        make, kinds = (finish, schema) if depth == 0 else (inner, f"g string, block long, {PATH}")
        nodes = tables[depth].withColumn("block", F.floor(F.col("pos") / size))
        above = paths.select(F.col("g").alias("over"), F.col("block").alias("at"), "path", "subroot", "root")  # names of their own: both may come of one table
        made = nodes.groupBy("g", "block").cogroup(above.groupBy("over", "at")).applyInPandas(_by_block(make, LEVELS, fanout), kinds)
        paths = made if depth == 0 else stored(made)
    return paths


def manifest(docs: DataFrame, key: str, group: str, leaf: Column, altered: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """A row a row of ``docs``: ``key``, leaf, subroot, root, proof_sha256, folded_root, verified.

    Within a ``group`` (null is one) leaves ascend by ``key``, nulls first, equal ones by their digest. While more than one
    node is left, every ``fanout`` consecutive ones become the digest of their joined hex; the last run may be shorter. The
    subroots, in the byte order of their group with null first, are made one root likewise. proof_sha256 is the digest of all
    siblings on the way up. folded_root goes up from ``altered`` (null: from the leaf) by the stored siblings; verified
    tells whether that is the root. Repeated rows are leaves of their own, an empty table gives no rows, and other
    columns, of any name, are not looked at."""
    name, kind = "k", docs.select(key).schema[0].dataType.simpleString()
    rows = docs.select(
        F.coalesce(F.concat(F.lit("."), F.col(group).cast("string")), F.lit("")).alias("g"),
        F.col(key).alias(name), leaf.alias("digest"), (altered if altered is not None else F.lit(None)).cast("string").alias("altered"),
    )
    leaves, subroots = _climb(_indexed(rows, [name, "digest"]), fanout)
    groups, roots = _climb(_indexed(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), ["name"]), fanout)

    def of_group(nodes: pd.DataFrame, block: Block, above: pd.Series) -> pd.DataFrame:
        own = [[{"a": str(a, "ascii"), "b": str(b, "ascii")} for a, b in way] for way in block.ways()]
        return pd.DataFrame({"g": nodes["name"], "path": [[*x, *above["path"]] for x in own], "subroot": nodes["digest"], "root": above["root"]})

    def of_leaf(nodes: pd.DataFrame, block: Block, above: pd.Series) -> pd.DataFrame:
        higher = [(x["a"].encode("ascii"), x["b"].encode("ascii")) for x in above["path"]]
        proofs, folded = [], []
        for way, digest, other in zip(block.ways(), nodes["digest"], nodes["altered"], strict=True):
            proof, node = hashlib.sha256(), (other or digest).encode("ascii")
            for a, b in [*way, *higher]:
                proof.update(a)
                proof.update(b)
                node = hashlib.sha256(b"".join((a, node, b))).hexdigest().encode("ascii")
            proofs.append(proof.hexdigest())
            folded.append(node.decode("ascii"))
        made = nodes[[name]].assign(leaf=nodes["digest"], subroot=above["subroot"], root=above["root"], proof_sha256=proofs, folded_root=folded)
        return made.assign(verified=made["folded_root"] == made["root"])

    tops = roots.select("g", F.array().cast("array<struct<a:string,b:string>>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    over = stored(_descend(groups, tops, fanout, of_group, f"g string, {PATH}"))
    made = _descend(leaves, over, fanout, of_leaf, f"{name} {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return made.withColumnRenamed(name, key)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    altered = F.when(touched, leaf_digest(*fields[:4], F.translate("text", UPPER, LOWER)))
    return manifest(docs, "doc_id", "lang", leaf_digest(*fields), altered)


ORACLE = """
WITH RECURSIVE
crc AS (
  SELECT DISTINCT doc_id, list_reduce(
      list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
      lambda s, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END, xor(s, b)),
      4294967295::BIGINT) AS c
  FROM documents
),
field AS (
  SELECT d.*, coalesce(xor(c, 4294967295::BIGINT) % 3 = 0, false) AS touched,
    coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    strlen(text) || ':' AS sized
  FROM documents d LEFT JOIN crc ON crc.doc_id IS NOT DISTINCT FROM d.doc_id
),
digests AS (
  SELECT doc_id, coalesce('.' || lang, '') AS g, sha256(head || coalesce(sized || text, '-')) AS leaf,
    sha256(head || coalesce(sized || CASE WHEN touched THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS altered
  FROM field
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM digests
),
nodes AS (
  SELECT g, 0 AS lvl, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT g, lvl + 1, i // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY g, lvl, i // 8
),
subroots AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, i, n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY lvl, i // 8
),
beside AS (
  SELECT g, lvl, i, coalesce(string_agg(h, '') OVER (PARTITION BY g, lvl, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(h, '') OVER (PARTITION BY g, lvl, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM nodes WHERE n > 1
),
above AS (
  SELECT lvl, i, coalesce(string_agg(h, '') OVER (PARTITION BY lvl, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(h, '') OVER (PARTITION BY lvl, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM tops WHERE n > 1
),
low AS (
  SELECT x.g, x.i, list({'a': y.a, 'b': y.b} ORDER BY y.lvl) FILTER (y.g IS NOT NULL) AS path
  FROM leaves x LEFT JOIN beside y ON y.g = x.g AND y.i = x.i // (8 ** y.lvl)::BIGINT GROUP BY x.g, x.i
),
high AS (
  SELECT x.g, x.h AS subroot, list({'a': y.a, 'b': y.b} ORDER BY y.lvl) FILTER (y.i IS NOT NULL) AS path
  FROM subroots x LEFT JOIN above y ON y.i = x.i // (8 ** y.lvl)::BIGINT GROUP BY x.g, x.h
),
made AS (
  SELECT l.doc_id, l.leaf, l.altered, h.subroot, (SELECT h FROM tops WHERE n = 1) AS root, list_concat(coalesce(p.path, []), coalesce(h.path, [])) AS path
  FROM leaves l JOIN low p ON p.g = l.g AND p.i = l.i JOIN high h ON h.g = l.g
),
folded AS (
  SELECT *, sha256(array_to_string(list_transform(path, lambda x: x.a || x.b), '')) AS proof_sha256,
    (list_reduce(list_prepend({'a': '', 'b': altered}, path), lambda x, y: {'a': '', 'b': sha256(y.a || x.b || y.b)})).b AS folded_root
  FROM made
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
