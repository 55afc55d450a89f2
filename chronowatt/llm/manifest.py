"""Merkle manifest of a dataset: leaves by language, runs of eight, and versions by path copying.

A row's leaf is the digest of its fields. Per language the leaves stand in order of doc_id; eight consecutive nodes
become one, the digest of their digests, until one is left: the language's subroot. The subroots, ordered by
language, become the root in the same way.

The tree is kept in aligned blocks of BLOCK = 8**4 nodes of one language. The blocks of the leaves are grouped by
(language, block) and yield one node each; these nodes are blocked again, and so on, so no task holds more than one
block and no language is gathered. Places of leaves come from a sort by ranges: place within the range plus the
counts of the ranges before.

The tree is persistent. Another digest at a leaf makes a version that shares all nodes but the leaf's ancestors: the
block copies its ancestors up to the block's node, and the version goes on in the copied ancestors of the upper
blocks, for which the block brings along the path above it (one row per block). Versions of a block are made in the
task that holds the block, however many there are, and never meet in one place.

Null fields have a mark of their own; null languages come first, null ids first within a language, an empty text
is not a null one. Repeated ids are leaves side by side in order of their digests, repeated rows likewise; each row
has its result. An empty table has no root and no rows. Very long texts are hashed where they are read, only
digests travel. Columns other than doc_id, source, lang, n_chars and text are not covered and may have any name.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Scratch, rest, ship_code, table

RUN = 8
BLOCK = RUN**4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """Digest of the fields of a row, some of them changed."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]).cast("binary"), 256)


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Block:
    """Up to BLOCK consecutive nodes and all nodes above them up to the block's own, in ``height`` levels."""

    def __init__(self, nodes: list[str], height: int):
        self.levels = [nodes]
        for _ in range(height):
            last = self.levels[-1]
            self.levels.append([digest(last[i : i + RUN]) for i in range(0, len(last), RUN)])
        self.top = self.levels[-1][0]

    def path(self, at: int) -> list[tuple[int, list[str]]]:
        """From the node up: its place in its run, and the others of the run."""
        found = []
        for nodes in self.levels[:-1]:
            run = nodes[at - at % RUN :][:RUN]
            found.append((at % RUN, run[: at % RUN] + run[at % RUN + 1 :]))
            at //= RUN
        return found


def version(node: str, path: list[tuple[int, list[str]]]) -> list[str]:
    """The nodes that another version has of its own: the changed node and a copy of each ancestor."""
    own = [node]
    for place, others in path:
        own.append(digest([*others[:place], own[-1], *others[place:]]))
    return own


def height(nodes: int, block: int = BLOCK) -> int:
    """Levels above so many nodes, within one block."""
    levels, nodes = 0, min(nodes, block)
    while nodes > 1:
        levels, nodes = levels + 1, -(-nodes // RUN)
    return levels


def placed(nodes: DataFrame, key: list[str], order: list[str], scratch: Scratch) -> DataFrame:
    """nodes with ``at``, their number from 0 among those of one key in the given order, and ``n``, how many the key has.
    Sorted by ranges over all keys, so that a key of any size is spread."""
    ranged = nodes.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    # partition number and place in the partition in one
    ranged = scratch.keep(ranged.withColumn("__id", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__part", F.shiftright("__id", 33))
    sizes = ranged.groupBy(*key, "__part").agg(F.min("__id").alias("__first"), F.count("*").alias("__size"))
    # one row for each range of a key
    own = Window.partitionBy(*key)
    before = F.sum("__size").over(own.orderBy("__part")) - F.col("__size")
    sizes = sizes.withColumn("__before", before).withColumn("n", F.sum("__size").over(own)).drop("__size")
    at = F.col("__id") - F.col("__first") + F.col("__before")
    return ranged.join(sizes, [*key, "__part"]).withColumn("at", at).drop("__id", "__part", "__first", "__before")


_PATH = "array<struct<place: int, others: array<string>>>"
_PATH_TYPE = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))
_KEY = ["known", "name"]
_KEY_TYPE = "known boolean, name string"


def _block_of(rows: pa.Table, block: int) -> tuple[Block, pa.Table]:
    rows = rows.sort_by("at")
    return Block(rows["digest"].to_pylist(), height(rows["n"][0].as_py(), block)), rows


def tops(nodes: DataFrame, size: int = BLOCK) -> DataFrame:
    """The nodes above each block: known, name, at (number of the block), n (blocks of the key), digest."""

    def run(rows: pa.Table) -> pa.Table:
        block, rows = _block_of(rows, size)
        one = rows.slice(0, 1)
        n = -(-one["n"][0].as_py() // size)
        return pa.table(
            {"known": one["known"], "name": one["name"], "at": one["block"], "n": pa.array([n]), "digest": pa.array([block.top])}
        )

    schema = f"{_KEY_TYPE}, at bigint, n bigint, digest string"
    return _blocked(nodes, size).groupBy(*_KEY, "block").applyInArrow(run, schema)


def _blocked(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("at") / size).cast("bigint"))


def paths(nodes: DataFrame, scratch: Scratch, size: int = BLOCK) -> DataFrame:
    """nodes (known, name, at, n, digest) with path, from each to the only node left of its key, which is ``top``."""

    def run(rows: pa.Table) -> pa.Table:
        block, rows = _block_of(rows, size)
        found = [[{"place": p, "others": o} for p, o in block.path(i)] for i in range(rows.num_rows)]
        return rows.select([*_KEY, "at", "n", "digest", "block"]).append_column("path", pa.array(found, _PATH_TYPE)).append_column(
            "top", pa.array([block.top] * rows.num_rows)
        )

    schema = f"{_KEY_TYPE}, at bigint, n bigint, digest string, block bigint, path {_PATH}, top string"
    inner = _blocked(nodes, size).groupBy(*_KEY, "block").applyInArrow(run, schema)
    if (nodes.agg(F.max("n")).first()[0] or 0) <= size:
        return inner.drop("block")
    upper = paths(scratch.keep(tops(nodes, size)), scratch, size).select(
        *_KEY, F.col("at").alias("block"), F.col("path").alias("above"), F.col("top").alias("upmost")
    )
    joined = inner.join(upper, [*_KEY, "block"])
    return joined.withColumn("path", F.concat("path", "above")).withColumn("top", F.col("upmost")).drop("block", "above", "upmost")


def subroots(leaves: DataFrame, scratch: Scratch, size: int = BLOCK) -> DataFrame:
    """For each block of leaves: known, name, block, path (from the block's node to the root), subroot, root."""
    blocks = scratch.keep(paths(scratch.keep(tops(leaves, size)), scratch, size))
    names = blocks.select(*[F.col(c).alias(f"of_{c}") for c in _KEY], F.col("top").alias("digest")).distinct()
    # all languages are nodes of one key
    langs = placed(names.select(F.lit(True).alias("known"), F.lit("").alias("name"), "*"), _KEY, ["of_known", "of_name"], scratch)
    above = paths(langs.select(*_KEY, "at", "n", "digest"), scratch, size).select("at", F.col("path").alias("above"), F.col("top").alias("root"))
    langs = langs.select(*[F.col(f"of_{c}").alias(c) for c in _KEY], "at").join(above, "at").drop("at")
    return blocks.join(langs, _KEY).select(
        *_KEY, F.col("at").alias("block"), F.concat("path", "above").alias("path"), F.col("top").alias("subroot"), "root"
    )


def manifest(docs: DataFrame, changed: Column, scratch: Scratch, nodes: bool = False, size: int = BLOCK) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (of the siblings from the leaf to the root) of every row; and folded_root,
    the root of the version in which ``changed`` (a digest, or null for none) stands in the leaf's place. With
    ``nodes`` also proof (the siblings, level by level) and own (the version's nodes that it does not share). ``size`` is
    that of the blocks, a power of RUN."""
    ship_code(docs.sparkSession)
    key = [F.col("lang").isNotNull().alias("known"), F.coalesce("lang", F.lit("")).alias("name")]
    leaves = docs.select(F.col("doc_id").cast("bigint"), *key, leaf().alias("digest"), changed.alias("changed"))
    leaves = scratch.keep(placed(leaves, _KEY, ["doc_id", "digest", "changed"], scratch))
    above = scratch.keep(subroots(leaves, scratch, size))

    def run(rows: pa.Table, up: pa.Table) -> pa.Table:
        block, rows = _block_of(rows, size)
        (upper,) = up.to_pylist()
        top = [(p["place"], p["others"]) for p in upper["path"]]
        columns = {"proof_sha256": [], "folded_root": [], "proof": [], "own": []}
        for i, (digest_, other) in enumerate(zip(rows["digest"].to_pylist(), rows["changed"].to_pylist())):
            path = block.path(i) + top
            own = version(other if other is not None else digest_, path)
            columns["proof_sha256"].append(digest([o for _, others in path for o in others]))
            columns["folded_root"].append(own[-1])
            if nodes:
                columns["proof"].append([others for _, others in path])
                columns["own"].append(own)
        out = {"doc_id": rows["doc_id"], "leaf": rows["digest"]}
        out |= {c: pa.array([upper[c]] * rows.num_rows, pa.string()) for c in ("subroot", "root")}
        out |= {c: pa.array(columns[c], pa.string()) for c in ("proof_sha256", "folded_root")}
        if nodes:
            out["proof"] = pa.array(columns["proof"], pa.list_(pa.list_(pa.string())))
            out["own"] = pa.array(columns["own"], pa.list_(pa.string()))
        return pa.table(out)

    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    schema += ", proof array<array<string>>, own array<string>" * nodes
    pairs = _blocked(leaves, size).groupBy(*_KEY, "block").cogroup(above.groupBy(*_KEY, "block"))
    return pairs.applyInArrow(run, schema)


def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every document; a third of the documents is
    tampered with after the manifest was made."""
    scratch = Scratch(spark, "manifest")
    tampered = F.when(rest("doc_id", 3) == 0, leaf(text=F.translate("text", _UPPER, _LOWER)))
    found = manifest(table(spark, sf, "documents"), tampered, scratch)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 7, upper: int = 3) -> str:
    """The same tree, one level after the other."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    low = f"translate(text, '{_UPPER}', '{_LOWER}')"
    steps = "flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"""xor(4294967295, list_reduce([4294967295::BIGINT] || {steps},
    lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"""
    out = [f"""WITH leaves AS (SELECT row_number() OVER () AS row, doc_id, coalesce('+' || lang, '') AS k,
  sha256({" || ".join(part(c) for c in FIELDS)}) AS leaf,
  sha256({" || ".join(part(low if c == "text" else c) for c in FIELDS)}) AS other, {crc} % 3 = 0 AS hit FROM documents)""",
           "n0 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS d FROM leaves)",
           "f0 AS (SELECT row, k, i, CASE WHEN hit THEN other ELSE leaf END AS f, '' AS proof FROM n0)"]

    def climb(node: str, fold: str, count: int) -> None:
        for j in range(count):
            a, b = f"{node}{j}", f"{node}{j + 1}"
            # a key with one node left keeps it
            out.append(f"""{b} AS (SELECT k, CASE WHEN many THEN i // 8 ELSE i END AS i,
  CASE WHEN any_value(many) THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d
  FROM (SELECT *, count(*) OVER (PARTITION BY k) > 1 AS many FROM {a}) GROUP BY k, CASE WHEN many THEN i // 8 ELSE i END)""")
            out.append(f"""{fold}{j + 1} AS (SELECT s.row, s.k, s.i // 8 AS i,
  CASE WHEN any_value(n.many) THEN sha256(string_agg(CASE WHEN n.i = s.i THEN f ELSE d END, '' ORDER BY n.i)) ELSE any_value(f) END AS f,
  any_value(proof) || coalesce(string_agg(d, '' ORDER BY n.i) FILTER (WHERE n.i <> s.i), '') AS proof
  FROM {fold}{j} s JOIN (SELECT k, i, d, count(*) OVER (PARTITION BY k) > 1 AS many FROM {a}) n ON n.k = s.k AND n.i // 8 = s.i // 8
  GROUP BY s.row, s.k, s.i)""")

    climb("n", "f", levels)
    out.append(f"m0 AS (SELECT k AS lang, 'all' AS k, row_number() OVER (ORDER BY k) - 1 AS i, d FROM n{levels})")
    out.append(f"g0 AS (SELECT row, 'all' AS k, m0.i, f, proof FROM f{levels} s JOIN m0 ON m0.lang = s.k)")
    climb("m", "g", upper)
    return ",\n".join(out) + f"""
SELECT l.doc_id, l.leaf, m0.d AS subroot, r.d AS root, sha256(g.proof) AS proof_sha256, g.f AS folded_root, g.f = r.d AS verified
FROM leaves l JOIN g{upper} g USING (row) JOIN m0 ON m0.lang = l.k CROSS JOIN m{upper} r"""


OP12_SQL = _sql()
