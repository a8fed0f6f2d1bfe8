"""A Merkle manifest of a table: a DAG of digests, and proofs by descent.

A row's leaf is the SHA-256 of its fields.  The leaves of a source ascend by
id; every ``FAN`` consecutive nodes (the last run may be shorter) become the
digest of their hexadecimal digests, until one is left, the source's subroot;
the subroots, ordered by source, give the root in the same way.

Records of ``digest -> children`` are kept by digest: equal subtrees have one
record.  A record holds the nodes of ``LEVELS`` levels, a segment, so that one
join serves as many steps.  Leaf requests descend from the root by the digits
of their ranks; requests that still share their path go as one, so that no
digest meets all requests.  A step appends the unselected children to the
path; the path read backwards is the proof from the leaf up.

Rows: a null field counts as ``-``; a null source is a source of its own,
first of all, and null ids come first in their source; rows of equal id are
ordered by leaf, so equal rows are alike.  Texts of any length are hashed in
the JVM and aren't moved.  An empty table has no root and no rows.  Only the named
columns are read, so others may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tessera.llm import ranks, shared

FAN = 3
#: Levels of a segment: a record holds up to FAN ** LEVELS members.
LEVELS = 4
SPAN = FAN ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _parent(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (binary) of fields, each with its length in bytes."""
    parts = []
    for field in fields:
        body = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(body).cast("string"), F.lit(":"), body), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def segment(members: list[bytes], whole: bool) -> tuple[bytes, int, list[bytes], list[list[bytes]]]:
    """Top digest, height and records of consecutive members: all levels of a
    segment, or (``whole``: there are no others) up to the single node."""
    height, nodes, parents, children = 0, members, [], []
    while height < LEVELS and (len(nodes) > 1 or not whole):
        runs = [nodes[i:i + FAN] for i in range(0, len(nodes), FAN)]
        nodes = [_parent(run) for run in runs]
        parents += nodes
        children += runs
        height += 1
    return nodes[0], height, parents, children


def descend(top: bytes, height: int, parents: list[bytes], children: list[bytes], path: list[bytes]) -> Iterator[tuple[bytes, list[bytes]]]:
    """The members below ``top`` in order of rank, each with its path: for
    each level the place of the selected child and the others' digests."""
    record = dict(zip(parents, children, strict=True))
    front = [(top, path)]
    for _ in range(height):
        following = []
        for digest, way in front:
            run = record[digest]
            for digit in range(len(run) // 32):
                rest = run[:32 * digit] + run[32 * digit + 32:]
                following.append((run[32 * digit:32 * digit + 32], [*way, bytes([digit]) + rest]))
        front = following
    yield from front


def proof_digest(path: list[bytes]) -> str:
    """SHA-256 of the siblings' hexadecimal digests from the leaf up."""
    return hashlib.sha256("".join(step[1:].hex() for step in reversed(path)).encode()).hexdigest()


def fold(leaf: bytes, path: list[bytes]) -> bytes:
    """The root that a leaf gives with the siblings of a path."""
    for step in reversed(path):
        rest, at = step[1:], 32 * step[0]
        leaf = hashlib.sha256((rest[:at].hex() + leaf.hex() + rest[at:].hex()).encode()).digest()
    return leaf


_SEGMENTS = "tree string, block long, digest binary, height int, parents array<binary>, children array<binary>"
_REQUESTS = "tree string, rank long, digest binary, subroot binary, path array<binary>"


def _segments(nodes: DataFrame, name: str) -> DataFrame:
    """Segments of the nodes (tree, rank, digest)."""
    schema = _parse_datatype_string(_SEGMENTS)
    placed = (nodes.select("tree", (F.col("rank") / SPAN).cast("long").alias("block"), "rank", "digest")
              .repartition("tree", "block").sortWithinPartitions("tree", "block", "rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, current, members = to_arrow_schema(schema), None, []

        def closed() -> dict:
            # A first segment that isn't full is the whole tree; of a full one
            # the same levels are made whether or not others follow.
            top, height, parents, children = segment(members, current[1] == 0)
            return {"tree": current[0], "block": current[1], "digest": top, "height": height, "parents": parents,
                    "children": [b"".join(c) for c in children]}

        for batch in batches:
            out = []
            for key in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "digest")), strict=True):
                if key[:2] != current:
                    if members:
                        out.append(closed())
                    current, members = key[:2], []
                members.append(key[2])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if members:
            yield pa.RecordBatch.from_pylist([closed()], schema=arrow)

    return shared.written(shared.map_arrow(placed, run, schema), name)


def _grown(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Rounds of segments from the nodes up to one node for each tree."""
    rounds = []
    while True:
        made = _segments(nodes, f"{name}-{len(rounds)}")
        rounds.append(made)
        if made.filter("block > 0").isEmpty():
            return rounds
        nodes = made.select("tree", F.col("block").alias("rank"), "digest")


def _records(round_: DataFrame) -> DataFrame:
    """Records by digest: of equal subtrees, one."""
    return round_.select("digest", "height", "parents", "children").dropDuplicates(["digest"])


def _down(requests: DataFrame, round_: DataFrame) -> DataFrame:
    """The requests of the members below the requested digests."""
    schema = _parse_datatype_string(_REQUESTS)
    met = requests.join(_records(round_), "digest").select(*requests.columns, "height", "parents", "children")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for row in batch.to_pylist():
                found = descend(row["digest"], row["height"], row["parents"], row["children"], row["path"])
                yield pa.RecordBatch.from_pylist(
                    [{"tree": row["tree"], "rank": row["rank"] * SPAN + place, "digest": digest, "subroot": row["subroot"], "path": path}
                     for place, (digest, path) in enumerate(found)], schema=arrow)

    return shared.map_arrow(met, run, schema)


@dataclass
class Manifest:
    """``leaves`` (tree, rank, digest and the columns that came with them),
    the rounds of segments of the sources' trees and of the tree above, the
    subroots (tree, rank, digest) and the root (None if there is no row)."""

    leaves: DataFrame
    rounds: list[DataFrame]
    upper: list[DataFrame]
    subroots: DataFrame
    root: bytes | None

    def records(self) -> DataFrame:
        """The stored ``digest -> children`` records, one for each digest."""
        every = None
        for round_ in [*self.rounds, *self.upper]:
            pairs = round_.select(F.explode(F.arrays_zip("parents", "children")).alias("x")).select("x.parents", "x.children")
            every = pairs if every is None else every.unionByName(pairs)
        return every.toDF("digest", "children").dropDuplicates(["digest"])


def build(rows: DataFrame, source: str, order: list[str], digest: str) -> Manifest:
    """The manifest of rows with a digest, a tree for each ``source``."""
    tree = F.coalesce(F.concat(F.lit("1"), F.col(f"`{source}`").cast("string")), F.lit("0"))
    named = rows.withColumn("tree", tree).withColumnRenamed(digest, "digest")
    leaves = shared.written(ranks.ranked(shared.written(named, "leaves"), "tree", [*order, "digest"]), "ranked-leaves")
    rounds = _grown(leaves, "segments")
    tops = rounds[-1].select(F.lit("").alias("all"), "tree", "digest")
    subroots = shared.written(ranks.ranked(tops, "all", ["tree"]), "subroots")
    upper = _grown(subroots.select(F.col("all").alias("tree"), "rank", "digest"), "upper")
    root = upper[-1].select("digest").head()
    return Manifest(leaves, rounds, upper, subroots, bytes(root["digest"]) if root else None)


def requests(manifest: Manifest) -> DataFrame:
    """Requests for all lowest segments (tree, rank, digest, subroot, path)."""
    spark = manifest.leaves.sparkSession
    schema = _parse_datatype_string(_REQUESTS)
    found = spark.createDataFrame([("", 0, manifest.root, None, [])] if manifest.root else [], schema)
    for round_ in reversed(manifest.upper):
        found = shared.written(_down(found, round_), "requests")
    found = (found.select("rank", "path").join(manifest.subroots.select("rank", "tree", "digest"), "rank")
             .select("tree", F.lit(0).cast("long").alias("rank"), "digest", F.col("digest").alias("subroot"), "path"))
    for round_ in reversed(manifest.rounds[1:]):
        found = shared.written(_down(found, round_), "requests")
    return found


def prove(manifest: Manifest, key: str, claimed: str) -> DataFrame:
    """For every leaf ``key``, ``leaf``, ``subroot``, ``root``,
    ``proof_sha256``, ``folded_root`` (what the digest ``claimed``, or else
    the leaf, gives with the proof's siblings) and ``verified``."""
    heads = (requests(manifest).join(_records(manifest.rounds[0]), "digest")
             .select("tree", F.col("rank").alias("block"), F.lit(-1).cast("long").alias("rank"), "digest", "subroot", "path",
                     "height", "parents", "children"))
    rows = manifest.leaves.select("tree", (F.col("rank") / SPAN).cast("long").alias("block"), "rank", "digest", key, claimed)
    dealt = (heads.unionByName(rows, allowMissingColumns=True).repartition("tree", "block")
             .sortWithinPartitions("tree", "block", "rank"))
    schema = _parse_datatype_string(f"`{key}` {manifest.leaves.schema[key].dataType.simpleString()}, leaf string, subroot string, "
                                    "root string, proof_sha256 string, folded_root string, verified boolean")
    root = manifest.root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, subroot, found = to_arrow_schema(schema), None, iter(())
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["rank"] < 0:
                    subroot = row["subroot"].hex()
                    found = descend(row["digest"], row["height"], row["parents"], row["children"], row["path"])
                    continue
                digest, path = next(found)
                if digest != row["digest"]:
                    raise ValueError(f"the manifest's leaf {digest.hex()} isn't that of the row")
                folded = fold(row[claimed] or digest, path)
                out.append({key: row[key], "leaf": digest.hex(), "subroot": subroot, "root": root.hex(),
                            "proof_sha256": proof_digest(path), "folded_root": folded.hex(), "verified": folded == root})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return shared.map_arrow(dealt, run, schema)


def document_leaves(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` and ``leaf`` of the documents, and ``altered``:
    the leaf without the text's line feeds, for the even crc32 of the id."""
    plain = docs.select(*(F.col(f"`{name}`") for name in FIELDS))
    own = {name: F.col(name) for name in FIELDS}
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = own | {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}
    tampered = F.when(even & F.contains(F.col("text"), F.lit("\n")), leaf_digest([*cut.values()]))
    return plain.select("doc_id", "source", leaf_digest([*own.values()]).alias("leaf"), tampered.alias("altered"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and check of every document against the manifest's root."""
    leaves = document_leaves(shared.read_table(spark, sf_dir, "documents"))
    return prove(build(leaves, "source", ["doc_id"], "leaf"), "doc_id", "altered")


#: The same level by level.
ORACLE = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, source, text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') ||
    coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') ||
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
    list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(ascii(c) AS BIGINT) for c in string_split(CAST(doc_id AS VARCHAR), '')],
      lambda r, c: list_reduce([xor(r, c), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    -- The checksum is the complement, so it is even where this is odd.
    CASE WHEN crc % 2 = 1 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS altered
  FROM fields
), nodes AS (
  SELECT source, 0 AS level, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL
  SELECT source, level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (any_value(n) + 2) // 3
  FROM nodes WHERE n > 1 GROUP BY source, level, i // 3
), tops AS (
  SELECT source, level AS height, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, place AS i, subroot AS digest, (SELECT count(*) FROM tops) AS n FROM tops
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (any_value(n) + 2) // 3
  FROM upper WHERE n > 1 GROUP BY level, i // 3
), runs AS (
  SELECT place, t.height, level, i // 3 AS run, list(digest ORDER BY i) AS kids FROM nodes JOIN tops t
    ON nodes.source IS NOT DISTINCT FROM t.source WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT place, height, height + level, u.i // 3, list(u.digest ORDER BY u.i) FROM upper u, tops WHERE n > 1 GROUP BY ALL
), walks AS (
  SELECT l.doc_id, l.leaf, t.subroot, t.place, t.height, 0 AS level,
    row_number() OVER (PARTITION BY l.source ORDER BY l.doc_id NULLS FIRST, l.leaf) - 1 AS i, coalesce(altered, leaf) AS folded, '' AS proof
  FROM leaves l JOIN tops t ON l.source IS NOT DISTINCT FROM t.source
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.place, w.height, w.level + 1, w.at // 3,
    sha256(array_to_string(r.kids[:w.at % 3] || [w.folded] || r.kids[w.at % 3 + 2:], '')),
    w.proof || array_to_string(r.kids[:w.at % 3] || r.kids[w.at % 3 + 2:], '')
  FROM (SELECT *, CASE WHEN level = height THEN place ELSE i END AS at FROM walks) w
  JOIN runs r ON r.place = w.place AND r.level = w.level AND r.run = w.at // 3
)
SELECT doc_id, leaf, subroot, (SELECT digest FROM upper WHERE n = 1) AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
  folded = (SELECT digest FROM upper WHERE n = 1) AS verified
FROM walks WHERE level = height + (SELECT max(level) FROM upper)
"""
