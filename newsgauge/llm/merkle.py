"""Merkle manifest of a dataset: leaf digests, one tree a group, one tree over the groups, inclusion proofs.

A tree of known size is a sparse forest: a set of nodes keyed by level and index, with the
rule that a run of siblings becomes its parent as soon as all of it is there. How long a
run is follows from the size alone, so adding forests is associative: any grouping of the
fragments, in any order, ends in the same nodes.

Rows are sorted by range and cut into fragments of at most 65,536 rows, so neither a hot
group nor a large partition is one piece. Each fragment folds what it can and keeps its
unresolved nodes, a few a level at either end. These are reduced as a tree: ``FAN``
neighbouring fragments of a group meet in a task, fold what has become complete and pass on
what has not, until the root is left. Every round is a table in the shared folder, so
that the nodes across fragments, which proofs need, never pass through the driver.

On the way down a fragment gets the nodes of its two edges by an equi-join on (tree, level,
index), folds its own leaves again and writes each leaf's path. Only digests are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ARITY = 3
#: Fragments that meet in one task of a round of the reduction.
FAN = 16
#: Rows of a fragment as a power of two.
FRAGMENT_BITS = 16


def digest_of(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(*columns: Column) -> Column:
    """Lowercase hex SHA-256 of the columns: ``-`` for null, else length in UTF-8 bytes, a colon and the value."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def heights(n: int) -> list[int]:
    """Number of nodes at each level of a tree of n leaves, the last is 1."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


class Forest:
    """Nodes of one tree by level and index. ``fold`` makes every parent whose run is complete."""

    def __init__(self, n: int):
        self.sizes = heights(n)
        self.levels: list[dict[int, str]] = [{} for _ in self.sizes]
        self.open: list[set[int]] = [set() for _ in self.sizes]

    def add(self, level: int, index: int, digest: str, unresolved: bool = True) -> None:
        self.levels[level][index] = digest
        if unresolved:
            self.open[level].add(index)

    def run(self, level: int, index: int) -> range:
        """The indices of a node's siblings and its own."""
        first = index - index % ARITY
        return range(first, min(first + ARITY, self.sizes[level]))

    def fold(self) -> list[tuple[int, int]]:
        """Resolves what can be resolved; returns the nodes made."""
        made = []
        for level in range(len(self.sizes) - 1):
            nodes, unresolved = self.levels[level], self.open[level]
            for first in sorted({i - i % ARITY for i in unresolved}):
                own = self.run(level, first)
                if all(i in nodes for i in own):
                    unresolved.difference_update(own)
                    self.add(level + 1, first // ARITY, digest_of(*[nodes[i] for i in own]))
                    made.append((level + 1, first // ARITY))
        return made

    def path(self, index: int, level: int = 0) -> Iterator[tuple[str, str]]:
        """From a node to the root: the digests left and right of it in each run."""
        for at in range(level, len(self.sizes) - 1):
            nodes, own = self.levels[at], self.run(at, index)
            yield "".join(nodes[i] for i in own if i < index), "".join(nodes[i] for i in own if i > index)
            index //= ARITY


def folded(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its path give."""
    for left, right in path:
        digest = digest_of(left, digest, right)
    return digest


def _spans(leaves: DataFrame) -> DataFrame:
    """tree, frag, seq, first, m, n: where each fragment lies in its tree. leaves: tree, frag, pos, digest."""
    held = leaves.groupBy("tree", "frag").agg(F.count("*").alias("m"))
    order = Window.partitionBy("tree").orderBy("frag")  # a row for each fragment, not for each leaf
    before = F.coalesce(F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.select(
        "tree", "frag", "m", (F.row_number().over(order) - 1).cast("bigint").alias("seq"), before.alias("first"),
        F.sum("m").over(Window.partitionBy("tree")).alias("n"),
    )


NODE = "tree bigint, seq bigint, n bigint, level int, idx bigint, digest string, open boolean"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict], list[dict]]]:
    """Sorted rows as (span row, side rows, leaf rows) of one fragment of one tree after the other."""
    span, sides, leaves = None, [], []
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                if span is not None:
                    yield span, sides, leaves
                span, sides, leaves = row, [], []
            else:
                (sides if row["kind"] == 1 else leaves).append(row)
    if span is not None:
        yield span, sides, leaves


def _laid(*tables: DataFrame) -> DataFrame:
    """Rows of every fragment side by side: its span, its edge nodes, its leaves in order."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.repartition("frag", "tree").sortWithinPartitions("frag", "tree", "kind", "pos")


def _forest(leaves: DataFrame, spans: DataFrame) -> DataFrame:
    """NODE rows: unresolved nodes of every fragment and all nodes above them up to the root."""
    span_rows = spans.select("tree", "frag", "seq", "n", F.lit(0).alias("kind"), F.col("first").alias("pos"))
    leaf_rows = leaves.select("tree", "frag", F.lit(2).alias("kind"), "pos", "digest")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for span, _, own in _segments(batches):
            forest = Forest(span["n"])
            for k, row in enumerate(own):
                forest.add(0, span["pos"] + k, row["digest"])
            forest.fold()
            out = [
                (span["tree"], span["seq"], span["n"], level, i, forest.levels[level][i], True)
                for level, left in enumerate(forest.open)
                for i in sorted(left)
            ]
            yield pa.RecordBatch.from_pydict(dict(zip(NODE_NAMES, map(list, zip(*out, strict=True)), strict=True)), schema=NODE_ARROW)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        forest = Forest(int(pdf["n"].iloc[0]))
        for level, i, digest in zip(pdf["level"], pdf["idx"], pdf["digest"], strict=True):
            forest.add(level, i, digest)
        given = {(level, i) for level, left in enumerate(forest.open) for i in left}
        new = set(forest.fold())
        left = {(level, i) for level, held in enumerate(forest.open) for i in held}
        rows = [(level, i, forest.levels[level][i], (level, i) in left) for level, i in sorted(new | (left & given))]
        out = pd.DataFrame(rows, columns=["level", "idx", "digest", "open"])
        return out.assign(tree=pdf["tree"].iloc[0], seq=pdf["seq"].iloc[0] // FAN, n=pdf["n"].iloc[0])[NODE_NAMES]

    nodes = materialize(_laid(span_rows, leaf_rows).mapInArrow(local, NODE), "forest")
    most = spans.agg(F.max("seq")).first()[0] or 0
    held = nodes
    while most > 0:
        met = held.where("open").groupBy("tree", F.floor(F.col("seq") / FAN).alias("meet"))
        held = materialize(met.applyInPandas(meet, NODE), "forest")
        nodes, most = nodes.unionByName(held), most // FAN
    # an open node of an earlier round comes again in a later one, as the same node
    return nodes.select("tree", "n", "level", "idx", "digest").distinct()


NODE_NAMES = ["tree", "seq", "n", "level", "idx", "digest", "open"]
NODE_ARROW = pa.schema(
    [("tree", pa.int64()), ("seq", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()),
     ("digest", pa.string()), ("open", pa.bool_())]
)


def _roots(nodes: DataFrame) -> DataFrame:
    """tree, digest of every tree's root: the node at the level where one node is left."""
    tops = nodes.groupBy("tree").agg(F.max(F.struct("level", "digest"))["digest"].alias("digest"))
    return tops


def _sides(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """The nodes that the first and the last leaf of a fragment need, by fragment: two runs a level."""
    levels = F.sequence(F.lit(0), F.ceil(F.log(float(ARITY), F.col("n"))).cast("int"))
    at = spans.where("m < n").select("tree", "frag", "first", (F.col("first") + F.col("m") - 1).alias("last"), F.explode(levels).alias("level"))
    power = F.pow(F.lit(float(ARITY)), F.col("level") + 1)
    runs = F.array_distinct(F.array(*[F.floor(F.col(e) / power).cast("bigint") for e in ("first", "last")]))
    at = at.select("tree", "frag", "level", F.explode(runs).alias("run"))
    wanted = at.select("tree", "frag", "level", F.explode(F.array(*[F.col("run") * ARITY + k for k in range(ARITY)])).alias("idx"))
    found = wanted.join(nodes.select("tree", "level", "idx", "digest"), ["tree", "level", "idx"])
    return found.select("tree", "frag", F.lit(1).alias("kind"), F.col("idx").alias("pos"), "level", "digest")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict, list[tuple[str, str]], str]]:
    """(span row, leaf row, path within the tree, root of the tree) of every leaf."""
    for span, sides, own in _segments(batches):
        forest = Forest(span["n"])
        for k, row in enumerate(own):
            forest.add(0, span["pos"] + k, row["digest"])
        forest.fold()
        for row in sides:
            forest.add(row["level"], row["pos"], row["digest"], unresolved=False)
        run, above, root = None, [], ""
        for k, row in enumerate(own):
            index = span["pos"] + k
            if len(forest.sizes) == 1:
                yield span, row, [], row["digest"]
                continue
            if index // ARITY != run:  # the path of the parent serves the whole run
                run = index // ARITY
                above = list(forest.path(run, 1))
                own_run = [forest.levels[0][i] for i in forest.run(0, index)]
                root = folded(digest_of(*own_run), above)
            nodes, siblings = forest.levels[0], forest.run(0, index)
            beside = "".join(nodes[i] for i in siblings if i < index), "".join(nodes[i] for i in siblings if i > index)
            yield span, row, [beside, *above], root


def manifest(
    df: DataFrame,
    fields: list[Column],
    id_col: str = "doc_id",
    group_col: str = "source",
    altered: list[Column] | None = None,
) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per input row.

    leaf is the digest of the fields. Leaves of one group ascend by id (null first, equal ids by
    leaf) and fold three at a time to the group's subroot, the subroots in order of group
    (null first, UTF-8 bytewise) to root. proof_sha256 is the digest of all siblings from the
    leaf to root. folded_root is what the leaf of the ``altered`` fields (default: the fields)
    gives with the original siblings; verified says whether that is root.

    Nulls are values of their own; equal rows are leaves of their own; a group of one row has
    its leaf as subroot and a single group its subroot as root. An empty input gives no rows.
    Columns other than those in the arguments are not read, so their names cannot clash.
    """
    leaf = leaf_digest(*fields)
    given = df.select(
        F.col(group_col).cast("string").alias("grp"), F.col(id_col).alias("doc_id"), leaf.alias("digest"),
        (leaf_digest(*altered) if altered else F.lit(None).cast("string")).alias("alt"),
    )
    given = given.withColumn("alt", F.when(F.col("alt") != F.col("digest"), F.col("alt")))
    # equal rows in any order: the last key only deals them over partitions
    ordered = given.withColumn("tie", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange("grp", "doc_id", "digest", "tie").sortWithinPartitions("grp", "doc_id", "digest")
    ordered = materialize(ordered.drop("tie").withColumn("at", F.monotonically_increasing_id()), "leaves")

    groups = ordered.groupBy("grp").agg(F.min("at").alias("first_at"))
    groups = materialize(
        groups.repartitionByRange("first_at").sortWithinPartitions("first_at").withColumn("slot", F.monotonically_increasing_id()), "groups"
    )
    # groups in order of their first rows; slots ascend with gaps, which the counts of their fragments close
    frag = lambda c: F.shiftright(c, FRAGMENT_BITS)
    leaves = ordered.join(groups, ordered["grp"].eqNullSafe(groups["grp"])).select(
        F.col("slot").alias("tree"), frag("at").alias("frag"), F.col("at").alias("pos"), "digest", "alt", "doc_id"
    )
    leaves = materialize(leaves, "leaves")
    spans = materialize(_spans(leaves), "spans")
    nodes = materialize(_forest(leaves, spans), "nodes")

    tops = _roots(nodes).select(F.lit(0).cast("bigint").alias("tree"), frag("tree").alias("frag"), F.col("tree").alias("pos"), "digest")
    tops = materialize(tops, "leaves")
    top_spans = materialize(_spans(tops), "spans")
    top_nodes = materialize(_forest(tops, top_spans), "nodes")
    top_rows = _laid(
        top_spans.select("tree", "frag", "n", F.lit(0).alias("kind"), F.col("first").alias("pos")),
        _sides(top_nodes, top_spans),
        tops.withColumn("kind", F.lit(2)),
    )

    def upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, row, path, root in _walk(batches):
            yield pa.RecordBatch.from_pydict(
                {"tree": [row["pos"]], "subroot": [row["digest"]], "root": [root],
                 "lefts": [[x for x, _ in path]], "rights": [[x for _, x in path]]}, schema=UPPER_ARROW,
            )

    tops_of = materialize(top_rows.mapInArrow(upper, UPPER), "subroots")
    span_rows = spans.join(tops_of, "tree").select(
        "tree", "frag", "n", F.lit(0).alias("kind"), F.col("first").alias("pos"), "subroot", "root", "lefts", "rights"
    )
    rows = _laid(span_rows, _sides(nodes, spans), leaves.withColumn("kind", F.lit(2)))
    id_type = given.schema["doc_id"].dataType.simpleString()

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_pydict(dict(zip(PROOF_NAMES, map(list, columns), strict=True)))

        for span, row, path, subroot in _walk(batches):
            whole = [*path, *zip(span["lefts"], span["rights"], strict=True)]
            proof = digest_of(*[side for pair in whole for side in pair])
            again = folded(row["alt"] or row["digest"], whole)
            held.append((row["doc_id"], row["digest"], subroot, span["root"], proof, again, again == span["root"]))
            if len(held) == 10_000:
                yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(
        proofs, f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )


PROOF_NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
UPPER = "tree bigint, subroot string, root string, lefts array<string>, rights array<string>"
UPPER_ARROW = pa.schema(
    [("tree", pa.int64()), ("subroot", pa.string()), ("root", pa.string()), ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string()))]
)


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents; where 2 divides the crc32 of the id, a copy without line feeds is held to the proof."""
    names = ("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in names]
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    stripped = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(docs, fields, altered=[*fields[:-1], stripped])
