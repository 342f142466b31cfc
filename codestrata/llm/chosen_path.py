"""Similarity join on word shingles by chosen paths: trees of minwise tokens.

A set's sketch holds its minwise token under many hash functions.  The root of a tree branches all
sets by one position of the sketch: a branch is a node with the sets that have one minwise token
there.  A node with few sets compares them exhaustively, by their sketches.  A larger one chooses
more positions, by a hash of its path, and each of its sets goes on to the branches of its own
minwise tokens at these.  Two sets that share a fraction s of their union agree at a position with
chance s, so they stay together down a tree with a chance known beforehand, and as many independent
trees are made as the target recall needs.  A node that is still large after some branchings holds
sets that are alike in all that was chosen; these are taken as one cluster without comparison.

Nodes give links that span what they found, never all pairs, and what they link is a cluster.  The
links of the result are confirmed on full sets, within clusters: each set is sent to one task with
others of its cluster, in chunks of bounded size that all hold the cluster's first set.  A set that
is not in its cluster's largest class after that is compared with the cluster's other chunks too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.components import components
from codestrata.llm.exchange import run_lengths
from codestrata.llm.jaccard import Sets, column
from codestrata.llm.words import Hasher, mix, ranges, text_runs
from codestrata.scale import attach, fits_broadcast, materialize

WIDTH = 4
LEAST_PERCENT = 80
# Chance that a tree or several find a pair that is just alike enough.
RECALL = 0.999
# Positions of a sketch.
SKETCH = 128
# Share of equal positions from which sets are taken as likely alike: what a pair that is just
# alike enough falls short of once in 2,500 times.
LIKELY_PERCENT = 68
# Sets of a node that are compared exhaustively; positions that a larger one branches by; levels.
SMALL_NODE, BRANCHES, LEVELS = 64, 2, 4
# Rows of nodes, and shingles of clusters, that a task works on together.
POOL_ROWS, CHUNK_SHINGLES = 1 << 13, 1 << 20

PATHS = "path long, node long"


def n_trees(least_percent: int, recall: float, branches: int = BRANCHES, levels: int = LEVELS) -> int:
    """Trees that find a pair of the least similarity with a chance of ``recall``."""
    agree = least_percent / 100
    missed = 1 - agree * (1 - (1 - agree) ** branches) ** (levels - 1)
    return max(1, math.ceil(math.log(1 - recall) / math.log(missed)))


def multipliers() -> np.ndarray:
    """An odd 32-bit number for each position of a sketch."""
    return (mix(np.arange(1, SKETCH + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | 1


def sketches(sets: Sets, factors: np.ndarray) -> np.ndarray:
    """The least hash of each set's shingles under each position; zeros for an empty set."""
    found = np.zeros((len(sets.sizes), len(factors)), np.uint32)
    some = np.flatnonzero(sets.sizes)
    if len(some):
        tokens, firsts = (sets.tokens >> np.uint64(32)).astype(np.uint32), sets.first[some]
        for position, factor in enumerate(factors):
            found[some, position] = np.minimum.reduceat(tokens * factor, firsts)
    return found


def _signatures(width: int):
    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, factors = Hasher(), multipliers()
        for batch in batches:
            ids, keys = column(batch, "doc_id"), column(batch, "key")
            for first, last, words in text_runs(batch, "text", lower=True):
                sets, n = Sets(words, hasher, width), last - first
                rows = [row.tobytes() for row in sketches(sets, factors)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, n),
                        keys.slice(first, n),
                        pa.array(sets.sizes),
                        pa.array(sets.nodes),
                        pa.array(rows, pa.binary()),
                    ],
                    ["doc_id", "key", "n_shingles", "node", "sketch"],
                )

    return signatures


def _matrix(blobs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), np.uint32).reshape(-1, SKETCH)


def _path(path: np.ndarray, position: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(mix(path + np.uint64(1) + position.astype(np.uint64)) ^ value.astype(np.uint64))


def _roots(trees: int):
    """The branch of each set in each tree; tree t branches by position t."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(column(batch, "sketch"))[:, :trees]
            position = np.broadcast_to(np.arange(trees), values.shape)
            paths = _path(np.zeros(values.shape, np.uint64), position, values)
            nodes = np.repeat(column(batch, "node").to_numpy(), trees)
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths.ravel().view(np.int64)), pa.array(nodes)], ["path", "node"]
            )

    return roots


def _branches(n: int):
    """The branches of the sets of large nodes, at ``n`` positions that a node's path chooses."""

    def branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, found = _matrix(column(batch, "sketch")), []
            above = column(batch, "path").to_numpy().view(np.uint64)
            for k in range(n):
                chosen = mix(above + np.uint64(k + 1)) % np.uint64(SKETCH)
                found.append(_path(above, chosen, values[np.arange(len(values)), chosen.astype(int)]))
            paths = np.concatenate(found) if found else np.zeros(0, np.uint64)
            nodes = np.tile(column(batch, "node").to_numpy(), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths.view(np.int64)), pa.array(nodes)], ["path", "node"]
            )

    return branches


def _spanning(likely: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the least row that it is connected with."""
    label = np.arange(len(likely))
    while True:
        least = np.where(likely, label, len(likely)).min(axis=1)
        least = np.minimum(label, least)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _node_links(percent: int, likely_percent: int):
    """Links ``(a, b)`` that span the likely pairs of each node in a table of whole nodes."""

    def node_links(table: pa.Table) -> pa.Table:
        path, node = (table.column(c).to_numpy() for c in ("path", "node"))
        order = np.lexsort((node, path))
        path, node = path[order], node[order]
        sizes = table.column("n_shingles").to_numpy()[order]
        values = _matrix(table.column("sketch").combine_chunks())[order]
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start, n in zip(*run_lengths(path), strict=True):
            own, size = values[start : start + n], sizes[start : start + n]
            equal = (own[:, None, :] == own[None, :, :]).sum(axis=2)
            least, most = np.minimum(size[:, None], size), np.maximum(size[:, None], size)
            likely = (100 * equal >= likely_percent * SKETCH) & (100 * least >= percent * most)
            label = _spanning(likely)
            linked = np.flatnonzero(label != np.arange(n))
            found_a.append(node[start + linked])
            found_b.append(node[start + label[linked]])
        return pa.Table.from_arrays(
            [pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], ["a", "b"]
        )

    return node_links


def _likely_links(
    sets: DataFrame, trees: int, percent: int, likely_percent: int, small: int, levels: int
) -> DataFrame:
    """Links ``(a, b)`` of sets that a node found likely, or could not part.

    ``sets`` is ``(node, n_shingles, sketch)``, one row for each set.  A level's paths are counted
    with each task's counts first; a set alone in its node goes no further.
    """
    paths = sets.select("node", "sketch").mapInArrow(_roots(trees), PATHS)
    leaves: DataFrame | None = None
    links: DataFrame | None = None
    for level in range(levels):
        paths = materialize(paths, "paths")
        nodes = paths.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
        nodes = materialize(nodes.filter("n > 1"), "nodes")
        members = materialize(attach(paths, nodes, ["path"], "n"), "members")
        found = members.filter(F.col("n") <= small).select("path", "node")
        leaves = found if leaves is None else leaves.unionByName(found)
        large = members.filter(F.col("n") > small)
        if large.isEmpty():
            break
        if level + 1 == levels:
            links = large.filter("node <> first").select(
                F.col("node").alias("a"), F.col("first").alias("b")
            )
        else:
            paths = large.select("path", "node").join(sets.select("node", "sketch"), "node")
            paths = paths.mapInArrow(_branches(BRANCHES), PATHS)
    pools = max(1, math.ceil(leaves.count() / POOL_ROWS))
    compared = leaves.join(sets, "node").withColumn(
        "pool", F.pmod(F.xxhash64("path"), F.lit(pools))
    )
    likely = compared.groupBy("pool").applyInArrow(
        _node_links(percent, likely_percent), "a long, b long"
    )
    likely = likely if links is None else likely.unionByName(links)
    return likely.distinct()


def _set_rows(width: int):
    """``(node, tokens)`` of the texts that stand for a set, each set once in a task."""

    def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(), set()
        for batch in batches:
            for _, _, words in text_runs(batch, "text", lower=True):
                sets = Sets(words, hasher, width)
                new = [
                    n
                    for n, node in enumerate(sets.nodes.tolist())
                    if node not in seen and not seen.add(node)
                ]
                blobs = [sets.tokens[sets.first[n] : sets.first[n + 1]].tobytes() for n in new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sets.nodes[new], pa.int64()), pa.array(blobs, pa.binary())],
                    ["node", "tokens"],
                )

    return set_rows


def _confirmed(percent: int):
    """Links between classes of a cluster, each confirmed on full sets.

    A table holds whole groups of rows ``(cluster, node, class, asks, tokens)``: a row that asks
    is compared with all rows of its cluster in the table, unless all are in one class by then.
    Where every row asks, those in the largest class that the first one made need not.
    """

    def of_cluster(node: np.ndarray, label: np.ndarray, asks: np.ndarray, sets: list) -> list:
        root = np.unique(label, return_inverse=True)[1]
        if (root == root[0]).all():
            return []
        sizes = np.array([len(own) for own in sets])
        tokens, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(tokens)
        tokens, owners = tokens[order], owners[order]
        found = []

        def compare(k: int) -> None:
            start = np.searchsorted(tokens, sets[k])
            counts = np.searchsorted(tokens, sets[k], "right") - start
            common = np.bincount(owners[ranges(start, counts)], minlength=len(sets))
            alike = 100 * common >= percent * (sizes[k] + sizes - common)
            others = np.flatnonzero(alike & (root != root[k]))
            joined, at = np.unique(root[others], return_index=True)
            found.extend((node[k], node[other]) for other in others[at])
            root[np.isin(root, joined)] = root[k]

        asking = np.flatnonzero(asks)
        if asks.all():
            compare(0)
            asking = np.flatnonzero(root != np.bincount(root).argmax())
        for k in asking:
            if (root == root[0]).all():
                break
            compare(k)
        return found

    def confirmed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("node", "ascending"), ("asks", "descending")])
        cluster, node, label = (table.column(c).to_numpy() for c in ("cluster", "node", "class"))
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        blobs, found = table.column("tokens").combine_chunks(), []
        for start, n in zip(*run_lengths(cluster), strict=True):
            own = slice(start, start + n)
            # A set that came twice counts once; the row that asks comes first.
            at = start + np.unique(node[own], return_index=True)[1]
            sets = [np.frombuffer(blobs[k].as_buffer(), np.uint64) for k in at.tolist()]
            found += of_cluster(node[at], label[at], asks[at], sets)
        a, b = (np.array(side, np.int64) for side in (zip(*found) if found else ([], [])))
        return pa.Table.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return confirmed


def _confirmed_links(clusters: DataFrame, sets: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Links ``(a, b)`` between sets of one cluster, enough of them to connect each class.

    ``clusters`` is ``(node, cluster, n_shingles)``, and ``sets`` has the tokens of these nodes; a
    cluster is named by its least node.
    """
    schema, confirmed = "a long, b long", _confirmed(percent)
    totals = clusters.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles")
    )
    totals = totals.withColumn("chunks", F.ceil(F.col("shingles") / chunk))
    totals = materialize(totals.select("cluster", "n", "chunks", "shingles"), "clusters")
    pools = max(1, math.ceil((totals.agg(F.sum("shingles")).first()[0] or 0) / chunk))
    placed = materialize(attach(clusters, totals.drop("shingles"), ["cluster"], "n"), "placed")

    whole = F.col("chunks") == 1
    last = F.col("chunks") - 1
    own = F.pmod(F.xxhash64("node"), "chunks")
    # The first set of a cluster goes to all of its chunks.
    to = F.when(F.col("node") == F.col("cluster"), F.sequence(F.lit(0).cast("long"), last))
    rows = placed.withColumn("chunk", F.explode(F.coalesce(to, F.array(own))))
    group = F.when(whole, F.pmod(F.xxhash64("cluster"), F.lit(pools))).otherwise(
        F.xxhash64("cluster", "chunk")
    )
    rows = rows.select(
        group.alias("group"), "cluster", "node", F.col("node").alias("class"), F.lit(True).alias("asks")
    )
    first = rows.join(sets, "node").groupBy("group").applyInArrow(confirmed, schema)
    first = materialize(first, "links")
    if totals.filter("chunks > 1").isEmpty():
        return first

    # Sets outside the largest class of a cluster of several chunks meet the others of them.
    known = placed.filter("chunks > 1").join(components(first), "node", "left")
    known = known.withColumn("class", F.coalesce("component", "node")).drop("component")
    classes = known.groupBy("cluster", "class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles")
    )
    largest = F.max_by("class", F.struct("n", "class"))
    open_ones = classes.groupBy("cluster").agg(
        F.sum("n").alias("n"),
        largest.alias("largest"),
        (F.sum("shingles") - F.max_by("shingles", F.struct("n", "class"))).alias("open"),
    )
    open_ones = open_ones.filter("open > 0").select(
        "cluster", "n", "largest", F.ceil(F.col("open") / chunk).alias("parts")
    )
    open_ones = materialize(open_ones, "open-clusters")
    known = materialize(attach(known.drop("n"), open_ones, ["cluster"], "n"), "open")
    part = F.pmod(F.xxhash64("node"), "parts")
    zero = F.lit(0).cast("long")
    every = known.select(
        "cluster", "node", "class", own.alias("chunk"), F.lit(False).alias("asks"),
        F.explode(F.sequence(zero, F.col("parts") - 1)).alias("part"),
    )
    asking = known.filter(F.col("class") != F.col("largest")).select(
        "cluster", "node", "class", F.explode(F.sequence(zero, last)).alias("chunk"),
        F.lit(True).alias("asks"), part.alias("part"),
    )
    rows = every.unionByName(asking)
    rows = rows.withColumn("group", F.xxhash64("cluster", "chunk", "part")).drop("chunk", "part")
    more = rows.join(sets, "node").groupBy("group").applyInArrow(confirmed, schema)
    return first.unionByName(more)


def similar_classes(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = WIDTH,
    least_percent: int = LEAST_PERCENT,
    recall: float = RECALL,
    small_node: int = SMALL_NODE,
    levels: int = LEVELS,
    likely_percent: int = LIKELY_PERCENT,
    chunk_shingles: int = CHUNK_SHINGLES,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of each document.

    Texts are lower-cased in A to Z.  A document's set is its distinct shingles of ``width`` words,
    or all its words as one if it has fewer; a null, empty or blank text has no set and is alike
    to nothing.  ``component_id`` is the least id that links lead to.  Null ids take part in links
    and count as no id; rows that share an id are documents of their own, repeated rows are copies;
    a very long text is one set in its task; other columns are left out; an empty table gives no
    rows.  Shingles and sets are compared by 64-bit hashes, every link on full sets; a pair that is
    just alike enough is missed with a chance of 1 - ``recall``, if nothing else connects it.
    """
    texts = docs.select(
        docs[id_column].cast("long").alias("doc_id"),
        docs[text_column].alias("text"),
    ).withColumn("key", F.xxhash64("text"))
    schema = "doc_id long, key long, n_shingles long, node long, sketch binary"
    found = materialize(texts.mapInArrow(_signatures(width), schema), "signatures")
    # One row for each different set, and the document that stands for it.
    sets = found.filter("n_shingles > 0").groupBy("node").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least"),
        F.min("n_shingles").alias("n_shingles"),
        F.min("sketch").alias("sketch"),
    )
    sets = materialize(sets, "sets")
    trees = n_trees(least_percent, recall, levels=levels)
    likely = _likely_links(
        sets.select("node", "n_shingles", "sketch"),
        trees, least_percent, likely_percent, small_node, levels,
    )
    clusters = components(likely).withColumnRenamed("component", "cluster")
    clusters = clusters.join(sets.select("node", "n_shingles", "least"), "node")
    clusters = materialize(clusters, "cluster-members")

    wanted = clusters.select(F.col("least.doc_id").alias("id"), F.col("least.key").alias("of"))
    wanted = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
    same = texts["doc_id"].eqNullSafe(wanted["id"]) & texts["key"].eqNullSafe(wanted["of"])
    tokens = texts.join(wanted, same, "left_semi").select("text")
    tokens = tokens.mapInArrow(_set_rows(width), "node long, tokens binary")
    # Rows that repeat, in several tasks, give their set more than once.
    tokens = materialize(tokens.dropDuplicates(["node"]), "tokens")
    members = clusters.select("node", "cluster", "n_shingles")
    links = materialize(_confirmed_links(members, tokens, least_percent, chunk_shingles), "links")

    classes = sets.select("node", "n", F.col("least.doc_id").alias("own")).join(
        components(links), "node", "left"
    )
    classes = classes.withColumn("component", F.coalesce("component", "node"))
    least = classes.groupBy("component").agg(F.min("own").alias("component_id"))
    by_node = materialize(classes.join(least, "component").select("node", "n", "component_id"), "classes")
    columns = ["doc_id", "n_shingles", "component_id"]
    some = attach(found.filter("n_shingles > 0").select("doc_id", "n_shingles", "node"), by_node, ["node"], "n")
    none = found.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return some.select(*columns).unionByName(none.select(*columns))
