"""Join of texts with similar word n-grams by a MinHash LSH forest (operator 8).

Two texts link if the Jaccard similarity of their sets of word n-grams (five words; a shorter text is one
n-gram) reaches the threshold (0.8). Equal texts are one node from the start, with a count.

1. Signature: every tree of the forest has its own string of `depth` min-hashes. One pass over the texts.
2. Tries: the strings of all trees are sorted once, by ranges, so a node of a tree's trie is a stretch of rows with
   a common prefix. Rows that share no prefix of `least_depth` min-hashes with a neighbour in this order are in no node
   and go. The texts of each node are counted at all depths from `least_depth` to `depth`.
3. Matched prefixes: a text begins with its whole string in every tree, and shortens the prefix of one tree after
   another by a min-hash until a partner at the threshold shares one of its prefixes with the target probability. It
   shortens first where that adds the fewest texts for the recall it gains, so in trees where it stands in a crowd its
   prefixes stay long and those of other trees make up for it. What a prefix finds, it finds for both sides.
4. Families: connected components of the nodes that some text chose. A family of more than BLOCK_TEXTS texts or
   BLOCK_GRAMS n-grams is dealt into blocks along the first tree; two blocks meet in a unit if a chosen node has
   texts of both, and only with the texts of such nodes. So work follows candidates, not the square of a family.
5. Exact verification: each unit counts common n-grams of its texts, in matrix products where n-grams are common
   and along lists where they are rare. No pair becomes a row: a unit gives each text its number of links and the
   smallest text it is connected to. Two texts meet in one unit only.
6. Classes: connected components of the verified links.

No step depends on the size of a node: crowds are split by longer prefixes and blocks, never cut off. Joins by
node or family send hot ones (at most KEY_SHARE) to the rows instead of the rows to one task. Texts of one
block are in one task's memory, each block pair of a large family ships its texts once.

Defined results: a null text or one without words links to nothing and is a class of its own; texts of any
length are read whole; each input row gives a row, so equal rows link to each other; a class is named by its
smallest id (null where it has only null ids); an empty table gives an empty result; the result has no other
columns than the id's, `class_id` and `n_links`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from texloom.llm.common import discard, distinct_ids, join_by_key, limit_batches, starts_of, text_bytes, worker_cache, written
from texloom.llm.graph import components

#: N-grams and texts of a block of a family.
BLOCK_GRAMS, BLOCK_TEXTS = 1_500_000, 2048
#: Bytes of a min-hash in a tree's string.
WIDTH = 2
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Forest:
    """threshold and recall say what is found; trees, depth and least_depth are the forest's."""

    words: int = 5
    threshold: float = 0.8
    recall: float = 0.999
    trees: int = 24
    depth: int = 8
    least_depth: int = 5
    seed: int = 5

    def __post_init__(self):
        if self.expected_recall(np.full(self.trees, self.least_depth)) < self.recall:
            raise ValueError("the shortest prefixes of all trees don't reach the recall")

    def expected_recall(self, depths: np.ndarray) -> np.ndarray:
        """Probability that a pair at the threshold shares a prefix of these depths (the last axis: trees) in some tree."""
        return 1 - np.prod(1 - self.threshold ** np.asarray(depths, float), axis=-1)

    def matched_depths(self, sizes: np.ndarray) -> np.ndarray:
        """Depths of the matched prefixes, a row a text and a column a tree. sizes[i, t, k]: texts that share the prefix of
        least_depth + k min-hashes of text i in tree t."""
        at = np.full(sizes.shape[:2], sizes.shape[2] - 1)
        sizes = np.maximum.accumulate(np.maximum(sizes, 1)[:, :, ::-1], axis=2)[:, :, ::-1].astype(float)
        log_miss = np.log(1 - self.threshold ** (self.least_depth + np.arange(sizes.shape[2], dtype=float)))
        # cost of each step from depth k to k - 1: new texts for the recall gained; ties go to the longer prefix, then the first tree
        cost = np.full(sizes.shape, np.inf)
        cost[:, :, 1:] = (sizes[:, :, :-1] - sizes[:, :, 1:] + 1e-3) / (log_miss[1:] - log_miss[:-1])
        goal = np.log(1 - self.recall)
        open_rows = np.arange(len(sizes))
        trees = np.arange(sizes.shape[1])
        while True:
            open_rows = open_rows[log_miss[at[open_rows]].sum(axis=1) > goal + 1e-12]
            if not len(open_rows):
                return at + self.least_depth
            pick = cost[open_rows[:, None], trees[None, :], at[open_rows]].argmin(axis=1)
            at[open_rows, pick] -= 1


def ngram_hashes(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word n-grams of each text, end to end, repeats included, and the texts' bounds."""
    split = [t.split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ids, vocabulary = distinct_ids([w for s in split for w in s])
    flat = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), np.uint64, len(vocabulary))[ids]
    counts = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
    bounds, begin = starts_of(counts), starts_of(sizes)[:-1]
    which = np.repeat(np.arange(len(split)), counts)
    first = begin[which] + np.arange(len(which)) - bounds[which]
    last = begin[which] + sizes[which]
    h = np.zeros(len(which), np.uint64)
    for k in range(words):
        at = first + k
        inside = at < last
        value = flat[np.minimum(at, len(flat) - 1)] if len(flat) else h
        h = np.where(inside, (h ^ value) * _MIX, h)
        h ^= h >> np.uint64(29)
    h *= _STEP
    return h ^ (h >> np.uint64(32)), bounds


def min_hashes(hashes: np.ndarray, bounds: np.ndarray, count: int, seed: int) -> np.ndarray:
    """The smallest of `count` hash functions over each text's n-grams; texts without any are all ones."""
    rng = np.random.default_rng(seed)
    mul = (rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
    add = rng.integers(0, 1 << 32, count, dtype=np.uint32)[:, None]
    low = hashes.astype(np.uint32)
    out = np.full((len(bounds) - 1, count), 0xFFFFFFFF, np.uint32)
    for i in range(len(bounds) - 1):
        for a in range(bounds[i], bounds[i + 1], 1024):
            part = low[a : min(a + 1024, bounds[i + 1])]
            np.minimum(out[i], (part * mul + add).min(axis=1), out=out[i])
    return out


def _signatures(docs: DataFrame, id_col: str, text_col: str, forest: Forest) -> DataFrame:
    """(id, digest, n_grams, keys): keys has a string for each tree, the tree's number first."""
    limit_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("digest"), text.alias("text"))
    schema = T.StructType([rows.schema["id"], rows.schema["digest"], T.StructField("n_grams", T.LongType()), T.StructField("keys", T.ArrayType(T.BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("near_copies")
        for batch in batches:
            hashes, bounds = ngram_hashes([t or b"" for t in text_bytes(batch.column(2))], forest.words)
            found = min_hashes(hashes, bounds, forest.trees * forest.depth, forest.seed)
            found = ((found >> np.uint32(13)) & np.uint32(0xFFFF)).astype(">u2")
            raw = np.empty((len(found), forest.trees, 1 + WIDTH * forest.depth), np.uint8)
            raw[:, :, 0] = np.arange(forest.trees)
            raw[:, :, 1:] = found.view(np.uint8).reshape(len(found), forest.trees, -1)
            keys = pa.array(np.ascontiguousarray(raw).view(f"V{raw.shape[2]}").ravel().tolist(), pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * forest.trees), keys)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(bounds)), lists], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def _crowded(texts: DataFrame, forest: Forest) -> DataFrame:
    """(key, digest) of the sorted tries where a neighbour shares the shortest prefix, and the ends of each sorted batch."""
    rows = texts.select(F.explode("keys").alias("key"), "digest")
    rows = rows.repartitionByRange("key", "digest").sortWithinPartitions("key", "digest")
    size, short = 1 + WIDTH * forest.depth, 1 + WIDTH * forest.least_depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, size)[:, :short]
            same = (raw[1:] == raw[:-1]).all(axis=1)
            stays = np.ones(len(raw), bool)
            stays[1:-1] = same[1:] | same[:-1]
            yield batch.filter(pa.array(stays))

    return rows.mapInArrow(run, rows.schema)


def _levels(crowded: DataFrame, forest: Forest) -> DataFrame:
    """(node, digest) for each depth."""
    ends = F.array(*[F.lit(1 + WIDTH * d) for d in range(forest.least_depth, forest.depth + 1)])
    return crowded.select("key", "digest", F.explode(ends).alias("end")).select(F.expr("substring(key, 1, end)").alias("node"), "digest")


def _chosen(sized: DataFrame, forest: Forest) -> DataFrame:
    """(digest, nodes: (node, n) of one text) -> (node) that the text's matched prefixes are, where other texts are too."""
    levels = forest.depth - forest.least_depth + 1
    schema = T.StructType([T.StructField("node", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            bounds = np.asarray(lists.offsets)
            bounds = bounds - bounds[0]
            flat = lists.flatten()
            nodes, count = flat.field(0).to_pylist(), np.asarray(flat.field(1))
            row = np.repeat(np.arange(len(lists)), np.diff(bounds))
            tree = np.fromiter((x[0] for x in nodes), np.int64, len(nodes))
            level = (np.fromiter(map(len, nodes), np.int64, len(nodes)) - 1) // WIDTH - forest.least_depth
            sizes = np.ones((len(lists), forest.trees, levels), np.int64)
            sizes[row, tree, level] = count
            depths = forest.matched_depths(sizes)
            used = np.nonzero(depths[row, tree] - forest.least_depth == level)[0]
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in used], pa.binary())], names=["node"])

    return sized.mapInArrow(run, schema)


def _memberships(texts: DataFrame, forest: Forest) -> DataFrame:
    """(node, digest, n): the texts of each node that some text chose; n is about how many there are."""
    crowded = written(_crowded(texts, forest), "tries")
    levels = _levels(crowded, forest)
    nodes = written(levels.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "nodes")
    sized = join_by_key(levels, nodes, "node").groupBy("digest").agg(F.collect_list(F.struct("node", "n")).alias("nodes"))
    chosen = written(_chosen(sized, forest).distinct().join(nodes, "node"), "chosen")
    found = written(join_by_key(levels, chosen, "node").select("node", "digest"), "memberships")
    for spent in (crowded, nodes, chosen):
        discard(spent)
    return found


def _incidence(hashes: np.ndarray, bounds: np.ndarray, split: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Which texts have which shared n-grams, from sets end to end, for texts before `split` and from it on (0: all on both sides).

    For each side: the texts of each column, end to end, and the columns' bounds; then each column's weight, as n-grams
    that the same texts have are one column.
    """
    m = len(bounds) - 1
    owner = np.repeat(np.arange(m), np.diff(bounds))
    _, column = np.unique(hashes, return_inverse=True)
    many = int(column.max(initial=-1)) + 1
    first = np.bincount(column[owner < split], minlength=many) if split else np.bincount(column, minlength=many)
    second = np.bincount(column[owner >= split], minlength=many) if split else first - 1
    shared = ((first > 0) & (second > 0))[column]
    column, owner = column[shared], owner[shared]
    mark = np.random.default_rng(m).integers(0, 1 << 63, m, dtype=np.uint64)
    pattern = np.zeros(many, np.uint64)
    np.add.at(pattern, column, mark[owner])
    kept = np.unique(column)
    _, chief, weight = np.unique(pattern[kept], return_index=True, return_counts=True)
    place = np.full(many, -1)
    place[kept[chief]] = np.arange(len(chief))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    sides = [owner < split, owner >= split] if split else [np.ones(len(owner), bool)] * 2
    shift = [0, split]
    return [owner[x] - d for x, d in zip(sides, shift, strict=True)], [starts_of(np.bincount(column[x], minlength=len(chief))) for x in sides], weight


def common_counts(hashes: np.ndarray, bounds: np.ndarray, split: int = 0) -> np.ndarray:
    """How many n-grams each two different texts share, from their sets end to end; with split, of each text before it and
    each from it on."""
    m = len(bounds) - 1
    rows, columns = (split, m - split) if split else (m, m)
    (left, right), (lb, rb), weight = _incidence(hashes, bounds, split)
    nl, nr = np.diff(lb), np.diff(rb)
    out = np.zeros((rows, columns), np.float32)
    dense = nl * nr * 64 >= rows * columns
    at = np.nonzero(dense)[0]
    width = max(1, min(4096, (16 << 20) // max(4 * max(rows, columns), 1)))
    for a in range(0, len(at), width):
        part = at[a : a + width]
        x, y = np.zeros((rows, len(part)), np.float32), np.zeros((columns, len(part)), np.float32)
        for own, b, count, into in ((left, lb, nl, x), (right, rb, nr, y)):
            many = count[part]
            pick = np.repeat(b[part] - starts_of(many)[:-1], many) + np.arange(many.sum())
            into[own[pick], np.repeat(np.arange(len(part)), many)] = 1
        x *= weight[part]
        out += x @ y.T
    at = np.nonzero(~dense)[0]
    cost = starts_of(nl[at] * nr[at])
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(cost, cost[a] + (2 << 20), side="right")) - 1)
        part = at[a:b]
        # each entry of the left side meets the column's entries of the right side
        many = nl[part]
        entry = np.repeat(lb[part] - starts_of(many)[:-1], many) + np.arange(many.sum())
        of = np.repeat(part, many)
        reach = nr[of]
        pick = np.repeat(rb[of] - starts_of(reach)[:-1], reach) + np.arange(reach.sum())
        np.add.at(out.ravel(), np.repeat(left[entry], reach) * columns + right[pick], np.repeat(weight[of], reach).astype(np.float32))
        a = b
    return out


def _stars(near: np.ndarray, square: bool) -> np.ndarray:
    """For each text of a unit, the first text of its component. near: of rows and columns, which are the same texts if square,
    else the columns' texts are numbered after the rows'."""
    rows, columns = near.shape
    if square:
        root = np.full(rows, -1)
        for i in range(rows):
            front = np.array([i] if root[i] < 0 else [], int)
            while len(front):
                root[front] = i
                front = np.nonzero(near[front].any(axis=0) & (root < 0))[0]
        return root
    root = np.full(rows + columns, -1)
    for i in range(rows):
        if root[i] >= 0:
            continue
        front = np.array([i])
        while len(front):
            root[front] = i
            across = np.nonzero(near[front].any(axis=0) & (root[rows:] < 0))[0]
            root[rows + across] = i
            front = np.nonzero(near[:, across].any(axis=1) & (root[:rows] < 0))[0] if len(across) else across
    alone = np.nonzero(root < 0)[0]
    root[alone] = alone
    return root


def _verify(units: DataFrame, forest: Forest) -> DataFrame:
    """Rows of units (unit, side, digest, copies, text) in the units' order -> (digest, links, leader)."""
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("links", T.LongType()), T.StructField("leader", T.BinaryType())])

    def of_unit(rows: list[tuple]) -> list[tuple]:
        rows = sorted(rows, key=lambda r: (r[0], r[1]))
        low = rows[0][0]
        split = sum(r[0] == low for r in rows)
        square = split == len(rows)
        sets, step = [], 256
        for a in range(0, len(rows), step):
            hashes, bounds = ngram_hashes([r[3] for r in rows[a : a + step]], forest.words)
            sets += [np.unique(hashes[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        common = common_counts(np.concatenate(sets), starts_of(sizes), 0 if square else split)
        one, two = (sizes, sizes) if square else (sizes[:split], sizes[split:])
        # common >= threshold * either, in parts that keep the matrix the only large one; one part in 10**9 allows for rounding
        share = forest.threshold / (1 + forest.threshold)
        near = np.empty(common.shape, bool)
        for i in range(len(one)):
            near[i] = common[i].astype(np.float64) >= share * (one[i] + two) - 1e-9 * two
        if square:
            np.fill_diagonal(near, False)
        copies = np.array([r[2] for r in rows], np.int64)
        if square:
            links = np.array([copies[x].sum() for x in near])
        else:
            links = np.concatenate([[copies[split:][x].sum() for x in near], [copies[:split][x].sum() for x in near.T]])
        root = _stars(near, square)
        return [(r[1], int(n), rows[root[i]][1]) for i, (r, n) in enumerate(zip(rows, links, strict=True)) if n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            out = of_unit(rows) if len(rows) > 1 else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["digest", "links", "leader"])

        for batch in batches:
            names = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), text_bytes(batch.column(4))]
            for key, *row in zip(*names, strict=True):
                if key != unit:
                    yield from finish()
                    unit, rows = key, []
                rows.append(row)
        yield from finish()

    return units.mapInArrow(run, schema)


def _units(memberships: DataFrame, texts: DataFrame, forest: Forest) -> DataFrame:
    """(digest, side, pairs): each candidate text's block and the block pairs (i, j) of its family that it takes part in, with family."""
    leaders = written(memberships.groupBy("node").agg(F.min("digest").alias("leader"), F.count(F.lit(1)).alias("n")), "leaders")
    families = components(join_by_key(memberships, leaders, "node").select(F.col("leader").alias("a"), F.col("digest").alias("b")))
    families = families.withColumnsRenamed({"node": "digest", "root": "family"})
    anchor = F.expr(f"substring(keys[0], 1, {1 + WIDTH * forest.least_depth})")
    members = written(families.join(texts.select("digest", "n_grams", anchor.alias("anchor")), "digest"), "members")
    size = members.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("grams"))
    size = written(size.select("family", "n", F.greatest(F.ceil(F.col("grams") / BLOCK_GRAMS), F.ceil(F.col("n") / BLOCK_TEXTS)).cast("int").alias("blocks")), "families")
    members = written(join_by_key(members, size, "family").select("digest", "family", "blocks", F.concat("family", "anchor").alias("place")), "blocked")
    one = F.lit(0)
    small = members.where("blocks <= 1").select("digest", "family", one.alias("side"), F.array(F.struct(one.alias("i"), one.alias("j"))).alias("pairs"))
    # a large family: its first tree's crowds go to as many blocks as they fill, other texts with their anchor
    large = members.where("blocks > 1")
    places = written(large.groupBy("place").agg(F.count(F.lit(1)).alias("n")), "places")
    spread = F.pmod(F.xxhash64("digest"), F.ceil(F.col("n") / BLOCK_TEXTS))
    sided = join_by_key(large, places, "place").select("digest", "family", F.pmod(F.xxhash64("place") + spread, F.col("blocks")).cast("int").alias("side"))
    sided = written(sided, "sides")
    met = written(memberships.join(sided, "digest"), "met")
    blocks_of = written(met.groupBy("node").agg(F.collect_set("side").alias("sides"), F.count(F.lit(1)).alias("n")), "spans")
    spans = join_by_key(met, blocks_of, "node").groupBy("digest", "family", "side").agg(F.array_distinct(F.flatten(F.collect_list("sides"))).alias("others"))
    pairs = F.transform("others", lambda j: F.struct(F.least("side", j).alias("i"), F.greatest("side", j).alias("j")))
    return written(small.unionByName(spans.select("digest", "family", "side", pairs.alias("pairs"))), "units")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: Forest | None = None) -> DataFrame:
    """(id, digest, class_id, class_digest, n_links) for each row of docs. digest: of the text; class_digest names the class's
    chosen text: of those with the smallest id, the smallest digest."""
    forest = forest or Forest()
    signed = written(_signatures(docs, id_col, text_col, forest), "signatures")
    full = signed.where("n_grams > 0")
    counted = full.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    # equal texts have equal signatures: one row of each stays
    heads = full.select("digest", F.col("id").alias("first"), "n_grams", "keys").join(counted, ["digest", "first"]).dropDuplicates(["digest", "first"])
    texts = written(heads.unionByName(full.where("id is null").select("digest", F.col("id").alias("first"), "n_grams", "keys").join(counted.where("first is null").drop("first"), "digest").dropDuplicates(["digest"])), "texts")
    members = _units(_memberships(texts, forest), texts, forest).join(texts.select("digest", "first", "copies"), "digest")
    members = written(members, "candidates")
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))).alias("digest"), F.col(f"`{text_col}`").cast("string").alias("text"))
    chosen = members.where("first is not null").withColumnRenamed("first", "id")
    # a merge join at every size: texts are dealt by digest, not sent a growing table
    held = source.join(chosen.hint("merge"), ["digest", "id"])
    nameless = source.where("id is null").join(members.where("first is null").drop("first"), "digest").select(held.columns)
    held = held.unionByName(nameless).dropDuplicates(["digest"]) if _repeats(signed) else held.unionByName(nameless)
    units = held.select("family", "digest", "copies", "text", "side", F.explode("pairs").alias("pair"))
    units = units.select(F.concat(F.hex("family"), F.lit(":"), F.col("pair.i"), F.lit(":"), F.col("pair.j")).alias("unit"), "side", "digest", "copies", "text")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    units = units.repartition(parts, "unit").sortWithinPartitions("unit")
    verified = written(_verify(units, forest), "verified")
    classes = components(verified.select(F.col("leader").alias("a"), F.col("digest").alias("b"))).withColumnsRenamed({"node": "digest", "root": "class"})
    links = verified.groupBy("digest").agg(F.sum("links").alias("links"))
    known = texts.select("digest", "first", "copies").join(classes, "digest", "left").join(links, "digest", "left")
    known = written(known.select("digest", "first", "copies", F.coalesce("class", "digest").alias("class"), F.coalesce("links", F.lit(0)).alias("links")), "known")
    named = known.groupBy("class").agg(
        F.min(F.when(F.col("first").isNotNull(), F.struct("first", "digest"))).alias("head"), F.min("digest").alias("least"), F.count(F.lit(1)).alias("n")
    )
    named = written(named.select("class", F.col("head.first").alias("class_id"), F.coalesce("head.digest", "least").alias("class_digest"), "n"), "named")
    found = join_by_key(known, named, "class").select("digest", "class_id", "class_digest", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n"))
    rows = join_by_key(signed.where("n_grams > 0").select("id", "digest"), written(found, "found"), "digest").drop("n")
    none = signed.where("n_grams = 0").select("id", "digest", F.col("id").alias("class_id"), F.col("digest").alias("class_digest"), F.lit(0).alias("n_links"))
    return rows.select(none.columns).unionByName(none).select(F.col("id").alias(id_col), "digest", "class_id", "class_digest", F.col("n_links").cast("long").alias("n_links"))


def _repeats(signed: DataFrame) -> bool:
    """Whether any id comes twice with one text."""
    return not signed.groupBy("id", "digest").count().where("count > 1").isEmpty()
