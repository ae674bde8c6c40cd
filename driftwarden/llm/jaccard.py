"""Linking documents whose shingle sets overlap almost wholly, through a token-group matrix.

1. Equal sets become one class, so copies cost one row each.
2. Each class' shingles are dealt by hash into a few more parts than its partners may differ in, so two
   linked classes have an equal part; where it may be empty, their least shingles stand in for it. Classes with an equal part come into one family; all links
   lie inside families.
3. A family is cut into groups of bounded size. Of a group, the union of its tokens is stored, and each
   member as places in the union: one block of the token-group matrix.
4. A query's overlap with a group's union bounds its overlap with any member. Only groups where the
   bound reaches the asked overlap are opened, and only their qualifying members compared, by a
   product of 0/1 matrices.
A family of one group is done in one task. In a larger one every group is compared with the first;
what hangs together with most of the family by then needs no further look, and only the rest is
compared with all groups. So a group of near copies costs rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden.llm.common import give_back, list_array, map_batches, row_key, small_batches, split_join, stored
from driftwarden.llm.links import components
from driftwarden.llm.mph import mix
from driftwarden.llm.sieve import Sieve, part_of, sieve_of
from driftwarden.llm.words import ODD_BASES, Words, run_hashes, slices

GROUP_DOCS = 256
GROUP_TOKENS = 200_000
COLUMNS = 4096  # of the 0/1 matrices at a time
# Shingles a part of the hash space is made for, tokens that a task packs at a time, and the most parts.
PART_TOKENS, PACKED_TOKENS, MOST_PARTS = 1 << 20, 1 << 20, 4096
COPY = np.dtype([("low", "<u4"), ("node", "<i8")])
LOWER = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c for c in range(256))


def spare_parts(differ: int, size: int) -> int:
    """Parts beyond those that may differ, so that a set of ``size`` shingles seldom has as many empty ones.

    Where sets are so unlike that no number is enough, two.
    """
    for spare in range(2, differ + 2):
        empty = (differ + spare) * np.exp(-size / (differ + spare))
        if empty + 4 * np.sqrt(empty) + 1 <= spare:
            return spare
    return 2


class Bands:
    """Size bands for a similarity of at least ``percent``: partners lie in one band or in neighbours."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low = [1]
        self.parts: list[int] = []
        self.spare: list[int] = []

    def _grow(self, size: int) -> None:
        p = self.percent
        while self.low[-1] <= size:
            k = len(self.low) - 1
            self.low.append(self.low[k] * 100 // p + 1)
            top = self.low[k + 1] - 1
            differ = (top + top * 100 // p) * (100 - p) // (100 + p)
            self.spare.append(spare_parts(differ, self.low[k]))
            self.parts.append(differ + self.spare[k] if differ else 1)

    def of(self, size: int) -> list[tuple[int, int, int]]:
        """(band, parts, spare parts) of the pairs that a set of this size may be in."""
        self._grow(size)
        k = int(np.searchsorted(self.low, size, "right")) - 1
        return [(b, self.parts[b], self.spare[b]) for b in (k - 1, k) if b >= 0]


def part_tokens(hashes: np.ndarray, bands: Bands) -> np.ndarray:
    """Tokens of a sorted set: the hash of each non-empty part, for each band of pairs.

    Linked sets have at least ``spare`` equal parts. If one of them is not empty, they share its token.
    Otherwise both sets have ``spare`` empty parts or more; such sets have a token for each of their
    least shingles too, as many as make sure that linked sets share one. So every token needs
    common content. Where no shingle may differ, equal sets are one class already and there is no token.
    """
    if not len(hashes):
        return hashes
    mixed, out = mix(hashes, 31), []
    for band, parts, spare in bands.of(len(hashes)):
        if parts == 1:
            continue
        part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        content, number = np.add.reduceat(mixed, at), part[at]
        out.append(mix(content + mix(number + np.uint64(band << 32), 32), 33))
        if parts - len(at) >= spare:
            least = hashes[: len(hashes) * (100 - bands.percent) // 100 + 1]
            out.append(mix(mix(least, 34) + np.uint64(band), 35))
    return np.concatenate(out) if out else hashes[:0]


def shingle_sets(texts: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes per text; a text of fewer words is one shingle, without words none."""
    words = Words([t.translate(LOWER) for t in texts])
    hashes = words.hashes()
    windows = words.windows(hashes, shingle)
    for first, n in zip(words.first.tolist(), words.counts.tolist()):
        if n >= shingle:
            yield np.unique(windows[first : first + n - shingle + 1])
        elif n:
            at = np.array([first])
            yield run_hashes(hashes, at, at + n, ODD_BASES[2], 40 + n)
        else:
            yield windows[:0]


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that name a set."""
    at, end = np.array([0]), np.array([len(hashes)])
    pair = [run_hashes(mix(hashes, s), at, end, ODD_BASES[s - 50], s)[0] for s in (50, 51)]
    return np.array(pair, "<u8").tobytes()


def profiles(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc, rk, n, key, node, tokens) per row of (doc, rk, text); ``node`` is the first half of the key."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bands, sizes, keys, tokens = Bands(percent), [], [], []
        for texts, _ in slices(batch):
            for found in shingle_sets(texts, shingle):
                sizes.append(len(found))
                keys.append(set_key(found))
                tokens.append(part_tokens(found, bands))
        counts = np.array([len(t) for t in tokens])
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc"),
                batch.column("rk"),
                pa.array(sizes, pa.int64()),
                pa.array(keys, pa.binary()),
                pa.array(np.array([int.from_bytes(k[:8], "little", signed=True) for k in keys], np.int64)),
                list_array(np.concatenate(tokens).view(np.int64), counts, pa.int64()),
            ],
            names=["doc", "rk", "n", "key", "node", "tokens"],
        )

    return map_batches(rows, run, "doc long, rk long, n long, key binary, node long, tokens array<long>")


def codes_of(tokens: np.ndarray, parts: int) -> np.ndarray:
    """What ``repeated_tokens`` knows of a token, its part and its lower half, as an even 64-bit hash."""
    part = part_of(tokens, parts).astype(np.uint64)
    return mix((part << np.uint64(32)) | (tokens & np.uint64(0xFFFFFFFF)), 71)


def packed_tokens(named: DataFrame, copied: Broadcast, parts: int) -> DataFrame:
    """(part, alone, copies): the lower halves of the tokens in a part of the hash space, packed, some rows per task.

    In ``alone`` those of sets that one row has; in ``copies`` with the set's node, for sets that several rows may have.
    """

    def packs(nodes: list[np.ndarray], tokens: list[np.ndarray]) -> pa.RecordBatch:
        node, token = np.concatenate(nodes), np.concatenate(tokens)
        several = copied.value.has(node.view(np.uint64))
        # Parts follow the order of tokens.
        single = np.sort(token[~several])
        order = np.argsort(token[several], kind="stable")
        pairs = np.empty(len(order), COPY)
        pairs["low"], pairs["node"] = token[several][order].astype("<u4"), node[several][order]
        every = np.arange(parts + 1)
        ends = np.searchsorted(part_of(single, parts), every)
        pair_ends = np.searchsorted(part_of(token[several][order], parts), every)
        some = np.flatnonzero((np.diff(ends) > 0) | (np.diff(pair_ends) > 0))
        low = single.astype("<u4")
        return pa.RecordBatch.from_arrays(
            [
                pa.array(some, pa.int32()),
                pa.array([low[ends[i] : ends[i + 1]].tobytes() for i in some], pa.binary()),
                pa.array([pairs[pair_ends[i] : pair_ends[i + 1]].tobytes() for i in some], pa.binary()),
            ],
            names=["part", "alone", "copies"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, tokens, held = [], [], 0
        for batch in batches:
            lists = batch.column("tokens")
            tokens.append(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            nodes.append(np.repeat(batch.column("node").to_numpy(), np.diff(lists.offsets.to_numpy())))
            held += len(tokens[-1])
            if held >= PACKED_TOKENS:
                yield packs(nodes, tokens)
                nodes, tokens, held = [], [], 0
        if held:
            yield packs(nodes, tokens)
        give_back()

    small_batches(named.sparkSession)
    return named.select("node", "tokens").mapInArrow(run, "part int, alone binary, copies binary")


def repeated_tokens(named: DataFrame, classes: DataFrame) -> tuple[Sieve, int]:
    """A sieve of the codes of tokens that several sets have, and the number of parts that the codes are made with.

    Most tokens are a set's own. Four bytes of each are shuffled to find those that are not; tokens that
    meet by chance in their part and these bytes pass too, and are told apart later.
    """
    spark = named.sparkSession
    size = classes.agg(F.sum("n").alias("n")).first().n or 0
    parts = min(MOST_PARTS, max(1, -(-size // PART_TOKENS)))
    copied = spark.sparkContext.broadcast(sieve_of(classes.filter("copies > 1"), "node"))

    def count(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        alone = np.frombuffer(b"".join(rows.column("alone").to_pylist()), "<u4")
        copies = np.unique(np.frombuffer(b"".join(rows.column("copies").to_pylist()), COPY))["low"]
        low = np.sort(np.concatenate([alone, copies]))
        same = low[1:] == low[:-1]
        again = low[1:][same & np.concatenate([[True], ~same[:-1]])].astype(np.uint64)
        codes = mix((np.uint64(key[0].as_py()) << np.uint64(32)) | again, 71)
        give_back()
        return pa.table({"code": pa.array(codes.view(np.int64))})

    repeated = packed_tokens(named, copied, parts).groupBy("part").applyInArrow(count, "code long")
    return sieve_of(stored(repeated, "repeated"), "code"), parts


def shared_tokens(named: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): each set that has a token in common with others, and the least of these, over all such tokens.

    Only tokens that ``repeated_tokens`` lets pass are written whole, with the sets that have them.
    """
    sieve, parts = repeated_tokens(named, classes)
    known = named.sparkSession.sparkContext.broadcast(sieve)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("tokens")
        tokens = lists.flatten().to_numpy(zero_copy_only=False)
        node = np.repeat(batch.column("node").to_numpy(), np.diff(lists.offsets.to_numpy()))
        some = known.value.has(codes_of(tokens.view(np.uint64), parts))
        # Copies of a set have the same tokens.
        pairs = np.unique(np.stack([node[some], tokens[some]]), axis=1) if some.any() else np.empty((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "token"])

    dealt = stored(map_batches(named.select("node", "tokens"), run, "a long, token long"), "dealt")
    spans = dealt.groupBy("token").agg(F.min("a").alias("low"), F.max("a").alias("high"))
    shared = stored(spans.filter("low < high").select("token", "low"), "shared")
    return split_join(dealt, shared, ["token"]).filter("low < a").select("a", F.col("low").alias("b"))


class Group:
    """Members of a family: their documents, the union of their tokens, and each member's places in it."""

    def __init__(self, docs: np.ndarray, union: np.ndarray, sizes: np.ndarray, places: np.ndarray):
        self.docs, self.union, self.sizes, self.places = docs, union, sizes, places
        self.row = np.repeat(np.arange(len(docs)), sizes)

    @classmethod
    def build(cls, docs: list[int], sets: list[np.ndarray]) -> Group:
        every = np.concatenate(sets)
        union, places = np.unique(every, return_inverse=True)
        return cls(np.array(docs, np.int64), union, np.array([len(s) for s in sets]), places)

    @classmethod
    def read(cls, row: dict) -> Group:
        kinds = (("docs", "<i8"), ("union", "<u8"), ("sizes", "<i4"), ("places", "<i4"))
        return cls(*(np.frombuffer(row[name], kind) for name, kind in kinds))

    def write(self) -> dict:
        kinds = (("docs", "<i8"), ("union", "<u8"), ("sizes", "<i4"), ("places", "<i4"))
        return {name: getattr(self, name).astype(kind).tobytes() for name, kind in kinds}


def linked(a: Group, b: Group, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Members (row of a, row of b) whose similarity reaches ``percent``."""
    shared, at_a, at_b = np.intersect1d(a.union, b.union, assume_unique=True, return_indices=True)
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(shared):
        return none
    column_a, column_b = np.full(len(a.union), -1), np.full(len(b.union), -1)
    column_a[at_a] = column_b[at_b] = np.arange(len(shared))
    entries = []
    for g, column in ((a, column_a), (b, column_b)):
        here = column[g.places]
        keep = here >= 0
        # The bound: a member shares no more tokens with the other group's members than with their union.
        most = np.bincount(g.row[keep], minlength=len(g.docs))
        opened = 100 * most >= percent * g.sizes
        keep &= opened[g.row]
        entries.append((opened, g.row[keep], here[keep]))
    (open_a, row_a, col_a), (open_b, row_b, col_b) = entries
    if not open_a.any() or not open_b.any():
        return none
    rows_a, rows_b = np.flatnonzero(open_a), np.flatnonzero(open_b)
    new_a, new_b = np.cumsum(open_a) - 1, np.cumsum(open_b) - 1
    common = np.zeros((len(rows_a), len(rows_b)), np.float32)
    for low in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - low)
        sides = []
        for row, col, new, count in ((row_a, col_a, new_a, len(rows_a)), (row_b, col_b, new_b, len(rows_b))):
            some = (col >= low) & (col < low + width)
            bits = np.zeros((count, width), np.float32)
            bits[new[row[some]], col[some] - low] = 1
            sides.append(bits)
        common += sides[0] @ sides[1].T
    both = a.sizes[rows_a][:, None].astype(np.int64) + b.sizes[rows_b][None, :]
    inside = common.astype(np.int64)
    x, y = np.nonzero(100 * inside >= percent * (both - inside))
    return rows_a[x], rows_b[y]


def forest(nodes: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest node reachable over the links (x, y)."""
    label = np.arange(nodes)
    while len(x):
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def edges_inside(group: Group, percent: int) -> tuple[np.ndarray, np.ndarray]:
    label = forest(len(group.docs), *linked(group, group, percent))
    off = label != np.arange(len(label))
    return group.docs[off], group.docs[label[off]]


def edges_between(a: Group, b: Group, percent: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = linked(a, b, percent)
    label = forest(len(a.docs) + len(b.docs), x, y + len(a.docs))
    docs = np.concatenate([a.docs, b.docs])
    off = label != np.arange(len(label))
    return docs[off], docs[label[off]]


GROUP_COLUMNS = "family long, gid long, docs binary, union binary, sizes binary, places binary"


def family_groups(rows: DataFrame, shingle: int) -> DataFrame:
    """Groups from rows (family, n, doc, text): members of similar size next to each other.

    The rows are dealt by ranges of (family, size, document), so a large family spreads over many tasks.
    """
    small_batches(rows.sparkSession)
    order = ["family", "n", "doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        docs: list[int] = []
        sets: list[np.ndarray] = []
        family, held = None, 0

        def close() -> pa.RecordBatch:
            nonlocal made, docs, sets, held
            row = {"family": family, "gid": (task << 32) + made, **Group.build(docs, sets).write()}
            made, docs, sets, held = made + 1, [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=kinds)

        kinds = pa.schema(
            [("family", pa.int64()), ("gid", pa.int64()), *((c, pa.binary()) for c in ("docs", "union", "sizes", "places"))]
        )
        for batch in batches:
            families, numbers = batch.column("family").to_pylist(), batch.column("doc").to_pylist()
            for texts, first in slices(batch):
                for i, found in enumerate(shingle_sets(texts, shingle), first):
                    full = len(docs) == GROUP_DOCS or held + len(found) > GROUP_TOKENS
                    if docs and (full or families[i] != family):
                        yield close()
                    family = families[i]
                    docs.append(numbers[i])
                    sets.append(found)
                    held += len(found)
        if docs:
            yield close()
        give_back()

    ranged = rows.select(*order, "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(run, GROUP_COLUMNS)


def edge_rows(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.int64)
    b = np.concatenate([y for _, y in found]) if found else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The batch's rows, one at a time: each holds whole groups."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def compare_inside(groups: DataFrame, percent: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return edge_rows([edges_inside(Group.read(row), percent) for row in rows_of(batch)])

    return map_batches(groups, run, "a long, b long")


def compare_pairs(groups: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """Edges between each group and every group of the same family in ``others``."""
    parts = ("docs", "union", "sizes", "places")
    right = others.select("family", F.col("gid").alias("other"), *(F.col(c).alias(f"{c}_2") for c in parts))
    pairs = groups.join(right, "family").filter("gid <> other")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for row in rows_of(batch):
            other = Group.read({c: row[f"{c}_2"] for c in parts})
            found.append(edges_between(Group.read(row), other, percent))
        return edge_rows(found)

    wanted = pairs.select(*parts, *(f"{c}_2" for c in parts))
    return map_batches(wanted, run, "a long, b long")


def class_links(named: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, label) for the classes (doc, rk, n, node, copies) that are linked with others; ``named`` has all rows' tokens."""
    families = components(shared_tokens(named, classes)).toDF("node", "family")
    # Two sets may share a node's name once in 2^64; they are in one family then, and compared.
    members = classes.join(families, "node").select("doc", "rk", "n", "family")
    texts = docs.join(members, ["doc", "rk"]).dropDuplicates(["doc", "rk"])
    groups = stored(family_groups(texts, shingle), "groups", wide=True)
    found = compare_inside(groups, percent)
    count = groups.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min("gid").alias("first"))
    large = stored(count.filter("n > 1"), "large")
    if not large.head(1):
        return components(found)
    many = groups.join(large.select("family", "first"), "family")
    hubs = many.filter("gid = first").drop("first")
    found = stored(found.unionByName(compare_pairs(many.drop("first"), hubs, percent)), "found")
    so_far = components(found)
    # Members that don't hang together with the label most of their family has.
    inside = members.join(large.select("family"), "family").join(so_far.withColumnRenamed("node", "doc"), "doc", "left")
    inside = inside.withColumn("label", F.coalesce("label", "doc"))
    sizes = inside.groupBy("family", "label").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("family").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
    # Read from a table it is not dealt by family, so a large family's members need not meet in one task.
    main = stored(main, "main")
    apart = inside.join(main, "family").filter("label <> main").select("doc", "rk", "n", "family")
    rest = stored(family_groups(docs.join(apart, ["doc", "rk"]).dropDuplicates(["doc", "rk"]), shingle), "rest", wide=True)
    # Numbers of their own, so that no group is taken for itself.
    rest = rest.withColumn("gid", -1 - F.col("gid"))
    more = compare_pairs(rest, many.drop("first"), percent)
    return components(found.unionByName(more))


def one_label(named: DataFrame, where: DataFrame) -> DataFrame:
    """``where`` (key, label), with one label for sets that hang together over a document of several texts."""
    several = named.groupBy("doc").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low <> high")
    several = stored(several.select("doc"), "several")
    if not several.head(1):
        return where
    edges = named.select("doc", "key").join(several, "doc").join(where, "key")
    over = components(edges.select(F.col("doc").alias("a"), F.col("label").alias("b")))
    return where.join(over.toDF("label", "least"), "label", "left").select("key", F.coalesce("least", "label").alias("label"))


def link_documents(
    docs: DataFrame, shingle: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: key, n_shingles, component_id (smallest key reachable over links, itself included).

    A text's set has its distinct runs of ``shingle`` words, A-Z lowered, cut at ASCII white space; a text
    of fewer words is one shingle; a null text or one without words has an empty set and no link. Two
    sets are linked if 100 * intersection >= percent * union. Shingles are told apart by 64-bit
    hashes. Rows with a null key are returned with a null component and link nothing. Rows that share
    a key are one node. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc"), row_key(text).alias("rk"), F.col(text).alias("text"))
    found = stored(profiles(rows, shingle, percent), "profiles")
    named = found.filter(F.col("doc").isNotNull() & (F.col("n") > 0))
    classes = named.groupBy("key").agg(F.min(F.struct("doc", "rk")).alias("least"), F.first("n").alias("n"), F.first("node").alias("node"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.select("least.doc", "least.rk", "n", "node", "copies"), "classes")
    labels = class_links(named, classes, rows.filter(F.col("doc").isNotNull()), shingle, percent)
    node = named.groupBy("key").agg(F.min("doc").alias("node"))
    where = node.join(labels, "node", "left").select("key", F.coalesce("label", "node").alias("label"))
    where = one_label(named, stored(where, "where"))
    # A second key of the same content makes Spark deal both sides anew, so that many copies of one set are split.
    both_keys = F.xxhash64("key").alias("h")
    joined = found.select("doc", "n", "key", both_keys).join(where.select("key", "label", both_keys), ["key", "h"], "left")
    linked_rows = joined.filter(F.col("doc").isNotNull() & (F.col("n") > 0))
    alone = joined.filter(F.col("doc").isNull() | (F.col("n") == 0)).withColumn("label", F.col("doc"))
    both = linked_rows.unionByName(alone)
    return both.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.col("label").alias("component_id"))
