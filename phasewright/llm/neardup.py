"""Near-duplicate records with small edits: BK-trees over Hamming distance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewright.plans.tables import keep

SIMILARITY = 0.7
#: Nodes of one tree and queries of one block: what a task holds at once.
TREE = 4096
#: Records with more ids than this are sharded by their size, never by their sorted ids.
LARGE = 4096
#: Records of a shard from which on several trees over parts of the signatures are worth while.
FOREST = 128
#: A signature has so many words of 64 bits; a tree of a forest has at least so many of its bits.
_WORDS, LEAST_BITS = 8, 16
#: Radius up to which one tree over whole signatures visits few nodes.
NARROW = 3


class BKTree:
    """A tree of signatures whose children are keyed by their integer Hamming distance to the parent."""

    def __init__(self):
        self.root, self.visited = None, 0

    def add(self, sig: int, value) -> None:
        if self.root is None:
            self.root = (sig, [value], {})
            return
        node = self.root
        while True:
            d = (node[0] ^ sig).bit_count()
            if d == 0:
                node[1].append(value)
                return
            child = node[2].get(d)
            if child is None:
                node[2][d] = (sig, [value], {})
                return
            node = child

    def within(self, sig: int, radius: int) -> Iterator[tuple[int, object]]:
        """(distance, value) of everything at most ``radius`` away; other edges are not followed."""
        todo = [self.root] if self.root else []
        while todo:
            node = todo.pop()
            self.visited += 1
            d = (node[0] ^ sig).bit_count()
            if d <= radius:
                for value in node[1]:
                    yield d, value
            if len(node[2]) <= 2 * radius:
                todo.extend(c for k, c in node[2].items() if d - radius <= k <= d + radius)
            else:
                todo.extend(node[2][k] for k in range(d - radius, d + radius + 1) if k in node[2])


class Forest:
    """Trees over parts of the signatures, so that a search within a wide radius is many searches within a narrow one.

    Two signatures ``r`` apart, cut into more than ``r`` parts, are equal in one
    of them; in ``p`` parts, one of them is at most ``r / p`` apart.  Sets of
    similar size share a forest: a set enters that of its size class and that
    of the next larger one, and is sought in its own.  ``visited`` counts nodes.
    """

    BITS = 64 * _WORDS

    def __init__(self, similarity: float):
        self.slack, self.step = (1 - similarity) / (1 + similarity), math.log(1 / similarity)
        self.trees: dict[int, list[BKTree]] = {}

    def size_class(self, n: int) -> int:
        return int(math.log(n) / self.step + 1e-9)

    def parts(self, size_class: int) -> int:
        """Parts for sets of a class: one more than the radius of the largest; a single one if that is small anyway, or leaves parts too few bits."""
        parts = int(self.slack * 2 * math.ceil(math.exp(self.step * (size_class + 1))) + 1e-9) + 1
        return parts if NARROW < parts <= self.BITS // LEAST_BITS else 1

    def lanes(self, sig: int, parts: int) -> list[int]:
        width = self.BITS // parts
        mask = (1 << width) - 1
        return [(sig >> (k * width)) & mask for k in range(parts - 1)] + [sig >> ((parts - 1) * width)]

    def add(self, n: int, sig: int, value) -> None:
        for at in (self.size_class(n), self.size_class(n) + 1):
            parts = self.parts(at)
            trees = self.trees.setdefault(at, [])
            if not trees:
                trees.extend(BKTree() for _ in range(parts))
            for tree, lane in zip(trees, self.lanes(sig, parts), strict=True):
                tree.add(lane, (sig, value))

    def within(self, n: int, sig: int) -> Iterator[tuple[int, object]]:
        """(distance, value) of what is within the radius of a set of ``n`` ids, among sets that are no larger."""
        trees = self.trees.get(self.size_class(n))
        if not trees:
            return
        radius = int(self.slack * 2 * n + 1e-9)
        seen = set()
        for tree, lane in zip(trees, self.lanes(sig, len(trees)), strict=True):
            for _, (other, value) in tree.within(lane, radius // len(trees)):
                if value not in seen:
                    seen.add(value)
                    if (d := (other ^ sig).bit_count()) <= radius:
                        yield d, value

    @property
    def visited(self) -> int:
        return sum(tree.visited for trees in self.trees.values() for tree in trees)


class Single:
    """One tree with the interface of a forest, for few records."""

    def __init__(self, similarity: float):
        self.slack, self.tree = (1 - similarity) / (1 + similarity), BKTree()

    def add(self, n: int, sig: int, value) -> None:
        self.tree.add(sig, value)

    def within(self, n: int, sig: int) -> Iterator[tuple[int, object]]:
        return self.tree.within(sig, int(self.slack * 2 * n + 1e-9))


def _walk(similarity: float, forest: int):
    """Per block of a shard, in order of size: each query is looked up among the smaller records inserted before it."""
    slack = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, trees = None, None
        for batch in batches:
            cols = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            scope, lows, highs = [], [], []
            sigs = zip(*[cols[f"g{k}"] for k in range(_WORDS)], strict=True)
            keys = zip(*[cols[c] for c in ("s", "level", "h1", "h2", "tree", "block")], strict=True)
            for key, words, role, n, i, c in zip(keys, sigs, cols["role"], cols["n"], cols["i"], cols["c"], strict=True):
                if key != at:
                    at, trees = key, (Forest if c >= forest else Single)(similarity)
                sig = 0
                for w in words:
                    sig = (sig << 64) | (w & 0xFFFFFFFFFFFFFFFF)
                if role:
                    trees.add(n, sig, (n, i))
                    continue
                for d, (m, j) in trees.within(n, sig):
                    if m >= similarity * n - 1e-9 and d <= slack * (n + m) + 1e-9:
                        scope.append(key[0])
                        lows.append(min(i, j))
                        highs.append(max(i, j))
            yield pa.RecordBatch.from_arrays(
                [pa.array(scope, batch.schema.field("s").type), pa.array(lows, pa.int64()), pa.array(highs, pa.int64())], names=["s", "a", "b"]
            )

    return run


class NearDuplicates:
    """``members``: s, i, rep, n for every record; ``pairs``: s, a, b, shared, similarity between different contents.

    ``rep`` is the smallest id among records of equal content.
    """

    def __init__(self, members: DataFrame, pairs: DataFrame):
        self.members, self.pairs = members, pairs

    def record_pairs(self) -> DataFrame:
        """All pairs (s, id_lo, id_hi) of records, copies included."""
        c = self.members
        a = c.select(F.col("s").alias("sa"), F.col("rep").alias("ra"), F.col("i").alias("x"))
        b = c.select(F.col("s").alias("sb"), F.col("rep").alias("rb"), F.col("i").alias("y"))
        across = self.pairs.join(a, F.col("s").eqNullSafe(F.col("sa")) & (F.col("a") == F.col("ra"))).select("s", "b", "x")
        across = across.join(b, F.col("s").eqNullSafe(F.col("sb")) & (F.col("b") == F.col("rb"))).select("s", "x", "y")
        copies = a.join(b, F.col("sa").eqNullSafe(F.col("sb")) & (F.col("ra") == F.col("rb")) & (F.col("x") < F.col("y")))
        copies = copies.select(F.col("sa").alias("s"), "x", "y")
        return across.unionByName(copies).select("s", F.least("x", "y").alias("id_lo"), F.greatest("x", "y").alias("id_hi"))

    def classes(self) -> DataFrame:
        """One row per record: its class of equal contents, the copies in it, and the links of the class to others."""
        ends = self.pairs.select("s", F.explode(F.array("a", "b")).alias("rep")).groupBy("s", "rep").agg(F.count(F.lit(1)).alias("links"))
        size = self.members.groupBy("s", "rep").agg(F.count(F.lit(1)).alias("copies"))
        e, z = ends.select(F.col("s").alias("es"), F.col("rep").alias("er"), "links"), size.select(F.col("s").alias("zs"), F.col("rep").alias("zr"), "copies")
        out = self.members.join(z, F.col("s").eqNullSafe(F.col("zs")) & (F.col("rep") == F.col("zr")))
        out = out.join(e, F.col("s").eqNullSafe(F.col("es")) & (F.col("rep") == F.col("er")), "left")
        return out.select("s", F.col("i").alias("record_id"), F.col("rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicates(
    members: DataFrame, scope: str, record: str, member: str, similarity: float = SIMILARITY, tree: int = TREE, large: int = LARGE, forest: int = FOREST
) -> NearDuplicates:
    """Records whose sets of ids have a Jaccard similarity of at least ``similarity``; exact.

    ``members`` has a row per record and id; rows with a null record or id are
    ignored, repeats count once, scopes are kept apart and may be null.  A
    record without ids occurs nowhere in the result.

    A set's signature has 512 bits; every id flips one of them, so the Hamming
    distance of two signatures is never more than the number of ids in just one
    of the sets, and a similarity asks for at most
    ``(1 - t) / (1 + t) * (size + size)`` of those.  Signatures hang in BK-trees and
    a search follows only edges within that radius, so no pair is lost;
    candidates are then verified on the ids themselves.

    A tree covers one shard: the records that have one id among their rarest,
    of which similar sets share one (sets over ``large`` ids: the records of a
    size class and the one below).  A shard of more than ``tree`` records is cut
    by a second id: similar sets of two ids or more share two among one more of
    their rarest.  What is still larger is divided into trees of that many and
    blocks of that many queries, and each tree is sent to every block.  From
    ``forest`` records on, a shard has trees over parts of the signatures.
    """
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    rows = members.select(F.col(scope).alias("s"), F.col(record).cast("long").alias("i"), F.col(member).cast("long").alias("m"))
    rows = keep(rows.where("i IS NOT NULL AND m IS NOT NULL").distinct()).df
    h = F.xxhash64("m")
    bit = lambda k: F.when(F.pmod(h, F.lit(_WORDS)) == k, F.expr("shiftleft(1L, cast(pmod(shiftright(xxhash64(m), 8), 64) AS INT))")).otherwise(F.lit(0).cast("long"))
    sig = [f"g{k}" for k in range(_WORDS)]
    sets = rows.groupBy("s", "i").agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(bit(k)).alias(g) for k, g in enumerate(sig)], F.bit_xor(h).alias("h0"), F.bit_xor(F.xxhash64("m", F.lit(1))).alias("h1"))
    sets = keep(sets).df
    same_content = ["s", "n", "h0", "h1"]
    reps = keep(sets.groupBy(*same_content).agg(F.min("i").alias("i"), *[F.first(g).alias(g) for g in sig]), most=F.max("n"))
    r = reps.df.select(*[F.col(c).alias(f"r_{c}") for c in same_content], F.col("i").alias("rep"))
    whole = sets.join(r, same("s", "r_s") & (F.col("n") == F.col("r_n")) & (F.col("h0") == F.col("r_h0")) & (F.col("h1") == F.col("r_h1")))
    whole = keep(whole.select("s", "i", "rep", "n")).df

    # the ids of every different set, rarest first; those that no other record has come before all others
    keys = reps.df.select(F.col("s").alias("ks"), F.col("i").alias("ki"), "n", *sig)
    own = rows.join(keys.where(F.col("n") <= large).select("ks", "ki"), same("s", "ks") & (F.col("i") == F.col("ki")), "left_semi")
    freq = rows.groupBy("s", "m").agg(F.count(F.lit(1)).alias("f")).where("f > 1").select(F.col("s").alias("fs"), F.col("m").alias("fm"), "f")
    own = own.join(freq, same("s", "fs") & (F.col("m") == F.col("fm")), "left").withColumn("f", F.coalesce("f", F.lit(1)))
    lists = own.groupBy("s", "i").agg(F.array_sort(F.collect_list(F.struct("f", "m"))).alias("p"), F.count_if(F.col("f") == 1).cast("int").alias("lone"))
    lists = keep(lists.select(F.col("s").alias("ls"), F.col("i").alias("li"), F.transform("p", lambda x: x["m"]).alias("ids"), "lone")).df

    # an id that occurs once is nobody's common id, so its shard is never built
    count = F.size("ids")
    prefix = (count - F.ceil(F.round(count * F.lit(similarity), 6)) + 1).cast("int")
    listed = lists.join(keys, same("ls", "ks") & (F.col("li") == F.col("ki"))).select("ls", "li", "ids", "lone", "n", *sig)
    none = F.lit(0).cast("long")
    first = listed.select(F.col("ls").alias("s"), F.col("li").alias("i"), "n", *sig, "lone", F.posexplode(F.slice("ids", 1, prefix)).alias("at", "h1")).where("at >= lone")
    first = keep(first.select("s", F.lit(1).alias("level"), "h1", none.alias("h2"), "i", "n", *sig, "at")).df
    place = ["s", "level", "h1", "h2"]

    def counted(shards: DataFrame) -> DataFrame:
        """Shards of two records or more, with their number of records."""
        size = shards.groupBy(*place).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*[F.col(c).alias(f"c_{c}") for c in place], "c")
        return shards.join(size, same("s", "c_s") & (F.col("level") == F.col("c_level")) & (F.col("h1") == F.col("c_h1")) & (F.col("h2") == F.col("c_h2"))).drop(*[f"c_{c}" for c in place])

    known = keep(counted(first), hot=F.max("c"))
    shards = known.df.drop("at")
    if similarity > 0.5 and (known.stats["hot"] or 0) > tree:
        hot = known.df.where(F.col("c") > tree).drop("c", "h2", "level")
        cut = hot.join(lists, same("s", "ls") & (F.col("i") == F.col("li")))
        later = F.slice("ids", F.greatest(F.col("at"), F.col("lone")) + 2, F.greatest(prefix - F.col("at"), F.lit(0)))
        second = cut.select("s", F.lit(2).alias("level"), "h1", F.explode(later).alias("h2"), "i", "n", *sig)
        shards = shards.where(F.col("c") <= tree).unionByName(counted(second))
    if (reps.stats["most"] or 0) > large:
        step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / similarity)))
        big = keys.where(F.col("n") >= large * similarity).withColumn("h1", F.explode(F.array(step, step + 1)))
        shards = shards.unionByName(counted(big.select(F.col("ks").alias("s"), F.lit(0).alias("level"), "h1", none.alias("h2"), F.col("ki").alias("i"), "n", *sig)))

    placed = shards.withColumn("cuts", F.ceil(F.col("c") / tree).cast("int"))
    one, all_cuts = F.pmod(F.xxhash64("i"), F.col("cuts")).cast("int"), F.sequence(F.lit(0), F.col("cuts") - 1)
    query = placed.withColumn("block", one).withColumn("tree", F.explode(all_cuts)).withColumn("role", F.lit(0))
    node = placed.withColumn("tree", one).withColumn("block", F.explode(all_cuts)).withColumn("role", F.lit(1))
    work = query.unionByName(node).drop("cuts")
    work = work.repartition(*place, "tree", "block").sortWithinPartitions(*place, "tree", "block", "n", "i", "role")
    kind = rows.schema["s"].dataType.simpleString()
    found = keep(work.mapInArrow(_walk(similarity, forest), f"s {kind}, a long, b long").distinct()).df

    of = lambda side: lists.select(F.col("ls").alias(f"s{side}"), F.col("li").alias(f"i{side}"), F.col("ids").alias(f"ids_{side}"))
    both = found.join(of("a"), same("s", "sa") & (F.col("a") == F.col("ia")), "left").join(of("b"), same("s", "sb") & (F.col("b") == F.col("ib")), "left")
    small = both.where("ids_a IS NOT NULL AND ids_b IS NOT NULL")
    shared = small.select("s", "a", "b", F.size(F.array_intersect("ids_a", "ids_b")).cast("long").alias("shared"), F.size("ids_a").alias("na"), F.size("ids_b").alias("nb"))
    if (reps.stats["most"] or 0) > large:
        rest = both.where("ids_a IS NULL OR ids_b IS NULL").select("s", "a", "b")
        a = rows.select(F.col("s").alias("as"), F.col("i").alias("ai"), "m")
        b = rows.select(F.col("s").alias("bs"), F.col("i").alias("bi"), F.col("m").alias("bm"))
        met = rest.join(a, same("s", "as") & (F.col("a") == F.col("ai"))).join(b, same("s", "bs") & (F.col("b") == F.col("bi")) & (F.col("m") == F.col("bm")))
        met = met.groupBy("s", "a", "b").agg(F.count(F.lit(1)).alias("shared"))
        for side in ("a", "b"):
            z = keys.select(F.col("ks").alias(f"s{side}"), F.col("ki").alias(f"i{side}"), F.col("n").cast("int").alias(f"n{side}"))
            met = met.join(z, same("s", f"s{side}") & (F.col(side) == F.col(f"i{side}")))
        shared = shared.unionByName(met.select("s", "a", "b", "shared", "na", "nb"))
    alike = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    pairs = shared.select("s", "a", "b", "shared", alike.alias("similarity")).where(F.col("similarity") >= similarity)
    return NearDuplicates(whole, keep(pairs).df)


def graph_records(bubbles: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (kind, id, member): the ids of both branches of a bubble, and the source ids of the links of a graph file."""
    none = F.array().cast("array<bigint>")
    branches = F.concat(F.coalesce("branch_a", none), F.coalesce("branch_b", none))
    of_bubbles = bubbles.select(F.lit("bubble").alias("kind"), F.col("bubble_id").alias("id"), F.explode(branches).alias("member"))
    return of_bubbles.unionByName(links.select(F.lit("graph").alias("kind"), F.col("graph_id").alias("id"), F.col("source_id").alias("member")))
