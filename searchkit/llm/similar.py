"""SimHash near-dedup, and beyond it a similarity of word shingles, for stages that must catch edited copies.

With a `distance`, the links of `simhash` come first: texts whose fingerprints differ in so
many bits or fewer, found by the generalised pigeonhole principle over groups of correlated
bits with allocated thresholds. Their components are known before anything else is
compared, and only what could join two of them is looked at further.

Copies that share four fifths of their shingles differ in about ten of 64 SimHash
bits, and bits spread that thin can't be found by parts of one fingerprint. Here a
fingerprint has PARTS more parts, each the hash of the shingle that is smallest in the
part's own order, so that all bits of a part agree together, with the probability of
the similarity itself: correlated bits are one part by construction. By the pigeonhole
principle a pair that differs in at most PARTS - 1 parts shares one, so each part is
probed with threshold 0; at a similarity of 0.8 a pair shares none with probability
0.2 ** PARTS. What shares a part is verified exactly on its set of shingles, nearest
64-bit SimHash first; pairs that can't be similar are left out by their sizes and by
the rarest shingles of each set, which similar sets can't but share.

Texts with one set of shingles are one node, so exact copies cost nothing further. What
shares a part value of up to HOT nodes (and GRAMS shingles) meets in one bucket, where
found members leave the search and only a spanning forest is emitted. A part value of more
(a group of very many copies, or a passage that many texts share) isn't gathered:

1. Its members are verified against its smallest node, where they are. That links most of
   a group of copies. Components of all links so far are found (`components`).
2. What shares a passage, but isn't similar, would still meet too often. All members of large
   values are therefore compared by prefixes: in any one order of all shingles, two sets of the
   similarity share one of the first size - ceil(similarity * size) + 1. The order takes
   shingles that are rare among these members first, by exact counts, so common passages
   come last. Only buckets in which components differ are looked at, and buckets of the same
   members once. This loses no pair.
   A set isn't dealt to a bucket in which, by its size and the shingles that only it has, no set
   can be similar to it.
3. Where even such a bucket is large, its main component and the other members are cut into
   pieces, and each piece of others meets every piece in a bucket of its own. Rows are
   members * pieces of others: the square of their number only where very many texts agree in
   over four fifths of themselves with a passage, and still aren't similar to each other.

Defined cases: a text without words (null, empty) has an empty set and fingerprint zero, and all of these are one
group; a text of fewer words than a shingle is one shingle; a null id takes part like any
other, and where an id must be chosen nulls come last; repeated rows are one node, and
of a group one row stays; ties in rarity go to the smaller hash; a very long text is
one set, verified in pairs beyond GRAMS shingles; extra columns stay, a column named
_key is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchkit.llm import kernels
from searchkit.llm.blocks import BLOCK_BYTES, Blocks, Lookup, gathered, with_found
from searchkit.llm.common import checkpoint, release, small_batches
from searchkit.llm.components import components
from searchkit.llm.simhash import fingerprints, keep_chosen, link

SHINGLE, SIMILARITY, PARTS = 5, 0.8, 6
#: Nodes, or shingles in all, of a bucket beyond which it isn't gathered.
HOT, GRAMS = 500, 2_000_000
#: Members of large values with a shingle beyond which it counts as common.
COMMON = 50
#: Shingles that a task sorts at once.
SORTED = 1_000_000
#: Shingles of a bucket beyond which its sets are ordered by hash instead of by rarity.
ORDERED = 4_000_000
_U = np.uint64
SCHEMA = "_id {id}, _key long, c long, fp long, parts array<long>, grams binary"


def sketches(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each document: a hash of its shingle set, its SimHash, its parts, and the set as sorted 32-bit hashes."""
    n_docs = len(offsets) - 1
    content, fp, least = np.zeros(n_docs, np.uint64), np.zeros(n_docs, np.uint64), np.zeros((n_docs, parts), np.uint64)
    sets: list[np.ndarray] = [np.zeros(0, np.uint32)] * n_docs
    for a, b in kernels.slices(offsets, 1 << 20):
        w = kernels.Words(kernels.LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a])
        whole = kernels.gram_hashes(w.hashes, shingle)
        for d in range(b - a):
            lo, hi = int(w.first[d]), int(w.first[d + 1])
            if hi == lo:
                continue
            h = np.unique(whole[lo : hi - shingle + 1]) if hi - lo >= shingle else kernels.gram_hashes(w.hashes[lo:hi], hi - lo)
            x = a + d
            sets[x] = np.unique((h >> _U(32)).astype(np.uint32))
            content[x] = h.sum(dtype=np.uint64)
            counts = np.zeros(64, np.int64)
            for i in range(0, len(h), 1 << 16):
                counts += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            fp[x] = np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0]
            for p in range(parts):
                least[x, p] = ((h ^ _U(0x9E3779B97F4A7C15 * (p + 1) & 0xFFFFFFFFFFFFFFFF)) * _U(0xD6E8FEB86659FD93)).min()
    return content, fp, least, sets


def _sketch(shingle: int, parts: int, own_fp: bool):
    """Of (_id, _key, text): SCHEMA; the fingerprint is of `simhash`, or of the set where own_fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernels.flat(batch.column(2))
            content, fp, least, sets = sketches(data, offsets, shingle, parts)
            fp = fp if own_fp else fingerprints(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fp) + 1, dtype=np.int32) * parts), pa.array(least.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(content.view(np.int64)), pa.array(fp.view(np.int64)), lists, pa.array([s.tobytes() for s in sets], pa.binary())], names=["_id", "_key", "c", "fp", "parts", "grams"])

    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 1.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def _prefixes(sets: list[np.ndarray], sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of each set in one order for all, (set, shingle): sets of the similarity share one of these.

    They share at least similarity * size shingles, so one of the first size - that + 1.
    """
    length = np.maximum(sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1, 0)
    if int(sizes.sum()) > ORDERED:
        return np.repeat(np.arange(len(sets)), np.minimum(length, sizes)), np.concatenate([s[:n] for s, n in zip(sets, length.tolist(), strict=True)])
    doc = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    _, gram, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((gram, n[gram], doc))
    gram = gram[order]
    keep = (np.arange(len(gram)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < length[doc]) & (n[gram] > 1)
    return doc[keep], gram[keep]


def forest(node: np.ndarray, fp: np.ndarray, sets: list[np.ndarray], linked: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """A spanning forest of the similar pairs of one bucket; linked members are known to be one component."""
    sizes = np.array([len(s) for s in sets])
    few = len(sets) <= 8
    if not few:
        doc, gram = _prefixes(sets, sizes, similarity)
        begin = np.searchsorted(doc, np.arange(len(sets) + 1))
        order = np.argsort(gram, kind="stable")
        by_gram, held = gram[order], doc[order]
        lo, hi = np.searchsorted(by_gram, gram), np.searchsorted(by_gram, gram, side="right")

    def near(among: np.ndarray, x: int) -> Iterator[int]:
        if not few:
            alive = np.zeros(len(sets), bool)
            for i in range(begin[x], begin[x + 1]):
                alive[held[lo[i] : hi[i]]] = True
            among = among[alive[among]]
        among = among[np.minimum(sizes[among], sizes[x]) >= similarity * np.maximum(sizes[among], sizes[x]) - 1e-9]
        among = among[np.argsort(np.bitwise_count(fp[among] ^ fp[x]), kind="stable")]
        return (i for i in among.tolist() if node[i] == node[x] or jaccard(sets[i], sets[x]) >= similarity)

    rest, one = np.flatnonzero(~linked), np.flatnonzero(linked)
    for x in rest.tolist() if len(one) else ():
        for i in near(one, x):
            yield int(node[x]), int(node[i])
            break
    while len(rest) > 1:
        root, rest = int(rest[0]), rest[1:]
        queue = [root]
        while queue and len(rest):
            found = list(near(rest, queue.pop()))
            if found:
                rest = rest[~np.isin(rest, found)]
                queue += found
                for i in found:
                    yield int(node[i]), int(node[root])


def _links(similarity: float):
    """Of (key, node, fp, grams, linked) sorted by key: links that connect what is similar in a bucket."""

    def solve(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        node, fp, grams, linked = zip(*rows, strict=True)
        if not all(linked) and len(set(node)) > 1:
            yield from forest(np.array(node, np.int64), np.array(fp, np.int64).view(np.uint64), [np.frombuffer(g, np.uint32) for g in grams], np.array(linked), similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for k, *row in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if k != key:
                    if len(rows) > 1:
                        out += solve(rows)
                    key, rows = k, []
                rows.append(row)
            if out:
                yield _edges(out)
        if len(rows) > 1 and (out := list(solve(rows))):
            yield _edges(out)

    return run


def _verify(pivots: Blocks, similarity: float):
    """Of (c, grams, pivots): the pairs (u, v) of a set and one of its pivots that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_pylist()
            sets = [np.frombuffer(g, np.uint32) for g in batch.column(1).to_pylist()]
            asked = batch.column(2).to_pylist()
            us, vs = [], []
            for known in pivots:
                for c, own, ps in zip(node, sets, asked, strict=True):
                    for p in ps:
                        other = known.get(p)
                        if other is not None and min(len(own), len(other)) >= similarity * max(len(own), len(other)) - 1e-9 and jaccard(own, other) >= similarity:
                            us.append(c)
                            vs.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _pivot_sets(held: DataFrame, pivots: DataFrame, block_bytes: int) -> Blocks:
    sets = checkpoint(held.join(pivots.withColumnRenamed("pivot", "c"), "c", "left_semi").select("c", "grams"))
    blocks = ({r["c"]: np.frombuffer(bytes(r["grams"]), np.uint32) for r in rows} for rows in gathered(sets, "grams", block_bytes))
    return Blocks(held.sparkSession, ((x, sum(g.nbytes + 100 for g in x.values())) for x in blocks))


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = (pa.array(x, pa.int64()) for x in zip(*sorted(set(pairs)), strict=True))
    return pa.RecordBatch.from_arrays([u, v], names=["u", "v"])


def _some(col: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows [a, b) of sets, of about `limit` shingles, with their shingles and sizes."""
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in col.to_pylist()])])
    for a, b in kernels.slices(offsets, limit):
        yield a, b, np.concatenate([np.frombuffer(col[i].as_py(), np.uint32) for i in range(a, b)]), np.diff(offsets[a : b + 1])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (grams): partial counts (key, n) of shingles."""
    held: list[np.ndarray] = []

    def emit() -> pa.RecordBatch:
        u, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(n)], names=["key", "n"])

    for batch in batches:
        for _, _, grams, _ in _some(batch.column(0), SORTED):
            held.append(grams)
            if sum(map(len, held)) > SORTED:
                yield emit()
    if held:
        yield emit()


def _first_grams(common: Lookup, similarity: float):
    """Of (c, grams, root): the shingles of each set's prefix (gram, c, size, root), those that aren't common first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, root = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for a, b, grams, sizes in _some(batch.column(1), SORTED):
                _, n = common.find(pa.array(grams.astype(np.int64)))
                row = np.repeat(np.arange(b - a), sizes)
                order = np.lexsort((grams, n, row))
                place = np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                keep = order[place < (sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1)[row]]
                yield pa.RecordBatch.from_arrays([pa.array(grams[keep].astype(np.int64)), pa.array(node[a + row[keep]]), pa.array(sizes[row[keep]]), pa.array(root[a + row[keep]])], names=["gram", "c", "size", "root"])

    return run


def _sets(rows: DataFrame, of: DataFrame, block_bytes: int) -> DataFrame:
    """(c, fp, grams) of the nodes in `of`, which are looked up in the scan: no other set moves, and copies are reduced to one in every task before they do."""
    lookup = Lookup(of.select(F.col("c").alias("key")).distinct().withColumn("value", F.lit(1)), block_bytes)
    found = with_found(rows.select("c", "fp", "grams"), lookup, "c", "_found", "_value").where("_found")
    return found.groupBy("c").agg(F.first("fp").alias("fp"), F.first("grams").alias("grams"))


def _meet(dealt: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) inside the buckets of (key, node, fp, grams, linked)."""
    rows = dealt.select("key", "node", "fp", "grams", "linked").repartition("key").sortWithinPartitions("key", "node")
    return rows.mapInArrow(_links(similarity), "u long, v long")


def _once(rows: DataFrame, key: str, *also: str) -> DataFrame:
    """One key of all that have the same members (rows of key and c), with `also`."""
    marks = F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "c")).alias("y")
    each = rows.groupBy(key).agg(F.count("*").alias("m"), *marks, *[F.first(c).alias(c) for c in also])
    return each.groupBy("m", "x", "y").agg(F.min(F.struct(key, *also)).alias("k")).select("k.*", "m")


def _beyond_parts(held: DataFrame, linked: DataFrame, similarity: float, hot: int, grams: int, common: int, block_bytes: int) -> DataFrame:
    """Links (u, v) between components, by prefixes, of `held` (c, fp, grams), members of large part values; linked: (node, root)."""
    counted = held.select("grams").mapInArrow(_count_grams, "key long, n long").groupBy("key").agg(F.sum("n").alias("value")).where(F.col("value") > common)
    lookup = Lookup(counted, block_bytes)
    rooted = checkpoint(held.join(linked.withColumnsRenamed({"node": "c"}), "c", "left").withColumn("root", F.coalesce("root", "c")))
    first = rooted.select("c", "grams", "root").mapInArrow(_first_grams(lookup, similarity), "gram long, c long, size long, root long")
    # A shingle that no other prefix has can't be shared. What is left of a set bounds the sizes of the sets that it can be
    # similar to, and a bucket without such sizes isn't entered.
    own = first.groupBy("gram").agg(F.count("*").alias("m"), F.min("c").alias("c")).where("m = 1").groupBy("c").agg(F.count("*").alias("alone"))
    sizes = first.groupBy("gram").agg(F.count("*").alias("m"), F.min("size").alias("least"), F.max("size").alias("most"), F.min("root").alias("a"), F.max("root").alias("b"))
    # What is joined by shingle is written first, so that adaptive execution can split a shingle of very many sets.
    sizes = checkpoint(sizes.where("a <> b").select("gram", "least", "most"))
    left = F.col("size") - F.coalesce("alone", F.lit(0))
    fits = (F.col("least") <= left * (1 + similarity) / similarity - F.col("size") + 1e-9) & (F.col("most") >= F.col("size") * similarity - 1e-9)
    first = checkpoint(first.join(sizes, "gram").join(own, "c", "left").where(fits).select("gram", "c", "size", "root"))
    marks = F.xxhash64("c"), F.xxhash64(F.lit(1), "c")
    buckets = first.groupBy("gram").agg(F.count("*").alias("m"), F.sum("size").alias("g"), F.min("root").alias("a"), F.max("root").alias("b"), F.bit_xor(marks[0]).alias("x"), F.bit_xor(marks[1]).alias("y"))
    buckets = checkpoint(buckets.where("a <> b").groupBy("m", "g", "x", "y").agg(F.min("gram").alias("gram")).select("gram", "m", "g"))
    release(held.sparkSession)
    met = checkpoint(first.join(buckets, "gram").select("gram", "c", "root", "m", "g"))
    by_root = met.groupBy("gram", "root").agg(F.count("*").alias("n"), F.first("m").alias("m"), F.first("g").alias("g"))
    plan = by_root.groupBy("gram").agg(F.max(F.struct("n", "root")).alias("x"), F.first("m").alias("m"), F.first("g").alias("g"))
    chunk = F.greatest(F.lit(1), F.least(F.lit(max(1, hot // 2)), F.floor(grams * F.col("m") / F.greatest(2 * F.col("g"), F.lit(1)))))
    alone = (F.col("m") <= hot) & (F.col("g") <= grams)
    pieces = lambda n: F.when(alone, F.lit(1)).otherwise(F.ceil(n / chunk)).cast("long")
    plan = checkpoint(plan.select("gram", F.col("x.root").alias("main"), alone.alias("alone"), pieces(F.col("x.n")).alias("mains"), pieces(F.col("m") - F.col("x.n")).alias("others")))
    rows_met = met.select("gram", "c", "root").join(plan, "gram").withColumn("linked", F.col("root") == F.col("main"))
    place = F.xxhash64("gram", "c")
    mine = F.when(F.col("linked"), F.pmod(place, F.col("mains"))).otherwise(F.col("mains") + F.pmod(place, F.col("others")))
    last = F.col("mains") + F.col("others") - 1
    partners = F.when(F.col("alone"), F.array(F.lit(-1).cast("long"))).when(F.col("linked"), F.sequence(F.col("mains"), last)).otherwise(F.sequence(F.lit(0).cast("long"), last))
    dealt = rows_met.withColumn("mine", F.when(F.col("alone"), F.lit(-1).cast("long")).otherwise(mine)).withColumn("partner", F.explode(partners))
    key = F.xxhash64("gram", F.least("mine", "partner"), F.greatest("mine", "partner"))
    dealt = dealt.select("c", F.col("root").alias("node"), "linked", key.alias("key"))
    return _meet(dealt.join(held.select("c", "fp", "grams"), "c"), similarity)


def _near(rows: DataFrame, distance: int) -> DataFrame:
    """Links (u, v) of the nodes whose fingerprints `simhash` links, to the smallest of each component."""
    prints = checkpoint(rows.select("c", "fp").distinct())
    linked = link(checkpoint(prints.select("fp").distinct()), distance).withColumnsRenamed({"node": "fp"})
    rooted = checkpoint(prints.join(linked, "fp", "left").select("c", F.coalesce("root", "fp").alias("_root")))
    least = rooted.groupBy("_root").agg(F.min("c").alias("v"))
    return rooted.join(least, "_root").select(F.col("c").alias("u"), "v").where("u <> v")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, parts: int = PARTS, hot: int = HOT, grams: int = GRAMS, common: int = COMMON, block_bytes: int = BLOCK_BYTES, distance: int | None = None) -> DataFrame:
    """(_id, _key, group) of each row: group is the smallest node that the row's text reaches by similar pairs.

    With a distance, pairs of fingerprints that differ in so many bits or fewer count as well.
    """
    spark = docs.sparkSession
    small_batches(spark)
    key = F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col))
    own = docs.select(F.col(id_col).alias("_id"), key.alias("_key"), F.col(text_col).alias("_text"))
    rows = checkpoint(own.mapInArrow(_sketch(shingle, parts, distance is None), SCHEMA.format(id=own.schema["_id"].dataType.simpleString())))
    near = None if distance is None else checkpoint(_near(rows, distance))
    known = spark.createDataFrame([], "c long, root long") if near is None else checkpoint(components(near)).withColumnsRenamed({"node": "c"})
    release(spark)
    nodes = rows.select("c", (F.octet_length("grams") / 4).cast("long").alias("size"), "parts").distinct().join(known, "c", "left")
    nodes = nodes.select("c", F.coalesce("root", "c").alias("root"), "size", F.posexplode("parts").alias("p", "v"))
    # What is one component already has nothing to find.
    counts = nodes.groupBy("p", "v").agg(F.count("*").alias("m"), F.sum("size").alias("g"), F.min("root").alias("a"), F.max("root").alias("b"))
    counts = checkpoint(counts.where("a <> b").select("p", "v", "m", "g"))
    large = (F.col("m") > hot) | (F.col("g") > grams)
    probed = checkpoint(nodes.join(counts, ["p", "v"]).select("c", "root", F.xxhash64("p", "v").alias("key"), large.alias("large")))
    release(spark)
    # Copies share several parts: a bucket of the same members is looked at once.
    small = probed.where("not large")
    wanted = checkpoint(small.join(_once(small, "key").select("key"), "key").groupBy("c").agg(F.collect_set("key").alias("keys"), F.first("root").alias("root")))
    dealt = _sets(rows, wanted, block_bytes).join(wanted, "c").select(F.explode("keys").alias("key"), F.col("root").alias("node"), "fp", "grams", F.lit(False).alias("linked"))
    edges = checkpoint(_meet(dealt, similarity))
    edges = edges if near is None else edges.union(near)
    del dealt, wanted, small
    release(spark)
    members = probed.where("large").select("c", "key")
    any_large = members.limit(1).count() > 0
    if any_large:
        held = checkpoint(_sets(rows, members, block_bytes))
        pivots = members.groupBy("key").agg(F.min("c").alias("pivot"))
        pairs = members.join(pivots, "key").where("c <> pivot").groupBy("c").agg(F.collect_set("pivot").alias("pivots"))
        sets = _pivot_sets(held, pivots.select("pivot").distinct(), block_bytes)
        verified = held.select("c", "grams").join(pairs, "c")
        edges = edges.union(verified.mapInArrow(_verify(sets, similarity), "u long, v long"))
        del verified, pairs, pivots, members, probed
    linked = checkpoint(components(edges))
    if any_large:
        release(spark)
        joined = components(_beyond_parts(held, linked, similarity, hot, grams, common, block_bytes)).select(F.col("node").alias("root"), F.col("root").alias("_to"))
        moved = linked.join(joined, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
        # A root of `joined` that had no link before isn't in `linked`.
        alone = joined.join(linked, joined["root"] == linked["node"], "left_anti").select(F.col("root").alias("node"), F.col("_to").alias("root"))
        linked = checkpoint(moved.unionByName(alone))
        del held, joined
        release(spark)
    linked = linked.withColumnsRenamed({"node": "c", "root": "_root"})
    return rows.select("_id", "_key", "c").join(linked, "c", "left").select("_id", "_key", F.coalesce("_root", "c").alias("group"))


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each group: that of the smallest id (nulls last; among rows of that id, one)."""
    return keep_chosen(docs, similar_groups(docs, id_col, text_col, **options), "group", id_col, text_col)
