"""SimHash near-dedup by the generalised pigeonhole principle.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its shingles.
Two fingerprints link at `distance` or fewer differing bits. To find links:

1. Distinct fingerprints are taken first; copies of a text cost nothing further.
2. The 64 bits are grouped into parts so that correlated bits share a part
   (bit-pair counts over all fingerprints, grouped greedily).
3. Each part i gets a threshold t_i >= -1 with sum(t_i + 1) = distance + 1: a
   linked pair then differs in at most t_i bits of some part. The thresholds are
   the cheapest by dynamic programming over estimated candidate counts, which
   are counts of value pairs in each part over all fingerprints.
4. A fingerprint is dealt to a bucket for each part with t_i >= 0 (and each choice of
   t_i bits to ignore). Buckets are read sorted, as runs; inside one, candidates
   are verified by their differing bits and only a spanning forest of the links
   is emitted, never all pairs. In a long run, found members leave the search,
   so a dense group costs about one comparison a member. Keys of more than LONG
   fingerprints, by a count of all keys, are split: the bits that such a key doesn't fix
   are cut into distance + 1 pieces, of which a linked pair shares one whole, and a
   fingerprint is dealt to a bucket for each piece instead.
5. The links' components are found by distributed large-star/small-star steps.

The parts are made fewer and wider as fingerprints grow in number, so a bucket
holds few unrelated fingerprints at any size.

Defined cases: a text without words (null, empty) has fingerprint zero, linked like any
other; a bit that half the hashes have is 0; a very long text is hashed whole, in slices; a null doc_id has a fingerprint and takes part in links, and component_id is the
smallest id that isn't null; repeated rows are linked to each other; columns of
the names that the operator adds are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchkit.llm import kernels
from searchkit.llm.blocks import BLOCK_BYTES, Lookup, with_found
from searchkit.llm.common import checkpoint, table, without
from searchkit.llm.components import components

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Runs up to this long are compared all to all at once; longer ones member by member.
SHORT_RUN = 48
#: Fingerprints of a key beyond which it is split.
LONG = 4_000
_U = np.uint64


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprints of some documents (uint64)."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    digest = xxhash.xxh64_intdigest
    for a, b in kernels.slices(offsets):
        low = kernels.LOWER[data[offsets[a] : offsets[b]]]
        w = kernels.Words(low, offsets[a : b + 1] - offsets[a])
        n = np.diff(w.first)
        if not len(w):
            continue
        size = w.ends - w.starts
        at = np.cumsum(size + 1) - (size + 1)
        joined = np.full(int(size.sum()) + len(w), 0x20, np.uint8)
        inner = np.arange(int(size.sum()))
        joined[inner + np.repeat(np.arange(len(w)), size)] = low[inner + np.repeat(w.starts - (np.cumsum(size) - size), size)]
        text = joined.tobytes()
        shingles = np.maximum(n - shingle + 1, n > 0)
        some = np.flatnonzero(shingles)
        heads = np.cumsum(shingles)[some] - shingles[some]
        first = np.repeat(w.first[:-1], shingles) + np.arange(int(shingles.sum())) - np.repeat(np.cumsum(shingles) - shingles, shingles)
        last = np.minimum(first + shingle, np.repeat(w.first[1:], shingles)) - 1
        for x in range(0, len(some), 256):
            docs = some[x : x + 256]
            lo = int(heads[x])
            hi = int(heads[x + len(docs)]) if x + len(docs) < len(some) else len(first)
            for start in range(lo, hi, 1 << 20):
                stop = min(start + (1 << 20), hi)
                s, e = at[first[start:stop]].tolist(), (at[last[start:stop]] + size[last[start:stop]]).tolist()
                h = np.fromiter((digest(text[i:j], seed) for i, j in zip(s, e, strict=True)), np.uint64, stop - start)
                bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                cuts = np.clip(heads[x : x + len(docs)], start, stop) - start
                if start == lo:
                    counts = np.zeros((len(docs), 64), np.int64)
                ends = np.append(cuts[1:], stop - start)
                for k in np.flatnonzero(ends > cuts).tolist():
                    counts[k] += bits[cuts[k] : ends[k]].sum(axis=0, dtype=np.int32)
            major = 2 * counts > shingles[docs][:, None]
            out[a + docs] = np.packbits(major, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """docs with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(*kernels.flat(batch.column(batch.schema.names.index(text_col))), shingle)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], names=[*batch.schema.names, name])

    docs = without(docs, [name])
    return docs.mapInArrow(run, T.StructType(docs.schema.fields + [T.StructField(name, T.LongType())]))


# Parts and thresholds.


def _bit_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((65, 65), np.int64)
    for batch in batches:
        fp = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
        for a in range(0, len(fp), 50_000):
            bits = np.unpackbits(fp[a : a + 50_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            x = np.column_stack([bits, np.ones(len(bits), np.uint8)]).astype(np.float32)
            total += (x.T @ x).astype(np.int64)
    i, j = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "n"])


def group_bits(pairs: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of almost equal width in which correlated bits are together; pairs[i, j] counts fingerprints with both bits."""
    n = max(int(pairs[64, 64]), 1)
    p = np.diag(pairs)[:64] / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(pairs[:64, :64] / n - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, out = set(range(64)), []
    for k in range(parts):
        width = (64 - sum(map(len, out))) // (parts - k)
        rest = sorted(free)
        own = [rest[int(np.argmax(corr[np.ix_(rest, rest)].max(axis=1)))]]
        while len(own) < width:
            rest = sorted(free - set(own))
            own.append(rest[int(np.argmax(corr[np.ix_(rest, own)].sum(axis=1)))])
        free -= set(own)
        out.append(sorted(own))
    return out


def part_values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.int64)
    for j, b in enumerate(bits):
        out |= ((fp >> _U(b)) & _U(1)).astype(np.int64) << j
    return out


def allocate(cost: list[dict[int, float]], distance: int) -> list[int]:
    """The cheapest thresholds with sum(t + 1) = distance + 1; cost[i][t] for t >= 0 (-1, no probing, costs nothing)."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (price, ts) in best.items():
            for t, more in ((-1, 0.0), *c.items()):
                u = used + t + 1
                if u <= distance + 1 and (u not in step or price + more < step[u][0]):
                    step[u] = (price + more, [*ts, t])
        best = step
    return best[distance + 1][1]


def _masks(bits: list[int], t: int) -> list[int]:
    """Which positions of a part a bucket ignores: each choice of t of them."""
    return [sum(1 << j for j in c) for c in combinations(range(len(bits)), t)]


def _costs(distinct: DataFrame, parts: list[list[int]], distance: int, n: int) -> list[dict[int, float]]:
    """Estimated work of each part and threshold: pairs that meet in its buckets, and the buckets' rows."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, bits in enumerate(parts):
                v, c = np.unique(part_values(fp, bits), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v), pa.array(c)], names=["part", "v", "n"])

    hist = distinct.mapInArrow(values, "part int, v long, n long").groupBy("part", "v").agg(F.sum("n").alias("n"))
    widest = max(map(len, parts))
    masked = hist.withColumn("j", F.explode(F.sequence(F.lit(-1), F.lit(widest - 1)))).withColumn("m", F.when(F.col("j") < 0, F.col("v")).otherwise(F.expr("v & ~shiftleft(1L, greatest(j, 0))")))
    met = masked.groupBy("part", "j", "m").agg(F.sum("n").alias("n")).groupBy("part", (F.col("j") >= 0).alias("t")).agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs"))
    pairs = {(r["part"], int(r["t"])): r["pairs"] for r in met.collect()}
    out = []
    for i, bits in enumerate(parts):
        zero, one = pairs.get((i, 0), 0.0), pairs.get((i, 1), 0.0)
        cost = {0: zero + 8.0 * n, 1: one + 8.0 * n * len(bits)}
        growth = max(one / max(zero, 1.0), 2.0)
        for t in range(2, distance + 1):
            cost[t] = one * growth ** (t - 1) + 8.0 * n * len(_masks(bits, t))
        out.append(cost)
    return out


# Buckets.


def _deal(parts: list[list[int]], thresholds: list[int]):
    keys = [(i, bits, _masks(bits, t)) for i, (bits, t) in enumerate(zip(parts, thresholds, strict=True)) if t >= 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0)
            fp = own.to_numpy(zero_copy_only=False).view(np.uint64)
            for i, bits, masks in keys:
                v = part_values(fp, bits)
                for k, mask in enumerate(masks):
                    key = (v & ~np.int64(mask)) | np.int64((i << 56) | (k << 36))
                    yield pa.RecordBatch.from_arrays([pa.array(key), own], names=["key", "fp"])

    return run


def _pieces(bits: list[int], mask: int, distance: int) -> list[list[int]]:
    """The bits that a key of a part doesn't fix, in distance + 1 pieces."""
    fixed = {b for j, b in enumerate(bits) if not mask >> j & 1}
    free = [b for b in range(64) if b not in fixed]
    return [free[k :: distance + 1] for k in range(distance + 1)]


def _split(parts: list[list[int]], thresholds: list[int], distance: int):
    """Of (key, fp, long): (key, fp), a long key's fingerprints by key and piece."""
    pieces = {(i << 20) | k: _pieces(bits, mask, distance) for i, (bits, t) in enumerate(zip(parts, thresholds, strict=True)) if t >= 0 for k, mask in enumerate(_masks(bits, t))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.compute.invert(batch.column(2))).select([0, 1])
            rows = batch.filter(batch.column(2))
            key, fp = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            bucket = key >> 36
            for of in np.unique(bucket).tolist():
                own = bucket == of
                for j, bits in enumerate(pieces[of]):
                    value = part_values(fp[own].view(np.uint64), bits).astype(np.uint64)
                    mixed = kernels._mix(key[own].view(np.uint64) * _U(0x9E3779B97F4A7C15) + (value << _U(4)) + _U(j + 1)) | _U(1 << 63)  # no other key is negative
                    yield pa.RecordBatch.from_arrays([pa.array(mixed.view(np.int64)), pa.array(fp[own])], names=["key", "fp"])

    return run


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def _settle(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n, given links i < j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def forest(fp: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links inside one long run: found members leave the search."""
    rest = fp
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            x = queue.pop()
            hit = _near(rest, x, distance)
            if hit.any():
                found = rest[hit]
                rest = rest[~hit]
                yield found, np.full(len(found), root)
                queue.extend(found)


def _links(distance: int):
    """Of (key, fp) sorted by key: links that connect what the runs connect."""

    def solve(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(heads, len(key)))
        us, vs = [], []
        short = np.repeat((size > 1) & (size <= SHORT_RUN), size)
        left = np.repeat(heads + size, size) - np.arange(len(key)) - 1
        ii, jj = [], []
        for d in range(1, int(size[size <= SHORT_RUN].max(initial=1))):
            i = np.flatnonzero(short & (left >= d))
            if not len(i):
                break
            i = i[_near(fp[i], fp[i + d], distance)]
            ii.append(i)
            jj.append(i + d)
        if ii:
            i, j = np.concatenate(ii), np.concatenate(jj)
            if len(i):
                label = _settle(len(fp), i, j)
                moved = np.flatnonzero(label != np.arange(len(fp)))
                us.append(fp[moved])
                vs.append(fp[label[moved]])
        for h, s in zip(heads[size > SHORT_RUN].tolist(), size[size > SHORT_RUN].tolist(), strict=True):
            for u, v in forest(fp[h : h + s], distance):
                us.append(u)
                vs.append(v)
        if us:
            u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
            pairs = np.unique(np.column_stack([np.maximum(u, v), np.minimum(u, v)]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, parts = np.zeros(0, np.int64), np.zeros(0, np.uint64), []
        held = 0
        for batch in batches:
            parts.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            held += batch.num_rows
            if held < 200_000:
                continue
            key, fp = (np.concatenate(x) for x in zip((key, fp), *parts, strict=True))
            parts, held = [], 0
            cut = int(np.searchsorted(key, key[-1]))  # the last run may go on
            if cut:
                yield from solve(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        key, fp = (np.concatenate(x) for x in zip((key, fp), *parts, strict=True))
        if len(key):
            yield from solve(key, fp)

    return run


def link(distinct: DataFrame, distance: int = DISTANCE, parts: int | None = None, long: int = LONG) -> DataFrame:
    """(node, root) for the distinct fingerprints (column fp) that have a link; root is the smallest of the component."""
    n = distinct.count()
    parts = parts or (4 if n <= 1 << 24 else 3 if n <= 1 << 31 else 2)
    pairs = np.zeros((65, 65), np.int64)
    for r in distinct.mapInArrow(_bit_pairs, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        pairs[r["i"], r["j"]] = r["n"]
    groups = group_bits(pairs, parts)
    thresholds = allocate(_costs(distinct, groups, distance, n), distance)
    dealt = distinct.mapInArrow(_deal(groups, thresholds), "key long, fp long")
    hot = checkpoint(dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > long).select("key", F.lit(True).alias("long")))
    if hot.limit(1).count():
        dealt = checkpoint(dealt).join(hot, "key", "left").select("key", "fp", F.coalesce("long", F.lit(False)).alias("long"))
        dealt = dealt.mapInArrow(_split(groups, thresholds, distance), "key long, fp long")
    shuffled = dealt.repartition("key").sortWithinPartitions("key", "fp")
    return components(shuffled.mapInArrow(_links(distance), "u long, v long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row (id, _key, fp, component_id) for each row of docs; _key is a hash of id and text."""
    key = F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col)).alias("_key")
    rows = checkpoint(with_fingerprint(docs.select(F.col(id_col).alias("_id"), key, F.col(text_col).alias("_text")), "_text", "fp", shingle).drop("_text"))
    distinct = checkpoint(rows.groupBy("fp").agg(F.min("_id").alias("_least")))
    linked = link(distinct.select("fp"), distance).withColumnsRenamed({"node": "fp"})
    rooted = checkpoint(distinct.join(linked, "fp", "left").select("fp", "_least", F.coalesce("root", "fp").alias("_root")))
    least = checkpoint(rooted.groupBy("_root").agg(F.min("_least").alias("component_id")))
    by_fp = checkpoint(rooted.join(least, "_root").select("fp", "_root", "component_id"))
    return rows.join(by_fp, "fp").withColumnRenamed("_id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each component: that of the smallest id (nulls last; among rows of that id, one)."""
    found = near_duplicates(docs, id_col, text_col, shingle, distance).select(F.col(id_col).alias("_id"), "_key", "_root")
    return keep_chosen(docs, found, "_root", id_col, text_col)


def keep_chosen(docs: DataFrame, found: DataFrame, group: str, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with one row of each group of found (_id, _key, group).

    The keys of what goes are looked up in the scan, in blocks of bounded size, so no text is shuffled,
    but for rows of a chosen document that are equal in id and text.
    """
    docs = without(docs, ["_key", "_found", "_mark"])
    found = checkpoint(found.select("_id", "_key", group))
    chosen = found.groupBy(group).agg(F.min(F.struct(F.col("_id").isNull().alias("a"), F.col("_id").alias("b"), F.col("_key").alias("c"))).alias("x"))
    keys = checkpoint(chosen.select(F.col("x.c").alias("_key")).distinct())
    removed = found.select("_key").distinct().join(keys, "_key", "left_anti").select(F.col("_key").alias("key"), F.lit(1).alias("value"))
    repeated = found.join(keys, "_key", "left_semi").groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("_key").alias("key"), F.lit(2).alias("value"))
    marks = checkpoint(removed.unionByName(repeated))
    marked = with_found(docs.withColumn("_key", F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col))), Lookup(marks, block_bytes), "_key", "_found", "_mark")
    kept = marked.where("not _found")
    if marks.where("value = 2").limit(1).count():
        kept = kept.unionByName(marked.where("_mark = 2").dropDuplicates(["_key"]))
    return kept.select(*docs.columns)


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")
