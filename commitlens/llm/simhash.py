"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has the bits that are set in over half of its
shingles' 64-bit hashes. For a radius r, each bit position gets a nonzero vector
of r+1 bits; each nonzero vector v of r+1 bits gives a mask of the positions
whose vector has an odd product with v. Two fingerprints that differ in at most
r positions leave at least one v orthogonal to all of these, so they agree under
that mask: with 2^(r+1)-1 tables no pair within the radius is missed (31 tables
for r = 4, each keeping about half of the bits).

Copies collapse to one row per fingerprint (or text) first. Groups grow in rounds:
within each bucket of a table every member finds the least group that it links
to, over all buckets one such link per group is kept (an aggregate, so no more
links than members), and groups that link become one. The next round has only
members of groups that linked, until nothing links. So links stay in proportion
to the members, however dense a group is, and none is lost.

A bucket that is too large for one task is streamed through it in blocks, its
smallest groups first: each block meets itself and the first ``bucket_rows``
members, which is exact if only one group lies beyond these. Where more do, what is left between
them is found spread over the cluster: for links by the radius alone by shared points, as two fingerprints within r
both lie within r/2 of some point; for wide links by blocks of the bucket, every two of which meet, unless both are of one group.

Edge cases: a null text is empty; a text without words has fingerprint zero and
links like any other; null doc_ids count as larger than all others (a component
of none but nulls has a null id); rows that repeat give a row each; very long texts
are hashed in blocks; an empty table gives no rows. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitlens.llm.common import arrow_schema, cut, per_batch, release

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Members of one bucket that meet all others in one task.
BUCKET_ROWS = 4096
#: Rows that a task gathers before it looks at their buckets, and that meet at once.
CHUNK_ROWS, BLOCK = 1 << 16, 128
#: Where all members of a bucket meet: a block's rows, in ``bucket_rows``.
BLOCKS = 8


@dataclass(frozen=True)
class Rule:
    """Members link if one of their prints, first with first and so on, differs in at most ``radius`` bits.

    With ``wide`` those link too that meet in a bucket and differ in at most so many
    bits of that print and the next together. The masks keep about half of the first ``bits`` bits.
    """

    radius: int = RADIUS
    bits: int = BITS
    wide: int = -1
    bucket_rows: int = BUCKET_ROWS


#: The stage's: five-word shingles that overlap by 0.8 differ in about 19 of 128 bits, by 0.7 in 25, by 0.5 in 34.
STAGE_SHINGLE, STAGE_PRINTS, STAGE = 5, 8, Rule(bits=48, wide=20)


def fingerprints_of(text: str | None, shingle: int = SHINGLE, prints: int = 1, distinct: bool = False) -> list[int]:
    """Bits set in over half of the shingles' hashes; words are parted by ASCII white space, A-Z lower-cased.

    With ``distinct`` a shingle that repeats counts once, so that a line repeated over and over doesn't speak for the text. Further prints take the same hashes, each mixed anew, so that their errors are independent.
    """
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return [0] * prints
    joined, width = b" ".join(words), min(shingle, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    hashes = np.unique(hashes) if distinct else hashes
    found = []
    for number in range(prints):
        counts = np.zeros(BITS, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            bits = np.unpackbits(mixed(hashes[at : at + (1 << 16)], number).astype(">u8").view(np.uint8))
            counts += bits.reshape(-1, BITS).sum(0, dtype=np.int64)
        found.append(int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big"))
    return found


def mixed(hashes, number: int):  # noqa: ANN001, ANN201
    """The hashes themselves for number 0, else another hash of each (a finaliser of a 64-bit generator, offset by the number)."""
    import numpy as np

    if not number:
        return hashes
    x = hashes + np.uint64(number * 0x9E3779B97F4A7C15 % (1 << BITS))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, prints: int = 1, distinct: bool = False) -> DataFrame:
    """doc_id, hash1, hash2 (of the text), fps (the fingerprints as signed longs)."""

    def make() -> Callable:
        def rows(columns: list[list]) -> Iterator[tuple]:
            for doc_id, text, *hashes in zip(*columns, strict=True):
                yield doc_id, *hashes, list(map(signed, fingerprints_of(text, shingle, prints, distinct)))

        return rows

    return per_batch(docs.select("doc_id", "text", *text_hashes()), make, "doc_id long, hash1 long, hash2 long, fps array<long>")


def text_hashes() -> list[Column]:
    """128 bits: at billions of texts 64 would meet by chance."""
    return [F.xxhash64("text").alias("hash1"), F.xxhash64(F.lit(1), "text").alias("hash2")]


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2^(radius+1)-1 masks; any ``radius`` positions are left out together by at least one."""
    vectors = [1 + position % ((2 << radius) - 1) for position in range(bits)]
    return [sum(1 << p for p, u in enumerate(vectors) if (u & v).bit_count() & 1) for v in range(1, 2 << radius)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def in_buckets(members: DataFrame, prints: int, rule: Rule) -> DataFrame:
    """key, size, label, a, b: each member (label, size, fps) in each bucket that it belongs to, with that print and the next."""
    each = members.select("label", "size", F.explode(F.array(*(F.struct(F.lit(i).alias("print"), F.get("fps", F.lit(i)).alias("a"), F.get("fps", F.lit((i + 1) % prints)).alias("b")) for i in range(prints)))).alias("p"))
    keys = [F.xxhash64(F.col("p.a").bitwiseAND(F.lit(signed(mask))), F.lit(number), "p.print") for number, mask in enumerate(covering_masks(rule.radius, rule.bits))]
    return each.select(F.explode(F.array(*keys)).alias("key"), "size", "label", F.col("p.a").alias("a"), *([F.col("p.b").alias("b")] if rule.wide >= 0 else []))


def placed(members: DataFrame, prints: int, rule: Rule) -> DataFrame:
    """key, label, a, b as in ``in_buckets``, whole buckets in a task, their smallest groups first."""
    return in_buckets(members, prints, rule).repartition("key").sortWithinPartitions("key", "size", "label").drop("size")


def linked(own: list, others: list, rule: Rule):  # noqa: ANN201
    """Which of ``own`` (label, a, b) link to which of ``others`` of another label, as a matrix."""
    import numpy as np

    apart = [np.bitwise_count(x[:, None] ^ y[None, :]) for x, y in zip(own[1:], others[1:], strict=True)]
    near = apart[0] <= rule.radius
    if rule.wide >= 0:
        near |= apart[0] + apart[1] <= rule.wide
    near &= own[0][:, None] != others[0][None, :]
    return near


def bucket_links(rows: DataFrame, rule: Rule) -> DataFrame:
    """x, y, key: y is the least other label that label x links to; (x, null) for the labels of a bucket in which links may be left, and its key in a row of its own."""
    schema = arrow_schema(rows.sparkSession, "x long, y long, key long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        none = np.iinfo(np.int64).max

        def least_of(own: list, others: list):  # noqa: ANN202
            """Of each of ``own`` (key, label, a, b) the least other label among those of ``others`` that link to it."""
            found = np.empty(len(own[0]), np.int64)
            for at in range(0, len(found), BLOCK):
                near = linked([c[at : at + BLOCK] for c in own[1:]], others[1:], rule)
                found[at : at + BLOCK] = np.where(near, others[1][None, :], none).min(1, initial=none)
            return found

        def out(x, y=None) -> pa.RecordBatch:  # noqa: ANN001
            """Of each label the least it links to; without ``y``, the labels alone."""
            if y is None:
                x = np.unique(x)
                return pa.RecordBatch.from_arrays([pa.array(x), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.int64())], schema=schema)
            some = y < none
            x, y = x[some], y[some]
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))[: len(x)]
            return pa.RecordBatch.from_arrays([pa.array(x[first]), pa.array(y[first]), pa.nulls(len(first), pa.int64())], schema=schema)

        def settled(rows: list) -> Iterator[pa.RecordBatch]:
            """Whole buckets: the many small ones at once, by distance within them, the others each in blocks."""
            edges = np.concatenate([[0], np.flatnonzero(np.diff(rows[0])) + 1, [len(rows[0])]])
            sizes = np.diff(edges)
            least, of = np.full(len(rows[0]), none), np.repeat(sizes, sizes)
            few = [c[(of > 1) & (of <= 32)] for c in rows]
            found = np.full(len(few[0]), none)
            for step in range(1, 32):
                i = np.flatnonzero(few[0][step:] == few[0][:-step]) if len(few[0]) > step else few[0][:0]
                if not len(i):
                    break
                apart = [np.bitwise_count(c[i] ^ c[i + step]) for c in few[2:]]
                near = apart[0] <= rule.radius
                if rule.wide >= 0:
                    near |= apart[0] + apart[1] <= rule.wide
                i = i[near & (few[1][i] != few[1][i + step])]
                found[i] = np.minimum(found[i], few[1][i + step])
                found[i + step] = np.minimum(found[i + step], few[1][i])
            least[(of > 1) & (of <= 32)] = found
            for g in np.flatnonzero(sizes > 32).tolist():
                a, b = int(edges[g]), int(edges[g + 1])
                if b - a > rule.bucket_rows:
                    yield from Stream().feed([c[a:b] for c in rows])
                elif rows[1][a : b].min() < rows[1][a : b].max():
                    own = [c[a:b] for c in rows]
                    least[a:b] = least_of(own, own)
            yield out(rows[1], least)

        class Stream:
            """A bucket that passes block by block; its first rows are held and met by all."""

            def __init__(self) -> None:
                self.held: list = []
                self.beyond, self.left = None, False

            def feed(self, rows: list) -> Iterator[pa.RecordBatch]:
                for at in range(0, len(rows[0]), rule.bucket_rows):
                    block = [c[at : at + rule.bucket_rows] for c in rows]
                    room = rule.bucket_rows - (len(self.held[0]) if self.held else 0)
                    every = [np.concatenate(c) for c in zip(self.held, block, strict=True)] if self.held else block
                    if every[1].min() < every[1].max():
                        yield out(block[1], least_of(block, every))
                        if self.held:
                            yield out(self.held[1], least_of(self.held, block))
                    self.held = [c[: rule.bucket_rows] for c in every]
                    rest = block[1][room:]
                    if len(rest):
                        self.beyond = rest[0] if self.beyond is None else self.beyond
                        if not self.left and (rest != self.beyond).any():
                            self.left = True
                            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array(block[0][:1])], schema=schema)
                            yield out(np.append(self.held[1], self.beyond))
                        if self.left:
                            yield out(rest)

        stream, stream_key, parts, count = None, None, [], 0
        for batch in _and_last(batches):
            if batch is not None:
                key, label, *words = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                parts.append([key, label, *(w.view(np.uint64) for w in words)])
                count += batch.num_rows
                if count < CHUNK_ROWS:
                    continue
            if not count:
                continue
            rows = [np.concatenate(c) for c in zip(*parts, strict=True)]
            if stream:  # the rest of a bucket that is passing
                n = int(np.searchsorted(rows[0], stream_key, side="right"))
                yield from stream.feed([c[:n] for c in rows])
                rows, stream = [c[n:] for c in rows], stream if n == len(rows[0]) else None
            last = 0 if not len(rows[0]) else len(rows[0]) if batch is None else int(np.searchsorted(rows[0], rows[0][-1], side="left"))
            if last:
                yield from settled([c[:last] for c in rows])
            rows = [c[last:] for c in rows]
            if len(rows[0]) > rule.bucket_rows:
                stream, stream_key = Stream(), int(rows[0][0])
                yield from stream.feed(rows)
                rows = [c[:0] for c in rows]
            parts, count = [rows], len(rows[0])

    return rows.mapInArrow(run, "x long, y long, key long")


def _and_last(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def point_links(members: DataFrame, prints: int, rule: Rule) -> DataFrame:
    """x, y as in ``bucket_links`` for all members (label, fps), of any number, without comparing pairs.

    Each fingerprint goes to all points that differ from it in at most radius/2
    bits; at a point that several labels reach, the largest links to the least.
    """
    if rule.radius % 2:
        raise ValueError("an even radius is needed: two members of one point are then within it")
    flips = [signed(sum(1 << p for p in some)) for n in range(rule.radius // 2 + 1) for some in combinations(range(BITS), n)]
    each = members.select("label", F.posexplode(F.slice("fps", 1, prints)).alias("print", "fp"))
    distinct = each.groupBy("print", "fp").agg(F.min("label").alias("y"), F.max("label").alias("x"))
    points = distinct.select("x", "y", "print", "fp", F.explode(F.array(*map(F.lit, flips))).alias("flip"))
    ends = points.groupBy("print", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")).agg(F.max("x").alias("x"), F.min("y").alias("y")).filter("y < x")
    return ends.groupBy("x").agg(F.min("y").alias("y"))


def block_links(members: DataFrame, keys: DataFrame, prints: int, rule: Rule) -> DataFrame:
    """x, y as in ``bucket_links`` for all members (label, size, fps) of the buckets ``keys``, of any size.

    A bucket's rows, in groups, are cut into blocks, and each two blocks meet in a task, also a block
    and itself. Two that hold but one group don't, so a large group's rows meet others' only.
    """
    spark = members.sparkSession
    schema = arrow_schema(spark, "x long, y long")
    place = F.row_number().over(Window.partitionBy("key").orderBy("size", "label")) - 1
    rows = in_buckets(members, prints, rule).join(keys, "key", "left_semi").withColumn("block", (place / (BLOCKS * rule.bucket_rows)).cast("int"))
    rows = cut(rows.drop("size"))
    ends = rows.groupBy("key", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    one, two = (ends.select("key", *(F.col(c).alias(f"{c}{n}") for c in ("block", "low", "high"))) for n in (1, 2))
    pairs = one.join(two, "key").filter("block1 <= block2 and least(low1, low2) < greatest(high1, high2)")
    pairs = cut(pairs.select(F.monotonically_increasing_id().alias("pair"), "key", "block1", "block2"))
    first = pairs.select("key", F.col("block1").alias("block"), "pair", F.lit(False).alias("second"))
    sides = first.unionByName(pairs.filter("block1 < block2").select("key", F.col("block2").alias("block"), "pair", F.lit(True).alias("second")))

    def run(met: pa.Table) -> pa.Table:
        import numpy as np

        none = np.iinfo(np.int64).max
        second, label, *words = (met[c].to_numpy() for c in ("second", "label", "a", *(["b"] if rule.wide >= 0 else [])))
        every = [label, *(w.view(np.uint64) for w in words)]
        own = [c[~second] for c in every]
        others = [c[second] for c in every] if second.any() else own
        found = [np.full(len(own[0]), none), np.full(len(others[0]), none)]
        for i in range(0, len(own[0]), BLOCK):
            for j in range(0, len(others[0]), 4 * BLOCK):  # matrices that stay in the processor's cache
                a, b = ([c[at : at + n] for c in side] for side, at, n in ((own, i, BLOCK), (others, j, 4 * BLOCK)))
                near = linked(a, b, rule)
                if near.any():
                    for least, at, labels, hits in ((found[0], i, b[0], near), (found[1], j, a[0], near.T)):
                        some = np.flatnonzero(hits.any(1))
                        least[at + some] = np.minimum(least[at + some], np.where(hits[some], labels[None, :], none).min(1))
        x, y = np.concatenate([own[0], others[0]]), np.concatenate(found)
        x, y = x[y < none], y[y < none]
        return pa.Table.from_arrays([pa.array(x), pa.array(y)], schema=schema)

    # so many tasks: the rows are few for the work that they make, and few bytes would be gathered into one task
    tasks = max(1, min(pairs.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    met = rows.join(sides, ["key", "block"]).select("pair", "second", "label", *rows.columns[2:-1]).repartition(tasks, "pair")
    links = cut(met.groupBy("pair").applyInArrow(run, "x long, y long").groupBy("x").agg(F.min("y").alias("y")))
    release(rows)
    release(pairs)
    return links


def followed(links: DataFrame) -> DataFrame:
    """links (x, its one lesser y) with each y followed to where it ends; doubling, so a few steps."""
    now, more = links, True
    while more:
        ahead = now.select(F.col("x").alias("y"), F.col("y").alias("next"))
        last, now = now, cut(now.join(ahead, "y", "left").select("x", F.coalesce("next", "y").alias("y"), F.col("next").isNotNull().alias("moved")))
        more = not now.filter("moved").isEmpty()
        if last is not links:
            release(last)
    return now.select("x", "y")


def roots(members: DataFrame, prints: int, rule: Rule) -> DataFrame:
    """node, root: the least node that each of ``members`` (node, fps) reaches by links, where that isn't itself."""
    active, root, number = members.select(F.col("node").alias("label"), F.lit(1).alias("size"), "fps"), None, 0
    while True:
        number += 1
        found = cut(bucket_links(placed(active, prints, rule), rule).groupBy("x", "key").agg(F.min("y").alias("y"), F.max(F.col("y").isNull()).alias("left")))
        met, keys = found.filter("key is null").select("x", "y"), found.filter("key is not null").select("key")
        more = not keys.isEmpty()
        if more and number > 1:  # most of what was left in the first round has become one group since
            if rule.wide >= 0:  # all pairs of these buckets have met then
                met, rest = met.filter("y is not null"), block_links(active, keys, prints, rule)
            else:
                left = found.filter("left and key is null").select(F.col("x").alias("label"))
                rest = point_links(active.join(left, "label", "left_semi"), prints, rule)
            met = cut(met.unionByName(rest).groupBy("x").agg(F.min("y").alias("y")))
        links = met.filter("y < x")
        linked = not links.isEmpty()
        if not linked and (number > 1 or not more):
            break
        ends = followed(links) if linked else links
        if linked and root is not None:
            root = cut(root.join(ends.select(F.col("x").alias("y"), F.col("y").alias("next")), "y", "left").select("x", F.coalesce("next", "y").alias("y")).unionByName(ends))
        elif linked:
            root = ends
        # all that met another, or may have, go on; at a point the least does so as what the largest links to
        labels = met.select("x").unionByName(links.select(F.col("y").alias("x"))).distinct()
        names = cut(labels.join(ends, "x", "left").select(F.col("x").alias("label"), F.coalesce("y", "x").alias("name")))
        sized = names.join(active.select("label", "size").distinct(), "label").groupBy("name").agg(F.sum("size").alias("size"))
        last, active = active, cut(active.drop("size").join(names.join(sized, "name"), "label").select(F.col("name").alias("label"), "size", "fps"))
        for kept in (found, names, *([last] if number > 1 else [])):
            release(kept)
    return root.select(F.col("x").alias("node"), F.col("y").alias("root")) if root is not None else members.select("node", F.col("node").alias("root")).limit(0)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """doc_id, fp and component_id (the smallest doc_id that its fingerprint reaches) for each row."""
    marks = cut(fingerprints(docs, shingle)).select("doc_id", F.get("fps", F.lit(0)).alias("fp"))
    distinct = cut(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = roots(distinct.select(F.col("fp").alias("node"), F.array("fp").alias("fps")), 1, rule)
    grouped = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    linked = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marks.join(grouped.join(linked, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = STAGE_SHINGLE, prints: int = STAGE_PRINTS, rule: Rule = STAGE) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group its first row by doc_id (nulls last) stays.

    One fingerprint of 64 bits strays by more than ``radius`` for many copies
    with a few words changed, so texts have several independent ones here, and
    those that meet in a bucket link by a wider distance over two of them; they are of distinct shingles, whose overlap is meant. Of different
    texts with the first id the one with the least hash stays, of rows that repeat both, any one.
    """
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash1", "hash2")
    marks = cut(fingerprints(docs, shingle, prints, distinct=True))
    # 128 bits tell texts apart; nodes are numbered as they are written, so that a number is one text's
    texts = cut(marks.groupBy("hash1", "hash2").agg(F.min(row).alias("first"), F.first("fps").alias("fps")).select(F.monotonically_increasing_id().alias("node"), "first", "fps"))
    found = roots(texts.select("node", "fps"), prints, rule)
    grouped = texts.select("node", "first").join(found, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    first = grouped.groupBy("root").agg(F.min("first").alias("first")).select(*(F.col(f"first.{c}").alias(f"first_{c}") for c in ("doc_id", "hash1", "hash2")))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), *text_hashes())
    same = F.col("id").eqNullSafe(F.col("first_doc_id")) & (F.col("hash1") == F.col("first_hash1")) & (F.col("hash2") == F.col("first_hash2"))
    copies = Window.partitionBy("id", "hash1", "hash2").orderBy(F.lit(0))
    return rows.join(first, same, "left_semi").withColumn("copy", F.row_number().over(copies)).filter("copy = 1").select("row.*")
