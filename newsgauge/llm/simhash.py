"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

Components of fingerprints. Two 64-bit fingerprints within d bits differ in at most d of m
blocks, so they agree on at least m - d whole blocks. Every choice of m - d blocks is a join
key; a pair is verified under the first choice on which it agrees, so it comes out once. With
m = 7 and d = 4 a key holds 27 or 28 bits and each fingerprint has 35 keys; a larger
``blocks`` gives longer keys and more of them, for corpora of billions of texts.

Scale: rows with equal fingerprints are collapsed before the join and expanded after
it. A key that very many different fingerprints share (``hot``) is not joined pair by
pair: two fingerprints are within 4 bits exactly if some 64-bit value is within 2 bits
of both, so each fingerprint of such a key is linked through the values around it,
which is linear in their number and finds the same components.

Near-duplicate texts. Texts of similarity 0.8 (shared share of their distinct five-word
shingles) differ in some 15 % of the bits of their fingerprints, ten of 64, too many for
whole blocks to agree, and blocks short enough to agree are shared by unlike texts the more of them
there are. drop_near_duplicates therefore takes blocks of a few bits of a 256-bit fingerprint and sets
beside each the least of the text's shingles under an order of its own: like texts have
the same least shingle as often as they share shingles, unlike ones hardly ever, so the number of keys of a text
(16 for a chance of 0.98 at the threshold) does not grow with the corpus. Where very many texts have one
least shingle, a passage that they all hold, their key is cut by more blocks of the fingerprint, as long as
the number of texts asks for and as many as keep the chance.

Pairs that share a key are held to a Hamming distance above the expected one, and then to the exact
similarity. Under each key every text meets the first one only, and the closest of these is
held to the similarity; what is linked so far is one component. Of the other meetings with a
first text, the closest between each two components is held to it too, and components are made
again. So a group of n near copies gives rows in proportion to n.

What is linked so far is nearly all, by chance. The rest is found exactly: shingles have one order for all
texts, the common ones last, and two texts of similarity s share one of the first n - ceil(s * n) + 1 of a text's n
shingles. Texts of different components that do are compared where their sizes, the places of what they share and
the parities of their shingles leave room for the similarity. Common shingles come from one text in sixteen; they
only set the order, any order finds the same pairs.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import first_of_each, materialize, slices
from .components import components

SEED = 42


def shingle_hashes(text: str | None, shingle: int):
    """XXH64 of a text's word shingles in order; a text of fewer words is one shingle, one without words has none."""
    import numpy as np
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= shingle:
        return np.array([digest(joined, SEED)] if found else [], np.uint64)
    ends = np.fromiter(map(len, found), np.int64, len(found)).cumsum() + np.arange(len(found))
    starts = [0, *(ends[: len(found) - shingle] + 1).tolist()]
    pairs = zip(starts, ends[shingle - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[i:j], SEED) for i, j in pairs), np.uint64, len(starts))


def majority(hashes) -> int:
    """Signed 64-bit integer of the bits that more than half of the hashes have; 0 for none."""
    import numpy as np

    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8)).view(">i8")[0])


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit SimHash of a text's word shingles; 0 if it has no word."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, fp (signed 64-bit), one row per input row, no shuffle."""
    thin = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = thin.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py(), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return thin.mapInArrow(run, f"doc_id {id_type}, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _block_masks(blocks: int) -> list[int]:
    sizes = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    return [((1 << n) - 1) << sum(sizes[:i]) for i, n in enumerate(sizes)]


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(_signed(v)).cast("bigint") for v in values])


def links(fps: DataFrame, distance: int = 4, blocks: int = 7, hot: int = 4096) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints within ``distance`` bits.

    fps: distinct values in column fp. Under hot keys an edge leads to the least of
    the fingerprints around a value and not to each of them; components are the same.
    """
    need = blocks - distance
    if need < 1:
        raise ValueError("blocks must exceed distance")
    each, chosen = _block_masks(blocks), list(combinations(range(blocks), need))
    masks = [sum(each[b] for b in c) for c in chosen]
    where = {c: i for i, c in enumerate(chosen)}
    keyed = fps.select("fp", F.posexplode(_longs(masks)).alias("c", "mask"))
    keyed = keyed.select("c", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    # counted by a partial aggregation and written, so that the join with a hot key can be split
    counts = materialize(keyed.groupBy("c", "key").agg(F.count("*").alias("n")).where("n > 1"), "key-counts")
    sharing = materialize(keyed.join(counts, ["c", "key"]), "sharing")

    cold = sharing.where(F.col("n") <= hot).select("c", "key", "fp")
    a, b = cold.alias("a"), cold.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    agree = sum(
        (F.when(x.bitwiseAND(F.lit(_signed(m))) == 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, m in enumerate(each)),
        F.lit(0),
    )
    first = []
    for pattern in range(1 << blocks):
        on = tuple(i for i in range(blocks) if pattern >> i & 1)[:need]
        first.append(where.get(on, -1))
    once = F.element_at(F.array(*[F.lit(i) for i in first]), agree + 1) == F.col("a.c")
    same = (F.col("a.c") == F.col("b.c")) & (F.col("a.key") == F.col("b.key"))
    near = (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(x) <= distance) & once
    pairs = a.join(b, same & near).select(F.col("b.fp").alias("u"), F.col("a.fp").alias("v"))

    reach = [0, *(1 << i for i in range(64))]
    for k in range(2, distance // 2 + 1):
        reach += [sum(1 << i for i in c) for c in combinations(range(64), k)]
    if distance % 2:
        raise ValueError("an even distance is needed")
    warm = sharing.where(F.col("n") > hot).select("fp").distinct()
    around = warm.select("fp", F.explode(_longs(reach)).alias("flip"))
    around = around.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    hub = F.min("fp").over(Window.partitionBy("at"))
    stars = around.withColumn("hub", hub).where("fp <> hub").select(F.col("fp").alias("u"), F.col("hub").alias("v"))
    return pairs.unionByName(stars.distinct())


def simhash_components(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    distance: int = 4,
    blocks: int = 7,
    hot: int = 4096,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, one row per input row.

    component_id is the smallest id reachable over links of at most ``distance``
    differing bits, the row's own included. Null and word-less texts have fingerprint
    zero and link like any other; texts of fewer words than a shingle are one shingle.
    Null ids stay null and never name a component unless all its ids are null. An
    empty input gives no rows; other columns are not read.
    """
    fps = materialize(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(links(nodes.select("fp"), distance, blocks, hot))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    # written first: a join right on an aggregation could not split a large component
    named = materialize(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "named")
    of = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(of, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: 64-bit words of the fingerprint that near-duplicate texts are compared by.
WORDS = 4
#: Bits of the fingerprint in a key, beside the least shingle.
KEY_BITS = 8
#: Texts of one key from which it is cut by further bits.
HOT = 4096
#: Bounds of sizes are taken this much wider than computed, since they are rounded.
SLACK = 1e-6
_MIX = 0x9E3779B97F4A7C15


def common_shingles(df: DataFrame, text_col: str, shingle: int, one_in: int = 16, most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, log2 of their counts) of shingles that several of one text in ``one_in`` hold: the most common ones, ``most`` at most."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = df.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0):
                grams = np.concatenate([np.unique(shingle_hashes(t, shingle)) for t in batch.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], ["gram"])

    counts = thin.mapInArrow(run, "gram bigint").groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    levels = materialize(counts.select("gram", F.floor(F.log2("n")).cast("int").alias("level")), "common")
    of_level = sorted(((r["level"], r["count"]) for r in levels.groupBy("level").count().collect()), reverse=True)
    sums = np.cumsum([0] + [n for _, n in of_level])
    least = [level for (level, _), upto in zip(of_level, sums[1:], strict=True) if upto <= most]
    held = levels.where(F.col("level") >= (least[-1] if least else 99)).toArrow()  # ``most`` rows of 12 bytes
    grams, level = held["gram"].to_numpy().view(np.uint64), held["level"].to_numpy()
    order = np.argsort(grams)
    return grams[order], level[order].astype(np.uint8)


def sketches(
    df: DataFrame, id_col: str, text_col: str, shingle: int, blocks: list[tuple[int, int]], common: tuple | None = None, similarity: float = 0.8
) -> DataFrame:
    """One row a row of df, no shuffle: name, doc_id, fp (WORDS long integers), keys (one a block), grams (distinct shingles as
    sorted integers), size (their number), rare (those of which texts of the similarity share one, rarest first), odd (of
    each of 256 parts of the shingles whether their number is odd).

    name is a digest of the id and the text, which finds the row again later. Shingles are compared by 32 bits of
    their hashes: of a text's thousands, one in a million meets another. common: see common_shingles.
    """
    shared = df.sparkSession.sparkContext.broadcast(common or (np.array([], np.uint64), np.array([], np.uint8)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = df.select(name_of(id_col, text_col).alias("name"), F.col(id_col).alias("doc_id"), text.alias("text"))
    id_type = thin.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = [np.uint64(_MIX * k & (1 << 64) - 1) for k in range(max(WORDS, len(blocks)))]
        numbers = np.array(salts[: len(blocks)], np.uint64)
        factors = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

        def mixed(x):
            x = x * factors[0]
            return (x ^ x >> np.uint64(32)) * factors[1]

        known, level = shared.value

        def rarest(h: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            rank = np.where(known[at] == h, level[at], 0) if len(known) else np.zeros(len(h), np.uint8)
            return h[np.lexsort((h, rank))[: len(h) - math.ceil(similarity * len(h) - SLACK) + 1]]

        def one(text: str) -> tuple[list[int], list[int], np.ndarray, int, np.ndarray, np.ndarray]:
            h = np.unique(shingle_hashes(text, shingle))
            odd = np.packbits((np.bincount((h & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).view(np.int64)
            fps = [majority(mixed(h ^ salt)) for salt in salts[:WORDS]]  # a word of its own from each mixing of the same hashes
            least = [mixed(h ^ ~salts[i]).min() if len(h) else np.uint64(0) for i in range(len(blocks))]
            cut = [np.uint64(fps[w] & m & (1 << 64) - 1) for w, m in blocks]
            keys = mixed(np.array(least, np.uint64) ^ mixed(np.array(cut, np.uint64) + numbers)).view(np.int64)
            return fps, keys.tolist(), np.unique(h.astype(np.uint32)).view(np.int32), len(h), rarest(h).view(np.int64), odd

        for whole in batches:
            for batch in slices(whole, 2):
                with np.errstate(over="ignore"):
                    fps, keys, grams, sizes, rare, odd = zip(*[one(t) for t in batch.column(2).to_pylist()], strict=True)
                columns = [pa.array(x, pa.list_(pa.int64())) for x in (fps, keys)] + [pa.array(grams, pa.list_(pa.int32())), pa.array(sizes, pa.int32())]
                columns += [pa.array(x, pa.list_(pa.int64())) for x in (rare, odd)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["name", "doc_id", "fp", "keys", "grams", "size", "rare", "odd"])

    return thin.mapInArrow(
        run, f"name string, doc_id {id_type}, fp array<bigint>, keys array<bigint>, grams array<int>, size int, rare array<bigint>, odd array<bigint>"
    )


def name_of(id_col: str, text_col: str) -> Column:
    """SHA-256 of a row's id and text; a null id differs from every other, a null text is empty."""
    given = F.col(id_col).cast("string")
    named = F.coalesce(F.concat(F.lit("="), F.length(given).cast("string"), F.lit(":"), given), F.lit("-"))
    return F.sha2(F.concat(named, F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))), 256)


def agreement(similarity: float) -> float:
    """Expected share of equal fingerprint bits of two texts that share this part of their shingles."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def drawn_blocks(bits: int, chance: float, recall: float, seed: int) -> list[tuple[int, int]]:
    """(word, mask) of each block of so many bits: as many blocks as make one of the given chance each succeed with the recall."""
    number = math.ceil(math.log(1 - recall) / math.log(1 - chance))
    rng = random.Random(seed)
    return [(k % WORDS, sum(1 << b for b in rng.sample(range(64), bits))) for k in range(number)]


def cut_keys(keyed: DataFrame, hot: int, similarity: float, recall: float) -> DataFrame:
    """keyed (key, fp, ...) with the keys that more than ``hot`` texts have cut by further blocks of their fingerprints.

    A key of n texts is cut by 2 * log2(n / hot) bits, as many times over as give a pair at the threshold the recall
    again. Texts that share a passage and no more agree in up to 0.7 of their bits, so such keys come down to some ``hot`` texts.
    """
    counts = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot), "hot-keys")
    most = counts.agg(F.max("n")).first()[0]
    if most is None:
        return keyed
    bits = F.least(F.ceil(2 * F.log2(F.col("n") / hot)).cast("int"), F.lit(40))
    sets = {}
    for size in range(1, min(40, math.ceil(2 * math.log2(most / hot))) + 1):
        drawn = drawn_blocks(size, agreement(similarity) ** size, recall, size)
        sets[size] = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(_signed(m)).cast("bigint").alias("m")) for w, m in drawn])
    drawn = F.create_map(*[x for size, blocks in sets.items() for x in (F.lit(size), blocks)])
    none = F.array(F.struct(F.lit(0).alias("w"), F.lit(0).cast("bigint").alias("m")))
    each = F.coalesce(F.try_element_at(drawn, bits), none)
    # counts has a row for each hot key only: fewer than the rows by a factor of hot
    cut = keyed.join(counts, "key", "left").select("*", F.posexplode(each).alias("cut_no", "cut"))
    part = F.get("fp", F.col("cut.w")).bitwiseAND(F.col("cut.m"))
    key = F.when(F.col("n").isNull(), F.col("key")).otherwise(F.xxhash64("key", "cut_no", part))
    return cut.withColumn("key", key).drop("n", "cut_no", "cut")


def _distance(a: Column, b: Column) -> Column:
    return sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(WORDS)), F.lit(0))


def pairs_left(rows: DataFrame, rooted: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of different components (rooted: node, root); every pair of at least the similarity is among them.

    rows: node, size, rare, odd (see sketches). Under each key the texts of the component that most of its texts
    are in meet the others only, so a group of near copies is not compared with itself.
    """
    place = F.shiftleft(F.col("size").cast("bigint"), 32) + F.col("at")  # one number: what is shuffled is a row a key
    each = rows.select("node", "size", F.posexplode("rare").alias("at", "key")).select("key", "node", place.alias("place"))
    shared = each.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").drop("n")
    placed = materialize(materialize(shared, "sharing").join(rooted.select("node", "root"), "node"), "placed")
    most = placed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("parts")
    )
    mixed = materialize(placed.join(most.where("parts > 1").drop("parts"), "key"), "mixed")
    size, at = F.shiftright("place", 32), F.col("place").bitwiseAND(F.lit((1 << 32) - 1))
    mixed = mixed.join(rows.select("node", "odd"), "node").select("key", "node", "root", "most", "odd", size.alias("size"), at.alias("at"))
    a, b = mixed.where("root <> most").alias("a"), mixed.alias("b")
    both, s = F.col("a.size") + F.col("b.size"), similarity
    meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root"))
    meet = meet & ((F.col("b.root") == F.col("b.most")) | (F.col("a.node") < F.col("b.node")))
    meet = meet & (F.least("a.size", "b.size") >= s * F.greatest("a.size", "b.size") - SLACK)
    # a pair meets first at its rarest common shingle: at most what follows it in both is shared
    rest = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))
    meet = meet & (rest >= s / (1 + s) * both - SLACK)
    meet = meet & (_distance(F.col("a.odd"), F.col("b.odd")) <= (1 - s) / (1 + s) * both + SLACK)
    return a.join(b, meet).select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def near_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.98,
    hot: int = HOT,
) -> DataFrame:
    """name, node, doc_id, root, one row per distinct id and text: root names the component of near-duplicates.

    Two texts are near-duplicates if they share at least ``similarity`` of their distinct shingles (of
    ``shingle`` words, letters A-Z in lower case); texts without words are equal. Every such pair is linked, none below
    the threshold is; ``recall`` is the part that keys of least shingles find at it, the rest is found by rare shingles.
    Nodes are numbers that the rows get once their table is written, so no two texts have one.
    """
    blocks = drawn_blocks(KEY_BITS, similarity * agreement(similarity) ** KEY_BITS, recall, 0)
    rows = sketches(df, id_col, text_col, shingle, blocks, common_shingles(df, text_col, shingle), similarity)
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("node"), "*"), "sketches")

    def reach(bits: int, deviations: float) -> int:
        """The distance of this many bits that a pair at the threshold exceeds by so many deviations only."""
        expected = bits * (1 - agreement(similarity))
        return math.floor(expected + deviations * math.sqrt(expected * agreement(similarity)))

    within, within_word = reach(64 * WORDS, 2.5), reach(64, 3.5)
    grams = rows.select("node", "grams")
    # a row for each text and key, with one word of the fingerprint to check a meeting by
    every = rows.select("node", "fp", F.posexplode("keys").alias("c", "key"))
    every = cut_keys(every, hot, similarity, recall)
    every = every.select("key", "c", "node", F.get("fp", (F.col("c") + 1) % WORDS).alias("other"))

    def keyed(nodes: DataFrame, *more: str) -> DataFrame:
        return every.join(nodes.select("node", *more), "node") if more else every

    def close(a: str, b: str) -> Column:
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= within_word

    def similar(a: Column, b: Column) -> Column:
        shared = F.size(F.array_intersect(a, b))
        return shared >= F.lit(similarity) * (F.size(a) + F.size(b) - shared)

    def alike(pairs: DataFrame) -> DataFrame:
        both = pairs.select("u", "v").join(grams.toDF("u", "gu"), "u").join(grams.toDF("v", "gv"), "v")
        return materialize(both.where(similar(F.col("gu"), F.col("gv"))).select("u", "v"), "links")

    def roots(edges: DataFrame) -> DataFrame:
        found = rows.select("node", "fp").join(components(edges), "node", "left")
        return materialize(found.select("node", "fp", F.coalesce("root", "node").alias("root")), "roots")

    # each text and the first ones of its blocks; the closest of these is held to the similarity
    first = keyed(rows).groupBy("key").agg(
        F.min("node").alias("v"), F.min_by("other", "node").alias("first_other"), F.count("*").alias("n")
    )
    first = materialize(first.where("n > 1"), "firsts")
    near = keyed(rows).join(first, "key").where((F.col("node") != F.col("v")) & close("other", "first_other"))
    near = near.groupBy(F.col("node").alias("u"), "v").agg(F.min("n").alias("n"))
    near = near.join(rows.select(F.col("node").alias("u"), F.col("fp").alias("fu")), "u")
    near = near.join(rows.select(F.col("node").alias("v"), F.col("fp").alias("fv")), "v").withColumn("far", _distance(F.col("fu"), F.col("fv")))
    near = materialize(near.where(F.col("far") <= within).select("u", "v", "n", "far"), "near")
    links = alike(near.groupBy("u").agg(F.min(F.struct("far", "v"))["v"].alias("v")))

    # meetings with first ones across components: all where the block holds two texts, otherwise the closest of each pair of components
    def crossing(pairs: DataFrame, rooted: DataFrame) -> DataFrame:
        ru, rv = rooted.select(F.col("node").alias("u"), F.col("root").alias("ru")), rooted.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        return pairs.join(ru, "u").join(rv, "v").where("ru <> rv")

    across = materialize(crossing(near, roots(links)), "across")
    closest = across.where("n > 2").groupBy(F.least("ru", "rv"), F.greatest("ru", "rv")).agg(F.min(F.struct("far", "u", "v")).alias("p"))
    links = links.unionByName(alike(across.where("n = 2").select("u", "v").unionByName(closest.select("p.u", "p.v"))))

    # what is left between components, by rare shingles
    rest = alike(materialize(pairs_left(rows, roots(links), similarity), "left"))
    rooted = roots(links.unionByName(rest))
    return rows.select("name", "node", "doc_id").join(rooted.select("node", "root"), "node").dropDuplicates(["name"])


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of near-duplicate texts, that of the smallest id, with all columns of df.

    See near_components. Ids name documents: rows of one id and one text are one document,
    a null id is above every other. An empty input gives no rows.
    """
    found = near_components(df, id_col, text_col, **options)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("name").alias("name"))
    kept = found.groupBy("root").agg(F.min(place).alias("least")).select(F.col("least.name").alias("key"))
    return first_of_each(df, name_of(id_col, text_col), kept)
