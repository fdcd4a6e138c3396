"""Near duplicates by HyperMinHash sketches, banding and full-set verification.

1. Sketch: a document's distinct word shingles are 64-bit hashes. The top
   bits choose one of ``REGISTERS`` buckets; of the least hash in a bucket
   the register keeps the number of leading zeros (6 bits) and the next 10
   bits (mantissa). A bucket that got no shingle takes the least value of a
   hash of its own over the whole set, so a register of two documents
   agrees with a probability of their Jaccard similarity at every size.
2. Documents with equal shingle sets (128-bit digest and size) are one
   class, named by the smallest doc_id; only class representatives go on.
3. Bands of ``ROWS`` registers are hashed. At similarity 0.8 a pair misses
   all ``BANDS`` bands with a probability of 3e-6. A bucket is never
   expanded into rows of pairs: each member is linked with the smallest and
   the largest id of its bucket, found with map-side combining.
4. Candidates are filtered by the collision-corrected Jaccard estimate of
   their sketches (five standard errors of slack) and confirmed on the
   full sets, in two rounds: first one candidate per document, then the
   candidates whose ends are not in one component yet. A third round takes
   the members of buckets that still hold several components. Two sets of
   at least that similarity share one of the first shingles of each, in any
   order common to all (prefix filter; rare ones first by a table of counts of fixed size, which
   only decides the order). Members that meet so, in different components,
   whose sizes and places in the two sets leave room for enough common shingles, are estimated
   and confirmed like the others. So every two members of a bucket are
   compared, ruled out exactly or already in one component.
5. Components of confirmed links by alternating large-star / small-star.

Sketches and texts are read from tables; no pairs, links or components are
collected. Edge cases: null, empty and blank texts have an empty set and
link with nothing; a text with fewer words than a shingle is one shingle;
a row without doc_id keeps itself; rows that repeat a doc_id are one node;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import (
    U64, checkpointed, document_of, mix, shuffles_released, slices, span_hashes, text_bytes, word_spans,
)

BUCKET_BITS = 8
REGISTERS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
ROWS = 6
BANDS = REGISTERS // ROWS
SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=U64) * U64(0xA0761D6478BD642F))
#: bits of the id bitmap that spares unneeded texts a shuffle
BITMAP = 1 << 24
#: counters of shingles that order them in the third round
COUNTERS = 1 << 20
#: rows of a block of the third round
BLOCK_ROWS = 1024
#: a bucket's rows are dealt over so many keys of a join
SALTS = 8
SKETCH = "doc_id long, n_shingles long, set_high long, set_low long, sketch binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each document."""
    n = len(offsets) - 1
    starts, ends = word_spans(data, offsets)
    words = span_hashes(data, starts, ends, lower=True)
    edges = np.searchsorted(document_of(starts, offsets), np.arange(n + 1))
    whole = np.zeros(max(0, len(words) - k + 1), U64)
    for j in range(k):
        whole = mix(whole * U64(0x9E3779B97F4A7C15) + words[j:j + len(whole)])
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a >= k:
            out.append(np.unique(whole[a:b - k + 1]))
        elif b > a:
            short = np.array([b - a], U64)
            for w in words[a:b]:
                short = mix(short * U64(0x9E3779B97F4A7C15) + w)
            out.append(short)
        else:
            out.append(np.zeros(0, U64))
    return out


def compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros (6 bits) and the mantissa behind the first one bit, as 16 bits."""
    _, exponent = np.frexp(least.astype(np.float64))
    zeros = np.minimum(64 - exponent, 63).astype(U64)
    body = np.left_shift(least, zeros + U64(1)) >> U64(64 - MANTISSA_BITS)
    return (((zeros << U64(MANTISSA_BITS)) | body) & U64(0xFFFF)).astype(np.uint16)


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """Registers of an ascending, non-empty set of hashes."""
    bucket = (shingles >> U64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    least = np.zeros(REGISTERS, U64)
    filled = np.zeros(REGISTERS, bool)
    least[bucket[first]] = shingles[first] << U64(BUCKET_BITS)
    filled[bucket[first]] = True
    empty = np.flatnonzero(~filled)
    step = max(1, (1 << 20) // len(shingles))
    for at in range(0, len(empty), step):
        own = empty[at:at + step]
        least[own] = mix(shingles[None, :] ^ SEEDS[own, None]).min(axis=1)
    return compress(least)


def estimate(left: np.ndarray, right: np.ndarray, n_left, n_right) -> np.ndarray:
    """Jaccard estimates of sketch rows, less the expected chance agreements of
    registers whose least elements differ."""
    small, large = np.minimum(n_left, n_right), np.maximum(n_left, n_right)
    ratio = large / np.maximum(small, 1)
    chance = 0.169919487159739093975315012348 * 2.0 ** -MANTISSA_BITS * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(0, ((left == right).mean(axis=1) - chance) / (1 - chance))


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, the set's digest and the sketch (empty for an empty set)."""

    def run(batches):
        for part, data, offsets in slices(batches):
            sets = shingle_sets(data, offsets, shingle)
            digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            halves = np.array([(d >> 64, d & (2**64 - 1)) for d in digests], U64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                 pa.array([sketch_of(s).tobytes() if len(s) else b"" for s in sets], pa.binary())],
                names=["doc_id", "n_shingles", "set_high", "set_low", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def band_keys(heads: DataFrame) -> DataFrame:
    """(key, doc_id) of every band of every sketch."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            registers = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, REGISTERS)
            keys = np.tile(SEEDS[:BANDS], (n, 1))
            for j in range(ROWS):
                keys = mix(keys + registers[:, j * BANDS:(j + 1) * BANDS].astype(U64))
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(ids, pa.int64())], names=["key", "doc_id"])

    return heads.select("doc_id", "sketch").mapInArrow(run, "key long, doc_id long")


def buckets(heads: DataFrame) -> DataFrame:
    """(key, doc_id, low, high, size) of the members of buckets with two ids or more."""
    bands = band_keys(heads)
    ends = (bands.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
                                     F.count(F.lit(1)).alias("size")).where("low < high"))
    return with_bucket(bands, ends, "doc_id")


def with_bucket(members: DataFrame, of: DataFrame, id_column: str) -> DataFrame:
    """``members`` joined with one row per key (``of``); a key's members are dealt over ``SALTS`` join keys."""
    salted = of.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = members.withColumn("_salt", F.pmod(F.xxhash64(id_column), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["key", "_salt"]).drop("_salt")


def candidates(met: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b: each member of a band bucket with its ends."""
    return (met.select(F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("doc_id").alias("b")),
                                         F.struct(F.col("doc_id").alias("a"), F.col("high").alias("b"))))
                       .alias("p")).select("p.*").where("a < b").distinct())


def likely(pairs: DataFrame, heads: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose estimate does not rule out ``threshold``."""
    slack = 5 * (threshold * (1 - threshold) / REGISTERS) ** 0.5
    a = heads.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
    b = heads.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            left, right = (np.frombuffer(b"".join(col[c].to_pylist()), np.uint16).reshape(-1, REGISTERS)
                           for c in ("sa", "sb"))
            na, nb = col["na"].to_numpy(), col["nb"].to_numpy()
            good = (estimate(left, right, na, nb) >= threshold - slack)
            yield pa.RecordBatch.from_arrays([col["a"].filter(pa.array(good)), col["b"].filter(pa.array(good))],
                                             names=["a", "b"])

    near_size = F.least("na", "nb") >= F.greatest("na", "nb") * (threshold - 1e-9)
    met = pairs.join(a, "a").join(b, "b").where(near_size)
    return met.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long")


def texts_of(ids: DataFrame, docs: DataFrame, make=None, schema: str = "id long, text string") -> DataFrame:
    """(id, text) of the documents named by ``ids`` (id), and of few others; or what
    ``make`` gives for a batch of those."""
    spark = docs.sparkSession
    slot = F.pmod(F.xxhash64("id"), F.lit(BITMAP))
    with shuffles_released(spark):
        maps = (ids.select(slot.alias("slot"))
                .groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("part"))
                .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits")).collect())
    bits = np.zeros(BITMAP // 8, np.uint8)  # at most 2 MB, whatever the data
    for row in maps:
        held = np.frombuffer(row["bits"], np.uint8)
        bits[(row["part"] - 1) * 4096:][:len(held)] = held
    shared = spark.sparkContext.broadcast(bits)

    def wanted(batches):
        for batch in batches:
            at = batch.column(2).to_numpy()
            hit = (shared.value[at >> 3] >> (at & 7)) & 1
            kept = batch.select([0, 1]).filter(pa.array(hit.astype(bool)))
            yield from make(kept) if make else [kept]

    return (docs.where(F.col("doc_id").isNotNull())
            .select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
            .select("id", "text", slot.alias("slot")).mapInArrow(wanted, schema))


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on their full shingle sets."""
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs)

    def run(batches):
        for batch in batches:
            for part, data, offsets in slices([batch], "ta"):
                other, edges = text_bytes(part.column(part.schema.get_field_index("tb")))
                sa, sb = shingle_sets(data, offsets, shingle), shingle_sets(other, edges, shingle)
                good = []
                for x, y in zip(sa, sb):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield part.select([0, 1]).filter(pa.array(good, pa.bool_()))

    met = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
           .join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b"))
    return met.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def counted(held: DataFrame) -> np.ndarray:
    """How many sets hold the shingles of each counter: one array of ``COUNTERS`` numbers."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            if batch.num_rows:
                own = np.frombuffer(b"".join(batch.column(0).to_pylist()), U64)
                total += np.bincount((own % U64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(total[slot])], names=["slot", "c"])

    found = (held.select("held").mapInArrow(run, "slot long, c long")
             .groupBy("slot").agg(F.sum("c").alias("c")).toArrow())  # at most COUNTERS rows, whatever the data
    out = np.zeros(COUNTERS, np.int64)
    out[found["slot"].to_numpy()] = found["c"].to_numpy()
    return out


def prefix(held: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The first shingles of a set, rare ones first, one of which every set that reaches
    ``percent`` shares; and how many of them are enough for partners of no smaller size."""
    n = len(held)
    order = np.lexsort((held, counts[(held % U64(COUNTERS)).astype(np.int64)]))
    return held[order[:n - -(-percent * n // 100) + 1]], n - -(-2 * percent * n // (100 + percent)) + 1


def prefixes(held: DataFrame, counts, percent: int) -> DataFrame:
    """(shingle, id, root, n, place, first) of each set's prefix; first: within its shorter one."""

    def run(batches):
        for batch in batches:
            out = []
            for k, own in enumerate(batch.column(2)):
                own = np.frombuffer(own.as_buffer(), U64)
                head, short = prefix(own, counts.value, percent)
                place = np.arange(len(head))
                out.append((head.view(np.int64), np.full(len(head), k), np.full(len(head), len(own)), place, place < short))
            if out:
                shingle, row, n, place, first = (np.concatenate(c) for c in zip(*out))
                ids, roots = (batch.column(c).take(pa.array(row)) for c in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shingle), ids, roots, pa.array(n, pa.int64()), pa.array(place, pa.int64()),
                     pa.array(first)], names=["shingle", "id", "root", "n", "place", "first"])

    return held.select("id", "root", "held").mapInArrow(
        run, "shingle long, id long, root long, n long, place long, first boolean")


def meeting(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b), a < b, of different roots that share a shingle of their prefixes
    (rows of ``prefixes``) and can still reach ``percent`` from there on. A shingle's rows
    of its most frequent root are not compared with each other; rows are dealt into blocks,
    and the join's keys are pairs of blocks."""
    parts = rows.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("c"), F.count_if("first").alias("f"))
    top = F.max(F.struct("c", "f", "root"))
    blocks = lambda c: F.ceil(c / BLOCK_ROWS).cast("int")
    shared = (parts.groupBy("shingle").agg(top.alias("top"), F.sum("c").alias("c"), F.sum("f").alias("f"))
              .where("c > top.c and f > 0")
              .select("shingle", F.col("top.root").alias("main"),
                      blocks(F.col("f") - F.col("top.f")).alias("i0"), blocks(F.col("c")).alias("j0"),
                      blocks(F.col("top.f")).alias("i1"), blocks(F.col("c") - F.col("top.c")).alias("j1")))
    dealt = checkpointed(with_bucket(rows.withColumnRenamed("shingle", "key"),
                                     shared.withColumnRenamed("shingle", "key"), "id"))
    is_main = F.col("root") == F.col("main")
    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # tiles of kind 0: first rows of other roots with all rows; of kind 1: those of the main root with the others
    tile = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    as_left = F.when(is_main, F.transform(upto(F.col("j1")), lambda j: tile(1, deal(F.col("i1")), j))).otherwise(
        F.transform(upto(F.col("j0")), lambda j: tile(0, deal(F.col("i0")), j)))
    with_others = F.transform(upto(F.col("i0")), lambda i: tile(0, i, deal(F.col("j0"))))
    as_right = F.when(is_main, with_others).otherwise(
        F.concat(with_others, F.transform(upto(F.col("i1")), lambda i: tile(1, i, deal(F.col("j1"))))))

    def side(df: DataFrame, tiles, mark: str) -> DataFrame:
        return df.select("key", F.explode(tiles).alias("t"),
                         *[F.col(c).alias(f"{c}_{mark}") for c in ("id", "root", "n", "place")])

    left, right = side(dealt.where("first"), as_left, "l"), side(dealt, as_right, "r")
    room = (100 + percent) * F.least(F.expr("n_l - place_l"), F.expr("n_r - place_r"))
    return (left.join(right, ["key", "t"])
            .where("root_l <> root_r and (n_l < n_r or (n_l = n_r and id_l < id_r))")
            .where((100 * F.col("n_l") >= percent * F.col("n_r")) & (room >= percent * F.expr("n_l + n_r")))
            .select(F.least("id_l", "id_r").alias("a"), F.greatest("id_l", "id_r").alias("b")).distinct())


def inner_pairs(met: DataFrame, roots: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame | None:
    """Pairs (a, b) of members of buckets of ``met`` that hold several components of ``roots``
    (id, root): all that reach ``percent`` and are in different ones are among them; None: no
    such bucket. (Buckets of three ids have no pair without an end.)"""
    members = checkpointed(
        met.where("size > 3").select("key", F.col("doc_id").alias("id")).join(roots, "id", "left")
        .select("key", "id", F.coalesce("root", "id").alias("root")))
    still = (members.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"))
             .where("least < most").select("key"))
    ids = checkpointed(with_bucket(members, still, "id").select("id", "root").distinct())
    if ids.isEmpty():
        return None

    def sets(batch):
        for part, data, offsets in slices([batch]):
            found = [s.tobytes() for s in shingle_sets(data, offsets, shingle)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["id", "held"])

    held = checkpointed(ids.join(texts_of(ids, docs, sets, "id long, held binary")
                                 .where(F.length("held") > 0), "id"))
    counts = docs.sparkSession.sparkContext.broadcast(counted(held))  # 8 MB, whatever the data
    return meeting(checkpointed(prefixes(held, counts, percent)), percent)


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every node of ``links`` (a, b): the least id it reaches.
    Alternating large-star and small-star steps, each written to the shared folder, until
    every node has larger neighbours only or a single, smaller one: then all are stars
    around their least ids."""
    edges = checkpointed(links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
                         .where("lo < hi"))
    while True:
        both = edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(edges.select("lo", "hi"))
        nodes = checkpointed(both.groupBy("n").agg(F.min("m").alias("least"), F.max("m").alias("most")))
        roots = nodes.select("n", F.least("n", "least").alias("root"))
        if nodes.where("least < n and least < most").isEmpty():
            return roots.withColumnRenamed("n", "id")
        # large star: larger neighbours of a node go to its least neighbour
        large = both.where("m > n").join(roots, "n").select(F.col("root").alias("lo"), F.col("m").alias("hi"))
        # small star: smaller neighbours and the node itself go to the least of them
        floor = large.groupBy("hi").agg(F.min("lo").alias("root"))
        edges = checkpointed(
            large.join(floor, "hi").select(F.col("root").alias("lo"), F.col("lo").alias("x"), "hi")
            .select("lo", F.explode(F.array("x", "hi")).alias("hi")).where("lo < hi").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept (is its component's smallest id)."""
    base = checkpointed(sketches(docs, shingle))
    heads = checkpointed(
        base.where("n_shingles > 0 and doc_id is not null").groupBy("set_high", "set_low", "n_shingles")
        .agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"),
             F.count(F.lit(1)).alias("copies")))
    met = checkpointed(buckets(heads))
    pairs = checkpointed(candidates(met))
    threshold = percent / 100
    # round 1: one candidate a document; round 2: what still joins two components;
    # round 3: pairs without an end of their buckets, where these still hold several
    one = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = checkpointed(confirmed(checkpointed(likely(one, heads, threshold)), docs, shingle, percent))
    roots = checkpointed(components(links))
    ra = roots.select(F.col("id").alias("a"), F.col("root").alias("ra"))
    rb = roots.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    rest = (pairs.join(one, ["a", "b"], "left_anti").join(ra, "a", "left").join(rb, "b", "left")
            .where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))
    more = checkpointed(confirmed(checkpointed(likely(rest, heads, threshold)), docs, shingle, percent))
    edge = (F.col("root").alias("a"), F.col("id").alias("b"))
    final = checkpointed(components(roots.select(*edge).union(more)))
    inner = inner_pairs(met, final, docs, shingle, percent)
    if inner is not None:  # pairs with an end of a bucket are known by now
        inner = checkpointed(inner.join(pairs, ["a", "b"], "left_anti"))
        links = checkpointed(confirmed(checkpointed(likely(inner, heads, threshold)), docs, shingle, percent))
        if not links.isEmpty():
            final = components(final.select(*edge).union(links))
    named = heads.where("copies > 1").select("set_high", "set_low", "n_shingles", F.col("doc_id").alias("head"))
    found = base.drop("sketch").join(named, ["set_high", "set_low", "n_shingles"], "left")
    head = F.coalesce("head", "doc_id")
    found = found.withColumn("head", head).join(final, F.col("head") == F.col("id"), "left")
    return found.select("doc_id", "n_shingles", F.coalesce("root", "head").alias("component_id"),
                        F.col("doc_id").eqNullSafe(F.coalesce("root", "head")).alias("kept"))


def drop_near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows that are not their component's smallest id."""
    gone = checkpointed(near_duplicates(docs, shingle, percent).where("not kept")
                        .select(F.col("doc_id").alias("_id")).distinct())
    return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")
