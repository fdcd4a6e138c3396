"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame
functions only.

A text's paragraphs are its lines, cut into blocks of at most
``BLOCK_WORDS`` words; the set of their 64-bit digests is sketched. A
digest goes to one cell in each of three subtables; a cell holds how many
digests it got, their exclusive or and that of their check hashes. The
fingerprint is the fixed base sketch in hexadecimal.

Two versions are compared by subtracting their sketches and peeling: a
cell with one digest (count 1 or -1, check hash right) reveals it, it is
taken out of its other cells, and so on until all cells are empty. What
was peeled are the digests of either version only, which gives the
Jaccard likeness of the paragraph sets. If the base sketch of a pair does
not peel to the end, both texts' digests are dealt by a hash into groups
of about ``GROUP`` and each group's sketches are subtracted and peeled; a
group that fails is retried with four times the cells and another seed,
and again. (Should the largest fail too, that group's two small sets are
compared as they are.)

The next document in descending order of doc_id is found without a global
sort: ids are dealt into ranges by a histogram of their values, each
range is sorted on its own, and the last row of a range takes the first
row of the next one.

Edge cases: null and empty texts have no paragraphs (two such are alike:
1.0); rows without doc_id come last; rows of equal doc_id are ordered by a
hash of their text; a single document is its own next one; repeated
paragraphs count once; extra columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.llm.common import partitions, stored

BLOCK_WORDS = 16
#: a block: up to BLOCK_WORDS words of one line
BLOCK = rf"[^\s]++(?:[ \t]++[^\s]++){{0,{BLOCK_WORDS - 1}}}+"
#: cells per subtable of the base sketch, and of a group's first try and retries
BASE_CELLS = 8
TRIES = ((8, 11), (32, 12), (128, 13))
GROUP = 8
ROUNDS = 10
#: histogram cells of the id ranges
HISTOGRAM = 1 << 14


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once. An empty fold hands its start on as it
    is, where ``transform`` would copy each result with all that it holds."""
    return F.aggregate(F.array(), value, lambda v, _: v, use)


def check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(99))


def paragraphs(text: Column) -> Column:
    """Distinct digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0)),
                                        lambda b: F.xxhash64(b)))


def placed(digest: Column, cells: Column | int, seed: Column | int, **more: Column) -> Column:
    """A digest with its check hash and the number of its cell in each subtable."""
    cells, seed = (v if isinstance(v, Column) else F.lit(v).cast("long") for v in (cells, seed))
    return bind(F.xxhash64(digest, seed.cast("int")), lambda h: F.struct(
        digest.alias("d"), check(digest).alias("k"), F.pmod(h, cells).alias("c0"),
        (F.pmod(F.shiftrightunsigned(h, 20), cells) + cells).alias("c1"),
        (F.pmod(F.shiftrightunsigned(h, 40), cells) + cells * 2).alias("c2"), *[v.alias(n) for n, v in more.items()]))


def xor_of(rows: Column, field: str) -> Column:
    return F.aggregate(rows, F.lit(0).cast("long"), lambda a, u: a.bitwiseXOR(u[field]))


def cell(own: Column, number: Column, n: Column) -> Column:
    return F.struct(number.alias("i"), n.alias("n"), xor_of(own, "d").alias("d"), xor_of(own, "k").alias("k"))


def sketch(digests: Column, cells: int, seed: int) -> Column:
    """The cells (i, n, d, k) of a set of digests, one subtable after the other."""
    def table(units: Column, j: int) -> Column:
        return F.transform(F.sequence(F.lit(j * cells).cast("long"), F.lit((j + 1) * cells - 1).cast("long")), lambda c:
                           bind(F.filter(units, lambda u: u[f"c{j}"] == c), lambda own: cell(own, c, F.size(own))))

    return bind(F.transform(digests, lambda d: placed(d, cells, seed)),
                lambda units: F.concat(*[table(units, j) for j in range(3)]))


def occupied(cells: Column) -> Column:
    return F.filter(cells, lambda c: (c["n"] != 0) | (c["d"] != 0) | (c["k"] != 0))


def subtract(a: Column, b: Column, cells: int) -> list[Column]:
    """The cells of the difference that are not empty, by subtable."""
    return [occupied(F.zip_with(F.slice(a, j * cells + 1, cells), F.slice(b, j * cells + 1, cells), lambda x, y: F.struct(
        x["i"].alias("i"), (x["n"] - y["n"]).alias("n"), x["d"].bitwiseXOR(y["d"]).alias("d"),
        x["k"].bitwiseXOR(y["k"]).alias("k")))) for j in range(3)]


def total(rows: Column) -> Column:
    return F.aggregate(rows, F.lit(0), lambda a, u: a + u["n"])


def signed_sketch(units: Column) -> list[Column]:
    """``subtract`` of the sketches of two sets: one's digests (as ``placed``) have n = 1 and
    are added, the other's have n = -1 and are taken away."""
    def table(j: int) -> Column:
        return occupied(F.transform(F.array_distinct(F.transform(units, lambda u: u[f"c{j}"])), lambda c: bind(
            F.filter(units, lambda u: u[f"c{j}"] == c), lambda own: cell(own, c, total(own)))))

    return [table(j) for j in range(3)]


def peel(difference: list[Column], cells: Column | int, seed: Column | int) -> Column:
    """(done, plus, minus): whether all cells became empty, and how many digests of the
    first and of the second version were recovered. Cells that become empty leave. A round
    that finds no single digest ends the search: later rounds pass the state on."""

    def without(c: Column, hit: Column) -> Column:
        return F.when(F.size(hit) == 0, c).otherwise(F.struct(
            c["i"].alias("i"), (c["n"] - total(hit)).alias("n"),
            c["d"].bitwiseXOR(xor_of(hit, "d")).alias("d"), c["k"].bitwiseXOR(xor_of(hit, "k")).alias("k")))

    def alone(state: Column, n: int) -> Column:
        found = F.filter(F.concat(*[state[f"t{j}"] for j in range(3)]),
                         lambda c: (c["n"] == n) & (check(c["d"]) == c["k"]))
        return F.transform(F.array_distinct(F.transform(found, lambda c: c["d"])),
                           lambda d: placed(d, cells, seed, n=F.lit(n)))

    def taken(state: Column, own: Column, j: int) -> Column:
        return occupied(F.transform(state[f"t{j}"], lambda c: bind(
            F.filter(own, lambda u: u[f"c{j}"] == c["i"]), lambda hit: without(c, hit))))

    def search(state: Column, own: Column) -> Column:
        return F.struct(
            *[taken(state, own, j).alias(f"t{j}") for j in range(3)],
            (state["plus"] + F.size(F.filter(own, lambda u: u["n"] == 1))).alias("plus"),
            (state["minus"] + F.size(F.filter(own, lambda u: u["n"] == -1))).alias("minus"), F.lit(False).alias("ended"))

    def ended(state: Column) -> Column:
        return F.struct(*[state[f].alias(f) for f in ("t0", "t1", "t2", "plus", "minus")], F.lit(True).alias("ended"))

    def empty(state: Column) -> Column:
        return F.size(state["t0"]) + F.size(state["t1"]) + F.size(state["t2"]) == 0

    start = F.struct(*[t.alias(f"t{j}") for j, t in enumerate(difference)], F.lit(0).alias("plus"),
                     F.lit(0).alias("minus"), F.lit(False).alias("ended"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start,
        lambda state, _: F.when(state["ended"] | empty(state), state).otherwise(bind(
            F.concat(alone(state, 1), alone(state, -1)),
            lambda own: F.when(F.size(own) == 0, ended(state)).otherwise(search(state, own)))),
        lambda s: F.struct(empty(s).alias("done"), s["plus"].alias("plus"), s["minus"].alias("minus")))


def group_difference(signed: Column) -> Column:
    """(done, plus, minus) of two small sets, retrying larger on failure; ``signed`` holds the
    first one's digests (d) with n = 1 and the second one's with n = -1."""
    def side(n: int) -> Column:
        return F.transform(F.filter(signed, lambda u: u["n"] == n), lambda u: u["d"])

    def tried(cells: Column, seed: Column) -> Column:
        return bind(F.transform(signed, lambda u: placed(u["d"], cells, seed, n=u["n"])),
                    lambda units: peel(signed_sketch(units), cells, seed))

    as_they_are = F.struct(F.lit(True).alias("done"), F.size(F.array_except(side(1), side(-1))).alias("plus"),
                           F.size(F.array_except(side(-1), side(1))).alias("minus"))
    tries = F.array(*[F.struct(F.lit(c).cast("long").alias("cells"), F.lit(s).cast("long").alias("seed"))
                      for c, s in TRIES])
    return F.aggregate(
        tries, F.struct(F.lit(False).alias("done"), F.lit(0).alias("plus"), F.lit(0).alias("minus")),
        lambda r, t: F.when(r["done"], r).otherwise(tried(t["cells"], t["seed"])),
        lambda r: F.when(r["done"], r).otherwise(as_they_are))


def dealt_difference(a: Column, b: Column) -> Column:
    """(done, plus, minus) of two sets of any size: dealt into groups first, in two steps of
    about as many parts, so that n digests take some n times the root of n / GROUP tests."""
    groups = F.greatest(F.lit(1), F.ceil((F.size(a) + F.size(b)) / GROUP))
    steps = bind(F.ceil(F.sqrt(groups)), lambda s: F.struct(s.alias("s"), F.ceil(groups / s).alias("w")))

    def dealt(rows: Column, n: int, z: Column) -> Column:
        return F.transform(rows, lambda d: bind(F.shiftrightunsigned(F.xxhash64(d, F.lit(7)), 8), lambda h: F.struct(
            d.alias("d"), F.lit(n).alias("n"), F.pmod(h, z["s"]).alias("s"),
            F.pmod(F.shiftrightunsigned(h, 28), z["w"]).alias("w"))))

    def parts(rows: Column, step: str, z: Column, use) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), z[step] - 1), lambda i: bind(
            F.filter(rows, lambda u: u[step] == i), use))

    results = bind(steps, lambda z: bind(
        F.concat(dealt(a, 1, z), dealt(b, -1, z)), lambda rows: F.flatten(parts(
            rows, "s", z, lambda part: parts(part, "w", z, group_difference)))))
    return F.aggregate(
        results, F.struct(F.lit(True).alias("done"), F.lit(0).alias("plus"), F.lit(0).alias("minus")),
        lambda s, r: F.struct((s["done"] & r["done"]).alias("done"), (s["plus"] + r["plus"]).alias("plus"),
                              (s["minus"] + r["minus"]).alias("minus")))


def likeness(a: Column, b: Column, base_a: Column, base_b: Column) -> Column:
    """Jaccard likeness of two paragraph sets from their sketches; base first."""
    base = peel(subtract(base_a, base_b, BASE_CELLS), BASE_CELLS, 1)
    found = bind(base, lambda r: F.when(r["done"], r).otherwise(dealt_difference(a, b)))
    return bind(found, lambda r: F.when(F.size(a) + r["minus"] == 0, F.lit(1.0)).otherwise(
        (F.size(a) - r["plus"]) / (F.size(a) + r["minus"])))


def hexed(cells: Column) -> Column:
    """The cells as text: count, digests and checks in hexadecimal."""
    # counts of 256 and more take more than two digits: lpad would cut them
    digits = lambda v, n: F.lpad(F.lower(F.hex(v)), F.greatest(F.lit(n), F.length(F.hex(v))), F.lit("0"))
    return F.array_join(F.transform(cells, lambda c: F.concat(
        digits(c["n"].cast("long"), 2), digits(c["d"], 16), digits(c["k"], 16))), ".")


def constant(numbers: list[int]) -> Column:
    """An array of whole numbers, folded into one literal."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")


def with_next(docs: DataFrame, columns: list[str], ranges: int | None = None) -> DataFrame:
    """``docs`` (doc_id, tie and ``columns``) with next_<column> of the document that
    follows in descending order of doc_id, the first one after the last."""
    ranges = ranges or partitions(docs.sparkSession)
    ends = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    lo, hi = float(ends["lo"] or 0), float(ends["hi"] or 0)
    # descending: cell 0 has the largest ids; ids that are null have a cell of their own
    cell = F.coalesce(F.least(F.lit(HISTOGRAM - 1), F.floor(
        (F.lit(hi) - F.col("doc_id").cast("double")) / F.lit(max(hi - lo, 1.0)) * HISTOGRAM)),
        F.lit(HISTOGRAM)).cast("int")
    counts = {r["cell"]: r["n"] for r in  # at most HISTOGRAM + 1 rows
              docs.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = max(1, sum(counts.values()) / ranges)
    bucket_of, seen = [], 0
    for i in range(HISTOGRAM + 1):
        bucket_of.append(int(seen / share))
        seen += counts.get(i, 0)
    used = sorted({bucket_of[i] for i in counts})
    after = dict(zip(used, [*used[1:], *used[:1]]))
    dealt = docs.withColumn("range", constant(bucket_of)[cell])
    # first row of each range: at most one id a range, so a bounded broadcast
    best = dealt.groupBy("range").agg(F.max(F.struct("doc_id", (-F.col("tie")).alias("tie"))).alias("top"))
    best = stored(best.select(F.col("range").alias("_range"), F.col("top.doc_id").alias("_id"),
                              (-F.col("top.tie")).alias("_tie")))
    heads = dealt.join(F.broadcast(best), F.col("doc_id").eqNullSafe(F.col("_id"))
                       & (F.col("tie") == F.col("_tie")) & (F.col("range") == F.col("_range")))
    before = {v: k for k, v in after.items()}
    back = constant([before.get(i, -1) for i in range(max(used, default=0) + 1)])
    heads = stored(heads.select(back[F.col("range")].alias("_before"),
                                *[F.col(c).alias(f"head_{c}") for c in columns])
                   .dropDuplicates(["_before"]))
    order = W.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), F.col("tie"))
    led = dealt.select("*", *[F.lead(c).over(order).alias(f"lead_{c}") for c in columns],
                       F.lead("tie").over(order).isNull().alias("is_last"))
    met = led.join(heads, F.col("range") == F.col("_before"), "left")
    return met.select(*docs.columns, *[F.when(F.col("is_last"), F.col(f"head_{c}")).otherwise(F.col(f"lead_{c}"))
                                       .alias(f"next_{c}") for c in columns])


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Per document: doc_id, n_chars, edited_text, fingerprint, edited_fingerprint,
    near_edited, near_next. The edited text has the last half of its code points
    replaced by the first as many of the next document's."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie"), paragraphs(text).alias("p"))
    paired = with_next(base, ["text", "p"], ranges)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = paired.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited_text"), "p", "next_p")
    rows = rows.withColumn("e", paragraphs(F.col("edited_text")))
    rows = rows.select("*", *[sketch(F.col(c), BASE_CELLS, 1).alias(f"base_{c}") for c in ("p", "e", "next_p")])
    near = lambda c: likeness(F.col("p"), F.col(c), F.col("base_p"), F.col(f"base_{c}"))
    return rows.select("doc_id", "n_chars", "edited_text", hexed(F.col("base_p")).alias("fingerprint"),
                       hexed(F.col("base_e")).alias("edited_fingerprint"),
                       near("e").alias("near_edited"), near("next_p").alias("near_next"))
