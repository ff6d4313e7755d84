"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A version's sketch has a fixed number of cells, so any two can be subtracted, whenever they were made. A cell holds a
count, the XOR of its digests and the XOR of their checksums; each digest is in one cell of each of three subtables.
Subtracting cancels what two versions share, and cells with a single digest are peeled until none is left, which gives
the differing digests and their side. Where cells stay, the sketch was too small: the digests are dealt by hash to
``SPLIT`` blocks with a sketch of their own and other hashes, and so on, for the blocks that failed only, until all
are recovered. Each attempt is linear in the paragraphs. Everything is a column expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteworks.llm import common
from noteworks.llm.common import let
from noteworks.session import cut_lineage

PARAGRAPH_WORDS = 32  # a longer line counts as several paragraphs
SUBTABLES = 3
SIDE = 8  # cells of a subtable
ROUNDS = 12  # of peeling; a sketch that needs more is retried in parts
SPLIT = 4
RANGE_ROWS = 4096
MAX_RANGES = 1 << 14  # bounds the literals and the table of first rows; beyond it ranges grow


def digests(text: Column) -> Column:
    """64-bit digests of the paragraphs of a text, each once; white space inside them is normalised. The digest of
    a paragraph that occurs several times also depends on how often."""

    def parts(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(w) - 1) / PARAGRAPH_WORDS).cast("int"))
        return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i * PARAGRAPH_WORDS + 1, F.lit(PARAGRAPH_WORDS)), " ")))

    def counted(s: Column) -> Column:
        first = F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), F.struct(x.alias("k"), i.alias("at"))))
        return let(F.filter(first, lambda r: r.isNotNull()), lambda runs: F.transform(runs, lambda r, i: let(
            F.coalesce(F.get(runs, i + 1)["at"], F.size(s)) - r["at"], lambda n: F.when(n == 1, r["k"]).otherwise(F.xxhash64(r["k"], n)))))

    lines = F.transform(F.split(text, "\n"), common.words)
    return let(F.sort_array(F.flatten(F.transform(F.filter(lines, lambda w: F.size(w) > 0), parts))), counted)


def cell(count: Column, key: Column, check: Column) -> Column:
    return F.struct(count.cast("int").alias("n"), key.cast("long").alias("k"), check.cast("long").alias("c"))


def checksum(key: Column) -> Column:
    return F.xxhash64(key, F.lit(-1))


def entry(key: Column, sign: Column, seed: int) -> Column:
    """A digest with its sign, checksum and place in each subtable."""
    places = [F.pmod(F.xxhash64(key, F.lit(SUBTABLES * seed + j)), F.lit(SIDE)).cast("int").alias(f"p{j}") for j in range(SUBTABLES)]
    return F.struct(sign.cast("int").alias("n"), key.alias("k"), checksum(key).alias("c"), *places)


def _changed(cells: Column, entries: Column, sign: int) -> Column:
    """Cells with the entries added (sign 1) or taken out (sign -1)."""

    def put(c: Column, e: Column) -> Column:
        return cell(c["n"] + sign * e["n"], c["k"].bitwiseXOR(e["k"]), c["c"].bitwiseXOR(e["c"]))

    def subtable(j: int) -> Column:
        return F.transform(F.slice(cells, j * SIDE + 1, SIDE), lambda c, i: F.aggregate(F.filter(entries, lambda e: e[f"p{j}"] == i), c, put))

    return F.concat(*[subtable(j) for j in range(SUBTABLES)])


def sketch(keys: Column, seed: int = 0) -> Column:
    """The cells of a version's digests."""
    empty = F.array_repeat(cell(F.lit(0), F.lit(0), F.lit(0)), SUBTABLES * SIDE)
    return let(F.transform(keys, lambda k: entry(k, F.lit(1), seed)), lambda e: _changed(empty, e, 1))


def subtract(a: Column, b: Column) -> Column:
    """What is left of two sketches of the same seed when the digests they share cancel."""
    return F.zip_with(a, b, lambda x, y: cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"])))


def peel(cells: Column, seed: int = 0) -> Column:
    """The digests ``lost`` (only in the first version) and ``new`` (only in the second) of a difference of
    sketches; null if it holds more than can be peeled."""

    def step(state: Column, _: Column) -> Column:
        pure = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["c"] == checksum(c["k"])))
        found = F.array_distinct(F.transform(pure, lambda c: entry(c["k"], c["n"], seed)))
        more = lambda e: F.struct(
            _changed(state["cells"], e, -1).alias("cells"),
            F.concat(state["found"], F.transform(e, lambda x: F.struct(x["n"].alias("n"), x["k"].alias("k")))).alias("found"))
        return let(found, lambda e: F.when(F.size(e) == 0, state).otherwise(more(e)))

    start = F.struct(cells.alias("cells"), F.array().cast("array<struct<n:int,k:bigint>>").alias("found"))

    def side(found: Column, sign: int) -> Column:
        return F.transform(F.filter(found, lambda x: x["n"] == sign), lambda x: x["k"])

    return let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step), lambda s: F.when(
        F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["c"] == 0)),
        F.struct(side(s["found"], 1).alias("lost"), side(s["found"], -1).alias("new"))))


def printed(cells: Column) -> Column:
    """A sketch as a string: for each cell its count, digests and checksums in hex, or a dash for an empty one."""
    one = lambda c: F.concat_ws(".", F.hex(c["n"]), F.hex(c["k"]), F.hex(c["c"]))
    return F.lower(F.array_join(F.transform(cells, lambda c: F.when(c["n"] == 0, "-").otherwise(one(c))), " "))


def read_printed(fingerprint: Column) -> Column:
    """The cells of a version's printed sketch, which can be subtracted and peeled like new ones."""
    number = lambda x: F.conv(x, 16, -10).cast("long")

    def one(s: Column) -> Column:
        filled = let(F.split(s, r"\."), lambda p: cell(number(F.get(p, F.lit(0))), number(F.get(p, F.lit(1))), number(F.get(p, F.lit(2)))))
        return F.when(s == "-", cell(F.lit(0), F.lit(0), F.lit(0))).otherwise(filled)

    return F.transform(F.split(fingerprint, " "), one)


def retried(failed: DataFrame, keys: list[str]) -> DataFrame:
    """Differences of digests ``a`` and ``b`` that one sketch could not hold: ``keys, lost, new``. Blocks that fail
    are dealt to ``SPLIT`` smaller ones; digests differ, so blocks shrink until all can be peeled."""
    done, level = [], 0
    while True:
        level += 1

        def part(d: str, g: Column) -> Column:
            return F.filter(d, lambda k: F.pmod(F.xxhash64(k, F.lit(-1 - level)), F.lit(SPLIT)) == g)

        numbers = F.array(*[F.lit(g) for g in range(SPLIT)])
        blocks = F.explode(F.transform(numbers, lambda g: F.struct(part("a", g).alias("a"), part("b", g).alias("b"))))
        tried = failed.select(*keys, blocks.alias("block")).select(*keys, "block.*")
        tried = cut_lineage(tried.withColumn("found", peel(subtract(sketch(F.col("a"), level), sketch(F.col("b"), level)), level)))
        done.append(tried.where("found IS NOT NULL").select(*keys, "found.*"))
        failed = tried.where("found IS NULL").drop("found")
        if failed.isEmpty():
            break
    merged = [F.flatten(F.collect_list(c)).alias(c) for c in ("lost", "new")]
    return reduce(DataFrame.unionByName, done).groupBy(*keys).agg(*merged)  # as long as one text's digests


def _search(bounds: list, value: Column) -> Column:
    """How many of the sorted bounds are at most ``value``, by halving."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.lit(int(b)) for b in bounds])
    steps = len(bounds).bit_length()
    state = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        return F.when(s["low"] >= s["high"], s).when(F.get(table, mid) <= value, F.struct((mid + 1).alias("low"), s["high"].alias("high"))).otherwise(
            F.struct(s["low"].alias("low"), mid.alias("high")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), state, halve, lambda s: s["low"])


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """Add to each row, as ``next``, a struct of ``columns`` of the row that follows by key (after the last: the first).

    Keys (numbers) are dealt to ranges of about ``RANGE_ROWS`` rows, at most ``MAX_RANGES``; the first row of each range is also sent, as a guest,
    to the end of the range before. So rows move once. Null keys come last; equal keys follow in order of columns.
    """
    n = docs.count()
    cuts = min(-(-n // RANGE_ROWS), MAX_RANGES)
    bounds = docs.where(F.col(key).isNotNull()).approxQuantile(key, [i / cuts for i in range(1, cuts)], 0.25 / cuts) if cuts > 1 else []
    bounds = sorted(set(bounds))
    bucket = F.when(F.col(key).isNull(), F.lit(len(bounds))).otherwise(_search(bounds, F.col(key)))
    own = docs.withColumn("_bucket", bucket.cast("int"))
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"))
    heads = own.groupBy("_bucket").agg(F.min(order).alias("first"))
    before = F.lag("_bucket").over(Window.partitionBy(F.lit(0)).orderBy("_bucket"))  # one row a range
    last = F.max("_bucket").over(Window.partitionBy(F.lit(0)))
    heads = heads.select(F.col("_bucket").alias("_at"), F.col("first.key").alias("_key"), F.coalesce(before, last).alias("_to"))
    guests = own.join(F.broadcast(heads), (F.col("_bucket") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key")))
    first = F.min(F.struct(*columns)).alias("first")
    guests = guests.groupBy("_to").agg(first).select(F.col("_to").alias("_bucket"), "first.*")
    both = own.withColumn("_guest", F.lit(False)).unionByName(guests.withColumn("_guest", F.lit(True)), allowMissingColumns=True)
    follow = Window.partitionBy("_bucket").orderBy("_guest", F.col(key).isNull(), key, *[c for c in columns if c != key])
    return both.withColumn("next", F.lead(F.struct(*columns)).over(follow)).where("not _guest").drop("_guest", "_bucket")


def compare_versions(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Sketches of every document and of its edited text, the digests in which it differs from its edited text and
    from the next document (``edited`` and ``following``: ``lost``, ``new``), and how alike they are: twice the
    shared digests over all digests of both, 1 for two versions without any.

    The edited text has its last half replaced by the beginning of the next document's. Null counts as empty; a
    single document follows itself; repeated rows follow each other; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("doc_id"), common.text_or_empty(text).alias("text"))
    rows = rows.withColumn("digests", digests(F.col("text")))
    paired = with_next(rows, ["doc_id", "text", "digests"])
    half = F.floor(F.length("text") / 2).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), (F.length("text") - half).cast("int"))
    edited = F.concat(kept, F.substring(F.col("next.text"), F.lit(1), half))
    made = paired.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("text"), F.col("digests").alias("own"), F.col("next.digests").alias("after"))
    made = made.select("doc_id", "n_chars", F.sha2("text", 256).alias("edited_sha256"), "own", "after", digests(F.col("text")).alias("other"))

    def first_try(s: Column) -> Column:
        return F.struct(*[peel(subtract(s, sketch(F.col(c)))).alias(c) for c in ("other", "after")])

    tried = made.withColumn("found", let(sketch(F.col("own")), first_try)).withColumn("_id", F.monotonically_increasing_id())
    tried = cut_lineage(tried)  # ids stay as they are when a task runs again
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("b"), F.col(f"found.{c}").isNull().alias("failed")) for c in ("other", "after")]))
    failed = tried.select("_id", "own", kinds.alias("pair")).where("pair.failed").select("_id", "pair.kind", F.col("own").alias("a"), "pair.b")
    late = retried(failed, ["_id", "kind"])
    late = late.groupBy("_id").agg(*[F.max(F.when(F.col("kind") == c, F.struct("lost", "new"))).alias(f"late_{c}") for c in ("other", "after")])

    def likeness(found: str, other: str) -> Column:
        total = F.size("own") + F.size(other)
        return F.when(total == 0, F.lit(1.0)).otherwise(1.0 - (F.size(f"{found}.lost") + F.size(f"{found}.new")) / total)

    whole = tried.join(late, "_id", "left").withColumns({
        "edited": F.coalesce("found.other", "late_other"), "following": F.coalesce("found.after", "late_after")})
    return whole.select(
        "doc_id", "n_chars", "edited_sha256", printed(sketch(F.col("own"))).alias("fingerprint"), printed(sketch(F.col("other"))).alias("edited_fingerprint"),
        likeness("edited", "other").alias("near_edited"), likeness("following", "after").alias("near_next"), "edited", "following")
