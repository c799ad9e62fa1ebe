"""Fingerprints of documents as invertible Bloom lookup sketches of their paragraphs, and what differs between two versions.

A text's paragraphs are its lines; lines of over LONG_LINE characters are cut after the ends of sentences. A paragraph's digest is its XXH64,
mixed with how often the text has it if that is more than once. A sketch of level L has 3 segments of 2**L cells; a digest goes into one
cell of each. A cell has the number of its digests, their XOR and the XOR of their checks, so the sketches of two versions
subtract cell by cell and what both have is gone. Peeling recovers the rest: a cell that holds one digest gives it away, it is taken out
of its other cells, and so on. A pair that leaves cells over is tried again with a sketch 4 times as large.

Everything is DataFrame and SQL functions. Cells are rows that stay in the partition of their pair, so a pair's peeling is a chain of
aggregations without a shuffle. The next document is found inside ranges of ids; the last one of each range meets
the first one of the next range in a small join.

Defined cases: null texts are empty, and an empty text has no paragraph; two texts without paragraphs have likeness 1; documents are ordered by id, null ids
last, rows of one id by their texts' hashes; a lone document is its own next one; repeated rows are each fingerprinted; an empty table
gives an empty result; columns of the names made here are replaced, all others stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read, stored

#: Characters of a line above which it is cut into sentences, the level of fingerprints, sweeps over a sketch, and the level beyond which arrays are compared in its place.
LONG_LINE, LEVEL, SWEEPS, LAST_LEVEL = 1000, 3, 2, 27
#: Bytes of text in a range of ids, and the most ranges that there are.
RANGE_BYTES, MOST_RANGES = 8 << 20, 1 << 16


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.transform(F.array(value), f)[0]


def digests(text: Column) -> Column:
    """The digests of a text's paragraphs, ascending and without repeats."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.when(F.length(x) > LONG_LINE, F.split(x, r"(?<=[.!?])[ \t]+")).otherwise(F.array(x)))
    hashed = F.sort_array(F.transform(F.filter(F.flatten(lines), lambda x: x != ""), lambda x: F.xxhash64(x)))

    def counted(h: Column) -> Column:
        n = F.size(h)
        new = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(h, i) != F.get(h, i - 1)))
        return _let(new, lambda s: F.transform(s, lambda i, k: _let(F.coalesce(F.get(s, k + 1), n) - i, lambda c: F.when(c == 1, F.get(h, i)).otherwise(F.xxhash64(F.get(h, i), c)))))

    return _let(hashed, lambda h: F.when(F.size(h) == 0, h).otherwise(F.sort_array(counted(h))))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(-1))


def _cell(digest: Column, segment: int, level: int) -> Column:
    """The cell of a digest in a segment; levels hash on their own."""
    return (F.lit(segment << level) + F.pmod(F.xxhash64(digest, F.lit(3 * level + segment)), F.lit(1 << level))).cast("int")


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The sum of cells; empty ones go."""
    out = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.expr("bit_xor(digests)").alias("digests"), F.expr("bit_xor(checks)").alias("checks"))
    return out.where("n <> 0 OR digests <> 0 OR checks <> 0")


def sketch(rows: DataFrame, keys: list[str], level: int, n: str | None = None) -> DataFrame:
    """Cells (keys, cell, n, digests, checks) of rows (keys, digest), which a column ``n`` of 1 and -1 adds or subtracts."""
    d, times = F.col("digest"), F.col(n) if n else F.lit(1)
    cells = rows.select(*keys, times.alias("n"), d.alias("digests"), _check(d).alias("checks"), F.explode(F.array(*[_cell(d, s, level) for s in range(3)])).alias("cell"))
    return _summed(cells, [*keys, "cell"])


def fingerprint(rows: DataFrame, keys: list[str], level: int = LEVEL) -> DataFrame:
    """(keys, fingerprint) of rows (keys, digest): the sketch's cells that are not empty, in order, as hexadecimal cell.n.digests.checks. Keys without a row are left out."""
    cell = F.concat_ws(".", F.hex("cell"), F.hex("n"), F.hex("digests"), F.hex("checks"))
    one = sketch(rows, keys, level).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cell", cell.alias("hex")))).alias("cells"))  # 3 * 2**level at most
    return one.select(*keys, F.lower(F.concat_ws("-", F.transform("cells", lambda c: c["hex"]))).alias("fingerprint"))


def _peeled(cells: DataFrame, keys: list[str], level: int, segment: int) -> DataFrame:
    """``cells`` (keys, cell, found, n, digests, checks) without the digests that stand alone in a cell of a segment; these become rows with cell -1 and the digest in found."""
    d, n, checks = F.col("digests"), F.col("n"), F.col("checks")
    alone = (F.shiftright("cell", level) == segment) & (F.abs(n) == 1) & (checks == _check(d)) & (F.col("cell") == _cell(d, segment, level))
    row = lambda cell, found, times: F.struct(cell.alias("cell"), found.alias("found"), times.alias("n"))
    found = [row(F.lit(-1), d, n), *[row(_cell(d, s, level), F.lit(0).cast("long"), -n) for s in range(3) if s != segment]]
    moved = F.when(alone, F.array(*found)).otherwise(F.array(row(F.col("cell"), F.col("found"), n)))
    rows = cells.select(*keys, d, checks, F.explode(moved).alias("to")).select(*keys, "digests", "checks", "to.cell", "to.found", "to.n")
    return _summed(rows, [*keys, "cell", "found"])


def _recovered(pairs: DataFrame, keys: list[str], level: int) -> DataFrame:
    """(keys, only_a, only_b, left) of pairs (keys, a, b) whose sketches differ; left is the number of cells that could not be peeled."""
    signed = lambda c, sign: F.transform(c, lambda x: F.struct(x.alias("digest"), F.lit(sign).alias("sign")))
    rows = pairs.repartition(*keys).select(*keys, F.inline(F.concat(signed("a", 1), signed("b", -1))))
    cells = sketch(rows, keys, level, "sign").withColumn("found", F.lit(0).cast("long"))
    for k in range(3 * SWEEPS):
        cells = _peeled(cells, keys, level, k % 3)
    held = lambda sign: F.collect_list(F.when((F.col("cell") == -1) & (F.col("n") == sign), F.col("found")))  # noqa: E731  as many as the texts have paragraphs at most
    return cells.groupBy(*keys).agg(held(1).alias("only_a"), held(-1).alias("only_b"), F.count_if(F.col("cell") >= 0).alias("left"))


def differences(pairs: DataFrame, keys: list[str], level: int = LEVEL) -> DataFrame:
    """(keys, only_a, only_b, level) of all pairs (keys, a, b) of digest arrays: the digests that only one side has, and the level of the sketches that gave them. ``keys`` name one pair."""
    done, todo = [], pairs
    while True:
        if level > LAST_LEVEL:
            done.append(todo.select(*keys, F.array_except("a", "b").alias("only_a"), F.array_except("b", "a").alias("only_b"), F.lit(level).alias("level")))
            break
        tried = stored(todo.join(_recovered(todo, keys, level), keys, "left").withColumn("left", F.coalesce("left", F.lit(0))).select(*keys, F.when(F.col("left") > 0, F.col("a")).alias("a"), F.when(F.col("left") > 0, F.col("b")).alias("b"), "only_a", "only_b", "left"))
        empty = F.array().cast("array<bigint>")
        done.append(tried.where("left = 0").select(*keys, *[F.coalesce(c, empty).alias(c) for c in ("only_a", "only_b")], F.lit(level).alias("level")))
        todo = tried.where("left > 0").select(*keys, "a", "b")
        if todo.isEmpty():
            break
        level += 2
    return reduce(DataFrame.unionByName, done)


def likeness(n_a: Column, n_b: Column, differing: Column) -> Column:
    """The share of the digests of both sides that both have."""
    return F.when(n_a + n_b == 0, 1.0).otherwise((n_a + n_b - differing) / (n_a + n_b + differing))


def _versions(text: Column, after: Column, n: Column) -> Column:
    """The text with its last half replaced by the beginning of the text after it."""
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(after, F.lit(1), half))


def _measured(rows: DataFrame, *keep) -> DataFrame:
    """``keep``, n_chars, edited_sha256, own, edited and after of rows with text, own, next_text and next_own; without a next text the last three but own are null."""
    n = F.char_length("text")
    rows = rows.withColumn("n", n).withColumn("edited_text", _versions(F.col("text"), F.col("next_text"), F.col("n")))
    return rows.select(*keep, F.col("n").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"), "own", digests(F.col("edited_text")).alias("edited"), F.col("next_own").alias("after"))


def _ranges(keys: DataFrame, parts: int) -> DataFrame:
    """One row: the first keys of ``parts`` ranges of keys at most, in order, and every ``step``-th of them."""
    starts = keys.repartitionByRange(parts, "k").groupBy(F.spark_partition_id()).agg(F.min("k").alias("k"))
    step = max(1, int(parts**0.5))
    one = starts.agg(F.array_sort(F.collect_list("k")).alias("starts"))  # MOST_RANGES at most
    return one.select("starts", F.filter("starts", lambda _, i: i % step == 0).alias("tops"), F.lit(step).alias("step"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(at, id, n_chars, edited_sha256, own, edited, after) of each row: ``at`` is a number of its own, the arrays are the digests of its text, of its edited text and of the next text."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("at"), F.coalesce(text_col, F.lit("")).alias("text"), F.col(id_col).alias("id"))
    rows = rows.withColumn("k", F.struct(F.col("id").isNull().alias("last"), "id", F.xxhash64("text").alias("h"), "at"))
    light = cut(rows.select("k", F.octet_length("text").alias("bytes")))
    total = light.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    ranges = _ranges(light, min(MOST_RANGES, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))))
    place = lambda starts: F.greatest(F.size(F.filter(starts, lambda s: s <= F.col("k"))), F.lit(1)) - 1
    placed = rows.crossJoin(F.broadcast(ranges)).withColumn("top", place(F.col("tops")) * F.col("step")).withColumn("range", F.col("top") + place(F.slice("starts", F.col("top") + 1, F.col("step"))))
    w = Window.partitionBy("range").orderBy("k")
    led = placed.select("range", "k", "id", "at", "text", digests(F.col("text")).alias("own")).select(
        "range", "id", "at", "text", "own", F.lead("text").over(w).alias("next_text"), F.lead("own").over(w).alias("next_own"), F.row_number().over(w).alias("n_in_range"))
    ends = led.withColumn("first", F.col("n_in_range") == 1).withColumn("ended", F.col("next_text").isNull())
    # The first and last texts of a range are kept, for the join with the range after it.
    kept = [F.when(F.col(c), F.col("text")).alias(f"{c}_text") for c in ("first", "ended")]
    table = stored(_measured(ends, "range", "first", "ended", *kept, "at", "id"))
    starts = table.where("first").select(F.col("range").alias("follower"), F.col("first_text").alias("next_text"), F.col("own").alias("next_own"))
    order = Window.orderBy("follower")  # one row a range
    follows = starts.select(F.col("follower").alias("range"), F.coalesce(F.lead("follower").over(order), F.min("follower").over(Window.partitionBy())).alias("follower"))
    border = table.where("ended").select("range", "at", "id", F.col("ended_text").alias("text"), "own").join(follows, "range").join(starts, "follower")
    return table.where("NOT ended").select("at", "id", "n_chars", "edited_sha256", "own", "edited", "after").unionByName(_measured(border, "at", "id"))


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = LEVEL) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row of ``docs``; its other columns are left out."""
    rows = stored(with_next(docs, id_col, text_col))
    version = lambda side, **arrays: F.struct(F.lit(side).alias("side"), *[F.col(c).alias(name) for name, c in arrays.items()])
    sides = rows.select("at", F.inline(F.array(version("own", digests="own"), version("edited", digests="edited"))))
    prints = fingerprint(sides.repartition("at").select("at", "side", F.explode("digests").alias("digest")), ["at", "side"], level)
    pairs = rows.select("at", F.inline(F.array(version("edited", a="own", b="edited"), version("after", a="own", b="after"))))
    differing = differences(pairs, ["at", "side"], level)
    by_row = lambda df, value: df.groupBy("at").agg(*[F.max(F.when(F.col("side") == s, value)).alias(f"{s}_value") for s in ("own", "edited", "after")])
    d, p = by_row(differing, F.size("only_a") + F.size("only_b")).drop("own_value"), by_row(prints, F.col("fingerprint")).select("at", *[F.col(f"{s}_value").alias(f"{s}_print") for s in ("own", "edited")])
    out = rows.select("at", F.col("id").alias(id_col), "n_chars", "edited_sha256", *[F.size(c).alias(f"n_{c}") for c in ("own", "edited", "after")]).join(d, "at").join(p, "at", "left")
    near = lambda side: likeness(F.col("n_own"), F.col(f"n_{side}"), F.col(f"{side}_value"))
    text = lambda side: F.coalesce(f"{side}_print", F.lit(""))
    return out.select(id_col, "n_chars", "edited_sha256", text("own").alias("fingerprint"), text("edited").alias("edited_fingerprint"), near("edited").alias("near_edited"), near("after").alias("near_next"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return fingerprinted(read(spark, sf_dir, "documents"))
