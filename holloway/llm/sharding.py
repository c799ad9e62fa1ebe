"""A uniform shuffle into shards of exact sizes, with a hypergeometric communication matrix.

Rows are permuted inside their partition (a local sort by a random key, no shuffle). How many rows of each partition go
to each shard is then drawn exactly as a uniform shuffle of all rows would have it: a shard's size is fixed, and going
down a tree over the partitions each node deals its counts to its children by hypergeometric draws. A row's place in its
partition decides its shard; after the exchange each shard is permuted again, in random buckets whose sizes give
each its first slot. All randomness comes from hashes of the seed, and the permuted rows are cut to the shared folder before
they are counted, so tasks that run again give the same rows. Only DataFrame operations are used.

Defined cases: shard sizes differ by one row at most (with fewer rows than shards some are empty); every row is placed
once, copies too; nulls in any column do not matter; an empty table gives an empty result; columns named like an
added one (shard, slot) are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

SHARDS, SEED = 8, 20_240_601
#: Children of a node in the tree over the partitions, as bits; rows of a bucket of a shard; tries of a draw.
FAN_BITS, BUCKET, TRIES = 6, 100_000, 64


def _let(name: str, fields: dict[str, str], body: str) -> str:
    """SQL: ``body`` with ``name.field`` for each field."""
    inside = ", ".join(f"'{k}', {v}" for k, v in fields.items())
    return f"element_at(transform(array(named_struct({inside})), {name} -> {body}), 1)"


def _log_factorial(n: str) -> str:
    """SQL: ln(n!) by its first factors or Stirling's series."""
    first = "array(0D, 0D, 0.6931471805599453D, 1.791759469228055D, 3.1780538303479458D, 4.787491742782046D, 6.579251212010101D, 8.525161361065415D, 10.60460290274525D, 12.801827480081469D)"
    series = f"({n}) * ln({n}) - ({n}) + 0.9189385332046727D + 0.5D * ln({n}) + 1D / (12D * ({n})) - 1D / (360D * pow({n}, 3)) + 1D / (1260D * pow({n}, 5))"
    return f"(CASE WHEN ({n}) < 10 THEN element_at({first}, CAST({n} AS INT) + 1) ELSE {series} END)"


def hypergeometric(good: str, bad: str, sample: str, key: str) -> str:
    """SQL: the number of good ones among ``sample`` drawn from ``good`` + ``bad``, a function of ``key``.

    A ratio-of-uniforms draw: points under a hat of the distribution's deviation are tried until one is below its density.
    """
    lf = _log_factorial
    uniform = lambda i, k: f"((xxhash64({key}, {i}, {k}) & 9007199254740991) + 0.5D) / 9007199254740992D"
    density = f"(h.top - {lf('w.z')} - {lf('h.few - w.z')} - {lf('h.k - w.z')} - {lf('h.many - h.k + w.z')})"
    tried = _let("w", {"x": "p.x", "z": "floor(p.at)"}, f"CASE WHEN p.at >= 0 AND p.at < h.end THEN CASE WHEN 2 * ln(w.x) <= {density} THEN w.z END END")
    tries = f"transform(sequence(0, {TRIES - 1}), i -> {_let('p0', {'x': uniform('i', 1), 'y': uniform('i', 2)}, _let('p', {'x': 'p0.x', 'at': 'h.mean + h.width * (p0.y - 0.5D) / p0.x'}, tried))})"
    found = f"CAST(coalesce(element_at(filter({tries}, z -> z IS NOT NULL), 1), h.mode) AS BIGINT)"
    own = _let("r", {"z": found}, "CASE WHEN d.good > d.bad THEN h.k - r.z ELSE r.z END")
    picked = _let("q", {"z": own}, "CASE WHEN h.k < d.m THEN d.good - q.z ELSE q.z END")
    hat = _let("h", {
        "few": "e.few", "many": "e.many", "k": "e.k", "mode": "e.mode", "mean": "e.k * e.share + 0.5D",
        "width": "1.7155277699214135D * e.dev + 0.8989161620588988D", "end": "least(least(e.k, e.few) + 1D, floor(e.k * e.share + 0.5D + 16 * e.dev))",
        "top": f"{lf('e.mode')} + {lf('e.few - e.mode')} + {lf('e.k - e.mode')} + {lf('e.many - e.k + e.mode')}"}, picked)
    shape = _let("e", {
        "few": "c.few", "many": "c.many", "k": "c.k", "share": "c.few / c.n", "mode": "CAST(floor((c.k + 1D) * (c.few + 1D) / (c.n + 2D)) AS BIGINT)",
        "dev": "sqrt(c.k * CAST(c.n - c.k AS DOUBLE) * (c.few / c.n) * (c.many / c.n) / (c.n - 1) + 0.5D)"}, hat)
    case = _let("c", {"few": "least(d.good, d.bad)", "many": "greatest(d.good, d.bad)", "n": "d.good + d.bad", "k": "least(d.m, d.good + d.bad - d.m)"}, shape)
    return _let("d", {"good": good, "bad": bad, "m": sample}, f"CASE WHEN d.m <= 0 OR d.good <= 0 THEN 0L WHEN d.bad <= 0 THEN d.m WHEN d.m >= d.good + d.bad THEN d.good ELSE {case} END")


def _dealt(seed: int) -> str:
    """SQL: for each child of a node (``children``: id, size) how many of its rows go to each shard; ``counts`` has the node's."""
    draw = hypergeometric("s.g", "a.rest - s.g", "a.left", f"{seed}L, ch.id, s.j")
    one_child = (
        "aggregate(transform(acc.left, (g, j) -> named_struct('g', g, 'j', j)),"
        " named_struct('left', ch.size, 'rest', aggregate(acc.left, 0L, (x, y) -> x + y), 'xs', CAST(array() AS ARRAY<BIGINT>)),"
        f" (a, s) -> {_let('v', {'x': draw}, 'named_struct(' + chr(39) + 'left' + chr(39) + ', a.left - v.x, ' + chr(39) + 'rest' + chr(39) + ', a.rest - s.g, ' + chr(39) + 'xs' + chr(39) + ', concat(a.xs, array(v.x)))')},"
        " a -> a.xs)"
    )
    step = _let("t", {"xs": one_child}, "named_struct('left', zip_with(acc.left, t.xs, (x, y) -> x - y), 'out', concat(acc.out, array(named_struct('id', ch.id, 'counts', t.xs))))")
    return ("aggregate(children, named_struct('left', counts, 'out', CAST(array() AS ARRAY<STRUCT<id: BIGINT, counts: ARRAY<BIGINT>>>)),"
            f" (acc, ch) -> {step}, acc -> acc.out)")


def communication_matrix(sizes: DataFrame, shards: int, total: int, last: int, seed: int = SEED) -> DataFrame:
    """(part, counts): of each partition the number of rows that go to each shard.

    ``sizes`` has (part, n) with parts from 0 to ``last``; row sums are n and column sums the exact shard sizes.
    """
    levels = max(1, -(-max(1, last.bit_length()) // FAN_BITS))
    whole = [total // shards + (j < total % shards) for j in range(shards)]
    now = sizes.sparkSession.range(1).select(F.lit(0).cast("long").alias("id"), F.array(*[F.lit(x).cast("long") for x in whole]).alias("counts"))
    for level in reversed(range(levels)):
        child = F.shiftright("part", level * FAN_BITS)
        nodes = sizes.groupBy(child.alias("child")).agg(F.sum("n").alias("size"))
        families = nodes.groupBy(F.shiftright("child", FAN_BITS).alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("child").alias("id"), "size"))).alias("children"))
        now = cut(now.join(families, "id").select(F.explode(F.expr(_dealt(seed + level))).alias("c")).select("c.id", "c.counts"))
    return now.select(F.col("id").alias("part"), "counts")


def shuffle(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with shard (0 to shards - 1) and slot (0 up, without gaps in a shard): a uniform random order.

    All columns of ``df`` go through the exchange; select those that are wanted.
    """
    columns = [c for c in df.columns if c not in ("shard", "slot")]
    mark = F.monotonically_increasing_id()
    first = df.select(F.struct(*columns).alias("row"), F.xxhash64(F.lit(seed), mark).alias("key")).sortWithinPartitions("key")
    rows = cut(first.select("row", F.shiftright(mark, 33).alias("part"), mark.bitwiseAND((1 << 33) - 1).alias("place")))
    sizes = cut(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")))
    total, last = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("part"), F.lit(0))).first()
    matrix = communication_matrix(sizes, shards, total, last, seed)
    ends = F.expr("transform(sequence(1, size(counts)), k -> aggregate(slice(counts, 1, k), 0L, (x, y) -> x + y))")
    buckets = max(16, -(-total // (shards * BUCKET)))
    again = F.xxhash64(F.lit(seed + 1_000_003), "part", "place")
    sent = (rows.join(matrix.select("part", ends.alias("ends")), "part")
            .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("place"))))
            .withColumn("key", again).withColumn("bucket", F.pmod("key", F.lit(buckets))).drop("ends"))
    sent = cut(sent)
    # First slot of each bucket: a running sum over at most ``buckets`` rows of a shard.
    filled = sent.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    begins = filled.selectExpr("shard", "bucket", "sum(n) OVER (PARTITION BY shard ORDER BY bucket) - n AS begin")
    placed = sent.selectExpr("*", "row_number() OVER (PARTITION BY shard, bucket ORDER BY key, part, place) - 1 AS at")
    return placed.join(begins, ["shard", "bucket"]).select("row.*", "shard", (F.col("begin") + F.col("at")).alias("slot"))


def write_shards(shuffled: DataFrame, path: str, files: int = 64) -> None:
    """Write each shard to its own folder; about ``files`` files in all, each with successive slots in order."""
    (shuffled.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
     .write.mode("errorifexists").partitionBy("shard").parquet(path))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return shuffle(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
