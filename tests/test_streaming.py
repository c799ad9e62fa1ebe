"""Streams give what tables give."""

from holloway.streaming.events import activity, once


def run(frame, mode, name):
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return frame.sparkSession.table(name)


def test_stream_equals_table(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    key = lambda t: sorted((str(r.start), r.event_type, r.n, round(r.total, 6)) for r in t.collect())
    assert key(run(activity(stream), "complete", "windows")) == key(activity(table))


def test_repeats_go(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet").limit(200)
    table.unionAll(table).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    assert run(once(stream, late="4000 days"), "append", "single").count() == once(table.unionAll(table)).count()
