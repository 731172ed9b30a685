"""Pages by number and by key against slices of a sorted list; streamed retries against the batch answer."""

import random

import pytest
from provena.operators import quality
from provena.operators.pages import Paged
from provena.operators.store import Store
from provena.streaming import retries
from pyspark.sql import functions as F


def test_pages_against_a_sorted_list(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "c"]), i, "x" * (i % 3)) for i in range(137)]
    rng.shuffle(rows)
    paged = Paged(spark.createDataFrame(rows, "k string, i int, x string"), ["k", "i"], 5)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    for number, size in ((1, 10), (4, 10), (14, 10), (15, 10), (2, 100), (1, 500)):
        got, total = paged.page(number, size)
        assert total == 137 and [tuple(r) for r in got.collect()] == want[(number - 1) * size : number * size]
    key = None
    for start in range(0, 180, 45):
        got = [tuple(r) for r in paged.after(key, 45)[0].collect()]
        assert got == want[start : start + 45]
        key = got[-1][:2] if got else key
    files = len(paged.page(1, 10)[0].inputFiles())
    assert files < len(paged.ranges) and len(paged.page(13, 10)[0].inputFiles()) <= files + 1  # as little work for a late page
    with pytest.raises(ValueError):
        paged.page(0, 10)
    empty = Paged(spark.createDataFrame([], "k string, i int"), ["k", "i"], 3)
    assert empty.page(1, 5)[1] == 0 and empty.page(1, 5)[0].count() == 0 and empty.after(None, 5)[0].count() == 0
    paged.drop()


def test_retries_over_restarts_with_repeated_and_late_rows(spark, tmp_path):
    rng, log = random.Random(2), tmp_path / "log"
    log.mkdir()
    rows = [(f"i{rng.randrange(12)}", k, rng.random() < 0.15) for k in range(240)]
    rng.shuffle(rows)  # late rows in every file
    rows += rows[:60]  # and repeated ones
    schema, path = "item string, seq long, ok boolean", f"file://{tmp_path}/store"
    for n in range(5):
        spark.createDataFrame(rows[n * 60 : n * 60 + 60], schema).coalesce(1).write.mode("append").json(f"{log}/p{n}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{log}/*")
        if n == 2:  # a writer that had applied its batch, and was lost before the stream knew
            retries.apply(Store(spark, path), "retries-2", spark.createDataFrame(rows[120:180], schema), 4)
        retries.keep(stream, path, f"{tmp_path}/checkpoint", buckets=4).awaitTermination()
        seen = spark.createDataFrame(list(dict.fromkeys(rows[: n * 60 + 60])), schema)
        want = {tuple(r) for r in quality.attempts(seen, "item", F.col("ok"), ["seq"], 5).collect()}
        assert {tuple(r) for r in retries.queue(Store(spark, path), 5).collect()} == want
    assert Store(spark, path).manifest()["version"] == 5
