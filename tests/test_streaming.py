"""Streaming slot sums equal the batch sums for every finalised slot."""

import os
import tempfile

from pyspark.sql import functions as F

from paths import SF001
from wattline.operators.panel import load_by
from wattline.sources.tables import readings
from wattline.streaming.load_stream import run_available, stream_load


def test_stream_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="wl-stream-")
    src, out, ck = (os.path.join(root, x) for x in ("src", "out", "ck"))
    r = readings(spark, SF001)
    r.write.parquet(src)
    run_available(stream_load(spark, src, "region"), out, ck)
    got = spark.read.parquet(out)
    batch = load_by(r, "region")
    # the last hour is still open under the watermark; compare the finalised slots
    cut = got.agg(F.max("datetime_15min")).first()[0]
    j = batch.where(F.col("datetime_15min") <= cut).join(got, ["item_id", "datetime_15min"], "left")
    assert got.count() > 0
    assert j.where(F.col("n_clients_approx").isNull()).count() == 0
    assert j.where(F.abs(batch.active_kw - got.active_kw) > 1e-9).count() == 0
