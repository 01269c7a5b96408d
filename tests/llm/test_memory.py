"""What the driver holds: arrays of a fit, and memory that is free again."""

import pathlib
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepline.llm import toxicity
from sweepline.llm.common import release_memory


def anonymous_mb(pid):
    return int(re.search(r"\nPss_Anon:\s+(\d+)", pathlib.Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024


def test_fit_holds_one_part_beside_its_arrays(spark):
    width = 600
    word = lambda k: F.concat(F.lit("w"), k.cast("string"))
    counts = spark.range(width * width).select(
        word(F.expr(f"id div {width}")).alias("v"), word(F.col("id") % width).alias("w"), (F.col("id") % 3).alias("ordinary"), (F.col("id") % 5).alias("toxic")
    )
    tracemalloc.start()
    try:
        model = toxicity.kneser_ney(counts, toxicity.Parameters())
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model.keys) == width * width and (np.diff(model.keys) > 0).all()
    assert most < 1.7 * (model.keys.nbytes + model.counts.nbytes), most
    n, names = model.lower.shape[1], model.names.decode().split("\n")
    for at in range(0, len(model.keys), 9973):
        v, w = (int(names[i][1:]) for i in divmod(int(model.keys[at]), n))
        assert model.counts[:, at].tolist() == [(v * width + w) % 3, (v * width + w) % 5]


def test_freed_memory_of_the_jvm_goes_back(spark):
    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    if not pathlib.Path(f"/proc/{pid}/smaps_rollup").exists():
        pytest.skip("memory can't be read here")
    release_memory(spark)
    streams = [jvm.java.util.zip.Deflater() for _ in range(600)]
    full = anonymous_mb(pid)
    for x in streams[:-1]:  # the last one stays, at the end of what was allocated
        x.end()
    kept = anonymous_mb(pid)
    release_memory(spark)
    left = anonymous_mb(pid)
    streams[-1].end()
    assert kept - left > 20, (full, kept, left)
