"""Resumable builds: a killed build goes on where it was, changed inputs begin anew, attempts never mix."""

import os
import subprocess
import sys

from townrisk.sources.chunked import ChunkedBuild, input_fingerprint

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

KILLED = """
import os, sys
sys.path.insert(0, {root!r})
from townrisk.session import build_session
from townrisk.sources.chunked import ChunkedBuild, input_fingerprint
spark = build_session("local[2]", shuffle_partitions=2)
def build(chunk):
    if chunk == "2":  # the process is gone in the middle of a chunk, its files half written
        spark.range(5).write.parquet({out!r} + "/data/half")
        os._exit(9)
    return spark.range(10).selectExpr("id", "'" + chunk + "' as c")
ChunkedBuild(spark, {out!r}, input_fingerprint(spark, [{src!r}], "v1")).run(map(str, range(4)), build)
"""


def test_a_killed_build_goes_on(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.range(100).write.parquet(src)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))}
    code = subprocess.run([sys.executable, "-c", KILLED.format(root=ROOT, out=out, src=src)], env=env, capture_output=True, timeout=240).returncode
    assert code == 9
    built = []

    def build(chunk):
        built.append(chunk)
        return spark.range(10).selectExpr("id", f"'{chunk}' as c")

    names = [str(c) for c in range(4)]
    again = ChunkedBuild(spark, out, input_fingerprint(spark, [src], "v1"))
    assert set(again.finished()) == {"0", "1"}
    assert again.run(names, build) == built == ["2", "3"]
    assert again.read(names).groupBy("c").count().orderBy("c").collect() == [(c, 10) for c in names]
    assert ChunkedBuild(spark, out, input_fingerprint(spark, [src], "v1")).run(names, build) == []


def test_changed_inputs_or_settings_begin_anew(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.range(100).write.parquet(src)
    first = input_fingerprint(spark, [src], "v1")
    assert first == input_fingerprint(spark, [src], "v1") != input_fingerprint(spark, [src], "v2")
    ChunkedBuild(spark, out, first).run(["a"], lambda c: spark.range(3))
    spark.range(7).write.mode("append").parquet(src)
    second = input_fingerprint(spark, [src], "v1")
    assert second != first and ChunkedBuild(spark, out, second).finished() == {}
    assert ChunkedBuild(spark, out, second).run(["a"], lambda c: spark.range(4)) == ["a"]
    assert ChunkedBuild(spark, out, second).read(["a"]).count() == 4 and ChunkedBuild(spark, out, first).read(["a"]).count() == 3


def test_the_first_attempt_of_a_chunk_stays(spark, tmp_path):
    b = ChunkedBuild(spark, str(tmp_path / "out"), "f")
    spark.range(3).write.parquet(f"{tmp_path}/out/one")
    spark.range(5).write.parquet(f"{tmp_path}/out/two")
    assert b._commit("k", f"{tmp_path}/out/one") and not b._commit("k", f"{tmp_path}/out/two")
    assert b.read(["k"]).count() == 3


def test_unfinished_chunks_cannot_be_read(spark, tmp_path):
    import pytest
    b = ChunkedBuild(spark, str(tmp_path / "out"), "f")
    b.run(["a"], lambda c: spark.range(1))
    with pytest.raises(ValueError, match="aren't finished"):
        b.read(["a", "b"])
