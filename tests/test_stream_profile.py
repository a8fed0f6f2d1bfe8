import glob
import os

import pytest

from tessera.operators import profile
from tessera.streaming import profiling
from tests.conftest import SF_SMALL

COLS = ["o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "empty"]


def _same(spark, out, whole):
    got = {r["column_name"]: r for r in profiling.read_profile(spark, out, COLS).collect()}
    want = {r["column_name"]: r for r in profile.describe(whole.select(*COLS)).collect()}
    assert got.keys() == want.keys()
    for c, r in want.items():
        for name in ("count", "unique", "top", "freq", "mean", "std", "min", "max"):
            assert got[c][name] == (pytest.approx(r[name], rel=1e-9) if isinstance(r[name], float) else r[name]), (c, name)


def test_micro_batches_equal_the_whole_also_after_a_restart(spark, tmp_root):
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet").selectExpr(
        "o_custkey", "IF(o_orderkey % 9 = 0, NULL, CAST(o_totalprice AS DOUBLE)) AS o_totalprice",
        "IF(o_orderkey % 5 = 0, NULL, o_orderpriority) AS o_orderpriority", "o_orderstatus", "CAST(NULL AS STRING) AS empty")
    src, out, state = (os.path.join(tmp_root, x) for x in ("src", "out", "state"))
    parts = orders.randomSplit([1.0, 2.0, 1.0], 3)

    def run():
        stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(src)
        query = profiling.write_profile(stream, out, state, COLS)
        query.awaitTermination(120)
        assert query.exception() is None

    parts[0].coalesce(2).write.mode("append").parquet(src)
    parts[1].coalesce(1).write.mode("append").parquet(src)
    run()
    _same(spark, out, spark.read.schema(orders.schema).parquet(src))
    # The last batch's commit is lost: a restart runs it again and replaces it.
    commits = [x for x in glob.glob(f"{state}/commits/*") if os.path.basename(x).isdigit()]
    last = max(commits, key=lambda x: int(os.path.basename(x)))
    os.remove(last)
    os.remove(os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc"))
    parts[2].coalesce(1).write.mode("append").parquet(src)
    run()
    whole = spark.read.schema(orders.schema).parquet(src)
    assert whole.count() == orders.count()
    _same(spark, out, whole)
