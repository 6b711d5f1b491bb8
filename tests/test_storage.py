"""Tables go when they should, and only then."""

import os
import subprocess
import sys
import textwrap
import threading
from pathlib import Path

from pyspark.sql import functions as F

from lumenfold.storage import dealt, materialise, passing_tables, scratch, shared_dir


def test_passing_tables_of_two_threads(spark):
    made, gate, found = {}, threading.Barrier(2), {}

    def work(name, wait):
        with passing_tables():
            made[name] = materialise(spark.range(3))
            gate.wait()
            if wait:
                gate.wait()
                found[name] = made[name].count()
        if not wait:
            gate.wait()

    threads = [threading.Thread(target=work, args=a) for a in (("short", False), ("long", True))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found == {"long": 3}  # after the other thread's tables went
    kept = materialise(spark.range(2))
    with passing_tables():
        gone = scratch(spark)
        spark.range(1).write.parquet(gone)
    assert kept.count() == 2
    assert not os.path.exists(gone.removeprefix("file:")) and os.path.exists(shared_dir(spark).removeprefix("file:"))


def test_nothing_stays_after_stop(tmp_path):
    code = f"""
        from pyspark.sql import SparkSession
        from lumenfold.storage import materialise
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
        assert materialise(spark.range(5)).count() == 5
        spark.stop()
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, timeout=100, env=os.environ | {"PYTHONPATH": str(Path(__file__).parent.parent)}, capture_output=True)
    for _ in range(100):  # the JVM ends a little later
        if not list(tmp_path.glob("shared/table-*")):
            break
        threading.Event().wait(0.1)
    assert not list(tmp_path.glob("shared/table-*"))


def test_dealt_rows_are_not_shuffled_by_a_join(spark):
    rows = spark.range(100).select((F.col("id") % 10).alias("key"), "id")
    table = dealt(rows, "key")
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, rows.collect()))
    joined = table.join(spark.range(10).repartition(3).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice")).hint("shuffle_hash"), "key")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert joined.where("twice = 2 * key").count() == 100
