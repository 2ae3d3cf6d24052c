import pytest

from tidemark import session
from tidemark.sources.frames import from_msgpack


def test_small_sides_are_sent_and_large_ones_are_not(spark):
    df = spark.createDataFrame([(1, "x" * 100), (2, None)], "k long, v string")
    assert session.broadcast_if_small(df, "t", 10, 10_000)[1]
    assert not session.broadcast_if_small(df, "t", 1, 10_000)[1] and not session.broadcast_if_small(df, "t", 10, 50)[1]
    table, small = session.broadcast_if_small(df.limit(0), "t", 0, 0)
    assert small and table.count() == 0


def test_tables_can_be_cleared(spark):
    import os

    table = session.materialize(spark.range(3), "gone")
    assert table.count() == 3
    session.clear_tables(spark)
    assert not os.path.exists(session._own_folder(spark))


def test_a_cluster_needs_its_shared_folder(monkeypatch, spark):
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_msgpack_is_gated(spark):
    pytest.importorskip("pyspark")
    try:
        import msgpack  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="msgpack"):
            from_msgpack(spark.createDataFrame([(b"x",)], "value binary"))


def test_workers_find_the_package_from_any_folder(tmp_path):
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(session.__file__)))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as e
from tidemark.session import build_session
spark = build_session("elsewhere", cores=2, partitions=2)
print("ROWS", e.queries()["p5_found"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
