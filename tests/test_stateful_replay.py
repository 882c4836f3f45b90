import random

import pytest
from conftest import rows

from skeinwork import streaming
from skeinwork.operators import updates

SCHEMA = "seq long, src long, dst long, typ int"
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset(STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def drop_in(spark, folder, part):
    spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, folder, out, checkpoint):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = streaming.changes(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start(str(out))
    assert q.awaitTermination(120)


def test_replay_goes_on_after_a_restart(rocks, tmp_path):
    r = random.Random(3)
    ops = [(k, r.randrange(4), r.randrange(4), int(r.random() < 0.6)) for k in range(120)]
    shuffled = r.sample(ops, len(ops))
    parts = [shuffled[:40], [*shuffled[40:80], *shuffled[:10], (500, None, 1, 1), (501, 1, 1, None)], [*shuffled[80:], *shuffled[30:50]]]
    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "checkpoint"
    drop_in(rocks, folder, parts[0])
    run(rocks, folder, out, checkpoint)
    first = rocks.read.parquet(str(out))
    assert rows(streaming.edges_after(first)) == rows(updates.replay(None, rocks.createDataFrame(parts[0], SCHEMA)))
    # the query has ended; a new one takes its state from the checkpoint
    for k in (1, 2):
        drop_in(rocks, folder, parts[k])
    run(rocks, folder, out, checkpoint)
    written = rocks.read.parquet(str(out))
    assert rows(streaming.edges_after(written)) == rows(updates.replay(None, rocks.createDataFrame(ops, SCHEMA)))
    # only changes are written: an edge's rows take turns
    seen = {}
    for src, dst, _, present in sorted(rows(written), key=lambda x: x[2]):
        assert seen.get((src, dst), False) != present
        seen[src, dst] = present
    n = written.count()
    run(rocks, folder, out, checkpoint)
    assert rocks.read.parquet(str(out)).count() == n
