import time

from lattice.streaming.watch import Watcher


def test_one_writer_and_reindex(spark, tmp_path):
    (tmp_path / "a.py").write_text("def one():\n    pass\n")
    seen = []
    first = Watcher(spark, str(tmp_path), on_reindex=seen.append)
    second = Watcher(spark, str(tmp_path))
    try:
        assert first.start() == "writer"
        assert second.start() == "standby"
        wait(lambda: len(seen) == 1)
        (tmp_path / "b.py").write_text("def two():\n    one()\n")
        wait(lambda: len(seen) == 2)
        assert seen[1]["files"] == 2
    finally:
        second.stop()
        first.stop()


def wait(done, seconds=90):
    until = time.time() + seconds
    while not done():
        assert time.time() < until
        time.sleep(0.3)
