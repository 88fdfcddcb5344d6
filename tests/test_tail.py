import os

from eventscope.session import work_path
from eventscope.sources.tail import Piece, TailReader, tail_event_log
from eventscope.streaming.runner import await_done


def _drain(spark, path, base, **kw):
    await_done(tail_event_log(spark, path, **kw).writeStream.format("parquet").option("path", f"{base}/out")
               .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
    return sorted((r.file, r.at, bytes(r.value).decode()) for r in spark.read.parquet(f"{base}/out").collect())


def _put(path, data, mode="ab"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(data)


def _local(spark):
    return work_path(spark, "tests", "tail").replace("file:", "")


def test_half_written_line_waits_and_restart_goes_on(spark):
    base = _local(spark)
    log = f"{base}/log/events.json"
    _put(log, b'{"a": 1}\n{"a": 2}\n{"a":')
    assert [x[2] for x in _drain(spark, f"{base}/log", base)] == ['{"a": 1}', '{"a": 2}']
    assert len(_drain(spark, f"{base}/log", base)) == 2          # nothing new: no line twice
    _put(log, b' 3}\n\n{"a": 4}\n')
    _put(f"{base}/log/second.json", "é\n".encode())
    got = _drain(spark, f"{base}/log", base)                      # same checkpoint, a new query
    assert [x[2] for x in got] == ['{"a": 1}', '{"a": 2}', '{"a": 3}', '{"a": 4}', "é"]
    assert [x[1] for x in got if x[0] == "events.json"] == [0, 9, 18, 28]


def test_one_file_and_replaced_file(spark):
    base = _local(spark)
    log = f"{base}/events.json"
    _put(log, b"one\ntwo\nthree\n")
    assert [x[2] for x in _drain(spark, log, base)] == ["one", "two", "three"]
    _put(log, b"new\n", "wb")        # shorter: replaced, read from its start
    assert sorted(x[2] for x in _drain(spark, log, base)) == ["new", "one", "three", "two"]


def test_missing_and_empty_log(spark):
    base = _local(spark)
    _put(f"{base}/log/empty.json", b"")
    _put(f"{base}/log/_hidden", b"x\n")
    _put(f"{base}/log/open.json", b"no newline yet")
    await_done(tail_event_log(spark, f"{base}/log").writeStream.format("parquet").option("path", f"{base}/out")
               .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
    assert TailReader("file:" + f"{base}/nothing", 10).latestOffset() == {}


def test_pieces_read_each_line_once(tmp_path):
    lines = [b"x" * (k % 23) + b"%d" % k for k in range(200)]
    path = tmp_path / "log"
    path.write_bytes(b"\n".join(lines) + b"\nhalf")
    for size in (1, 7, 64, 1 << 20):
        reader = TailReader(f"file:{path}", size)
        end = reader.latestOffset()
        got = [(a, v.as_py()) for p in reader.partitions({}, end) for b in reader.read(p)
               for v, a in zip(b.column(0), b.column(2).to_pylist())]
        assert [v for _, v in got] == lines
        assert [a for a, _ in got] == [sum(len(x) + 1 for x in lines[:k]) for k in range(200)]


def test_long_line_over_many_pieces(tmp_path):
    path = tmp_path / "log"
    path.write_bytes(b"a\n" + b"y" * 300_000 + b"\nb\n")
    reader = TailReader(f"file:{path}", 1000)
    end = reader.latestOffset()
    got = [v.as_py() for p in reader.partitions({}, end) for b in reader.read(p) for v in b.column(0)]
    assert [len(v) for v in got] == [1, 300_000, 1]
    assert list(reader.read(Piece(f"file:{path}", 0, 2000, 3000, 300_005))) == []
