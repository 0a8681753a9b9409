"""Event files: every cut of a sample gives the same events, each once."""

import pytest

from paperloom.sources import eventlog
from paperloom.sources.eventlog import Piece, events_in, pieces

EVENTS = [("1", "claim", "a"), (None, "message", "ä 😀\nsecond"), ("3", "message", ""), (None, "end", "x:y")]
SAMPLE = "\ufeffid: 1\nevent: claim\ndata: a\n\n: note\r\ndata: ä 😀\r\ndata:second\r\n\r\nid: 3\rdata\r\r\n\n\nevent: none\n\nevent: end\ndata: x:y\r\rdata: not complete\n".encode()


def plain(data: bytes):
    """Line by line, as the format says."""
    out, event, begin, at = [], b"", 0, 0
    while at < len(data):
        ends = [e for e in (data.find(b"\n", at), data.find(b"\r", at)) if e >= 0]
        if not ends:
            break
        end = min(ends)
        stop = end + (2 if data[end : end + 2] == b"\r\n" else 1)
        if end == at:
            if e := eventlog.parse_event(event.removeprefix(b"\xef\xbb\xbf") if not begin else event):
                out.append((begin, *e))
            event, begin = b"", stop
        else:
            event += data[at:end] + b"\n"
        at = stop
    return out


def test_sample():
    assert [e[1:] for e in plain(SAMPLE)] == EVENTS


@pytest.mark.parametrize("end", [b"\n", b"\r\n", b"\r", None])
def test_every_cut(tmp_path, monkeypatch, end):
    monkeypatch.setattr(eventlog, "LOOK_BACK", 3)
    data = SAMPLE if end is None else SAMPLE.replace(b"\r\n", b"\n").replace(b"\r", b"\n").replace(b"\n", end)
    (tmp_path / "a.events").write_bytes(data)
    want = plain(data)
    assert [w[1:] for w in want] == EVENTS
    for cut in range(len(data) + 1):
        got = [e for p in (Piece("a.events", 0, cut), Piece("a.events", cut, len(data))) for e in events_in(str(tmp_path), p)]
        assert [g[1:] for g in got] == want, cut
    for size in range(1, 40):
        assert [e[1:] for p in pieces({}, {"a.events": len(data)}, size) for e in events_in(str(tmp_path), p)] == want, size


def test_table(spark, tmp_path):
    assert eventlog.event_log(spark, str(tmp_path), stream=False).count() == 0
    (tmp_path / "a.events").write_bytes(SAMPLE)
    (tmp_path / "b.events").write_bytes(b"data: \xff\n\n")
    (tmp_path / "c.txt").write_bytes(SAMPLE)
    got = eventlog.event_log(spark, f"file://{tmp_path}", stream=False, piece=7).orderBy("file", "offset").collect()
    assert [(r.id, r.event, r.data) for r in got] == [*EVENTS, (None, "message", "\ufffd")]


def test_stream_grows_and_restarts(spark, tmp_path):
    """Bytes arrive in cuts that split characters and line ends; each run goes on from the checkpoint."""
    (tmp_path / "in").mkdir()
    rows = []

    def keep(df, number):
        rows.extend((r.file, r.offset, r.id, r.event, r.data) for r in df.collect())

    places = [0, 9, 46, 47, 62, 63, 80, len(SAMPLE)]
    for a, b in zip(places, places[1:], strict=False):
        with open(tmp_path / "in" / "a.events", "ab") as f:
            f.write(SAMPLE[a:b])
        q = eventlog.event_log(spark, str(tmp_path / "in"), piece=16).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(60) and q.exception() is None
    assert sorted(r[1:] for r in rows) == sorted(plain(SAMPLE))
