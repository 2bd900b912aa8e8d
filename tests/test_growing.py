"""Frames of files that grow, as a stream and as a batch."""

import random

import pytest

from veilgrid.sources import growing


def plain(data, form):
    out, at = [], 0
    for m in [*growing.ENDS[form].finditer(data), None]:
        frame = data[at : m.start() if m else len(data)]
        if frame.strip():
            blank = len(frame) - len(frame.lstrip(b"\r\n")) if form == "sse" else 0
            out.append((at + blank, frame[blank:].decode("utf-8", "replace").replace("\r\n", "\n")))
        at = m.end() if m else at
    return out


@pytest.mark.parametrize("form", ["sse", "lines"])
@pytest.mark.parametrize("span", [1, 3, 10, 1 << 20])
def test_ranges_give_each_frame_once(tmp_path, monkeypatch, form, span):
    monkeypatch.setattr(growing, "RANGE", span)
    monkeypatch.setattr(growing, "FIRST", 8)
    rng = random.Random(span)
    for k in range(12):
        data = b"".join(rng.choice([b"data: x", b"\n", b"\n\n", b"\r\n\r\n", b"\n\r\n", "ä文".encode(), b"long " * 9, b"\r"]) for _ in range(rng.randrange(30)))
        (tmp_path / f"f{k}").write_bytes(data)
        source = growing._Batch({"path": str(tmp_path / f"f{k}"), "form": form})
        got = sorted((at, frame) for part in source.partitions() for _, at, frame in source.read(part))
        assert got == plain(data, form), data
        # the stream's offset is the end of the last whole frame
        ends = [m.end() for m in growing.ENDS[form].finditer(data)]
        stream = growing._Stream({"path": str(tmp_path / f"f{k}"), "form": form})
        assert stream.latestOffset() == ({str(tmp_path / f"f{k}"): ends[-1]} if ends else {})


def test_files_that_grow_by_half_frames(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    texts = {n: "".join(f"id: {i}\ndata: {n}{i} {'y' * (i % 40)}\n\n" for i in range(60)).encode() for n in "ab"}
    at = dict.fromkeys(texts, 0)

    def grow(name, n):
        with open(folder / name, "ab") as f:
            f.write(texts[name][at[name] : at[name] + n])
        at[name] += n

    def start():
        return growing.frames_of(spark, str(folder), stream=True).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()

    rng = random.Random(9)
    for turn in range(3):  # each turn is a restart from the checkpoint
        q = start()
        try:
            for _ in range(2):
                for name in texts:
                    grow(name, rng.randrange(100, 500))
                q.processAllAvailable()
        finally:
            q.stop()
        got = spark.read.schema(growing.FRAMES).parquet(str(tmp_path / "out")).collect() if turn or at else []
        for name, data in texts.items():
            whole = [m.end() for m in growing.ENDS["sse"].finditer(data[: at[name]])][-1]
            assert sorted((r.seq, r.frame) for r in got if r.stream_id == name) == plain(data[:whole], "sse")
    for name in texts:
        grow(name, 1 << 20)
    q = start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.read.schema(growing.FRAMES).parquet(str(tmp_path / "out")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, growing.frames_of(spark, str(folder)).collect())) and len(got) == 120


def test_no_files_and_unknown_forms(spark, tmp_path):
    assert growing.frames_of(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        growing._Batch({"path": "x", "form": "xml"})
