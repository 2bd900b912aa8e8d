import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilgrid.llm import media, warc, winnow
from veilgrid.llm.common import scratch
from veilgrid.llm.queries import ORACLES, op3_media, op5_winnow, op9_warc


def test_frames_are_lossless():
    x = np.random.default_rng(0).integers(0, 256, (300, 192)).astype(np.uint8)
    x[0], x[1], x[2] = 0, 255, np.tile([0, 255], 96)
    assert (media.decode_frames(media.encode_frames(x)) == x).all()
    assert media.read_avi(media.write_avi(media.encode_frames(x))) == media.encode_frames(x)


def test_a_plain_decoder_reads_the_frames():
    """Huffman codes read bit by bit, after the standard."""
    x = np.random.default_rng(1).integers(0, 256, (3, 192)).astype(np.uint8)
    for row, file in zip(x, media.encode_frames(x)):
        scan = file[file.index(b"\xff\xda") + 10 : -2].replace(b"\xff\0", b"\xff")
        bits = "".join(f"{b:08b}" for b in scan)
        at, value = 0, 0
        for want in row:
            k = int(bits[at : at + 4], 2)
            raw = int(bits[at + 4 : at + 4 + k] or "0", 2)
            value += raw if not k or raw >> (k - 1) else raw - (1 << k) + 1
            at += 4 + k + 1
            assert bits[at - 1] == "0" and value + 128 == want


def plain_jpeg(planes, steps, sampling, restart=0):
    """A baseline file, written term by term with fixed-length codes; and the pictures that its rounded terms stand for."""
    order = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    cos = np.array([[(np.sqrt(0.125) if k == 0 else 0.5) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])
    symbols = [r << 4 | s for r in range(16) for s in range(1, 11)] + [0, 0xF0]
    seg = lambda m, b: bytes([0xFF, m, (len(b) + 2) >> 8, (len(b) + 2) & 255]) + b
    height, width = planes[0].shape
    most = max(s[0] for s in sampling), max(s[1] for s in sampling)
    units = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
    out, bits, wanted = b"", "", [np.zeros((units[1] * 8 * s[1], units[0] * 8 * s[0])) for s in sampling]
    before, scan, unit = [0] * len(planes), b"", 0

    def number(v):
        size = int(abs(v)).bit_length()
        return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    def flush():
        nonlocal bits, scan
        bits += "1" * (-len(bits) % 8)
        scan += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        bits = ""

    for uy in range(units[1]):
        for ux in range(units[0]):
            if restart and unit and unit % restart == 0:
                flush()
                scan += bytes([0xFF, 0xD0 + (unit // restart - 1) % 8])
                before = [0] * len(planes)
            unit += 1
            for c, (sx, sy) in enumerate(sampling):
                for by in range(sy):
                    for bx in range(sx):
                        y, x = 8 * (uy * sy + by), 8 * (ux * sx + bx)
                        full = np.zeros((8, 8))
                        part = planes[c][y : y + 8, x : x + 8]
                        full[: part.shape[0], : part.shape[1]] = part - 128.0
                        q = np.rint(cos @ full @ cos.T / steps).astype(int)
                        wanted[c][y : y + 8, x : x + 8] = np.clip(np.rint(cos.T @ (q * steps) @ cos + 128), 0, 255)
                        size, extra = number(int(q[0, 0]) - before[c])
                        before[c] = int(q[0, 0])
                        bits += format(size, "04b") + extra
                        run = 0
                        last = max([k for k in range(1, 64) if q[order[k]]], default=0)
                        for k in range(1, last + 1):
                            v = int(q[order[k]])
                            if v == 0:
                                run += 1
                                continue
                            while run > 15:
                                bits += format(symbols.index(0xF0), "08b")
                                run -= 16
                            size, extra = number(v)
                            bits += format(symbols.index(run << 4 | size), "08b") + extra
                            run = 0
                        if last < 63:
                            bits += format(symbols.index(0), "08b")
    flush()
    n = len(planes)
    out = b"\xff\xd8" + seg(0xE0, b"AVI1\0") + seg(0xDB, bytes([0]) + bytes(int(steps[p]) for p in order))
    out += seg(0xC0, bytes([8, height >> 8, height & 255, width >> 8, width & 255, n]) + b"".join(bytes([c + 1, sx << 4 | sy, 0]) for c, (sx, sy) in enumerate(sampling)))
    out += seg(0xC4, bytes([0x00, 0, 0, 0, 12] + [0] * 12) + bytes(range(12))) + seg(0xC4, bytes([0x10] + [0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols))
    if restart:
        out += seg(0xDD, bytes([restart >> 8, restart & 255]))
    return out + seg(0xDA, bytes([n]) + b"".join(bytes([c + 1, 0]) for c in range(n)) + bytes([0, 63, 0])) + scan + b"\xff\xd9", wanted


@pytest.mark.parametrize("sampling,restart", [([(1, 1)], 0), ([(1, 1)], 3), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2)])
def test_frames_of_other_writers(sampling, restart):
    r = np.random.default_rng(3)
    steps = 1 + r.integers(0, 30, (8, 8))
    most = max(s[0] for s in sampling), max(s[1] for s in sampling)
    files, pictures = [], []
    for k in range(3):
        height, width = 40, 50
        y, x = np.mgrid[0:height, 0:width]
        base = 128 + 60 * np.sin(x / (5 + k)) * np.cos(y / 7) + r.normal(0, 20, (height, width))
        planes = [np.clip(base, 0, 255)] + [np.clip(base[:: most[1], :: most[0]] + 20 * c, 0, 255) for c in range(1, len(sampling))]
        file, wanted = plain_jpeg(planes, steps, sampling, restart)
        files.append(file)
        pictures.append(wanted)
    for got, wanted in zip(media.decode_pictures(files), pictures):
        for c, (sx, sy) in enumerate(sampling):
            want = wanted[c].repeat(most[1] // sy, 0).repeat(most[0] // sx, 1)[:40, :50]
            assert np.abs(got[c].astype(int) - want).max() <= 1
    grey = media.decode_frames(files)
    means = [w[0].reshape(w[0].shape[0] // 8, 8, -1, 8).mean((1, 3)).ravel() for w in pictures]
    assert np.abs(grey - np.array(means)[:, : grey.shape[1]]).max() < 20 and np.abs(grey - np.array(means)).mean() < 1.5
    for bad in (files[0][:300], files[0].replace(b"\xff\xc0", b"\xff\xc2"), b"GIF89a" + files[0]):
        with pytest.raises(ValueError):
            media.decode_frames([bad])


def test_the_standard_codes():
    for said, end, long_run in ((media._AC_LUMA, "1010", "11111111001"), (media._AC_CHROMA, "00", "1111111010")):
        symbol, length = media._standard(said)
        for code, want in ((end, 0), (long_run, 0xF0)):
            at = int(code.ljust(16, "0"), 2)
            assert (symbol[at], length[at]) == (want, len(code))
        assert len(set(symbol[length > 0].tolist())) == 162 and not length[-1] and length[-3]


def test_files_of_other_writers():
    """Places that count from the file's begin, lists of records, no index, a sound stream first, dropped frames."""
    frames = media.encode_frames(np.random.default_rng(2).integers(0, 256, (4, 192)).astype(np.uint8))
    chunk = lambda k, b: k + len(b).to_bytes(4, "little") + b + b"\0" * (len(b) % 2)
    strl = lambda kind, handler: chunk(b"LIST", b"strl" + chunk(b"strh", kind + handler + bytes(12) + (1).to_bytes(4, "little") + (10).to_bytes(4, "little") + bytes(24)))
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", bytes(56)) + strl(b"auds", bytes(4)) + strl(b"vids", b"mjpg"))
    records = b"".join(chunk(b"LIST", b"rec " + chunk(b"00wb", b"abc") + chunk(b"01dc", f)) for f in frames)
    file = chunk(b"RIFF", b"AVI " + head + chunk(b"JUNK", b"x") + chunk(b"LIST", b"movi" + records))
    assert media.read_avi(file) == frames and media.rate_of(file) == 10
    body = chunk(b"00wb", b"abc") + chunk(b"01db", frames[0]) + chunk(b"01dc", b"") + chunk(b"01dc", frames[1])
    begin = 12 + len(head) + 12
    places, at = [], begin
    for kind, size in ((b"00wb", 3), (b"01db", len(frames[0])), (b"01dc", 0), (b"01dc", len(frames[1]))):
        places.append(kind + (16).to_bytes(4, "little") + at.to_bytes(4, "little") + size.to_bytes(4, "little"))
        at += 8 + size + size % 2
    file = chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", b"movi" + body) + chunk(b"idx1", b"".join(places)))
    assert media.read_avi(file) == [frames[0], frames[0], frames[1]]
    part = lambda kind, some: chunk(b"RIFF", kind + (head if kind == b"AVI " else b"") + chunk(b"LIST", b"movi" + b"".join(chunk(b"01dc", f) for f in some)))
    assert media.read_avi(part(b"AVI ", frames[:2]) + part(b"AVIX", frames[2:])) == frames


def test_shots_and_broken_files():
    x = np.vstack([np.full((6, 192), 10), np.full((5, 192), 200)]).astype(np.uint8)
    assert media.shots(x) == [(0, 6), (6, 11)]
    file = media.write_avi(media.encode_frames(x))
    for bad in (b"RIFX" + file[4:], file[:-10], file[:20]):
        with pytest.raises((ValueError, __import__("struct").error)):
            media.read_avi(bad)


def test_op3(spark, data, texts, odd):
    want = {r.doc_id: (r.text or "").encode() for r in texts.collect()}
    rows = op3_media(spark, data).collect()
    assert len(rows) == len(want)
    for r in rows:
        p = want[r.doc_id] + b" " * (max(1, -(-len(want[r.doc_id]) // 192)) * 192 - len(want[r.doc_id]))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(want[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    got = media.describe_media(odd).collect()
    assert len(got) == 10 and len({(r.media_sha256, r.feature) for r in got if r.doc_id in (5, 6)}) == 1
    assert {r.payload_bytes for r in got if r.doc_id in (1, 2)} == {192}
    found = media.clips(media.store_media(odd)).groupBy("doc_id").agg(F.sum("n_frames").alias("n"), F.max("end_s").alias("e")).collect()
    assert {r.doc_id: r.n for r in found}[1] == 1 and all(abs(r.e * 25 - r.n) < 1e-6 for r in found if r.doc_id not in (5,))
    assert media.describe_media(odd.limit(0)).count() == 0


def pages(spark):
    rows = [(3, "http://a/x y", "<p>one</p>"), (1, None, "<p>one</p>"), (2, "http://b/\r\n", None), (9, "u", ""), (None, "n", "<p>two</p>"), (5, "v", "é" * 40000), (7, "w", "<p>one</p>"), (7, "w", "<p>one</p>")]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, revisit string")


def test_op9(spark, data):
    import duckdb

    got = sorted(map(tuple, op9_warc(spark, data).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{data}/pages.parquet')")
    assert got == sorted(c.sql(ORACLES["op9_warc"]).fetchall())


def test_archives(spark):
    path = scratch(spark, "warc")
    warc.write_warc(pages(spark), path)
    rows = {(r.page_id, r.record_type): r for r in warc.read_warc(spark, path).collect()}
    assert {k for k in rows} == {(1, "response"), (3, "revisit"), (7, "revisit"), (2, "response"), (9, "revisit"), (None, "response"), (5, "response")}
    assert rows[3, "revisit"].refers_to == 1 and rows[9, "revisit"].refers_to == 2 and rows[9, "revisit"].payload_bytes == 0
    assert rows[5, "response"].payload.decode() == "é" * 40000 and rows[1, "response"].payload_digest == warc.digest(b"<p>one</p>")
    assert warc.read_warc(spark, path).count() == 8
    some = warc.read_warc(spark, path, "page_id long, record_type string").where("record_type = 'revisit'")
    assert "record_type" in some._jdf.queryExecution().executedPlan().toString() and {r.page_id for r in some.collect()} == {3, 7, 9}
    assert [r.page_id for r in warc.read_warc(spark, path).where(F.col("page_id") == 5).collect()] == [5]
    kept = scratch(spark, "warc")
    warc.write_warc(pages(spark), kept, min_bytes=5)
    assert {r.page_id for r in warc.read_warc(spark, kept).where("record_type = 'revisit'").collect()} == {3, 7}
    none = scratch(spark, "warc")
    warc.write_warc(pages(spark).limit(0), none)
    assert warc.read_warc(spark, none).count() == 0


def foreign(kind, uri, block, version="1.0", **more):
    head = [f"WARC/{version}", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{zlib.crc32(block):08x}-0000>", "WARC-Date: 2020-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {uri}"] * bool(uri) + [f"{k.replace('_', '-')}: {v}" for k, v in more.items()] + [f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


RECORDS = [
    foreign("warcinfo", "", b"software: x\r\n", Content_Type="application/warc-fields"),
    foreign("request", "http://a/", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request"),
    foreign("response", "<http://a/>", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>one</p>", Content_Type="application/http; msgtype=response"),
    foreign("revisit", "http://b/", b"HTTP/1.1 200 OK\r\n\r\n", "1.1", WARC_Payload_Digest="sha1:ABC", WARC_Refers_To="<urn:uuid:1>", Content_Type="application/http;\r\n  msgtype=response"),
    foreign("resource", "file://c", b"WARC/1.0\r\n\r\n" * 9000, "1.1", Content_Type="text/plain"),
]


@pytest.mark.parametrize("form", ["plain", "members", "one", "named"])
def test_archives_of_other_writers(spark, tmp_path, form):
    import gzip
    import io

    def named(data):
        out = io.BytesIO()
        with gzip.GzipFile("some name", "wb", fileobj=out) as f:
            f.write(data)
        return out.getvalue()

    data = {"plain": b"".join, "members": lambda r: b"".join(map(gzip.compress, r)), "one": lambda r: gzip.compress(b"".join(r)), "named": lambda r: b"".join(map(named, r))}[form](RECORDS)
    path = tmp_path / ("a.warc" if form == "plain" else "a.warc.gz")
    path.write_bytes(data)
    warc.register(spark)
    read = lambda split: spark.read.format("warc").option("split_bytes", split).load(str(tmp_path))
    for split in (1 << 20, 100):
        rows = {r.record_type: r for r in read(split).collect()}
        assert sorted(rows) == ["request", "resource", "response", "revisit", "warcinfo"] and read(split).count() == 5
        assert rows["response"].payload == b"<p>one</p>" and rows["response"].target_uri == "http://a/" and rows["response"].page_id is None and rows["response"].record_id.startswith("<urn:uuid:")
        assert (rows["revisit"].payload, rows["revisit"].payload_bytes, rows["revisit"].payload_digest, rows["revisit"].refers_to_id) == (None, None, "ABC", "<urn:uuid:1>")
        assert rows["resource"].payload == b"WARC/1.0\r\n\r\n" * 9000 and rows["warcinfo"].target_uri is None
    assert [r.payload for r in read(100).where("record_type = 'response'").collect()] == [b"<p>one</p>"]
    for bad in (data[:-30], b"WARX" + data[4:] if form == "plain" else data[:20] + b"xx" + data[22:]):
        path.write_bytes(bad)
        with pytest.raises(Exception):
            read(1 << 20).collect()


@pytest.mark.parametrize("split", [1, 200, 1000, 5000, 1 << 20])
def test_ranges_of_a_file_have_each_record_once(spark, tmp_path, monkeypatch, split):
    """Payloads that hold whole members, stored as they are, are not taken for members of the file."""
    monkeypatch.setattr(warc._Plain, "STEP", 300)  # so that reads go back to places that are no longer held
    r = random.Random(5)
    inner = b"".join(warc.member(warc.record(900 + k, "in", r.randbytes(50), None, False)) for k in range(30))
    pages = [(k, inner if k % 7 == 3 else r.randbytes(r.randrange(300)) if k % 2 else b"text " * r.randrange(200)) for k in range(60)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.member(warc.record(k, "u", p, None, False)) for k, p in pages))
    (tmp_path / "b.warc.gz").write_bytes(b"")
    reader = warc.WarcReader(warc.StructType.fromDDL(warc.SCHEMA), {"path": str(tmp_path), "split_bytes": str(split)})
    parts = reader.partitions()
    rows = [x for p in parts for batch in reader.read(p) for x in batch.to_pylist()]
    assert sorted((x["page_id"], x["payload"]) for x in rows) == pages and (split > 5000 or len(parts) > 1)


def plain_hash(gram, k):
    number = lambda b: xxhash.xxh64_intdigest(b, seed=42)
    if len(gram) < k or k % 2:
        return number(gram) >> (winnow.PLACE_BITS + 1)
    h = (number(gram[: k // 2]) << k // 2 & (1 << 64) - 1) ^ number(gram[k // 2 :])
    return h >> (winnow.PLACE_BITS + 1)


def plain_winnow(text, k, w):
    b = text.encode()
    if not b:
        return []
    h = [plain_hash(b[j : j + k], k) for j in range(max(1, len(b) - k + 1))]
    chosen = set()
    for j in range(max(1, len(h) - w + 1)):
        window = h[j : j + w]
        chosen.add(j + max(i for i, x in enumerate(window) if x == min(window)))
    return sorted((j, h[j]) for j in chosen)


@pytest.mark.parametrize("k,w", [(3, 5), (2, 7), (16, 16), (1, 1), (7, 4)])
def test_places_against_plain_winnowing(spark, monkeypatch, k, w):
    monkeypatch.setattr(winnow, "SEGMENT", 10)
    r = random.Random(0)
    some = [None, "", "a", "ababab"] + ["".join(r.choice("abcé") for _ in range(r.randrange(60))) for _ in range(30)]
    got = {}
    for x in winnow.places(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), k, w).collect():
        got.setdefault(x.doc_id, []).append((x.place, x.hash))
    assert all(sorted(got.get(i, [])) == plain_winnow(t or "", k, w) for i, t in enumerate(some))


@pytest.mark.parametrize("k,w,letters", [(3, 5, "ab"), (2, 7, "abcé"), (16, 16, "abcdé"), (16, 16, "a"), (1, 1, "ab"), (5, 2, "ab")])
def test_marks_of_edited_texts(spark, k, w, letters):
    """What is put together from the marks of two texts is what winnowing the edited text itself gives."""
    r = random.Random(1)
    some = ["".join(r.choice(letters) for _ in range(r.choice([0, 1, 5, 20, 60, 200, 500]))) for _ in range(150)]
    pairs = [(i, a, b) for i, (a, b) in enumerate(zip(some, some[1:]))]
    cut = lambda a, b: (a[: len(a) - len(a) // 2], b[: len(a) // 2])
    rows = spark.createDataFrame([(i, a, b, "".join(cut(a, b)), len(cut(a, b)[0].encode())) for i, a, b in pairs], "i int, a string, b string, e string, seam int")
    f = lambda c: winnow.marks(winnow.fingerprint(F.col(c), k, w))
    rows = rows.withColumns({"fa": f("a"), "fb": f("b")}).select("i", "e", winnow.edited_marks(F.col("e"), F.col("seam"), F.col("fa"), F.col("fb"), k, w).alias("f"))
    for x in rows.collect():
        assert [tuple(m) for m in x.f] == plain_winnow(x.e, k, w), (x.i, x.e)


def test_op5(spark, data, texts):
    rows = {r.doc_id: r for r in op5_winnow(spark, data).collect()}
    docs = sorted((r.doc_id, r.text or "") for r in texts.collect())
    assert len(rows) == len(docs)
    sets = {t: {h for _, h in plain_winnow(t, 16, 16)} for _, t in docs}
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for n, (i, t) in enumerate(docs):
        after = docs[(n + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        if n % 5 == 0:
            assert abs(r.near_edited - like(sets[t], {h for _, h in plain_winnow(edited, 16, 16)})) < 1e-9
        assert abs(r.near_next - like(sets[t], sets[after])) < 1e-9


def test_winnowing_of_odd_rows(spark, odd):
    rows = winnow.compare_edited(odd).collect()
    assert len(rows) == 10 and len({r.fingerprint for r in rows if r.doc_id in (5, 6)}) == 1
    assert {r.n_chars for r in rows if r.doc_id in (1, 2)} == {0}
    assert winnow.compare_edited(odd.limit(0)).count() == 0
    one = winnow.compare_edited(odd.where("doc_id = 4")).collect()[0]
    assert one.near_next == 1.0
