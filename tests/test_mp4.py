"""MP4 files put together box by box."""

import struct

import pytest

from clipsieve.sources import mp4, readers


def box(name, *parts, wide=False):
    body = b"".join(parts)
    return struct.pack(">I4sQ", 1, name, 16 + len(body)) + body if wide else struct.pack(">I4s", 8 + len(body), name) + body


def track(kind=b"vide", n=30, scale=600, stts=((30, 20),), size=(64, 48), version=0, number=1):
    times = struct.pack(">IQQIQ", 1 << 24, 0, 0, scale, 9) if version else struct.pack(">IIIII", 0, 0, 0, scale, 9)
    head = struct.pack(">IQQI", 1 << 24, 0, 0, number) if version else struct.pack(">IIII", 0, 0, 0, number)
    stbl = box(b"stbl", box(b"stsd", bytes(8)), box(b"stts", struct.pack(">II", 0, len(stts)), *(struct.pack(">II", *x) for x in stts)), box(b"stsz", struct.pack(">III", 0, 0, n), bytes(4 * n)))
    mdia = box(b"mdia", box(b"mdhd", times), box(b"hdlr", bytes(8), kind, bytes(12)), box(b"minf", stbl))
    return box(b"trak", box(b"tkhd", head, bytes(60), struct.pack(">II", size[0] << 16, size[1] << 16)), mdia)


def movie(*tracks):
    return box(b"moov", box(b"mvhd", bytes(100)), *tracks)


FTYP, MDAT = box(b"ftyp", b"isom", bytes(4)), box(b"mdat", b"moov" * 50)


@pytest.mark.parametrize("data", [FTYP + movie(track()) + MDAT, FTYP + MDAT + movie(track()), FTYP + box(b"mdat", b"x" * 99, wide=True) + movie(track()), FTYP + movie(track(version=1)) + struct.pack(">I4s", 0, b"mdat") + b"to the end"])
def test_order_and_sizes(data):
    assert mp4.movie(data) == (30.0, 64, 48, 30, 1.0)


def test_tracks_and_rates():
    sound = track(b"soun", n=1000, scale=44100, stts=((1000, 1024),), size=(0, 0))
    assert mp4.movie(FTYP + movie(sound, track(n=5, scale=1000, stts=((2, 100), (3, 200)), size=(1920, 1080)))) == (6.25, 1920, 1080, 5, 0.8)
    assert mp4.movie(movie(track(n=30, scale=30_000, stts=((30, 1001),))))[0] == pytest.approx(29.97002997)
    assert mp4.movie(movie(track(n=0, stts=())))[3] == 0


def test_fragments():
    tfhd = lambda number: box(b"tfhd", struct.pack(">III", 8, number, 20))
    part = lambda number, n: box(b"moof", box(b"mfhd", bytes(8)), box(b"traf", tfhd(number), box(b"trun", struct.pack(">II", 0x200, n), bytes(4 * n))))
    timed = box(b"moof", box(b"traf", tfhd(1), box(b"trun", struct.pack(">II", 0x300, 2), struct.pack(">IIII", 30, 7, 50, 7))))
    assert mp4.movie(FTYP + movie(track(n=0, stts=())) + part(1, 10) + part(2, 99) + part(1, 5) + timed)[::3] == (17 * 600 / 380, 17)


@pytest.mark.parametrize("data", [b"", b"moov", FTYP, FTYP + movie(), FTYP + movie(track(b"soun")), (FTYP + movie(track()))[:-5], FTYP + struct.pack(">I4s", 7, b"moov"), b"\0" * 100, FTYP + movie(box(b"trak", box(b"mdia")))])
def test_broken(data):
    with pytest.raises((ValueError, struct.error)):
        mp4.movie(data)


def test_folder(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "a.mp4").write_bytes(FTYP + movie(track()) + MDAT)
    (tmp_path / "b" / "c.mp4").write_bytes(b"broken")
    (tmp_path / "no.txt").write_bytes(b"")
    got = {r["path"].rpartition("/")[2]: (r["frame_count"], r["fps"], r["width"], r["duration_sec"]) for r in mp4.probe_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.mp4": (30, 30.0, 64, 1.0), "c.mp4": (0, 0.0, 0, 0.0)}
    paths = spark.createDataFrame([(str(tmp_path / "a.mp4"),), ("gone",)], "path string")
    probe = mp4.probe_folder(spark, str(tmp_path)).selectExpr("replace(path, 'file:', '') AS path", "CAST(frame_count AS INT) AS frame_count")
    assert sorted(r["frame_count"] for r in readers.probed_counts(paths, probe).collect()) == [0, 30]
    none = spark.createDataFrame([(1, None)], "path long, content binary")
    assert mp4.probe_movies(none).first()["frame_count"] == 0 and mp4.probe_movies(none.limit(0)).isEmpty()
