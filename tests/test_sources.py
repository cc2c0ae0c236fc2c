import json
import struct

import numpy as np
import pytest

from tessitura.operators import etl, signal
from tessitura.sources import files
from tessitura.streaming import scans


def _vorbis(*pairs):
    b = struct.pack("<I", 3) + b"ref" + struct.pack("<I", len(pairs))
    for k, v in pairs:
        e = f"{k}={v}".encode()
        b += struct.pack("<I", len(e)) + e
    return b


def _flac(*pairs):
    info = bytes(10) + ((44100 << 44) | (1 << 41) | (15 << 36) | 1000).to_bytes(8, "big") + bytes(16)
    c = _vorbis(*pairs)
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([132]) + len(c).to_bytes(3, "big") + c


def test_flac_tags_keep_order_and_repeats():
    t = files.flac_tags(_flac(("ARTIST", "A"), ("artist", "B"), ("Title", "Ç")))
    assert [(k, v) for k, v, _, _ in t] == [("ARTIST", "A"), ("artist", "B"), ("Title", "Ç")]
    assert files.flac_stream(_flac()) == {"rate": 44100, "channels": 2, "depth": 16, "samples": 1000}


@pytest.mark.parametrize("cut", range(0, 90, 7))
def test_truncated_flac_never_crashes(cut):
    with pytest.raises((ValueError, IndexError)):
        files.flac_stream(_flac(("A", "b"))[: min(cut, 20)])


def test_ape_round_trip_and_replacement():
    data = files.with_ape_tags(b"body", [("Artist", "A"), ("ARTIST", "B"), ("Title", "T")])
    assert [(k, v) for k, v, _, _ in files.ape_tags(data)] == [("Artist", "A"), ("Artist", "B"), ("Title", "T")]
    again = files.with_ape_tags(data, [("X", "1")])
    assert again.startswith(b"body") and [(k, v) for k, v, _, _ in files.ape_tags(again)] == [("X", "1")]
    assert files.ape_tags(b"no tag") == []


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_wav_round_trip(bits):
    x = np.random.default_rng(0).uniform(-1, 1, (100, 2))
    rate, y = files.wav(files.to_wav(x, 48000, bits))
    assert rate == 48000 and np.abs(x - y).max() < 1.5 / 2 ** (min(bits, 24) - 1)


def test_stream_blocks_round_trip(spark):
    head = files.header_payload(12345, 7, 48000, 28, 2, True, 6)
    data = b"ID3\x03\0\0\0\0\0\x02ab" + files.STREAM_MAGIC + files.block("SH", head, True) + files.block("AP", bytes(300)) + files.block("SE", b"")
    got = list(files.stream_blocks(data))
    assert [(k, len(p)) for k, _, _, p in got] == [("SH", len(head) + 4), ("AP", 300), ("SE", 0)]
    h = files.stream_header(got[0][3])
    assert (h["samples"], h["silence"], h["rate"], h["bands"], h["channels"], h["block_power"]) == (12345, 7, 48000, 28, 2, 6)
    rows = files.blocks(spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"junk"))], "path string, content binary")).collect()
    assert [r.key for r in rows if r.path == "a"] == ["SH", "AP", "SE"] and next(r for r in rows if r.path == "b").error


def _manifest(title, tracks=4, edition="E"):
    return {"format": "x", "version": 1, "album": {"title": title, "artists": [{"name": "A"}], "releaseType": "album"}, "release": {"edition": edition},
            "media": [{"disc": 1, "tracks": [{"track": i + 1, "title": f"t{i}", "audio": {"path": f"audio/{i}.flac"}} for i in range(tracks)]}]}


def _write(root, name, doc):
    (root / name).mkdir(parents=True, exist_ok=True)
    (root / name / "manifest.json").write_text(doc if isinstance(doc, str) else json.dumps(doc))


def _scan(spark, root, state, run):
    from pyspark.sql import functions as F

    f = files.manifests(spark, str(root)).select(F.col("package").alias("path"), "manifest_sha256", "fingerprint", "problems", F.lit(0).alias("missing"))
    table, counters = etl.scan(state, f, run)
    rows = table.collect()
    return spark.createDataFrame(rows, etl.PACKAGES), counters.first().asDict()


def test_scan_scenario(spark, tmp_path):
    root = tmp_path / "lib"
    root.mkdir()
    state = spark.createDataFrame([], etl.PACKAGES)
    _write(root, "a.mpack", _manifest("One"))
    _write(root, "b.mpack", _manifest("Two", 3))
    _write(root, "a.mpack/inner.mpack", _manifest("hidden"))
    state, c = _scan(spark, root, state, "s1")
    assert (c["total"], c["added"]) == (2, 2)
    state, c = _scan(spark, root, state, "s2")
    assert (c["unchanged"], c["added"], c["updated"], c["removed"]) == (2, 0, 0, 0)
    _write(root, "c.mpack", _manifest("One", edition="1987"))
    _write(root, "b.mpack", _manifest("Two!", 3))
    _write(root, "bad.mpack", "{not json")
    state, c = _scan(spark, root, state, "s3")
    assert (c["added"], c["updated"], c["invalid"]) == (1, 1, 1)
    before = {r.path.rsplit("/", 1)[1]: r.id for r in state.collect()}
    (root / "c.mpack").rename(root / "moved.mpack")
    state, c = _scan(spark, root, state, "s4")
    assert c["moved"] == 1 and {r.path.rsplit("/", 1)[1]: r.id for r in state.collect()}["moved.mpack"] == before["c.mpack"]
    (root / "b.mpack/manifest.json").rename(tmp_path / "kept.json")
    state, c = _scan(spark, root, state, "s5")
    assert c["removed"] == 1 and [r.status for r in state.collect() if r.path.endswith("b.mpack")] == ["unavailable"]
    (tmp_path / "kept.json").rename(root / "b.mpack/manifest.json")
    state, c = _scan(spark, root, state, "s6")  # a package that comes back is valid again
    assert [r.status for r in state.collect() if r.path.endswith("b.mpack")] == ["valid"]


def test_streaming_scan_applies_batches_once(spark, tmp_path):
    src, folder = tmp_path / "in", tmp_path / "state"
    src.mkdir()
    row = lambda p, sha: json.dumps({"path": p, "manifest_sha256": sha, "fingerprint": p, "problems": [], "missing": 0})
    (src / "1.json").write_text(row("a", "1") + "\n" + row("b", "1"))
    scans.watch(spark, str(src), str(folder), str(tmp_path / "cp")).awaitTermination()
    (src / "2.json").write_text(row("a", "2"))
    scans.watch(spark, str(src), str(folder), str(tmp_path / "cp")).awaitTermination()
    n, t = scans.latest(spark, str(folder))
    assert n == 1 and sorted((r.path, r.manifest_sha256, r.status) for r in t.collect()) == [("a", "2", "valid"), ("b", "1", "valid")]
    scans.apply_batch(spark.createDataFrame([("a", "2", "a", [], 0)], etl.FOUND), 1, str(folder))
    assert sorted(r.path for r in scans.latest(spark, str(folder))[1].collect()) == ["a", "b"]


def test_loudness_laws():
    rate, t = 44100, np.arange(44100 * 3) / 44100
    sine = np.sin(2 * np.pi * 997 * t)
    full, mono = np.column_stack([sine, sine]), np.column_stack([sine, 0 * sine])
    assert abs(signal.integrated(mono, rate) + 3.01) < 0.1 and abs(signal.integrated(full, rate)) < 0.1
    assert signal.integrated(0 * full, rate) == -70 and abs(signal.true_peak(full)) < 0.1
    loud, quiet = full, full / 4
    both = signal.integrated(np.concatenate([loud, quiet]), rate)
    mean = (signal.integrated(loud, rate) + signal.integrated(quiet, rate)) / 2
    assert abs(both - mean) > 0.5
    b, a = signal.k_weights(48000)[0]
    assert np.allclose(b, [1.53512485958697, -2.69169618940638, 1.19839281085285], atol=1e-6) and np.allclose(a[1:], [-1.69065929318241, 0.73248077421585], atol=1e-6)


def test_filterbank_restores_a_delayed_signal():
    x = np.random.default_rng(1).standard_normal(32 * 60)
    y = signal.synthesised(signal.analysed(x))
    d = signal.cosine_bank().shape[1] - 1
    assert np.corrcoef(x[: len(x) - d], y[d:])[0, 1] > 0.99


def test_ini_chapters(spark, tmp_path):
    (tmp_path / "c.ini").write_text("; head\n[0]\nTitle = One ; x\n[44100]\ntitle=\"Two\"\nArtist=B\n")
    rows = files.chapters(files.ini_entries(files.ini_lines(spark, str(tmp_path)))).orderBy("sample").collect()
    assert [(r.sample, [(t.key, t.value) for t in r.tags]) for r in rows] == [(0, [("title", "One")]), (44100, [("artist", "B"), ("title", "Two")])]
    lines = [r.value for r in files.chapter_lines(files.chapters(files.ini_entries(files.ini_lines(spark, str(tmp_path))))).collect()]
    assert lines == ["[0]", "title=One", "[44100]", "artist=B", "title=Two"]


def test_ini_lines_count_from_one(spark, tmp_path):
    (tmp_path / "a.ini").write_text("x\r\n\n[1]\n")
    assert sorted((r.line, r.text) for r in files.ini_lines(spark, str(tmp_path)).collect()) == [(1, "x"), (2, ""), (3, "[1]"), (4, "")]


def _stream(n=5, power=2):
    ap = b"".join(files.block("AP", bytes([i]) * (100 + i)) for i in range(n))
    return files.STREAM_MAGIC + files.block("SH", files.header_payload(n * 1152 << power, 100, 44100, 28, 2, True, power), True) + files.block("RG", files.gain_payload(-300, 20000, 5, 30000)) + files.block("EI", files.encoder_payload(10.5, True, 1, 30, 1)) + ap + files.block("SE", b"")


def test_stream_headers_of_both_versions(spark):
    old = files.old_header_data(100, 27, 10, 48000, 500, 115, True, (300, 20000, 65236, 0)) + bytes(5000)
    early = files.STREAM_MAGIC + files.block("AP", b"x")
    data = {"new": _stream(), "old": old, "early": early, "crc": _stream().replace(b"\x1c", b"\x1d", 1), "short": old[:20], "junk": b"RIFF"}
    rows = {r.path: r for r in files.stream_headers(spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "path string, content binary")).collect()}
    n, o = rows["new"], rows["old"]
    assert (n.version, n.samples, n.silence, n.rate, n.bands, n.blocks, n.title_gain, n.album_peak, n.profile, n.encoder, n.error) == (8, 23040, 100, 44100, 28, 5, -300, 30000, 10.5, 1 << 24 | 30 << 16 | 1 << 8, None)
    assert (o.version, o.samples, o.rate, o.bands, o.encoder, o.album_peak) == (7, 99 * 1152 + 500, 48000, 27, 115, 0)
    assert (o.title_gain, o.title_peak, o.album_gain) == (int((64.82 - 3) * 256 + 0.5), int(np.log10(20000) * 5120 + 0.5), int((64.82 + 3) * 256 + 0.5))
    assert o.bitrate == len(old) * 8.0 * 48000 / o.samples
    assert all(rows[k].error for k in ("early", "crc", "short", "junk"))


@pytest.mark.parametrize("offsets", [[], [7], [7, 300], [50, 900, 1800, 2500, 9000, 9001, 10**7]])
def test_seek_tables_round_trip(offsets):
    assert files.seek_offsets(files.seek_payload(offsets, 3)) == (offsets, 3)


def test_long_seek_tables_are_thinned():
    offsets = [i * 1000 + i % 7 for i in range(1000)]
    assert files.seek_offsets(files.seek_payload(offsets, 1), 300) == (offsets[::4], 3)


def test_blocks_are_padded():
    b = files.block("ZZ", b"abc", True, 20)
    assert len(b) == 3 + 20 and b.endswith(b"abc" + bytes(13)) and list(files.stream_blocks(files.STREAM_MAGIC + b))[0][2] == 23


def test_cut_keeps_whole_blocks():
    data = _stream(5, 0)
    out = files.cut_stream(data, 1152 + 10, 1152 * 3)
    parts = list(files.stream_blocks(out))
    h = files.stream_header(parts[0][3])
    # samples count from the end of the leading silence of 100
    assert [k for k, *_ in parts] == ["SH", "RG", "EI", "AP", "AP", "AP", "ST", "SE"] and (h["silence"], h["samples"]) == (110, 1152 * 2 + 100)
    assert [p[0] for k, *_, p in parts if k == "AP"] == [1, 2, 3] and files.seek_offsets(parts[-2][3])[0] == [at for k, at, *_ in parts if k == "AP"]
    with pytest.raises(ValueError):
        files.cut_stream(data, 0, 10**6)


def test_cue_sheets(spark, tmp_path):
    (tmp_path / "a.cue").write_text('PERFORMER "All"\nFILE "x.wav" WAVE\n  TRACK 01 AUDIO\n    TITLE "One"\n    INDEX 00 00:00:00\n    INDEX 01 00:02:37\n  TRACK 02 AUDIO\n    PERFORMER "B"\n    INDEX 01 01:00:00\n')
    rows = files.cue_entries(files.ini_lines(spark, str(tmp_path)), 44100).orderBy("track").collect()
    assert [(r.sample, [(t.key, t.value) for t in r.tags]) for r in rows] == [(44100 * 187 // 75, [("Track", "1/2"), ("Title", "One")]), (44100 * 60, [("Track", "2/2"), ("Artist", "B")])]


def test_chapters_round_trip(spark, tmp_path):
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "c.ini").write_text("[0]\ntitle=One\n[44100]\nartist=B\ntitle=Two\n")
    c = files.chapters(files.ini_entries(files.ini_lines(spark, str(tmp_path / "i"))))
    files.chapter_lines(c).coalesce(1).write.text(str(tmp_path / "o"))
    again = files.chapters(files.ini_entries(files.ini_lines(spark, str(tmp_path / "o"))))
    assert again.drop("file").collect() and sorted(map(str, again.drop("file").collect())) == sorted(map(str, c.drop("file").collect()))


def test_tag_and_file_sinks(spark, tmp_path):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(f"{tmp_path}/p{i}/t.mpc", bytearray(b"body%d" % i)) for i in range(6)], "path string, content binary")
    t = d.select("path", F.posexplode(F.array(F.struct(F.lit("Title").alias("key"), F.col("path").alias("value")), F.struct(F.lit("Artist").alias("key"), F.lit("A").alias("value")))).alias("pos", "x")).select("path", "pos", "x.*")
    out = files.tagged(d, t)
    files.write_files(out)
    got = files.tags(files.binaries(spark, str(tmp_path), "*.mpc"))
    assert sorted((r.key, r.value) for r in got.collect()) == sorted([("Title", r.path) for r in d.collect()] + [("Artist", "A")] * 6)
    read = files.binaries(spark, str(tmp_path), "*.mpc").select(F.sha2("content", 256).alias("s")).collect()
    assert sorted(r.s for r in read) == sorted(r.sha256 for r in out.collect())


def test_float_samples_and_clipping(spark):
    x = np.array([[1.5, -1.5], [0.25, -0.25]])
    assert files.wav(files.to_wav(x, 8000, 32))[1].tolist() == x.tolist()
    assert np.allclose(files.wav(files.to_wav(x, 8000, 16))[1], [[32767 / 32768, -1], [0.25, -0.25]])
    f = files.pcm_frames(spark.createDataFrame([("a", bytearray(files.to_wav(x, 8000, 32)))], "path string, content binary")).first()
    assert (f.m, f.s) == ([0.0, 0.0], [1.5, 0.25])


def test_import_folder_is_classified(spark):
    names = ["CD 2/03 - Air.flac", "cover.jpg", "01. One.wav", "booklet.pdf", "x.lrc", "notes.txt"]
    rows = files.classified(spark.createDataFrame([("/in/" + n,) for n in names], "path string")).collect()
    assert [(r.kind, r.disc, r.number, r.title) for r in rows] == [("audio", 2, 3, "Air"), ("artwork", None, None, None), ("audio", 1, 1, "One"), ("booklet", None, None, None), ("lyrics", None, None, None), ("extra", None, None, None)]


def test_wav_sink_round_trip(spark, tmp_path):
    x = np.random.default_rng(1).uniform(-1, 1, (3000, 2))
    d = spark.createDataFrame([("a.wav", bytearray(files.to_wav(x, 8000, 24)))], "path string, content binary")
    out = files.wav_files(files.pcm_frames(d, 500).repartition(4), 24).first()
    assert out.path == "a.wav" and bytes(out.content) == files.to_wav(x, 8000, 24)
    loud = files.wav_files(files.pcm_frames(d, 500), 16, 4.0).first()
    assert np.allclose(files.wav(bytes(loud.content))[1], np.clip(x * 4, -1, 32767 / 32768), atol=1e-4)


def test_tables_are_made_and_migrated_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessitura.sources import tables

    t = tables.opened(spark, str(tmp_path / "c"))
    assert "sessions" in t and t["artists"].columns == ["id", "name"] and max(tables.applied(spark, str(tmp_path / "c")).values()) == 2
    add = tables.Step(3, {"artists": lambda old: old["artists"].unionByName(spark.createDataFrame([(1, "A")], "id bigint, name string")).withColumn("sort", F.lower("name"))})
    broken = tables.Step(4, {"groups": lambda old: old["groups"].select("nothing")})
    assert tables.opened(spark, str(tmp_path / "c"), [*tables.STEPS, add])["artists"].collect() == [(1, "A", "a")]
    assert tables.opened(spark, str(tmp_path / "c"), [*tables.STEPS, add])["artists"].count() == 1
    with pytest.raises(Exception):
        tables.opened(spark, str(tmp_path / "c"), [*tables.STEPS, add, broken])
    assert tables.applied(spark, str(tmp_path / "c"))["groups"] == 1
    with pytest.raises(ValueError):
        tables.opened(spark, str(tmp_path / "c"))


def test_samples_are_pulled_by_position(spark, tmp_path):
    from tessitura.streaming import samples

    x = np.random.default_rng(2).uniform(-1, 1, (2500, 2)).astype("<f4")
    (tmp_path / "a.wav").write_bytes(files.to_wav(x, 8000, 32))
    seen = []
    spark.sparkContext.environment["PYTHONPATH"] = spark.sparkContext.environment.get("PYTHONPATH", "")
    q = samples.stream(spark, str(tmp_path / "a.wav"), 1000, 100).writeStream.foreachBatch(lambda d, n: seen.append(d.orderBy("position").collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = [r for b in seen for r in b]
    assert [r.position for r in rows] == list(range(100, 2500)) and max(map(len, seen)) <= 1000
    assert np.allclose([[r.l, r.r] for r in rows], x[100:])


def test_replay_has_pre_roll_and_stale_rows_go(spark):
    d = spark.createDataFrame([("a", i, g) for i in range(100) for g in (1, 2) if g == 1 or i < 50], "track string, frame int, gen int")
    rows = scans.replay(d.where("gen = 1"), "track", "frame", 60, 32).collect()
    assert sorted(r.frame for r in rows) == list(range(28, 100)) and all(r.wanted == (r.frame >= 60) for r in rows)
    assert {r.gen for r in scans.current(d, "gen", "track").collect()} == {2}


def test_streams_are_checked_to_their_samples(spark):
    import random

    from tessitura.operators import codec
    from tests.test_codec import _frames

    r = random.Random(3)
    frames = _frames(r, 10, 20)
    ap = [files.block("AP", codec.encode_block(frames[i : i + 4], 20, True)) for i in range(0, 10, 4)]
    head = lambda samples: files.STREAM_MAGIC + files.block("SH", files.header_payload(samples, 0, 44100, 21, 2, True, 2), True)
    good = head(10 * 1152 - 5) + b"".join(ap) + files.block("SE", b"")
    data = {"good": good, "short": head(11 * 1152) + b"".join(ap) + files.block("SE", b""), "missing": head(10 * 1152) + ap[0] + ap[2], "long": head(8 * 1152) + b"".join(ap), "cut": good[: len(good) // 2], "late": files.STREAM_MAGIC + ap[0]}
    got = {x.path: x for x in files.stream_checks(spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "path string, content binary")).collect()}
    assert (got["good"].frames, got["good"].blocks, got["good"].error) == (10, 3, None)
    assert all(got[k].error for k in data if k != "good")
