"""Archives, sounds and licences: exact round trips and direct computation."""

import gzip
import hashlib
import io
import wave
import zlib
from math import gcd

import numpy as np
import pytest

from kairograph.llm import audio, licences, warc
from kairograph.llm.session import stored

from .helpers import LONG, docs, odd_rows


def page_rows():
    big, magic = "<p>" + "x" * 1200, warc.MAGIC.decode("latin-1") * 700
    rows = [(k, f"http://a/{k}", f"<html>{k}" + "y" * (k * 37)) for k in range(60)]
    return rows + [(70, "u", big), (71, "u", big), (72, None, big), (72, "again", big), (73, "u", "small"), (74, "u", "small"), (75, "a\r\nb", None), (None, "none", big), (76, "", ""), (77, "m", magic), (78, "l", LONG), (None, "alone", LONG + "!"), (None, None, LONG + "!")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, salt int").repartition(3)


@pytest.mark.parametrize("size", [97, 5000, warc.RANGE_BYTES])
def test_archives_read_back_from_any_ranges(spark, size):
    rows = page_rows()
    found = warc.read(warc.archive(pages(spark, rows)), range_bytes=size).collect()
    kept = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 1000 and i is not None:
            kept[h] = max(i, kept.get(h, -1))
    want = []
    for i, url, h in rows:
        body = (h or "").encode()
        refers = kept.get(h) if h and h in kept and kept[h] != i else None
        want.append((i, warc._clean(url) if url is not None else None, "revisit" if refers is not None else "response", refers, len(body), hashlib.sha1(body).hexdigest(), None if refers is not None else body))
    assert sorted(((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in found), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("per_salt", [1, 2, warc.PER_SALT])
def test_references_by_salted_joins_are_those_by_broadcast(spark, per_salt, monkeypatch):
    monkeypatch.setattr(warc, "PER_SALT", per_salt)
    table = pages(spark, page_rows())
    one, other = (sorted(map(repr, warc.with_references(table, broadcast=n).collect())) for n in (1000, 0))
    assert one == other and len(one) == len(page_rows())


def foreign(kind, block, version=b"WARC/1.0", level=9, **named):
    head = b"".join(f"{k.replace('_', '-')}: {v}\r\n".encode() for k, v in {"WARC_Type": kind, "Content_Length": len(block), **named}.items())
    return gzip.compress(version + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n", level)


def test_archives_of_other_writers(spark, tmp_path):
    """Both versions, all record types, base32 digests, no lengths or ids stated."""
    import base64

    body = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nhello"
    digest = "sha1:" + base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    members = [foreign("warcinfo", b"software: x\r\n"), foreign("request", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request"), foreign("response", body, b"WARC/1.1", Content_Type="application/http;msgtype=response", warc_payload_digest=digest, WARC_Target_URI="u"), foreign("metadata", b"a: b"), foreign("revisit", b"", WARC_Payload_Digest=digest), foreign("resource", b"raw\r\n\r\nbytes")]
    path = tmp_path / "other.warc.gz"
    path.write_bytes(b"".join(members))
    manifest = spark.createDataFrame([(f"file://{path}", path.stat().st_size, len(members))], "path string, bytes long, records long")
    for size in (50, 10_000):
        found = {r.record_type: r for r in warc.read(manifest, range_bytes=size).collect()}
        assert {k: None if r.payload is None else bytes(r.payload) for k, r in found.items()} == {"warcinfo": b"software: x\r\n", "request": b"", "response": b"hello", "metadata": b"a: b", "revisit": None, "resource": b"raw\r\n\r\nbytes"}
        assert found["response"].payload_digest == found["revisit"].payload_digest == hashlib.sha1(b"hello").hexdigest() and found["revisit"].payload_bytes is None
    wrong = spark.createDataFrame([(f"file://{path}", path.stat().st_size, 7)], "path string, bytes long, records long")
    with pytest.raises(ValueError, match="7 records were written and 6 read"):
        warc.complete(warc.read(wrong), wrong)


def test_records_inside_records_are_not_read(spark):
    """Random bytes are stored as they are, and with them the archive that they surround."""
    r = np.random.default_rng(4)
    inner = warc.record(9, "in", b"inner" * 9, None, hashlib.sha1(b"inner" * 9).hexdigest())
    noise = r.bytes(20_000)
    payload = noise + inner + inner + noise
    own = warc.record(1, "out", payload, None, hashlib.sha1(payload).hexdigest())
    assert list(warc.starts(own, len(own))) == [0]
    block = b"x" + payload
    data = foreign("resource", block, level=0) + warc.record(2, "next", b"p", None, hashlib.sha1(b"p").hexdigest())
    assert inner in data
    whole = [warc.parse(x)["headers"].get("x-page-id") for x in warc.read_range(io.BytesIO(data), len(data), 0, len(data))]
    assert whole == [None, "2"]
    for size in (1000, 4096, 30_000):
        got = [warc.parse(x)["headers"].get("x-page-id") for at in range(0, len(own), size) for x in warc.read_range(io.BytesIO(own), len(own), at, min(len(own), at + size))]
        assert got == ["1"]


def test_an_archive_is_plain_gzip_of_records(spark):
    manifest = stored(warc.archive(pages(spark, page_rows()[:9])), "m")
    assert manifest.agg({"records": "sum"}).first()[0] == 9
    for row in manifest.collect():
        text = gzip.open(row.path.removeprefix("file://")).read()
        assert text.startswith(warc.VERSION) and text.count(b"WARC/1.1\r\n") == row.records


def test_a_false_magic_is_no_record_and_a_cut_file_is_an_error():
    member = warc.record(1, "u", b"p" * 50, None, hashlib.sha1(b"p" * 50).hexdigest())
    data = warc.MAGIC + b"\0" * 40 + gzip.compress(b"no record") + member
    assert len(list(warc.read_range(io.BytesIO(data), len(data), 0, len(data)))) == 1
    with pytest.raises(EOFError):
        list(warc.read_range(io.BytesIO(member[:-9]), len(member) - 9, 0, len(member) - 9))


def test_no_pages(spark):
    assert warc.read(warc.archive(pages(spark, []))).count() == 0


@pytest.mark.parametrize(("source", "target"), [(16000, 8000), (3, 2), (2, 3), (44100, 16000), (5, 7)])
def test_resampling_is_filtering_with_zeros(source, target):
    x = np.random.default_rng(0).normal(size=301).astype(np.float32)
    up, down = target // gcd(source, target), source // gcd(source, target)
    h, spaced = audio.resampling_filter(up, down).astype(float), np.zeros(301 * up)
    spaced[::up] = x
    want = np.convolve(spaced, h)[len(h) // 2 :][::down]
    got = audio.resample(x, source, target)
    assert np.allclose(got, want[: len(got)], atol=1e-5)


def test_frames_are_spectra_of_overlapping_pieces():
    x = np.random.default_rng(1).normal(size=1000).astype(np.float32)
    mel = audio.log_mel(x)
    piece = x[3 * audio.HOP : 3 * audio.HOP + audio.FRAME] * np.hanning(audio.FRAME)
    want = np.log(np.maximum(np.abs(np.fft.rfft(piece, audio.FFT)) ** 2 @ audio.mel_filters(), np.exp(audio.FLOOR)))
    assert np.allclose(mel[3], want, atol=1e-3)


def test_segments_hold_on_between_the_thresholds():
    energy = np.array([-1, 1, 0, 0.1, -1, 0, 0, 1, 0], float)
    assert audio.segments(energy - energy.mean()) == [(1, 4), (7, 9)]


def test_payloads_and_sounds_are_lossless(spark):
    rows = odd_rows() + [(900, "x" * 576, "en"), (901, "x" * 577, "en")]
    for i, t, _ in rows[:30] + rows[-2:]:
        body = (t or "").encode()
        p = audio.payload(body)
        assert len(p) % 576 == 0 and len(p) >= 576 and p[: len(body)] == body and set(p[len(body) :]) <= {255} and len(p) - len(body) <= 576
        assert audio.from_wav(audio.to_wav(p)) == (p, audio.SOURCE), i
    features = audio.audio_features(stored(audio.media_column(docs(spark, rows)), "media"))
    found, described = features.collect(), audio.digests(features).collect()
    assert len(found) == len(described) == len(rows)
    texts = {i: (t or "").encode() for i, t, _ in rows}
    for r, d in zip(found, described, strict=True):
        text, p = texts[r.doc_id], audio.payload(texts[r.doc_id])
        values, starts, ends = audio.read_tensors(bytes(r.tensors))
        assert values.shape[1:] == (audio.PATCH, audio.MELS) and len(values) == -(-r.frames // audio.PATCH) and (starts < ends).all()
        assert (d.doc_id, d.n_bytes, d.payload_bytes, d.payload_sha256, d.tail_crc32) == (r.doc_id, len(text), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        with wave.open(io.BytesIO(bytes(r.media))) as sound:
            assert (sound.getnchannels(), sound.getsampwidth(), sound.getframerate(), sound.readframes(len(p) + 1)) == (1, 1, audio.SOURCE, p)
        assert (d.media_bytes, d.media_sha256) == (len(r.media), hashlib.sha256(bytes(r.media)).hexdigest())
        if len(p) < 20_000:
            assert d.feature == plain_feature(p)
    assert audio.digests(audio.audio_features(audio.media_column(docs(spark, [])))).count() == 0


def plain_feature(payload):
    """The feature text from its definition: zeros between samples, one long filter, one spectrum a frame, a walk over the energies."""
    x = [(b - 128) / 128 for b in payload]
    up, down = 3, 4
    assert (audio.SOURCE // audio.TARGET, audio.SOURCE * up) == (1, audio.TARGET * down)
    h = audio.resampling_filter(up, down).astype(float)
    spaced = np.zeros(len(x) * up)
    spaced[::up] = x
    y = np.convolve(spaced, h)[len(h) // 2 :][::down][: -(-len(x) * up // down)]
    n = 1
    while (n - 1) * audio.HOP + audio.FRAME < len(y):
        n += 1
    y = np.concatenate([y, np.zeros((n - 1) * audio.HOP + audio.FRAME - len(y))])
    frames = [np.log(np.maximum(np.abs(np.fft.rfft(y[k * audio.HOP :][: audio.FRAME] * np.hanning(audio.FRAME), audio.FFT)) ** 2 @ audio.mel_filters().astype(float), np.exp(audio.FLOOR))) for k in range(n)]
    energy = [f.mean() for f in frames]
    middle, on, spans = sum(energy) / n, False, []
    for k, e in enumerate(energy):
        if not on and e - middle > audio.ENTER:
            on = True
            spans.append([k, k])
        elif on and e - middle < audio.LEAVE:
            on = False
        if on:
            spans[-1][1] = k
    active = sum((b * audio.HOP + audio.FRAME - a * audio.HOP) / audio.TARGET for a, b in spans)
    tensors = -(-n // audio.PATCH)
    mel = ",".join(f"{v:.3f}" for v in np.mean(frames, axis=0)[::4])
    return f"frames={n} tensors={tensors} span=0.000-{((n - 1) * audio.HOP + audio.FRAME) / audio.TARGET:.3f} segments={len(spans)} active={active:.3f} mel={mel}"


def test_licences_in_other_spellings(spark):
    mit = dict(licences.KNOWN[:1])["MIT"]
    rows = odd_rows() + [(800, "Copyright (c) 2020 A Body\n\n" + mit.upper(), "en"), (801, mit.replace(",", " ;").replace("sublicense", "sub-license"), "en"), (802, mit + "and more", "en"), (803, "// (C) me\n# All rights reserved.\n" + mit, None), (804, "Licenced under the MIT licence", "en"), (805, "copyright 2020", "en")]
    found = {r.doc_id: r for r in licences.scan(docs(spark, rows), licences.known_digests(spark)).collect()}
    assert [found[k].license_id for k in (800, 801, 802, 803, 804, 805)] == ["MIT", "MIT", None, "MIT", "MIT-notice", None]
    assert found[100].canonical_sha256 == found[101].canonical_sha256 == found[805].canonical_sha256 == hashlib.sha256(b"").hexdigest()
    assert found[100].license_id is None
    assert licences.scan(docs(spark, []), licences.known_digests(spark)).count() == 0


def test_whole_licences_and_notices_are_found(spark):
    import duckdb

    whole = ("Apache-2.0", "CC0-1.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "Unlicense")
    texts = dict(licences.KNOWN)
    rows = [(k, "\n".join("  " + x for x in texts[name].upper().split("\n")), "en") for k, name in enumerate(whole)]
    rows += [(100, "Released under the MIT license.", "en"), (101, "This work is licensed under the GNU General Public License, version 3.", None), (102, "Some prose.\n" + texts["MPL-2.0"], "en")]
    found = {r.doc_id: r.license_id for r in licences.scan(docs(spark, rows), licences.known_digests(spark)).collect()}
    want = {k: name for k, name in enumerate(whole)} | {100: "MIT-notice", 101: "GPL-3.0-notice", 102: None}
    assert found == want
    engine = duckdb.connect()
    engine.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    engine.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert {i: name for i, _, name in engine.sql(licences.OP4_SQL).fetchall()} == want
