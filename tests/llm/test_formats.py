"""Token files, archives and media: exact round trips, awkward rows, broken input."""

import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import zstandard

from tessitura.llm import matroska, segment, token_files, warc, words
from tessitura.llm.common import staged

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = [None, "", " ", "\n", "Don't stop, 12 é́ İstanbul ΣΑΣ ﬁ", "a" * 5000, "x " * 20_000, "\x00 \x85\x1c tab\tend", "😀 中文", "word word"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (3, TEXTS[3], "again")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(4)


def test_token_files_round_trip(spark, docs, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    token_files.write(token_files.encode(docs, path), str(tmp_path / "t"))
    rows = token_files.starts(staged(token_files.checksums(token_files.read(spark, str(tmp_path / "t"))), "t")).orderBy("start").collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    want = sorted([(i, t or "") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3])] + [(-1, "null id")])
    at = 0
    for r, (i, t) in zip(rows, want, strict=True):
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        assert (r.id if r.id is not None else -1, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.tokens(spark, str(tmp_path / "t"), 3, 4).count() == 3
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(next((tmp_path / "t").glob("part-*"))).metadata.row_group(0).column(4)
    assert meta.has_offset_index and {"DELTA_BINARY_PACKED", "RLE_DICTIONARY", "PLAIN_DICTIONARY"} & {*meta.encodings}


def test_token_files_of_nothing(docs):
    assert token_files.encode(docs.where("false"), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_fast_path_equals_tokenizer():
    rng = np.random.default_rng(3)
    letters = list("aZé'stßÀİΣςçñ ,.!\n\t́ﬁ中1٢²ªº_-…😀\x85​\x1c×÷µŉǅʰ")
    texts = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(2000)]
    c = token_files.encoder(public_tokenizers.path("word_bpe_49k.json"))
    tok = token_files.Words(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    distinct, index, offsets = words.split(pa.array(texts))
    ids, at = words.spread(c.get(distinct), index, offsets)
    assert all(ids[a:b].tolist() == tok.encode(t, add_special_tokens=False).ids for t, a, b in zip(texts, at[:-1], at[1:]))


def test_whole_table_equals_tokenizer(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    c = token_files.encoder(public_tokenizers.path("word_bpe_49k.json"))
    tok = token_files.Words(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    distinct, index, offsets = words.split(pa.array(texts))
    ids, at = words.spread(c.get(distinct), index, offsets)
    assert all(ids[a:b].tolist() == tok.encode(t, add_special_tokens=False).ids for t, a, b in zip(texts, at[:-1], at[1:]))


def test_added_tokens_in_text_equal_tokenizer():
    c = token_files.encoder(public_tokenizers.path("word_bpe_49k.json"))
    tok = token_files.Words(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "|>", "<", "|", " ", "\n", "end", "Don't", "é", "ﬁ", "."]
    rng = np.random.default_rng(4)
    texts = ["end <|endoftext|> here"] + ["".join(rng.choice(parts, rng.integers(0, 8))) for _ in range(1000)]
    distinct, index, offsets = words.split(pa.array(texts))
    ids, at = words.spread(c.get(distinct), index, offsets)
    assert ids[: at[1]].tolist() == [806, 49407, 763]
    assert all(ids[a:b].tolist() == tok.encode(t, add_special_tokens=False).ids for t, a, b in zip(texts, at[:-1], at[1:]))


PAGES = [(1, "http://a/é b", "x" * 150), (2, None, "x" * 150), (3, "u\r\nX: y", "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""), (7, "u", "é" * 50), (0, "u", "é" * 50), (8, "u", "<p>" + "word " * 50_000)]


def test_archives_equal_oracle(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").repartition(3)
    warc.write(pages, str(tmp_path / "w"))
    rows = warc.read(spark, str(tmp_path / "w")).collect()
    assert not [r.error for r in rows if r.error]
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(PAGES, columns=["page_id", "url", "html"]))
    want = sorted(con.execute(warc.OP4_SQL).fetchall())
    got = sorted((int(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in rows)
    assert [tuple(None if x != x else x for x in w) for w in want] == got
    html = {i: h or "" for i, _, h in PAGES}
    assert all(bytes(r.payload).decode() == (html[int(r.record_id)] if r.record_type == "response" else "") for r in rows)
    data = next((tmp_path / "w").glob("part-*")).read_bytes()
    assert data[:4] == warc.DICTIONARY_MAGIC
    d = zstandard.ZstdCompressionDict(data[8 : 8 + int.from_bytes(data[4:8], "little")])
    assert zstandard.ZstdDecompressor(dict_data=d).stream_reader(data, read_across_frames=True).read().startswith(b"WARC/1.1\r\n")


def test_archives_of_nothing_and_repeated_pages(spark, tmp_path):
    schema = "page_id bigint, url string, html string"
    warc.write(spark.createDataFrame([], schema), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0
    warc.write(spark.createDataFrame([(1, "u", "y" * 200)] * 2 + [(None, "u", "y" * 200), (None, None, None)], schema), str(tmp_path / "r"))
    rows = warc.read(spark, str(tmp_path / "r")).collect()
    assert sorted(r.record_type for r in rows) == ["response", "response", "response", "revisit"]


@pytest.mark.parametrize("harm", [lambda d: d[:-3], lambda d: d[:60] + b"\xff" + d[61:], lambda d: d + b"junk", lambda d: b"abcd"])
def test_broken_archives_have_errors(harm):
    zip_ = zstandard.ZstdCompressor(write_checksum=True)
    rec = warc._record("response", "1", "u", hashlib.sha256(b"hello").hexdigest(), 5, None, b"hello")
    assert [e for _, _, e in warc.records(zip_.compress(rec))] == [None]
    assert any(e for _, _, e in warc.records(harm(zip_.compress(rec))))
    with pytest.raises(ValueError):
        warc.parse(rec.replace(b"Content-Length: 9", b"Content-Length: 8").replace(b"hello", b"hellO"))


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 8, 576 * 9 + 1, 576 * 8 * 32, 576 * 8 * 32 * 2 + 5])
def test_matroska_round_trip(n):
    p = matroska.padded(bytes(i * 7 % 251 for i in range(n)))
    data = matroska.mux(p)
    f = matroska.demux(data)
    assert b"".join(data[a:b] for _, _, a, b, _ in f.packets) == p and [c for _, _, c in f.cues] == f.clusters
    assert [x[1] for x in f.packets] == [i * matroska.MS for i in range(len(p) // 576)]


def test_matroska_unknown_sizes_and_broken_files():
    p = matroska.padded(b"q" * 5000)
    data = matroska.mux(p)
    at = data.index(bytes.fromhex("1f43b675")) + 4
    width = 9 - data[at].bit_length()
    open_ = data[:at] + bytes([(1 << (8 - width)) | ((1 << (8 - width)) - 1)]) + b"\xff" * (width - 1) + data[at + width :]
    assert len(matroska.demux(open_).packets) == len(p) // 576
    for i in range(0, len(data), 397):
        with pytest.raises(ValueError):
            matroska.demux(data[:i])


def test_media_columns(docs):
    rows = matroska.features(matroska.store(docs)).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        want = matroska.padded((TEXTS[r.id] if r.id is not None else "null id").encode() if r.id is None or TEXTS[r.id] else b"")
        assert (r.payload_sha256, r.tail_crc32, r.payload_bytes) == (hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]), len(want))
    assert len({(r.media_sha256, r.feature) for r in rows if r.id == 3}) == 1
    assert matroska.packets(matroska.store(docs)).where("id = 6").count() == 40_000 // 576 + 1


def _all(l, t):
    out = []

    def go(i, s, ids):
        if i == len(t):
            out.append((s, tuple(ids)))
            return
        single = False
        for j in range(i + 1, len(t) + 1):
            if e := l.pieces.get(t[i:j]):
                go(j, s + e[1], [*ids, e[0]])
                single = single or j == i + 1
        if not single:
            go(i + 1, s + l.low, [*ids, *l.without_piece(t[i])])

    go(0, 0.0, [])
    return sorted((x[0] for x in out), reverse=True)


@pytest.mark.parametrize("word", ["▁the", "▁hello,", "▁ünï", "▁▁ab", "x中y", "▁running", "😀a", "", "▁"])
def test_n_best_equals_enumeration(word):
    _, l = segment.load(segment.default_model())
    assert [x[0] for x in l.best(word, 6)] == pytest.approx(_all(l, word)[:6])


@pytest.mark.parametrize("text", ["the cat\nsat  on é mat", "a b c", "\n\nfoo bar ", "中文 a,b˿", "don't stop!!"])
def test_chain_equals_whole_lattice(text):
    sp, l = segment.load(segment.default_model())
    n = sp.normalize(text)
    distinct, index, offsets = segment.links([n, "x", n], l)
    for k in (0, 2):
        paths = [l.best(distinct[i], 4) for i in index[offsets[k] : offsets[k + 1]]]
        open_ = sorted(((i, p) for i, p in enumerate(paths) if len(p) > 1), key=lambda x: x[1][0][0] - x[1][1][0])[:3]
        got = segment.combined(sum(p[0][0] for p in paths), open_, 4)
        assert [x[0] for x in got] == pytest.approx([x[0] for x in l.best(n, 4)])
    ids, at, scores, others = segment.segmented([text, "", text], segment.default_model(), 4)
    assert [scores[2], *(a["score"] for a in others[2])] == pytest.approx([x[0] for x in l.best(n, 4)]) and at[1] == at[2]


def test_segmentation_round_trip_and_edits(docs):
    model = segment.default_model()
    rows = segment.decode(segment.encode(docs, model), model).collect()
    sp, l = segment.load(model)
    assert len(rows) == len(TEXTS) + 2
    by_id = {}
    for r in rows:
        text = (TEXTS[r.id] if r.id is not None else "null id") or ""
        by_id[r.id] = r
        assert r.decoded == text
        for a in r.alternatives:
            ids = list(r.ids)
            for e in reversed(a.edits):
                ids[e.at : e.at + e.n] = e.ids
            assert a.score <= r.score and ids != list(r.ids) and sp.decode(ids) == text
    for r in segment.summary(docs, model).collect():
        assert r.round_trip and r.ids_crc32 == zlib.crc32(np.array(by_id[r.id].ids, "<u4").tobytes()) and r.score == by_id[r.id].score
