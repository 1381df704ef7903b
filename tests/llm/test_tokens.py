"""Tokens, packing and token files against the library's own encoding of whole texts and plain best fit."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import packing, token_files, tokens

SIGNS = [*"ab Z\n\t  \r\x1c\x85\xa0é'1.,!Σİ̈中ßя×\u2003\u3000\u2028’", "<|endoftext|>", "'ll", "<"]


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_batches_have_whole_text_ids(name, kind, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 50)  # so that it is forgotten now and then
    rnd, own = random.Random(5), tokens.PieceTokenizer(tokens.default_path(name), kind)
    for _ in range(200):
        texts = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 14))) for _ in range(20)]
        flat, ends = own.encode(pa.array(["other", *texts, None])[1:], 7)
        want = [[*e.ids, 7] for e in own.library.encode_batch([*texts, ""], add_special_tokens=False)]
        assert [x.tolist() for x in np.split(flat, ends[:-1])] == want
    assert own.encode(pa.array([], pa.string()), 7)[0].tolist() == []


def whole_texts(spark, name: str, end: int) -> dict[int, list[int]]:
    library = tokens.PieceTokenizer(tokens.default_path(name), "word").library
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: [*e.ids, end] for r, e in zip(rows, library.encode_batch([r.text or "" for r in rows], add_special_tokens=False), strict=True)}


def test_token_files_equal_whole_text_encoding(spark, monkeypatch):
    table, want = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), whole_texts(spark, "word_bpe_49k.json", 1)
    manifest = token_files.write_token_files(table, tokens.default_path("word_bpe_49k.json"), "word", 1)
    got = token_files.token_digests(token_files.read_token_files(manifest)).orderBy("start").collect()
    start = 0
    assert [r.doc_id for r in got] == sorted(want)
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want[r.doc_id]), crc(want[r.doc_id]))
        start += r.n_tokens


def test_a_token_file_gives_any_document(tmp_path):
    rng = np.random.default_rng(2)
    sizes, doc_ids = rng.integers(0, 40, 5_000), np.sort(rng.integers(-(2**63), 2**63 - 1, 4_990))
    ids, ends = rng.integers(0, 2**16, sizes.sum()).astype(np.uint32), np.cumsum(sizes)
    path = f"file://{tmp_path}/x.ids"
    writer = token_files.TokenFileWriter(path, 2)
    numbers = pa.concat_arrays([pa.nulls(10, pa.int64()), pa.array(doc_ids)])
    for a, b in ((0, 700), (700, 5_000)):
        first = ends[a - 1] if a else 0
        writer.add(numbers[a:b], ids[first : ends[b - 1]], ends[a:b] - first)
    with pytest.raises(ValueError):
        writer.add(pa.array([1]), np.array([1 << 16], np.uint32), np.array([1]))
    writer.close()
    file = token_files.TokenFile(path)
    for i in [0, 1, 9, 10, 11, 255, 256, 257, *rng.integers(0, 5_000, 200).tolist()]:
        start, end = file.start(i), file.ends.select(i)
        assert (start, end) == (ends[i] - sizes[i], ends[i]) and file.ids(start, end).tolist() == ids[start:end].tolist()
        assert file.doc_ids(i, i + 1)[0].as_py() == numbers[i].as_py()
    plain = 8 * len(sizes)
    assert len(file.ends.to_bytes()) < plain / 6


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 1000, 70_000):
        for top in (1, 50, 10**9, 2**62):
            values = np.sort(rng.integers(0, top, n))
            coded = token_files.EliasFano.from_bytes(token_files.EliasFano.encode(values).to_bytes())
            assert (coded.decode(0, n).astype(np.int64) == values).all()
            for i in rng.integers(0, n, 20).tolist() if n else []:
                assert coded.select(i) == values[i]


def test_bins_are_the_best_fitting_ones():
    rnd = random.Random(4)
    for limit in (1, 3, 10):
        bins, plain, placed, closed = packing.OpenBins(50, limit, 0), {}, 0, 0
        for _ in range(2_000):
            length = rnd.randint(1, 50)
            number, offset = bins.place(length)
            fitting = [free for free in plain.values() if free >= length]
            if fitting:
                assert plain[number] == min(fitting) and offset == 50 - plain[number]
            else:
                if len(plain) == limit:  # the fullest closes
                    del plain[next(k for k in plain if plain[k] == min(plain.values()) and k not in sum(bins.by_free, []))]
                    closed += 1
                assert offset == 0 and number not in plain
            plain[number] = 50 - offset - length
            if not plain[number]:
                del plain[number]
            placed += 1
            assert sorted(plain) == sorted(sum(bins.by_free, [])) and bins.count == len(plain) <= limit
        assert closed


def test_packing_is_whole_and_tight(spark):
    table, want = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), whole_texts(spark, "byte_bpe_50k.json", 0)
    got = packing.pack_documents(table, tokens.default_path("byte_bpe_50k.json")).toPandas()
    total = sum(map(len, want.values()))
    assert got["length"].sum() == total and set(got.doc_id) == set(want)
    for doc_id, pieces in got.sort_values("piece").groupby("doc_id"):
        ids = want[doc_id]
        assert pieces["piece"].tolist() == list(range(-(-len(ids) // 2048))) and pieces["start"].tolist() == [0, *pieces["length"].cumsum().tolist()[:-1]]
        assert pieces["length"].iloc[1:].eq(2048).all()
        for r in pieces.itertuples():
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.start : r.start + r.length]
    for _, bin_ in got.sort_values("offset").groupby("sequence_id"):
        assert bin_["offset"].tolist() == [0, *bin_["length"].cumsum().tolist()[:-1]] and bin_["length"].sum() <= 2048
    assert got.sequence_id.nunique() <= 1.01 * total / 2048 + 4 * table.rdd.getNumPartitions()


def test_packing_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7)], ["doc_id", "text", "t", "c0", "piece"])
    (row,) = packing.pack_documents(docs, tokens.default_path("byte_bpe_50k.json"), keep=("doc_id", "t", "c0", "piece", "text")).collect()
    assert (row.doc_id, row.t, row.c0, row.piece, row.text, row.length) == (1, 5, 6, 0, "a b", 3)
