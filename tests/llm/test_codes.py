import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.llm import codes
from fieldloom.llm.queries import tokenizer_path


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=1500))
def test_every_token_is_addressable(ids):
    seg = codes.Segment(codes.pack(np.array([5]), np.array([len(ids)]), np.array(ids, dtype=np.uint32)))
    assert seg.ids().tolist() == ids
    assert [seg.token(i) for i in range(0, len(ids), 7)] == ids[::7]
    with pytest.raises(IndexError):
        seg.token(len(ids))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_the_tokenizers_own(text):
    encode = codes.piece_encoder(tokenizer_path())
    assert encode(text).tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_memory_is_bounded():
    encode = codes.PieceEncoder(tokenizer_path(), keep=3)
    for text in ("one two three", "four five six", "one seven"):
        assert encode(text).tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encode.known) <= 3


def test_most_words_are_in_flat_arrays(monkeypatch):
    """Also where all words have one of two hashes."""
    texts = [" ".join(f"w{k * 7919 % 500}é{'x' * (k % 5)}" for k in range(at, at + 90)) for at in range(0, 900, 30)]
    for told in (hash, lambda word: len(word) % 2):
        monkeypatch.setattr(codes, "hash", told, raising=False)
        encode = codes.PieceEncoder(tokenizer_path(), keep=400, fast=20, newest=10)
        for text in texts * 2:
            assert encode(text).tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids
            assert len(encode.known) < 30 and encode.n <= 400


def test_words_are_found_in_flat_arrays_once_they_are_added():
    flat, words = codes.FlatWords(), [f"{k}ß{'y' * (k % 4)}" for k in range(1000)]
    assert flat.find(words[:2]).tolist() == [-1, -1]
    for at in range(0, 900, 300):
        flat.add(words[at : at + 300])
    assert flat.find(words).tolist() == [*range(900), *[-1] * 100] and flat.find([]).tolist() == []


def test_segments_are_sent_to_python_a_few_at_a_time(spark, monkeypatch):
    def counting(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())] * 4, ["doc_id", "start", "n_tokens", "ids_crc32"])

    path = codes.new_table(spark)
    codes.write_codes(spark.range(60).selectExpr("id AS doc_id", "'some words' AS text").coalesce(1), path, tokenizer_path(), segment_tokens=1)
    monkeypatch.setattr(codes, "decode_batches", counting)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = [r["n_tokens"] for r in codes.read_codes(spark, path).collect()]
    assert sum(sizes) == 60 and max(sizes) <= codes.BATCH_SEGMENTS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_words_are_let_go_once_the_files_are_read():
    first = codes.piece_encoder(tokenizer_path())
    assert list(codes.decode_batches(iter([]))) == []
    assert codes.piece_encoder(tokenizer_path()) is not first


def test_files_give_back_all_documents(spark, odd_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = sorted(map(tuple, codes.token_codes(odd_docs, tokenizer_path(), segment_tokens=1000).collect()))
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -(2**63), r["text"] or "") for r in odd_docs.collect()), key=lambda r: r[0])
    want, start = [], 0
    for doc, text in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)


def test_tokens_by_position(spark, odd_docs, tmp_path):
    path = str(tmp_path / "codes")
    codes.write_codes(odd_docs.where("doc_id in (1, 7)"), path, tokenizer_path())
    wanted = spark.createDataFrame([(0,), (5,), (10**9,), (-1,), (None,)], "position long")
    got = {r["position"]: r["token_id"] for r in codes.tokens_at(spark, path, wanted).collect()}
    encode = codes.piece_encoder(tokenizer_path())
    ids = encode("Plain text here.\nAnd more of it, to be sure.").tolist()
    assert got == {0: ids[0], 5: ids[5]}


def test_no_documents(no_docs):
    assert codes.token_codes(no_docs, tokenizer_path()).count() == 0


def test_texts_are_sent_to_python_in_small_batches(spark, monkeypatch):
    from fieldloom.llm.common import BATCH_ROWS

    def counting(batches, path, end_id, segment_tokens):
        import pyarrow as pa

        for batch in batches:
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((0, 0, 0, batch.num_rows, 0, 0, 0, b""), types, strict=True)], ["part", "segment", "before", "n_docs", "n_tokens", "first_doc", "last_doc", "blob"])

    monkeypatch.setattr(codes, "encode_batches", counting)
    path = codes.new_table(spark)
    codes.write_codes(spark.range(5_000).selectExpr("id AS doc_id", "'x' AS text"), path, "none")
    sizes = [r["n_docs"] for r in spark.read.parquet(path).collect()]
    assert sum(sizes) == 5_000 and max(sizes) <= BATCH_ROWS


def test_words_of_many_texts_are_learned_together():
    encode = codes.PieceEncoder(tokenizer_path())
    texts = [f"w{k}é it's w{k % 7}, 你好 x{k * 31}ß" for k in range(300)] + ["", " \t", "odd Σ İ", "a <|endoftext|> b", "e\u0301 ﬁn"] * 2
    calls, learn = [], encode.learn
    encode.learn = lambda words: (calls.append(len(words)), learn(words))
    got = [ids.tolist() for ids in encode.each(texts)]
    assert got == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) == 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=12).map(lambda t: "".join(t.lower().split())).filter(bool), min_size=1, max_size=20))
def test_ids_are_cut_by_bytes_as_by_places(words):
    encode = codes.piece_encoder(tokenizer_path())
    by_length, by_place = encode.cut_by_length(words), encode.cut_by_place(words)
    if by_length is not None:
        assert [x.tolist() for x in by_length] == [x.tolist() for x in by_place]
    elif all(w.isascii() for w in words):
        raise AssertionError(words)
