import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import byte_bpe, token_files
from tidemark.llm.token_pieces import chunks, spelled

ODD = ["", " ", "\n", "a", "  a  b\n\n c", "\t\tx\ty z ", "it's we'll 'tis  ", "a" * 3000, "ab" * 700 + " !!!!" * 50 + "   ", "x\x1cy \x85z\r\nq", "日本語 テキスト 😀😀", " lead", "trail \n", "123 45", "\x00a b", "<|endoftext|> a", "word, word. word", "x <|endoftext|>\ny", "a<|endoftext|>b, c.\nd", "two\nlines, of.\nthree words. <|endoftext", "|> z"]


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def encoder(ranks):
    return byte_bpe.Encoder(ranks, P.PATTERN)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoder_equals_tiktoken(encoder, reference):
    for text, (ids, n, plain) in zip(ODD, encoder.encode_batch(ODD)):
        expected = reference.encode_ordinary(text)
        assert ids == " ".join(map(str, expected)) and n == len(expected) and plain == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab eé'.,!\n\t1 　ñx")), max_size=60))
def test_encoder_on_random_texts(text):
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    e = byte_bpe.encoder_of(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}) if not hasattr(test_encoder_on_random_texts, "t") else test_encoder_on_random_texts.t
    test_encoder_on_random_texts.t = t
    assert next(e.encode_batch([text]))[0] == " ".join(map(str, t.encode_ordinary(text)))


def test_heap_and_matrix_agree(encoder):
    r = random.Random(1)
    pieces = ["".join(r.choice("abcdeth ") for _ in range(r.randrange(2, 200))).encode() for _ in range(200)]
    assert encoder._matrix(pieces) == [encoder._heap(p) for p in pieces]


def test_chunks_join_to_the_text():
    for text in ODD:
        c = chunks(text)
        assert c is None or "".join(map(spelled, c)) == text


def test_query_decodes_and_handles_null_and_empty(spark, docs):
    out = {r.doc_id: r for r in byte_bpe.digests(docs([None, "", "a b"]), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert out[0].n_tokens == out[1].n_tokens == 0 and out[0].ids_sha256 == out[1].ids_sha256
    assert out[2].n_tokens == 2
    assert byte_bpe.digests(docs([]), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    both = byte_bpe.decode(byte_bpe.encode(docs(["héllo wörld"]), P.path("byte_bpe_50k.tiktoken"), P.PATTERN), P.path("byte_bpe_50k.tiktoken"))
    assert bytes(both.first().decoded).decode() == "héllo wörld"


def test_files_equal_the_library(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ODD + [None] + ["more words, and some. " * 20 + "x"]
    df = docs(texts).repartition(5)
    folder, shape = f"file://{tmp_path}/tokens", {"vocabulary": 50_257, "end_id": 2}
    parts = token_files.write(df, folder, P.path("byte_bpe_50k.json"), **shape)
    got = {r.doc_id: r for r in token_files.read(spark, folder, parts, with_tokens=True, batch_tokens=100, **shape).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert list(got[i].tokens) == ids and got[i].n_tokens == len(ids) and got[i].start == start, text
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_no_files_for_no_documents(spark, docs, tmp_path):
    folder, shape = f"file://{tmp_path}/none", {"vocabulary": 50_257, "end_id": 2}
    parts = token_files.write(docs([]), folder, P.path("byte_bpe_50k.json"), **shape)
    assert parts == [] and token_files.read(spark, folder, parts, **shape).count() == 0


def test_files_keep_null_and_large_ids_repeated_rows_and_long_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    big, long_ = (1 << 53) + 1, " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [(None, "no id", "x", 1), (big, "a b", "x", 1), (big + 2, "c", "x", 1), (5, "same", "x", 1), (5, "same", "x", 1), (6, long_, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, part int").coalesce(1)
    folder, shape = f"file://{tmp_path}/edge", {"vocabulary": 50_257, "end_id": 2}
    parts = token_files.write(df, folder, P.path("byte_bpe_50k.json"), **shape)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.start, list(r.tokens)) for r in token_files.read(spark, folder, parts, with_tokens=True, **shape).collect())
    ordered, start = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1])), 0
    for (doc, text, _, _), (i, at, tokens) in zip(ordered, got):
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        assert (i, at, tokens) == (-1 if doc is None else doc, start, ids)
        start += len(ids)
    assert len(got) == len(rows)


def test_digests_keep_null_and_large_ids_and_repeated_rows(spark, reference):
    import hashlib

    big, long_ = (1 << 53) + 1, "wörd " * 5000 + "x" * 700
    rows = [(None, "no id"), (big, "a b"), (big, "a b"), (7, long_)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS n_tokens", "1 AS _text").coalesce(1)
    got = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in byte_bpe.digests(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()]
    want = []
    for i, text in rows:
        ids = reference.encode_ordinary(text)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_words_before_any_punctuation_share_their_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    e = token_files.LibraryEncoder(P.path("byte_bpe_50k.json"), "<u2")
    tails = ["", "###", ".%%%", "!?", "'", "'s", "s'", "'.", "$5", "_x", ",,", "-", ")", "\u2019s", "*\u00e9"]
    texts = [f"{w}{tail} {w}{tail}\n{w}" for w in ("word", "\u00c9t\u00e9", "x1", "it's", "(a", "\u65e5\u672c") for tail in tails]
    assert [np.frombuffer(x, "<u2").tolist() for x in e(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    plain = [t for t in e.pieces.young if "word" in t and "'" not in t]
    assert set(plain) == {"word", " word", "word$5", " word$5", "word_x", " word_x", "word\u2019s", " word\u2019s", "word*\u00e9", " word*\u00e9"}


def test_common_chunks_stay_in_the_cache():
    from tidemark.llm.token_pieces import Cache

    made = []
    cache = Cache(lambda found: made.extend(found) or list(map(len, found)), limit=20)
    for k in range(50):
        got = cache.of([["common", f"rare {k}"], [f"another {k}", "common"]])
        assert got["common"] == 6 and got[f"rare {k}"] == len(f"rare {k}")
        assert len(cache.young) + len(cache.old) <= 20 + 2 * 3
    assert made.count("common") == 1 and len(made) == 101
