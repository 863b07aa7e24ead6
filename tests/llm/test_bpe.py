import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from glossweave.llm import bpe
from glossweave.llm.queries import QUERIES, RANKS

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path(RANKS))


@pytest.fixture(scope="module")
def truth(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _same(rows, texts, truth):
    for r in rows:
        ids = truth.encode_ordinary(texts[r.doc_id] or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(truth.decode_bytes(ids)).hexdigest()


def test_query_against_the_library(spark, truth):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    rows = QUERIES["op2_bpe"](spark, FOLDER).collect()
    assert len(rows) == len(docs)
    _same(rows, {d.doc_id: d.text for d in docs}, truth)


def test_edges(spark, make_docs, folder_of, truth):
    pick = random.Random(3)
    parts = ["a", "é", "the", "  ", "\n", "😀", "ing", "文", "12", "%%", "<|endoftext|>", "'s", "‍", "eee", " "]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 60))) for _ in range(300)]
    docs = make_docs([None, "", " " * 5000, "a" * 3000, "".join(parts) * 20_000, *texts])
    rows = QUERIES["op2_bpe"](spark, folder_of(documents=docs)).collect()
    assert len(rows) == docs.count()
    _same(rows, {d.doc_id: d.text for d in docs.collect()}, truth)
    assert QUERIES["op2_bpe"](spark, folder_of(documents=docs.limit(0))).count() == 0


def test_any_vocabulary():
    """Rules whose merges come in odd orders, against plain merging."""
    pick = random.Random(5)
    for _ in range(60):
        letters = [b"a", b"b", b"c"]
        words = {bytes((b,)): n for n, b in enumerate(range(256))}
        for _ in range(25):
            words.setdefault(pick.choice(list(words)[97:100] + letters + [w for w in words if len(w) > 1]) + pick.choice(letters + [w for w in words if len(w) > 1]), len(words))
        machine = bpe.Transducer(words)
        for _ in range(60):
            piece = b"".join(pick.choice(letters) for _ in range(pick.randint(1, 25)))
            want = [words[piece]] if piece in words else [words[t] for t in bpe.merged(piece, words)]
            assert machine.encode(piece) == want and machine.encode(piece) == want


def test_decode_is_the_way_back(make_docs, ranks):
    docs = make_docs([None, "", "naïve 😀 text", "a a"]).withColumn("decoded", F.lit(1))
    made = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    assert {r.decoded for r in made.collect()} == {"", "naïve 😀 text", "a a"}


def test_streaming_decode(ranks):
    text = "naïve 😀 文字 \U0010ffff é"
    decoder = bpe.Decoder(ranks)
    packed = bpe.Encoder(ranks, public_tokenizers.PATTERN).encode(text)
    for stretch in (1, 2, 3, 1000):
        assert "".join(decoder.pieces(packed, stretch)) == text
    machine = bpe.Utf8Machine()
    assert machine.feed(b"a\xc3") == "a" and machine.feed(b"\xa9") == "é"
    assert machine.feed(b"\xe2\x28\xff") == "�(�" and machine.feed(b"\xf0\x9f") + machine.finish() == "�"
