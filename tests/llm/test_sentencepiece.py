import random

import numpy as np
import pytest
import sentencepiece

from gridlens.llm import queries
from gridlens.llm import sentencepiece_codec as S


@pytest.fixture(scope="module")
def model():
    return S.load_model(S.default_model_path())


@pytest.fixture(scope="module")
def plain():
    return sentencepiece.SentencePieceProcessor(model_file=S.default_model_path())


def same(codec, model, plain, texts):
    got = [np.frombuffer(x, "<i4") for x in codec.encode(texts)]
    assert [g.tolist() for g in got] == [plain.encode(t or "") for t in texts]
    decoder = S.Decoder(model)
    assert [decoder.decode(g) for g in got] == [(t or "").replace("▁", " ") for t in texts]


def test_against_the_library(model, plain):
    codec = S.Codec(model, most_bytes=1 << 20)
    rng = random.Random(7)
    letters = "the of and in ing tion er es 0123456789 .,;:!?éàñß日本語\n\t  -_<>/(){}\U0001f600"
    same(codec, model, plain, ["Hello  world\n▁ x\t é 日本", "", None, " ", "  a ", "a\n\nb", "   \n   x", " " * 40 + "日本  日", "a" * 300, "\n", " \n ", "▁▁x", "\x00\x01"])
    same(codec, model, plain, ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(400)])
    same(codec, model, plain, ["".join(model.pieces[rng.randrange(259, len(model.pieces))] for _ in range(30)).replace("▁", " ") for _ in range(400)])
    same(codec, model, plain, [" " * n + tail for n in range(1, 40) for tail in ("", "x", "\n", "日")])


def test_long_parts_without_blank(model, plain):
    import time

    codec, rng = S.Codec(model), random.Random(9)
    letters = "etaoinshrdlu0123456789-_日本語é\U0001f600\U000e0001"
    long = ["a" * 3000, "ab" * 40_000, "日本語" * 2000, "the" * 700 + "\n" + "x" * 513, "\U000e0001" * 600, "=" * 70_000]
    long += ["".join(rng.choice(letters) for _ in range(n)) for n in (512, 513, 65_536, 65_537, 140_000)]
    long += ["".join(model.pieces[rng.randrange(259, len(model.pieces))] for _ in range(5000)).replace("▁", "") for _ in range(3)]
    same(codec, model, plain, long)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    began = time.perf_counter()
    same(codec, model, plain, [text, text + "\n" + text])
    assert time.perf_counter() - began < 30  # two seconds on a quiet machine


def test_spread_over_batches_and_odd_rows(spark, model, plain, odd_docs, no_docs):
    got = S.decode_ids(S.encode_texts(odd_docs, model), model).collect()
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r.doc_id, r.text)
    assert len(got) == odd_docs.count()
    for r in got:
        assert r.decoded == (texts[r.doc_id] or "").replace("▁", " ") and r.n_tokens == len(plain.encode(texts[r.doc_id] or ""))
    assert S.decode_ids(S.encode_texts(no_docs, model), model).count() == 0


def test_given_documents(spark, data, plain):
    import hashlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries.QUERIES["op6_sentencepiece_codec"](spark, data).collect():
        ids = np.array(plain.encode(texts[r.doc_id]), dtype="<i4")
        assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
