import random
import struct

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import piece_bpe
from tests.llm import helpers

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return piece_bpe.read_model(MODEL)


def _unpacked(ids):
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


def _texts(pieces, rnd, count):
    for k in range(count):
        if k % 4 == 0:
            yield "".join(rnd.choice(" a▁\n\tbtheinr é😀漢") for _ in range(rnd.randint(0, 60)))
        elif k % 4 == 1:
            yield "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 12))).replace("▁", " ")
        elif k % 4 == 2:
            yield "".join(rnd.choice(pieces).replace("▁", "") for _ in range(rnd.randint(1, 25)))
        else:
            yield "".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(0, 0xD7FF), rnd.randint(97, 101)])) for _ in range(40))


def test_random_texts_against_the_library(library, vocabulary):
    encoder, decoder, rnd = piece_bpe.Encoder(vocabulary), piece_bpe.Decoder(vocabulary), random.Random(3)
    pieces = [vocabulary.pieces[i] for i in sorted(vocabulary.mergeable)]
    for text in ["", " ", "   ", "▁", "<s>", "<0x41>", "\x00", "a" * 5000, " " * 5000, "漢" * 3000, *_texts(pieces, rnd, 3000)]:
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert _unpacked(encoder.encode(text, True, True)) == ids, text
        assert decoder.decode(struct.pack(f"<{len(ids)}I", *ids)) == library.decode(ids)
        assert _unpacked(encoder.encode(text, False, False)) == library.encode(text)


def test_random_ids_against_the_library(library, vocabulary):
    decoder, rnd = piece_bpe.Decoder(vocabulary), random.Random(4)
    for _ in range(3000):
        ids = [rnd.randint(0, 300) if rnd.random() < 0.7 else rnd.randint(0, 31_999) for _ in range(rnd.randint(0, 9))]
        assert decoder.decode(struct.pack(f"<{len(ids)}I", *ids)) == library.decode(ids), ids


def test_backtracking_finds_what_merging_finds(vocabulary):
    """Without the lookup of recurring segments, against plain merging of short texts."""
    encoder, rnd = piece_bpe.Encoder(vocabulary), random.Random(5)
    merger = piece_bpe.Merger(vocabulary)
    pieces = [vocabulary.pieces[i] for i in sorted(vocabulary.mergeable)]
    for _ in range(1500):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 6)))
        assert encoder.backtrack(text) == merger.merge(text)


def test_whole_table(spark, library):
    docs = helpers.awkward(spark).union(helpers.documents(spark, [(9, "x" * 50_000 + " ende", "a"), (10, "漢字" * 20_000, "a")]))
    encoded = piece_bpe.encode(helpers.clash(docs, "ids", "n_tokens", "decoded", "n"), MODEL)
    rows = piece_bpe.decode(encoded.withColumn("listed", piece_bpe.as_array(F.col("ids"))), MODEL).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert _unpacked(r.ids) == want and r.n_tokens == len(want) and r.decoded == library.decode(want) and r.n == "clash"
        assert r.listed == want
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows if not r.text) == [(0, 2), (3, 2), (4, 2)]


def test_empty_table_and_nulls(spark):
    assert piece_bpe.decode(piece_bpe.encode(helpers.empty(spark), MODEL), MODEL).count() == 0
    none = spark.createDataFrame([(None,)], "ids binary")
    assert piece_bpe.decode(none, MODEL).first().decoded == ""
    assert none.select(piece_bpe.as_array(F.col("ids"))).first()[0] == []


def test_models_with_other_rules_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as model

    proto = model.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "other.model"
    path.write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        piece_bpe.read_model(str(path))
