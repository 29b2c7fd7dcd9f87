import random

import numpy as np
import pyarrow as pa
import pytest

from trailspan.llm import pieces


def brute(m, text):
    """Score of the best segmentation by plain dynamic programming over all substrings."""
    best = [0.0] + [-1e300] * len(text)
    for e in range(1, len(text) + 1):
        for a in range(max(0, e - 16), e):
            p = m.pieces.get(text[a:e])
            if p is not None:
                best[e] = max(best[e], best[a] + m.score[p])
        if text[e - 1] not in m.single:
            best[e] = max(best[e], best[e - 1] + m.byte_score * len(text[e - 1].encode()))
    return best[-1]


def score(m, ids):
    return sum(m.score.get(i, m.byte_score) for i in ids)


def test_segmentation_is_best_and_chunks_join():
    m, coder = pieces.model(pieces.model_path())
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["th", "er", " ", "  ", "\n", "é", "ß", "the", "tion", "x", "😀", "1", "͸"]) for _ in range(rng.randrange(25)))
        ids, counts = coder.encode(pa.array([text], pa.string()))
        assert counts.tolist() == [len(ids)]
        if text:
            assert abs(score(m, ids.tolist()) - brute(m, (" " + text).replace(" ", pieces.SPACE))) < 1e-6
        assert m.decode(ids) == text


def test_round_trip_with_space_marks_and_long_words():
    m, coder = pieces.model(pieces.model_path())
    for text in ["", " ", "  ", "▁", "a▁b ▁", "x" * 5000, " lead", "trail ", "\t\n", "a\x00b", "tab\tnew\nline  two"]:
        ids, _ = coder.encode(pa.array([text], pa.string()))
        assert m.decode(ids) == text, repr(text)


def test_rows(spark):
    docs = spark.createDataFrame([(1, "the heat of tion", 1), (2, None, 1), (2, None, 1), (3, "", 1), (4, "a" * 150000, 1)], "doc_id long, text string, pieces_crc32 int")
    rows = pieces.with_pieces(docs, ["doc_id", "text"]).collect()
    assert len(rows) == 5 and all(r.round_trip for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[2].n_pieces == by[3].n_pieces == 0 and by[2].pieces == [] and by[4].n_pieces > 1000
    back = {r.doc_id: r.text for r in pieces.decoded(pieces.with_pieces(docs, ["doc_id", "text"]), ["doc_id", "pieces"]).collect()}
    assert back[1] == "the heat of tion" and back[3] == ""
    assert pieces.with_pieces(docs.limit(0), ["doc_id", "text"]).count() == 0
    assert np.array(by[1].pieces).max() < 32000


def test_clashing_names_raise_before_any_job(spark):
    docs = spark.createDataFrame([(1, "a b", 5)], "doc_id long, text string, N_PIECES int")
    with pytest.raises(ValueError):
        pieces.with_pieces(docs, ["doc_id", "text", "N_PIECES"])
    assert pieces.with_pieces(docs, ["doc_id", "text"]).count() == 1
    with pytest.raises(ValueError):
        pieces.decoded(docs, ["text"])


def test_parts_of_a_long_word_change_nothing(monkeypatch):
    m, _ = pieces.model(pieces.model_path())
    rng = random.Random(11)
    text = pieces.SPACE + "".join(rng.choice(["th", "er", "é", "the", "tion", "x", "😀", "1", "qz"]) for _ in range(3000))
    whole, _ = m._segment(text)
    monkeypatch.setattr(pieces, "PART", 50)
    assert m.segment(text) == whole


def test_ids_of_a_unigram_model_are_those_of_its_own_encoder(tmp_path):
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    rng = random.Random(1)
    add = lambda piece, score, kind: proto.pieces.add(piece=piece, score=score, type=kind)
    kinds = pb.ModelProto.SentencePiece
    add("<unk>", 0.0, kinds.UNKNOWN)
    for b in range(256):
        add(f"<0x{b:02X}>", 0.0, kinds.BYTE)
    some = {pieces.SPACE, *"abcdefgh", *(pieces.SPACE + "".join(rng.choices("abcdefgh", k=rng.randrange(1, 5))) for _ in range(80)), *("".join(rng.choices("abcdefgh", k=rng.randrange(2, 6))) for _ in range(300))}
    for p in sorted(some):
        add(p, -rng.uniform(2, 12), kinds.NORMAL)
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback, proto.trainer_spec.unk_id = pb.TrainerSpec.UNIGRAM, True, 0
    proto.trainer_spec.bos_id = proto.trainer_spec.eos_id = proto.trainer_spec.pad_id = -1
    proto.normalizer_spec.name, proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.escape_whitespaces = "identity", True, False, True
    path = str(tmp_path / "u.model")
    open(path, "wb").write(proto.SerializeToString())
    own, m = SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    for _ in range(400):
        text = " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 14))) for _ in range(rng.randrange(1, 9)))
        got = [i for c in m.chunks(text) for i in m.encode_chunk(c)]
        assert got == own.encode(text), text
