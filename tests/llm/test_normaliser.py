"""The compiled normaliser and both kinds of models with it against the library."""

import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from barspark.llm import pieces
from barspark.llm.normaliser import Normaliser, rewrites_of

LETTERS = "aabcdeéＡＢｆﬁ①²  　\t\n ​́´½▁😀漢한ﷺ<u>"


def table(rule):
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    return proto.normalizer_spec.precompiled_charsmap


@pytest.fixture(scope="module")
def charsmap():
    return table("nmt_nfkc")


def model_file(folder, charsmap, kind, shorten, prefix, fallback, user):
    """A model of made-up pieces: nothing is trained."""
    proto = sentencepiece_model_pb2.ModelProto()
    special = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    special += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else []
    special += [("<u>", 0.0, 4), ("bc", 0.0, 4)] if user else []
    draw = random.Random(7)
    words = ["▁", "a", "b", "c", "d", "e", "A", "B", "f", "i", "1", "2", "fi", "▁a", "ab", "▁ab", "abc", "cd", "▁c", "cde", "de", "é", "aé", "▁▁", "<", "u", "漢"]
    usual = [(w, -float(k) if kind == 2 else -1.0 - 4 * draw.random(), 1) for k, w in enumerate(sorted(set(words) - {"bc"}, key=lambda w: (len(w) == 1, words.index(w))))]
    for piece, score, of in special + usual:
        proto.pieces.add(piece=piece, score=score, type=of)
    proto.trainer_spec.model_type = kind
    proto.trainer_spec.byte_fallback = fallback
    proto.trainer_spec.vocab_size = len(proto.pieces)
    proto.normalizer_spec.precompiled_charsmap = charsmap
    proto.normalizer_spec.remove_extra_whitespaces = shorten
    proto.normalizer_spec.add_dummy_prefix = prefix
    proto.normalizer_spec.escape_whitespaces = True
    path = folder / "made.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


def texts(count, seed):
    draw = random.Random(seed)
    return ["", " ", "   ", "​", "▁", "a  b ", " a ▁ "] + ["".join(draw.choice(LETTERS) for _ in range(draw.randrange(30))) for _ in range(count)]


@pytest.mark.parametrize("shorten", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("user", [True, False])
def test_unigram_models_equal_the_library(tmp_path, charsmap, shorten, prefix, fallback, user):
    path = model_file(tmp_path, charsmap, 1, shorten, prefix, fallback, user)
    ours, theirs = pieces.Transducer(pieces.load_model(path)), sentencepiece.SentencePieceProcessor(model_file=path)
    for t in texts(500, 1):
        assert ours.normalised(t) == theirs.normalize(t).replace(" ", "▁"), t
        assert ours.encode(t) == theirs.encode(t), t
        assert ours.decode(ours.encode(t)) == theirs.decode(theirs.encode(t)), t


@pytest.mark.parametrize("shorten", [True, False])
@pytest.mark.parametrize("user", [True, False])
def test_bpe_models_equal_the_library(tmp_path, charsmap, shorten, user):
    path = model_file(tmp_path, charsmap, 2, shorten, True, True, user)
    ours, theirs = pieces.Transducer(pieces.load_model(path)), sentencepiece.SentencePieceProcessor(model_file=path)
    for t in texts(500, 2):
        assert ours.encode(t) == theirs.encode(t), t
        assert ours.decode(ours.encode(t)) == theirs.decode(theirs.encode(t)), t


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
def test_every_rewrite_is_the_librarys(rule):
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    found = rewrites_of(table(rule))
    assert len(found) > 1000
    assert all(theirs.normalize(s) == t for s, t in found.items())


@settings(max_examples=200, deadline=None)
@given(st.text("ab ▁", max_size=12))
def test_spacing_by_hand(text):
    assert Normaliser(prefix=False, shorten=True)(text) == "▁".join(w for w in text.split(" ") if w).rstrip("▁")
    assert Normaliser(prefix=True)(text) == ("▁" + text.replace(" ", "▁") if text else "")


def test_no_table_has_no_rewrites():
    assert rewrites_of(b"") == {}
