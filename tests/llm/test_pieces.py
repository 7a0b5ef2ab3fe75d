import public_tokenizers
import pytest
import sentencepiece as spm
from helpers import ODD, frame, sample, sha
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb

from simforge.llm.pieces import CharMap, Pieces, encode_decode, piece_spans

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL, SP = Pieces(PATH), spm.SentencePieceProcessor(model_file=PATH)
TEXT = st.one_of(st.text(), st.text(alphabet="ab  \n\n\t▁é漢.\x00"))


@given(TEXT)
@settings(max_examples=400, deadline=None)
def test_equals_the_library(text):
    ids = SP.encode(text)
    n, digest, decoded, _ = MODEL.digests([text])[0]
    assert (n, digest, decoded) == (len(ids), sha(",".join(map(str, ids))), sha(SP.decode(ids)))


@given(TEXT)
@settings(max_examples=200, deadline=None)
def test_spans_tile_the_text(text):
    import numpy as np

    spans = MODEL.spans(text)
    assert [i for i, _, _ in spans] == SP.encode(text)
    at = 0
    for _, a, b in spans:
        assert a == at <= b
        at = b
    assert at == len(text.encode()) or not spans
    assert MODEL.digests([text])[0][3] == np.array([e for _, _, e in spans], "<u4").tobytes()


def rewriting_model(rule):
    m = pb.ModelProto()
    m.ParseFromString(open(PATH, "rb").read())
    m.normalizer_spec.CopyFrom(spec(rule))
    m.normalizer_spec.add_dummy_prefix = True
    return m.SerializeToString()


def spec(rule):
    n = spm.SentencePieceNormalizer(rule_name=rule)
    m = pb.ModelProto()
    m.ParseFromString(n.serialized_model_proto())
    return m.normalizer_spec


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_character_map(rule):
    s = spec(rule)
    charmap = CharMap(s.precompiled_charsmap)
    norm = spm.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    for text in ("ﬁne Ｆull ①½ ｶﾞ é Straße ＡＢＣ", "plain", "한글 ㈱ …", "tab\tand blank"):
        out, at = charmap.normalise(text.encode())
        assert out.decode() == norm.normalize(text)
        assert len(at) == len(out) + 1 and (at[1:] >= at[:-1]).all()


def test_rewriting_model_projects_spans():
    blob = rewriting_model("nmt_nfkc")
    m, sp = Pieces(blob), spm.SentencePieceProcessor(model_proto=blob)
    text = "  ﬁne  ＡＢＣ ① x "
    assert [i for i, _, _ in m.spans(text)] == sp.encode(text)
    covered = [text.encode()[a:b].decode(errors="ignore") for _, a, b in m.spans(text)]
    assert "".join(covered).replace(" ", "") == text.replace(" ", "")


def test_frame(spark):
    rows = sample(spark) + ODD
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_decode(frame(spark, rows, extra=True), PATH).collect()), key=repr)
    want = [(i, len(x), sha(",".join(map(str, x))), sha(SP.decode(x))) for i, x in ((i, SP.encode(t or "")) for i, t in rows)]
    assert got == sorted(want, key=repr)
    assert encode_decode(frame(spark, []), PATH).collect() == []
    assert piece_spans(frame(spark, [(1, "ab c")]), PATH).first().pieces[0].end == 2
