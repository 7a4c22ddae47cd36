"""SentencePiece: ids, decoded text and spans against the library."""

import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from colloquy.llm import sentence_pieces as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = open(PATH, "rb").read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
ALPHABET = "ab eét  \n\t▁\U0001f600<s>.ß あ"


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=40) | st.text(max_size=20))
def test_ids_and_spans(text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    model = S.encoder(MODEL)
    ids = model.ids(text)
    assert ids.tolist() == LIBRARY.encode(text)
    begin, end = model.spans(text, ids)
    data = text.encode()
    for piece, lo, hi in zip(LIBRARY.encode(text, out_type=str), begin, end):
        if not piece.startswith("<0x"):
            assert data[lo:hi].decode().replace(" ", S.SPACE) in (piece, piece.removeprefix(S.SPACE))


@settings(max_examples=100, deadline=None)
@given(st.text("ab  ﬁÅＡ① ​　é가ㄱ\n\t", max_size=30))
def test_character_map(text):
    for rule in ("nmt_nfkc", "nfkc_cf"):
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(MODEL)
        other = sentencepiece_model_pb2.ModelProto()
        other.ParseFromString(library.serialized_model_proto())
        proto.normalizer_spec.CopyFrom(other.normalizer_spec)
        proto.normalizer_spec.add_dummy_prefix = True
        proto.normalizer_spec.escape_whitespaces = True
        for squeeze in (False, True):
            proto.normalizer_spec.remove_extra_whitespaces = squeeze
            model = S.encoder(proto.SerializeToString())
            want = "".join(model.library.encode(text, out_type=str))
            if "<0x" in want:
                continue
            got, begin, end = model.normalise(text)
            assert got.decode() == want
            assert (np.diff(begin) >= 0).all() and (begin <= end).all() and (not end.size or end[-1] <= len(text.encode()))
            model.spans(text, model.ids(text))


def test_operator(spark):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (3, ""), (4, "long words here " * 20000), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = S.encode_decode(docs, PATH, keep=("doc_id", "ids")).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), LIBRARY.encode(t or "", add_eos=True), LIBRARY.decode(LIBRARY.encode(t or "", add_eos=True))) for i, t in rows)
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in got) == want
    assert all(len(r.ids) == len(r.begins) == len(r.ends) for r in got)
    assert S.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query(spark):
    from colloquy.llm.queries import QUERIES

    name = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{name}/documents.parquet").collect()}
    for r in QUERIES["op1_sentencepiece"](spark, name).collect():
        ids = LIBRARY.encode(texts[r.doc_id] or "", add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_long_entries(tmp_path):
    """Entries of a character map are found however long they are."""
    rules = tmp_path / "rules.tsv"
    source = [0x3042] * 30
    rules.write_text("\n".join(f"{' '.join(f'{c:X}' for c in source[:n])}\t{chr(ord('a') + k).encode().hex().upper()}" for k, n in enumerate((1, 12, 30))) + "\n")
    library = sentencepiece.SentencePieceNormalizer(rule_tsv=str(rules))
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    own = S.CharacterMap(proto.normalizer_spec.precompiled_charsmap)
    for n in (1, 5, 12, 29, 30, 31, 75):
        data, at, out = ("あ" * n).encode(), 0, b""
        while at < len(data):
            size, target = own.longest(data, at)
            out, at = out + target, at + size
        assert out.decode() == library.normalize("あ" * n).lstrip(S.SPACE)


@settings(max_examples=60, deadline=None)
@given(st.text("ab ﬁ①② x", max_size=20))
def test_user_defined_symbols(text):
    """A user's symbols stay as they are where the character map would change them."""
    proto, other = sentencepiece_model_pb2.ModelProto(), sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(MODEL)
    other.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    proto.normalizer_spec.CopyFrom(other.normalizer_spec)
    proto.normalizer_spec.add_dummy_prefix = proto.normalizer_spec.escape_whitespaces = True
    known = {p.piece: k for k, p in enumerate(proto.pieces)}
    for k, symbol in enumerate(("①", "ﬁ", "① x", "①ﬁ")):
        piece = proto.pieces[known.get(symbol, 20000 + k)]
        piece.piece, piece.type = symbol, 4
    for squeeze in (False, True):
        proto.normalizer_spec.remove_extra_whitespaces = squeeze
        model = S.encoder(proto.SerializeToString())
        ids = model.ids(text)
        got, begin, end = model.normalise(text)
        want = "".join(model.library.encode(text, out_type=str))
        if "<0x" not in want:
            assert got.decode() == want
        model.spans(text, ids)
        data = text.encode()
        for piece, lo, hi in zip(model.library.encode(text, out_type=str), *model.spans(text, ids), strict=True):
            assert piece not in ("①", "ﬁ", "①ﬁ") or data[lo:hi].decode() == piece
