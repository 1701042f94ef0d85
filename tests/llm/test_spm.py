import random
import struct

import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from flowloom.llm import spm
from tests.conftest import SMALL
from tests.llm.conftest import ODD

MODEL = spm.read_model()
OURS = spm.Tokenizer(MODEL)
THEIRS = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)


def varint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | (128 if n else 0)])
        if not n:
            return out


def message(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


def unigram_model():
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -2, 1), ("a", -3, 1), ("b", -3.1, 1), ("c", -3.5, 1), ("ab", -4, 1), ("bc", -4.05, 1), ("abc", -6, 1), ("▁a", -4.2, 1), ("▁ab", -5.5, 1), ("ca", -4.4, 1), ("cab", -5.9, 1)]
    one = lambda p, s, t: message(1, message(1, p.encode()) + varint(21) + struct.pack("<f", s) + varint(24) + varint(t))
    return b"".join(one(*p) for p in pieces) + message(2, varint(24) + varint(1)) + message(3, message(1, b"identity") + varint(24) + varint(1) + varint(32) + varint(0))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_matches_the_library_and_comes_back(text):
    ids = OURS.encode(text).tolist()
    assert ids == THEIRS.encode(text)
    assert OURS.decode(ids) == THEIRS.decode(ids)
    assert OURS.decode(ids) == text.replace("▁", " ")


def test_window_gives_what_whole_cuts_give():
    rng = random.Random(1)
    parts = ["th", "e", "in", "g", " ", "an", "\n", "er", "xq", "Z", "é", "  ", "1", "ou", "tion", "st", ".", ",", "日"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 80)))
        normal = OURS.normalise(text)
        stream = spm.Stream(OURS)
        ids, size = [], rng.choice((1, 7, 100))
        for i in range(0, len(normal), size):  # in parts
            ids += stream.feed(normal[i : i + size])
        assert ids + stream.finish() == OURS.encode(text).tolist() == THEIRS.encode(text)


def test_window_is_bounded():
    stream = spm.Stream(OURS)
    text = "▁▁ab " * 30 + "abcdefgh" * 3000 + "\n▁" + "x▁y" * 50
    normal, ids = OURS.normalise(text), []
    for i in range(0, len(normal), 500):
        ids += stream.feed(normal[i : i + 500])
    assert 48 < stream.window.most_states <= 4 * OURS.vocabulary.longest + 1
    assert stream.window.commits > 100 and len(ids) > 4000
    assert ids + stream.finish() == OURS.encode(text).tolist() == OURS.stream(normal) == THEIRS.encode(text)


def test_every_id_was_committed_by_the_window(spark, monkeypatch):
    made = []
    ids = spm.Window._ids
    monkeypatch.setattr(spm.Window, "_ids", lambda self, boundary: made.append(ids(self, boundary)) or made[-1])
    texts = [r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    ours = spm.Tokenizer(MODEL)
    found = [x.tolist() for x in ours.encode_all(texts)]
    assert found == THEIRS.encode(texts)
    spans = [ours.spans.findall(ours.normalise(t)) for t in texts]
    assert sorted(i for x in made for i in x) == sorted(i for s in set().union(*spans) for i in ours.stream(s))
    assert ours.window.commits >= len(set().union(*spans))


def test_a_very_long_word_matches_the_library():
    text = "".join(random.Random(3).choice("abcdeing") for _ in range(5000))
    assert OURS.encode(text).tolist() == THEIRS.encode(text)


def test_unigram_models():
    ours, theirs = spm.Tokenizer(unigram_model()), sentencepiece.SentencePieceProcessor(model_proto=unigram_model())
    rng = random.Random(7)
    for _ in range(1500):
        text = "".join(rng.choice("abc  abcx") for _ in range(rng.randint(0, 40)))
        assert ours.encode(text).tolist() == theirs.encode(text) == ours.stream(ours.normalise(text))


def test_remembered_cuts_are_bounded(monkeypatch):
    monkeypatch.setattr(spm, "REMEMBERED", 50)
    ours = spm.Tokenizer(MODEL)
    for i in range(40):
        texts = [f"word{i}x{j} again{j % 3}" for j in range(30)]
        assert [x.tolist() for x in ours.encode_all(texts)] == THEIRS.encode(texts)
    assert len(ours._known) <= 50 + 70 and len(ours._older) <= 50 + 70


def test_models_that_rewrite_texts_are_refused():
    with pytest.raises(ValueError):
        spm.Vocabulary(unigram_model() + message(3, message(2, b"x")))


def test_tables(odd, none):
    rows = spm.decode(spm.encode(odd, MODEL), MODEL).collect()
    assert len(rows) == len(ODD)
    texts = {i: t or "" for i, t, *_ in ODD}
    for r in rows:
        assert r.text == texts[r.doc_id] and r.n_tokens == len(r.ids) and r.ids == THEIRS.encode(texts[r.doc_id])
    assert spm.encode(none, MODEL).count() == 0
