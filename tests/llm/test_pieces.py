"""Ids of pieces that the tokeniser's short ways must not take for plain words."""

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from querylume.llm import word_bpe  # noqa: E402
from querylume.llm.word_bpe import Pieces  # noqa: E402


def test_special_tokens_and_odd_pieces():
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = Pieces(path)
    special = [t.content for t in pieces.tokenizer.get_added_tokens_decoder().values()]
    for text in [*special, *(f"ab{s}cd" for s in special), "Word", "don't", "İstanbul", "x\x00y", "日本", "ÀÉ", "a1b2", "(Ab)", "it's!"]:
        told = pieces.tokenizer.encode(text, add_special_tokens=False).ids
        assert [int.from_bytes(pieces.encode(text.encode())[i : i + 4], "little") for i in range(0, 4 * len(told), 4)] == told


def test_a_plain_word_is_not_split_again(monkeypatch):
    """One pre-token is looked up as it is, without a search for pre-tokens."""
    pieces = Pieces(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr("querylume.llm.word_bpe.PRE_TOKEN", None)
    assert pieces.encode(b"Word") == pieces.words["word"]


def test_a_later_task_finds_what_an_earlier_one_has_encoded(monkeypatch):
    """Tasks of one worker share the pieces, so a word costs its merges once a worker, not once a task."""
    path = public_tokenizers.path("word_bpe_49k.json")
    told = word_bpe.shared_pieces(path).encode(b"Ofthinghand, ofthinghand")
    monkeypatch.setattr(word_bpe.shared_pieces(path).words, "model", None)
    assert word_bpe.shared_pieces(path).encode(b"ofthinghand Ofthinghand,") == Pieces(path).encode(b"ofthinghand ofthinghand,")
    assert told == Pieces(path).encode(b"ofthinghand, ofthinghand")
