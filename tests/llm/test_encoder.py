"""New words of the token encoder."""

import numpy as np
import public_tokenizers

from lookalike.llm import edit_counts, token_files

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


class _Counting:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, inner):
        self.inner, self.characters = inner, 0

    def encode_batch_fast(self, texts, **options):
        self.characters += sum(map(len, texts))
        return self.inner.encode_batch_fast(texts, **options)


def test_new_words_are_encoded_without_marks_between_them():
    encoder = token_files.Encoder(TOKENIZER)
    raw = encoder.tokenizer
    encoder.tokenizer = counting = _Counting(raw)
    texts = [" ".join(f"word{i}x{k}" for i in range(500)) for k in range(4)]
    texts += ["", " ", "odd  blanks\n here", "× ÷ 中 文 é", "a <|endoftext|> b<|endoftext|> c", " <| endoftext|>"]
    found = encoder.encode(texts)
    assert found == [np.array(raw.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert counting.characters < 1.1 * sum(map(len, texts))


def test_a_full_cache_keeps_what_is_in_use(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_PIECES", 3)
    encoder = token_files.Encoder(TOKENIZER)
    encoder.encode(["one two three four five"])
    encoder.tokenizer = counting = _Counting(encoder.tokenizer)
    encoder.encode(["one two six"])
    assert counting.characters == len(" six")
    assert " one" in encoder.known and "five" not in encoder.known


def test_edits_of_many_documents_are_encoded_in_one_call():
    """Plans of several documents, settled by one call, give the trees of edits made one by one."""
    encoder = token_files.Encoder(TOKENIZER)
    texts = ["", "one", "some words " * 300, "é 中文 \n\n x" * 200]
    edits = [(0, 0, "new text"), (0, 3, ""), (700, 740, " put in"), (5, 900, "x " * 5000)]
    alone = [edit_counts.edit(encoder, edit_counts.build(encoder, t), t, *e) for t, e in zip(texts, edits)]
    trees = [edit_counts.build(encoder, t) for t in texts]
    plans = [edit_counts.planned(tree, t, *e) for tree, t, e in zip(trees, texts, edits)]
    counts = iter(edit_counts.counted(encoder, [leaf for _, _, leaves in plans for leaf in leaves]))
    for tree, (after, first, leaves), (single, text, encoded) in zip(trees, plans, alone):
        tree = edit_counts.settled(tree, first, leaves, [next(counts) for _ in leaves])
        assert (tree, after, sum(map(len, leaves))) == (single, text, encoded)
        assert tree.tokens[1] == len(encoder.tokenizer.encode(after, add_special_tokens=False).ids)
