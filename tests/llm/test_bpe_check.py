"""Ranked merging stands in for the tokenizers library only where both agree."""

import itertools
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from tessera.llm.bpe import ChunkEncoder, all_reached, byte_symbols


def saved_tokenizer(folder: str, merges: list[tuple[str, str]]) -> str:
    symbols = byte_symbols()
    tokens = [*sorted(symbols, key=symbols.get), *(a + b for a, b in merges)]
    tok = Tokenizer(models.BPE(vocab={t: k for k, t in enumerate(tokens)}, merges=merges))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    path = f"{folder}/merges.json"
    tok.save(path)
    return path


@pytest.mark.parametrize("merges, fast", [
    ([("b", "c"), ("a", "b"), ("ab", "c")], False),
    ([("a", "b"), ("b", "c"), ("ab", "c")], True),
    ([("a", "a"), ("aa", "a"), ("aa", "aa")], True),
    ([("a", "b"), ("c", "d"), ("b", "c"), ("a", "bc")], False),
])
def test_split_that_the_library_never_takes(tmp_dir, merges, fast):
    path = saved_tokenizer(tmp_dir, merges)
    enc, tok = ChunkEncoder(path), Tokenizer.from_file(path)
    assert (enc.fast is not None) == fast == all_reached(merges)
    texts = ["".join(t) for n in range(1, 7) for t in itertools.product("abc", repeat=n)] + ["abcd", "dabcdabc"]
    flat, n = enc._encode_new(texts)
    at = 0
    for text, size in zip(texts, n):
        assert list(flat[at : at + size]) == tok.encode(text, add_special_tokens=False).ids
        at += size


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_supplied_files_pass_the_check(name):
    start = time.process_time()
    assert ChunkEncoder(public_tokenizers.path(name)).fast is not None
    assert time.process_time() - start < 30
