"""Memory of the tasks that write and read token files."""

import gc
import weakref
from itertools import islice, product

import numpy as np

from frostline.llm import tokens, wavelet


def test_the_word_table_starts_anew_before_it_is_large():
    path = tokens.tokenizer_path("word_bpe_49k.json")
    words = ("".join(w) for w in product("abcdefghijklmnopqrstuvwxyz", repeat=5))
    own = tokens.WordEncoder(path)
    for _ in range(8):
        texts = [" ".join(islice(words, 1000)) for _ in range(150)]
        ids, lengths = own.encode(texts)
        assert len(own.known) <= 1_100_000
    again, sizes = tokens.WordEncoder(path).encode(texts)
    assert np.array_equal(ids, again) and np.array_equal(lengths, sizes)


def test_a_file_that_was_read_leaves_memory_at_once():
    ids = np.arange(100_000, dtype=np.uint32) % 5000
    data = wavelet.pack([7], np.array([len(ids)]), ids)
    gc.disable()
    try:
        matrix = wavelet.WaveletMatrix(data, held_chunks=2)
        assert matrix.access(70_000) == 70_000 % 5000 and len(matrix.held) == 2
        gone = weakref.ref(matrix)
        del matrix
        assert gone() is None
    finally:
        gc.enable()
