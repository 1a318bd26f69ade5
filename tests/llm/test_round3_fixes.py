import numpy as np
import pyarrow as pa

from skein.llm import langid, memory, packing


def test_words_of_a_group_are_kept_together(monkeypatch):
    words = packing.WordEncoder(packing.default_tokenizer())
    monkeypatch.setattr(words, "_keep", None)       # one word at a time
    texts = [" ".join(f"Wo{i}rd caf\u00e9{'ab' * (i % 7)}, {'xy' * (i % 9)}z! ..." for i in range(300)), "", " \n", "z z!"]
    for _ in range(3):                              # new, remembered, renewed from the older generation
        got = list(words.encode([t.encode() for t in texts]))
        assert got == [np.array(words._ids(t), "<u4").tobytes() for t in texts]
        words.old, words.young, words.held = words.young, {}, 0


def test_other_work_drops_the_encoder():
    run = lambda *work: list(memory.trimmed(iter, *work)([]))
    packing.encoder(packing.default_tokenizer())
    run("packing")
    assert packing._ENCODERS
    run()
    assert not packing._ENCODERS


def test_language_models_work_on_small_pieces():
    batch = pa.record_batch([pa.array(["word " * 1000] * 200)], ["t"])
    found = [(len(owner), grams.shape) for grams, owner in langid.pieces(batch, 0)]
    assert sum(n for n, _ in found) == 200 * 5000
    assert max(n for n, _ in found) < 200_000
