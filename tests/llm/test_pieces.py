"""Pieces of text against the tokenizers library itself."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from bandloom.llm import bpe, chunks, words


def test_latin_letters_and_marks_encode_as_in_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = chunks.load_tokenizer(path)
    signs = [chr(c) for c in range(33, 256)]
    pieces = [form.format(c) for c in signs for form in ("{0}", "{0}{0}{0}", "Dé{0}", "{0}aB", "b{0}'s{0}", "straße,{0}.", "<|endoftext|>{0}", "x{0}<|endoftext|>")]
    pieces += ["", "it's$$$", "ŁÓDŹ***", "naïveté%%%", " a\u0085b", "é&&&", "日本,", "12a.", "a_b#"]
    wanted = [library.encode(piece, add_special_tokens=False).ids for piece in pieces]
    for encoder in (words.WordEncoder(path), bpe.TrieBPE(path)):
        for size in (len(pieces), 7):  # how new words are put together and parted must not show
            for at in range(0, len(pieces), size):
                ids, ends = encoder.encode(pa.array(pieces[at : at + size]))
                got = [g.tolist() for g in np.split(ids, ends)[:-1]]
                assert got == wanted[at : at + size]
    for ids in wanted:
        assert " ".join(encoder.token[ids]) == library.decode(ids, skip_special_tokens=False)


def test_a_worker_keeps_one_operators_state():
    chunks._held.clear()
    released = []
    chunks.hold("a", lambda: released.append("a"))
    chunks.hold("a", lambda: released.append("a"))
    assert released == []
    chunks.hold("b")
    assert released == ["a"]
    chunks.hold("c", lambda: released.append("c"))
    chunks.hold("a", lambda: released.append("a"))
    assert released == ["a", "c"] and set(chunks._held) == {"a"}
    chunks._held.clear()


def test_operators_release_what_they_filled():
    """Of the operators that follow one another in a worker only the last keeps words."""
    from bandloom.llm import language, toxicity

    path = public_tokenizers.path("word_bpe_49k.json")
    bpe._encoder(path).encode(pa.array(["some words here"]))
    assert bpe._encoders[path].kept
    model = toxicity.SparseModel.fit(["a b", "c d"], [1, 0], l1=0)
    toxicity._scorer("k", type("M", (), {"value": (model.bias, model.slots, model.values)})).score(pa.array(["some more words"]))
    assert not bpe._encoders and len(toxicity._pieces)
    crf = language.WordCRF.fit(["der und", "the and"], ["de", "en"])
    language._labeller("k", type("M", (), {"value": (crf.labels, crf.weights, crf.transitions)})).label(pa.array(["the"]))
    assert not len(toxicity._pieces) and not toxicity._scorers
    chunks.hold("none")
    assert not language._labellers


def test_byte_ranges():
    column = pa.array(["aaaa", None, "é" * 3, "", "b" * 20, "c"])
    ranges = list(chunks.byte_ranges(column, 8))
    assert ranges[0][0] == 0 and ranges[-1][1] == 6 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    assert all(sum(len((x or "").encode()) for x in column[b:e].to_pylist()[:-1]) < 8 for b, e in ranges)
    assert list(chunks.byte_ranges(pa.array([], pa.string()))) == []
