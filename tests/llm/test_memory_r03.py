"""What a Python worker holds while it packs (the pipeline's stage of packing went past an executor's memory)."""

import random

import numpy as np
from tokenizers import Tokenizer

from tessera.llm import packing, queries, transducer


def _words(n: int) -> list[str]:
    r = random.Random(5)
    return ["".join(r.choices("etaoinshrdlu", k=r.randint(1, 12))) for _ in range(n)]


def _ids(texts: list[str]):
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    return packing.word_ids(np.frombuffer(b"".join(data), np.uint8), offsets, queries.tokenizer("word_bpe_49k.json"), 2)[0]


def test_states_share_what_they_hold():
    t = transducer.Transducer(queries.tokenizer("word_bpe_49k.json"))
    words = _words(3_000)
    symbols = np.frombuffer("".join(words).encode(), np.uint8).astype(np.int64)
    ends = np.cumsum([len(w) for w in words])
    symbols[ends - 1] += 256
    t.ids(symbols, np.append(0, ends[:-1]), ends)
    entries = [e for s in t.states for e in s]
    assert len(entries) > 1.5 * len(set(entries))  # so much would be held twice
    assert len({id(e) for e in entries}) <= len(set(entries)) + 1  # the start state's own


def test_ids_do_not_depend_on_what_is_kept(monkeypatch):
    monkeypatch.setattr(transducer, "ASKED", 4)
    packing.compiled.__globals__["cache"]("tokens").clear()
    texts = [" ".join(_words(400)), "", "Naïve café, 123 тест! " * 5]
    library = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    expected = [i for t in texts for i in [*library.encode(t, add_special_tokens=False).ids, 2]]
    assert _ids(texts).tolist() == expected
    made = packing.compiled(queries.tokenizer("word_bpe_49k.json"))[0]
    made.max_states = 100  # tables are made anew, and grow past the bound
    assert _ids(texts).tolist() == expected == _ids(texts).tolist()
    packing.compiled.__globals__["cache"]("tokens").clear()
