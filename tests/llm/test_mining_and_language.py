"""Phrase mining, the conversation trie and language identification against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import collocations, conversation_trie, language_id, queries


def phrases_by_brute_force(rows, least, top):
    count, total = Counter(), Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    count[(lang or "und", *w[i : i + m])] += 1
    candidates = {k: a for k, a in count.items() if len(k) > 2 and a >= least}
    out = []
    for (lang, *w), a in candidates.items():
        inside = any(x[0] == lang and len(x) > len(w) + 1 and any(list(x[1 + i : 1 + i + len(w)]) == w for i in range(len(x) - len(w))) and 100 * f >= 80 * a for x, f in candidates.items())
        if not inside:
            cuts = [(2000000 * a // (count[(lang, *w[:k])] + count[(lang, *w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.append((lang, -score, -a, " ".join(w).encode(), count[(lang, *w[:k])], count[(lang, *w[k:])]))
    ranked, seen = set(), Counter()
    for lang, score, a, phrase, l_, r in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.add((lang, seen[lang], phrase.decode(), -a, l_, r, total[lang], -score))
    return ranked


@pytest.mark.parametrize("budget", [1 << 20, 16])
def test_collocations(spark, monkeypatch, budget):
    """With a small budget too: many groups, prefixes extended by a word."""
    monkeypatch.setattr(collocations, "BUDGET", budget)
    rng = random.Random(3)
    rows = [(None, None), ("en", ""), ("en", " .,; \n"), (None, "New York new york NEW YORK, new york"), ("und", "new york \x0b new york"), ("é", "ß\x00x ß\x00x\tß\x00x " * 9)]
    for lang in ("en", "fr", None):
        for _ in range(60):
            rows.append((lang, "".join(rng.choice(["a", "b", "c c", "red Green blue", "x y z w v", "to be or not to be"]) + rng.choice([" ", "  ", "\t", ". ", "\n", " "]) for _ in range(40))))
    docs = spark.createDataFrame([(x, t, 1, "w") for x, t in rows], "lang string, text string, n int, word string")  # clashing names
    got = collocations.collocations(docs.repartition(5), least=6, top=25)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == phrases_by_brute_force(rows, 6, 25)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_words_of_a_long_text_in_cuts(monkeypatch):
    monkeypatch.setattr(collocations, "PIECE", 64)
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é.,\n\t") for _ in range(n)) for n in (0, 5, 3000, 1, 0, 700)] + ["no end " * 80]
    seen, linked = [], 0
    for own, starts, ends, _, follows, _, _ in collocations._words(pa.array(texts), pa.array(["en"] * len(texts))):
        seen += [own.tobytes()[a:b] for a, b in zip(starts, ends, strict=True)]
        linked += int(follows.sum())
    pieces = [re.findall(r"[^\x20\x09]+", p) for t in texts for p in re.split(r"[.,;:!?\x0A-\x0D]", t)]
    assert seen == [w.encode() for p in pieces for w in p] and linked == sum(max(len(p) - 1, 0) for p in pieces)


def trie_by_brute_force(rebuilt):
    """{depth and path: what the contract asks for}; rebuilt: conversation -> turns."""
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in own if len(rebuilt[c]) == len(p))))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), kids[p], sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(rng, n):
    rows = []
    for c in range(n):
        kind = rng.random()
        say = ["hot start", "same again"] if kind < 0.4 else [f"t{rng.randrange(4)} x" for _ in range(rng.randrange(1, 9))]
        rows += [(c, k, "user" if k % 2 else None, t) for k, t in enumerate(say + [f"t{rng.randrange(3)}"] * rng.randrange(2))]
    return rows


@pytest.mark.parametrize("shard", [1 << 14, 12])
def test_prefix_trie(spark, tmp_path, monkeypatch, shard):
    """With small shards too: several levels of open paths."""
    monkeypatch.setattr(conversation_trie, "SHARD", shard)
    monkeypatch.setattr(conversation_trie, "FEWEST", 4)
    monkeypatch.setattr(conversation_trie, "BLOCK", 7)
    rng = random.Random(5)
    rows = [r for r in conversations(rng, 170) if r[0] != 40] + [(None, 0, "user", "lost"), (400, None, "a", None), (400, 2, None, ""), (400, 1, "", "ü  b"), (401, 0, "r", "x " * 3000), (33, 0, "user", "tie"), (33, 0, "user", "tie")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, path string")
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    symbol = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()[:32]
    own = defaultdict(list)
    for c, k, r, t in rows:
        if c is not None:
            own[c].append((k is not None, k or 0, symbol(r or "", t or ""), (r or "", t or "")))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    assert any(not t for t in rebuilt.values())  # turnless ones are among them
    got = queries.op12_prefix_trie(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=str) == trie_by_brute_force(rebuilt)


def test_trie_of_nothing_and_texts_of_nodes(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert conversation_trie.prefix_trie(conversation_trie.paths(none)).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, None, "yo"), (2, 0, "user", "hi")], none.schema)
    nodes = conversation_trie.prefix_trie(conversation_trie.paths(df)).join(conversation_trie.turn_texts(df), "turn", "left")
    assert {(r["depth"], r["role"], r["text"], r["n_convs"]) for r in nodes.collect()} == {(0, None, None, 2), (1, "user", "hi", 2), (2, "", "yo", 1)}


def test_double_array_holds_its_paths():
    rng = np.random.default_rng(6)
    for _ in range(40):
        paths = sorted({tuple(rng.integers(1, 7, rng.integers(0, 6)).tolist()) for _ in range(rng.integers(1, 60))})
        trie = conversation_trie.DoubleArray(np.array([c for p in paths for c in p], np.int64), np.array([len(p) for p in paths]))
        assert len(trie.nodes) == len({p[:d] for p in paths for d in range(len(p) + 1)}) == len(set(trie.nodes.tolist()))
        for p in paths:
            s = 0
            for c in p:
                s, up = trie.base[s] + c, s
                assert trie.check[s] == up


def speech(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(7)
    alphabets = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ßéçabnop"}
    rows = [(i, lang, speech(rng, alphabets[lang], 30).upper()) for i, lang in enumerate(rng.choice(list(alphabets)) for _ in range(300))]
    model = language_id.fit(spark.createDataFrame([*rows[:200], (900, None, "x"), (901, "aa", None)], "doc_id bigint, lang string, text string"))
    assert model.langs == ["aa", "bb", "cc"]
    edge = [(None, None, "abc"), (500, "aa", None), (501, "aa", ""), (502, "aa", "12 ... 3"), (503, "aa", "漢字"), (504, "aa", "abc " * 200_000), (505, "aa", "ab" * 100_000), (rows[0][0], *rows[0][1:])]
    docs = spark.createDataFrame([*rows[200:], *edge], "doc_id bigint, lang string, text string")
    got = model.predict(docs, keep=["doc_id"]).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) - 200 + len(edge) and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([by[i]["lang_pred"] == lang for i, lang, _ in rows[200:]]) > 0.97
    assert [by[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3 and by[503]["lang_pred"] in model.langs and by[504]["lang_pred"] == "aa"
    with pytest.raises(ValueError):
        model.predict(docs.withColumnRenamed("lang", "score"))
    nothing = language_id.fit(docs.limit(0))
    assert {tuple(r) for r in nothing.predict(docs, keep=["doc_id"]).select("lang_pred", "score").collect()} == {("und", 0.0)}
    assert model.predict(docs.limit(0), keep=["doc_id"]).count() == 0


def test_word_first_backoff_in_plain_loops(spark):
    """Every text's scores against the definition, word by word and place by place."""
    rng = random.Random(8)
    train = [("x", speech(rng, "abcé", 40)) for _ in range(6)] + [("y", speech(rng, "bcdé", 40)) for _ in range(4)]
    model = language_id.fit(spark.createDataFrame(train, "lang string, text string"))
    words, totals = {k: Counter() for k in "xy"}, Counter()
    for k, t in train:
        words[k].update(t.split())
        totals[k] += len(t.split())
    known = {w for k in "xy" for w in words[k] if words["x"][w] + words["y"][w] >= 2}
    grams = {n: {k: Counter(f"<{w}>"[i : i + n] for w in words[k] for i in range(len(w) + 3 - n)) for k in "xy"} for n in range(1, 6)}
    size = {n: len({*g["x"], *g["y"]}) for n, g in grams.items()}

    def score(k, text):
        z = math.log(sum(x == k for x, _ in train) / len(train))
        for w in text.split():
            if w in known:
                z += math.log((words[k][w] + 0.5) / (totals[k] + 0.5 * len(known)))
                continue
            spelled, found = f"<{w}>", []
            for i in range(len(spelled)):
                for n in range(min(5, len(spelled) - i), 0, -1):
                    if any(grams[n][x][spelled[i : i + n]] for x in "xy"):
                        found.append(math.log((grams[n][k][spelled[i : i + n]] + 0.5) / (sum(grams[n][k].values()) + 0.5 * size[n])))
                        break
            z += sum(found) / max(len(found), 1)
        return z

    texts = [speech(rng, "abcdeé", 12) for _ in range(30)]
    assert np.allclose(model.scores(pa.array(texts)), [[score(k, t) for k in "xy"] for t in texts], atol=1e-3)
