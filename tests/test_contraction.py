"""Indexed pairs and contraction clusters against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from tessera.functions import sequences
from tessera.operators import contraction

CODES = sequences.isometric_codes()
SCORES = {k: min(v, 4.0) for k, v in sequences.BLOSUM62.items()}


def code(s):
    return contraction.encode([s], contraction._table(CODES), 3, 2)[0].ravel()


def limit(n, threshold=7.0):
    return threshold - 0.5 * (15 - n)


def family(rng, n, lengths=(10, 11, 13, 16)):
    """Sequences around a few seeds, one to three residues changed."""
    seeds = ["CAS" + "".join(rng.choice(sequences.RESIDUES) for _ in range(k - 5)) + "YF" for k in lengths for _ in range(3)]
    out = []
    for _ in range(n):
        s = list(rng.choice(seeds))
        for _ in range(rng.randrange(4)):
            s[rng.randrange(3, len(s) - 2)] = rng.choice("ILVMSTA")
        out.append("".join(s))
    return out


def brute_pairs(texts, threshold=7.0):
    known = {s: code(s) for s in set(texts)}
    return {(a, b): round(float(((x - y) ** 2).sum()), 6) for a, x in known.items() for b, y in known.items() if a != b and len(a) == len(b) and ((x - y) ** 2).sum() <= limit(len(a), threshold)}


def test_codes_are_isometric():
    vectors = {k: np.array(v) for k, v in CODES.items()}
    assert len(vectors) == 20 and {len(v) for v in CODES.values()} == {16}
    off = [((vectors[a] - vectors[b]) ** 2).sum() - (4 - SCORES[a + b]) for a in vectors for b in vectors if a != b]
    assert max(map(abs, off)) < 0.4 and abs(np.mean(off)) < 0.1


def test_indexed_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [*family(rng, 150), "CASSF", "CASSFF", "CASTFF", "CA", "", "CASSXXXXXXYF", "CASSXXXXXIYF"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "cdr3_aa string")
    for threshold in (7.0, 12.0):
        got = {(r["a"], r["b"]): round(r["distance"], 6) for r in contraction.indexed_pairs(df, df, CODES, threshold).collect()}
        assert got == {k: v for k, v in brute_pairs(texts, threshold).items() if k[0]}


def test_candidates_are_few(spark):
    """Of 2,000 sequences of one length under 5 % of the ordered pairs are candidates."""
    rng = random.Random(2)
    texts = {"CAS" + "".join(rng.choice(sequences.RESIDUES) for _ in range(9)) + "YF" for _ in range(2000)}
    df = spark.createDataFrame([(t,) for t in texts], "cdr3_aa string")
    assert contraction.indexed_candidates(df, df, CODES).count() < 0.05 * len(texts) ** 2


def find(root, x):
    while root[x] != x:
        x = root[x]
    return x


def parts(nodes, edges):
    root = {n: n for n in nodes}
    for a, b in edges:
        x, y = find(root, a), find(root, b)
        root[max(x, y)] = min(x, y)
    held = {}
    for n in {n for e in edges for n in e}:
        held.setdefault(find(root, n), []).append(n)
    return list(held.values())


def brute_clusters(members, v_scores, least=3.7, alike=3.5):
    """The three stages by plain loops, groups with their member sets."""
    seen = Counter((s, v) for s, v in members if 10 <= len(s) <= 24 and set(s) <= set(sequences.RESIDUES))
    out, clusters = [], []
    for n in {len(s) for s, _ in seen}:
        groups = [(f"{s}|{v}", code(s), frozenset([(s, v)])) for s, v in seen if len(s) == n]
        finished = []
        while True:
            made = {}
            for name, x, held in groups:
                others = [(round(float(((x - y) ** 2).sum()), 9), other, y, own) for other, y, own in groups if other != name and ((x - y) ** 2).sum() <= limit(n)]
                if others:
                    _, other, y, own = min(others, key=lambda t: t[:2])
                    made[min(name, other), max(name, other)] = ((x + y) / 2, held | own)
                else:
                    finished.append(held)
            if not made:
                break
            groups = [(" ".join(k), x, held) for k, (x, held) in made.items()]
        clusters += parts([m for f in finished for m in f], [(m, min(f)) for f in finished for m in f])
    lone = []

    def fits(a, b):
        return v_scores[a, b] >= least if (a, b) in v_scores else a == b

    second = []
    for c in clusters:
        if len(c) == 1:
            lone += c
            continue
        edges = [(x, y) for x in c for y in c if x < y and fits(x[1], y[1])]
        split = parts(c, edges)
        second += split
        lone += [m for m in c if not any(m in p for p in split)]
    third = []
    score = lambda a, b: sum(SCORES[x + y] for x, y in zip(a[0][3:-2], b[0][3:-2], strict=True)) / (len(a[0]) - 5)
    mers = lambda m: [m[0][3:-2][i : i + 5] for i in range(len(m[0]) - 9)]
    share = lambda a, b: any(sum(p != q for p, q in zip(x, y, strict=True)) <= 1 for x in mers(a) for y in mers(b))
    for c in second:
        edges = [(x, y) for x in c for y in c if x < y and score(x, y) >= alike and (len(c) <= 3 or share(x, y))]
        split = parts(c, edges) if len(c) > 3 else [list({m for e in edges for m in e})] if edges else []
        third += split
        lone += [m for m in c if not any(m in p for p in split)]
    for c in third:
        out += [(*m, "|".join(min(c))) for m in c]
    return sorted(out + [(*m, "|".join(m)) for m in lone if seen[m] > 1])


@pytest.mark.parametrize("seed", [3, 4])
def test_contraction_clusters_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    genes = ["TRBV1", "TRBV2", "TRBV3", "TRBV4"]
    members = [(s, rng.choice(genes[:2] if rng.random() < 0.7 else genes)) for s in family(rng, 140, (10, 12, 15))]
    members += [("CASSAAAAAAEQYF", "TRBV9"), ("CASSAAAAAAEQYF", "TRBV9"), ("CASSX", "TRBV1"), ("CASSAAAAXAEQYF", "TRBV1")]
    pairs = {("TRBV1", "TRBV2"): 3.9, ("TRBV2", "TRBV1"): 3.9, ("TRBV3", "TRBV3"): 3.0, ("TRBV1", "TRBV3"): 1.0, ("TRBV3", "TRBV1"): 1.0}
    v_scores = spark.createDataFrame([(*k, v) for k, v in pairs.items()], "v1 string, v2 string, score double")
    df = spark.createDataFrame(members, "cdr3_aa string, v_call string")
    got = sorted(tuple(r) for r in contraction.contraction_clusters(df, CODES, v_scores, scores=sequences.BLOSUM62).collect())
    assert got == brute_clusters(members, pairs)
    assert contraction.contraction_clusters(df.limit(0), CODES).count() == 0
