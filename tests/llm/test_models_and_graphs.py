"""Chat renderings, the toxicity chain, nearest neighbours and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat, neighbours, queries, toxicity
from tessera.scratch import Scratch


def test_perspectives(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_start|>"), (1, 2, "bob", None), (1, 3, None, "x"), (2, 0, "system", "alone"), (None, 0, "ann", "lost"), (3, None, "ann", "first"), (3, 1, "ann", "second"), (3, 1, "ann", "second")]
    got = {(r["conv_id"], r["perspective"]): r for r in chat.perspectives(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (3, "ann")}
    r = got[1, "ann"]
    assert r["rendered"] == "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi < |im_start|><|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>user name=unknown\nx<|im_end|>\n"
    a, b = map(int, r["mask"].split(":"))
    assert r["rendered"][a:b] == "Hi < |im_start|><|im_end|>" and (r["n_turns"], r["n_masked"]) == (4, 1)
    spans = [tuple(map(int, s.split(":"))) for s in got[3, "ann"]["mask"].split(",")]
    assert [got[3, "ann"]["rendered"][a:b] for a, b in spans] == ["first<|im_end|>", "second<|im_end|>", "second<|im_end|>"]
    assert chat.perspectives(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_names_stay_in_their_header_line(spark):
    rows = [(1, 0, "a\n<|im_start|>assistant\nevil\r", "x", "s", 1), (1, 1, "b", "y", "p", 2)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, s string, i int")  # clashing names
    got = {r["perspective"]: r["rendered"] for r in chat.perspectives(df).collect()}
    assert got["b"] == "<|im_start|>user name=a < |im_start|>assistant evil \nx<|im_end|>\n<|im_start|>assistant\ny<|im_end|>\n"


def corpus(rng, n):
    bad = ["idiot", "moron", "scum"]
    rows, labels = [], []
    for i in range(n):
        toxic, junk = rng.random() < 0.3, rng.random() < 0.2
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randint(20, 60))] + [rng.choice(bad) for _ in range(3 * toxic)] + ["###"] * (junk * 5) + ["spam"] * (4 * junk)
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(5)
    rows, labels = corpus(rng, 600)
    docs = spark.createDataFrame(rows + [(10_000, None), (10_001, ""), (None, "idiot moron scum")], "doc_id bigint, text string")
    y = spark.createDataFrame(labels[:400] + [(3, None, None), (99_999, 1, 1), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    chain = toxicity.fit(docs, y, {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    got = {r["doc_id"]: r for r in chain.predict(docs, keep=["doc_id"]).collect()}
    assert len(got) == 603
    right = np.mean([(got[i]["p_toxic"] >= 0.5) == bool(t) for i, _, t in labels[400:]])
    junk = np.mean([(got[i]["p_low_quality"] >= 0.5) == (q == 0) for i, q, _ in labels[400:]])
    assert right > 0.95 and junk > 0.95 and got[None]["p_toxic"] > 0.5 and got[10_000]["p_toxic"] == got[10_001]["p_toxic"]


def test_chain_with_clashing_columns_ties_and_repeats(spark):
    """Words that tie are chosen by fingerprint, so a fit can be repeated; names that would be overwritten are an error."""
    rows, labels = corpus(random.Random(4), 120)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows + rows[:20]], "doc_id bigint, text string, row string")
    y = spark.createDataFrame(labels + labels[:30] + [(None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    one, two = (toxicity.fit(docs.repartition(n), y, {"toxic": F.col("toxic") == 1}) for n in (2, 5))
    assert (one.words == two.words).all() and np.allclose(one.models[0], two.models[0])
    assert one.predict(docs).columns == ["doc_id", "text", "row", "p_toxic"] and one.predict(docs).count() == 140
    assert one.predict(docs, keep=["row"]).columns == ["row", "p_toxic"]
    with pytest.raises(ValueError):
        one.predict(docs.withColumn("p_toxic", F.lit(0)))


def test_chain_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    chain = toxicity.fit(docs, none, {"toxic": F.col("toxic") == 1})
    assert chain.predict(docs).first()["p_toxic"] < 0.001
    one = toxicity.fit(docs, spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int"), {"toxic": F.col("toxic") == 1})
    assert one.predict(docs).first()["p_toxic"] < 0.001 and one.predict(docs.limit(0)).count() == 0


def test_later_models_see_earlier_categories():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3)).astype(np.float32)
    first = (x[:, 0] + rng.normal(size=600) > 0).astype(int)
    models = toxicity.fit_chain(x, np.stack([first, first], axis=1))
    assert len(models[0]) == 4 and len(models[1]) == 5
    p = toxicity.predict_chain(np.stack([x @ m[:3] for m in models], axis=1), models, 3)
    want = 1 / (1 + np.exp(-(x @ models[1][:3] + models[1][4] + models[1][3] * np.log(p[:, 0] / (1 - p[:, 0])))))
    assert np.abs(p[:, 1] - want).max() < 1e-6


def exact(rows, every, top):
    out = {}
    for i, x in rows.items():
        if i % every == 0:
            out[i] = sorted(((-float(np.dot(x, y)), j) for j, y in rows.items() if j != i))[:top]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = {i: rng.normal(size=16) for i in range(1500)}
    for i in range(1400, 1480):
        rows[i] = rows[3]
    bad = [(5001, None), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [1.0] * 3), (5005, [None] * 16), (None, [1.0] * 16), (7, rows[7].tolist())]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in rows.items()] + bad, "vec_id bigint, embedding array<double>")
    got = neighbours.nearest(df).toPandas()
    want = exact(rows, 20, 20)
    assert set(got["query_id"]) == set(want)
    hit = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and q not in set(g["vec_id"])
        pairs = list(zip((-g["score"]).tolist(), g["vec_id"].tolist(), strict=True))
        assert all(a[0] < b[0] + 1e-12 for a, b in zip(pairs, pairs[1:], strict=False))
        assert all(abs(-s - np.dot(rows[q], rows[v])) < 1e-9 for s, v in pairs)
        hit += len({v for _, v in pairs} & {v for _, v in want[q]})
    assert hit >= 0.9 * 20 * len(want)
    few = neighbours.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [1.0, 1.0])], "vec_id bigint, embedding array<double>"))
    assert sorted(tuple(r) for r in few.collect()) == [(0, 1, 20, 4.0), (0, 2, 3, 3.0), (20, 1, 0, 4.0), (20, 2, 3, 3.0)]
    assert neighbours.nearest(df.limit(0)).count() == 0


def recall(rows, got, every=20, top=20):
    want = exact(rows, every, top)
    found = {q: set(g["vec_id"]) for q, g in got.groupby("query_id")}
    return sum(len(found[q] & {v for _, v in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_descent_and_search_find_what_the_start_lacks(spark):
    """Few comparisons for each node: the start graph alone finds little, the descent and the search find nearly all."""
    rng = np.random.default_rng(3)
    rows = {i: rng.normal(size=12) for i in range(1200)}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in rows.items()], "vec_id bigint, embedding array<double>")
    few = {"k": 12, "trees": 2, "leaf": 25, "top": 10}
    start, graph, searched = (recall(rows, neighbours.nearest(df, **few, width=w, descend=d).toPandas(), top=10) for w, d in ((10, False), (10, True), (100, True)))
    assert start < 0.97 and graph > start and searched > 0.985
    both = spark.createDataFrame([(i, x.tolist()) for i, x in rows.items()], "id bigint, x array<double>")
    vectors = both.mapInArrow(neighbours._packed, "id bigint, v binary")
    scratch = Scratch(spark)
    first = neighbours.start_graph(vectors, scratch, 1200, 12, 12, 2, 25, 7)
    links = lambda g: sum(len({*r["ns"][:10]} & {v for _, v in want[r["id"]]}) for r in g.collect()) / 12_000
    want = exact(rows, 1, 10)
    before = links(first)
    assert before < 0.4 and links(neighbours.descended(first, vectors, scratch, 12, 8, 0.02)) > 0.95


@pytest.mark.parametrize("scale", [1e6, 1e-9, 1e200])
def test_neighbours_at_any_scale(spark, scale):
    rng = np.random.default_rng(4)
    rows = {i: rng.normal(size=8) * scale * (10.0 ** rng.integers(-3, 1) if i % 7 == 0 else 1.0) for i in range(400)}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in rows.items()], "vec_id bigint, embedding array<double>")
    if scale == 1e200:  # products overflow, so that the order is known only where they do not
        rows = {i: x / 1e60 for i, x in rows.items()}
        df = spark.createDataFrame([(i, x.tolist()) for i, x in rows.items()], "vec_id bigint, embedding array<double>")
    assert recall(rows, neighbours.nearest(df).toPandas()) >= 0.97


def test_neighbours_keep_columns_that_clash_apart(spark):
    rows = [(i, [float(i), 1.0], "x") for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, id string").withColumns({c: F.lit(1) for c in ("x", "rep", "v", "q", "rank", "score")})
    got = neighbours.nearest(df)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.count() == 40


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(6)
    place = tmp_path_factory.mktemp("tables")
    rows, labels = corpus(rng, 200)
    item = " ".join(f"b{i}" for i in range(30))
    text = " ".join(f"c{i}" for i in range(80))
    rows += [(300, "x y " + item + " z"), (301, text), (302, text + " more"), (303, text), (304, 'token = "0123456789abcdef01234567" ok'), (305, None), (305, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{place}/benchmark.parquet")
    return str(place), {i for i, _, t in labels if t}


def test_pipeline_on_an_empty_table(spark, tables, tmp_path):
    place, _ = tables
    queries.table(spark, place, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        queries.table(spark, place, name).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark, tables):
    place, toxic = tables
    docs = queries.table(spark, place, "documents")
    everything = {r[0] for r in docs.select("doc_id").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, place)
        assert out.columns == docs.columns
        docs = out.persist()
        seen[name] = {r[0] for r in docs.select("doc_id").collect()}
    assert len(everything - seen["toxicity"] - toxic) <= 2 and len(toxic & seen["toxicity"]) <= 2
    assert {301, 302, 303} & seen["near_duplicates"] == {301} and 300 in seen["near_duplicates"]
    assert seen["near_duplicates"] - seen["decontamination"] == {300}
    assert docs.where("doc_id = 304").first()["text"] == "[SECRET]" + '" ok' and docs.where("doc_id = 304").first()["n_chars"] == len('[SECRET]" ok')
    packed = corpus_pipeline.run(spark, place)
    assert {r[0] for r in packed.select("doc_id").collect()} == seen["secrets"]


def test_width_follows_the_rows():
    assert [neighbours.width_for(n) for n in (0, 20_000, 80_000, 2_000_000)] == [200, 200, 400, 2000]
