"""Classes of documents whose word-shingle sets have a Jaccard similarity of at least 0.8: a prefix-filtered self join.

All sets are sorted by one global order of shingles.  If x and y share at least t(x) = ceil(0.8 |x|) and t(y) shingles, which
similar sets do, the first |x| - t(x) + l of x and the first |y| - t(y) + l of y share at least l, for every l >= 1.  So
documents meet on the shingles of their prefixes alone, and a longer prefix demands more shared shingles (multi-match).

* Order: shingles are ordered by fingerprint, but those that more than HOT documents hold come last.  Counts are needed
  where prefixes lie: every document lays out the quarter of its shingles with the smallest fingerprints; documents of
  which hot shingles leave too few there ("overflow") lay out the rest of theirs too, counted among themselves.  Hotness is
  a property of the shingle, so the order is the same for all documents.
* Adaptive prefix: each document takes the l of LEVELS with the least estimated cost: postings to scan, sum(df - 1), plus
  the comparisons that at most sum(df - 1) / l candidates cause, each in proportion to the set.  A pair of documents uses
  the smaller l of the two.
* Postings of at most HOT documents are joined.  Hot shingles reach a prefix only where over four fifths of a document are
  hot (large groups of near copies): their postings are not joined with themselves, every document is compared with the
  posting's hub, its most typical document.
* Verification is exact, on whole sets, in two steps: hubs and each document's first candidate; then all candidates whose
  documents are in different classes still.  In a hot posting these are the documents outside its largest class against
  all others, in blocks of sets.  So no link between different classes is lost and no group's pairs are all made.

Documents with equal sets become one class before all this.  Sets and shingles are 64-bit fingerprints.

Defined results: a null or empty text or one without words has no shingles and is its own component; a null id takes no
part (component null); repeated rows get the same component; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from ..scratch import Scratch, but, having
from .repeats import _lists
from .texts import cache, mixed, powers, raw, row_groups, small_batches, windows, word_hashes

#: Documents from which a shingle is hot, prefix extensions to choose from, cost of comparing one shingle of a set against
#: that of reading one posting, sets in a block.
HOT, LEVELS, COMPARE, BLOCK = 64, (1, 2, 4, 8, 16), 0.05, 64
#: Shingles laid out at first: those below this fingerprint (a quarter of all).
QUARTER = 1 << 62


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """(sorted distinct shingle fingerprints of all texts, their number by text, fingerprint of each text's set)."""
    hashes, counts = word_hashes(data, offsets, True)
    found, n = windows(hashes, counts, size)
    text = np.repeat(np.arange(len(counts)), n)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        up, down = powers(len(hashes) + 1)
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=total[1:])
        ends = np.cumsum(counts)
        begin = ends - counts
        whole = mixed((total[ends[short]] - total[begin[short]]) * down[begin[short]] + counts[short].astype(np.uint64))
        found, text = np.concatenate([found, whole]), np.concatenate([text, short])
    signed = found.view(np.int64)
    order = np.lexsort((signed, text))
    signed, text = signed[order], text[order]
    new = np.ones(len(signed), bool)
    new[1:] = (signed[1:] != signed[:-1]) | (text[1:] != text[:-1])
    signed, text = signed[new], text[new]
    sizes = np.bincount(text, minlength=len(counts))
    total = np.zeros(len(signed) + 1, np.uint64)
    np.cumsum(mixed(signed.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    ends = np.cumsum(sizes)
    prints = mixed(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)
    return signed, sizes, prints


def _sets(size: int, part: str):
    """Map of (doc_id, text): the ``first`` quarter, the ``rest`` or ``all`` of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache("sets")
        for batch in batches:
            data, offsets = raw(batch.column(1))
            for a, b in row_groups(offsets):
                found, sizes, prints = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                text = np.repeat(np.arange(b - a), sizes)
                if part != "all":
                    inside = (found >= 0) & (found < QUARTER)
                    keep = inside if part == "first" else ~inside
                    found, text = found[keep], text[keep]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(prints), _lists(found, np.bincount(text, minlength=b - a))],
                    names=["doc_id", "n", "f", "tokens"],
                )

    return run


_SET = "doc_id bigint, n bigint, f bigint, tokens array<bigint>"


def _again(docs: DataFrame, wanted: DataFrame, size: int, part: str) -> DataFrame:
    """(f, n, tokens) of the classes ``wanted`` (doc_id, f), read again from the texts of their first documents."""
    names = wanted.select("doc_id").distinct()
    read = having(docs, names, ["doc_id"]).select("doc_id", "text").mapInArrow(_sets(size, part), _SET)
    return read.join(wanted.select("doc_id", "f"), ["doc_id", "f"], "left_semi").dropDuplicates(["f"]).select("f", "n", "tokens")


def _alike(shared, n, m, threshold: int):
    return 100 * shared >= threshold * (n + m - shared)


def _fits(a, b, threshold: int):
    return 100 * F.least(a, b) >= threshold * F.greatest(a, b)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The (a, b) of ``pairs`` that are alike; b is the rarer one."""
    right = pairs.join(sets.select(F.col("f").alias("b"), F.col("tokens").alias("tb")), "b")
    both = right.join(sets.select(F.col("f").alias("a"), F.col("tokens").alias("ta")), "a")
    shared = F.size(F.array_intersect("ta", "tb"))
    return both.where(_alike(shared, F.size("ta"), F.size("tb"), threshold)).select("a", "b")


def _in_blocks(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for f, label, tokens, names, labels, sets in zip(*(batch.column(i) for i in range(6)), strict=True):
                own = tokens.values.to_numpy()
                block, name = sets.values, np.array(names.as_py())
                values = block.flatten().to_numpy()
                sizes = np.array([len(x) for x in block])
                at = np.searchsorted(own, values)
                hit = np.append(own, 0)[np.minimum(at, len(own))] == values
                hit &= at < len(own)
                shared = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
                ok = (100 * shared >= threshold * (sizes + len(own) - shared)) & (name != f.as_py()) & (np.array(labels.as_py()) != label.as_py())
                out_a += name[ok].tolist()
                out_b += [f.as_py()] * int(ok.sum())
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; ``threshold`` in percent (80 or more)."""
    if not 80 <= threshold <= 100:
        raise ValueError("threshold: 80 to 100")
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    seen = scratch.write(docs.mapInArrow(_sets(size, "first"), _SET))
    scratch.sized(seen.count())
    named = seen.where("n > 0 and doc_id is not null")
    classes = scratch.write(named.groupBy("f").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last_id"), F.min("n").alias("n")))
    copies = named.select("doc_id", "f").join(classes.where("doc_id < last_id").select("f", F.col("doc_id").alias("first_id")), "f").where("doc_id > first_id").select("doc_id", "f")
    copies = scratch.write(copies.distinct())
    first = but(named, copies, ["doc_id", "f"])

    # 1. The first quarter: which shingles are shared, and which are hot.
    laid = first.select("f", F.posexplode("tokens").alias("pos", "t"))
    df = scratch.write(laid.groupBy("t").agg(F.count("*").alias("df")).where("df > 1"))  # written: its join can then split hot keys
    shared = scratch.write(laid.join(df, "t"))
    hot = F.col("df") > HOT
    meta = first.select("f", "doc_id", "n", F.size("tokens").alias("m"), (F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1).alias("p"))
    hots = shared.groupBy("f").agg(F.count_if(hot).alias("hots"))
    meta = scratch.write(meta.join(hots, "f", "left").select("f", "doc_id", "n", "p", (F.col("m") - F.coalesce("hots", F.lit(0))).alias("cold"), F.coalesce("hots", F.lit(0)).alias("hots")).dropDuplicates(["f"]))
    before = Window.partitionBy("f").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ranked = shared.withColumn("hots_before", F.coalesce(F.count_if(hot).over(before), F.lit(0))).join(meta.drop("doc_id"), "f")

    # 2. Overflow: the other three quarters, of documents without enough cold shingles in the first.
    over = meta.where("cold < p")
    rest = scratch.write(_again(docs, over, size, "rest"))
    laid2 = rest.select("f", F.posexplode("tokens").alias("pos", "t"))
    df2 = scratch.write(laid2.groupBy("t").agg(F.count("*").alias("df")).where("df > 1"))
    shared2 = scratch.write(laid2.join(df2, "t"))
    ranked2 = shared2.withColumn("hots_before", F.coalesce(F.count_if(hot).over(before), F.lit(0)))
    hots2 = shared2.groupBy("f").agg(F.count_if(hot).alias("hots2"))
    need = over.join(hots2, "f", "left").select(
        "f", "n", F.col("hots").alias("first_hots"), (F.col("p") - F.col("cold")).alias("need"), (F.col("n") - F.col("cold") - F.col("hots") - F.coalesce("hots2", F.lit(0))).alias("cold2"), (F.coalesce("hots2", F.lit(0)) + F.col("hots")).alias("all_hots")
    )
    ranked2 = ranked2.join(need, "f")

    # 3. Adaptive prefixes.
    level = F.greatest(F.lit(1), F.col("pos") - F.col("hots_before") + 2 - F.col("p"))
    cold = ranked.where(~hot).withColumn("level", F.when(F.col("cold") < F.col("p"), 1).otherwise(level))
    scan = {k: F.sum(F.when(F.col("level") <= k, F.col("df") - 1).otherwise(0)) for k in LEVELS}
    room = F.min(F.when(F.col("cold") < F.col("p"), 1).otherwise(F.least(F.col("cold") - F.col("p") + 1, F.col("n") - F.col("p") + 1)))
    costs = F.array(*(F.struct(F.when(F.lit(k) <= room, scan[k] * (1 + COMPARE * F.min("n") / k)).otherwise(F.lit(1e300)).alias("cost"), F.lit(k).alias("l")) for k in LEVELS))
    chosen = cold.groupBy("f").agg(F.array_min(costs)["l"].alias("l"))
    postings = cold.join(chosen, "f").where("level <= l").select("t", "f", "n", "level", "l")
    postings2 = ranked2.where(~hot & (F.col("pos") - F.col("hots_before") < F.col("need"))).select("t", "f", "n", F.lit(1).alias("level"), F.lit(1).alias("l"))
    postings = scratch.write(postings.unionByName(postings2))
    left, right = (postings.select("t", *(F.col(c).alias(c + s) for c in ("f", "n", "level", "l"))) for s in "ab")
    met = left.join(right, "t").where(F.col("fa") < F.col("fb")).where(_fits(F.col("na"), F.col("nb"), threshold)).where(F.greatest("levela", "levelb") <= F.least("la", "lb"))
    pairs = scratch.write(met.groupBy(F.col("fa").alias("a"), F.col("fb").alias("b")).agg(F.count("*").alias("shared"), F.min(F.least("la", "lb")).alias("l")).where("shared >= l").select("a", "b"))

    # 4. Hot postings: hubs.
    lacking = F.col("need") - F.col("cold2")
    hot1 = ranked.where(hot).join(need.where(lacking > 0).select("f", "need", "cold2", "all_hots"), "f").where(F.col("hots_before") < lacking)
    hot2 = ranked2.where(hot & (lacking > 0) & (F.col("first_hots") + F.col("hots_before") < lacking))
    typical = (F.col("all_hots") / F.col("n")).alias("typical")
    hot_postings = scratch.write(hot1.select("t", "f", "n", typical).unionByName(hot2.select("t", "f", "n", typical)))
    hubs = hot_postings.groupBy("t").agg(F.max(F.struct("typical", "f", "n")).alias("hub")).select("t", F.col("hub.f").alias("hub"), F.col("hub.n").alias("hub_n"))
    members = scratch.write(hot_postings.join(hubs, "t").select("hub", "hub_n", "f", "n").distinct())
    to_hub = members.where((F.col("f") != F.col("hub")) & _fits(F.col("n"), F.col("hub_n"), threshold)).select(F.col("hub").alias("a"), F.col("f").alias("b"))

    # 5. Verification: hubs and first candidates, then what is apart still.
    to_first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("f")).unionByName(members.select("f")).distinct()
    sets = scratch.write(_again(docs, meta.select("f", "doc_id").join(wanted, "f"), size, "all"))
    links = scratch.write(_verified(to_hub.unionByName(to_first).distinct(), sets, threshold))
    label = scratch.write(components(links, "a", "b"))
    labelled = pairs
    for c in "ab":
        labelled = labelled.join(label.select(F.col("node").alias(c), F.col("component").alias("label_" + c)), c, "left")
    apart = labelled.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")
    more = scratch.write(_verified(apart, sets, threshold))
    inside = members.join(label.select(F.col("node").alias("f"), "component"), "f", "left").withColumn("label", F.coalesce("component", "f"))
    sizes = inside.groupBy("hub", "label").agg(F.count("*").alias("rows"))
    largest = sizes.groupBy("hub").agg(F.max(F.struct("rows", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").select("hub", F.col("top.label").alias("major"))
    mixed_hubs = scratch.write(inside.join(largest, "hub").select("hub", "f", "label", "major"))
    minor = mixed_hubs.where("label <> major").join(sets.select("f", "tokens"), "f")
    block = minor.withColumn("block", F.row_number().over(Window.partitionBy("hub", F.pmod(F.xxhash64("f"), F.lit(64))).orderBy("f")) / BLOCK)
    block = block.groupBy("hub", F.pmod(F.xxhash64("f"), F.lit(64)), F.floor("block")).agg(F.collect_list(F.struct("f", "label", "tokens")).alias("set")).select("hub", F.col("set.f").alias("names"), F.col("set.label").alias("labels"), F.col("set.tokens").alias("sets"))
    compared = mixed_hubs.join(sets.select("f", "tokens"), "f").join(block, "hub").select("f", "label", "tokens", "names", "labels", "sets")
    last = compared.mapInArrow(_in_blocks(threshold), "a bigint, b bigint")
    every = scratch.write(links.unionByName(more).unionByName(last))
    found = components(every, "a", "b")
    first_id = found.join(classes.select(F.col("f").alias("node"), "doc_id"), "node")
    least = first_id.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = scratch.write(first_id.join(least, "component").select(F.col("node").alias("f"), "component_id"))
    scratch.drop(copies, df, shared, meta, rest, df2, shared2, postings, pairs, hot_postings, members, sets, links, label, more, mixed_hubs, every)
    ids = classes.join(of_class, "f", "left").select("f", F.coalesce("component_id", "doc_id").alias("component_id"))
    return (
        seen.join(ids, "f", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).cast("bigint").alias("component_id"))
    )
