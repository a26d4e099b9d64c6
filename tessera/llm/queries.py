"""The registered queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import chat, collocations, conversation_trie, decontamination, language_id, licenses, near_duplicates, neighbours, packing, repeats, secret_scan, token_counts, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """A public tokenizer file; TESSERA_TOKENIZERS names another folder."""
    folder = os.environ.get("TESSERA_TOKENIZERS")
    return os.path.join(folder, name) if folder else public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), keep=["doc_id"])


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def toxicity_scores(spark: SparkSession, docs: DataFrame, sf_dir: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, p_low_quality, p_toxic and rejected (p_toxic of a half or more) of every row of ``docs``."""
    chain = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    return chain.predict(docs, keep=keep).withColumn("rejected", F.col("p_toxic") >= 0.5)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(spark, table(spark, sf_dir, "documents"), sf_dir, ["doc_id"])


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with the first h = crc32(id) % 4 turns of the one whose id is the next lower multiple of 20."""
    scratch = Scratch(spark)
    own = scratch.write(conversation_trie.paths(table(spark, sf_dir, "conversations")))
    c, h = F.col("conv_id"), (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    heads = own.where(c % 20 == 0).select(c.alias("base"), F.slice("symbols", 1, 3).alias("head"))
    rebuilt = own.withColumn("base", c - c % 20).join(heads, "base", "left")
    none = F.array().cast("array<binary>")
    symbols = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("symbols", h + 1, F.greatest(F.size("symbols") - h, F.lit(0))))
    return conversation_trie.prefix_trie(rebuilt.select("conv_id", symbols.alias("symbols"))).drop("turn")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    model = language_id.fit(docs.where("doc_id is not null and not held_out"))
    return model.predict(docs, keep=["doc_id", "held_out"])


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_chat_perspectives": op3_chat_perspectives,
    "op4_decontamination": op4_decontamination,
    "op5_packing": op5_packing,
    "op6_license_scan": op6_license_scan,
    "op7_toxicity": op7_toxicity,
    "op8_secret_scan": op8_secret_scan,
    "op9_neighbours": op9_neighbours,
    "op10_repeats": op10_repeats,
    "op11_collocations": op11_collocations,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_language_id": op13_language_id,
}

OP3_SQL = """
with r as (select conv_id d, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, 'unknown'), coalesce(text, '')) i, coalesce(role, 'unknown') s, coalesce(text, '') x from conversations where conv_id is not null),
 w as (select distinct d, s p from r where s <> 'system'),
 v as (select r.d, p, i, s = p own, case when s = 'system' then '<|im_start|>system' || chr(10) when s = p then '<|im_start|>assistant' || chr(10) else '<|im_start|>user name=' || replace(translate(s, chr(10) || chr(13), '  '), '<|', '< |') || chr(10) end head, replace(x, '<|', '< |') || '<|im_end|>' body from r join w using (d)),
 q as (select *, coalesce(sum(length(head) + length(body) + 1) over (partition by d, p order by i rows between unbounded preceding and 1 preceding), 0) + length(head) b from v)
select d conv_id, p perspective, count(*) n_turns, count(*) filter (where own) n_masked, coalesce(string_agg(case when own then b || ':' || (b + length(body)) end, ',' order by i), '') mask, string_agg(head || body || chr(10), '' order by i) rendered from q group by d, p
"""

OP2_SQL = """
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws from documents),
 s as (select distinct doc_id, md5(array_to_string(ws[i:i + 4], ' ')) g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, case when len(ws) > 0 then 2 else 1 end))) i from w)),
 n as (select doc_id, count(*) n from s group by 1),
 p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
 e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
 u as (select a, b from e union all select b, a from e),
 r(node, root) as (select doc_id, doc_id from documents union select u.b, r.root from r join u on u.a = r.node where r.root < u.b)
select d.doc_id, coalesce(n.n, 0) n_shingles, least(d.doc_id, m.m) component_id from documents d left join n using (doc_id)
 left join (select node, min(root) m from r group by 1) m on m.node = d.doc_id
"""

OP10_SQL = """
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws from documents),
 win as (select doc_id, pos, md5(array_to_string(ws[pos:pos + 49], ' ')) k from (select doc_id, ws, unnest(range(1, len(ws) - 48)) pos from w)),
 low as (select k, min(doc_id) low from win group by k),
 cut as (select distinct doc_id, unnest(range(pos, pos + 50)) p from win join low using (k) where doc_id > low),
 cuts as (select doc_id, list(p) ps from cut group by doc_id),
 kept as (select w.doc_id, len(ws) n, case when ps is null then ws else list_transform(list_filter(range(1, len(ws) + 1), lambda i: not list_contains(ps, i)), lambda i: ws[i]) end k from w left join cuts using (doc_id))
select doc_id, cast(n as bigint) n_words, cast(n - len(k) as bigint) n_removed, sha256(array_to_string(k, ' ')) kept_sha256 from kept
"""

OP11_SQL = """
with d as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') x from documents),
 p as (select lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) x from d),
 w as (select lang, list_filter(regexp_split_to_array(x, '[\x20\x09]+'), lambda y: y <> '') ws from p),
 g as (select lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) s from w, unnest(range(1, 5)) u(m)),
 f as (select lang, m, s, count(*) f from g group by all having count(*) >= 30),
 n as (select lang, count(*) n from g where m = 1 group by 1),
 c as (select lang, m, s, f a, string_split(s, ' ') ws from f where m > 1),
 b as (select lang, array_to_string(ws[i:i + k - 1], ' ') s, max(a) longer from (select lang, ws, a, k, unnest(range(1, m - k + 2)) i from c, unnest(range(2, m)) t(k) where m > 2) group by 1, 2),
 o as (select c.* from c left join b using (lang, s) where longer is null or 100 * longer::hugeint < 80 * a::hugeint),
 k as (select lang, s, a, k, array_to_string(ws[1:k], ' ') x, array_to_string(ws[k + 1:], ' ') y from (select *, unnest(range(1, m)) k from o)),
 z as (select k.lang, k.s, a, k, x.f l, y.f r, (2000000 * a::hugeint) // (x.f::hugeint + y.f) score from k join f x on x.lang = k.lang and x.s = k.x join f y on y.lang = k.lang and y.s = k.y),
 t as (select * from z qualify row_number() over (partition by lang, s order by score, k) = 1),
 q as (select *, row_number() over (partition by lang order by score desc, a desc, s) rank from t)
select lang, rank, s phrase, a, l, r, n, cast(score as bigint) score from q join n using (lang) where rank <= 2000
"""

OP12_SQL = """
with t as (select conv_id c, sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] s, turn, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda y: y <> '')) w from conversations where conv_id is not null),
 o as (select c, list({'s': s, 'w': w} order by turn nulls first, s) xs from t group by 1),
 h as (select c, xs, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(c::varchar, ''), lambda y: ascii(y)::bigint)), lambda x, y: list_reduce(list_prepend(xor(x, y), range(0, 8)), lambda p, q: case when p % 2 = 1 then xor(3988292384, p // 2) else p // 2 end))) % 4 h from o),
 r as (select h.c, list_concat(coalesce(b.xs, [])[1:h], h.xs[h + 1:]) xs from h left join o b on b.c = h.c - h.c % 20),
 m as (select c, xs, d, xs[1:d] p from (select c, xs, unnest(range(0, len(xs) + 1)) d from r)),
 e as (select p, d, min(c) id, count(*) n, coalesce(string_agg(c::varchar, ',' order by c) filter (where d = len(xs)), '') ids from m group by 1, 2),
 k as (select e.*, f.id up, case when e.d = 0 then 0 else e.p[e.d].w end w from e left join e f on e.d > 0 and f.d = e.d - 1 and f.p = e.p[1:e.d - 1]),
 q as (select p[1:d - 1] p, d - 1 d, count(*) kids from k where d > 0 group by 1, 2),
 y as (select k.*, coalesce(kids, 0) kids from k left join q using (p, d)),
 s as (select p[1:x] p, x d, sum((n - 1) * w) saved, count(*) filter (where kids = 0) leaves from (select *, unnest(range(0, d + 1)) x from y) group by 1, 2)
select id conv_id, d depth, up parent_conv_id, n n_convs, kids n_children, leaves n_leaves, cast(saved as bigint) saved_tokens, sha256(ids) ends_sha256 from y join s using (p, d)
"""

ORACLE_SQL: dict[str, str] = {"op2_ngram_jaccard": OP2_SQL, "op3_chat_perspectives": OP3_SQL, "op10_repeats": OP10_SQL, "op11_collocations": OP11_SQL, "op12_prefix_trie": OP12_SQL}
