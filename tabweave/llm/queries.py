"""The checked queries of this subpackage over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm import (decontaminate, jaccard, knn, language, lines, lm, merkle, packing, phrases, planes,
                          quality, token_counts, toxicity)
from tabweave.llm.text import crc_mod
from tabweave.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_decontamination(spark, folder):
    found = decontaminate.match_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0] + 1)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
                        (hit > 0).alias("contaminated"))


@query
def op2_lm_scores(spark, folder):
    docs = table(spark, folder, "documents")
    return lm.score(docs, lm.fit(docs))


@query
def op3_line_dedup(spark, folder):
    docs = table(spark, folder, "documents")
    gone = lines.removed_lines(docs).groupBy("doc_id", "crc").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("line_no")), ",").alias("removed"))
    sizes = docs.select("doc_id", lines.text_checksum(F.col("text")).alias("crc"),
                        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"))
    both = sizes.alias("s").join(gone.alias("g"), F.expr("s.doc_id <=> g.doc_id and s.crc = g.crc"), "left")
    n = F.coalesce("n", F.lit(0))
    return both.select("s.doc_id", "n_lines", n.alias("n_removed"), (F.col("n_lines") - n).alias("n_kept"),
                       F.coalesce("removed", F.lit("")).alias("removed_lines"))


@query
def op4_token_counts(spark, folder):
    return token_counts.count_tokens(table(spark, folder, "documents"), "piece_bpe_32k.model", limit=4096)


@query
def op5_quality_classifier(spark, folder):
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, table(spark, folder, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), quality.HELD_OUT_OF) == 0).alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query
def op6_packing(spark, folder):
    pieces = packing.pack_documents(table(spark, folder, "documents"), "byte_bpe_50k.json")
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@query
def op7_bit_planes(spark, folder):
    files = scratch_path(spark, "token-ids")
    planes.write_ids(table(spark, folder, "documents"), files, "word_bpe_49k.json")
    return planes.read_ids(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op8_jaccard_join(spark, folder):
    return jaccard.similar_texts(table(spark, folder, "documents")).select("doc_id", "class_id", "n_links", "group_id")


@query
def op9_exact_top_k(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return knn.top_k(vectors, F.col("vec_id") % 100 == 0)


@query
def op10_toxicity(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    # the two categories that the labels know: unreadable shouting and junk, then abuse
    marks = labels.select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    chain = toxicity.fit(docs, marks, ["junk", "toxic"])
    return toxicity.score(docs, chain).select(
        "doc_id", (crc_mod(F.col("doc_id"), toxicity.HELD_OUT_OF) == 0).alias("held_out"), "p_junk",
        F.col("p_toxic").alias("score"), (F.col("p_toxic") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op11_language(spark, folder):
    docs = table(spark, folder, "documents")
    found = language.predict(docs, language.fit(docs, language.learned(F.col("doc_id"))))
    held = crc_mod(F.col("doc_id"), language.HELD_OUT_OF) == language.HELD_OUT
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op12_merkle_manifest(spark, folder):
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7) == 0
    made = merkle.documents_manifest(table(spark, folder, "documents"), tampered)
    siblings = F.flatten(F.transform("proof", lambda step: step["others"]))
    return merkle.row_proofs(made).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root",
        F.sha2(F.array_join(siblings, "").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


@query
def op13_phrase_collocations(spark, folder):
    return phrases.collocations(table(spark, folder, "documents"))


#: floor(1024 * x) of every component, all pairs of a query with the rows of its length
SQL["op9_exact_top_k"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, d.vec_id,
         cast(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v d on d.vec_id <> q.vec_id and len(d.e) = len(q.e)
  where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10"""


#: levels by recursion; a sibling is kept behind its side's digit, and the fold runs along the list of them
SQL["op12_merkle_manifest"] = """
with recursive docs as (
  select doc_id, lang, row_number() over () as row_no, n_chars,
         coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') as before_n,
         coalesce(strlen(text) || ':' || text, '-') as after_n,
         list_reduce(
           list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: cast(ascii(ch) as bigint))),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]),
             lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) as crc
  from documents),
hashed as (
  select *, sha256(before_n || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') || after_n) as leaf,
         case when xor(crc, 4294967295) % 7 = 0
              then sha256(before_n || coalesce(strlen(cast(n_chars + 1 as varchar)) || ':' || (n_chars + 1), '-') || after_n)
              end as claimed
  from docs),
langs as (select lang, row_number() over (order by lang nulls first) - 1 as tree from (select distinct lang from docs)),
leaves as (
  select h.*, l.tree, row_number() over (partition by l.tree order by doc_id nulls first, leaf, row_no) - 1 as rank
  from hashed h join langs l on h.lang is not distinct from l.lang),
nodes as (
  select tree, 0 as level, rank, leaf as digest, count(*) over (partition by tree) as n from leaves
  union all
  select tree, level + 1, rank // 2, sha256(string_agg(digest, '' order by rank)), (n + 1) // 2
  from nodes where n > 1 group by tree, level, rank // 2, n),
tops as (
  select 0 as level, tree as rank, digest, count(*) over () as n from nodes where n = 1
  union all
  select level + 1, rank // 2, sha256(string_agg(digest, '' order by rank)), (n + 1) // 2
  from tops where n > 1 group by level, rank // 2, n),
steps as (
  select l.row_no, a.level, ((l.rank >> a.level) % 2) || coalesce(b.digest, '') as step
  from leaves l join nodes a on a.tree = l.tree and a.rank = l.rank >> a.level and a.n > 1
  left join nodes b on b.tree = a.tree and b.level = a.level and b.rank = xor(a.rank, 1)
  union all
  select l.row_no, 1000 + a.level, ((l.tree >> a.level) % 2) || coalesce(b.digest, '')
  from leaves l join tops a on a.rank = l.tree >> a.level and a.n > 1
  left join tops b on b.level = a.level and b.rank = xor(a.rank, 1)),
ways as (select row_no, list(step order by level) as way from steps group by row_no),
proved as (
  select l.doc_id, l.leaf, s.digest as subroot, t.digest as root,
         sha256(array_to_string(list_transform(coalesce(w.way, []), lambda x: x[2:]), '')) as proof_sha256,
         list_reduce(list_prepend(coalesce(l.claimed, l.leaf), coalesce(w.way, [])),
           lambda d, x: sha256(case when x[1] = '0' then d || x[2:] else x[2:] || d end)) as folded_root
  from leaves l left join ways w using (row_no) join nodes s on s.tree = l.tree and s.n = 1 join tops t on t.n = 1)
select *, folded_root = root as verified from proved"""


#: words with their piece's number, so that neighbours in a piece follow each other
SQL["op13_phrase_collocations"] = r"""
with pieces as (
  select lang, row_number() over () as piece_no, piece from (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents)),
listed as (select lang, piece_no, regexp_extract_all(piece, '[^\x20\x09]+') as words from pieces),
words as (select lang, piece_no, unnest(words) as w1, unnest(range(len(words))) as place from listed),
grams as (
  select lang, w1, lead(w1) over near as w2, lead(w1, 2) over near as w3 from words
  window near as (partition by lang, piece_no order by place)),
one as (select lang, w1 as p, count(*) as f from grams group by all),
two as (select lang, w1, w2, w1 || ' ' || w2 as p, count(*) as f from grams where w2 is not null group by all),
three as (select lang, w1, w2, w3, w1 || ' ' || w2 || ' ' || w3 as p, count(*) as f from grams where w3 is not null group by all),
cuts as (
  select t.lang, t.p, t.f as a, 1 as k, x.f as l, y.f as r
  from two t join one x on x.lang = t.lang and x.p = t.w1 join one y on y.lang = t.lang and y.p = t.w2 where t.f >= 10
  union all
  select t.lang, t.p, t.f, 1, x.f, y.f
  from three t join one x on x.lang = t.lang and x.p = t.w1 join two y on y.lang = t.lang and y.w1 = t.w2 and y.w2 = t.w3
  where t.f >= 10
  union all
  select t.lang, t.p, t.f, 2, x.f, y.f
  from three t join two x on x.lang = t.lang and x.w1 = t.w1 and x.w2 = t.w2 join one y on y.lang = t.lang and y.p = t.w3
  where t.f >= 10),
scored as (
  select *, cast(1000000 * cast(a as hugeint) * a // (cast(l as hugeint) * r) as bigint) as score from cuts),
lowest as (select * from scored qualify row_number() over (partition by lang, p order by score, k) = 1),
around as (
  select lang, w1 || ' ' || w2 as p, f from three where f >= 10
  union all select lang, w2 || ' ' || w3, f from three where f >= 10),
widest as (select lang, p, max(f) as most from around group by all),
kept as (
  select s.* from lowest s left join widest w on w.lang = s.lang and w.p = s.p where w.most is null or 100 * w.most < 50 * s.a),
totals as (select lang, count(*) as n from words group by lang)
select k.lang, row_number() over (partition by k.lang order by score desc, a desc, p) as rank, p as phrase, a, l, r, n, score
from kept k join totals t on t.lang = k.lang
qualify rank <= 2000"""
