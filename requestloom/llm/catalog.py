"""Queries of the operators over the given tables, with a SQL check where SQL can express one.

``LLM_CATALOG`` maps a query name to (DataFrame function, SQL text or None).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, decontamination, line_dedup, ngram_join, pii, sharding, simhash_dedup, spelling, token_counts
from . import token_files, topk_search, toxicity, vector_codes
from .common import table

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"

LLM_CATALOG: dict = {}


def query(name: str, sql: str | None = None):
    def register(function):
        LLM_CATALOG[name] = (function, sql)
        return function

    return register


def shingles_sql(source: str, key: str, lowered: str) -> str:
    """(key, sh): distinct word 5-grams; fewer words are one run."""
    return f"""
  select {key}, unnest(list_distinct(case
    when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end)) as sh
  from (select {key}, list_filter(string_split_regex({lowered}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') as ws
        from {source} where text is not null)"""


@query("op1_byte_bpe")
def byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN, ids=False)


@query(
    "op2_decontamination",
    f"""with d as ({shingles_sql("documents", "doc_id", "lower(text)")}),
  b as ({shingles_sql("benchmark", "item_id", "lower(text)")}),
  q as (select item_id, count(*) as n_item from b group by item_id),
  m as (select doc_id, item_id, count(*) as n_shared from d join b using (sh) group by doc_id, item_id)
  select doc_id, item_id, n_item, n_shared, n_shared / n_item as containment from m join q using (item_id)
  where n_shared >= 0.75 * n_item""",
)
def contaminated(spark, sf_dir):
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_toxicity")
def toxic(spark, sf_dir):
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_sharding")
def shards(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("virtual").alias("virtual_slot"),
    )


@query("op5_token_counts")
def counted(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op6_ngram_jaccard",
    f"""with recursive s as ({shingles_sql("documents", "doc_id", ASCII_LOWER)}),
  n as (select doc_id, count(*) as n from s group by doc_id),
  e as (select a.doc_id as a, b.doc_id as b from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id
        join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
        group by a.doc_id, b.doc_id having 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))),
  r as (select doc_id as node, doc_id as seen from documents
        union select r.node, e.b from r join e on e.a = r.seen)
  select doc_id, coalesce(n, 0) as n_shingles, component_id
  from (select node as doc_id, min(seen) as component_id from r group by node) left join n using (doc_id)""",
)
def similar(spark, sf_dir):
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


@query(
    "op7_exact_topk",
    """with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
    from embeddings where embedding is not null),
  s as (select q.vec_id as query_id, c.vec_id,
      cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
    from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id)
  select query_id, rank, vec_id, score
  from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
  where rank <= 10""",
)
def nearest(spark, sf_dir):
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


@query("op8_line_dedup")
def deduped(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


@query("op9_token_files")
def token_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return token_files.read_files(token_files.write_files(docs, public_tokenizers.path(WORD_TOKENIZER)))


@query("op10_personal_data")
def personal_data(spark, sf_dir):
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))

    def shown(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )


def part_codes_sql() -> str:
    """Every round of the part codes as a step of its own; distances and means are plain lists."""
    parts, rounds = vector_codes.PARTS, vector_codes.ROUNDS
    steps = [
        f"""v as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor({vector_codes.SCALE} * cast(x as double)) as bigint)) as v
    from embeddings where embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"""p as materialized (select vec_id, label, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] as x
    from v, (select unnest(range(0, {parts})) as part))""",
        f"""c0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as entry, x as c
    from p where vec_id in (select vec_id from v order by vec_id limit {vector_codes.ENTRIES}))""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} as materialized (select vec_id, any_value(label) as label, part, any_value(x) as x,
      min(struct_pack(d := d, entry := entry)) as best
    from (select p.vec_id, p.label, p.part, p.x, entry,
        cast(list_sum(list_transform(list_zip(x, c), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) as bigint) as d
      from p join c{i} on p.part = c{i}.part) group by vec_id, part)""")
        if i < rounds:
            steps.append(f"""m{i} as (select part, entry, list(m order by place) as c from (
      select part, best.entry as entry, place, cast(floor(cast(sum(x[place]) as double) / count(*)) as bigint) as m
      from a{i}, (select unnest(range(1, (select max(len(x)) from p) + 1)) as place) group by all) group by part, entry)""")
            steps.append(f"""c{i + 1} as materialized (select part, entry, coalesce(m{i}.c, c{i}.c) as c
    from c{i} left join m{i} using (part, entry))""")
    return f"""with {", ".join(steps)},
  f as (select vec_id, any_value(label) as label, string_agg(printf('%02x', best.entry), '' order by part) as code,
      cast(sum(best.d) as bigint) as error from a{rounds} group by vec_id),
  s as (select label, cast(sum(error) as bigint) as label_error from f group by label)
  select vec_id, code, error, label_error,
    (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) from c{rounds}) as codebooks_sha256
  from f join s on f.label is not distinct from s.label"""


@query("op11_vector_codes", part_codes_sql())
def coded(spark, sf_dir):
    return vector_codes.code_vectors(table(spark, sf_dir, "embeddings"))


@query("op12_spelling_variants")
def variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query("op13_simhash_dedup")
def near(spark, sf_dir):
    return simhash_dedup.near_documents(table(spark, sf_dir, "documents"))
