"""The registered queries of this subpackage and the SQL some of them can be checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.llm import bpe, curriculum, decontamination, hard_negatives, neighbours, pii, quality, sharding
from tillsight.llm import shingle_join, tokens, toxicity, vector_codes, warc
from tillsight.llm.shipping import ship_package
from tillsight.plans.materialize import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sharding.document_sizes(_table(spark, sf_dir, "documents"))
    placed = sharding.shard_rows(sizes, ["doc_id", "text_crc32", "size"], shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "place",
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.decide_records(_table(spark, sf_dir, "pages"))
    archives = warc.write_archives(records, warc.archive_folder(spark))
    return warc.read_archives(archives, payload=False).select(
        F.col("page").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"), "url",
    )


def op3_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.shingle_classes(_table(spark, sf_dir, "documents"), size=3, percent=90)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels")
    network = toxicity.train_on(docs, labels)
    scored = materialize(toxicity.score_texts(docs, network, carry=["doc_id", "lang"]))
    limits = toxicity.language_thresholds(scored, labels).withColumnRenamed("lang", "of")
    return scored.join(limits, F.col("lang").eqNullSafe(F.col("of")), "left").select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        (F.col("score") >= F.coalesce("threshold", F.lit(toxicity.THRESHOLD))).alias("flagged_for_language"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    featured = materialize(quality.document_features(docs, ["doc_id", "source", "lang"]))
    model = quality.learn(featured, _table(spark, sf_dir, "labels"))
    return model.score(featured).select(
        "doc_id", "source", "lang", "evidence", "host_rate", "path_rate", "quality_score",
        (F.col("quality_score") >= quality.THRESHOLD).alias("keep"),
    )


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_passages(docs, _table(spark, sf_dir, "benchmark"))
    hit = decontamination.hit_words(F.col("hits"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        decontamination.item_digest(F.col("items")).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"), "byte_bpe_50k.json")


def op9_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", "source", curriculum.word_count(F.col("text")).alias("size"),
        curriculum.stream_order(F.col("doc_id"), F.col("text")).alias("order"),
    )
    docs = materialize(docs)
    sources = curriculum.targets(curriculum.weigh_by_rank(curriculum.source_sizes(docs)))
    mixed = curriculum.mix(docs, sources)
    taken = F.aggregate("copies", F.lit(0).cast("bigint"), lambda n, c: n + c["words"])
    first = F.col("copies")[0]["position"]
    return mixed.select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("copies").alias("uses"),
        F.when(F.size("copies") > 0, first).alias("position"),
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    digest = F.sha2(pii.span_text(base).cast("binary"), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), pii.span_text(F.col("pii")).alias("spans"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = "byte_bpe_multi_50k.tiktoken"
    coded = bpe.encode_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks)
    return bpe.decode_ids(coded, ranks).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.mine(vectors, lambda id: id % 100 == 0)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = vector_codes.compress(_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    # stored, so that Spark knows its size when it chooses the join
    sums = materialize(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    digits = F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", F.array_join(digits, "").alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )


Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_feistel_shards,
        op2_warc,
        op3_shingle_join,
        op4_toxicity,
        op5_quality,
        op6_neighbours,
        op7_decontamination,
        op8_token_counts,
        op9_curriculum,
        op10_pii,
        op11_byte_bpe,
        op12_hard_negatives,
        op13_vector_codes,
    )
}

#: DuckDB statements over the views of the test tables.
ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op9_curriculum"] = r"""
with docs as (
    select doc_id, source,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
           md5(coalesce(doc_id::varchar, '') || ':' || coalesce(md5(text), '')) as h
    from documents
),
src as (
    select source, sum(size)::bigint as source_size,
           (row_number() over (order by source nulls last) - 1)::bigint as rk
    from docs group by source
),
weighed as (
    select *, rk % 3 + 1 as weight, 3 * source_size as cap, 3 * source_size / (rk % 3 + 1)::double as ratio from src
),
sums as (
    select *,
        (sum(source_size) over () - coalesce(sum(cap) over (order by ratio, source nulls last
            rows between unbounded preceding and 1 preceding), 0))::double as left_over,
        sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following)::double as rest
    from weighed
),
share as (
    select arg_min(struct_pack(l := left_over, r := rest), struct_pack(a := ratio, b := source)) as s
    from sums where left_over / rest <= ratio
),
plan as (
    select source, source_size, rk,
        case when left_over / rest <= ratio then weight * s.l / s.r else cap::double end as target
    from sums, share
),
placed as (
    select d.doc_id, d.size, p.source_size, p.target, p.rk, floor(p.target + 0.5)::bigint as cut,
        (sum(d.size) over (partition by d.source order by d.h, d.doc_id, d.size
            rows between unbounded preceding and current row) - d.size)::bigint as start
    from docs d join plan p on d.source is not distinct from p.source
),
taken as (
    select *,
        least(start + size, cut) - least(start, cut) as t0,
        least(source_size + start + size, cut) - least(source_size + start, cut) as t1,
        least(2 * source_size + start + size, cut) - least(2 * source_size + start, cut) as t2,
        start / target as f
    from placed
)
select doc_id, size, source_size, target, (t0 + t1 + t2)::bigint as taken,
    ((t0 > 0)::int + (t1 > 0)::int + (t2 > 0)::int)::int as uses,
    case when t0 <= 0 then null
         when rk % 3 = 0 then case when f < 0.625 then 2 * f / (1.5 + sqrt(2.25 - 2 * f))
              else 0.5 + 2 * (f - 0.625) / (1 + sqrt(1 - 2 * (f - 0.625))) end
         when rk % 3 = 1 then 2 * f / (1 + 1)
         else case when f < 0.375 then 2 * f / (0.5 + sqrt(0.25 + 2 * f))
              else 0.5 + 2 * (f - 0.375) / (1 + sqrt(1 + 2 * (f - 0.375))) end
    end as position
from taken
"""

# Word-by-word search by string position: every window, padded, in the padded word sequence of every document.
ORACLE_SQL["op7_decontamination"] = r"""
with d as (
    select doc_id, row_number() over () as rn,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents
),
b as (
    select item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark
),
items as (
    select item_id, least(10, len(w)) as m, list_aggregate(w[i:i + least(10, len(w)) - 1], 'string_agg', ' ') as win
    from b, unnest(range(1, len(w) - least(10, len(w)) + 2)) as t(i) where len(w) > 0
),
lengths as (select distinct m from items),
runs as (
    select rn, i, l.m, list_aggregate(w[i:i + l.m - 1], 'string_agg', ' ') as win
    from d, lengths l, unnest(range(1, len(w) - l.m + 2)) as t(i)
),
occ as (select r.rn, r.i, r.m, k.item_id from runs r join items k on k.m = r.m and k.win = r.win),
hit as (select rn, count(distinct i + j) as n_hit from occ, unnest(range(0, m)) as t(j) group by rn),
named as (
    select rn, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids
    from occ group by rn
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (rn) left join named using (rn)
"""

ORACLE_SQL["op12_hard_negatives"] = r"""
with v as (
    select row_number() over () as rn, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as e
    from embeddings
    where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
    select a.rn as anchor, a.vec_id as anchor_id, b.rn, b.vec_id, a.label = b.label as same,
        list_dot_product(a.e, b.e)::bigint as score
    from v a join v b on a.rn <> b.rn where a.vec_id % 100 = 0
),
p as (
    select * from (
        select *, row_number() over (partition by anchor order by score desc, vec_id nulls last) as nth from s where same
    ) where nth <= 5
),
n as (
    select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
        row_number() over (partition by p.anchor, p.nth order by s.score desc, s.vec_id nulls last)::int as rank
    from p join s on s.anchor = p.anchor and not s.same
    where 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score
)
select * from n where rank <= 10
"""


def _vector_codes_sql(rounds: int = 4) -> str:
    """Rounds of k-means by all distances, one common table after another; a distance is two squares less twice the product."""
    ctes = [
        """kept as materialized (
    select row_number() over () as rn, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as v
    from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
)""",
        """x as materialized (
    select rn, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] as c, list_dot_product(c, c) as s
    from kept, range(4) as t(p)
)""",
        """b0 as materialized (
    select p, row_number() over (partition by p order by vec_id nulls last, v) - 1 as e, c, s
    from x join kept using (rn) qualify e < 256
)""",
    ]
    for r in range(rounds + 1):
        ctes.append(f"""a{r} as materialized (
    select rn, p, arg_min(struct_pack(e := e, d := d), struct_pack(d := d, e := e)) as near
    from (select rn, x.p, e, x.s - 2 * list_dot_product(x.c, b.c) + b.s as d from x join b{r} b on x.p = b.p) group by rn, p
)""")
        if r == rounds:
            break
        ctes.append(f"""m{r} as materialized (
    select p, e, list(floor(total / n) order by i) as c
    from (
        select a.p, a.near.e as e, i, sum(x.c[i]) as total, count(*) as n
        from a{r} a join x on a.rn = x.rn and a.p = x.p, unnest(range(1, len(x.c) + 1)) as t(i) group by a.p, a.near.e, i
    ) group by p, e
)""")
        ctes.append(f"""b{r + 1} as materialized (
    select b.p, b.e, coalesce(m.c, b.c) as c, list_dot_product(coalesce(m.c, b.c), coalesce(m.c, b.c)) as s
    from b{r} b left join m{r} m on m.p = b.p and m.e = b.e
)""")
    ctes.append(f"""coded as (
    select rn, string_agg(lower(printf('%02x', near.e::int)), '' order by p) as code, sum(near.d)::bigint as error from a{rounds} group by rn
)""")
    body = f"""
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
    (select sha256(string_agg(array_to_string(list_transform(c, lambda y: y::bigint), ','), ',' order by p, e)) from b{rounds}) as codebooks_sha256
from kept join coded using (rn)
"""
    return "with " + ",\n".join(ctes) + body


ORACLE_SQL["op13_vector_codes"] = _vector_codes_sql()
