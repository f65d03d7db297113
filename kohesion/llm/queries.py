"""One query per operator, each over its whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohesion.llm import decontaminate, embeddings, lines, mixing, quality, secrets, simhash, tokens, toxicity, warc

#: Of word_bpe_49k.json, what ends a document.
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: A line that over this share of a host's pages hold, at least so many, is boilerplate, on hosts of so many pages.
LINE_RATIO = 0.05
LINE_LEAST = 3
LINE_PAGES = 10
MIX_ALPHA = 0.5
MIX_SEED = 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), words=3, radius=2, blocks=4)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint().alias("fingerprint"), F.col("component").alias("component_id"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    clean = lines.drop_site_lines(pages, lines.url_host(F.col("url")), lines.html_lines(F.col("html")), LINE_RATIO, LINE_LEAST, LINE_PAGES)
    return clean.select("row.page_id", "host", F.col("clean").alias("clean_text"), "n_lines", "n_dropped")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), alpha=MIX_ALPHA, seed=MIX_SEED)
    return mixed.select("row.doc_id", "row.source", "row.text", "copy", F.col("order").alias("order_key"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(secrets.span_text("base").cast("binary"), 256).alias("base_sha256"), secrets.span_text("found").alias("spans")
    )


def op9_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_round_trip(table(spark, sf_dir, "documents"), vocabulary(), END_ID)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_quality_classifier,
        op2_benchmark_decontamination,
        op3_simhash_near_dedup,
        op4_embedding_near_dedup,
        op5_line_dedup,
        op6_toxicity,
        op7_source_mixing,
        op8_secret_scan,
        op9_warc_archives,
        op10_token_files,
        pipeline,
    )
    return {f.__name__: f for f in own}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


SQL = {
    "op2_benchmark_decontamination": f"""
        with items as (select item_id, {_words("text")} as w from benchmark),
        sized as (select item_id, w, least(5, len(w)) as k from items where len(w) > 0),
        shingle as (select item_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))) as s from sized),
        size as (select item_id, k, count(*) as n from shingle group by all),
        doc as (select doc_id, {_words("text")} as w from documents),
        widths as (select distinct k from sized),
        docshingle as (select doc_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))) as s from doc, widths where len(w) >= k),
        hits as (select d.doc_id, t.item_id, count(*) as shared from docshingle d join shingle t on d.k = t.k and d.s = t.s group by all)
        select h.doc_id, h.item_id, h.shared, z.n as item_size, cast(h.shared as double) / z.n as containment
        from hits h join size z on h.item_id = z.item_id where h.shared >= ceil(round(0.8 * z.n, 9))""",
    "op4_embedding_near_dedup": """
        with recursive v as (
          select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
          where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        link as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93),
        reach as (select vec_id as n, vec_id as r from embeddings union select link.b as n, reach.r from reach join link on link.a = reach.n),
        root as (select n, min(r) as component_id from reach group by n),
        cnt as (select a, count(*) as c from link group by a)
        select e.vec_id, cast(coalesce(c.c, 0) as bigint) as n_links, t.component_id, e.vec_id = t.component_id as kept
        from embeddings e join root t on e.vec_id = t.n left join cnt c on c.a = e.vec_id""",
    "op5_line_dedup": rf"""
        with base as (select page_id, nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)', 1)), '') as host,
          list_filter(list_transform(string_split_regex(coalesce(html, ''), '(?i)</?(?:{"|".join(lines.BLOCKS.split())})(?:[\s/][^>]*)?>|\n'), lambda y: trim(regexp_replace(y, '<[^>]*>', '', 'g'), ' ')), lambda y: y <> '') as l from pages),
        total as (select host, count(*) as n from base group by host),
        line as (select host, x, count(*) as c from (select host, unnest(list_distinct(l)) as x from base) group by all),
        often as (select line.host, list(x) as xs from line join total on line.host is not distinct from total.host where n >= {LINE_PAGES} and c >= {LINE_LEAST} and c > n * cast({LINE_RATIO} as double) group by all),
        kept as (select b.page_id, b.host, b.l, case when o.xs is null then b.l else list_filter(b.l, lambda y: not list_contains(o.xs, y)) end as k from base b left join often o on b.host is not distinct from o.host)
        select page_id, host, coalesce(array_to_string(k, chr(10)), '') as clean_text, len(l) as n_lines, len(l) - len(k) as n_dropped from kept""",
    "op7_source_mixing": f"""
        with s as (select source, count(*) as n, pow(count(*), {MIX_ALPHA}) as w from documents group by source),
        rate as (select source, w / (select sum(w) from s) * (select sum(n) from s) / n as r from s),
        cdf as (select source, k, sum(exp(-r + k * ln(r) - lgamma(k + 1))) over (partition by source order by k) as p from rate, range(0, 200) as t(k)),
        own as (select doc_id, source, text, cast('0x' || substr(md5('{MIX_SEED}:' || coalesce(cast(doc_id as varchar), 'null') || ':0'), 1, 13) as bigint) / cast(4503599627370496 as double) as u from documents),
        drawn as (select own.doc_id, own.source, own.text, (select count(*) from cdf where cdf.source is not distinct from own.source and cdf.p <= own.u) as c from own),
        copies as (select doc_id, source, text, unnest(range(1, c + 1)) as copy from drawn where c > 0)
        select doc_id, source, text, cast(copy as integer) as copy, md5('{MIX_SEED}:order:' || coalesce(cast(doc_id as varchar), 'null') || ':' || copy) as order_key from copies""",
    "op9_warc_archives": """
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
        m as (select *, max(page_id) over (partition by payload_digest) as top from p)
        select page_id, payload_bytes, payload_digest,
          case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
          case when payload_bytes >= 1000 and page_id <> top then top end as refers_to from m""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
