"""One query for each operator of this subpackage, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest inner products of every 50th vector with all others."""
    from tidewell.llm.topk import exact_top_k

    return exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: the patterns' counts and digest, and all spans."""
    from tidewell.llm.secret_scan import fit_secrets, scan_secrets

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs, fit_secrets(docs))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), count("crf").alias("n_crf"),
        F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"),
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned outside the held-out fold."""
    from tidewell.llm.langid import fit_languages, predict_languages

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"))
    model = fit_languages(docs.where(~out))
    return predict_languages(docs.select("doc_id", out.alias("held_out"), "text"), model)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that an earlier line matches by four fifths of their words."""
    from tidewell.llm.line_dedup import line_report

    found = line_report(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.array_join("removed_lines", ",").alias("removed_lines"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    from tidewell.llm.token_files import read_token_files, write_token_files

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = f.read()
    folder, manifest = write_token_files(_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return read_token_files(spark, folder, manifest)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy components of all documents."""
    from tidewell.llm.simhash import simhash_groups

    return simhash_groups(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def rank_file() -> bytes:
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of all documents, and back."""
    from tidewell.llm.byte_bpe import byte_bpe

    return byte_bpe(_table(spark, sf_dir, "documents"), rank_file(), public_tokenizers.PATTERN)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents to the weights 1, 2, 3 by source."""
    from tidewell.llm.mixing import mix_plan

    return mix_plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def toxicity_model(spark: SparkSession, docs: DataFrame, labels: DataFrame):
    """Fitted on labelled documents outside the held-out fold; fold 4 sets the weights."""
    from tidewell.llm.toxicity import fit_toxicity

    learned = labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    return fit_toxicity(docs, learned, F.crc32(F.col("_key").cast("string")) % 5 == 4)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    from tidewell.llm.toxicity import toxicity_scores

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(spark, docs, _table(spark, sf_dir, "labels"))
    return toxicity_scores(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents."""
    from tidewell.llm.exact_dedup import exact_dedup

    found = exact_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their middle moved to the end, and back."""
    from tidewell.llm.fill_in_middle import fill_in_middle, restored

    made = fill_in_middle(_table(spark, sf_dir, "documents"))
    back = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back.alias("restored_sha256"))


#: Fixed rules of the URL query: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: The listed canonical URLs of the query: advertising, betting and spam sites.
LISTED_SITES = [f"{name}.example.{zone}/" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for zone in ("com", "net", "org")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on all pages' URLs by rule, else by the listed sites."""
    from tidewell.llm.url_filter import judge_urls

    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, LISTED_SITES))).alias("url"))
    return judge_urls(_table(spark, sf_dir, "pages"), listed, URL_RULES)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 phrases of each language that hold together best, over all documents."""
    from tidewell.llm.collocations import collocations

    return collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_top_k, op2_secrets, op3_language, op4_line_dedup, op5_token_files, op6_simhash, op7_byte_bpe, op8_mixing, op9_toxicity, op10_exact_dedup, op11_fill_in_middle, op12_url_filter, op13_collocations)
}

_NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
            from embeddings where embedding is not null and not list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)
        ), scored as (
            select q.vec_id as query_id, c.vec_id,
                   list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
            from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
        ), ranked as (
            select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored
        )
        select query_id, rank, vec_id, score from ranked where rank <= 5
    """,
    "op10_exact_dedup": f"""
        with d as (select doc_id, sha256({_NORMAL}) as text_sha256 from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = max(doc_id) over w as kept, text_sha256
        from d window w as (partition by text_sha256)
    """,
    "op11_fill_in_middle": """
        with h as (
            select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u,
                   list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(sha256('1:' || coalesce(doc_id::varchar, 'null')), i, 8))::bigint) as x
            from documents
        ), c as (
            select doc_id, t, u, len(u) as n, least(x[1] % (len(u) + 1), x[2] % (len(u) + 1)) as a, greatest(x[1] % (len(u) + 1), x[2] % (len(u) + 1)) as b,
                   case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or x[3] % 100 >= 90 then 'plain'
                        when x[4] % 100 < 20 then 'spm' else 'psm' end as form
            from h
        ), p as (
            select doc_id, n, t, form, array_to_string(u[:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:], '') as suf from c
        )
        select doc_id, n::bigint as n, form,
               case when form <> 'plain' then length(pre)::bigint end as prefix_chars, case when form <> 'plain' then length(mid)::bigint end as middle_chars,
               sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
                      else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
               sha256(t) as restored_sha256
        from p
    """,
    "op12_url_filter": f"""
        with u as (
            select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages
        ), s as (
            select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
            from u
        ), r as (
            select *, case
                when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
                when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
                when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
                when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
                when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule
            from s
        ), listed as (
            select unnest({[x[:-1] for x in LISTED_SITES]}) as site
        )
        select page_id, host, path, rule, site || '/' as listed,
               case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null or site is not null then 'block' else 'allow' end as verdict
        from r left join listed on r.host = site or ends_with(r.host, '.' || site)
    """,
    "op13_collocations": r"""
        with pieces as (
            select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
            from documents
        ), worded as (
            select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
        ), grams as (
            select lang, words, unnest(list_transform(range(1, len(w) - words + 2), lambda i: array_to_string(w[i:i + words - 1], ' '))) as phrase
            from worded, (select unnest([1, 2, 3, 4]) as words)
        ), f as (
            select lang, phrase, words, count(*) as f from grams group by all
        ), totals as (
            select lang, sum(f)::bigint as n from f where words = 1 group by lang
        ), candidates as (
            select lang, phrase, words, f as a, string_split(phrase, ' ') as w from f where words > 1 and f >= 30
        ), inner_ as (
            select c.lang, array_to_string(c.w[i:i + k - 1], ' ') as phrase, max(c.a) as over
            from candidates c, (select unnest([2, 3]) as k), (select unnest([1, 2, 3]) as i) where k < c.words and i + k - 1 <= c.words
            group by all
        ), cuts as (
            select c.lang, c.phrase, c.a, k, array_to_string(c.w[:k], ' ') as left_, array_to_string(c.w[k + 1:], ' ') as right_
            from candidates c, (select unnest([1, 2, 3]) as k) where k < c.words
        ), scores as (
            select c.lang, c.phrase, c.a, x.f as l, y.f as r, (2000000::hugeint * c.a // (x.f + y.f))::bigint as score,
                   row_number() over (partition by c.lang, c.phrase order by 2000000::hugeint * c.a // (x.f + y.f), k) as best
            from cuts c join f x on x.lang = c.lang and x.phrase = c.left_ join f y on y.lang = c.lang and y.phrase = c.right_
        ), ranked as (
            select s.lang, row_number() over (partition by s.lang order by score desc, a desc, encode(s.phrase)) as rank, s.phrase, a, l, r, n, score
            from scores s join totals t on t.lang = s.lang left join inner_ i on i.lang = s.lang and i.phrase = s.phrase
            where best = 1 and (over is null or 100 * over < 80 * a)
        )
        select * from ranked where rank <= 2000
    """,
    "op8_mixing": r"""
        with recursive sized as (
            select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents
        ), sources as (
            select source, sum(size)::bigint as source_size,
                   [1.0, 2.0, 3.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight
            from sized group by source
        ), ranked as (
            select *, sum(source_size) over ()::double as total,
                   sum(3.0 * source_size) over f - 3.0 * source_size as before,
                   sum(weight) over () - (sum(weight) over f - weight) as weight_left
            from sources window f as (order by source_size / weight, source nulls last rows unbounded preceding)
        ), level as (
            select min(before) as before, max(weight_left) as weight_left
            from ranked where (total - before) / weight_left * weight <= 3.0 * source_size
        ), targets as (
            select r.source, r.source_size,
                   least(3.0 * r.source_size, case when l.before is null or r.before < l.before then 3.0 * r.source_size
                        else (r.total - l.before) * r.weight / l.weight_left end)::double as target
            from ranked r, level l
        ), rated as (
            select s.doc_id, s.size, t.source_size, t.target,
                   case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
                   ('0x' || substr(md5(coalesce(s.doc_id::varchar, 'null') || ':42'), 1, 13))::bigint / 4503599627370496.0 as u
            from sized s join targets t on s.source is not distinct from t.source
        )
        select doc_id, size::bigint as size, source_size, target,
               (size * (floor(rate) + (u < rate - floor(rate))::int))::bigint as taken,
               (floor(rate) + (u < rate - floor(rate))::int)::bigint as copies
        from rated
    """,
}
