"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import token_output

    return token_output(common.documents(spark, sf_dir), vocabulary_path())


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_counts

    return mix_counts(common.documents(spark, sf_dir))


QUERIES = {"op3_token_ids": op3_token_ids, "op10_mix": op10_mix}
ORACLES: dict[str, str] = {}


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify, train

    docs = common.documents(spark, sf_dir)
    scored = classify(docs, train(docs, common.labels(spark, sf_dir)))
    return scored.select("doc_id", (common.fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


QUERIES["op9_quality"] = op9_quality


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify, train

    docs = common.documents(spark, sf_dir)
    scored = classify(docs, train(docs, common.labels(spark, sf_dir)))
    return scored.select("doc_id", (common.fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


QUERIES["op2_toxicity"] = op2_toxicity


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, train

    docs = common.documents(spark, sf_dir)
    found = identify(docs, train(docs))
    return found.select("doc_id", (common.fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES["op8_language"] = op8_language


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decision_list import judge, learn, statistics

    stats = common.written(statistics(common.documents(spark, sf_dir)), "rule-statistics")
    return judge(stats, learn(stats, common.labels(spark, sf_dir)))


QUERIES["op5_rules"] = op5_rules


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score

    return score(common.documents(spark, sf_dir))


QUERIES["op1_context_tree"] = op1_context_tree


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(common.documents(spark, sf_dir), common.benchmark(spark, sf_dir))


QUERIES["op4_decontamination"] = op4_decontamination


def op6_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicate_classes

    return near_duplicate_classes(common.documents(spark, sf_dir))


QUERIES["op6_weighted_minhash"] = op6_weighted_minhash


def op7_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(common.documents(spark, sf_dir))


QUERIES["op7_prefix_free_parsing"] = op7_prefix_free_parsing


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_components

    return near_components(common.documents(spark, sf_dir))


QUERIES["op11_simhash"] = op11_simhash


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import run_digests

    docs = common.documents(spark, sf_dir)
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    words = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({common.WORD})"))).alias("w"))
    n = F.size("w").cast("long")
    shaped = words.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    shaped = shaped.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    repeated = F.expr("concat_ws(' ', transform(sequence(0L, n - 1), i -> get(w, cast(if(i < a, i, a + (i - a) % p) as int))))")
    found = run_digests(shaped.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text")))
    return found.select("doc_id", *[c for c in found.columns if c not in ("doc_id", "n_words")], "n_words")


QUERIES["op12_periodic_runs"] = op12_periodic_runs


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(common.documents(spark, sf_dir))


QUERIES["op13_collocations"] = op13_collocations
ORACLES["op13_collocations"] = r"""
with pieces as (
  select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
words as (
  select piece_no, lang, unnest(w) w1, generate_subscripts(w, 1) i
  from (select row_number() over () piece_no, lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') w from pieces)),
spots as (select lang, w1, lead(w1) over spot w2, lead(w1, 2) over spot w3 from words window spot as (partition by piece_no order by i)),
grams as materialized (
  select lang, w1 phrase, 1 size, count(*) f from spots group by 1, 2
  union all select lang, w1 || ' ' || w2, 2, count(*) from spots where w2 is not null group by 1, 2
  union all select lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) from spots where w3 is not null group by 1, 2),
cand as materialized (select lang, phrase, size, f a, string_split(phrase, ' ') w from grams where size > 1 and f >= 10),
cuts as materialized (
  select lang, phrase, size, a, 1 k, w[1] part, array_to_string(w[2:], ' ') rest from cand
  union all select lang, phrase, size, a, 2, w[1] || ' ' || w[2], w[3] from cand where size = 3),
parts as materialized (select lang, phrase, f from grams where size < 3 and f >= 10),
scored as (
  select c.lang, c.phrase, c.size, c.a, k, l.f l, r.f r, (1000000::hugeint * c.a * c.a) // (l.f::hugeint * r.f) score
  from cuts c join parts l on l.lang = c.lang and l.phrase = c.part join parts r on r.lang = c.lang and r.phrase = c.rest),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (
  select lang, part phrase, max(a) longer from (
    select lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) part from cand where size = 3) group by 1, 2),
kept as (
  select c.* from lowest c left join inside i on i.lang = c.lang and i.phrase = c.phrase and c.size = 2
  where i.longer is null or 100 * i.longer < 50 * c.a),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from kept qualify rank <= 2000)
select lang, rank::bigint rank, phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score
from ranked join (select lang, sum(f) n from grams where size = 1 group by 1) using (lang)
"""
