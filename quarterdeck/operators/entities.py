"""Entities in texts and in searches, by inverted indexes: equi-joins find candidates, the rule itself decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import once
from ..storage import kept
from .validation import enough_tokens, entity_text, entity_words, mentions, name_tokens

#: Characters of a gram; shorter strings are grams of their own length.
GRAM = 3
#: Buckets of hashes by which rows that meet nothing are dropped before a join.
BUCKETS = 1 << 16


def _sieved(rows: DataFrame, c: str, wanted: DataFrame) -> DataFrame:
    """Rows but those whose c no row of wanted has, as far as the bucket of its hash shows; a bounded number is broadcast."""
    bucket = F.pmod(F.xxhash64(c), F.lit(BUCKETS)).alias("\x01bucket")
    return rows.select("*", bucket).join(F.broadcast(wanted.select(bucket).distinct()), "\x01bucket", "left_semi").drop("\x01bucket")


def _grams(text: Column, size: int) -> Column:
    """Distinct stretches of size characters."""
    last = F.length(text) - size + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def _all_grams(text: Column) -> Column:
    out = _grams(text, 1)
    for size in range(2, GRAM + 1):
        out = F.concat(out, _grams(text, size))
    return F.array_distinct(out)


def _part_grams(parts: DataFrame, part: str) -> DataFrame:
    of = F.coalesce(F.nullif(F.size(_grams(F.col(part), GRAM)), F.lit(0)), F.lit(-1))
    grams = F.when(of > 0, _grams(F.col(part), GRAM)).otherwise(F.array(part))
    return parts.select(part).distinct().select(part, F.explode(grams).alias("gram"))


def _keys(grams: DataFrame, part: str, counts: DataFrame) -> DataFrame:
    """(part, gram): of each distinct part its gram that stands in the fewest indexed strings."""
    known = grams.hint("merge").join(counts.hint("merge"), "gram", "left")
    return known.groupBy(part).agg(F.min(F.struct(F.coalesce("\x01uses", F.lit(0)).alias("uses"), "gram"))["gram"].alias("gram"))


def contained(inner: DataFrame, part: str, outer: DataFrame, whole: str) -> DataFrame:
    """Distinct (part, whole) of all strings of inner that lie in a string of outer; neither may be empty.

    An index of the grams of outer that inner may have is joined with the rarest gram of each string of inner, and what they
    share is tested.
    """
    grams = _part_grams(inner, part)
    index = _sieved(outer.select(whole).distinct().select(whole, F.explode(_all_grams(F.col(whole))).alias("gram")), "gram", grams)
    counts = index.groupBy("gram").agg(F.count(F.lit(1)).alias("\x01uses"))
    pairs = _keys(grams, part, counts).hint("merge").join(index.hint("merge"), "gram")
    return pairs.where(F.col(whole).contains(F.col(part))).select(part, whole).distinct()


def search_entities(registry: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """(q, entity, rank, place): names equal to the query first, then those that hold it or that it holds, then by entity.

    registry: entity, name, aliases, is_active; queries: q.  Blank queries and names find nothing; names and queries of any
    number meet over an index of their grams, never pairwise.
    """
    clean = lambda c: F.lower(F.trim(c))
    every = F.concat(F.array("entity", "name"), F.coalesce("aliases", F.array().cast("array<string>")))
    names = registry.where("is_active").select("entity", F.explode(F.array_distinct(F.transform(every, clean))).alias("n")).where("n <> ''")
    asked = queries.select("q", clean(F.col("q")).alias("k")).where("k <> ''").distinct()
    both = contained(asked, "k", names, "n").unionByName(contained(names, "n", asked, "k")).distinct()
    hits = asked.hint("merge").join(both.hint("merge"), "k").hint("merge").join(names.hint("merge"), "n")
    ranked = hits.groupBy("q", "entity").agg(F.min((F.col("n") != F.col("k")).cast("int")).alias("rank"))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("rank", "entity"))).where(F.col("place") <= limit)


def _anchors(names: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, n): words of which a text that mentions the name n has one at least; names: n.

    All tokens of a name, or a name of three words and more, need one exact word, for which the rarest stands.  A name of
    one or two words may begin or end within words: those are looked up among the vocabulary (word, texts).
    """
    exact = lambda words: names.select("n", F.explode(words).alias("word"))
    words = F.split("n", " ")
    inner = F.when(F.size(words) > 2, F.slice(words, F.lit(2), F.size(words) - 2)).otherwise(F.array().cast("array<string>"))

    def rarest(rows):
        found = rows.hint("merge").join(vocabulary.hint("merge"), "word", "left")
        return found.groupBy("n").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "word"))["word"].alias("word")).select("word", "n")

    whole = names.where(F.length("n") >= 3)
    one = whole.where(F.size(words) == 1)
    lone = contained(one.select(F.col("n").alias("part")), "part", vocabulary, "word")
    short = one.hint("merge").join(lone.withColumnRenamed("part", "n").hint("merge"), "n").select("word", "n")
    two = whole.where(F.size(words) == 2).withColumn("head", F.get(words, F.lit(0)))
    tail = lambda c: F.reverse(F.substring(F.reverse(c), F.lit(1), F.least(F.length(c), F.lit(GRAM))))  # noqa: E731  its last characters
    ends = vocabulary.select("word", F.explode(F.array_distinct(F.array(*[F.reverse(F.substring(F.reverse("word"), 1, k)) for k in range(1, GRAM + 1)]))).alias("tail"))
    pairs = two.withColumn("tail", tail(F.col("head"))).hint("merge").join(ends.hint("merge"), "tail").where(F.col("word").endswith(F.col("head"))).select("word", "n")
    tokens = name_tokens(F.col("n"))
    tokens = F.when(enough_tokens(tokens), tokens).otherwise(F.array().cast("array<string>"))
    return rarest(exact(tokens)).unionByName(rarest(exact(inner))).unionByName(short).unionByName(pairs).distinct()


def match_entity_in_text(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, entity): texts that mention an entity (see validation.mentions); docs: doc_id, text; entities: entity, name.

    Words of texts meet the anchor words of names, and the rule decides on whole texts, once for all entities of a name.  Null
    and blank texts and names match nothing; equal rows of docs give a row each, equal rows of entities one.  Texts are
    read three times: for the vocabulary and the anchors, which are written, and in the plan returned.
    """
    named = entities.select("entity", entity_text(F.col("name")).alias("n")).where("n <> ''").distinct()
    key = F.xxhash64("doc_id", "text").alias("key")  # of two texts of one key each is tested for what either may mention
    words = docs.select(key, F.explode(F.array_distinct(entity_words(F.col("text")))).alias("word"))
    vocabulary = kept(words.groupBy("word").agg(F.count(F.lit(1)).alias("texts")), "entity-vocabulary")
    anchors = kept(_anchors(named.select("n").distinct(), vocabulary), "entity-anchors")
    found = _sieved(words, "word", anchors).hint("merge").join(anchors.hint("merge"), "word")
    some = found.groupBy("key").agg(F.collect_set("n").alias("names"))
    texts = docs.select("doc_id", key, entity_text(F.col("text")).alias("t"))
    tested = once(texts.join(some.hint("shuffle_hash"), "key").select("doc_id", "t", "names"), "hits", F.filter("names", lambda n: mentions(F.col("t"), n)))
    hits = tested.select("doc_id", "hits", F.explode("hits").alias("n"))
    # of the names of an entity that a text mentions the least stands for it
    names = named.groupBy("entity").agg(F.collect_set("n").alias("all")).select("entity", "all", F.explode("all").alias("n"))
    met = hits.hint("merge").join(names.hint("merge"), "n")
    return met.where(F.col("n") == F.array_min(F.array_intersect("hits", "all"))).select("doc_id", "entity")
