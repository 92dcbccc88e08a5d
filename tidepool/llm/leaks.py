"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

1. ``build_index`` stores the postings of the test terms: term, document, position, in the files of the tasks that read the
   documents, so the index is dealt by document and nothing is shuffled. A posting also holds signatures (16 bits) of the words
   before and behind it.
2. Each phrase is looked up from its rarest term, as counted over all documents. Its postings, moved back by the term's offset,
   are the phrase's possible beginnings; neighbours' signatures that don't fit drop out while the list is read.
3. The lists of the other terms, moved back by their offsets, are intersected with these beginnings, in the documents that have
   any. What is in all lists is an exact match (signatures only thin out).
4. ``near_matches`` intersects the same lists within a distance: places where all of a phrase's terms lie within so many words,
   in any order.

Terms, plans and candidates are broadcast up to ``FEW`` rows; more are joined by shuffles. A frequent word is one posting a row
and is looked up only if a phrase has no rarer one.

Edge cases: null and empty texts have no words; nor do texts without letters or digits. Items without words have no phrase;
items of fewer words than a window are one phrase. Repeated documents (equal id and text) share their postings and each gets
the same row. Items with one id are one item; an item with a null id hits words but is neither counted nor listed. Very long
texts are one array of words in the task that reads them. Other columns are not read. No documents give no rows; no items, no hits.
Documents are known by 128 bits of hash of id and text, phrases by 128 bits of hash of their words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import FEW, Staging, documents

#: A word after A-Z have been lowered, and what lies between words before that (fixed values).
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SIZE = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["k1", "k2"]


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def pieces(text: Column) -> Column:
    """The words of a text, with an empty string before or behind them where it begins or ends with other characters (splitting
    costs a quarter of extracting)."""
    return F.split(lowered(F.coalesce(text, F.lit(""))), BETWEEN)


def words(text: Column) -> Column:
    return F.array_remove(pieces(text), "")


def word_count(text: Column) -> Column:
    cut = F.split(F.coalesce(text, F.lit("")), BETWEEN)
    return (F.size(cut) - F.when(F.get(cut, F.lit(0)) == "", 1).otherwise(0) - F.when((F.size(cut) > 1) & (F.element_at(cut, -1) == ""), 1).otherwise(0)).cast("long")


def _key(id_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(F.lit(1), text_col, id_col).alias("k2")]


def _signed(array: str, at: Column) -> Column:
    """16 bits of the word at a place of an array; -1 where there is none."""
    word = F.nullif(F.get(array, at), F.lit(""))
    return F.when(word.isNull(), -1).otherwise(F.pmod(F.hash(word), F.lit(1 << 16)))


def _small(df: DataFrame) -> bool:
    """Whether a narrow table may be broadcast."""
    return df.limit(FEW + 1).count() <= FEW


def _meet(df: DataFrame, other: DataFrame, on, how: str = "inner", small: bool | None = None) -> DataFrame:
    small = _small(other) if small is None else small
    return df.join(other.hint("broadcast" if small else "merge"), on, how)


def phrases(staging: Staging, items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """phrase and words (distinct windows of the items), and phrase and item (which items have them), as tables."""
    each = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("_w")).where(F.size("_w") > 0)
    cut = each.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - size + 1, F.lit(1))), lambda i: F.slice("_w", i, size))).alias("words"))
    whole = staging.put(cut.select(F.md5(F.concat_ws(" ", "words")).alias("phrase"), "item", "words"), "windows")
    return staging.put(whole.dropDuplicates(["phrase"]).select("phrase", "words"), "phrases"), staging.put(whole.select("phrase", "item").distinct(), "items")


@dataclass
class Index:
    """postings: k1, k2 (document), term, pos (from 0), before, behind (signatures)."""

    staging: Staging
    postings: DataFrame

    def terms_of(self, found: DataFrame) -> DataFrame:
        """phrase, length, offset, term, n (postings of the term) of phrases all of whose terms have postings."""
        terms = found.select("phrase", F.size("words").alias("length"), F.posexplode("words").alias("offset", "term"))
        counted = terms.join(self.postings.groupBy("term").agg(F.count("*").alias("n")), "term")
        return counted.withColumn("_have", F.count("*").over(W.partitionBy("phrase"))).where("_have = length").drop("_have")

    def exact_matches(self, found: DataFrame) -> DataFrame:
        """found: phrase, words. k1, k2, phrase, start (from 0) and length of each exact match, as a table."""
        terms = self.staging.put(self.terms_of(found), "terms")
        rarest = terms.groupBy("phrase").agg(F.min(F.struct("n", "offset", "term")).alias("r")).select("phrase", "r.offset", "r.term")
        side = lambda step: F.when((F.col("offset") + step).between(0, F.size("words") - 1), _signed("words", F.col("offset") + step))
        plan = self.staging.put(rarest.join(found, "phrase").select("phrase", "term", "offset", F.size("words").alias("length"), side(-1).alias("_before"), side(1).alias("_behind")), "plan")
        fits = (F.col("pos") >= F.col("offset")) & F.coalesce(F.col("before") == F.col("_before"), F.lit(True)) & F.coalesce(F.col("behind") == F.col("_behind"), F.lit(True))
        begun = _meet(self.postings, plan, "term").where(fits).select(*_KEY, "phrase", (F.col("pos") - F.col("offset")).alias("start"), "length", F.col("offset").alias("_known"))
        begun = self.staging.put(begun.distinct(), "beginnings")

        small = _small(begun)
        lists = self.in_documents(begun.select(*_KEY).distinct(), small).select(*_KEY, "pos", "term")
        wanted = _meet(begun, terms.select("phrase", "offset", "term"), "phrase").where("offset <> _known")
        wanted = wanted.select(*_KEY, "phrase", "start", "length", (F.col("start") + F.col("offset")).alias("pos"), "term")
        met = wanted.join(lists.distinct(), [*_KEY, "pos", "term"])
        others = met.groupBy(*_KEY, "phrase", "start", "length").agg(F.count("*").alias("_n")).where("_n = length - 1").drop("_n")
        out = self.staging.put(others.union(begun.where("length = 1").select(others.columns)), "matches")
        self.staging.drop(terms, plan, begun)
        return out

    def in_documents(self, keys: DataFrame, small: bool) -> DataFrame:
        """The postings of some documents."""
        return _meet(self.postings, keys, _KEY, "left_semi", small)

    def near_matches(self, found: DataFrame, within: int) -> DataFrame:
        """k1, k2, phrase, start and length of each shortest place where all distinct terms of a phrase lie within so many words.

        A place begins at the last posting of one term that has all others behind it within reach; it is known by its first word.
        """
        terms = self.staging.put(self.terms_of(found).groupBy("phrase", "term").agg(F.min("n").alias("n")), "terms")
        rarest = terms.groupBy("phrase").agg(F.min_by("term", F.struct("n", "term")).alias("rare"), F.count("*").alias("_terms"))
        span = lambda c: F.expr(f"{c} div {within}")
        heart = _meet(self.postings, rarest.withColumnRenamed("rare", "term"), "term").select(*_KEY, "phrase", "_terms", F.col("pos").alias("_at"))
        heart = self.staging.put(heart.distinct(), "hearts")
        lists = self.in_documents(heart.select(*_KEY).distinct(), _small(heart)).select(*_KEY, "pos", "term").distinct()
        around = heart.withColumn("_cell", F.explode(F.sequence(span("_at") - 1, span("_at") + 1)))
        around = _meet(around, terms.select("phrase", "term"), "phrase")
        close = around.join(lists.withColumn("_cell", span("pos")), [*_KEY, "_cell", "term"]).where(F.abs(F.col("pos") - F.col("_at")) < within)
        # from each first word on: the nearest posting of every term; all of them within reach of it
        by_heart = close.groupBy(*_KEY, "phrase", "_terms", "_at").agg(F.array_sort(F.collect_set(F.struct("pos", "term"))).alias("_l"))  # 2 * within entries at most
        first = by_heart.withColumn("_first", F.explode("_l"))
        reach = F.filter("_l", lambda x: (x["pos"] >= F.col("_first.pos")) & (x["pos"] < F.col("_first.pos") + within))
        nearest = F.aggregate(reach, F.struct(F.array().cast("array<string>").alias("seen"), F.lit(-1).alias("last")), lambda a, x: F.when(F.array_contains(a["seen"], x["term"]), a).otherwise(F.struct(F.array_append(a["seen"], x["term"]).alias("seen"), x["pos"].alias("last"))))
        whole = first.withColumn("_r", nearest).where(F.size("_r.seen") == F.col("_terms")).select(*_KEY, "phrase", F.col("_first.pos").alias("start"), (F.col("_r.last") - F.col("_first.pos") + 1).alias("length"))
        # shortest: no other place lies inside it
        order = W.partitionBy(*_KEY, "phrase").orderBy("start")
        ended = whole.distinct().withColumn("_next", F.lead(F.col("start") + F.col("length")).over(order))
        out = self.staging.put(ended.where("_next IS NULL OR _next > start + length").drop("_next"), "near")
        self.staging.drop(terms, heart)
        return out


def build_index(staging: Staging, docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """terms: term (distinct). The postings of these terms over all documents, written once."""
    tokens = docs.select(*_key(id_col, text_col), pieces(F.col(text_col)).alias("_w")).select(*_KEY, "_w", F.posexplode("_w").alias("_at", "term"))
    known = _meet(tokens, terms, "term")
    at, skipped = F.col("_at"), F.when(F.get("_w", F.lit(0)) == "", 1).otherwise(0)
    return Index(staging, staging.put(known.select(*_KEY, "term", (at - skipped).alias("pos"), _signed("_w", at - 1).alias("before"), _signed("_w", at + 1).alias("behind")), "postings"))


def covered(matches: DataFrame) -> DataFrame:
    """k1, k2 and n_hit, the words that matches of a document cover, overlaps once."""
    longest = matches.groupBy(*_KEY, "start").agg(F.max(F.col("start") + F.col("length")).alias("_end"))
    before = W.partitionBy(*_KEY).orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    new = F.greatest(F.col("_end") - F.greatest(F.col("start"), F.coalesce(F.max("_end").over(before), F.lit(0))), F.lit(0))
    return longest.withColumn("_new", new).groupBy(*_KEY).agg(F.sum("_new").alias("n_hit"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = SIZE) -> DataFrame:
    """id, n_words, n_hit (words inside an exact match), items (array of the ids with matches, as strings in order) of every row."""
    staging = Staging(docs.sparkSession)
    found, has = phrases(staging, items, item_col, item_text, size)
    terms = staging.put(found.select(F.explode("words").alias("term")).distinct(), "vocabulary")
    index = build_index(staging, docs, terms, id_col, text_col)
    matches = index.exact_matches(found)
    of = _meet(matches.select(*_KEY, "phrase").distinct(), has.where("item IS NOT NULL"), "phrase").select(*_KEY, F.col("item").cast("string").alias("item")).distinct()
    listed = of.groupBy(*_KEY).agg(F.array_sort(F.collect_list("item")).alias("items"))  # as many as there are items, at most
    hits = staging.put(covered(matches).join(listed, _KEY, "left"), "hits")
    staging.drop_all_but(hits)
    rows = docs.select(F.col(id_col).alias("_id"), *_key(id_col, text_col), word_count(F.col(text_col)).alias("n_words"))
    out = _meet(rows, hits, _KEY, "left")
    return out.select(F.col("_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op12_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return made.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TOKEN}')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - {SIZE - 1}, 1) + 1)) AS i FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
p AS (SELECT item_id, array_to_string(w[i:i + {SIZE - 1}], ' ') AS g, len(w[i:i + {SIZE - 1}]) AS n FROM b),
g AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM p))),
h AS (SELECT DISTINCT r, s, n, item_id FROM g JOIN p USING (g, n)),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS x FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)
"""
