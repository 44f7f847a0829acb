"""Queries on many phrases at once, word families and their places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import morphology
from ..functions.text import is_verbatim
from ..operators import phrases
from ..session import table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text")


def _runs(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Distinct runs of n words of the benchmark's items, single blanks between them: a few thousand phrases."""
    words = table(spark, sf_dir, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9]+"), F.lit(0)).alias("w"))
    runs = words.where(F.size("w") >= n).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))).alias("phrase")).distinct()
    return runs.select(F.col("phrase").alias("phrase_id"), "phrase")


def phrase_index_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place in documents of every run of three words of the benchmark."""
    return phrases.phrase_hits(_documents(spark, sf_dir), "doc_id", "text", _runs(spark, sf_dir, 3)).drop("span")


# Words of documents with their places (code points), for DuckDB.
def _words(word: str, gap: str) -> str:
    return rf"""p as (select doc_id, regexp_extract_all(text, '{word}|{gap}') as xs from documents),
u as (select doc_id, unnest(xs) as piece, generate_subscripts(xs, 1) as k from p),
o as (select *, cast(coalesce(sum(length(piece)) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as bigint) as "start" from u),
words as (select doc_id, k, piece as word, "start", "start" + length(piece) as "end", row_number() over (partition by doc_id order by k) as place from o where not regexp_full_match(piece, '{gap}'))"""


_HITS = rf"""with b as (select regexp_extract_all(lower(text), '[a-z0-9]+') as w from benchmark), r as (select distinct unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as phrase from b),
{_words(r'[\pL\pN_]+', r'[^\pL\pN_]+')}, t as (select doc_id, "start", lead("end", 2) over v as "end" from words window v as (partition by doc_id order by place)),
h as (select t.doc_id, t."start", t."end", lower(substr(text, t."start" + 1, t."end" - t."start")) as span from t join documents d on d.doc_id = t.doc_id where t."end" is not null)
select doc_id, phrase as phrase_id, "start", "end" from h join r on span = phrase"""


def morphology_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 300 most frequent word families of documents, with their words."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(morphology.WORD), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    found = words.groupBy(morphology.family(F.col("word")).alias("family")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))
    return found.orderBy(F.desc("n"), "family").limit(300)


def _family_sql(word: str) -> str:
    """The family of a word with Latin letters, for DuckDB."""
    bare = f"string_split(replace(replace(lower(strip_accents({word})), 'ß', 'ss'), '’', ''''), '''')[-1]"
    known = " ".join(f"when regexp_full_match(f, '{stem}({'|'.join(endings.split())})') then '{name}'" for stem, endings, name in morphology.FAMILIES)
    suffix = lambda s: f"when regexp_full_match(f, '.{{4,}}({'|'.join(s.split())})') then regexp_replace(f, '^(.{{4,}})({'|'.join(s.split())})$', '\\1')"
    return f"(select case {known} {suffix(morphology.VERB_SUFFIXES)} {suffix(morphology.NOUN_SUFFIXES)} when regexp_full_match(f, '.{{5,}}[aeio]') then f[:-2] else f end from (select {bare} as f))"


_L = r"[\pL\p{Nl}\p{No}]"
_FAMILIES = rf"""with w as (select unnest(regexp_extract_all(text, '{_L}+(?:''{_L}+)?')) as word from documents), c as (select word, count(*) as n from w group by word)
select family, cast(sum(n) as bigint) as n, count(*) as words from (select {_family_sql('word')} as family, n from c) group by family order by n desc, family limit 300"""

#: Phrases of which any inflection is looked for.
FAMILY_PHRASES = ("Thing Thé", "être AVEC", "énergétique", "the tion", "ander Stadt", "andare", "est onore", "anation")


def morphology_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in documents where words are, by family, those of a phrase; with a check that the span is what the text holds there."""
    listed = spark.createDataFrame([(p, p) for p in FAMILY_PHRASES], "phrase_id string, phrase string")
    docs = _documents(spark, sf_dir)
    hits = phrases.phrase_hits(docs, "doc_id", "text", listed, norm=morphology.family_of_folded, fold=morphology.folded_words, word=morphology.WORD, gap=morphology.GAP, literal=False)
    # a text meets all of its places in one row
    of_text = hits.groupBy("doc_id").agg(F.collect_list(F.struct("phrase_id", "start", "end", "span")).alias("hits")).join(docs.select("doc_id", "text"), "doc_id")
    checked = F.transform("hits", lambda h: h.withField("verbatim", is_verbatim(F.col("text"), h["start"], h["end"], h["span"])))
    return of_text.select("doc_id", F.explode_outer(checked).alias("h")).select("doc_id", "h.*")


_LISTED = " union all ".join(f"select '{p}' as phrase_id, {_family_sql(repr(p.split()[0]))} as a, " + (_family_sql(repr(p.split()[1])) if " " in p else "null") + " as b" for p in FAMILY_PHRASES)
_PLACES = rf"""with {_words(_L + "+(?:''" + _L + "+)?", r'[^\pL\p{Nl}\p{No}]+')}, l as ({_LISTED}), f as (select word, {_family_sql('word')} as family from (select distinct word from words)),
n as (select doc_id, "start", "end", family, lead(family) over v as next_family, lead("end") over v as next_end from words join f using (word) window v as (partition by doc_id order by place)),
h as (select doc_id, phrase_id, "start", case when b is null then "end" else next_end end as "end" from n join l on family = a and (b is null or next_family = b))
select h.doc_id, phrase_id, "start", "end", substr(text, "start" + 1, "end" - "start") as span, true as verbatim from h join documents d on d.doc_id = h.doc_id"""

#: Phrases by domain; a document's language and source open domains.
GATED = (("english", "of the"), ("english", "the"), ("french", "les"), ("french", "est"), ("german", "der"), ("german", "die"), ("spanish", "las"), ("spanish", "que"), ("legal", "MIT License"), ("legal", "rights reserved"))
_DOMAIN = "map('en', 'english', 'fr', 'french', 'de', 'german', 'es', 'spanish')"


def gated_phrase_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of phrases in the documents whose language, or odd source, opens their domain."""
    rules = spark.createDataFrame([(f"{d}:{p}", p, d) for d, p in GATED], "phrase_id string, phrase string, domain string")
    gate = F.array_compact(F.array(F.try_element_at(F.expr(_DOMAIN), F.col("lang")), F.when(F.col("source").rlike("[13579]$"), "legal")))
    return phrases.gated_hits(table(spark, sf_dir, "documents").select("doc_id", "text", gate.alias("gate")), "doc_id", "text", "gate", rules).select("doc_id", "phrase_id", "start", "end", "span")


def _gated_sql(domain: str, phrase: str) -> str:
    opened = "regexp_matches(source, '[13579]$')" if domain == "legal" else f"lang = '{domain[:2].replace('ge', 'de').replace('sp', 'es')}'"
    n = phrase.count(" ")
    return f"""select t.doc_id, '{domain}:{phrase}' as phrase_id, t."start", e{n} as "end", substr(text, t."start" + 1, e{n} - t."start") as span from t join documents d on d.doc_id = t.doc_id where {opened} and lower(substr(text, t."start" + 1, e{n} - t."start")) = '{phrase.lower()}'"""


_GATED_PLACES = rf"""with {_words(r'[\pL\pN_]+', r'[^\pL\pN_]+')}, t as (select doc_id, "start", "end" as e0, lead("end", 1) over v as e1 from words window v as (partition by doc_id order by place)) """ + " union all ".join(_gated_sql(d, p) for d, p in GATED)

QUERIES = {
    "phrase_index_hits": (phrase_index_hits, _HITS), "morphology_families": (morphology_families, _FAMILIES),
    "morphology_places": (morphology_places, _PLACES), "gated_phrase_places": (gated_phrase_places, _GATED_PLACES),
}
