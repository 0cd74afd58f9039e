"""Quality rules (9): base counts and distribution divergence, in DataFrame functions only.

Two histograms of a document, one over character classes and one over common words of the corpus
languages, are compared with the references of its language by Jensen-Shannon distance (base 2,
0 to 1). A language's reference is the sum of the histograms of all its documents that pass the
base rule and the length guard. A document under ``min_words`` words, or of a language whose
reference has under ``min_reference`` words, is not judged by the method.

Everything about one document is computed inside its row (split words, 64-bit window hashes, sorted
arrays); only the histograms' sums are shuffled. Windows are compared by 64-bit hash.

Defined edge cases: null or empty text has no words and fails the base rule; a null language is a
language of its own; repeated rows are judged one by one; an empty table gives no rows; extra
columns are ignored by ``assess`` and kept by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.llm.common import WORD_GAP, cut

#: Common words of the corpus languages.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "are", "with", "this"),
    "de": ("der", "die", "und", "das", "den", "ist", "mit", "von", "auf", "nicht", "im", "dem"),
    "fr": ("le", "la", "et", "les", "des", "du", "un", "une", "est", "pour", "que", "en"),
    "es": ("el", "los", "y", "las", "del", "por", "con", "para", "se", "no", "de", "al"),
}
VOCABULARY = tuple(dict.fromkeys(w for words in COMMON_WORDS.values() for w in words))
N_CLASSES = 5  # lower case, upper case, digits, sentence marks, other


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """Base counts and both histograms, one row a document; ``keep`` names further columns to pass on."""
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep
    )
    quoted = ", ".join(f"'{w}'" for w in VOCABULARY)
    step = (
        base.withColumn("words", F.array_remove(F.split("text", WORD_GAP), ""))
        .withColumn("hashes", F.expr("transform(words, w -> xxhash64(w))"))
        .withColumn("common", F.expr(f"filter(words, w -> w IN ({quoted}))"))
        .withColumn("solid", F.array_join("words", ""))
        .withColumn("lines", F.expr(r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
        .withColumn("n_symbols", F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("n_words", F.size("words").cast("long"))
        .drop("text", "words")
    )
    step = (
        step.withColumn("windows", F.expr("if(n_words >= 8, transform(sequence(0, n_words - 8), i -> xxhash64(" + ", ".join(f"hashes[int(i) + {k}]" for k in range(8)) + ")), cast(array() as array<bigint>))"))
        .withColumn("word_chars", F.length("solid").cast("long"))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .withColumn("not_lower", F.regexp_replace("solid", r"\p{Ll}+", ""))
        .withColumn("counts", F.array(*[F.size("common") - F.size(F.array_remove("common", w)) for w in VOCABULARY]))
        .withColumn("n_common", F.size("common"))
        .drop("hashes", "lines", "solid", "common")
    )
    step = step.withColumn("not_letter", F.regexp_replace("not_lower", r"\p{Lu}+", "")).withColumn("twice", F.size(F.array_distinct("windows")) < F.size("windows"))
    # Windows with their places, equal ones side by side; only where some window is there twice.
    step = step.withColumn("placed", F.expr("if(twice, array_sort(transform(windows, (h, i) -> struct(h, bigint(i) AS p))), cast(array() as array<struct<h: bigint, p: bigint>>))"))
    step = step.withColumn(
        "starts", F.expr("sort_array(transform(filter(placed, (x, j) -> coalesce(x.h = get(placed, j - 1).h, false) or coalesce(x.h = get(placed, j + 1).h, false)), x -> x.p))")
    )
    repeat = "aggregate(transform(starts, (p, j) -> least(8L, coalesce(get(starts, j + 1), p + 8) - p)), 0L, (a, x) -> a + x)"
    digits, marks = F.regexp_count("not_letter", F.lit("[0-9]")), F.regexp_count("not_letter", F.lit(r"""[.,;:!?'"()-]"""))
    classes = F.array(
        F.col("word_chars") - F.length("not_lower"), F.length("not_lower") - F.length("not_letter"), digits.cast("long"), marks.cast("long"), (F.length("not_letter") - digits - marks).cast("long")
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        step.withColumn("n_repeat_words", F.expr(repeat))
        .withColumn("class_counts", classes)
        .withColumn("word_counts", F.concat("counts", F.array(F.col("n_words") - F.col("n_common"))))
        .withColumn("base_failed", failed)
        .select("doc_id", "lang", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_counts", "word_counts")
    )


def references(measured: DataFrame, min_words: int) -> DataFrame:
    """(ref_lang, class_ref, word_ref, their totals, ref_words): each language's histograms, in millionths summed over
    its documents, so that a long document weighs as much as a short one and sums are exact."""
    share = lambda name, k, total: F.sum(F.expr(f"bigint(round(1000000 * {name}[{k}] / {total}))"))
    good = measured.where(~F.col("base_failed") & (F.col("n_words") >= min_words))
    sums = good.groupBy(F.col("lang").alias("ref_lang")).agg(
        F.array(*[share("class_counts", k, "word_chars") for k in range(N_CLASSES)]).alias("class_ref"),
        F.array(*[share("word_counts", k, "n_words") for k in range(len(VOCABULARY) + 1)]).alias("word_ref"),
        F.sum("n_words").alias("ref_words"),
    )
    total = lambda name: F.expr(f"aggregate({name}, 0L, (s, x) -> s + x)")
    return sums.withColumn("class_total", total("class_ref")).withColumn("word_total", total("word_ref"))


def js_distance(left: str, left_total: str, right: str, right_total: str) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of counts with known totals; null where one is empty."""
    shares = f"zip_with({left}, {right}, (x, y) -> struct(x / nullif({left_total}, 0) AS p, y / nullif({right_total}, 0) AS q))"
    part = "if(v.p > 0, v.p * log2(2 * v.p / (v.p + v.q)), 0D) + if(v.q > 0, v.q * log2(2 * v.q / (v.p + v.q)), 0D)"
    return F.expr(f"sqrt(greatest(0D, aggregate({shares}, 0D, (s, v) -> s + {part}) / 2))")


#: Languages whose references are broadcast (under 1 KB each); more are joined by shuffle.
MOST_LANGUAGES = 1000


def few_languages(rows: DataFrame) -> DataFrame:
    """Written rows of one a language, marked for broadcast if their count allows it."""
    written = cut(rows, "quality_refs")
    return F.broadcast(written) if written.count() <= MOST_LANGUAGES else written


def typical_limits(first: DataFrame, typical: float) -> DataFrame:
    """(limit_lang, class_limit): ``typical`` times each language's median class distance, by thousandths."""
    counts = first.where("class_js is not null").groupBy("lang", F.floor(F.col("class_js") * 1000).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto, all_bins = Window.partitionBy("lang").orderBy("bin"), Window.partitionBy("lang")
    half = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(all_bins)).where("2 * upto >= total")
    return half.groupBy(F.col("lang").alias("limit_lang")).agg((F.lit(typical / 1000) * (F.min("bin") + 1)).alias("class_limit"))


def compared(measured: DataFrame, refs: DataFrame, min_words: int, min_reference: int) -> DataFrame:
    """Adds class_js and word_js; null where a guard applies."""
    refs = few_languages(refs)
    joined = measured.join(refs, measured["lang"] == refs["ref_lang"], "left")
    judged = (F.col("n_words") >= min_words) & (F.col("ref_words") >= min_reference)
    joined = joined.withColumn("class_js", F.when(judged, js_distance("class_counts", "word_chars", "class_ref", "class_total")))
    joined = joined.withColumn("word_js", F.when(judged, js_distance("word_counts", "n_words", "word_ref", "word_total")))
    return joined.drop("ref_lang", "class_ref", "word_ref", "class_total", "word_total", "ref_words")


def judge(
    measured: DataFrame,
    min_words: int = 40,
    min_reference: int = 2000,
    class_limit: tuple[float, float] = (0.09, 1.25),
    word_limit: tuple[float, float] = (0.3, 0.9),
    typical: float = 1.3,
) -> DataFrame:
    """Adds class_js, word_js and kept to measured rows.

    A limit (a, b) is a + b / sqrt(n_words): short texts scatter more. References are taken twice; the
    second time only from documents whose class distance is within ``typical`` times the language's median.
    """
    first = compared(measured, references(measured, min_words), min_words, min_reference)
    limits = few_languages(typical_limits(first, typical))
    usual = first.join(limits, first["lang"] == limits["limit_lang"]).where("class_js <= class_limit")
    found = compared(measured, references(usual, min_words), min_words, min_reference)
    limit = lambda ab: F.lit(ab[0]) + F.lit(ab[1]) / F.sqrt("n_words")
    fine = F.coalesce((F.col("class_js") <= limit(class_limit)) & (F.col("word_js") <= limit(word_limit)), F.lit(True))
    return found.withColumn("kept", ~F.col("base_failed") & fine).drop("class_counts", "word_counts")


def assess(docs: DataFrame, **limits) -> DataFrame:
    """One row a document: counts, base_failed, distances and kept."""
    return judge(cut(measure(docs), "quality"), **limits)


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The documents that ``assess`` keeps, all columns."""
    tagged = docs.select("*", F.struct("*").alias("__row"))
    measured = cut(measure(tagged, "__row"), "quality_docs")
    return judge(measured, **limits).where("kept").select("__row.*")


_CATEGORIES = ", ".join(f"'{w}'" for w in VOCABULARY)


def _distances(refs: str) -> str:
    """SQL of each judged document's two distances to the references named ``refs``."""
    part = "CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END"
    return f"""
  SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN kind = 0 THEN {part} END) / 2)) AS class_js, sqrt(greatest(0, sum(CASE WHEN kind = 1 THEN {part} END) / 2)) AS word_js
  FROM (SELECT c.doc_id, c.kind, c.n / c.total AS p, r.r / sum(r.r) OVER (PARTITION BY c.doc_id, c.kind) AS q
        FROM cells c JOIN {refs} r ON c.lang = r.lang AND c.kind = r.kind AND c.cat = r.cat WHERE c.n_words >= 40 AND r.ref_words >= 2000)
  GROUP BY doc_id"""


def _references(rows: str) -> str:
    """SQL of the references over the documents of ``rows``."""
    return f"""
  SELECT lang, kind, cat, CAST(sum(CAST(round(1000000 * n / total) AS BIGINT)) AS DOUBLE) AS r, sum(n_words) AS ref_words
  FROM cells WHERE NOT base_failed AND n_words >= 40 AND doc_id IN ({rows}) GROUP BY lang, kind, cat"""


ORACLE = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS p FROM w),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, words[p:p + 7]) AS c FROM starts) WHERE c > 1),
covered AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT doc_id, least(8, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p, 8)) AS n FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (SELECT w.doc_id, lang, words, array_to_string(words, '') AS solid, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
           len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
           len(words) < 20 OR 100 * coalesce(c.n, 0) > 30 * len(words) AS base_failed
         FROM w LEFT JOIN covered c USING (doc_id) LEFT JOIN lines l USING (doc_id)),
rest AS (SELECT *, regexp_replace(solid, '\p{{Ll}}+', '', 'g') AS a FROM base),
peeled AS (SELECT *, regexp_replace(a, '\p{{Lu}}+', '', 'g') AS b FROM rest),
marks AS (SELECT *, len(regexp_extract_all(b, '[0-9]')) AS digits, len(regexp_extract_all(b, '[.,;:!?''"()-]')) AS marks FROM peeled),
classes AS (SELECT doc_id, unnest([0, 1, 2, 3, 4]) AS cat, unnest([word_chars - length(a), length(a) - length(b), digits, marks, length(b) - digits - marks]) AS n FROM marks),
common AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM w) WHERE word IN ({_CATEGORIES}) GROUP BY ALL),
every AS (SELECT doc_id, unnest([{_CATEGORIES}]) AS word FROM base),
cells AS (
  SELECT doc_id, lang, n_words, base_failed, 0 AS kind, CAST(cat AS VARCHAR) AS cat, n, word_chars AS total FROM classes JOIN base USING (doc_id)
  UNION ALL SELECT e.doc_id, lang, n_words, base_failed, 1, e.word, coalesce(c.n, 0), n_words FROM every e JOIN base USING (doc_id) LEFT JOIN common c ON c.doc_id = e.doc_id AND c.word = e.word
  UNION ALL SELECT b.doc_id, lang, n_words, base_failed, 1, '', n_words - coalesce((SELECT sum(n) FROM common c WHERE c.doc_id = b.doc_id), 0), n_words FROM base b),
refs1 AS ({_references("SELECT doc_id FROM base")}),
js1 AS ({_distances("refs1")}),
bins AS (SELECT lang, floor(class_js * 1000) AS bin, count(*) AS n FROM js1 JOIN base USING (doc_id) GROUP BY ALL),
halves AS (SELECT lang, bin, sum(n) OVER (PARTITION BY lang ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang) AS total FROM bins),
limits AS (SELECT lang, 0.0013::DOUBLE * (min(bin) + 1) AS most FROM halves WHERE 2 * upto >= total GROUP BY lang),
refs2 AS ({_references("SELECT doc_id FROM js1 JOIN base USING (doc_id) JOIN limits USING (lang) WHERE class_js <= most")}),
js2 AS ({_distances("refs2")})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(class_js <= 0.09 + 1.25 / sqrt(n_words) AND word_js <= 0.3 + 0.9 / sqrt(n_words), true) AS kept
FROM base LEFT JOIN js2 USING (doc_id)
"""
