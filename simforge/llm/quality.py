"""Quality rules by distribution divergence, in DataFrame functions alone.

Each document's histogram of character classes and of common words is held
against a reference of each language, the mean histogram of that language's
documents. Jensen-Shannon distance (base 2, so 0 to 1) decides. Short documents
have noisy histograms, so each test has a guard on the document's length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, documents, spaced, words

#: The function words counted, as they stand within a sentence, by language.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "was", "be"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
    "de": ("der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist"),
    "es": ("que", "el", "y", "los", "se", "del", "las", "por", "con", "una", "no", "para"),
}
#: Character classes, each by the pattern of its members; a last bin takes the rest.
CHAR_CLASSES = (SPACE_CLASS, r"[a-z]", r"[A-Z]", r"[^\x00-\x7F]", r"[0-9]", r"[.,;:!?'\"()-]")


@dataclass(frozen=True)
class QualityRules:
    """min_words, most_repeated: the base rules. The distances beyond which a document is rejected, and the lengths from which they apply.

    A text without any common word lies 0.29 to 0.31 from references that hold a
    sixth of common words. word_distance is below that, so that it rejects such texts.
    """

    min_words: int = 50
    most_repeated: float = 0.5
    char_distance: float = 0.31
    char_guard: int = 200
    word_distance: float = 0.28
    word_guard: int = 100
    common_words: dict = field(default_factory=lambda: COMMON_WORDS)

    def vocabulary(self) -> list[str]:
        return sorted({w for ws in self.common_words.values() for w in ws})


def with_char_counts(docs: DataFrame) -> DataFrame:
    """docs (with _text) and _c0, _c1, ..., counts by CHAR_CLASSES and then of all other characters, and _symbols, the characters that are in none of the first two classes.

    Each class is taken out of what the ones before it left, blanks first: the
    letters then stand in long runs, and what they leave is short. What is left is
    a column each time, which more than one expression reads, so that it is worked
    out once and in generated code.
    """
    docs = docs.withColumn("_left0", F.replace(spaced(F.col("_text")), F.lit(" "), F.lit(""))).withColumn("_c0", (F.length("_text") - F.length("_left0")).cast("double"))
    for i, c in enumerate(CHAR_CLASSES[1:], 1):
        docs = docs.withColumn(f"_left{i}", F.regexp_replace(f"_left{i - 1}", f"{c}+", "")).withColumn(f"_c{i}", (F.length(f"_left{i - 1}") - F.length(f"_left{i}")).cast("double"))
    last = len(CHAR_CLASSES)
    docs = docs.withColumn(f"_c{last}", F.length(f"_left{last - 1}").cast("double")).withColumn("_symbols", F.col("_left1"))
    return docs.drop(*[f"_left{i}" for i in range(last)])


def entropy(h: list[float]) -> float:
    return -sum(x * math.log2(x) for x in h if x > 0)


def summed(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def times_log(x: Column) -> Column:
    """x * log2 x, 0 at 0."""
    return x * F.log2(F.greatest(x, F.lit(1e-300)))


def js_distances(p: Column, references: list[list[float]]) -> list[Column]:
    """Jensen-Shannon distance of a column of shares from each of some constant histograms.

    The divergence is the entropy of the mean less the mean of both entropies; the
    mean's is 1 - sum(s * log2 s) / 2, where s is the sum of both shares.
    """
    own = -summed(F.transform(p, times_log))

    def one(e: Column, q: list[float]) -> Column:
        mixed = F.zip_with(p, F.array(*[F.lit(float(x)) for x in q]), lambda a, b: times_log(a + b))
        return F.sqrt(F.greatest(1 - summed(mixed) / 2 - (e + F.lit(entropy(q))) / 2, F.lit(0.0)))

    return [one(own, q) for q in references]


def histograms(docs: DataFrame, rules: QualityRules) -> DataFrame:
    """docs (with _text, _words), with_char_counts, and the columns _ch and _wh, both shares; null where the document is under the guard."""
    vocabulary = rules.vocabulary()
    # Each common word as its number. Sorted with one more of each, numbers stand apart by their counts.
    number = F.array(*[F.lit(w) for w in vocabulary])
    common = F.transform(F.filter("_words", lambda w: w.isin(vocabulary)), lambda w: F.array_position(number, w).cast("int"))
    docs = docs.withColumn("_order", F.sort_array(F.concat(common, F.array(*[F.lit(i + 1) for i in range(len(vocabulary))]))))
    docs = docs.withColumn("_at", F.array(*[F.array_position("_order", F.lit(i + 1)) for i in range(len(vocabulary))], F.size("_order").cast("long") + 1))
    words_of = F.zip_with(F.slice("_at", 1, len(vocabulary)), F.slice("_at", 2, len(vocabulary)), lambda x, y: (y - x - 1).cast("double"))
    docs = docs.withColumn("_wc", F.array_append(words_of, (F.size("_words") + len(vocabulary) - F.size("_order")).cast("double"))).drop("_order", "_at")
    docs = with_char_counts(docs)
    total = F.length("_text")
    docs = docs.withColumn("_ch", F.when(total >= rules.char_guard, F.array(*[F.col(f"_c{i}") / total for i in range(len(CHAR_CLASSES) + 1)])))
    return docs.withColumn("_wh", F.when(F.size("_words") >= rules.word_guard, F.transform("_wc", lambda x: x / F.size("_words")))).drop("_wc")


def language_references(docs: DataFrame, rules: QualityRules = QualityRules()) -> list[tuple[list[float], list[float]]]:
    """Mean character and word histograms of each known language over all of its documents that pass the guards.

    Documents of an unknown or null language form one more group. The result has
    a row for each language of rules.common_words at most, and one for the rest,
    whatever the number of documents. Empty tables give no reference.
    """
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    base = docs.select(F.when(lang.isin(*rules.common_words), lang).otherwise("").alias("_lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    h = histograms(base.withColumn("_words", words(F.col("_text"))), rules)
    n_c, n_w = len(CHAR_CLASSES) + 1, len(rules.vocabulary()) + 1
    bins = F.concat(F.coalesce("_ch", F.array_repeat(F.lit(None).cast("double"), n_c)), F.coalesce("_wh", F.array_repeat(F.lit(None).cast("double"), n_w)))
    means: dict[str, list[float | None]] = {}
    for r in h.select("_lang", F.posexplode(bins).alias("bin", "share")).groupBy("_lang", "bin").agg(F.avg("share").alias("mean")).collect():
        means.setdefault(r["_lang"], [None] * (n_c + n_w))[r["bin"]] = r["mean"]
    return [(m[:n_c], m[n_c:]) for _, m in sorted(means.items()) if None not in m]


def windows(words: Column, of) -> Column:
    """of(word, next word, the one after) for each 3-word window; none in an array of fewer words."""
    n = F.size(words)
    return F.when(n >= 3, F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(1))), lambda w, i: of(w, F.get(words, i + 1), F.get(words, i + 2))))


#: Bits of a number that hold a window's place, and the rest its hash.
PLACE = 20


def with_windows(docs: DataFrame) -> DataFrame:
    """docs (with _words) and _sorted: the hash of each 3-word window and its place in one number, in order. No windows are in fewer words."""
    docs = docs.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.greatest(F.size("_words") - 2, F.lit(0))
    two = F.zip_with(F.slice("_hash", 1, n), F.slice("_hash", 2, n), lambda a, b: F.xxhash64(a, b))
    three = F.zip_with(two, F.slice("_hash", 3, n), lambda a, b: F.xxhash64(a, b))
    keyed = F.transform(three, lambda h, i: h.bitwiseAND(F.lit(-(1 << PLACE))).bitwiseOR(i.cast("long")))
    return docs.withColumn("_keyed", keyed).withColumn("_sorted", F.sort_array("_keyed")).drop("_hash", "_keyed")


def repeated_words() -> Column:
    """Words covered by 3-word windows that stand twice or more in a text (_words, _sorted).

    Neighbours with one hash are compared word for word. Should two different
    windows of a text share a hash, or places not fit, its windows are sorted
    themselves.
    """
    words, keyed = F.col("_words"), F.col("_sorted")
    place = lambda k: k.bitwiseAND((1 << PLACE) - 1).cast("int")
    three = lambda p: F.slice(words, p + 1, 3)
    # Null where hashes differ, else the places of both, none if the windows differ.
    pair = lambda a, b: F.when(F.shiftright(a, PLACE) == F.shiftright(b, PLACE), F.when(three(place(a)) == three(place(b)), F.array(place(a), place(b))).otherwise(F.array().cast("array<int>")))
    n = F.greatest(F.size(keyed) - 1, F.lit(0))
    pairs = F.array_compact(F.zip_with(F.slice(keyed, 1, n), F.slice(keyed, 2, n), pair))
    exact = covered(windows(words, lambda *w: F.concat_ws(" ", *w)))
    found = lambda ps: F.when(F.exists(ps, lambda x: F.size(x) == 0), exact).otherwise(spread(F.sort_array(F.array_distinct(F.flatten(ps)))))
    # The one-element array binds the pairs to a name, so that they are worked out once.
    counted = F.element_at(F.transform(F.array(pairs), lambda ps: F.when(F.size(ps) == 0, 0).otherwise(found(ps))), 1)
    return F.when(F.size(words) > 1 << PLACE, exact).otherwise(counted)


def spread(starts: Column) -> Column:
    """How many words windows of three cover, from their places in order."""
    return F.aggregate(starts, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")))["n"]


def covered(windows: Column) -> Column:
    """Words covered by windows that stand twice or more in the array of all windows."""
    ordered = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))

    def starts(s: Column) -> Column:
        same = F.transform(
            F.sequence(F.lit(1), F.size(s)),
            lambda i: F.when(((i > 1) & (F.try_element_at(s, F.greatest(i - 1, F.lit(1)))["w"] == F.element_at(s, i)["w"])) | ((i < F.size(s)) & (F.try_element_at(s, i + 1)["w"] == F.element_at(s, i)["w"])), F.element_at(s, i)["p"]).otherwise(F.lit(-1)),
        )
        return F.sort_array(F.filter(same, lambda p: p >= 0))

    # The one-element arrays bind a value to a name, so that it is worked out once.
    found = F.element_at(F.transform(F.array(ordered), starts), 1)
    return spread(found)


def quality_rules(docs: DataFrame, rules: QualityRules = QualityRules(), references: list | None = None) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance, base_failed, kept.

    Two passes without any shuffle of documents: the first averages histograms by
    language, the second judges each row by itself. Columns of docs by the names
    above are replaced. A null or empty text has no words and fails the base
    rules. A document under a guard passes that test, as does every document if
    there is no reference. Repeated rows get equal results.
    """
    references = language_references(docs, rules) if references is None else references
    out = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("_words", words(F.col("_text")))
    out = with_windows(histograms(out, rules))
    n = F.size("_words")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD_IN))
    out = out.withColumn("_lines", lines)
    out = out.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": (F.length("_text") - F.col("_c0")).cast("long"),
            "n_symbols": (F.length("_symbols") - F.length(F.regexp_replace("_symbols", r"[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeated_words().cast("long"),
        }
    )
    nearest = lambda c, k: F.least(*js_distances(F.col(c), [r[k] for r in references]), F.lit(1.0)) if references else F.lit(0.0)
    out = out.withColumns({"char_distance": F.when(F.col("_ch").isNotNull(), nearest("_ch", 0)), "word_distance": F.when(F.col("_wh").isNotNull(), nearest("_wh", 1))})
    out = out.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") > rules.most_repeated * F.col("n_words")))
    strange = (F.coalesce("char_distance", F.lit(0.0)) > rules.char_distance) | (F.coalesce("word_distance", F.lit(0.0)) > rules.word_distance)
    # No filter on the verdict passes below a row number. It would take the word arrays with it, to be worked out anew for each word.
    stop = F.monotonically_increasing_id() >= 0
    return out.withColumn("kept", ~F.col("base_failed") & ~strange & stop).drop("_text", "_words", "_ch", "_wh", "_lines", "_symbols", "_sorted", *[f"_c{i}" for i in range(len(CHAR_CLASSES) + 1)])


WORD_IN = r"[^\x20\x09-\x0D]"


def op4_quality_rules(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return quality_rules(docs.select("doc_id", "text", "lang")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, with their own columns."""
    judged = quality_rules(docs.select(F.struct("*").alias("_row"), F.col("text"), F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")), rules)
    return judged.where("kept").select("_row.*")
