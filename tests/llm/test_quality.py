import math
import re
from collections import Counter

from helpers import ODD, WORD, frame, sample

from simforge.llm.quality import CHAR_CLASSES, QualityRules, keep_good, language_references, quality_rules

RULES = QualityRules()


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def shares(text):
    text, left, cc = text or "", text or "", []
    w = WORD.findall(text)
    for c in CHAR_CLASSES:
        cc.append(len(re.findall(c, left)))
        left = re.sub(c, "", left)
    cc.append(len(left))
    vocabulary = RULES.vocabulary()
    wc = [w.count(v) for v in vocabulary]
    wc.append(len(w) - sum(wc))
    return [x / len(text) for x in cc] if len(text) >= RULES.char_guard else None, [x / len(w) for x in wc] if len(w) >= RULES.word_guard else None


def distance(p, q):
    kl = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b) if x > 0)
    return math.sqrt(max(0, (kl(p, q) + kl(q, p)) / 2))


def brute(rows, langs):
    means = []
    for lang in sorted({x if x in RULES.common_words else "" for x in langs}):
        own = [shares(t) for (_, t), x in zip(rows, langs) if (x if x in RULES.common_words else "") == lang]
        parts = [[s[k] for s in own if s[k]] for k in (0, 1)]
        if all(parts):
            means.append([[sum(c) / len(p) for c in zip(*p)] for p in parts])
    out = []
    for i, t in rows:
        b, s = base(t), shares(t)
        d = [min((distance(s[k], m[k]) for m in means), default=0.0) if s[k] else 0.0 for k in (0, 1)]
        out.append((i, *b, not b[5] and d[0] <= RULES.char_distance and d[1] <= RULES.word_distance))
    return sorted(out, key=repr)


def run(df):
    return sorted([tuple(r) for r in quality_rules(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()], key=repr)


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    assert run(docs) == brute([r[:2] for r in rows], [r[2] for r in rows])


def test_odd_rows(spark):
    rows = sample(spark) + [(i and i + 1000, t) for i, t in ODD]
    assert run(frame(spark, rows, extra=True)) == brute(rows, ["en"] * len(rows))


def test_empty_table_and_no_lang(spark):
    assert language_references(frame(spark, [])) == []
    assert run(frame(spark, [])) == []
    assert quality_rules(frame(spark, sample(spark, 5)).drop("lang")).count() == 5


def test_clean_documents_stay_and_columns_too(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = keep_good(docs)
    assert good.columns == docs.columns
    clean = [r.doc_id for r in labels.where("quality = 1").collect()]
    lost = {i for i in clean} - {r.doc_id for r in good.select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(base(texts[i])[5] for i in lost)


def test_text_without_common_words_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    near = docs.where("lang = 'en'").select("text").orderBy("doc_id").first().text
    made = lambda k, mark: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{near[i % 20].strip() or 'e'}ation{mark}" for i in range(k)).lower()
    rows = [(10**6 + 1, made(300, "")), (10**6 + 2, made(300, " |")), (10**6 + 3, made(300, "."))]
    judged = quality_rules(frame(spark, rows), references=language_references(docs)).collect()
    assert all(not r.base_failed and r.char_distance <= RULES.char_distance for r in judged)
    assert [r.kept for r in judged] == [False] * 3


def test_null_languages_and_windows_that_repeat(spark):
    rows = sample(spark) + [(7000, "a b c a b c a b c " * 30), (7001, "x " * 200), (7002, "one two three four " + "five six " * 60)]
    df = frame(spark, rows)
    from pyspark.sql import functions as F

    langs = [None if (i or 0) % 2 else "en" for i, _ in rows]
    assert run(df.withColumn("lang", F.when(F.coalesce("doc_id", F.lit(0)) % 2 == 0, "en"))) == brute(rows, langs)
