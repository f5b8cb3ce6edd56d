import random
import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as registry
from payrisk.llm import quality as ql

DOC_SCHEMA = "doc_id bigint, text string, words string, kept boolean, n_words string, doc string"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated),
    )


def test_measures_equal_plain_python(spark):
    draw = random.Random(4)
    texts = [None, "", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", "é # é", "x\x1cy z\xa0w\x85", "a\x0bb\x0cc\rd"]
    for _ in range(300):
        texts.append("".join(draw.choices(["a", "b", "c", "É!", "#*", " ", " ", " ", "\n", "\t", "|<1"], k=draw.randint(0, 60))))
    texts.append("the same words " * 20_000)
    docs = spark.createDataFrame([(k, t, "w", True, "n", None) for k, t in enumerate(texts)], DOC_SCHEMA)
    found = {r["doc_id"]: tuple(r)[1:] for r in ql.measure(docs).select("doc.doc_id", *ql.MEASURES).collect()}
    for k, text in enumerate(texts):
        assert found[k] == plain(text), repr(text)[:80]


def test_features_by_hand_and_no_sort_by_a_lambda(spark):
    texts = ["Éa B1! 𝐀 ?#22\n\x0b\n x", "one two three four " * 3 + "ONE", "a b c d", None]
    docs = spark.createDataFrame([(k, t, "w", True, "n", None) for k, t in enumerate(texts)], DOC_SCHEMA)
    measured = ql.measure(docs)
    plan = measured._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan
    # Signs are counted in what is left of a text, not character by character in all of it.
    assert "translate(text" not in plan and "translate(coalesce" not in plan
    for row, text in zip(measured.orderBy("doc.doc_id").collect(), texts):
        text = text or ""
        n, words = max(1, len(re.sub(r"\s", "", text))), text.split()
        shares = [sum(c in "!?" for c in text), sum(unicodedata.category(c) == "Lu" for c in text), sum(c in "0123456789" for c in text)]
        assert [row["mark_share"], row["upper_share"], row["digit_share"]] == [s / n for s in shares]
        assert row["distinct_share"] == len(set(words)) / max(1, len(words)) and tuple(row[m] for m in ql.MEASURES) == plain(text)


def learnable(n=600, seed=5):
    draw = np.random.default_rng(seed)
    rows = {f: draw.random(n) for f in ql.FEATURES}
    bad = (rows["symbol_share"] > 0.8) | ((rows["words"] < 0.3) & (rows["upper_share"] > 0.6))
    return rows | {"bad": bad, "grow": np.arange(n) % 3 != 0}


def test_list_finds_planted_rules():
    rules = ql.learn_list(learnable())
    rows = learnable(4000, 6)
    rejected = np.zeros(4000, bool)
    for rule in rules:
        rejected |= ql._cover(rule, rows, np.ones(4000, bool))
    assert (rejected & rows["bad"]).sum() >= 0.9 * rows["bad"].sum()
    assert (rejected & ~rows["bad"]).sum() <= 0.03 * rejected.sum()
    assert {c.feature for rule in rules for c in rule} >= {"symbol_share", "words", "upper_share"}


def test_nothing_to_learn():
    rows = learnable(50)
    for bad in (np.zeros(50, bool), np.ones(50, bool)):
        rules = ql.learn_list(rows | {"bad": bad})
        assert rules == [] or bad.all()
    assert ql.learn_list({f: np.zeros(0) for f in ql.FEATURES} | {"bad": np.zeros(0, bool), "grow": np.zeros(0, bool)}) == []


def test_conditions_in_order(spark):
    rules = [(ql.Condition("words", False, 60.0),), (ql.Condition("symbol_share", True, 0.2), ql.Condition("words", True, 60.0))]
    texts = ["a b c d e " * 11, "q w e r t y # % & $ u i o p " * 20, " ".join(f"w{k}" for k in range(90)), "short", None]
    docs = spark.createDataFrame([(k, t, "w", True, "n", None) for k, t in enumerate(texts)], DOC_SCHEMA)
    found = {r["doc_id"]: (r["base_failed"], r["rule"], r["kept"]) for r in ql.judge(docs, rules).select("doc.doc_id", "base_failed", "rule", "kept").collect()}
    assert found == {0: (True, 1, False), 1: (True, 2, False), 2: (False, None, True), 3: (True, 1, False), 4: (True, 1, False)}
    kept = ql.keep_good(docs, rules)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, texts[2], "w", True, "n", None)]
    assert ql.keep_good(docs.limit(0), rules).count() == 0
    assert ql.describe(rules) == ["words < 60", "symbol_share >= 0.2 and words >= 60"]


def test_labels_with_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(60)), "w", True, "n", None) for k in (1, 1, 2, None)], DOC_SCHEMA)
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (None, 1), (3, None)], "doc_id bigint, quality int")
    rows = ql.labelled_rows(docs, labels)
    assert sorted(rows["bad"]) == [False, True]
    assert len(ql.labelled_rows(docs, labels, 1)["bad"]) == 1
    assert ql.learn(docs, labels.limit(0)) == []


def test_query_rejects_what_is_labelled_bad_and_keeps_the_rest(spark):
    folder = "/root/testdata/sf0.01"
    out = registry.queries()["op4_quality_rules"](spark, folder)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    rows = out.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where(~F.col("base_failed")).collect()
    good, bad = ([r for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(r["kept"] for r in good) >= 0.98 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.6 * len(bad)
