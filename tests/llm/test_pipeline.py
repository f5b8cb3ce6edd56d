"""Every stage beside a plain version of it, on the small table and on hard rows."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as registry
import corpus_pipeline
from payrisk.llm import decontaminate as dc
from payrisk.llm import quality, secrets
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_jaccard import brute as brute_components
from tests.llm.test_quality import plain as plain_measures

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of each stage, each written and read again."""
    out, docs = [], spark.read.parquet(f"{FOLDER}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, FOLDER).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def rows(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_columns(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert dict(after.dtypes) == dict(before.dtypes)


def test_quality_keeps_clean_documents(stages, spark):
    before, after = rows(stages[0][1]), rows(stages[0][2])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    base = {d: plain_measures(r["text"]) for d, r in before.items()}
    failed = {d for d, m in base.items() if m[0] < 50 or 100 * m[4] > 50 * m[0]}
    assert not failed & set(after) and all(after[d] == before[d] for d in after)
    good = [d for d, q in labels.items() if q == 1 and d in before and d not in failed]
    assert sum(d in after for d in good) >= 0.98 * len(good)


def test_one_of_each_group_stays(stages):
    before, after = rows(stages[1][1]), rows(stages[1][2])
    want = {c for _, c in brute_components([(d, r["text"]) for d, r in before.items()]).values()}
    assert set(after) == want and all(after[d] == before[d] for d in after)


def test_passages_of_items_go(stages, spark):
    before, after = rows(stages[2][1]), rows(stages[2][2])
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hits = {d: brute_hits(r["text"], items, 10) for d, r in before.items()}
    assert set(after) == {d for d, (n, hit, _) in hits.items() if hit <= 0.5 * n}
    assert any(hit for _, hit, _ in hits.values())
    for d, r in after.items():
        n, hit, _ = hits[d]
        assert len(dc.words_of(r["text"].encode())) == n - hit
        assert r["n_chars"] == (len(r["text"]) if hit else before[d]["n_chars"])


def test_secrets_go(stages):
    before, after = rows(stages[3][1]), rows(stages[3][2])
    assert set(after) == set(before)
    changed = 0
    for d, r in after.items():
        base = secrets.base_spans(before[d]["text"])
        spans = sorted(base + secrets.guess_spans(before[d]["text"], base))
        assert r["text"] == secrets.redact(before[d]["text"], spans)
        assert not secrets.base_spans(r["text"])
        changed += bool(spans)
    assert changed > 5


def test_every_token_is_packed(stages):
    before, pieces = rows(stages[4][1]), stages[4][2].collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by = {}
    for p in pieces:
        by.setdefault(p["doc_id"], []).append((p["start"], np.frombuffer(p["ids"], "<u4").tolist()))
    for d, r in before.items():
        want = library.encode(r["text"], add_special_tokens=False).ids + [1]
        assert sum((ids for _, ids in sorted(by[d])), []) == want
    place = sorted((p["sequence_id"] * 2048 + p["offset"], p["length"]) for p in pieces)
    assert [a for a, _ in place] == np.cumsum([0] + [n for _, n in place])[:-1].tolist()


def test_run_gives_what_the_stages_give(stages, spark):
    assert registry.queries()["pipeline"] is corpus_pipeline.run
    ran = corpus_pipeline.run(spark, FOLDER)
    assert ran.columns == stages[-1][2].columns
    total = lambda df: df.agg(F.sum("length"), F.countDistinct("doc_id")).first()
    assert total(ran) == total(stages[-1][2])


HARD = [
    (1, None, "en", "a", None, "x"), (2, "", None, None, 0, "x"), (None, "no id " * 60, "en", "a", 1, None),
    (3, " ".join(f"w{k}" for k in range(80)), "en", "a", 2, "x"), (3, " ".join(f"w{k}" for k in range(80)), "en", "a", 2, "x"),
    (4, " ".join(f"v{k}" for k in range(60_000)), "en", "b", 3, "x"),
]


@pytest.mark.parametrize("stage", range(4))
def test_stages_take_hard_rows(spark, stage):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, doc string"
    docs = spark.createDataFrame(HARD, schema)
    apply = corpus_pipeline.STAGES[stage][1]
    out = apply(spark, docs, FOLDER)
    assert out.columns == docs.columns
    found = out.collect()
    # No words fail the base rules; of repeated rows one stays in the join.
    want = {0: [3, 3, 4], 1: [1, 2, 3, 4, None], 2: [1, 2, 3, 3, 4, None], 3: [1, 2, 3, 3, 4, None]}[stage]
    assert sorted((r["doc_id"] for r in found), key=lambda d: (d is None, d)) == want
    assert apply(spark, docs.limit(0), FOLDER).count() == 0
    assert quality.MIN_WORDS == 50
