import zlib

import numpy as np

import __spark_entry__ as registry
from payrisk.llm import langid as li

SCHEMA = "doc_id bigint, text string, lang string, score string, doc string"


def test_gradients_match_differences():
    draw = np.random.default_rng(0)
    net = li.new_network(["a", "b", "c"])
    net = li.Network(net.languages, *[p.astype(float) if not isinstance(p, list) else [q.astype(float) for q in p] for p in (net.embedding, net.filters, net.bias + 0.3, net.out, net.out_bias)])
    rows, wanted = draw.integers(0, 40, (6, li.WIDTH)), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        p = li.Reader(net)
        # In double precision, as the differences are small.
        embedded = net.embedding[rows]
        pooled = []
        for kernel in net.filters:
            w = len(kernel)
            answers = sum(embedded[:, k : li.WIDTH - w + 1 + k] @ kernel[k] for k in range(w))
            pooled.append(answers.max(axis=1))
        active = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0)
        prob = li._softmax(active @ net.out + net.out_bias)
        assert np.allclose(prob, p.probabilities(rows), atol=1e-4)
        return -np.log(prob[np.arange(6), wanted]).mean()

    grads = li._step(net, rows, wanted)
    for p, g in zip(net.parameters(), grads):
        for _ in range(6):
            at = tuple(draw.integers(0, s) for s in p.shape)
            if p is net.embedding:
                at = (int(rows[0, draw.integers(0, 200)]), at[1])
            keep = p[at]
            p[at] = keep + 1e-6
            up = loss()
            p[at] = keep - 1e-6
            down = loss()
            p[at] = keep
            assert abs((up - down) / 2e-6 - g[at]) < 1e-4


def test_windows_hold_the_whole_text():
    for n in (0, 1, 255, 256, 257, 1000):
        rows = li.windows_of(bytes(range(1, 251)) * 4 if n == 1000 else b"x" * n)
        assert rows.shape[1] == li.WIDTH and (rows != li.PAD).sum() == n


def test_order_of_texts_does_not_matter():
    net = li.train([(b"the cat and the dog " * 9, "en"), (b"der hund und die katze " * 9, "de")] * 40)
    texts = [b"the dog and the cat", b"und die katze " * 100, b"the " * 3000]
    reader = li.Reader(net)
    together = li.judge_texts(reader, texts)
    assert [t[0] for t in together] == ["en", "de", "en"]
    for text, found in zip(texts, together):
        lang, score, n = li.judge_texts(reader, [text])[0]
        assert (lang, n) == (found[0], found[2]) and abs(score - found[1]) < 1e-5


def test_hard_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", "s", "d"), (2, "", "en", None, None), (3, "123 !?", None, None, None), (None, "the cat and the dog", None, None, None),
         (4, "und die katze", "de", None, None), (4, "und die katze", "de", None, None), (5, "é", None, None, None), (6, "the " * 200_000, None, None, None)],
        SCHEMA,
    )
    net = li.train([(b"the cat and the dog " * 9, "en"), (b"der hund und die katze " * 9, "de")] * 40)
    found = {(r["doc"]["doc_id"], r["doc"]["score"]): (r["lang_pred"], r["score"]) for r in li.predict(docs, net).collect()}
    assert found[(1, "s")] == found[(2, None)] == found[(3, None)] == ("und", 0.0)
    assert found[(None, None)][0] == found[(6, None)][0] == "en" and found[(4, None)][0] == "de"
    assert all(0 <= s <= 1 for _, s in found.values())
    assert {r["lang_pred"] for r in li.predict(docs, None).collect()} == {"und"}
    assert li.predict(docs.limit(0), net).count() == 0
    assert li.sample(docs.limit(0)) == [] and li.train([]) is None
    assert {name for _, name in li.sample(docs)} <= {"de"}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = registry.queries()["op7_language_id"](spark, folder).collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(found) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r["held_out"]]
    assert len(held) > 150
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_every_language_is_sampled(spark):
    rows = [(k, f"text number {k} in tongue {'abc'[k % 3]}", f"l{k}", None, None) for k in range(1500)]
    taken = li.sample(spark.createDataFrame(rows, SCHEMA))
    assert sorted(name for _, name in taken) == sorted(f"l{k}" for k in range(1500))
    # Copies count once, however many they are, and take no place from the other texts.
    rows = [(k, "the same words", "en", None, None) for k in range(3000)] + [(k, f"other words {k}", "en", None, None) for k in range(50)]
    taken = li.sample(spark.createDataFrame(rows, SCHEMA), per_language=60)
    assert sorted(text for text, _ in taken) == sorted([b"the same words", *(f"other words {k}".encode() for k in range(50))])
    # Many languages share the bound of all windows.
    rows = [(k, f"words {k}", f"l{k % 20}", None, None) for k in range(400)]
    taken = li.sample(spark.createDataFrame(rows, SCHEMA), max_windows=60)
    assert len({name for _, name in taken}) == 20 and len(taken) <= 60
