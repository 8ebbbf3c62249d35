"""Bounds of samples, blocks and broadcasts, whatever repeats."""

import pytest
from pyspark.sql import functions as F

from barspark.llm import languages, ngrams, quality, sampling, sharding
from barspark.llm.storage import row_bytes, saved
from barspark.sources import scratch


def test_one_id_with_very_many_texts_gives_one_text(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(quality, "train", lambda texts, labels: taken.append((texts, labels)) or quality.Network(*([None] * 4), [0.0]))
    ids = [k for k in range(40)]
    docs = spark.createDataFrame([(k, f"text {k}") for k in ids], "doc_id long, text string").union(spark.range(5000).selectExpr("1L AS doc_id", "concat('other ', id % 3000)"))
    labels = spark.createDataFrame([(k, k % 2) for k in ids] * 2 + [(None, 1)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "SAMPLE_PER_LABEL", 8)
    quality.fit_quality(spark, docs, labels)
    texts, marks = taken[0]
    assert len(texts) == 16 and marks.count(1) == marks.count(0) == 8
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 20)
    quality.fit_quality(spark, docs, labels)
    assert 2 <= len(taken[1][0]) <= 8


def test_a_language_of_one_repeated_row_is_learnt(spark):
    hot = spark.range(30_000).selectExpr("1L AS doc_id", "'der die das und ist nicht ein zu' AS text", "'de' AS lang")
    rest = [(k, f"die katze sitzt auf dem tisch {k}", "de") for k in range(10, 50)] + [(k, f"the cat is on the table {k}", "en") for k in range(100, 300)]
    docs = hot.union(spark.createDataFrame(rest, hot.schema))
    model = languages.fit_languages(docs)
    assert model.languages == ["de", "en"]
    found = {r.text: r.lang_pred for r in languages.identify(docs, model).join(docs.distinct(), "doc_id").select("text", "lang_pred").distinct().collect()}
    assert sum(v == ("de" if "katze" in t or "der" in t else "en") for t, v in found.items()) > 0.95 * len(found)


def test_samples_are_whole_below_their_bound_and_bounded_above_it(spark):
    rows = spark.createDataFrame([(k, f"t{k % 7}", v) for v, n in (("a", 3), ("b", 50), (None, 20)) for k in range(n)] * 3, "doc_id long, text string, v string")
    count = lambda df: {r.v: r["count"] for r in df.groupBy("v").count().collect()}
    assert count(sampling.hash_sample(rows.where("v IS NOT NULL"), "v", 10, 1000, 1 << 20)) == {"a": 3, "b": 10}
    assert count(sampling.hash_sample(rows.where("v IS NOT NULL"), "v", 10, 4, 1 << 20)) == {"a": 2, "b": 2}
    assert count(sampling.hash_sample(rows.where("v IS NOT NULL"), "v", 10, 1000, 3)) == {"a": 2, "b": 2}
    assert sampling.hash_sample(rows.limit(0), "v", 10, 10, 10).count() == 0


def test_rows_that_are_alike_spread_over_blocks(spark):
    docs = spark.range(3000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'same' AS text").union(spark.range(50).selectExpr("id", "concat('t', id)"))
    rows = sharding.shard_documents(docs, 8, rows_per_block=100)
    slots = rows.groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("s")).collect()
    assert all(r.s == list(range(len(r.s))) for r in slots) and sum(len(r.s) for r in slots) == 3050
    by = {}
    original = sharding.saved
    with pytest.MonkeyPatch.context() as m:
        m.setattr(sharding, "saved", lambda df, name: by.setdefault(name, original(df, name)))
        sharding.shard_documents(docs, 8, rows_per_block=100).count()
    assert by["sharding-blocks"].groupBy("shard", "_block").count().agg(F.max("count")).first()[0] < 250


def test_broadcasts_are_bounded_in_bytes(spark, monkeypatch):
    wide = saved(spark.range(50).selectExpr("id AS k", "array_repeat('0123456789', 100) AS a", "'x' AS s", "named_struct('v', array(1, 2)) AS n"), "wide")
    assert 50 * 2600 <= wide.agg(F.sum(row_bytes(wide.schema))).first()[0] <= 50 * 2900
    rows = spark.range(100).selectExpr("id % 50 AS k")
    plan = lambda: scratch.attached(rows, wide, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan()
    monkeypatch.setattr(scratch, "MOST_BROADCAST_BYTES", 100_000)
    assert "broadcast" not in plan()


def test_a_remote_master_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = {"spark.checkpoint.dir": None, "spark.sql.warehouse.dir": "file:/tmp/warehouse"}

    with pytest.raises(ValueError, match="share"):
        scratch.shared_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://x/y/"}
    assert scratch.shared_dir(Session()) == "hdfs://x/y"


def test_shards_are_opened_on_first_use(spark):
    model = ngrams.train(spark.createDataFrame([(f"w{k} w{k + 1} w{k % 7}",) for k in range(400)], "text string"))
    trie = model.open()
    assert not trie.words and not trie.pairs and len(trie.words.sources) > 1
    hashes, _ = ngrams.tokens(*next(iter(ngrams.slices(ngrams.pa.array(["w1"]))))[2:])
    numbers, counts = trie.numbers(hashes[:1])
    assert numbers[0] >= 0 and counts[0] > 0 and len(trie.words) == 1
    missing = next(s for s in trie.words.sources if s not in dict.keys(trie.words))
    assert missing in trie.words
