"""The stages by their effects, each on what the one before kept."""

import corpus_pipeline as pipeline
from barspark.llm import jaccard, queries


def test_stages_keep_their_contract(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    counts = []
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.saved(stage(spark, docs, small), f"test-{name}")
        assert docs.columns == columns
        counts.append(docs.count())
        if name == "near_duplicates":
            again = jaccard.near_duplicates(docs)
            assert again.select("component_id").where("n_shingles > 0").distinct().count() == again.where("n_shingles > 0").count()
    assert counts[0] < 200 and counts[1] < counts[0] and counts[2] == counts[1]
    final = pipeline.STAGES[-1][1](spark, docs, small)
    assert final.count() == counts[3] and final.where("size(ids) <> n_tokens").count() == 0


def test_clean_documents_stay(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet").where("quality = 1 and doc_id % 7 <> 0")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    good = docs.join(labels.select("doc_id"), "doc_id").select(*docs.columns)
    assert pipeline.STAGES[0][1](spark, good, small).count() >= 0.95 * good.count()


def test_a_query_for_each_operator():
    assert [sum(n.startswith(f"op{k}_") for n in queries.QUERIES) for k in range(1, 11)] == [1] * 10


def clashing(spark):
    """Rows whose columns bear the names that operators use inside, with repeated ids, other texts under one id, nulls and empty texts."""
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen " * 2
    rows = [(3, long), (5, long), (5, "another text of more than five words under the same id"), (5, long), (7, "password = hunter2hunter2 and some words after it"), (None, None), (None, "no id but some words to read here"), (9, ""), (3, long)]
    names = ["_key", "col", "_spans", "_blob", "_text", "_changed", "_rows", "_id", "_copy", "_several", "_score", "_predicted", "score", "predicted", "ids", "n_tokens", "copies", "row", "row_number", "d", "doc", "h", "k", "_hash", "_row", "address", "blob", "spans", "clean", "a.b"]
    table = spark.createDataFrame([(i, t, "en", f"s{k % 2}", len(t or ""), *[f"{n}{k}" for n in names]) for k, (i, t) in enumerate(rows)], ["doc_id", "text", "lang", "source", "n_chars", *names])
    return table, names


def by_row(df, names):
    return sorted((tuple(str(r[n]) for n in names), r["doc_id"] or -1, r["text"] or "") for r in df.select("doc_id", "text", *[f"`{n}`" for n in names]).collect())


def test_stages_keep_columns_of_any_name(spark, small):
    table, names = clashing(spark)
    everything = by_row(table, names)
    stages = dict(pipeline.STAGES)
    for name in ("quality", "near_duplicates", "mixing"):
        out = stages[name](spark, table, small)
        assert out.columns == table.columns
        assert set(by_row(out, names)) <= set(everything)
    kept = {(i, t) for _, i, t in by_row(stages["near_duplicates"](spark, table, small), names)}
    assert len(kept) == stages["near_duplicates"](spark, table, small).count() == 6 and (5, everything[1][2]) not in kept
    clean = stages["secrets"](spark, table, small)
    assert clean.columns == table.columns
    want = [(n, i, t.replace("password = hunter2hunter2", "[SECRET]")) for n, i, t in everything]
    assert by_row(clean, names) == want
    pieces = stages["pieces"](spark, table, small)
    assert pieces.columns == ["doc_id", "lang", "source", "n_chars", "ids", "n_tokens"] and pieces.count() == len(everything)
    for name, stage in pipeline.STAGES:
        assert stage(spark, table.where("false"), small).count() == 0, name
