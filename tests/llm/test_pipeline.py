"""The corpus pipeline: every stage against what its operator says about the stage's own input."""

import corpus_pipeline
from lucerna.llm import line_dedup, mixing, near_dedup, packing, quality_rules, queries


def test_stages(spark, tmp_path):
    line = "shared line of more than ten characters"
    good = lambda i, n=80: " ".join(f"doc{i}word{k}" for k in range(n))
    base = good(1)
    rows = [(i, f"{good(i)}\n{line}" if i % 2 else good(i), "en", f"s{i % 3}", 0) for i in range(2, 30)]
    rows += [(1, base, "en", "s1", 0), (40, base + " tail", "en", "s1", 0), (41, "too short", "en", "s1", 0), (42, "a b c " * 50, "en", "s2", 0), (43, None, "en", None, None)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    docs = spark.read.parquet(path)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    state = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        state[name] = docs
        if name == "quality_rules":
            assert ids(docs) == sorted(r["doc_id"] for r in quality_rules.quality_rules(before).where("kept").collect()) and not {41, 42, 43} & set(ids(docs))
        elif name == "line_dedup":
            kept = {r[0]: r[1] for r in line_dedup.line_dedup(before).selectExpr("row.doc_id", "kept").collect()}
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == kept and sum(line in t for t in kept.values()) == 1
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect() if line not in r["text"] and r["doc_id"] % 2 and r["doc_id"] > 1)
        elif name == "near_dedup":
            assert ids(docs) == sorted(r["doc_id"] for r in near_dedup.near_dedup(before).where("keep").collect()) and 1 in ids(docs) and 40 not in ids(docs)
        elif name == "mixing":
            order = [r["doc_id"] for r in docs.collect()]
            assert order == [r[0] for r in mixing.mixing(before).orderBy("position").selectExpr("row.doc_id").collect()]
        if name != "packing":
            assert docs.columns == before.columns
    last = state["packing"].select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(last) == sorted(packing.cut(before, queries.vocabulary()).select("doc_id", "piece", "ids_crc32").collect())
    assert sorted(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "ids_crc32").collect()) == sorted(last)


def test_the_order_of_the_mixture_decides(spark, tmp_path):
    rows = [(i, " ".join(f"w{i % 9}" for _ in range(400 + i % 3)), "en", "s", 0) for i in range(60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    found = []
    for name, order in (("up", rows), ("down", rows[::-1])):
        path = str(tmp_path / name)
        spark.createDataFrame(order, schema).repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").write.parquet(path) if name == "up" else spark.createDataFrame(order, schema).coalesce(1).write.parquet(path)
        for docs in (spark.read.parquet(path), spark.createDataFrame(order, schema)):
            out = corpus_pipeline.packing(spark, docs, "").collect()
            at = {r[0]: k for k, r in enumerate(order)}
            first = {}
            for r in out:
                first[r["sequence_id"]] = min(first.get(r["sequence_id"], 99), at[r["doc_id"]])
            assert len(out) == 60 and sorted(first) == list(range(len(first)))
            assert [first[k] for k in sorted(first)] == sorted(first.values())
        found.append({(r["doc_id"], r["sequence_id"], r["offset"]) for r in out})
    assert found[0] != found[1]
