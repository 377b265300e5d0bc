"""The stages in order, each on what the one before kept."""

import random

from quillspark.llm import decontaminate, quality, secrets, simhash


def test_stages(folder, spark):
    import corpus_pipeline

    rng = random.Random(1)
    w = [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.getrandbits(14):x}" for _ in range(900)]
    text = lambda n: " ".join(rng.choice(w) for _ in range(n))
    docs = [(i, text(80)) for i in range(200)] + [(1000 + i, text(60).upper() + "!!") for i in range(60)]
    labels = [(i, int(i < 1000), 0) for i, _ in docs]
    item = text(40)
    docs += [(500, docs[0][1]), (501, f"{text(30)} {item} {text(30)}"), (502, text(50) + " token = 'a81f3b92cc0475d1e6f0' end"), (503, None), (503, None)]
    d = folder(docs, labels=(labels, "doc_id long, quality int, toxic int"), benchmark=([(1, item)], "item_id long, text string"))
    at = spark.read.parquet(f"{d}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, at, d)
        assert now.columns == at.columns, name
        now.write.parquet(f"{d}/{name}")
        at = spark.read.parquet(f"{d}/{name}")
        ids.append({r["doc_id"] for r in at.select("doc_id").collect()})
    assert not ids[0] & set(range(1000, 1060)) and set(range(200)) <= ids[0]
    assert 500 not in ids[1] and 0 in ids[1]
    assert 501 in ids[1] and 501 not in ids[2]
    assert ids[3] == ids[2]
    masked = at.where("doc_id = 502").first()
    assert "a81f3b92" not in masked["text"] and masked["n_chars"] == len(masked["text"])
    assert corpus_pipeline.STAGES[-1][1](spark, at, d).select("doc_id").distinct().count() == len(ids[3])


def test_near_copies_by_exact_jaccard_index(folder, spark):
    from quillspark.llm import near_copies

    rng = random.Random(2)
    w = [f"w{rng.getrandbits(40):x}" for _ in range(4000)]
    docs = [(1, None), (2, ""), (3, "Two words"), (4, "two  WORDS"), (5, "two words more"), (None, "two words more")]
    for i in range(60):
        base = [rng.choice(w) for _ in range(rng.randint(55, 240))]
        docs.append((100 + 10 * i, " ".join(base)))
        for k in range(1, 4):
            copy = list(base)
            for _ in range(max(1, k * len(base) // 130)):
                copy[rng.randrange(len(copy))] = "changed"
            docs.append((100 + 10 * i + k, " ".join(copy)))
    d = folder(docs)
    got = {r["doc_id"] for r in near_copies.keep_one(spark.read.parquet(f"{d}/documents.parquet")).collect()}
    sets = {i: {tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))} for i, t in docs if i is not None for x in [(t or "").lower().split()]}
    root = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in range(4):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    # Fingerprints of equal texts but for a word may link a pair just below 0.8, too; none here.
    assert got == set(root.values()) and 50 < len(pairs)


def test_empty_and_odd_tables(folder, spark, odd, tmp_path):
    import corpus_pipeline

    bench, labels = ([(1, "an item of some words"), (2, None)], "item_id long, text string"), ([(3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    for name, rows in (("none", []), ("odd", odd)):
        d = f"{tmp_path}/{name}"
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "cast(length(text) as long) n_chars", "'clash' digest", "7 fp", "1 key", "'r' rid", "'w' words")
        df.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(*bench).write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame(*labels).write.parquet(f"{d}/labels.parquet")
        at = spark.read.parquet(f"{d}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            got = f(spark, at, d)
            assert got.columns == at.columns, stage
            n = got.count()
            assert n == {"near_dedup": len({" ".join((t or "").split()).lower() for _, t in rows}), "quality": n}.get(stage, len(rows)), stage
        packed = corpus_pipeline.STAGES[-1][1](spark, at, d)
        assert packed.where("piece = 0").count() == len(rows)
        out = corpus_pipeline.run(spark, d)
        assert (out.count() > 0) == bool(rows) and set(out.columns) >= {"doc_id", "piece", "sequence_id", "offset"}
