"""The pipeline's stages against plain versions, each on its own input."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from faultline.llm.packing import PieceEncoder
from faultline.llm.queries import tokenizer_file
from faultline.llm.shared import stored

from .fixtures import documents, link_components, removed_words, words


def base_fails(text):
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen, covered = {}, [False] * len(w)
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered[i : i + 5] = [True] * 5
    return len(w) < 10 or 100 * sum(covered) > 20 * len(w)


def test_stages(spark, tmp_path):
    sf_dir = str(tmp_path)
    documents(spark).write.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.createDataFrame([(k, int(k % 5 > 0), int(k % 11 == 0)) for k in range(0, 150, 3)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{sf_dir}/labels.parquet")
    docs, outputs = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        outputs[name] = (docs.collect(), docs := stored(stage(spark, docs, sf_dir), name))

    before, after = outputs["quality_rules"][0], outputs["quality_rules"][1].collect()
    assert sorted(repr(r) for r in after) == sorted(repr(r) for r in before if not base_fails(r["text"]))  # few labels admit no further rule

    before, after = outputs["ngram_jaccard_join"][0], outputs["ngram_jaccard_join"][1].collect()
    least, sizes = link_components([r["doc_id"] for r in before], [r["text"] for r in before])
    assert len(after) == len(set(least)) and min(sizes) > 0
    assert {r["doc_id"] for r in after} == set(least)

    before, after = outputs["substring_dedup"][0], outputs["substring_dedup"][1].collect()
    flags = removed_words([r["text"] for r in before])
    want = sorted((repr(r["doc_id"]), " ".join(w for w, x in zip(words(r["text"]), g, strict=True) if not x)) for r, g in zip(before, flags, strict=True))
    assert sorted((repr(r["doc_id"]), r["text"]) for r in after) == want
    assert all(r["n_chars"] == len(r["text"]) for r in after)

    before, mixed = outputs["source_mixing"]
    assert mixed.columns == corpus_pipeline.COLUMNS
    assert {repr(r) for r in mixed.collect()} <= {repr(r) for r in before}

    before, pieces = outputs["packing"][0], outputs["packing"][1].collect()
    encoder = PieceEncoder(tokenizer_file())
    ids = {repr(r["doc_id"]): np.append(encoder.encode([r["text"] or ""])[0], 1).astype("<u4") for r in before}
    for p in pieces:
        own = ids[repr(p["doc_id"])]
        assert p["doc_tokens"] == len(own)
        assert p["ids_crc32"] == zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes())
    assert sum(p["length"] for p in pieces) == sum(len(ids[repr(r["doc_id"])]) for r in before)


def test_run_gives_the_last_stage(spark, tmp_path):
    sf_dir = str(tmp_path)
    documents(spark).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
