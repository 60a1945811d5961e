"""Recordings with links: noisy and cut copies of the fixtures' vectors, against aligning every pair at every offset."""

import numpy as np

from factloom.llm import audio


def test_noisy_and_cut_copies_are_found(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 120").select("vec_id", "embedding").collect()
    r = np.random.default_rng(7)
    noisy = [(10_001 + 2 * v["vec_id"], [float(x + 0.01 * r.normal()) for x in v["embedding"]]) for v in vectors]
    rows = spark.createDataFrame([(v["vec_id"], v["embedding"]) for v in vectors] + noisy, "vec_id long, embedding array<float>")
    prints = audio.audio_fingerprints(rows, "vec_id", "embedding", audio.tone_row)
    held = {x.rec_id: np.frombuffer(x.codes, "<u4") for x in prints.collect()}
    cut = [(20_001 + 20 * i, bytearray(held[i][len(held[i]) // 5 :].tobytes())) for i in list(held)[:60] if i < 120]
    prints = prints.unionByName(spark.createDataFrame(cut, "rec_id long, codes binary"))
    codes = {x.rec_id: np.frombuffer(x.codes, "<u4") for x in prints.collect()}
    got = {(x.query_id, x.rec_id): x for x in audio.find_recordings(prints).collect()}

    brute = set()
    for q, a in codes.items():
        if q % 20 == 0:
            for i, b in codes.items():
                if i != q and any(audio.align(a, b, o)[1] <= audio.MAX_ERROR for o in range(-len(b) + audio.MIN_OVERLAP, len(a) - audio.MIN_OVERLAP + 1)):
                    brute.add((q, i))
    assert len(brute) >= 8  # every query has its noisy or its cut copy
    assert set(got) <= brute and len(got) >= 0.9 * len(brute), (len(got), len(brute))
    offsets = [x["offset"] for (q, i), x in got.items() if i == 20_001 + 20 * q]
    assert offsets and all(abs(o) > 0 for o in offsets)
