"""Near copies in families of texts of which only some are alike, against comparing every pair."""

import random
from itertools import combinations

from factloom.llm import simhash


def test_pairs_meet_beside_the_least_of_a_bucket(spark):
    rng = random.Random(5)
    texts = []
    for family in range(8):
        base = [f"w{family}x{i}" for i in range(300)]
        for _ in range(8):
            words = list(base)
            for at in rng.sample(range(300), rng.choice((3, 6, 9))):
                words[at] = f"n{rng.random()}"
            texts.append(" ".join(words))
    grams = [simhash.shingles(t.encode()) for t in texts]
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    group = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]) or (prints[i] ^ prints[j]).bit_count() <= 4:
            group = [group[i] if g == group[j] else g for g in group]
    got = simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert 8 < len(set(group)) < len(texts)
    assert sorted(r.doc_id for r in got.collect()) == sorted(min(i for i, g in enumerate(group) if g == x) for x in set(group))


def test_repeated_rows_are_packed_in_several_groups(spark):
    """A third of all rows alike, without an id: they don't meet in one group."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from factloom.llm import packing

    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one and the same text").alias("text"))
    packed = packing.pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json"), group_pieces=256)
    rows = packed.select("sequence_id", "offset", "length", (F.col("sequence_id") / F.lit(1 << 32)).cast("long").alias("group")).collect()
    sizes = [sum(r["group"] == g for r in rows) for g in {r["group"] for r in rows}]
    assert len(rows) == 3000 and len(sizes) >= 10 and max(sizes) < 3 * 256
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(spans[-1]) <= 2048


def test_a_bucket_of_many_unlike_texts_loses_no_pair(spark, monkeypatch):
    """Forty texts that share all minima: the three heads are unlike most of them, and only pairs of five are alike."""
    rng = random.Random(9)
    texts = []
    for i in range(20):
        own = [f"o{i}x{j}" for j in range(200)]
        twin = list(own)
        for at in rng.sample(range(200), 3):
            twin[at] = f"t{rng.random()}"
        texts += [" ".join(own), " ".join(twin)]
    monkeypatch.setattr(simhash, "HEADS", 1)
    real = simhash._bands
    monkeypatch.setattr(simhash, "_features", lambda base: _same_bands(base, real))
    monkeypatch.setattr(simhash, "close_links", lambda fps, distance, blocks=6: fps.sparkSession.createDataFrame([], "a long, b long"))
    base = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "digest long, text string")
    labels = {r["digest"]: r["label"] for r in simhash._labels(base, 4).collect()}
    grams = [simhash.shingles(t.encode()) for t in texts]
    for a, b in combinations(range(len(texts)), 2):
        alike = len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])
        assert (labels[a] == labels[b]) == alike, (a, b)


def _same_bands(base, real):
    """Features in which every text has the same bands."""
    from pyspark.sql import functions as F

    fps = F.udf(lambda t: simhash.fingerprint(t.encode()) - (1 << 63), "long")
    sizes = F.udf(lambda t: len(simhash.shingles(t.encode())), "long")
    return base.select("digest", fps("text").alias("fp"), F.array(*[F.lit(7).cast("long")] * 3).alias("bands"), sizes("text").alias("grams"))
