"""The pipeline against a brute-force version of its stages, and each stage's columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from fieldbiome.llm import quality
from tests.llm.test_operators import SCHEMA, SPACE, brute_components, brute_lines, brute_mix, brute_stats, sentence


def brute_quality(rows, rules):
    kept = []
    for r in rows:
        t = r[1] or ""
        n, chars, symbols, dup, rep = brute_stats(t)
        w, lines = re.findall(SPACE, t), [x for x in t.split("\n") if re.search(SPACE, x)]
        rate = lambda a, b: a / b if b else 0.0
        capital = sum(x.upper() == x and x.lower() != x and len(x) > 1 for x in w)
        x = np.array([[rate(symbols, n), rate(dup, len(lines)), rate(rep, n), rate(len(set(w)), n), rate(t.count("!") + t.count("?"), n), rate(capital, n), rate(chars, n)]])
        if n >= 10 and 100 * rep <= 20 * n and not any(quality._covers(rule, x)[0] for rule in rules):
            kept.append(r)
    return kept


def brute_copies(rows):
    total, target = brute_mix([(d, t, s) for d, t, _, s, _ in rows])
    copies = {}
    for s in total:
        mine = sorted((int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16), d, len(re.findall(SPACE, t or ""))) for d, t, _, v, _ in rows if v == s)
        passes = int(target[s] // total[s]) if total[s] else 0
        rest, upto = target[s] - passes * total[s], 0
        for _, d, n in mine:
            upto += n
            copies[d] = min(2, passes + (upto - n / 2 <= rest)) if n else 0
    return copies


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    good = ["\n".join(sentence(rng, rng.randint(12, 40)) for _ in range(rng.randint(1, 4))) for _ in range(120)]
    texts = [None, "", "too short"] + good
    texts += [good[k] for k in range(10)]  # exact copies
    for k in range(20, 40):  # near copies: two words of each line
        lines = []
        for line in good[k].split("\n"):
            w = line.split()
            for _ in range(2):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            lines.append(" ".join(w))
        texts.append("\n".join(lines))
    texts += [" ".join(f"{w}###" for w in sentence(rng, 40).split()) for _ in range(40)]
    rows = [(k, t, "en", None if k % 13 == 0 else f"s{k % 4}", len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bad = range(len(texts) - 40, len(texts))
    labels = spark.createDataFrame([(k, int(k not in bad), 0) for k in range(3, len(texts))], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    want = brute_quality(rows, quality.fit(docs, labels))
    assert not {r[0] for r in want} & set(bad)
    gone = brute_lines([r[1] for r in want])
    left = []
    for k, r in enumerate(want):
        lines = r[1].split("\n")
        kept = [x for p, x in enumerate(lines) if (k, p) not in gone]
        if any(re.search(SPACE, x) for x in kept) or not any(re.search(SPACE, x) for x in lines):
            left.append((r[0], "\n".join(kept), *r[2:]))
    classes = brute_components([r[1] for r in left], 5, 80)
    left = [r for k, r in enumerate(left) if classes[k][1] == k]
    copies = brute_copies(left)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = Counter()
    for d, t, *_ in left:
        if copies[d]:
            expected[d, hashlib.sha256(",".join(map(str, lib.encode(t))).encode()).hexdigest()] = copies[d]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in got) == expected

    extra = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, extra, str(tmp_path)).columns == docs.columns


def test_pipeline_of_missing_and_repeated_ids(spark, tmp_path):
    rng = random.Random(20)
    a, b, c = ("\n".join(sentence(rng, 30) for _ in range(3)) for _ in range(3))
    rows = [(1, a), (1, a), (1, b), (None, c), (2, None), (3, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA).select("*", *[F.lit("x").alias(x) for x in ("__stats", "__lines", "__kept", "__copies", "__id")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == sorted([(0, c), (1, a), (1, b)])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {None, 1}
