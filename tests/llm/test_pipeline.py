"""The stages of corpus_pipeline, each against a plain version of what it keeps, and on rows with nulls, repeats and clashing columns."""

import base64
import hashlib
import math
from collections import Counter, defaultdict

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tessera.llm import quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Plain, repetitive and foreign texts, copies, near copies and a shared passage, in two sources."""
    rng = np.random.default_rng(7)
    vocabulary = [f"word{k}" for k in range(300)]
    passage = "\n".join(" ".join(rng.choice(vocabulary, 15)) for _ in range(4))
    rows = []
    for i in range(80):
        text = " ".join(rng.choice(vocabulary, rng.integers(30, 90)))
        if i % 10 == 3:
            text = " ".join(f"zq{x}" for x in rng.integers(0, 10**6, 50))  # unlike what is trusted
        if i % 10 == 4:
            text = "same five words come back " * 9
        if i % 10 == 5 and i > 10:
            text = rows[i - 1 - 10 * (i % 20 == 5)][1]
        if i % 10 == 6:
            text = rows[i - 4][1] + " end"  # a near copy
        if i % 20 == 7:
            text += "\n" + passage + "\n" + " ".join(rng.choice(vocabulary, 30))
        rows.append((i, text, "en", "big" if i % 4 else "small", len(text)))
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    labels = [(i, int(i % 10 not in (3, 4)), 0) for i in range(80)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path, labels


def after_quality(rows, labels):
    kept = brute.quality([r[:2] for r in rows], labels, quality.BUCKETS, quality.THRESHOLD)
    return [r for r, (_, keep) in zip(rows, kept) if keep]


def after_lines(rows):
    gone = brute.line_dedup([(r[0], r[1]) for r in sorted(rows)])
    out = []
    for i, text, lang, source, _ in rows:
        left = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[i])
        if left == text or brute.WORD.search(left):
            out.append((i, left, lang, source, len(left)))
    return out


def after_join(rows):
    found = brute.components([r[:2] for r in rows])
    return [r for r in rows if found[r[0]][0] == 0 or found[r[0]][1] == r[0]]


def after_mixing(rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1])
    roots = {s: math.sqrt(n) for s, n in sizes.items()}
    out = []
    for r in rows:
        rate = roots[r[3]] / sum(roots.values()) * sum(sizes.values()) / sizes[r[3]]
        u, copies, cdf = int(hashlib.md5(f"0|{r[0]}".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate)
        while cdf <= u:
            copies += 1
            cdf += math.exp(-rate + copies * math.log(rate) - math.lgamma(copies + 1))
        out += [r] * copies
    return out


def test_stages_and_run(spark, folder):
    path, labels = folder
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources", "byte-level BPE"]
    rows = corpus()
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (lambda r: after_quality(r, labels), after_lines, after_join, after_mixing)):
        docs = spark.createDataFrame(rows, SCHEMA)
        got = stage(spark, docs, path)
        assert got.columns == COLUMNS
        expected = plain(rows)
        assert sorted(map(tuple, got.collect())) == sorted(expected), name
        assert name == "mixing sources" or 0 < len(expected) < len(rows) or name == "line dedup" and expected != rows
        rows = expected
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    expected = sorted((i, lang, source, encode(text)) for i, text, lang, source, _ in rows)
    got = corpus_pipeline.run(spark, path).collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) // 4 for r in got)
    assert sorted((r.doc_id, r.lang, r.source, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == expected


def test_stages_on_odd_rows(spark, folder, docs, no_docs):
    """Nulls, empty and repeated rows and columns of clashing names pass every stage; an empty table stays empty."""
    path, _ = folder
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, path)
        assert name == "byte-level BPE" or got.columns == docs.columns
        found = defaultdict(int)
        for r in got.collect():
            found[r.doc_id] += 1
        assert set(found) <= {r.doc_id for r in docs.collect()}
        assert stage(spark, no_docs, path).count() == 0
