"""Operators 11 to 13: edge cases, and whole results against plain versions."""

import hashlib
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from brute import WORD
from conftest import DOCS
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import crosstoken, periodic, queries, urlrules

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def same(got, expected):
    assert sorted(got, key=repr) == sorted(expected, key=repr)


# 11


def plain_runs(w):
    """(start, length, period) of all runs: every lag, every stretch, the smallest period of each."""
    n, best = len(w), {}
    for q in range(n // 2, 0, -1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                best[i, j + q - i] = q
            i = j + 1
    return sorted(((a, n_, q) for (a, n_), q in best.items()), key=lambda r: (r[0], r[2]))


def found_runs(rows):
    ids = np.array([x for w in rows for x in w], np.int32)
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in rows], dtype=np.int64)])
    out = [[] for _ in rows]
    for a, b, q in periodic.runs_of(ids, offsets).tolist():
        k = int(np.searchsorted(offsets, a, "right")) - 1
        out[k].append((int(a - offsets[k]), b - a + 1, q))
    return out


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def shapes():
    rng = np.random.default_rng(5)
    yield []
    yield [1] * 500
    yield fibonacci(700)
    yield [bin(i).count("1") % 2 for i in range(512)]  # Thue-Morse: its squares, and where polynomial hashes collide
    yield [0, 1] * 60 + [0] + [0, 1] * 60 + [0] + [2] * 90  # runs between neighbouring runs of one period
    yield ([0] * 100 + [1]) * 5 + [0] * 40
    yield ([0, 1, 0] * 40 + [2, 3]) * 3 + [0, 1, 0] * 50 + [1] + [0, 0, 1] * 50
    for k in range(120):
        letters, n = int(rng.integers(1, 5)), int(rng.integers(1, 420))
        w = rng.integers(0, letters, n)
        for _ in range(int(rng.integers(0, 5))):
            a, p = int(rng.integers(0, n)), int(rng.integers(1, 140))
            w[a:] = w[a + np.arange(n - a) % p] if a + p <= n else w[a:]
        for _ in range(int(rng.integers(0, 3))):
            w[rng.integers(0, n)] = 9
        yield w.tolist()


def test_all_runs_of_awkward_sequences():
    rows = list(shapes())
    assert found_runs(rows) == [plain_runs(w) for w in rows]
    assert [found_runs([w])[0] for w in rows[:8]] == [plain_runs(w) for w in rows[:8]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=50), st.integers(1, 6)), max_size=6))
def test_all_runs_of_repeated_blocks(blocks):
    w = [x for block, times in blocks for x in block * times]
    assert found_runs([w, w[::-1]]) == [plain_runs(w), plain_runs(w[::-1])]


def test_runs_where_hashes_deceive(monkeypatch):
    """With hashes that are all equal, seeds are many and extensions too long; the comparison of words mends both."""
    rows = list(shapes())[4:40]
    monkeypatch.setattr(periodic.Prefixes, "same", lambda self, a, lag, n: np.ones(len(a), bool))
    found = found_runs(rows)
    assert found == [plain_runs(w) for w in rows]


def test_a_long_text_of_runs():
    w = [0] * 300_000 + fibonacci(100_000)
    found = found_runs([w])[0]
    assert (0, 300_001, 1) in found and len(found) > 20_000


def plain_op11(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(runs), s, n, q, 1000 * n // q if q else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(kept)


def test_periodic_runs(spark, docs, no_docs, tmp_path):
    rows = [(i, t) for i, t in DOCS] + [(100 + k, " ".join(f"w{k % 7}{x % 31}" for x in range(20 + 9 * k))) for k in range(60)] + [(200, "la " * 40 + "\u00a0 é\x0b\x1f x")]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    same([tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()], [plain_op11(i, t) for i, t in rows])
    found = periodic.find(docs.withColumn("runs", F.lit(1)))
    assert set(found.columns) == {"doc_id", "lang", "source", "n_chars", "ids", "key", "n_words", "runs", "collapsed"} and found.count() == len(DOCS)
    assert {r.n_words for r in found.where("key IN (1, 2, 3)").collect()} == {0}
    assert periodic.find(no_docs).count() == 0


# 12

URLS = [
    None, "", "no scheme", "http://", "http://example.org", "https://a.EXAMPLE.org/es/1?x#y", "http://example.org/en/12", "http://example.org/en/21", "http://notexample.org/es/",
    "http://b.example.com/fr/1", "http://com/de/", "http://x.com/de", "http://x.com/DE/", "http://example.org:80/es/", "http://example.org?/es/", "http://example.org#/es/", "a://b://c.org/",
    "http://.org/x", "http://a..org/x", "http://org./x", "ftp://net/\n/x", "http://" + "a." * 20_000 + "org/" + "p/" * 20_000, "http://user@example.org/es/", "http://ÀB.Org/É",
]
MORE = (*urlrules.RULES, urlrules.Rule("block", "b.org", "/c"), urlrules.Rule("allow", "org", "/ccccc"), urlrules.Rule("block", "org", "/"), urlrules.Rule("allow", "a'\\b.NET", "/x?"), urlrules.Rule("allow", "net", ""), urlrules.Rule("block", "", "/"))


def plain_rule(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m[1].translate(str.maketrans(urlrules.UPPER, urlrules.LOWER)), m[2]) if m else ("", "")
    fit = [(len(r.host) + len(r.path), len(r.host), r.host.lower() + r.path, r.verdict) for r in rules if r.host and (host == r.host.lower() or host.endswith("." + r.host.lower())) and path.startswith(r.path)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("rules,most", [(urlrules.RULES, 4096), (MORE, 4096), (MORE, 3)])
def test_url_rules(spark, monkeypatch, rules, most):
    monkeypatch.setattr(urlrules, "MOST_SHAPES", most)
    urls = [u for u in URLS if most > 3 or len(u or "") < 1000]
    if most == 3:
        urls.append("http://c.b.org/ccccc/d")
    rows = [(k, u, f"own{k}", k) for k, u in enumerate(urls + urls[4:9])]  # repeated rows
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, found int")
    judged = urlrules.judge(pages, urlrules.rules_table(spark, rules))
    assert judged.columns == ["page_id", "url", "found", "host", "path", "rule", "verdict"]
    same([tuple(r) for r in judged.drop("found").collect()], [(k, u, *plain_rule(u, rules)) for k, u, _, _ in rows])
    assert urlrules.judge(pages.where("false"), urlrules.rules_table(spark, rules)).count() == 0
    assert {tuple(r) for r in urlrules.judge(pages, urlrules.rules_table(spark, rules).where("false")).select("rule", "verdict").collect()} == {(None, "allow")}


def test_url_shapes_bound_the_expressions(spark):
    """A rule of two labels and four characters asks for one expression of a URL, however long it is."""
    urls = spark.createDataFrame([("u", "a." * 5000 + "org", "/abc" * 5000)], "url string, host string, path string")
    assert urlrules.expressions(urls, [(2, 4), (1, 1)]).count() == 2


def test_url_query_equals_its_sql(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(k, u) for k, u in enumerate(URLS)], "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    expected = db.sql(queries.ORACLE_SQL["op12_url_filters"])
    got = queries.op12_url_filters(spark, str(tmp_path))
    same([tuple(r) for r in got.select(*expected.columns).collect()], expected.fetchall())


# 13


@lru_cache(1)
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_alignment(rows, models=None):
    a, b = models or tokenizers()
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    out, count, links_of = [], Counter(), []
    for _, text in rows:
        whole = (" " + (text or "")).encode()
        x = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids] if text else []
        y = [(i, b_bytes(i)) for i in b.encode(text)] if text else []
        if not text or b"".join(t for _, t in x) != whole or b"".join(t for _, t in y) != whole:
            x = y = []
        ends = [np.cumsum([len(t) for _, t in z]).tolist() if z else [] for z in (x, y)]
        groups, links = [], []
        at = [0, 0]
        for e in sorted(set(ends[0]) & set(ends[1])):
            own = []
            for k, z in enumerate((x, y)):
                low = at[k]
                while at[k] < len(z) and ends[k][at[k]] <= e:
                    at[k] += 1
                own.append([i for i, _ in z[low : at[k]]])
            groups.append("|".join(",".join(map(str, g)) for g in own))
            links.append((own[0][-1], own[1][-1]))
        count.update(links)
        links_of.append(links)
        out.append((len(x), len(y), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
    best = {}
    for (_, b_id), n in count.items():
        best[b_id] = max(best.get(b_id, 0), n)
    return [(i, *o[:4], sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links), o[4]) for (i, _), o, links in zip(rows, out, links_of)]


TEXTS = [
    "a  b ", " ", "  ", "\n", "x\n y\n\n  z", "tab\tand\r\nlines ", "<|endoftext|> and <s> </s> <unk> <0x41>", "漢字 😀  naïve café\u00a0noir \u3000x\u2003 y\u2028 z", "a▁b", "▁", "ﬁ ０ ①", "\x00 nul", "it's  we'll 'S don't",
    "x" * 3000 + " y", "é " * 200, "１２３ 456 7,890.12", "\x1c \x1f a\x85 b", "aaaa bbbb " * 50, "ÀÉ ÿ Ā ſ", "русский текст здесь 中文 文本", "  leading", "trailing\u2581 ", "\u1680 x\u205f y\u202f z",
]


@pytest.mark.parametrize("hot", [crosstoken.MOST_HOT, 3, 0])
def test_alignment(spark, docs, no_docs, hot):
    rows = DOCS + [(100 + k, t) for k, t in enumerate(TEXTS)] + [(None, "null ids twice"), (None, "null ids twice")]
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, link int, row int").repartition(3)
    found = crosstoken.counted(table, A, B, most_hot=hot)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    same([tuple(r) for r in found.collect()], plain_alignment(rows))
    if not hot:
        assert crosstoken.counted(no_docs, A, B).count() == 0
        assert crosstoken.counted(docs, A, B).count() == len(DOCS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab 's.é漢😀 　\x1f\u2003Ãà▁\n\t1")), max_size=24), max_size=4))
def test_pieces_align_as_whole_texts(texts):
    own = crosstoken.aligner(A, B)
    assert own.cuts
    found = []
    for n_a, n_b, groups, links, stops in own.aligned(pa.array(texts, pa.string())):
        found += [(x, y, int(n), int(n), hashlib.sha256(g).hexdigest() if g else "") for x, y, g, n in zip(n_a.tolist(), n_b.tolist(), groups, np.diff(stops))]
    assert found == [(*r[1:5], r[7]) for r in plain_alignment(list(enumerate(texts)), tokenizers())]


def test_identity_map_has_the_same_bytes():
    own = crosstoken.aligner(A, B)
    shown = {v: k for k, v in own.a.spelled.items()}
    for i in range(0, len(own.identity), 7):
        if own.identity[i] >= 0:
            assert own.b_bytes[own.identity[i]] == bytes(shown.get(ord(c), ord(c)) for c in own.a.library.id_to_token(i))
    assert (own.identity >= 0).sum() > 10_000
