"""The whole pipeline against a brute-force version, stage by stage, on a small table."""

import re
from collections import Counter

import duckdb
import pytest

pytest.importorskip("gridstone.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from gridstone.llm import mixing, pieces, quality  # noqa: E402
from test_jaccard import brute  # noqa: E402
from test_native import brute_pii, brute_quality  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5 and corpus_pipeline.ORACLE_SQL is None
    (_, good), (_, single), (_, clean), (_, mixed), (_, encoded) = corpus_pipeline.STAGES
    rows = [tuple(r) for r in docs.collect()]

    kept = [tuple(r) for r in good(spark, docs, sf).select(*COLUMNS).collect()]
    verdict = {r.doc_id: r.kept for r in quality.quality_report(docs).collect()}
    assert Counter(kept) == Counter(r for r in rows if verdict[r[0]])
    assert not any(brute_quality(r[1])[-1] for r in kept)

    df = spark.createDataFrame(kept, docs.schema)
    one = [tuple(r) for r in single(spark, df, sf).select(*COLUMNS).collect()]
    firsts = {c for _, n, c in brute([(r[0], r[1]) for r in kept]) if n}
    assert Counter(one) == Counter(r for r in kept if r[0] in firsts)

    df = spark.createDataFrame(one, docs.schema)
    safe = [tuple(r) for r in clean(spark, df, sf).select(*COLUMNS).collect()]
    assert sorted(r[0] for r in safe) == sorted(r[0] for r in one)
    before = {r[0]: r for r in one}
    for r in safe:
        found = brute_pii(before[r[0]][1])
        assert not brute_pii(r[1]) and (r[1] == before[r[0]][1]) <= (not found) and r[2:] == before[r[0]][2:]

    df = spark.createDataFrame(safe, docs.schema)
    mix = [tuple(r) for r in mixed(spark, df, sf).select(*COLUMNS).collect()]
    documents = df.toArrow()  # noqa: F841  DuckDB reads it
    taken = {i: t // s if s else 0 for i, s, _, _, t in duckdb.sql(mixing.ORACLE).fetchall()}
    assert Counter(mix) == Counter({r: taken[r[0]] for r in safe if taken[r[0]]})

    out = encoded(spark, spark.createDataFrame(mix, docs.schema), sf).collect()
    with open(pieces.MODEL, "rb") as f:
        codec = pieces.Codec(f.read())
    texts = {r[0]: r[1] for r in mix}
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in mix)
    assert all(r.lossless and codec.decode(r.pieces) == texts[r.doc_id] and r.n_pieces == len(r.pieces) for r in out)


def test_run_and_odd_rows(spark, tmp_path):
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "x " * 80, "en", "a", 3), (4, "word " * 3, None, "b", 2), (5, " ".join(f"w{i}" for i in range(300)), "en", None, 1), (5, " ".join(f"w{i}" for i in range(300)), "en", None, 1), (None, " ".join(f"v{i}" for i in range(90)), "en", "a", 1), (6, " ".join(f"u{i} +1 (415) 555-2671" for i in range(60)), "en", "a", 1)]
    for name, rows in (("some", odd), ("none", [])):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
        got = corpus_pipeline.run(spark, path).collect()
        assert all(r.lossless for r in got)
        assert set(r.doc_id for r in got) <= {5, None, 6}
        assert re.match("some|none", name) and (bool(got) == bool(rows))


def test_stages_with_long_texts_and_clashing_columns(spark):
    """Nulls, an empty text, one of 40,000 words with copies, and columns named as the stages' own ones."""
    long = " ".join(f"w{i}" for i in range(40_000))
    plain = lambda k: " ".join(f"t{k}x{i}" for i in range(120))
    rows = [(1, long, "en", "a"), (2, long + " end", "en", "a"), (3, plain(3) + " write to jo@example.org", "en", "b"), (3, plain(3) + " write to jo@example.org", "en", "b"), (4, None, None, None), (5, "", "en", "a"), (None, plain(6), None, None), (7, plain(7), "de", "b")]
    names = ["h", "size", "kept", "row", "words", "n", "component_id", "copies", "pieces", "lossless", "target", "spans"]
    df = spark.createDataFrame([(*r, 1, *range(len(names))) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} int" for n in names))
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, "")
        assert set(df.columns) >= {*COLUMNS, *names}
        df = spark.createDataFrame(df.collect(), df.schema)
        seen.append(Counter(r.doc_id for r in df.collect()))
        assert all([r[n] for n in names] == list(range(len(names))) for r in df.collect())
    assert seen[0] == Counter([1, 2, 3, 3, None, 7]) and seen[1] == Counter([1, 3, None, 7]) and seen[2] == seen[1]
    assert not any("jo@example.org" in r.text for r in df.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, df, "").collect()
    assert all(r.lossless for r in last) and len(last) == df.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), "").count() == 0
