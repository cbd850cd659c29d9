"""Importance resampling, decontamination and fill-in-middle against plain Python on whole small tables and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("gridstone.llm")
from gridstone.llm import decontaminate, fim, importance  # noqa: E402

SCHEMA = "doc_id bigint, text string, h bigint, w string, row string, n string, form string, rank string"
LONG = " ".join(f"Wörd{i % 997}" for i in range(21_000))
SHARED = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
ODD = [
    (1, None), (2, ""), (3, " \n.,;:!? "), (4, "A"), (4, "A"), (5, "one two"), (6, LONG), (7, f"before {SHARED.upper()}, after <P> it"), (7, f"before {SHARED.upper()}, after <P> it"),
    (None, "no id of its own " * 9), (8, SHARED.replace(" ", "\x00\n") + " é" + SHARED[:40]), (9, "漢字 かな " * 30), (10, "a a a a a a a a a a a a a a a a a a a a a a a"), (11, "x" * 40_000 + " yes no"), (12, "9" * 300), (13, "É É é é İ ß"),
]
ITEMS = [("1", SHARED), ("2", " ".join(SHARED.split()[4:16])), ("2", "one two"), ("3", None), ("4", "..."), ("5", "a a a a a a a a a a a"), (None, "before alpha"), ("6", "yes"), ("7", "wörd1 wörd2 wörd3 wörd4 wörd5 wörd6 wörd7"), ("8", "never seen words here"), ("9", SHARED)]


def words(text):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def odd(spark):
    return spark.createDataFrame([(i, t, 1, "x", None, "y", "z", "0") for i, t in ODD], SCHEMA).repartition(3)


def tables(spark, small):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    return docs, bench


# --- importance resampling -------------------------------------------------------------------


def brute_importance(rows, target):
    grams = lambda t: [" ".join(w[i : i + k]) for w in [words(t)] for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    own = [[bucket(f) for f in grams(t)] for _, t in rows]
    s, t = Counter(b for o in own for b in o), Counter(bucket(f) for x in target for f in grams(x))
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10_000) / ((s[b] + 1) * (nt + 10_000)))) for b in s}
    out = []
    for (i, text), o in zip(rows, own):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in o)
        out.append([i, len(o), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


def test_importance_equals_brute_force(spark, small, monkeypatch):
    docs, bench = tables(spark, small)
    both = docs.select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in both.collect()]
    want = brute_importance(rows, [r.text for r in bench.collect()])
    for stretch in (importance.STRETCH, 50):  # texts of more than 100 characters in stretches of 50 words
        monkeypatch.setattr(importance, "STRETCH", stretch)
        assert Counter(tuple(r) for r in importance.importance_report(both, bench).collect()) == want
    assert sum(1 for r in want if r[4]) >= 9


def test_importance_of_clashing_names_and_empty_tables(spark, small):
    _, bench = tables(spark, small)
    got = importance.importance_report(odd(spark), bench)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and got.count() == len(ODD)
    assert importance.importance_report(odd(spark).filter("doc_id > 99"), bench).count() == 0
    none = importance.importance_report(odd(spark), bench.filter("item_id < 0")).collect()
    assert Counter((r.doc_id, r.weight) for r in none) == Counter((i, w) for i, _, w, _, _ in brute_importance(ODD, []).elements())


def test_resample_keeps_whole_rows(spark, small):
    docs, bench = tables(spark, small)
    rank = {r.doc_id for r in importance.importance_report(docs, bench).filter("rank is not null").collect()}
    got = importance.resample(docs, bench)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == rank and got.count() == len(rank)
    assert importance.resample(odd(spark), bench, percent=100).count() == sum(len(words(t)) >= 20 for _, t in ODD)


# --- decontamination ---------------------------------------------------------------------------


def brute_leaks(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if w else []:
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = Counter()
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if own := windows.get(tuple(w[at : at + n])):
                    hit |= set(range(at, at + n))
                    found |= {x for x in own if x is not None}
        out[(i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    return out


@pytest.mark.parametrize(("small_rows", "piece", "bits"), [(200_000, 256, 1 << 23), (0, 12, 1 << 12), (0, 256, 64)])
def test_leaks_equal_brute_force(spark, small, monkeypatch, small_rows, piece, bits):
    """Broadcast and shuffled joins, short pieces, and a map so full that it hides nothing."""
    monkeypatch.setattr(decontaminate, "SMALL", small_rows)
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    monkeypatch.setattr(decontaminate, "MOST_BITS", bits)
    docs, bench = tables(spark, small)
    both = docs.select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    items = bench.selectExpr("cast(item_id + 100 as string) as item_id", "text").unionByName(spark.createDataFrame(ITEMS, "item_id string, text string"))
    want = brute_leaks([(r.doc_id, r.text) for r in both.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert Counter(tuple(r) for r in decontaminate.leak_report(both, items).collect()) == want
    assert sum(n for r, n in want.items() if r[5]) >= 8 and any(r[3] > 1 for r in want)


def test_leaks_of_long_items_only(spark, small):
    docs, bench = tables(spark, small)
    want = brute_leaks([(r.doc_id, r.text) for r in docs.collect()], [(str(r.item_id), r.text) for r in bench.collect()])
    assert Counter(tuple(r) for r in decontaminate.leak_report(docs, bench).collect()) == want


def test_leaks_of_clashing_names_and_empty_tables(spark):
    items = spark.createDataFrame([(*i, "q", "r") for i in ITEMS], "item_id string, text string, n string, h string")
    got = decontaminate.leak_report(odd(spark), items)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"] and Counter(tuple(r) for r in got.collect()) == brute_leaks(ODD, ITEMS)
    assert decontaminate.leak_report(odd(spark).filter("doc_id > 99"), items).count() == 0
    for none in (items.filter("item_id = '99'"), items.filter("item_id in ('3', '4')")):
        assert not any(r.contaminated or r.n_items for r in decontaminate.leak_report(odd(spark), none).collect())


def test_clean_keeps_whole_rows(spark):
    items = spark.createDataFrame([("1", SHARED)], "item_id string, text string")
    kept = decontaminate.clean(odd(spark), items)
    assert kept.columns == odd(spark).columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in ODD if i not in (7, 8))
    assert Counter(r.doc_id for r in decontaminate.clean(odd(spark), items, most=0.9).collect()) == Counter(i for i, _ in ODD)  # a few words around it stay


# --- fill-in-middle -------------------------------------------------------------------------------


def brute_fim(text, key, seed=1):
    w = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(w)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_cut_equals_brute_force():
    rnd = random.Random(3)
    parts = ["a", "Zq", "\x00", "é", "<", "P>", "<S", "<S>", " ", "\n", "漢", "\U0001f600", "9", "\x7f", "?"]
    for k in range(8000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))
        assert fim.cut(text, str(k), 1) == brute_fim(text, str(k))


def test_fim_report_and_texts(spark, small, monkeypatch):
    docs, _ = tables(spark, small)
    both = docs.select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    rows = [(r.doc_id, r.text or "") for r in both.collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for i, t in rows:
        *head, out = brute_fim(t, "" if i is None else i)
        want[(i, *head, sha(out), sha(t))] += 1
    for size in (fim.SLICE, 1):
        monkeypatch.setattr(fim, "SLICE", size)
        assert Counter(tuple(r) for r in fim.fim_report(both).collect()) == want
    assert {"plain", "psm", "spm"} == {r[2] for r in want}
    got = fim.fill_in_middle(odd(spark), seed=5)
    assert got.columns == ["doc_id", "h", "w", "row", "rank", "text", *fim.ADDED]
    back = got.withColumn("again", fim.restored(got.output, got.form)).collect()
    assert all(r.again == (r.text or "") and r.h == 1 and r.rank == "0" for r in back) and len(back) == len(ODD)
    assert fim.fim_report(odd(spark).filter("doc_id > 99")).count() == 0
