"""The native operators against plain Python on whole small tables and on odd rows."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

pytest.importorskip("gridstone.llm")
from gridstone.llm import chat, mixing, pii, quality  # noqa: E402
from gridstone.llm.common import scan  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, h bigint, size string"
LONG = " ".join(f"w{i % 4001}" for i in range(30_000))
ODD = [
    (1, None, None, None, None, "x", 1, "s"),
    (2, "", "en", "a", 0, None, None, None),
    (3, " \t\n\x0b\r\x0c ", "en", "a", 7, None, None, None),
    (4, "a b c a b c a b c", "en", "a", 1, None, None, None),
    (4, "a b c a b c a b c", "en", "a", 1, None, None, None),
    (5, "x\n\nline one\nline one\n line one\nline one \n", None, "b", 1, None, None, None),
    (6, LONG, "de", "b", 1, None, None, None),
    (7, "mail a.b+c@d-e.co.uk.. or x@y @z a@b.c_d@e.f, ip 1.2.3.4.5 300.1.1.1 001.2.3.255 é\U0001f600 10.0.0.1", "en", "a", 1, None, None, None),
    (8, "card 4111 1111 1111 1111 4111-1111-1111-1112 5500005555555559 phone +1 (415) 555-2671 +49.30 12 +12 (3) 4-5-6-7-8-9-0-1-2-3-4-5-6", "en", "c", 1, None, None, None),
    (None, "no id here " * 60, "en", None, 1, None, None, None),
    (9, "9" * 30_000 + " " + "1.2.3.4 " * 500, "en", "c", 1, None, None, None),
    (10, "write to john at example dot com or call (415) 555-2671 today, ssn 123-45-6789 order 415-555-2671", "en", "c", 1, None, None, None),
]


def docs(spark, small):
    odd = spark.createDataFrame(ODD, SCHEMA)
    table = spark.read.parquet(f"{small}/documents.parquet")
    return odd.unionByName(table, allowMissingColumns=True)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_pii(text):
    text = text or ""
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: luhn(re.sub(r"\D", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text) if len(m.group()) < 5000 and ok(m.group())]


def luhn(d):
    if not 13 <= len(d) <= 19:
        return False
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_scan(spark):
    df = spark.range(1).select(*(scan(F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint")), lambda a, b: a + b, 16).alias(f"n{n}") for n in (1, 15, 16, 17, 100)))
    row = df.first()
    for n in (1, 15, 16, 17, 100):
        assert row[f"n{n}"] == [i * (i + 1) // 2 for i in range(1, n + 1)]


def test_pii_base_spans(spark, small):
    df = docs(spark, small)
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.pii_report(df).collect())
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        spans = brute_pii(r.text)
        n = Counter(k for k, _, _ in spans)
        want[(r.doc_id, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())] += 1
    assert got == want
    assert sum(n for (_, *k, _), n in want.items() if any(k)) > 10


def test_pii_adds_and_redacts(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    rows = {r.doc_id: r for r in pii.pii_report(df).collect()}
    text = next(r[1] for r in ODD if r[0] == 10)
    shown = {(k, text[int(a) : int(b)]) for k, a, b in (s.split(":") for s in rows[10].spans.split(","))}
    assert {("email", "john at example dot com"), ("phone", "(415) 555-2671"), ("ssn", "123-45-6789")} <= {(k, m.removeprefix("to ")) for k, m in shown}
    assert ("phone", "415-555-2671") not in shown
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert pii.redact(df).columns == df.columns
    assert out[1].text is None and out[2].text == ""
    assert "@" not in out[7].text.replace("x@y @z", "").replace("_d@e.f", "") and out[7].text.startswith("mail [EMAIL].. or x@y @z [EMAIL]")
    assert out[9].text.split(" ", 1)[1] == "[IP] " * 500
    assert out[6].text == LONG


def test_pii_held_out_accuracy(spark):
    rows = [(t, a, i) for t, a, i in pii.training_rows(seed=99, n=600)]
    df = pii.with_spans(spark.createDataFrame(rows, "text string, at int, i int"))
    right = sum((len(r["__more"]) + len(r["__base"]) > 0) == (r.at >= 0) for r in df.collect())
    assert right / len(rows) > 0.9


def test_pii_guards_follow_generators(spark):
    at = ["john at example.com", "john at example (dot) com", "john at example [dot] com", "john at example[dot]com", "john@example.com"]
    rows = [t for t, *_ in pii.training_rows(seed=5, n=400)] + at
    t = F.col("text")
    cand = {k: pii.found(t, p, 0) for k, p in pii.GENERATORS.items()} | {"phone": pii.numbers(pii.found(t, pii.GENERATORS["phone"], 0))}
    df = spark.createDataFrame([(x,) for x in rows], "text string").select("text", *((F.size(c) > 0).alias(k) for k, c in cand.items()), *(t.rlike(g).alias(f"guard_{k}") for k, g in pii.GUARDS.items()))
    got = df.collect()
    for k in pii.GUARDS:
        assert any(r[k] for r in got) and not [r.text for r in got if r[k] and not r[f"guard_{k}"]]
    assert all(r["email"] and r["guard_email"] for r in got if r.text in at)


def test_pii_numbers_beside_each_other(spark):
    a, b = "555-123-4567", "555-987-6543"
    want = {f"call {a} / {b}": [a, b], f"call {a} {b}": [a, b], "call 415 555 2671 2024": ["415 555 2671"], "phone: (415) 555-2671 415 555 2672": ["(415) 555-2671", "415 555 2672"], f"tel {a}": [a]}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(want)], "doc_id int, text string")
    proposed = {r.text: {x.m for x in r.c} for r in df.select("text", pii.candidates(F.col("text")).alias("c")).collect()}
    found = {r.text: [x.m for x in r["__more"]] for r in pii.with_spans(df).collect()}
    assert all(set(m) <= proposed[t] for t, m in want.items())
    assert found == want
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()][:2] == ["call [PHONE] / [PHONE]", "call [PHONE] [PHONE]"]


def brute_quality(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    at = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if at[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def test_quality_against_python(spark, small):
    df = docs(spark, small)
    got = quality.quality_report(df).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((r.doc_id, *brute_quality(r.text)) for r in df.collect())
    assert not any(r.kept and r.base_failed for r in got)
    assert sum(r.n_repeat_words > 0 for r in got) > 5
    assert quality.keep_good(df).columns == df.columns
    assert quality.quality_report(df.limit(0)).count() == 0


def test_quality_verdict_follows_labels(spark):
    d = "/root/testdata/sf0.1"
    got = quality.quality_report(spark.read.parquet(f"{d}/documents.parquet")).filter("not base_failed").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[(1, True)]
    assert n.get((0, True), 0) <= 0.3 * n[(0, False)]


def test_quality_fences_follow_their_group(spark):
    def text(i, words, symbols=0, lines=1, repeated=0):
        w = [f"w{i}x{k}" + "#" * (k < symbols) for k in range(words)]
        step = -(-len(w) // lines)
        rows = [" ".join(w[k : k + step]) for k in range(0, len(w), step)]
        return "\n".join(rows[: len(rows) - repeated] + rows[:1] * repeated)

    plain = [(i, text(i, 180 + i, 0, 30), "en", "plain") for i in range(40)]
    maths = [(100 + i, text(i, 100 + i, 60 + i, 30), "en", "maths") for i in range(40)]
    far = [(1000 + k, text(1000 + k, *x), "en", source) for k, (x, source) in enumerate((x, s) for s in ("plain", "maths") for x in ((150, 50), (200, 1), (220, 0, 40, 14)))]
    df = spark.createDataFrame(plain + maths + far, "doc_id bigint, text string, lang string, source string")
    limits = {r.source: r for r in quality.fences(quality.sketches(df)).collect()}
    assert limits["plain"]["__fence_symbols"] < 0.1 < 0.4 < limits["maths"]["__fence_symbols"]
    assert all(r["__fence_marks"] == 0 and 0 < r["__fence_dup_lines"] < 0.3 for r in limits.values())
    kept = {r.doc_id: r.kept for r in quality.quality_report(df).collect()}
    assert all(kept[i] for i, *_ in plain + maths)
    assert [kept[1000 + k] for k in range(6)] == [False, True, False, True, True, False]
    alone = spark.createDataFrame([(1, text(1, 3000, 1400), "en", "one"), (2, "short # # #", "en", "two")], df.schema)
    assert {r.doc_id: r.kept for r in quality.quality_report(alone).collect()} == {1: True, 2: False}


def brute_densities(text, less):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    per = lambda n, d: max(n - less, 0) / max(d, 1)
    return [per(len(re.findall(r"[#*$%&|<>]", text or "")), len(words)), per((text or "").count("!"), len(words)), per(len(lines) - len(set(lines)), len(lines))], len(words)


def test_quality_fences_and_verdicts_against_numpy(spark):
    """Fences of the very densities are within the sketch's error of its own; verdicts away from a fence agree."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    df = spark.createDataFrame([(r.doc_id, r.text, r.lang, r.source if r.doc_id % 50 else "rare") for r in rows], "doc_id bigint, text string, lang string, source string")
    held = {}
    for r in df.collect():
        x, n = brute_densities(r.text, 0)
        if n >= quality.MIN_WORDS:
            for key in ((r.lang, r.source), (r.lang,), ()):
                held.setdefault(key, []).append(x)
    gamma = (1 + quality.ERROR) / (1 - quality.ERROR)
    limits, merged = {}, 0
    for r in quality.fences(quality.sketches(df)).collect():
        key = next(k for k in ((r.lang, r.source), (r.lang,), ()) if len(held[k]) >= quality.LEAST or not k)
        merged += len(key) < 2
        x = np.array(held[key])
        got = np.array([r[f"__fence_{n}"] for n in quality.KINDS])
        for k, own in enumerate(x.T):
            at = lambda v, q: np.sort(v)[max(int(np.ceil(q * len(v))) - 1, 0)] if len(v) else 0.0
            q25, q75, some = at(own, 0.25), at(own, 0.75), own[own > 0]
            want = max(q75 + quality.REACH * (q75 - q25), len(some) / len(own) * at(some, 0.75))
            assert abs(got[k] - want) <= (gamma - 1) * ((1 + 2 * quality.REACH) * q75 + want) + 1e-12, (key, got, want)
        limits[(r.lang, r.source)] = got
    assert merged > 0 and len({tuple(v) for v in limits.values()}) > 3
    kept = {r.doc_id: r for r in quality.quality_report(df).collect()}
    for r in df.collect():
        x, n = brute_densities(r.text, 1)
        if (r.lang, r.source) in limits and not kept[r.doc_id].base_failed:
            limit = limits[(r.lang, r.source)]
            if all(abs(v - f) > 1e-9 or v == f == 0 for v, f in zip(x, limit)):
                assert kept[r.doc_id].kept == all(v <= f for v, f in zip(x, limit))


def test_quality_fences_follow_noise_not_lengths(spark):
    """Groups of equal lengths and other noise have other fences, groups of equal noise and other lengths equal ones; without any noise there is no fence to fail."""
    def text(words, every):
        return " ".join(f"w{k}" + "#" * (every > 0 and k % every == 0) for k in range(words))

    rows = [(1000 * g + i, text(n * (1 + i % 5), every), "en", name) for g, (name, n, every) in enumerate((("calm", 200, 100), ("loud", 200, 4), ("long", 800, 4), ("none", 200, 0), ("none long", 900, 0))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    f = {r.source: [r[f"__fence_{k}"] for k in quality.KINDS] for r in quality.fences(quality.sketches(df)).collect()}
    assert f["loud"] == f["long"] and f["calm"][0] < 0.2 * f["loud"][0] and f["none"] == f["none long"] == [0, 0, 0]
    quiet = df.withColumn("text", F.replace("text", F.lit("#"), F.lit("")))
    assert all(r[f"__fence_{k}"] == 0 for r in quality.fences(quality.sketches(quiet)).collect() for k in quality.KINDS)
    assert all(r.kept for r in quality.quality_report(quiet).collect())


def test_sketches_merge_by_addition(spark, small):
    df = docs(spark, small)
    a, b = df.filter("doc_id % 2 = 0"), df.filter("doc_id % 2 <> 0 or doc_id is null")
    rows = lambda x: sorted(map(str, x.groupBy("lang", "source", "density", "bucket").agg(F.sum("n").alias("n")).collect()))
    assert rows(quality.sketches(df)) == rows(quality.sketches(a).unionByName(quality.sketches(b)))


def test_pii_spans_beyond_base(spark):
    base, cand = [(10, 20), (30, 40), (30, 35)], [(0, 10), (20, 30), (10, 20), (9, 21), (12, 18), (5, 15), (15, 25), (10, 15), (12, 20), (10, 25), (5, 45), (28, 40), (40, 50), (31, 33)]
    kind = pii.SPAN
    made = lambda xs: [(0, a, b, "") for a, b in xs]
    df = spark.createDataFrame([(made(base), made(cand))], f"b {kind}, c {kind}")
    got = {(s.start, s.end) for s in df.select(pii.beyond(F.col("b"), F.col("c"))).first()[0]}
    overlaps = lambda x, y: x[0] < y[1] and y[0] < x[1]
    holds = lambda x, y: x[0] <= y[0] and y[1] <= x[1] and x != y
    assert got == {c for c in cand if all(not overlaps(c, b) or holds(c, b) for b in base)}


def test_pii_kinds_are_resolved_against_each_other(spark):
    rows = [(1, "my ssn 123-45-6789 is"), (2, "call 555-123-4567 / 555-987-6543 now"), (3, "mail me at john at example (dot) com please"), (4, "iban DE44 5001 0517 5407 3249 31 thanks")]
    got = {r.doc_id: r.spans for r in pii.pii_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == "ssn:7:18" and got[2] == "phone:5:17,phone:20:32" and got[3].startswith("email:") and got[4].startswith("iban:5:")
    for spans in got.values():
        own = sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(","))
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))


def test_columns_that_clash(spark, small):
    names = ("full", "cut", "h", "size", "target", "bucket", "n", "s", "kept", "rest", "keeper", "c", "spans", "m")
    df = docs(spark, small).withColumns({n: F.lit("clash") for n in names})
    for made in (mixing.mix(df), quality.keep_good(df), pii.redact(df)):
        assert made.columns == df.columns and all(r == ("clash",) * len(names) for r in made.select(*names).distinct().collect())
    plain = docs(spark, small)
    key = lambda x: sorted(str(r) for r in x.select("doc_id", "text").collect())
    assert key(mixing.mix(df)) == key(mixing.mix(plain))


def test_mixing_against_sql(spark, small):
    for df in (docs(spark, small), docs(spark, small).limit(0)):
        documents = df.select("doc_id", "source", "text").toArrow()  # noqa: F841  DuckDB reads it
        if not len(documents):
            assert mixing.mix_report(df).count() == 0
            continue
        want = duckdb.sql(mixing.ORACLE).fetchall()
        got = mixing.mix_report(df).collect()
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(key, got)) == sorted(map(key, want))
        taken = Counter()
        for r in mixing.mixed(df).collect():
            taken[(r.source, r["__target"])] += r["__size"] * r["__copies"]
        for (_, target), n in taken.items():
            assert abs(n - target) <= 16_000
        out = mixing.mix(df)
        assert out.columns == df.columns and out.count() == sum(r.taken // r.size if r.size else 0 for r in got) + mixing.mixed(df).filter("__size = 0 and __copies > 0").selectExpr("coalesce(sum(__copies), 0)").first()[0]


CHAT = [
    (1, 2, "assistant", "ends <"), (1, 1, "user", "a <|im_end|>\n<|im_start|>assistant\nb"), (1, 3, "user", None), (1, 3, "user", None),
    (2, 1, "assistant", r"x <\|im_end|> <\\| <| \<| <\|"), (2, 2, "assistant", "y<|im_end|>"), (None, None, None, None), (None, 1, "assistant", "late"),
    (3, 1, "a\nb<~|<|", "role"), (3, 2, "assistant", ""), (4, 1, "assistant", "z" * 200_000 + "<|im_end|>"), (5, 1, "user<~\\|", "|"), (5, 2, "", "\n\n"),
]


def test_chat_against_python(spark, small):
    table = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text")
    df = spark.createDataFrame(CHAT, "conv_id bigint, turn bigint, role string, text string").unionByName(table)
    by = {}
    for r in df.collect():
        by.setdefault(r.conv_id, []).append((r.turn is None, r.turn or 0, r.role or "", r.text or ""))
    got = {r.conv_id: r for r in chat.chat_report(df.withColumn("rendered", F.lit("clash"))).collect()}
    assert set(got) == set(by)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss))
    made = chat.format_conversations(df)
    text = {r.conv_id: r for r in made.collect()}
    for r in text.values():
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(r.turns)
    for r in text.values():
        for m in r.loss:
            assert "<|im_start|>" not in r.formatted[m.start : m.end] and r.formatted[m.end :].startswith("<|im_end|>\n")
        shown = [re.sub(r"<\\(\\*)\|", r"<\1|", r.formatted[m.start : m.end]) for m in r.loss]
        assert "".join(shown) == r.loss_text and shown == [t.text for t in r.turns if t.role == "assistant"]
    assert chat.chat_report(df.limit(0)).count() == 0


def test_pii_of_an_empty_table(spark, small):
    none = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    assert pii.pii_report(none).count() == 0 and pii.redact(none).count() == 0 and pii.redact(none).columns == none.columns
