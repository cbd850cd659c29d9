"""Personal data by candidate gradient boosting (native).

Base spans come from fixed patterns and validators. Beside them, high-recall
generators propose further spans: written-out e-mail addresses, telephone numbers
without a plus, social security numbers, IBANs. Telephone numbers are proposed from every
group of digits to every later one in reach, so that one beside other numbers is among
them. Boosted trees score each by its format and context; the scores are calibrated, and a
threshold a kind, set for PRECISION on held-out rows, selects what is kept. Of those, of
any kind, that overlap the most probable stays. The base spans always stay; candidates
must add to them (see beyond).

The trees are fitted on the driver on TRAINING_ROWS texts made by rule from a fixed
seed (the only bound of the operator); features of training rows and of documents
come from the same column expressions.

Defined cases: a null text is empty and has no spans; repeated rows each get a row;
an empty table gives an empty result; other columns are left alone. Positions are
code points, ends exclusive.
"""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import fixed, let, scan

#: The base patterns. A possessive quantifier stands where nothing after it could take back what it took.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Generators of further candidates.
GENERATORS = {
    "email": r"(?i)\b[a-z0-9._%+-]{1,64} ?(?:@|[\[({] ?at ?[\])}]| at ) ?[a-z0-9-]{1,63}(?: ?(?:\.|[\[({] ?dot ?[\])}]| dot ) ?[a-z0-9-]{2,63}){1,4}",
    "phone": r"(?<![0-9A-Za-z.+-])\(?+[0-9]++(?![A-Za-z])(?:[() ./-]++[0-9]++(?![A-Za-z]))*+",  # a region, see numbers()
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
}
#: A telephone number has so many characters and digits.
WIDTH, DIGITS = 20, (7, 15)
#: Texts that can hold a candidate at all: every candidate implies its guard.
GUARDS = {"email": r"(?i)@|\bat\b", "phone": r"[0-9](?:[() ./-]*+[0-9]){6}", "ssn": r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}", "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"}
KINDS = (*PATTERNS, "ssn", "iban")
#: Cue words before a candidate.
CUES = {
    "contact": r"(?i)(?:tel|phone|call|fax|mobil|móvil|cell|ruf|appel|contact|whatsapp|sms|mail|write|reach|llam)",
    "identity": r"(?i)(?:ssn|social|security|tax|iban|bank|account|konto|compte|cuenta|passport)",
    "other": r"(?i)(?:order|invoice|ref|version|isbn|page|seite|part|model|sku|ticket|bestell|pedido|commande|build|issue|serial|chapter|room|score|code|token|hash|uuid)",
}
CONTEXT = 28
TRAINING_ROWS, SEED, PRECISION, TREES = 3000, 7, 0.98, 60
SPAN = "array<struct<kind:int,start:int,end:int,m:string>>"


def found(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost non-overlapping matches, as SPAN. The pieces between matches give their places."""
    what = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(ms: Column) -> Column:
        widths = F.flatten(F.transform(F.split(text, pattern, -1), lambda p, i: F.array(F.length(p).cast("bigint"), F.coalesce(F.length(F.get(ms, i)), F.lit(0)).cast("bigint"))))
        return let(widths, lambda w: let(scan(w, lambda a, b: a + b), lambda at: F.transform(ms, lambda m, i: F.struct(F.lit(kind).alias("kind"), F.get(at, 2 * i).cast("int").alias("start"), F.get(at, 2 * i + 1).cast("int").alias("end"), m.alias("m")))))

    return let(what, spans)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans of each kind, as SPAN."""
    none = F.expr(f"cast(array() as {SPAN})")
    digits = text.rlike("[0-9]")
    guards = {"email": text.contains("@"), "ip": digits & text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), "card": digits & text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": text.contains("+") & text.rlike(r"\+[0-9][\x20().0-9-]+[0-9]")}
    valid = {
        "email": None,
        "ip": lambda s: s["m"].rlike(rf"\A{BYTE}(?:\.{BYTE}){{3}}\z"),
        "card": lambda s: F.when(F.length(_digits(s["m"])).between(13, 19), F.call_function("luhn_check", _digits(s["m"]))).otherwise(F.lit(False)),
        "phone": lambda s: F.length(_digits(s["m"])).between(9, 15),
    }
    out = {}
    for k, (name, pattern) in enumerate(PATTERNS.items()):
        spans = found(text, pattern, k)
        out[name] = F.when(guards[name], spans if valid[name] is None else F.filter(spans, valid[name])).otherwise(none)
    return out


def candidates(text: Column) -> Column:
    """What the generators propose, as SPAN."""
    none = F.expr(f"cast(array() as {SPAN})")
    each = []
    for name, pattern in GENERATORS.items():
        spans = found(text, pattern, KINDS.index(name))
        each.append(F.when(text.rlike(GUARDS[name]), numbers(spans) if name == "phone" else spans).otherwise(none))
    return F.concat(*each)


def numbers(regions: Column) -> Column:
    """Overlapping telephone numbers of regions, which are groups of digits with separators: every run of groups that has WIDTH and DIGITS, with a bracket before it."""
    kind = KINDS.index("phone")

    def span(r: Column, w: Column, a: Column, b: Column) -> Column:
        bracket = w.startswith("(").cast("int")
        m = w.substr(2 - bracket, b["end"] - a["start"] + bracket)
        return F.struct(F.lit(kind).alias("kind"), (r["start"] + a["start"] - bracket).alias("start"), (r["start"] + b["end"]).alias("end"), m.alias("m"))

    fits = lambda s: (F.length(s["m"]) <= WIDTH) & F.length(_digits(s["m"])).between(*DIGITS)
    # a long region is cut once a group: the character before the group and what is in reach
    around = lambda r, a: F.when(a["start"] == 0, F.concat(F.lit(" "), r["m"].substr(F.lit(1), F.lit(WIDTH)))).otherwise(r["m"].substr(a["start"], F.lit(WIDTH + 1)))
    near = lambda g, a, i: F.filter(F.slice(g, i + 1, F.lit(WIDTH // 2)), lambda b: b["end"] - a["start"] <= WIDTH)
    runs = lambda r, g: F.flatten(F.transform(g, lambda a, i: let(around(r, a), lambda w: F.filter(F.transform(near(g, a, i), lambda b: span(r, w, a, b)), fits))))
    rich = F.filter(regions, lambda r: F.length(_digits(r["m"])) >= DIGITS[0])
    return F.flatten(F.transform(rich, lambda r: let(found(r["m"], "[0-9]+", kind), lambda g: runs(r, g))))


def beyond(base: Column, cand: Column) -> Column:
    """The candidates that add to the base spans: those that none of them overlaps, and those that hold every one they overlap whole and more.

    That is: no base span crosses the candidate's start or its end, and none is equal to it. Sorted together, running
    maxima tell all three. Not quadratic.
    """
    tag = lambda xs, c, at: F.transform(xs, lambda s: F.struct(at(s).alias("at"), F.lit(c).alias("c"), s.alias("s")))
    wide = lambda s: s["start"].cast("bigint") * (1 << 31) + s["end"]
    ways = [
        # order, whether candidates come before base spans at the same place, what base spans are remembered by, when a candidate passes
        (lambda s: s["start"].cast("bigint"), True, lambda s: s["end"].cast("bigint"), lambda top, s: top <= s["start"]),
        (lambda s: -s["end"].cast("bigint"), True, lambda s: -s["start"].cast("bigint"), lambda top, s: top <= -s["end"]),
        (wide, False, wide, lambda top, s: top != wide(s)),
    ]

    def filtered(first: bool, kept, passes):
        mark = F.lit(0 if first else 1)
        tops = lambda ts: scan(F.transform(ts, lambda t: F.when(t["c"] == mark, F.lit(-(1 << 62)).cast("bigint")).otherwise(kept(t["s"]))), lambda a, b: F.greatest(a, b))
        return lambda ts: let(tops(ts), lambda m: F.transform(F.filter(ts, lambda t, i: (t["c"] == mark) & passes(F.get(m, i), t["s"])), lambda t: t["s"]))

    for at, first, kept, passes in ways:
        cand = let(F.sort_array(F.concat(tag(base, int(first), at), tag(cand, int(not first), at))), filtered(first, kept, passes))
    return cand


def resolved(spans: Column) -> Column:
    """Of spans with p those that no more probable (then longer, then earlier) kept one overlaps. Chains of overlapping spans are resolved one by one."""
    rank = lambda s: F.struct((-s["p"]).alias("p"), (s["start"] - s["end"]).alias("w"), s["start"].alias("start"), s["s"].alias("s"))
    meets = lambda a, b: (a["s"]["start"] < b["s"]["end"]) & (b["s"]["start"] < a["s"]["end"])
    none = lambda c: F.slice(c, 1, 0)
    best = lambda chain: let(F.sort_array(F.transform(chain, rank)), lambda c: F.aggregate(c, none(c), lambda acc, s: F.when(F.exists(acc, lambda k: meets(k, s)), acc).otherwise(F.concat(acc, F.array(s)))))

    def chains(ss: Column, tops: Column) -> Column:
        heads = F.filter(F.transform(ss, lambda s, i: F.when((i == 0) | (s["start"] >= F.get(tops, i - 1)), i)), lambda i: i.isNotNull())
        return let(heads, lambda h: F.flatten(F.transform(h, lambda i, k: best(F.slice(ss, i + 1, F.coalesce(F.get(h, k + 1), F.size(ss)) - i)))))

    one = let(F.sort_array(spans), lambda ss: let(scan(F.transform(ss, lambda s: s["end"].cast("bigint")), lambda a, b: F.greatest(a, b)), lambda tops: chains(ss, tops)))
    return F.transform(one, lambda x: x["s"])


def features(text: Column, s: Column) -> Column:
    """Format and context of a candidate: array<double>."""
    m = s["m"]
    count = lambda p: (F.length(m) - F.length(F.regexp_replace(m, p, ""))).cast("double")
    before = text.substr(F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT)))
    after = text.substr(s["end"] + 1, F.lit(8))
    groups = F.split(m, "[^0-9A-Za-z]+")
    flag = lambda c: c.cast("double")
    return F.array(
        s["kind"].cast("double"), count("[0-9]"), F.length(m).cast("double"), count("[() -]"), count(r"\."), count("[()]"), count("[A-Za-z]"),
        F.size(groups).cast("double"), F.length(F.get(groups, F.lit(0))).cast("double"), F.length(F.element_at(groups, -1)).cast("double"),
        F.aggregate(groups, F.lit(99), lambda a, g: F.least(a, F.length(g))).cast("double"),
        *(flag(before.rlike(c)) for c in CUES.values()),
        flag(m.rlike(r"(?i)\bat\b|@")), flag(m.rlike(r"(?i)\bdot\b")), flag(m.rlike(r"(?:19|20)[0-9]{2}")), flag(before.rlike(r"[\"'=#$€£:]\s?\z")),
        flag(before.rlike(r"[0-9][() ./-]*\z")), flag(before.rlike(r"[0-9][./-]\z")), flag(after.rlike(r"\A[() ./-]*[0-9]")), flag(after.rlike(r"\A[./-][0-9]")),
    )


def training_rows(seed: int = SEED, n: int = TRAINING_ROWS) -> list[tuple[str, int, int]]:
    """(text, where the first true span starts or -1, the number of the row)."""
    return [(text, spans[0][0] if spans else -1, i) for text, spans, i in training_texts(seed, n)]


def training_texts(seed: int = SEED, n: int = TRAINING_ROWS) -> list[tuple[str, list[tuple[int, int]], int]]:
    """(text, its true spans, the number of the row), by rule: half hold personal data, half what only looks so."""
    rnd = random.Random(seed)
    num = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice(["an", "er", "on", "la", "que", "ung", "sch", "os", "ti", "re"]) for _ in range(rnd.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    block = lambda k: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k))
    at, dot = lambda: rnd.choice(["(at)", "[at]", " at ", " [at] ", " (at) "]), lambda: rnd.choice(["(dot)", "[dot]", " dot ", " [dot] "])
    phone = lambda: rnd.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(2)} {num(7)}", f"{num(3)} {num(3)} {num(4)}", f"0{num(4)}/{num(6)}"])
    cue = lambda: rnd.choice(["tel ", "phone: ", "call ", "fax ", "mobile ", "Telefon ", "appel ", "llame al "])
    # what comes before, a true span, then by turns what is between and a further true span
    true = [
        lambda: (rnd.choice(["mail ", "write to ", "contact ", ""]), f"{word()}{at()}{word()}{dot()}{rnd.choice(['com', 'org', 'net', 'de', 'fr'])}"),
        lambda: (cue(), phone()),
        lambda: (rnd.choice([cue(), ""]), phone(), rnd.choice([" / ", " ", "/", ", ", " - "]), phone()),
        lambda: (cue(), phone(), f" {rnd.choice([rnd.randint(1990, 2030), num(2), num(4)])}"),
        lambda: ("", rnd.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}"])),
        lambda: (rnd.choice(["ssn ", "social security ", "SSN: ", ""]), f"{num(3)}-{num(2)}-{num(4)}"),
        lambda: (rnd.choice(["iban ", "bank account ", "Konto ", ""]), f"{rnd.choice(['DE', 'FR', 'ES', 'GB'])}{num(2)} " + " ".join(num(4) for _ in range(rnd.randint(3, 5)))),
    ]
    false = [
        lambda: (rnd.choice(["look ", "we met ", ""]), f"{word()} at {word()} dot {word()}"),
        lambda: (rnd.choice(["order ", "invoice ", "ref ", "ticket ", "part ", "serial "]), rnd.choice([num(9), f"{num(4)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(2)}-{num(6)}"])),
        lambda: (rnd.choice(["version ", "build ", "", "chapter "]), f"{num(1)}.{num(1)}.{num(3)}.{num(4)}"),
        lambda: (rnd.choice(["on ", "", "since "]), f"{rnd.randint(1900, 2030)}-{num(2)}-{num(2)}"),
        lambda: (rnd.choice(["from ", "", "pages "]), f"{rnd.randint(1900, 2030)}-{rnd.randint(1900, 2030)}"),
        lambda: ("", num(rnd.randint(7, 15))),
        lambda: ("", " ".join(num(rnd.randint(1, 3)) for _ in range(rnd.randint(4, 6)))),
        lambda: ("", ".".join(num(rnd.randint(1, 3)) for _ in range(4))),
        lambda: (rnd.choice(["isbn ", "sku ", "model ", "order code "]), rnd.choice([f"{num(3)}-{num(2)}-{num(4)}", f"{num(3)}-{num(1)}-{num(2)}-{num(6)}"])),
        lambda: (rnd.choice(["token ", "hash ", "code ", "serial "]), f"{block(2).translate(str.maketrans('0123456789', 'ABCDEFGHIJ'))}{num(2)}{block(rnd.randint(8, 20))}"),
    ]
    rows = []
    for i in range(n):
        lead, *parts = rnd.choice((true, false)[i % 2])()
        text, spans = f"{prose(rnd.randint(0, 6))} {lead}", []
        for k, part in enumerate(parts):
            if i % 2 == 0 and k % 2 == 0:
                spans.append((len(text), len(text) + len(part)))
            text += part
        rows.append((f"{text} {prose(rnd.randint(0, 6))}.", spans, i))
    return rows


def fit_model(spark: SparkSession) -> dict:
    """Trees, calibration and the threshold of each kind. Rows with i % 3 == 2 are held out for the last two."""
    rows = training_texts()
    df = spark.createDataFrame([(text, i) for text, _, i in rows], "text string, i int")
    df = df.select("i", F.col("text"), F.explode(candidates(F.col("text"))).alias("s"))
    got = df.select("i", F.col("s.start").alias("start"), F.col("s.end").alias("end"), features(F.col("text"), F.col("s")).alias("x")).collect()
    x = np.array([r.x for r in got])
    y = np.array([float(any(abs(r.start - a) <= 1 and r.end == b for a, b in rows[r.i][1])) for r in got])
    held = np.array([r.i // 2 % 3 == 2 for r in got])
    trees = boosting.fit(x[~held], y[~held], TREES)
    a, b = boosting.platt(boosting.predict(trees, x[held]), y[held])
    p = 1 / (1 + np.exp(-(a * boosting.predict(trees, x[held]) + b)))
    limits = {}
    for kind in {KINDS.index(g) for g in GENERATORS}:
        own = x[held][:, 0] == kind
        # equal scores pass together: only the last row of each can be a limit
        order = np.argsort(-p[own], kind="stable")
        score, right = p[own][order], np.cumsum(y[held][own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero((right >= PRECISION) & (np.append(score[1:], -1.0) < score))
        limits[kind] = _between(score, good[-1]) if len(good) else 1.1
    return {"trees": trees, "a": a, "b": b, "limits": limits, "held": (x[held][:, 0], p, y[held])}


def _between(score: np.ndarray, k: int) -> float:
    """The threshold under score[k], half way in log-odds to the next lower one: what scores a hair less than the held-out rows passes too."""
    odds = np.log(np.clip(score, 1e-12, 1 - 1e-12)) - np.log1p(-np.clip(score, 1e-12, 1 - 1e-12))
    low = odds[k + 1] if k + 1 < len(odds) else min(odds[k], 0.0)
    return float(1 / (1 + np.exp(-(odds[k] + low) / 2)))


@functools.lru_cache(maxsize=4)
def _model(spark: SparkSession) -> dict:
    return fit_model(spark)


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with __base and __more (SPAN): base spans by kind, then start; spans that the trees add, by kind, then start."""
    model = _model(docs.sparkSession)
    df = docs.withColumn("__t", F.coalesce("text", F.lit("")))
    df = fixed(df, __base=F.concat(*base_spans(F.col("__t")).values()), __cand=candidates(F.col("__t")))
    p = lambda x: 1 / (1 + F.exp(-(model["a"] * boosting.column(model["trees"], lambda j: F.get(x, F.lit(j))) + model["b"])))
    limit = lambda s: F.element_at(F.array(*(F.lit(model["limits"].get(k, 1.1)) for k in range(len(KINDS)))), s["kind"] + 1)
    # what a candidate adds doesn't depend on its score: the others needn't be scored
    adds = F.when(F.size("__base") == 0, F.col("__cand")).otherwise(beyond(F.col("__base"), F.col("__cand")))
    scored = F.transform(adds, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), let(features(F.col("__t"), s), p).alias("p"), s.alias("s")))
    kept = let(F.filter(scored, lambda x: x["p"] >= limit(x["s"])), lambda xs: F.sort_array(resolved(xs)))
    none = F.expr(f"cast(array() as {SPAN})")
    return fixed(df, __more=F.when(F.size("__cand") > 0, kept).otherwise(none)).drop("__cand")


def pii_report(docs: DataFrame) -> DataFrame:
    df = with_spans(docs.select("doc_id", "text"))
    shown = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    line = lambda spans: F.array_join(F.transform(spans, shown), ",")
    every = F.when(F.size("__more") == 0, F.col("__base")).otherwise(F.sort_array(F.concat("__base", "__more")))
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("bigint")
    return df.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(PATTERNS)), F.sha2(line("__base").cast("binary"), 256).alias("base_sha256"), line(every).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; overlapping spans become one, named after the first."""
    columns = docs.columns
    df = with_spans(docs)
    spans = F.sort_array(F.transform(F.concat("__base", "__more"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def rebuilt(ss: Column) -> Column:
        def pieces(tops: Column) -> Column:
            cut = lambda i: F.coalesce(F.get(tops, i - 1), F.lit(0).cast("bigint")).cast("int")  # noqa: E731  where what is kept before span i begins
            name = lambda s: F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)), F.lit("]"))
            kept = lambda s, i: F.when((s["start"] < cut(i)) & (i > 0), F.lit("")).otherwise(F.concat(F.col("__t").substr(cut(i) + 1, s["start"] - cut(i)), name(s)))
            return F.concat(F.array_join(F.transform(ss, kept), ""), F.col("__t").substr(F.element_at(tops, -1).cast("int") + 1, F.length("__t")))

        return let(scan(F.transform(ss, lambda s: s["end"].cast("bigint")), lambda a, b: F.greatest(a, b)), pieces)

    text = F.when(F.size("__base") + F.size("__more") == 0, F.col("text")).otherwise(let(spans, rebuilt))
    return df.withColumn("text", text).select(*columns)
