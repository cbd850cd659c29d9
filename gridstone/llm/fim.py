"""Fill-in-middle by an Aho-Corasick scan of events.

A text's units are its runs of ASCII letters and its other code points, one by one. An
automaton, built once a worker, finds the places where an ASCII letter stands beside
another ASCII character, and the sentinels. Other characters count as one ASCII
character that is no letter, at the same offset, so that the scan needs no tables of
Unicode. Between two events all characters are of one class: letters make one unit,
others as many as they are. Running sums over the events, far fewer than characters,
give the offset of any unit by bisection; no unit is ever cut out to be counted.

A row is handled on its own, in Arrow batches handed on in slices of some SLICE
characters; memory is that of the longest text. Defined cases: a null text counts as
empty; an empty text, or one with a sentinel, stays plain; a null doc_id is drawn as an
empty one; repeated rows are cut alike; an empty table gives an empty result; other
columns stay, but for those named as the ones that are added.
"""

from __future__ import annotations

import functools
import hashlib
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of prefix, suffix and middle; the percentages of texts that are cut and, of these, with the suffix first.
SENTINELS = ("<P>", "<S>", "<M>")
CUT_PERCENT, SPM_PERCENT = 90, 20
SLICE = 1 << 20
CHANGE, SENTINEL = 0, 1
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]


@functools.lru_cache(maxsize=1)
def automaton():
    """Finds each ASCII letter beside another ASCII character, and the sentinels."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for other in map(chr, range(128)):
        if other not in string.ascii_letters:
            for letter in string.ascii_letters:
                found.add_word(letter + other, CHANGE)
                found.add_word(other + letter, CHANGE)
    for mark in SENTINELS:
        found.add_word(mark, SENTINEL)
    found.make_automaton()
    return found


class Units:
    """The units of a text by its events: n, whether it has a sentinel, and the offset at which a unit begins."""

    def __init__(self, text: str):
        plain = text if text.isascii() else text.encode("ascii", "replace").decode("ascii")
        events = np.fromiter((2 * end + kind for end, kind in automaton().iter(plain)), np.int64)
        self.sentinel = bool((events & 1 == SENTINEL).any())
        self.edges = np.concatenate([[0], events[events & 1 == CHANGE] >> 1, [len(plain)]])
        gap = np.diff(self.edges)
        first = plain[:1] in string.ascii_letters
        self.letters = (np.arange(len(gap)) % 2 == 0) == first
        self.upto = np.concatenate([[0], np.cumsum(np.where(self.letters, np.minimum(gap, 1), gap))])
        self.n = int(self.upto[-1])

    def offset(self, k: int) -> int:
        """Code points before unit k, or all for k = n."""
        if k >= self.n:
            return int(self.edges[-1])
        gap = int(np.searchsorted(self.upto, k, "right")) - 1
        return int(self.edges[gap]) + (0 if self.letters[gap] else k - int(self.upto[gap]))


def cut(text: str, key: str, seed: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of a text."""
    units = Units(text)
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or units.sentinel or h3 % 100 >= CUT_PERCENT:
        return units.n, "plain", None, None, text
    a, b = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    i, j = units.offset(a), units.offset(b)
    p, s, m = SENTINELS
    if h4 % 100 < SPM_PERCENT:
        return units.n, "spm", i, j - i, s + text[j:] + p + text[:i] + m + text[i:j]
    return units.n, "psm", i, j - i, p + text[:i] + s + text[j:] + m + text[i:j]


def fill_in_middle(docs: DataFrame, seed: int = 1, key: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output, the rearranged text; without text on request."""
    others = [c for c in docs.columns if c != "text" and c not in ADDED]
    used = docs.select(F.col(key).cast("string").alias("__key"), F.col("text").alias("__text"), F.struct(*others).alias("__row"))
    made = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches):
        for batch in batches:
            begin, size, rows = 0, 0, []
            texts, keys = batch.column(1), batch.column(0)
            for k in range(batch.num_rows):
                text = texts[k].as_py() or ""
                rows.append(cut(text, keys[k].as_py() or "", seed))
                size += len(text)
                if size >= SLICE or k == batch.num_rows - 1:
                    arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows), made)]
                    kept = [texts.slice(begin, len(rows))] * keep_text
                    yield pa.RecordBatch.from_arrays([batch.column(2).slice(begin, len(rows)), *kept, *arrays], ["__row", *["text"] * keep_text, *made.names])
                    begin, size, rows = k + 1, 0, []

    row = used.schema["__row"].dataType.simpleString()
    out = used.mapInArrow(run, f"__row {row}, " + "text string, " * keep_text + "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return out.select("__row.*", *["text"] * keep_text, *ADDED)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: what stands between the sentinels, put back in order."""
    part = F.split(output, "<[PSM]>", -1)
    psm, spm = (F.concat(part[i], part[3], part[j]) for i, j in ((1, 2), (2, 1)))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def fim_report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of the text restored from it."""
    df = fill_in_middle(docs.select("doc_id", "text"), keep_text=False)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(w)::BIGINT AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, coalesce(array_to_string(w[1:a], ''), '') AS pre, coalesce(array_to_string(w[a + 1:b], ''), '') AS mid, coalesce(array_to_string(w[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
