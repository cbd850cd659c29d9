"""Chat formatting by grammar round trip (native).

Grammar of the output, deterministic, left to right:

    conversation := turn*
    turn         := "<|im_start|>" role "\n" text "<|im_end|>" "\n"

Inside roles and texts a run "<\\...|" stands for the same run with one backslash
less. A turn is first rendered as it is, parsed again and compared with its source;
if the parse differs, role and text are rendered with one more backslash in every
such run (in a role, also a line feed as "<~|"), and parsed and compared again. Escaped text holds no "<|", so that the
second comparison always holds; the whole conversation is parsed once more when it
is joined, and a difference there raises an error.

Defined cases: a null text or role is empty; equal turn numbers are ordered by role
and text; repeated rows stay repeated turns; a null conv_id is a conversation of its
own; an empty table gives no conversation; other columns play no part. A conversation
is one string, so that it has to fit into one row, also that of null: turns without a
conversation that are more than this want format_turns, which works turn by turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, scan

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
#: Between a turn and the next one.
PIECE = r"(?<=<\|im_end\|>\n)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    """A role is one line: a line feed becomes "<~|", and "<~" itself is escaped as "<|" is."""
    return F.replace(F.regexp_replace(role, r"<(\\*)([|~])", r"<\\$1$2"), F.lit("\n"), F.lit("<~|"))


def _unescape_role(role: Column) -> Column:
    return F.regexp_replace(F.replace(role, F.lit("<~|"), F.lit("\n")), r"<\\(\\*)([|~])", r"<$1$2")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n"))


def parse(rendered: Column) -> Column:
    """array<struct<role,text>> of rendered text. Total: whatever lies between markers is read as a turn."""
    turns = F.split(rendered, r"<\|im_end\|>\n", -1)
    bodies = F.transform(F.slice(turns, 1, F.greatest(F.size(turns) - 1, F.lit(0))), lambda t: F.regexp_replace(t, r"\A<\|im_start\|>", ""))
    role = lambda b: F.substring_index(b, "\n", 1)
    text = lambda b: b.substr(F.length(role(b)) + 2, F.length(b))  # noqa: E731  empty without a line feed
    return F.transform(bodies, lambda b: F.struct(_unescape_role(role(b)).alias("role"), unescape(text(b)).alias("text")))


def format_turns(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> with rendered, escaped: each turn so rendered that it parses to itself."""
    df = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    df = df.withColumn("plain", render(F.col("role"), F.col("text")))
    source = F.array(F.struct("role", "text"))
    marked = F.concat(F.col("role"), F.lit("\n"), F.col("text")).contains("<|im_")  # also what this parser would bear, but others not
    # a control string cut by a turn's edge can't arise: a turn begins with "<" and ends with a line feed
    df = df.withColumn("escaped", (parse(F.col("plain")) != source) | marked)
    return df.withColumn("rendered", F.when(F.col("escaped"), render(_escape_role(F.col("role")), escape(F.col("text")))).otherwise(F.col("plain"))).drop("plain")


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (read back), loss (the mask: spans of formatted, in code points), loss_text (what is under the mask, unescaped): one row a conversation."""
    df = format_turns(turns)
    piece = F.struct(F.col("turn").isNull().alias("late"), "turn", "role", "text", "rendered")
    df = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("ps"))
    df = df.withColumn("formatted", F.array_join(F.transform("ps", lambda p: p["rendered"]), ""))
    df = df.withColumn("turns", parse(F.col("formatted")))
    same = F.col("turns") == F.transform("ps", lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text")))
    df = df.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("conversation doesn't survive the round trip: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))))
    marked = let(F.split("formatted", PIECE, -1), loss_spans)
    df = df.select("conv_id", "formatted", "turns", marked.alias("marked"))
    return df.select("conv_id", "formatted", "turns", F.transform("marked", lambda m: F.struct(m["start"], m["end"])).alias("loss"), F.array_join(F.transform("marked", lambda m: unescape(m["shown"])), "").alias("loss_text"))


def loss_spans(pieces: Column) -> Column:
    """The loss mask over a formatted text split into PIECEs: array<struct<start,end,shown>>, the places of assistant texts and what stands there.

    A piece ends with a turn. Each is cut by its span less the place where it begins, so that no cut walks through the whole text.
    """
    head = f"{START}{ASSISTANT}\n"

    def spans(upto: Column) -> Column:
        begin = lambda i: F.coalesce(F.get(upto, i - 1), F.lit(0).cast("bigint"))
        place = lambda x, i: F.when(x.startswith(head), F.struct((begin(i) + len(head)).alias("start"), (F.get(upto, i) - len(END) - 1).alias("end"), begin(i).alias("begin"), x.alias("piece")))
        found = F.filter(F.transform(pieces, place), lambda m: m.isNotNull())
        cut = lambda m: m["piece"].substr((m["start"] - m["begin"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), cut(m).alias("shown")))

    return let(scan(F.transform(pieces, lambda x: F.length(x).cast("bigint")), lambda a, b: a + b), spans)


def chat_report(turns: DataFrame) -> DataFrame:
    df = format_conversations(turns)
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), digest(whole).alias("turns_sha256"), F.length("loss_text").cast("bigint").alias("loss_chars"), digest(F.col("loss_text")).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, contains(r || chr(10) || x, '<|im_') OR regexp_matches(x, '<\\+\|') OR regexp_matches(r, '<\\+[|~]') OR contains(r, chr(10)) OR contains(r, '<~|') AS esc FROM t),
f AS (SELECT *, CASE WHEN esc THEN replace(regexp_replace(r, '<(\\*)([|~])', '<\\\1\2', 'g'), chr(10), '<~|') ELSE r END AS role_out,
             CASE WHEN esc THEN regexp_replace(x, '<(\\*)\|', '<\\\1|', 'g') ELSE x END AS text_out FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
       coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>' || role_out || chr(10) || text_out || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
