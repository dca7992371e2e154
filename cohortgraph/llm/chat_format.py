"""Chat formatting with typed content parts.

A turn's content is a list of typed parts: text, image, audio or document. A visitor goes over the parts in order: text is
escaped, an attachment becomes a placeholder with its place in the turn, and what it refers to is recorded beside the
text with the tokens that it expands to in a model. Turns are framed by control strings; control strings inside texts and
roles are escaped, so reading a formatted conversation gives back every role and part exactly. Everything is built from
DataFrame functions: turns are formatted row by row, and a conversation's turns meet in one sorted list, as its output is
one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template.
TURN, SAYS, PART_END, END = "<|turn|>", "<|says|>", "<|part|>", "<|end|>"
#: What must not follow `<` or `[` in a text: the template's own strings, and those of other well-known templates.
HELD = r"\||/?s>|/?INST\]|/?<?SYS>"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
KINDS = ("image", "audio", "document")

#: Tokens that attachments expand to: an image to one for each square of so many pixels' side up to a most, audio to so many
#: a second, a document to so many a page. One of unknown size counts as one square, second or page.
PATCH, MOST_PATCHES, PER_SECOND, PER_PAGE = 28, 1280, 25, 600
#: Code points for each token of text: an estimate, as no vocabulary is asked here.
CHARS_PER_TOKEN = 4


def escaped(text: Column) -> Column:
    r"""One more backslash after each `<` or `[` that begins a control string, however many are there already."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({HELD})", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({HELD})", "$1$2$3")


def text_part(text: Column) -> Column:
    """Content of one text part."""
    fields = [F.lit("text"), text.cast("string"), *(F.lit(None) for _ in range(5))]
    return F.array(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(fields)))).cast(f"array<{PART}>")


def _attached(p: Column) -> Column:
    return F.coalesce(p["kind"].isin(*KINDS), F.lit(False))


def _tokens(p: Column) -> Column:
    """Tokens that one part expands to."""
    side = lambda c: F.ceil(F.coalesce(p[c], F.lit(1)) / PATCH)
    one = lambda c: F.greatest(c.cast("long"), F.lit(1).cast("long"))
    image = F.least(side("width") * side("height"), F.lit(MOST_PATCHES))
    pages = F.coalesce(p["pages"], F.lit(1))
    sized = F.when(p["kind"] == "image", one(image)).when(p["kind"] == "audio", one(F.ceil(F.coalesce(p["seconds"], F.lit(1.0)) * PER_SECOND))).when(p["kind"] == "document", one(pages) * PER_PAGE)
    return F.coalesce(sized, F.ceil(F.length(p["text"]) / CHARS_PER_TOKEN), F.lit(0)).cast("long")


def format_turns(chats: DataFrame, parts: Column, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """One row for each row of chats: conv, turn, role, body (parts as one string), attachments, tokens, seen in the parts' order.

    parts is a list of PART. A placeholder is `<|kind:n|>`, n the part's number in its turn; attachments hold n, the part and
    its tokens. Parts without one of the three kinds are text; a null text, and a null or empty list, is an empty text."""
    some = F.when(F.size(parts) > 0, parts).otherwise(text_part(F.lit("")))
    rows = chats.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), some.alias("parts"))
    shown = F.transform("parts", lambda p, n: F.when(_attached(p), F.concat(F.lit("<|"), p["kind"], F.lit(":"), n.cast("string"), F.lit("|>"))).otherwise(escaped(F.coalesce(p["text"], F.lit("")))))
    numbered = F.transform("parts", lambda p, n: F.struct(n.cast("int").alias("n"), _tokens(p).alias("tokens"), p.alias("part")))
    tokens = F.aggregate(F.transform("parts", _tokens), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("conv", "turn", "role", F.array_join(shown, PART_END).alias("body"), F.filter(numbered, lambda x: _attached(x["part"])).alias("attachments"), tokens.alias("tokens"))


def format_chats(chats: DataFrame, parts: Column | None = None, text_col: str = "text", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", learn: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, formatted, attachments (for each turn in order, a list), tokens, loss_mask.

    Rows of a conversation go by turn, null first; rows that share a turn by role, then by formatted content; equal rows all
    stay. Without parts a row's content is its text, null counting as empty. A null role is an empty one. Null ids are one
    conversation. loss_mask is run-length coded, three runs (chars, learn) for each turn: what stands before the content, the
    content, what stands after it; learn is true for contents of the role to be learned. Other columns are ignored. A
    conversation must fit into a string of 2 GB.
    """
    turns = format_turns(chats, text_part(F.col(text_col)) if parts is None else parts, conv_col, turn_col, role_col)
    lead = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(SAYS))
    # Long texts travel once: the struct holds them in the order in which it is compared.
    turn = F.struct("turn", "role", "body", F.length("body").cast("long").alias("chars"), lead.alias("lead"), "attachments", "tokens")
    whole = turns.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    run = lambda chars, on: F.struct(chars.cast("long").alias("chars"), on.alias("learn"))
    mask = lambda t: F.array(run(F.length(t["lead"]), F.lit(False)), run(t["chars"], t["role"] == learn), run(F.lit(len(END)), F.lit(False)))
    return whole.select(
        F.col("conv").alias(conv_col), F.array_join(F.transform("turns", lambda t: F.concat(t["lead"], t["body"], F.lit(END))), "").alias("formatted"),
        F.transform("turns", lambda t: t["attachments"]).alias("attachments"), F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("tokens"),
        F.flatten(F.transform("turns", mask)).alias("loss_mask"),
    )


_MARK = r"^<\|(image|audio|document):([0-9]+)\|>$"


def read_chats(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """From rows of format_chats: conv_id, formatted_chars, turns (role, parts, learn), read from the string, its attachments
    and its mask. learn is what the mask says of the content, null where the mask's run is not as long as the content."""

    def part(piece: Column, files: Column) -> Column:
        number = F.regexp_extract(piece, _MARK, 2).cast("int")
        held = F.get(F.filter(files, lambda a: a["n"] == number), F.lit(0))["part"]
        return F.when(piece.rlike(_MARK), held).otherwise(F.get(text_part(unescaped(piece)), F.lit(0)))

    def turn(piece: Column, i: Column) -> Column:
        halves = F.split(F.substr(piece, F.lit(len(TURN) + 1)), r"<\|says\|>", 2)
        role, body, run, files = unescaped(halves[0]), halves[1], F.get("loss_mask", 3 * i + 1), F.get("attachments", i)
        parts = F.transform(F.split(body, r"<\|part\|>"), lambda x: part(x, files))
        return F.struct(role.alias("role"), parts.alias("parts"), F.when(run["chars"] == F.length(body), run["learn"]).alias("learn"))

    ended = F.split("formatted", r"<\|end\|>")  # nothing stands after the last end
    pieces = formatted.select(F.col(conv_col).alias("conv"), F.length("formatted").cast("long").alias("chars"), F.slice(ended, F.lit(1), F.size(ended) - 1).alias("pieces"), "attachments", "loss_mask")
    return pieces.select(F.col("conv").alias(conv_col), F.col("chars").alias("formatted_chars"), F.transform("pieces", turn).alias("turns"))


def chat_digest(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv_id, n_turns, turns_sha256 (role, line break, text, line break for each turn), loss_chars and loss_sha256 (texts under the
    mask one after another), formatted_chars; all of it read back. An attachment's text is its reference."""
    text = lambda t: F.array_join(F.transform(t["parts"], lambda p: F.coalesce(F.when(_attached(p), p["ref"]).otherwise(p["text"]), F.lit(""))), "")
    read = read_chats(formatted, conv_col).select(conv_col, "formatted_chars", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), text(t).alias("text"), t["learn"].alias("learn"))).alias("turns"))
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: t["text"]), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sums = read.select(conv_col, "formatted_chars", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), learned.alias("learned"))
    return sums.select(conv_col, "n_turns", "turns_sha256", F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


#: Both rows of the conversation that the query adds.
PROBE = "</s>[INST] ok [/INST]"

_SQL_TEXT = rf"regexp_replace({{0}}, '([<\[])(\\*)({HELD})', '\1\\\2\3', 'g')"
SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
e AS (SELECT *, {_SQL_TEXT.format("role")} AS shown, {_SQL_TEXT.format("text")} AS body FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(shown) + length(body) + {len(TURN + SAYS + END)}) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
