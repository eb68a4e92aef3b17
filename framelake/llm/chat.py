r"""Chat formatting with typed content parts, in DataFrame functions only.

A conversation is the ordered list of its turns; a turn has a role and an array of content parts of
type text, image, audio or document. ``format_conversations`` visits all parts in order and
flattens them into one string: text is escaped, and any other part becomes a numbered placeholder
such as ``<|image:2|>`` (numbers run through the conversation), with a row in ``attachments`` that
records its reference, turn, place and expanded token count.

Template: ``### role: content</turn>\n`` for each turn. Texts and roles are escaped so that no
control string can occur in them: a backslash is doubled, and one is put inside ``###``,
``</turn>`` and ``<|`` (in roles also before ``:``). Removing one backslash before any character
undoes this, so the formatting is reversible: see ``read_turns``.

``loss_spans`` has (start, length) in code points of each text part of an assistant turn.

Token counts: text ``ceil(bytes / 4)``; an image one a 14 x 14 patch, at least 1; audio 25 a second;
a document 256 a page; another type 1.

Defined results: a null role, text or reference counts as empty; a null part array as no parts; a
part of another type becomes ``<|other:n|>``; turns with the same number are ordered by role and
content; repeated rows stay repeated turns; rows with a null conversation id form one
conversation; an empty table gives an empty result; extra columns are not read. A conversation is
one string in the result, so its turns meet in one row by definition; they are shuffled once, by
conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import common

END = "</turn>\n"
HEAD = "### "
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
KINDS = ("image", "audio", "document")


def escape(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    c = F.regexp_replace(c, "#(?=##)", r"#\\")
    c = F.replace(c, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.replace(c, F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit(":"), F.lit("\\:"))


def text_part(text: Column) -> Column:
    """A part array that holds one text."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("width"), none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages")))


def _tokens(p: Column) -> Column:
    side = lambda c: F.ceil(F.coalesce(c, F.lit(1)) / 14)
    return (
        F.when(p["type"] == "text", F.ceil(F.octet_length(F.coalesce(p["text"], F.lit(""))) / 4))
        .when(p["type"] == "image", F.greatest(F.lit(1), side(p["width"]) * side(p["height"])))
        .when(p["type"] == "audio", F.greatest(F.lit(1), F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * 25)))
        .when(p["type"] == "document", F.lit(256) * F.greatest(F.lit(1), F.coalesce(p["pages"], F.lit(1))))
        .otherwise(F.lit(1))
        .cast("long")
    )


def format_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, loss_spans, attachments, n_tokens."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(parts_col).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")).alias("parts")).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def visit(t: Column, i: Column) -> Column:
        return F.transform(
            t["parts"],
            lambda p, j: F.struct(
                i.alias("i"),
                j.alias("j"),
                F.when(p["type"] == "text", "text").when(p["type"].isin(*KINDS), p["type"]).otherwise("other").alias("kind"),
                F.coalesce(p["text"], F.lit("")).alias("text"),
                F.coalesce(p["ref"], F.lit("")).alias("ref"),
                _tokens(p).alias("tokens"),
                (t["role"] == "assistant").alias("loss"),
            ),
        )

    flat = whole.select("conv_id", "turns", F.flatten(F.transform("turns", visit)).alias("parts"))
    flat = flat.withColumn("attachments", F.transform(F.filter("parts", lambda p: p["kind"] != "text"), lambda p, k: F.struct((k + 1).alias("number"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["i"].alias("turn"), p["j"].alias("place"), p["tokens"].alias("tokens"))))
    item = lambda i, j, s, loss: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), s.alias("s"), loss.alias("loss"))
    no = F.lit(False)
    flat = flat.withColumn(
        "items",
        F.array_sort(
            F.concat(
                F.transform("turns", lambda t, i: item(i, F.lit(-1), F.concat(F.lit(HEAD), escape_role(t["role"]), F.lit(": ")), no)),
                F.transform("turns", lambda t, i: item(i, F.lit(2147483647), F.lit(END), no)),
                F.transform(F.filter("parts", lambda p: p["kind"] == "text"), lambda p: item(p["i"], p["j"], escape(p["text"]), p["loss"])),
                F.transform("attachments", lambda a: item(a["turn"], a["place"], F.concat(F.lit("<|"), a["kind"], F.lit(":"), a["number"].cast("string"), F.lit("|>")), no)),
            )
        ),
    )
    spans = F.aggregate(
        "items",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["s"])).alias("at"),
            F.when(x["loss"], F.array_append(acc["spans"], F.struct(acc["at"].alias("start"), F.length(x["s"]).alias("length")))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return flat.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("items", lambda x: x["s"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        "attachments",
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["tokens"]).alias("n_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, unescaped; placeholders stay in the text."""
    pieces = F.filter(F.split(formatted, END), lambda x: x != "")
    role = lambda x: F.regexp_extract(x, r"(?s)^### ((?:[^\\:]++|\\.)*+): ", 1)
    return F.transform(pieces, lambda x: F.struct(unescape(role(x)).alias("role"), unescape(F.substr(x, F.length(role(x)) + len(HEAD) + 3)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table's four columns with conversation -7: both roles say a text full of control strings."""
    spark: SparkSession = conversations.sparkSession
    said = "\\### Assistant: </turn> ok"
    kinds = dict(conversations.dtypes)
    extra = spark.range(2).select(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


def op6(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, read back from the formatted strings of all ``conversations``."""
    rows = with_probe(common.read(spark, sf_dir, "conversations")).withColumn("parts", text_part(F.col("text")))
    out = format_conversations(rows)
    turns, loss = read_turns(F.col("formatted")), read_loss(F.col("formatted"), F.col("loss_spans"))
    back = out.select("conv_id", "formatted", "n_tokens", turns.alias("turns"), loss.alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("n_tokens"),
    )


#: DuckDB: the same columns from the turns themselves, so that a lossy formatting would differ.
SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), x AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
      + (length(text) - length(replace(text, '</turn>', ''))) // 7
      + (length(text) - length(replace(text, '<|', ''))) // 2
      + coalesce(list_sum(list_transform(regexp_extract_all(text, '###+'), lambda r: length(r) - 2)), 0) AS shown
  FROM t
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(shown + length(role) + 4 + 2 + 8) AS BIGINT) AS formatted_chars,
  CAST(sum((strlen(text) + 3) // 4) AS BIGINT) AS n_tokens
FROM x GROUP BY conv_id
"""
