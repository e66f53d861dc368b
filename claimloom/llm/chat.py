"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role share a block. A block is

    <|ROLE|>TEXT<|+|>TEXT<|end|>

so a merged block still shows where each of its turns begins. In texts and roles `&` and `<` are escaped as `&amp;` and `&lt;` (in roles
`|` too, as `&#124;`), so no text can hold a control string, and unescaping in the opposite order gives the text back exactly.
The loss mask is a list of spans (start, length in code points of the formatted string): one for each turn of the assistant.

Edge cases: null text or role counts as empty; rows of equal turn are ordered by role, then text; repeated rows are all kept; rows with a
null conv_id form one conversation; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

JOIN, END = "<|+|>", "<|end|>"
LOSS_ROLE = "assistant"


def _swap(x: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


#: Pieces that are added up together.
CHUNK = 256


def escape(x: Column) -> Column:
    return _swap(x, ("&", "&amp;"), ("<", "&lt;"))


def unescape(x: Column) -> Column:
    return _swap(x, ("&lt;", "<"), ("&amp;", "&"))


def _role(x: Column) -> Column:
    return _swap(escape(x), ("|", "&#124;"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (array of structs start, length)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = turns.select("conv_id", F.struct(F.col("turn"), empty("role").alias("role"), empty("text").alias("text")).alias("t"))
    got = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        before = F.get("turns", i - 1)["role"]
        head = F.when(i == 0, F.concat(F.lit("<|"), _role(t["role"]), F.lit("|>"))).when(before == t["role"], F.lit(JOIN)).otherwise(F.concat(F.lit(END + "<|"), _role(t["role"]), F.lit("|>")))
        body = escape(t["text"])
        return F.struct(F.concat(head, body).alias("s"), F.length(head).cast("long").alias("head"), F.length(body).cast("long").alias("body"), (t["role"] == LOSS_ROLE).alias("loss"))

    got = got.select("conv_id", F.transform("turns", piece).alias("pieces"))
    return got.select("conv_id", F.concat(F.array_join(F.transform("pieces", lambda p: p["s"]), ""), F.lit(END)).alias("formatted"), _spans().alias("loss"))


def _spans() -> Column:
    """Start and length of each piece under the loss mask. Places are added up over chunks of CHUNK pieces first, then within each, so that
    the work on a very long conversation stays in proportion to its length."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("pieces") - 1) / CHUNK).cast("int")), lambda k: F.slice("pieces", k * CHUNK + 1, CHUNK))
    size = lambda chunk: F.aggregate(chunk, F.lit(0).cast("long"), lambda n, p: n + p["head"] + p["body"])
    none = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("bases"))
    bases = F.aggregate(F.transform(chunks, size), none, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["bases"], F.array(acc["at"])).alias("bases")), lambda acc: acc["bases"])

    def step(acc: Column, p: Column) -> Column:
        span = F.array(F.struct((acc["at"] + p["head"]).alias("start"), p["body"].alias("length")))
        return F.struct((acc["at"] + p["head"] + p["body"]).alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    empty = F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)")
    return F.flatten(F.zip_with(chunks, bases, lambda chunk, base: F.aggregate(chunk, F.struct(base.alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string, in order."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")

    def turns(b: Column) -> Column:
        head = F.substring_index(F.substr(b, F.lit(3)), "|>", 1)
        body = F.substr(b, F.length(head) + 5)
        role = unescape(_swap(head, ("&#124;", "|")))
        return F.transform(F.split(body, r"<\|\+\|>"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    done = format_chats(turns).select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("loss_text"))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(7 + sum(length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + CASE WHEN before IS NULL THEN 4 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '|', '&#124;'))
            WHEN before = role THEN 5 ELSE 11 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '|', '&#124;')) END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""

QUERIES = {"op9_chat_formatting": op9}
SQL = {"op9_chat_formatting": OP9_SQL}
