"""Record extraction from page text and tagged transcripts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions import text as T


def extract_page_records(pages: DataFrame, marker: str, key_pattern: str, fields: Mapping[str, str], text: str = "html") -> DataFrame:
    """Cut a page at a key marker; every piece is one record with its key and fields.

    Escaped quotes are undone first. ``fields``: name -> pattern with one
    group; no match gives null. Pieces whose key does not fit are dropped.
    """
    clean = F.replace(F.col(text), F.lit('\\"'), F.lit('"'))
    pieces = pages.select("page_id", F.posexplode(F.slice(
        F.split(clean, "\\Q" + marker + "\\E", -1), 2, 1_000_000_000)).alias("pos", "piece"))
    key = F.regexp_extract("piece", f"^({key_pattern})", 1)
    return pieces.withColumn("key", key).where("key <> ''").select(
        "page_id", "pos", "key", *[F.nullif(F.regexp_extract("piece", p, 1), F.lit("")).alias(n) for n, p in fields.items()])


# what a bracketed value is read by: strings (to the end, if they never close), brackets, anything between
TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"?|[\[\]{}]|[^"\[\]{}]++'


def bracketed(text: Column) -> Column:
    """The bracketed value at the start of a text: (state, n), its length n if the state is ``done``.

    ``bad``: no bracket there, or one that closes another kind; ``open``: it
    does not close within the text. Brackets in strings do not count.
    """
    start = F.struct(F.lit("").alias("stack"), F.lit(0).alias("n"), F.lit("open").alias("state"))

    def step(acc: Column, token: Column) -> Column:
        stack = acc["stack"]
        opens, closes = token.isin("{", "["), token.isin("}", "]")
        fits = closes & (F.right(stack, F.lit(1)) == token)
        popped = F.substring(stack, F.lit(1), F.length(stack) - 1)
        new = F.when(opens, F.concat(stack, F.translate(token, "{[", "}]"))).when(fits, popped).otherwise(stack)
        state = (F.when((closes & ~fits) | ((acc["n"] == 0) & ~opens), "bad").when(fits & (F.length(stack) == 1), "done").otherwise("open"))
        going = F.struct(new.alias("stack"), (acc["n"] + F.length(token)).alias("n"), state.alias("state"))
        return F.when(acc["state"] == "open", going).otherwise(acc)

    return F.aggregate(F.regexp_extract_all(text, F.lit(TOKEN), 0), start, step)


def extract_json_blocks(pages: DataFrame, keys: Sequence[str], text: str = "html") -> DataFrame:
    """Every bracketed value that follows one of the keys; escaped quotes are undone first.

    A page is cut at the key. A value mostly closes before the next cut, so
    pieces are read one by one, each once; one that is still open there (it
    holds the key itself) is read again over the rest of the page.
    """
    clean = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit('\\"'), F.lit('"'))
    held = pages.select("page_id", clean.alias("_body")).where(reduce(lambda a, b: a | b, [F.contains("_body", F.lit(f'"{k}":')) for k in keys]))

    def values(key: str) -> Column:
        mark = f'"{key}":'

        def after_cuts(pieces: Column) -> Column:
            def value(piece: Column, i: Column) -> Column:
                def read(here: Column) -> Column:
                    rest = F.array_join(F.slice(pieces, i + 2, F.size(pieces)), mark)
                    again = T.let(bracketed(rest), lambda r: F.when(r["state"] == "done", F.substring(rest, F.lit(1), r["n"])))
                    return F.when(here["state"] == "done", F.substring(piece, F.lit(1), here["n"])).when(here["state"] == "open", again)
                return T.let(bracketed(piece), read)
            return F.filter(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), value), lambda x: x.isNotNull())

        found = T.let(F.split("_body", "\\Q" + mark + "\\E", -1), after_cuts)
        return T.let(found, lambda xs: F.transform(xs, lambda x, i: F.struct(F.lit(key).alias("key"), i.alias("block_no"), x.alias("block"))))

    return held.select("page_id", F.inline(F.flatten(F.array(*[values(k) for k in keys]))))


def join_stream_chunks(chunks: DataFrame) -> DataFrame:
    """Streamed page chunks (page_id, chunk_no, chunk) joined back to one text per page."""
    return chunks.groupBy("page_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))), lambda c: c["chunk"]), "").alias("html"))


MESSAGE = r'(?s)<message role="(user|assistant)">(.*?)</message>|<tool_result tool="([^"]*)" tool_call_id="([^"]*)">(.*?)</tool_result>'
INNER = r'(?s)<thinking>.*?</thinking>|<tool_call name="[^"]*" id="[^"]*">.*?</tool_call>|<text>.*?</text>'


def parse_transcripts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Tagged transcript text to block rows: message position, block position, type, text, call id, tool."""
    # an assistant turn without any block is no message, so positions are counted without it
    silent = lambda m: F.startswith(m, F.lit('<message role="assistant">')) & ~m.rlike(INNER)
    found = docs.select("doc_id", F.posexplode(F.filter(F.regexp_extract_all(text, F.lit(MESSAGE), 0), lambda m: ~silent(m))).alias("msg_idx", "raw"))
    g = lambda i: F.regexp_extract("raw", MESSAGE, i)
    messages = found.select(
        "doc_id", "msg_idx", F.when(g(1) != "", g(1)).otherwise("toolresult").alias("role"),
        F.when(g(1) != "", g(2)).otherwise(g(5)).alias("body"), F.nullif(g(3), F.lit("")).alias("tool"),
        F.nullif(g(4), F.lit("")).alias("call_id"))
    inner = F.regexp_extract_all("body", F.lit(INNER), 0)
    # a user turn is its first block if that is a text, else all of it as it stands
    spoken = F.when(F.get(inner, F.lit(0)).rlike("(?s)^<text>.+</text>$"), F.slice(inner, 1, 1)).otherwise(F.array(F.col("body")))
    blocks = F.when(F.col("role") == "assistant", inner).when(F.col("role") == "user", spoken).otherwise(F.array(F.col("body")))
    rows = messages.select("doc_id", "msg_idx", "role", "tool", "call_id", F.posexplode(blocks).alias("block_idx", "block"))
    call = r'(?s)^<tool_call name="([^"]*)" id="([^"]*)">(.*)</tool_call>$'
    b = F.col("block")
    made = F.col("role") == "assistant"
    kind = (F.when(made & b.startswith("<thinking>"), "thinking").when(made & b.startswith("<tool_call"), "toolcall").otherwise("text"))
    bare = F.regexp_replace(b, r"^<(?:thinking|text)>|</(?:thinking|text)>$", "")
    content = (F.when(kind == "toolcall", F.regexp_extract(b, call, 3)).when(made | b.rlike("(?s)^<text>.+</text>$"), bare).otherwise(b))
    is_call = kind == "toolcall"
    return rows.select(
        "doc_id", "msg_idx", "block_idx", "role", kind.alias("block_type"),
        F.regexp_replace(content, r"(?U)^\s+|\s+\z", "").alias("text"),
        F.when(is_call, F.regexp_extract(b, call, 2)).otherwise(F.col("call_id")).alias("call_id"),
        F.when(is_call, F.regexp_extract(b, call, 1)).otherwise(F.col("tool")).alias("tool"))


def transcript_messages(blocks: DataFrame) -> DataFrame:
    """Block rows of `parse_transcripts` as one row per message, in the form of the session operators.

    Texts of a message are joined by line breaks, thinking is left out; an
    assistant message lists all its calls (``calls``), a result bears the id
    of the one it answers.
    """
    typed = lambda kind, value: F.when(F.col("block_type") == kind, value)
    in_order = lambda c: F.array_sort(F.collect_list(c))
    call = F.struct("block_idx", F.col("call_id").alias("id"), "tool", F.col("text").alias("args"))
    answer = F.col("role") == "toolresult"
    grouped = blocks.groupBy(F.col("doc_id").alias("session_id"), F.col("msg_idx").cast("long").alias("msg_idx"), "role").agg(
        F.array_join(F.transform(in_order(typed("text", F.struct("block_idx", "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.max(F.when(answer, F.col("call_id"))).alias("call_id"), F.max(F.when(answer, F.col("tool"))).alias("tool"),
        F.lit(None).cast("string").alias("args"), in_order(typed("toolcall", call)).alias("_calls"))
    return grouped.select("session_id", "msg_idx", "role", "text", "call_id", "tool", "args",
                          F.transform("_calls", lambda c: F.struct(c["id"].alias("id"), c["tool"].alias("tool"), c["args"].alias("args"))).alias("calls"))
