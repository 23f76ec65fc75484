"""Chat formatting: typed content parts become one marked text a turn, with attachments listed aside."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

START, BODY, END = "<|start|>", "<|body|>", "<|end|>\n"
#: Strings a reader of the output, or of a template of another model, could take for control.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Size rules of attachments; the counts say how long a placeholder gets once expanded.
PATCH, FRAMES_A_SECOND, TOKENS_A_PAGE = 14, 25, 512

PART = (
    "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
)


def escape(text: Column) -> Column:
    """Put one more backslash behind the first character of each control string, escaped ones included."""
    for c in CONTROL:
        text = F.regexp_replace(text, rf"({_quoted(c[0])})(\\*)(?={_quoted(c[1:])})", r"$1$2\\")
    return text


def unescape(text: str) -> str:
    """The exact inverse of ``escape``: its steps undone in reverse order."""
    for pattern in _UNDO:
        text = pattern.sub(r"\1\2", text)
    return text


def _quoted(text: str) -> str:
    return re.sub(r"([\[\]|])", r"\\\1", text)


_UNDO = [re.compile(rf"({_quoted(c[0])})\\(\\*)(?={_quoted(c[1:])})") for c in reversed(CONTROL)]
_TURN = re.compile(r"<\|start\|>(.*?)<\|body\|>(.*)<\|end\|>\n", re.S)


def text_part(text: Column) -> Column:
    """A turn of plain text as a list of parts."""
    null = F.lit(None)
    fields = [F.lit("text").alias("kind"), text.alias("text")]
    fields += [null.cast(k).alias(n) for n, k in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(*fields))


def visit(part: Column, place: Column) -> Column:
    """What one part becomes: its text or placeholder in the turn, its reference, and its token count once expanded."""
    kind = F.lower(F.coalesce(part["kind"], F.lit("text")))
    tokens = (
        F.when(kind == "image", F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH))
        .when(kind == "audio", F.ceil(part["seconds"] * FRAMES_A_SECOND))
        .when(kind == "document", part["pages"].cast("long") * TOKENS_A_PAGE)
        .otherwise(F.lit(None))
        .cast("long")
    )
    is_text = kind == "text"
    mark = F.concat(F.lit("<|"), escape(kind), F.lit(":"), place.cast("string"), F.lit("|>"))
    return F.struct(
        is_text.alias("text"),
        F.when(is_text, F.coalesce(part["text"], F.lit(""))).otherwise(mark).alias("shown"),
        F.when(~is_text, F.struct(place.alias("place"), kind.alias("kind"), part["ref"].alias("ref"), F.coalesce(tokens, F.lit(0).cast("long")).alias("tokens"))).alias("attachment"),
    )


def _flattened(seen: Column) -> Column:
    """The text of a turn: neighbouring texts are one before they are escaped, so none is a part of a control string."""

    def add(runs: Column, part: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        grown = F.struct(F.lit(True).alias("text"), F.concat(last["shown"], part["shown"]).alias("shown"))
        joins = F.coalesce(last["text"], F.lit(False)) & part["text"]
        return F.when(joins, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(grown))).otherwise(
            F.concat(runs, F.array(F.struct(part["text"].alias("text"), part["shown"].alias("shown"))))
        )

    runs = F.aggregate(seen, F.array().cast("array<struct<text:boolean,shown:string>>"), add)
    # A placeholder begins with < and ends with >, which no text can go on to a control string.
    return F.array_join(F.transform(runs, lambda r: F.when(r["text"], escape(r["shown"])).otherwise(r["shown"])), "")


def format_turns(turns: DataFrame, parts: str = "parts", role: str = "role", result: str = "formatted") -> DataFrame:
    """Add ``result`` (text, attachments, expanded_tokens, loss) to each turn.

    Text parts are escaped; image, audio, document and unknown parts become
    placeholders numbered within the turn, in order, each with a row in
    ``attachments``.  Null roles and null or empty part lists give an empty
    place; a part without a kind is text, a missing size counts no tokens.
    ``loss`` tells assistant turns.  Everything is per row: no key is gathered.
    """
    seen = turns.drop(result).withColumn(
        "__seen", F.transform(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), lambda p, i: visit(p, i))
    )
    attachments = F.filter(F.transform("__seen", lambda s: s["attachment"]), lambda a: a.isNotNull())
    body = _flattened(F.col("__seen"))
    name = F.coalesce(F.col(role), F.lit(""))
    value = F.struct(
        F.concat(F.lit(START), escape(name), F.lit(BODY), body, F.lit(END)).alias("text"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
        (name == "assistant").alias("loss"),
    )
    return seen.withColumn(result, value).drop("__seen")


DIGEST = StructType(
    [
        StructField("conv_id", LongType()),
        StructField("n_turns", LongType()),
        StructField("turns_sha256", StringType()),
        StructField("loss_chars", LongType()),
        StructField("loss_sha256", StringType()),
        StructField("formatted_chars", LongType()),
    ]
)


class _Reader:
    """Reads a conversation back from its formatted turns, holding sums and two hash states."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss, self.chars = conv, 0, 0, 0
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str) -> None:
        role, text = map(unescape, _TURN.fullmatch(formatted).groups())
        self.turns += 1
        self.chars += len(formatted)
        self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if role == "assistant":
            self.loss += len(text)
            self.learned.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss, self.learned.hexdigest(), self.chars


def read_back(formatted: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", result: str = "formatted") -> DataFrame:
    """Per conversation, digests of roles and texts read from the formatted turns.

    Turns stream in order (turn, then role and formatted text; null first)
    through the task of their conversation: a long one is never gathered, though
    a digest of one text has to pass one task.  Turns that share a number, and
    repeated rows, each count; a null conv_id is a conversation of its own.
    """
    rows = (
        formatted.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(f"{result}.text").alias("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    schema = pa.schema([(f.name, pa.string() if f.dataType == StringType() else pa.int64()) for f in DIGEST])

    def digest(batches):
        reader, done = None, []
        for batch in batches:
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("text").to_pylist()):
                if reader is None or reader.conv != conv:
                    if reader:
                        done.append(reader.row())
                    reader = _Reader(conv)
                reader.add(text)
            yield _batch(done, schema)
            done = []
        if reader:
            yield _batch([reader.row()], schema)

    return rows.mapInArrow(digest, DIGEST)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
