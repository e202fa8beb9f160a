"""String functions over columns: answers, tool tags, code blocks, prompts, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's strip() removes, for both engines.
PY_SPACE = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))
#: Split pattern of the tokenizer (fixed value); Java needs (?U) for Unicode classes.
SPLIT_PATTERN = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""


def py_strip(col: Column) -> Column:
    return F.btrim(col, F.lit(PY_SPACE))


def pretokens(text: Column) -> Column:
    """Pieces of a text; joined they give the text back."""
    return F.regexp_extract_all(text, F.lit("(?U)" + SPLIT_PATTERN), F.lit(0))


def answer_number(text: Column) -> Column:
    """The number after `#### `, without commas; null without one."""
    return F.replace(F.nullif(F.regexp_extract(text, r"#### (\-?[0-9\.\,]+)", 1), F.lit("")), F.lit(","), F.lit(""))


def tool_parts(answer: Column) -> Column:
    """array<struct<type, text>>: texts, tool calls and outputs of `<<expr=result>>` tags;
    empty texts at the edges and between neighbours are kept."""
    tag = r"<<[^>]+>>"
    texts = F.split(answer, tag)
    tags = F.regexp_extract_all(answer, F.lit(tag), F.lit(0))

    def parts(text: Column, i: Column) -> Column:
        inner = F.regexp_replace(F.get(tags, i - 1), "^<<|>>$", "")
        expr = F.when(inner.contains("="), F.regexp_extract(inner, r"(?s)^(.*)=[^=]*$", 1)).otherwise(inner)
        result = F.when(inner.contains("="), F.regexp_extract(inner, r"(?s)=([^=]*)$", 1)).otherwise("")
        own = F.struct(F.lit("text").alias("type"), text.alias("text"))
        call = F.array(F.struct(F.lit("python").alias("type"), expr.alias("text")), F.struct(F.lit("python_output").alias("type"), result.alias("text")), own)
        return F.when(i == 0, F.array(own)).otherwise(call)

    return F.flatten(F.transform(texts, parts))


def leading_imports(prompt: Column) -> Column:
    """Import lines before the first other code line, stripped."""
    lines = F.transform(F.split(prompt, "\n"), py_strip)
    code = F.transform(lines, lambda x: (x != "") & ~x.startswith("#") & ~x.rlike("^(import|from) "))
    stop = F.array_position(code, True)
    head = F.when(stop > 0, F.slice(lines, 1, F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(lines)
    return F.array_join(F.filter(head, lambda x: x.rlike("^(import|from) ")), "\n")


def first_program(completion: Column) -> Column:
    """The first fenced block, else the whole text; stripped."""
    fence = r"(?s)```(?:python)?\s*\n(.*?)\n```"
    return py_strip(F.when(completion.rlike(fence), F.regexp_extract(completion, fence, 1)).otherwise(completion))


def render_choices(question: Column, letters: Column, choices: Column) -> Column:
    """Multiple-choice question; stops at the shorter of letters and choices."""
    n = F.least(F.size(letters), F.size(choices))
    rows = F.zip_with(F.slice(choices, F.lit(1), n), F.slice(letters, F.lit(1), n), lambda c, x: F.concat(F.lit("- "), c, F.lit("="), x, F.lit("\n")))
    return F.concat(F.lit("Multiple Choice question: "), question, F.lit("\n"), F.array_join(rows, ""), F.lit("\nRespond only with the letter of the correct answer."))


def few_shot(examples: Column, last: Column) -> Column:
    """Rendered examples, each followed by an empty line, and the item itself."""
    return F.concat(F.array_join(F.transform(examples, lambda x: F.concat(x, F.lit("\n\n"))), ""), last)


def common_length(rows: Column, suffix: bool = False) -> Column:
    """Length of the common prefix (or suffix) of an array of arrays: the least that any
    row shares with the first, each place read once."""
    first = F.get(rows, F.lit(0))

    def shared(row: Column) -> Column:
        ends = (F.reverse(first), F.reverse(row)) if suffix else (first, row)
        stop = F.array_position(F.zip_with(*ends, lambda x, y: x.eqNullSafe(y)), False)  # the shorter ends in nulls
        return F.when(stop > 0, stop - 1).otherwise(F.size(row)).cast("int")

    return F.array_min(F.transform(rows, shared))


def byte_ids(text: Column, prepend: int | None = None) -> Column:
    """UTF-8 bytes of a text as token ids: read as Latin-1, each byte is a character."""
    chars = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")
    ids = F.transform(F.when(text == "", F.array().cast("array<string>")).otherwise(chars), lambda c: F.ascii(c))
    return F.concat(F.array(F.lit(prepend)), ids) if prepend is not None else ids


def slugify(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(" "), F.lit("-"))


def report_value(kind: Column, number: Column, text: Column) -> Column:
    """Report format: floats with four digits, integers from 10,000 with commas."""
    whole = F.format_string("%d", number.cast("long"))
    return F.when(kind == "float", F.format_string("%.4f", number)).when((kind == "int") & (number >= 10000), F.format_number(number, 0)).when(kind == "int", whole).otherwise(text)
