"""Text expressions. White space is Unicode white space and the separators 1C to 1F."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x1c-\x1f]"
# Fixed values.
BULLETS = "•▪◦‣–"
NO_SPACE_BEFORE = ",.;:!?%)]}"
NO_SPACE_AFTER = "([{$£€/-–—"
SPECIAL_TOKENS = 2
QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "
INSTRUCTED_MODEL = "baai/bge-small-en-v1.5"


def squeeze(t: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(t, f"(?U){_SPACE}+", " "))


def strip(t: Column) -> Column:
    return F.regexp_replace(t, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def rstrip(t: Column) -> Column:
    return F.regexp_replace(t, rf"(?U){_SPACE}+\z", "")


def lstrip(t: Column) -> Column:
    return F.regexp_replace(t, rf"(?U)\A{_SPACE}+", "")


def boilerplate_key(t: Column) -> Column:
    """The text as it is compared between pages; lower case stands in for case folding (they differ for a few letters)."""
    return F.lower(squeeze(t))


def is_bullet(t: Column) -> Column:
    return lstrip(t).rlike(rf"\A[{BULLETS}]")


def without_bullet(t: Column) -> Column:
    """The text without one leading bullet."""
    return strip(F.regexp_replace(lstrip(t), rf"\A[{BULLETS}]", ""))


def is_bold_font(font: Column) -> Column:
    return F.lower(font).rlike("bold|black")


def word_count(t: Column) -> Column:
    """Words between white space."""
    s = squeeze(t)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, " "))).cast("int")


def token_count(t: Column) -> Column:
    """Words and the two special tokens of an encoder's input."""
    return word_count(t) + SPECIAL_TOKENS


def token_counter(count: Callable[[list[str]], list[int]]) -> Callable[[Column], Column]:
    """token_count() by a tokenizer of one's own: count gives the tokens, special ones among them, of each of many texts."""

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(count(texts.fillna("").tolist()), dtype="int32")

    return run


def join_spans(spans: Column) -> Column:
    """The text of a line from its spans (array of text, x0, x1, size, in order).

    A blank goes between two spans if one of them has a blank or tab at the seam, or the gap is wider than 8 % of the
    larger size (at least 1); blank spans are passed over; never before closing punctuation nor after an opening sign.
    """
    closing = "[" + "".join("\\" + c for c in NO_SPACE_BEFORE) + "]"
    opening = "[" + "".join("\\" + c for c in NO_SPACE_AFTER) + "]"

    def step(state: Column, span: Column) -> Column:
        done, before = state["done"], state["before"]
        left, right = F.rtrim(F.regexp_replace(done, r"[ \t]+\z", "")), F.regexp_replace(span["text"], r"\A[ \t]+", "")
        explicit = before["text"].rlike(r"[ \t]\z") | span["text"].rlike(r"\A[ \t]")
        apart = (span["x0"] - before["x1"]) > 0.08 * F.greatest(before["size"], span["size"], F.lit(1.0))
        blank = (explicit | apart) & ~right.rlike(rf"\A{closing}") & ~left.rlike(rf"{opening}\z") & (left != "") & (right != "")
        text = F.when(before.isNull(), span["text"]).otherwise(F.concat(left, F.when(blank, " ").otherwise(""), right))
        return F.struct(text.alias("done"), span.alias("before"))

    kind = "struct<done: string, before: struct<text: string, x0: double, x1: double, size: double>>"
    filled = F.filter(spans, lambda s: squeeze(s["text"]) != "")
    typed = F.transform(filled, lambda s: F.struct(s["text"].alias("text"), s["x0"].cast("double").alias("x0"), s["x1"].cast("double").alias("x1"), s["size"].cast("double").alias("size")))
    return squeeze(F.aggregate(typed, F.struct(F.lit("").alias("done"), F.lit(None).alias("before")).cast(kind), lambda a, s: step(a, s).cast(kind), lambda a: a["done"]))


def join_lines(lines: Column) -> Column:
    """One text from lines (array of strings): one blank at each seam, but none where the left ends in a hyphen and the
    right starts in lower case; the hyphen stays. Empty lines add nothing."""

    def step(left: Column, right: Column) -> Column:
        a, b = rstrip(left), lstrip(right)
        glued = a.endswith("-") & b.rlike(r"\A\p{Ll}")
        return F.when(a == "", b).when(b == "", a).when(glued, F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))

    return F.aggregate(lines, F.lit(""), step)


def embedding_text(headings: Column, body: Column) -> Column:
    """What an encoder gets for a chunk: its headings that are not blank, then its body, a line each."""
    heads = F.filter(F.transform(headings, strip), lambda h: h != "")
    text = strip(body)
    return F.concat_ws("\n", heads, F.when(text != "", text))


def prepared_query(query: Column, model: str) -> Column:
    """The query with the instruction that some encoders expect."""
    return F.concat(F.lit(QUERY_INSTRUCTION), query) if model.lower() == INSTRUCTED_MODEL else query


def snippet(text: Column, limit: int = 420) -> Column:
    """At most `limit` characters of the squeezed text; if cut, at a blank in the last two fifths if there is one, with an ellipsis."""
    if limit < 20:
        raise ValueError("a snippet has 20 characters or more")
    s = squeeze(text)
    room = limit - 1
    head = rstrip(F.substring(s, 1, room))
    behind = F.instr(F.reverse(head), " ")
    at = F.when(behind > 0, F.length(head) - behind).otherwise(-1)
    cut = F.when(at >= int(room * 0.6), rstrip(F.substring(head, F.lit(1), at))).otherwise(head)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(cut, F.lit("…")))


def page_reference(pages: Column) -> Column:
    """Where a chunk stands: one page, a run of pages, or a list (sorted distinct page numbers)."""
    first, last = F.element_at(pages, 1), F.element_at(pages, -1)
    return (
        F.when(F.size(pages) == 1, F.concat(F.lit("PDF page "), first))
        .when(F.size(pages) == last - first + 1, F.concat(F.lit("PDF pages "), first, F.lit("–"), last))
        .otherwise(F.concat(F.lit("PDF pages "), F.array_join(F.transform(pages, lambda p: p.cast("string")), ", ")))
    )


def chunk_id(document_id: Column, target: Column, section: Column, chunk: Column) -> Column:
    return F.format_string("%s-t%d-s%04d-c%02d", document_id.cast("string"), target, section, chunk)


def preview(t: Column, n: int = 160) -> Column:
    return F.substring(t, 1, n)


def query_status(query: Column, limit: int = 2000) -> Column:
    """ok, blank or too_long."""
    s = strip(query)
    return F.when(s.isNull() | (s == ""), "blank").when(F.length(s) > limit, "too_long").otherwise("ok")
