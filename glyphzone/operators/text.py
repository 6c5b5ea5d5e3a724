"""Text around zones: candidate lines, noise, HTML entities, and JSON as models write it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.checkdigit import let


def mrz_shaped_lines(text: Column) -> Column:
    lines = F.transform(F.split(text, "\r?\n"), lambda s: F.trim(s))
    return F.array_join(F.filter(lines, lambda s: F.length(F.regexp_replace(s, "(?U)\\s", "")) >= 20), "\n")


def text_sanity(text: Column) -> Column:
    """Share of characters other than spaces that are alphanumeric or one of . , - / < '; 0 without any."""
    solid = F.regexp_replace(text, "(?U)\\s", "")
    sane = F.length(F.regexp_replace(solid, "[^\\p{L}\\p{N}.,\\-/<']", ""))
    return F.when(F.length(solid) > 0, sane / F.length(solid)).otherwise(0.0)


def is_noise(line: Column) -> Column:
    """More than half of the characters other than spaces are not printable ASCII letters, digits or marks."""
    solid = F.regexp_replace(line, "(?U)\\s", "")
    return 2 * F.length(F.regexp_replace(solid, "[A-Za-z0-9<>/:.,_()'\"*#|=+&%!?;-]", "")) > F.length(solid)


def drop_noise(text: Column) -> Column:
    """The lines that aren't noise; a last empty line goes, as lines end with line feeds."""
    lines = F.split(F.regexp_replace(text, "\r?\n\\z", ""), "\r?\n")
    return F.array_join(F.filter(lines, lambda s: ~is_noise(s)), "\n")


def unescape_html(s: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return s


def repair_json(raw: Column) -> Column:
    """Without code fences and prose around the outermost braces, and without commas before closing brackets."""
    s = F.regexp_replace(F.trim(raw), "\\A```[^\\n]*\\n", "")
    s = F.trim(F.regexp_replace(s, "```\\s*\\z", ""))
    s = F.coalesce(F.nullif(F.regexp_extract(s, "(?s)(\\{.*\\})", 1), F.lit("")), s)
    return F.regexp_replace(s, ",(?=\\s*[}\\]])", "")


def needs_repair(raw: Column) -> Column:
    return ~(F.trim(raw).startswith("{") & F.try_parse_json(raw).isNotNull())


#: The fields that a model is asked for, in order, and the groups of words that tell kinds of documents.
ASKED = ("document_type", "issuing_country", "document_number", "surname", "given_names", "nationality", "date_of_birth", "sex", "date_of_expiry", "mrz_line")
KEYWORDS = {
    "passport": ("PASSPORT", "PASOS", "PASOŠ", "PUTOVNICA"),
    "identity_card": ("IDENTITY CARD", "LIČNA KARTA", "LICNA KARTA", "OSOBNA ISKAZNICA"),
    "driving_license": ("DRIVING LICEN", "VOZAČKA", "VOZACKA", "RIJBEWIJS", "PERMIS DE CONDUIRE"),
}
#: What the model is told first; a caller may pass text of their own.
SYSTEM = "You read identity documents. Give the fields that are asked for, as they are printed in Latin letters, as one JSON object; use null for what is missing or can't be read. Don't guess."


def prompt(markdown: Column, system: str = SYSTEM) -> Column:
    """A ChatML prompt for one page: entities undone, lines of noise dropped."""
    page = drop_noise(unescape_html(markdown))
    head = f"<|im_start|>system\n{system}\n<|im_end|>\n<|im_start|>user\nExtract these fields: {', '.join(ASKED)}.\n\nOCR Markdown Text:\n"
    return F.concat(F.lit(head), page, F.lit("\n\nOutput ONLY valid JSON. No markdown formatting, no explanations, no code blocks.\n<|im_end|>\n<|im_start|>assistant"))


def grammar(fields: tuple[str, ...] = ASKED) -> str:
    """A GBNF grammar for one JSON object of the fields in order, each a string or null."""
    pairs = ' "," ws '.join(f'"\\"{f}\\"" ws ":" ws value ws' for f in fields)
    text = r'''"\"" ( [^"\\] | "\\" (["\\/bfnrt] | "u" [0-9a-fA-F] [0-9a-fA-F] [0-9a-fA-F] [0-9a-fA-F]) )* "\""'''
    return "\n".join((f'root ::= "{{" ws {pairs} "}}"', "", 'value  ::= string | "null"', f"string ::= {text}", r"ws     ::= [ \t\n]*", ""))


def keywords(text: Column) -> Column:
    """The groups of which some word stands in the text, in table order."""
    upper = F.upper(text)
    return F.array_compact(F.array(*[F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(upper, w)), group) for group, words in KEYWORDS.items()]))


def parse_extraction(raw: Column) -> Column:
    """struct(fields, error) from what a model wrote, mended if need be; extraction_method is always llm.

    error: invalid_json, not_an_object or wrong_type (a field that is no text); then all fields are null.
    """
    fields = [*ASKED, "personal_number"]

    def error(parsed: Column) -> Column:
        kind = lambda f: F.schema_of_variant(F.try_variant_get(parsed, f"$.{f}", "variant"))
        wrong = F.lit(False)
        for f in fields:
            wrong = wrong | ~F.coalesce(kind(f), F.lit("VOID")).isin("STRING", "VOID")
        return F.when(parsed.isNull(), "invalid_json").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "not_an_object").when(wrong, "wrong_type")

    def answer(parsed: Column) -> Column:
        return let(error(parsed), lambda e: F.struct(*[F.when(e.isNull(), F.try_variant_get(parsed, f"$.{f}", "string")).alias(f) for f in fields], F.when(e.isNull(), "llm").alias("extraction_method"), e.alias("error")))

    clean = let(raw, lambda r: F.when(needs_repair(r), repair_json(r)).otherwise(F.trim(r)))
    return let(F.try_parse_json(clean), answer)
