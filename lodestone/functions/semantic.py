"""What a chunk says in words: parameters, return types, imports, bases, and the sentence that stands for it in the index.

Columns of strings; patterns know the letters of all scripts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import clean, lines

_ENDS = r"^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _ENDS, "")


def params_python(raw: Column) -> Column:
    """What stands in the brackets of the first def, without annotations."""
    inside = F.regexp_extract(raw, r"(?U)def\s+\w+\s*\(([^)]*)\)", 1)
    return clean(F.regexp_replace(inside, r":\s*[^,=)]+", ""))


def params(raw: Column) -> Column:
    """What stands in the first brackets, of 200 characters at most."""
    return clean(F.regexp_extract(raw, r"\(([^)]{0,200})\)", 1))


def return_type(raw: Column) -> Column:
    """What follows the first arrow, else a name in capitals between brackets and a brace."""
    arrow = F.regexp_extract(raw, r"->\s*([^\n:]{1,60})", 1)
    return clean(F.when(raw.rlike(r"->\s*[^\n:]"), arrow).otherwise(F.regexp_extract(raw, r"\)\s+([A-Z][a-zA-Z0-9*\[\]]+)\s*\{", 1)))


def imports(raw: Column) -> Column:
    """Of the first 50 lines those that import, 80 characters of each, ten at most."""
    said = F.transform(F.slice(lines(raw), 1, 50), strip)
    found = F.filter(said, lambda x: x.rlike(r"^(?:import |from |require\(|use |using )"))
    return F.array_join(F.slice(F.transform(found, lambda x: F.substring(x, 1, 80)), 1, 10), ", ")


def bases(raw: Column, language: Column) -> Column:
    """The classes or interfaces that a class is made from."""
    python = F.regexp_extract(raw, r"(?U)class\s+\w+\s*\(([^)]+)\)", 1)
    others = F.regexp_extract(raw, r"(?:extends|implements)\s+([A-Za-z0-9_, <>\[\]]+)", 1)
    return clean(F.when(language == "python", python).when(language.isin("typescript", "javascript", "java"), others).otherwise(F.lit("")))


def _said(lead: str, what: Column) -> Column:
    return F.when(what != "", F.concat(F.lit(lead), what, F.lit("."))).otherwise(F.lit(""))


def semantic_text(kind: Column, name: Column, language: Column, path: Column, raw: Column, parent: Column, doc: Column, start: Column, end: Column) -> Column:
    """The sentence for a chunk; where a piece is missing two blanks stay between its neighbours."""
    readable = F.regexp_replace(name, "[_-]", " ")
    said, blank, lit = clean(doc), F.lit(" "), F.lit
    call = F.when(language == "python", params_python(raw)).otherwise(params(raw))
    call = F.concat(_said("Parameters: ", call), blank, _said("Returns: ", return_type(raw)), blank, said)
    owner = F.coalesce(parent, lit(""))
    text = (
        F.when(kind == "module", F.concat(lit("Module "), name, lit(" in file "), path, lit(". Language: "), language, lit(". "), _said("Imports: ", imports(raw)), blank, said))
        .when(kind == "function", F.concat(lit("Function "), readable, F.when(owner != "", F.concat(lit(" in "), owner)).otherwise(lit("")), lit(". "), call))
        .when(kind == "method", F.concat(lit("Method "), readable, lit(" of class "), F.when(owner != "", owner).otherwise(lit("unknown class")), lit(". "), call))
        .when(kind == "class", F.concat(lit("Class "), readable, lit(". "), _said("Extends: ", bases(raw, language)), blank, said))
        .when(kind == "interface", F.concat(lit("Interface "), readable, lit(". "), said))
        .when(kind == "window", F.concat(lit("Code from "), path, lit(" lines "), start.cast("string"), lit("-"), end.cast("string"), lit(". Language: "), language, lit(". "), F.substring(raw, 1, 800)))
        .otherwise(F.concat(kind, blank, readable, lit(". "), said))
    )
    return strip(text)


def description(text: Column, name: Column) -> Column:
    """Of a chunk's sentence what its comment says: the first sentence behind name and signature, 160 characters at most."""
    rest = strip(F.regexp_replace(text, r"^(?:Function|Method|Class|Interface)\s+\S[^.]*\.\s*", ""))
    rest = strip(F.regexp_replace(rest, r"^(?:(?:Parameters|Returns):[^.]*\.\s*)+", ""))
    first = F.regexp_replace(F.substring_index(rest, ". ", 1), r"\.+$", "")
    return F.when(rest == "", F.concat(F.lit("implements "), F.regexp_replace(name, "[_-]", " "))).otherwise(F.substring(first, 1, 160))


def without_prefix(text: Column) -> Column:
    """A query made from a chunk's sentence: its first sentence behind the name, else the whole."""
    rest = strip(F.regexp_replace(text, r"^(?:Function|Method|Class|Module)\s+\S[^.]*\.\s*", ""))
    return F.when(rest == "", text).otherwise(F.substring_index(rest, ". ", 1))


# Markers of work left, and the pattern of a body that does nothing yet.
MARKER = r"(?i)\b(TODO|FIXME|HACK|XXX)\b[:\s]*([^\n]*)"
_STUB = r"^\s*(?:pass|raise\s+NotImplementedError[^\n]*)\s*(?:$|\n)"


def markers(text: Column) -> Column:
    """Markers of work left: an array of type (capitals) and text (120 characters at most)."""
    kinds, said = (F.regexp_extract_all(text, F.lit(MARKER), F.lit(i)) for i in (1, 2))
    return F.zip_with(kinds, said, lambda k, x: F.struct(F.upper(k).alias("type"), F.substring(strip(x), 1, 120).alias("text")))


def is_stub(kind: Column, raw: Column) -> Column:
    """A function of five lines at most whose body, of under 80 characters, begins with a line that does nothing."""
    whole = strip(raw)
    n = F.size(F.split(whole, "\n"))
    body = strip(F.when(F.instr(whole, "\n") > 0, F.regexp_replace(whole, r"^[^\n]*\n", "")).otherwise(F.lit("")))
    return kind.isin("function", "method") & (n <= 5) & (F.char_length(body) < 80) & body.rlike(_STUB)


def is_test(path: Column) -> Column:
    return path.contains("/test") | path.endswith("_test.py")
