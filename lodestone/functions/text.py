"""Text functions on columns: tokens, identifiers, chunk ids, cosine, line splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words of the sparse index.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")
TOKEN = r"[\p{L}\p{N}_]{2,}"
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def tokens(text: Column) -> Column:
    """Lower-case words of two characters or more, in order, without stop words; null text has none."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda w: ~w.isin(*STOPWORDS))


def code_tokens(text: Column) -> Column:
    """Four copies of a text joined by blanks: as is, snake case split, also camel case split, also letters from figures; lower case."""
    snake = F.regexp_replace(text, "_+", " ")
    camel = F.regexp_replace(snake, "([a-z0-9])([A-Z])", "$1 $2")
    parts = F.regexp_replace(camel, "([a-zA-Z])([0-9])", "$1 $2")
    return F.lower(F.concat_ws(" ", text, snake, camel, parts))


#: What the splits of code_tokens() change; a text without it gives four equal copies.
SPLIT = "_|[a-z0-9][A-Z]|[a-zA-Z][0-9]"


def code_terms(text: Column) -> tuple[Column, Column]:
    """The tokens of code_tokens(text), and how often each of them counts: of a text that no split changes one copy is enough."""
    split = F.coalesce(text, F.lit("")).rlike(SPLIT)
    return tokens(F.when(split, code_tokens(text)).otherwise(text)), F.when(split, 1).otherwise(4)


def chunk_id(path: Column, name: Column, row: Column) -> Column:
    """Sixteen hex digits of the sha256 of path::name::row."""
    return F.substring(F.sha2(F.concat_ws("::", path, name, row.cast("string")), 256), 1, 16)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in doubles; null where a norm is 0."""
    total = lambda x: F.aggregate(x, F.lit(0.0).cast("double"), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda x: F.sqrt(total(F.transform(x, lambda v: v.cast("double") * v.cast("double"))))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def lines(text: Column) -> Column:
    """Lines as str.splitlines gives them, without their ends; an empty text has none."""
    parts = F.split(text, LINE_END)
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def clean(text: Column) -> Column:
    """White space collapsed to one blank and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def signature(raw: Column) -> Column:
    """The first line, 200 characters at most."""
    return F.substring(F.substring_index(raw, "\n", 1), 1, 200)


def language_of(path: Column) -> Column:
    """The language of a path's suffix, null for others."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[suffix]


# Languages by suffix.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".rs": "rust", ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".rb": "ruby", ".ex": "elixir", ".exs": "elixir", ".tf": "hcl", ".tfvars": "hcl"}

# Words that send a question to a tool, tried in this order.
ROUTES = {
    "summarize_project": ("what does", "what is this", "purpose", "overview", "summary", "about", "describe", "tell me about", "what kind", "what type"),
    "get_architecture": ("architecture", "structure", "organized", "how is it", "layers", "modules", "design", "dependency", "dependencies", "components", "layout"),
    "project_status": ("todo", "status", "what's left", "what is left", "implemented", "progress", "where are we", "stubs", "health", "fixme", "remaining", "done", "complete"),
}


def route(question: Column) -> Column:
    """The tool that a question goes to: of the first list with a word in it, else query_code."""
    q, out = F.lower(question), None
    for tool, said in ROUTES.items():
        hit = F.lit(False)
        for s in said:
            hit = hit | q.contains(s)
        out = F.when(hit, tool) if out is None else out.when(hit, tool)
    return out.otherwise("query_code")


def role(out_degree: Column, in_degree: Column) -> Column:
    """hub, utility, bridge or leaf by a node's degrees."""
    return F.when(out_degree > 5, "hub").when((in_degree > 3) & (out_degree <= 2), "utility").when((out_degree >= 2) & (in_degree >= 2), "bridge").otherwise("leaf")
