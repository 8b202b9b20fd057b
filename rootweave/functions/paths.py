"""Classification of file paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BY_SUFFIX = {
    "py": "python",
    **dict.fromkeys(("ts", "tsx"), "typescript"),
    **dict.fromkeys(("js", "jsx", "mjs", "cjs"), "javascript"),
    "go": "go",
    "java": "java",
    "rs": "rust",
    **dict.fromkeys(("c", "h"), "c"),
    **dict.fromkeys(("cpp", "cc", "cxx", "hpp", "hh", "hxx"), "cpp"),
    "cs": "csharp",
    "rb": "ruby",
    "php": "php",
    **dict.fromkeys(("kt", "kts"), "kotlin"),
    "lua": "lua",
    "md": "markdown",
    "json": "json",
    **dict.fromkeys(("yml", "yaml"), "yaml"),
    "toml": "toml",
    "sql": "sql",
    **dict.fromkeys(("tf", "tfvars"), "terraform"),
    "hcl": "hcl",
    **dict.fromkeys(("ini", "cfg", "conf", "properties"), "ini"),
}
BY_NAME = dict.fromkeys(("containerfile", "dockerfile"), "dockerfile") | dict.fromkeys(("gnumakefile", "makefile"), "make")
CODE = tuple("c cpp csharp go java javascript kotlin lua php python ruby rust typescript".split())
FULL_GRAPH = tuple(c for c in CODE if c != "lua")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """The path without its last part; files at the top are in (root)."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)).otherwise("(root)")


def _look_up(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def language(path: Column) -> Column:
    """The language of a path by its suffix, then its whole name, then its suffix taken as a name (web.Dockerfile); else null."""
    name = F.lower(file_name(path))
    suffix = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.coalesce(_look_up(BY_SUFFIX, suffix), _look_up(BY_NAME, name), _look_up(BY_NAME, suffix))


def parser(lang: Column) -> Column:
    return F.when(lang.isin(*CODE), "treesitter").otherwise("line")


def graph_tier(lang: Column) -> Column:
    return F.when(lang.isin(*FULL_GRAPH), "full").otherwise("partial")


def is_secret_name(path: Column) -> Column:
    """Names of files that hold credentials and must never be indexed."""
    name = F.lower(file_name(path))
    exact = name.isin("credentials.json", "secrets.json", "service-account.json", "id_ed25519", "id_rsa", ".env")
    return exact | name.startswith(".env.") | name.rlike(r"\.(pem|key|p12|pfx)$")


def is_generated(path: Column) -> Column:
    name = F.lower(file_name(path))
    return name.contains(".generated.") | name.endswith(".generated") | name.endswith(".min.js") | name.endswith(".min.css")


def is_test(path: Column) -> Column:
    """Test files as ranking sees them: a test directory above, a test stem, or .test. / .spec. in the name."""
    parts = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    name = F.element_at(parts, -1)
    stem = F.element_at(F.split(name, r"\."), 1)
    above = F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(x) for x in "__test__ __tests__ e2e spec specs test testing tests".split()]))
    return above | (stem == "test") | stem.startswith("test_") | stem.endswith("_test") | name.contains(".test.") | name.contains(".spec.")


def is_test_for_labels(path: Column) -> Column:
    """Test files as community labels see them: any part of the path counts, the rules for names differ."""
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    among = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in "__tests__ spec specs test tests".split()]))
    return among | name.startswith("test_") | name.startswith("test.") | name.contains("_test.") | name.contains(".test.")


def looks_binary(content: Column, prefix: int = 4096) -> Column:
    """Whether a zero byte stands among the first bytes."""
    return F.contains(F.substring(content, 1, prefix), F.unhex(F.lit("00")))


def depth_suffixes(path: Column) -> Column:
    """Every suffix of a path that begins at a part, lower-cased, the longest first."""
    parts = F.split(F.lower(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))
