"""Languages by file extension, as lookup columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line-comment marker by extension; none where it is missing.
LINE_COMMENT = {
    ".py": "#",
    ".js": "//", ".jsx": "//", ".ts": "//", ".tsx": "//", ".mjs": "//", ".cjs": "//", ".scss": "//",
    ".rs": "//", ".go": "//", ".java": "//", ".kt": "//", ".cs": "//", ".cpp": "//", ".hpp": "//", ".h": "//",
}

# Block-comment markers by extension.
BLOCK_COMMENT = {
    ".py": ('"""', '"""'),
    ".html": ("<!--", "-->"), ".vue": ("<!--", "-->"),
    ".css": ("/*", "*/"), ".scss": ("/*", "*/"), ".js": ("/*", "*/"), ".jsx": ("/*", "*/"), ".ts": ("/*", "*/"), ".tsx": ("/*", "*/"),
    ".rs": ("/*", "*/"), ".go": ("/*", "*/"), ".java": ("/*", "*/"), ".kt": ("/*", "*/"), ".cs": ("/*", "*/"), ".cpp": ("/*", "*/"),
    ".hpp": ("/*", "*/"), ".h": ("/*", "*/"),
}

# Extensions that each scan takes.
C_FAMILY = (".rs", ".go", ".java", ".kt", ".cs", ".cpp", ".hpp", ".h")
LOC_EXTS = (".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".css", ".scss", ".html", ".vue", ".svelte", *C_FAMILY)
DUPLICATE_EXTS = (".py", ".js", ".jsx", ".ts", ".tsx", ".css", ".scss", ".html", *C_FAMILY)
JS_EXTS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")

# Directories that scans skip.
SKIP_DIRS = ("node_modules", ".git", "dist", "build", ".next", "__pycache__", ".venv", "venv", "coverage", ".turbo", "out")
COVERAGE_SKIP_DIRS = (*SKIP_DIRS, ".mypy_cache")

# Languages that are measured by outside tools, and those tools.
HARD_LANGUAGES = {
    ".rs": "Rust", ".go": "Go", ".java": "Java", ".kt": "Kotlin", ".cs": "C#", ".cpp": "C++", ".hpp": "C++", ".h": "C/C++",
}
TOOL_HINTS = {
    "Rust": "cargo clippy",
    "Go": "gocyclo (or golangci-lint with gocyclo enabled)",
    "Java": "pmd check -R rulesets/java/cyclomaticcomplexity.xml",
    "Kotlin": "detekt",
    "C#": "npx lizard (or Roslyn complexity analyzers)",
    "C++": "npx lizard (or clang-tidy)",
    "C/C++": "npx lizard (or clang-tidy)",
}


def lookup(key: Column, table: dict[str, str | None]) -> Column:
    """table[key], null where it has none. A map literal: no join, no broadcast."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable((k, v) for k, v in table.items() if v is not None)])
    return F.try_element_at(pairs, key)


def line_marker(ext: Column) -> Column:
    return lookup(ext, LINE_COMMENT)


def block_start(ext: Column) -> Column:
    return lookup(ext, {k: v[0] for k, v in BLOCK_COMMENT.items()})


def block_end(ext: Column) -> Column:
    return lookup(ext, {k: v[1] for k, v in BLOCK_COMMENT.items()})


def language_hints(files):
    """language, hint: the outside tools for the hard languages among ``files(ext)``."""
    name = lookup(F.col("ext"), HARD_LANGUAGES)
    return (
        files.select(name.alias("language")).where("language IS NOT NULL").distinct()
        .withColumn("hint", lookup(F.col("language"), TOOL_HINTS))
    )
