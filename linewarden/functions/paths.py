"""Predicates and projections over a relative ``path`` column (``/`` separated)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linewarden.functions.dialect import sql_literal
from linewarden.functions.text import fold_name

# Extension, directory and file name lists.
LISTING_BINARY_EXTENSIONS = (
    "exe", "dll", "so", "dylib", "bin", "png", "jpg", "jpeg", "gif", "ico", "pdf", "zip", "tar",
    "gz", "7z", "woff", "woff2",
)
BINARY_EXTENSIONS = (
    "exe", "dll", "so", "dylib", "bin", "png", "jpg", "jpeg", "gif", "ico", "pdf", "zip", "tar",
    "gz", "7z", "rar", "bz2", "xz", "woff", "woff2", "ttf", "eot", "mp3", "mp4", "avi", "mov",
    "wmv", "flv", "mkv", "class", "jar", "war", "ear", "a", "lib", "obj", "o",
)
TEXT_EXTENSIONS = (
    "txt", "md", "rst", "adoc", "json", "yaml", "yml", "toml", "xml", "html", "htm", "css",
    "scss", "sass", "less", "js", "jsx", "ts", "tsx", "py", "rs", "go", "java", "kt", "kts", "c",
    "h", "cpp", "hpp", "cc", "cxx", "cs", "php", "rb", "sh", "bash", "zsh", "fish", "ps1", "psm1",
    "sql", "graphql", "gql", "wsdl", "xsd", "dtd", "xslt", "svg", "vue", "svelte", "astro", "elm",
    "dart", "lua", "r", "rmd", "jl", "nim", "v", "zig", "cr", "ex", "exs", "erl", "hs", "lhs",
    "fs", "fsi", "fsx", "ml", "mli", "lisp", "lsp", "scm", "rkt", "clj", "cljs", "cljc", "edn",
    "pl", "pm", "t", "pod",
)
LISTING_IGNORED_DIRS = (
    ".git", "node_modules", "target", ".venv", "venv", "__pycache__", ".vscode", ".idea", "dist",
    "build",
)
IGNORED_DIRS = (
    ".git", ".svn", ".hg", "node_modules", "target", "build", "dist", ".venv", "venv",
    ".virtualenv", "__pycache__", ".pytest_cache", ".vscode", ".idea", ".vs", "vendor",
    "third_party", ".bundle", "tmp", "temp", ".gradle", "gradle", ".maven", "maven",
)
LOCK_FILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "cargo.lock", "go.sum", "pom.xml",
    "build.gradle", "gradle.lock", "gemfile.lock", "composer.lock", "packages.lock.json",
    "poetry.lock",
)
URL_SKIPPED_NAMES = ("package-lock.json", "yarn.lock", "Cargo.lock")
LANGUAGES = {
    "py": "python", "pyw": "python",
    "js": "javascript", "ts": "javascript", "jsx": "javascript", "tsx": "javascript",
    "php": "php",
    "java": "java", "jar": "java",
    "go": "go",
    "rs": "rust",
    "rb": "ruby",
    "cs": "csharp",
}
SUSPICIOUS_EXTENSIONS = (
    (".bak", "Backup file (may contain sensitive data)", "LOW"),
    (".backup", "Backup file (may contain sensitive data)", "LOW"),
    (".old", "Old version of file", "INFO"),
    (".tmp", "Temporary file", "INFO"),
    (".swp", "Vim swap file (may contain unsaved changes)", "LOW"),
    (".swo", "Vim swap file", "LOW"),
    (".~", "Backup file", "INFO"),
    (".log", "Log file (may contain sensitive information)", "LOW"),
    (".cache", "Cache file", "INFO"),
)
# Manifest name, language and description; the last two match as suffixes.
MANIFEST_NAMES = (
    ("package.json", "javascript", "npm/Node.js"),
    ("package-lock.json", "javascript", "npm lock file"),
    ("yarn.lock", "javascript", "Yarn lock file"),
    ("pnpm-lock.yaml", "javascript", "pnpm lock file"),
    ("requirements.txt", "python", "pip requirements"),
    ("Pipfile", "python", "Pipenv dependencies"),
    ("poetry.lock", "python", "Poetry lock file"),
    ("pyproject.toml", "python", "Python project config"),
    ("setup.py", "python", "Python setup file"),
    ("Cargo.toml", "rust", "Rust dependencies"),
    ("Cargo.lock", "rust", "Cargo lock file"),
    ("go.mod", "go", "Go module dependencies"),
    ("go.sum", "go", "Go module checksums"),
    ("Gemfile", "ruby", "Ruby dependencies"),
    ("Gemfile.lock", "ruby", "Ruby gem lock file"),
    ("composer.json", "php", "Composer dependencies"),
    ("composer.lock", "php", "Composer lock file"),
    ("pom.xml", "java", "Maven dependencies"),
    ("build.gradle", "java", "Gradle dependencies"),
)
MANIFEST_SUFFIXES = (
    (".csproj", "csharp", "NuGet / .NET project"),
    ("packages.config", "csharp", "NuGet packages"),
)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def raw_extension(path: Column) -> Column:
    """Text after the last dot of the file name; null without a dot or for ``.name``."""
    name = base_name(path)
    has_extension = name.rlike(r"(?s)\A.+\.[^.]*\z") & (name != "..")
    return F.when(has_extension, F.substring_index(name, ".", -1))


def extension(path: Column) -> Column:
    return F.lower(raw_extension(path))


def _in(value: Column, names, default: bool) -> Column:
    return F.coalesce(value.isin(list(names)), F.lit(default))


def is_binary_file(path: Column) -> Column:
    return _in(extension(path), BINARY_EXTENSIONS, False)


def is_text_file(path: Column) -> Column:
    return _in(extension(path), TEXT_EXTENSIONS, True)


def is_ignored_dir(name: Column) -> Column:
    return name.isin(list(IGNORED_DIRS))


def is_dependency_file(path: Column) -> Column:
    return F.lower(base_name(path)).isin(list(LOCK_FILES))


def is_listed(path: Column) -> Column:
    """Whether a directory listing keeps the file: 17 extensions, in this case only, are left out."""
    return ~_in(raw_extension(path), LISTING_BINARY_EXTENSIONS, False)


def below_ignored_dir(path: Column, names=tuple(LISTING_IGNORED_DIRS)) -> Column:
    """Whether any directory above the file is in the ignore list."""
    parts = F.split(path, "/", -1)
    return F.arrays_overlap(
        F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, names))
    )


def detect_language(path: Column) -> Column:
    pairs = ", ".join(f"'{known}', '{language}'" for known, language in LANGUAGES.items())
    return F.try_element_at(F.expr(f"map({pairs})"), raw_extension(path))


def is_url_skipped(path: Column) -> Column:
    """Lock files whose URLs are expected, found anywhere in the path."""
    a, b, c = (path.contains(name) for name in URL_SKIPPED_NAMES)
    return a | b | c


def manifest(path: Column, nested: bool = False) -> Column:
    """``struct(language, description, rank)`` of a dependency manifest, else null.

    The 19 named manifests count only at the root of the repository; ``nested=True`` takes
    them in any folder.  No path matches two patterns.
    """
    def entry(rank: int, language: str, description: str) -> str:
        return (
            f"named_struct('language', '{language}', 'description', {sql_literal(description)}, "
            f"'rank', {rank})"
        )

    known = ", ".join(
        f"{sql_literal(name.lower())}, {entry(rank, language, description)}"
        for rank, (name, language, description) in enumerate(MANIFEST_NAMES)
    )
    found = F.try_element_at(F.expr(f"map({known})"), fold_name(base_name(path) if nested else path))
    folded = fold_name(path)
    for rank, (suffix, *described) in enumerate(MANIFEST_SUFFIXES, len(MANIFEST_NAMES)):
        found = F.when(folded.endswith(suffix), F.expr(entry(rank, *described))).otherwise(found)
    return found


def repo_name(root: Column) -> Column:
    """Last component of a root path, ``unknown`` when there is none."""
    name = F.regexp_extract(root, r"([^/]+)/*\z", 1)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown"))
