"""What a path says: language, test, source, generated, kind of change, scope."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by suffix.
LANGUAGES = {
    ".py": "Python", ".pyi": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".go": "Go", ".rs": "Rust", ".java": "Java", ".kt": "Kotlin", ".scala": "Scala",
    ".rb": "Ruby", ".php": "PHP", ".cs": "C#", ".swift": "Swift", ".c": "C", ".h": "C/C++ header", ".cc": "C++", ".cpp": "C++", ".hpp": "C/C++ header", ".ex": "Elixir", ".exs": "Elixir", ".erl": "Erlang", ".clj": "Clojure", ".sh": "Shell", ".bash": "Shell",
    ".zsh": "Shell", ".sql": "SQL", ".html": "HTML", ".css": "CSS", ".scss": "CSS", ".less": "CSS", ".vue": "Vue", ".svelte": "Svelte", ".lua": "Lua", ".r": "R", ".jl": "Julia", ".yaml": "YAML", ".yml": "YAML", ".toml": "TOML", ".json": "JSON",
    ".md": "Markdown", ".rst": "reStructuredText", ".proto": "Protobuf", ".tf": "Terraform", ".dockerfile": "Docker",
}
#: Suffixes and base names of text that isn't code, folders of documentation, and marks of generated files.
NON_CODE = ".md .markdown .rst .txt .adoc .org .json .yaml .yml .toml .ini .cfg .properties .lock .sum .csv .tsv .xml .svg .png .jpg .jpeg .gif .ico .pdf .zip .gz .po .pot .snap .map".split()
NON_CODE_NAMES = "readme license licence copying notice authors contributors changelog changes history news todo install manifest codeowners maintainers version".split()
DOC_FOLDERS = "docs doc documentation examples example samples".split()
GENERATED_MARKS = [".min.js", ".min.css", ".bundle.js", "_pb2.py", ".g.dart", ".generated."]
#: Patterns of test paths (of the lower-cased path), of generated documents and of kinds of changed files.
TEST_PATHS = [r"(^|/)(tests?|specs?|__tests__|testing)(/|$)", r"(_test|\.test|\.spec|_spec)\.[a-z]+$", r"(^|/)test_[^/]+\.py$", r"(^|/)conftest\.py$"]
GENERATED_DOCUMENT = r"^docs/(codemap\.html|pr-[^/]+\.html)$"
MIGRATION, CONTRACT, BUILD = r"(^|/)(migrations?|schema|db/migrate)(/|$)", r"(openapi|swagger)\.", r"(^|/)(\.github|ci|\.circleci|\.gitlab)(/|$)"
MANIFESTS = "package.json package-lock.json yarn.lock pnpm-lock.yaml requirements.txt pyproject.toml poetry.lock uv.lock setup.py setup.cfg go.mod go.sum cargo.toml cargo.lock gemfile gemfile.lock pom.xml build.gradle build.gradle.kts composer.json".split()
CONTRACT_SUFFIXES, DOC_SUFFIXES, CONFIG_SUFFIXES = [".proto", ".graphql", ".graphqls", ".avsc", ".thrift"], [".md", ".rst", ".txt", ".adoc"], [".yaml", ".yml", ".toml", ".ini", ".env", ".cfg", ".conf", ".properties", ".json"]
#: Names of files that hold secrets, and of templates for them.
SECRET_NAMES, SECRET_FAMILY, SECRET_TEMPLATES = [".env", ".env.local"], ".env.", [".env.example", ".env.sample", ".env.template"]


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """The name's part from its last dot on; none for a name without one, or whose only dot begins or ends it."""
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def _any(column: Column, values: list[str], test) -> Column:
    made = F.lit(False)
    for v in values:
        made = made | test(column, v)
    return made


def language(path: Column) -> Column:
    low = F.lower(name(path))
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.when(low == "dockerfile", "Docker").when(low == "makefile", "Make").otherwise(F.coalesce(F.try_element_at(known, F.lower(suffix(path))), F.lit("Other")))


def is_test(path: Column) -> Column:
    return _any(F.lower(path), TEST_PATHS, lambda c, p: c.rlike(p))


def is_source(path: Column) -> Column:
    """Neither in a folder of documentation, nor text by suffix or base name, nor generated."""
    low, base = F.lower(path), F.lower(name(path))
    folders = F.split(low, "/")
    documented = F.arrays_overlap(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), F.array(*map(F.lit, DOC_FOLDERS)))
    prose = (suffix(path) == "") & F.substring_index(base, ".", 1).isin(NON_CODE_NAMES)
    return ~(documented | F.lower(suffix(path)).isin(NON_CODE) | prose | _any(base, GENERATED_MARKS, lambda c, m: c.contains(m)))


def is_generated_document(path: Column) -> Column:
    return path.rlike(GENERATED_DOCUMENT)


def change_kind(path: Column) -> Column:
    """What a changed file is: the first of eight kinds that fits."""
    low, base, ext = F.lower(path), F.lower(name(path)), F.lower(suffix(path))
    return (
        F.when(is_test(path), "test").when(low.rlike(MIGRATION) | (ext == ".sql"), "schema/migration").when(base.isin(MANIFESTS), "dependencies").when(base.rlike(CONTRACT) | ext.isin(CONTRACT_SUFFIXES), "api-contract")
        .when(low.rlike(BUILD) | _any(base, [".gitlab-ci", "jenkinsfile", "dockerfile"], lambda c, x: c.startswith(x)) | (base == "makefile"), "build/ci").when(ext.isin(DOC_SUFFIXES), "docs").when(ext.isin(CONFIG_SUFFIXES), "config").otherwise("source")
    )


def is_secret_name(path: Column) -> Column:
    n = name(path)
    return n.isin(SECRET_NAMES) | (n.startswith(SECRET_FAMILY) & ~n.isin(SECRET_TEMPLATES))


def within(path: Column, roots: Column) -> Column:
    """Whether the path is one of the roots (an array) or below one, in whole parts; '' is below none, the root '' holds all."""
    return (F.coalesce(path, F.lit("")) != "") & F.exists(roots, lambda r: (r == "") | (path == r) | path.startswith(F.concat(F.rtrim(r, F.lit("/")), F.lit("/"))))


def relative(value: Column, root: str) -> Column:
    """The text with the absolute root cut off its paths; the root itself is '.'."""
    bare = root.rstrip("/")
    return F.replace(F.replace(value, F.lit(bare + "/"), F.lit("")), F.lit(bare), F.lit("."))


def href(source: Column, target: Column) -> Column:
    """The way from one document to another: up out of the folders that aren't shared, then down; both are paths from one root."""
    here, there = F.slice(F.split(source, "/"), 1, F.size(F.split(source, "/")) - 1), F.split(target, "/")
    shared = F.size(F.filter(F.sequence(F.lit(0), F.size(there) - 1), lambda i: (i < F.size(here)) & (i < F.size(there) - 1) & (F.slice(here, F.lit(1), i + 1) == F.slice(there, F.lit(1), i + 1))))
    up = F.array_repeat(F.lit(".."), F.size(here) - shared)
    encoded = lambda part: F.replace(F.url_encode(part), F.lit("+"), F.lit("%20"))
    return F.array_join(F.concat(up, F.transform(F.slice(there, shared + 1, F.size(there)), encoded)), "/")
