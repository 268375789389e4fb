"""Column expressions over file paths and repository addresses."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by file extension.
LANGUAGES = {
    "Python": "py pyw pyi", "JavaScript": "js jsx mjs cjs", "TypeScript": "ts tsx", "Java": "java", "Kotlin": "kt kts", "Scala": "scala", "C": "c h", "C++": "cpp cc cxx hpp hxx", "Go": "go", "Rust": "rs",
    "Ruby": "rb", "PHP": "php", "R": "r", "C#": "cs", "Swift": "swift", "Shell": "sh", "Bash": "bash", "Zsh": "zsh", "PowerShell": "ps1", "JSON": "json", "YAML": "yaml yml", "TOML": "toml", "XML": "xml", "SQL": "sql",
    "HTML": "html htm", "CSS": "css", "SCSS": "scss", "SASS": "sass", "Less": "less", "Markdown": "md", "reStructuredText": "rst", "Text": "txt",
}
#: Extensions by chunking strategy; the rest is fixed.
STRATEGIES = {"semantic": "md markdown rst txt adoc", "ast": "py pyw js jsx ts tsx mjs"}
#: Directories and files left out of a scan.
EXCLUDED = ("node_modules", ".git", "venv", ".venv", "env", "__pycache__", "dist", "build", ".next", "coverage", ".pytest_cache", ".mypy_cache", "vendor", "auto-generated")
EXCLUDED_FILES = ("*.min.js", "*.min.css", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "*.pyc", "*.pyo", "*.so", "*.dll", "*.exe", "*.bin", "*.generated.*")


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The lower-cased characters behind the last dot of the file's name; none where the name only begins with a dot."""
    return F.lower(F.regexp_extract(name(path), r"^.+\.([^.]+)$", 1))


def language(path: Column) -> Column:
    ext = extension(path)
    pairs = [x for lang, exts in LANGUAGES.items() for e in exts.split() for x in (F.lit(e), F.lit(lang))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), ext), F.lit("Unknown"))


def strategy(path: Column) -> Column:
    ext = extension(path)
    out = F.when(ext.isin(*STRATEGIES["semantic"].split()), "semantic").when(ext.isin(*STRATEGIES["ast"].split()), "ast")
    return out.otherwise("fixed")


def matches(column: Column, globs: tuple[str, ...]) -> Column:
    """Whether a string matches any glob; the globs become one regular expression on the driver."""
    joined = "|".join(fnmatch.translate(g).replace(r"\Z", "$").replace(r"\z", "$") for g in globs)
    return column.rlike(f"^(?:{joined})")


def excluded(path: Column, directories: tuple[str, ...] = EXCLUDED, files: tuple[str, ...] = EXCLUDED_FILES) -> Column:
    """Whether any directory of the path, at the root too, or the file's name is left out of scans."""
    parents = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(parents, lambda p: p.isin(*directories)) | matches(name(path), files)


def repository(url: Column) -> Column:
    """(owner, repo) of a repository address: shorthand, ssh, https or without scheme; NULL where it is none."""
    u = F.trim(url)
    short = F.regexp_extract(u, r"^([\w.-]+)/([\w.-]+)$", 1) != ""
    ssh = u.startswith("git@github.com:")
    web = F.regexp_extract(u, r"(?i)^(?:[a-z][a-z0-9+.-]*://)?([^/]*github\.com[^/]*)/", 1) != ""
    pattern = F.when(short, F.regexp_extract(u, r"^([\w.-]+)/", 1)).when(ssh, F.regexp_extract(u, r"^git@github\.com:(.+)/[^/]+$", 1)).when(web, F.regexp_extract(u, r"(?i)github\.com[^/]*/([^/?#]+)/[^/?#]+", 1))
    repo = F.when(short, F.regexp_extract(u, r"/([\w.-]+)$", 1)).when(ssh, F.regexp_extract(u, r"/([^/]+)$", 1)).when(web, F.regexp_extract(u, r"(?i)github\.com[^/]*/[^/?#]+/([^/?#]+)", 1))
    clean = F.regexp_replace(repo, r"\.git$", "")
    return F.when((pattern != "") & (clean != ""), F.struct(pattern.alias("owner"), clean.alias("repo")))


def number_in(url: Column, kind: str) -> Column:
    """The number of a pull request (``pull``) or issue (``issues``) in an address, or NULL."""
    found = F.regexp_extract(url, rf"/{kind}/(\d+)", 1)
    return F.when(found != "", found.cast("bigint"))


def common_prefix(low: Column, high: Column) -> Column:
    """The common leading directories of two paths; of all paths of a group if given its least and greatest."""
    a, b = F.split(low, "/"), F.split(high, "/")
    same = F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1)))
    differing = F.filter(same, lambda i: ~F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)))
    upto = F.coalesce(F.get(differing, 0) - 1, F.least(F.size(a), F.size(b)))
    upto = F.when(low == high, F.size(a) - 1).otherwise(upto)
    return F.array_join(F.slice(a, F.lit(1), upto), "/")


#: Addresses of a hosted repository, its files, their raw content and its interface.
WEB, RAW, API = "https://github.com", "https://raw.githubusercontent.com", "https://api.github.com"


def repository_url(owner: Column, repo: Column) -> Column:
    return F.concat_ws("/", F.lit(WEB), owner, repo)


def file_url(owner: Column, repo: Column, path: Column, ref: Column | str = "main", first: Column | None = None, last: Column | None = None) -> Column:
    """The address of a file at a reference, with an anchor of lines if any are given."""
    ref = F.lit(ref) if isinstance(ref, str) else ref
    url = F.concat_ws("/", F.lit(WEB), owner, repo, F.lit("blob"), ref, normalised(path))
    if first is None:
        return url
    anchor = F.concat(F.lit("#L"), first.cast("string"))
    end = F.lit(None).cast("string") if last is None else F.when(last != first, F.concat(F.lit("-L"), last.cast("string")))
    return F.concat(url, F.coalesce(F.concat(anchor, end), anchor, F.lit("")))


def raw_url(owner: Column, repo: Column, path: Column, ref: Column | str = "main") -> Column:
    return F.concat_ws("/", F.lit(RAW), owner, repo, F.lit(ref) if isinstance(ref, str) else ref, normalised(path))


def api_url(owner: Column, repo: Column, *rest: Column | str) -> Column:
    return F.concat_ws("/", F.lit(API), F.lit("repos"), owner, repo, *[F.lit(x) if isinstance(x, str) else x for x in rest])


def normalised(path: Column) -> Column:
    """A path with forward slashes and none at its ends."""
    return F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", "")


def is_repository(url: Column) -> Column:
    return F.coalesce(repository(url).isNotNull(), F.lit(False))
