"""Reading directory trees as (path, content), and the rules for what is left out."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.shared import numbered, settle
from glyphmill.functions.text import basename

# Directories that are never entered.
SKIP_DIRS = [
    ".git", ".claude", "node_modules", ".zig-cache", "zig-out", ".next", ".nuxt", ".svelte-kit", "dist", "build", ".build", ".output", "out",
    "__pycache__", ".venv", "venv", ".env", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "target", ".gradle", ".idea", ".vs", "vendor", "Pods",
    ".dart_tool", ".pub-cache", "coverage", ".nyc_output", ".turbo", ".parcel-cache", ".cache", ".tmp", ".temp", ".DS_Store", "bundle", ".bundle", ".swc",
    ".terraform", ".terragrunt-cache", ".serverless", "elm-stuff", ".stack-work", ".cabal-sandbox", ".cargo", "bower_components",
]
# Suffixes of files that are not text.
SKIP_SUFFIXES = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".icns", ".webp", ".svg", ".ttf", ".otf", ".woff", ".woff2", ".eot", ".zip", ".tar", ".gz", ".bz2", ".xz",
    ".7z", ".rar", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".pptx", ".mp3", ".mp4", ".wav", ".avi", ".mov", ".flv", ".ogg", ".webm", ".exe", ".dll", ".so",
    ".dylib", ".o", ".a", ".lib", ".wasm", ".pyc", ".pyo", ".class", ".db", ".sqlite", ".sqlite3", ".lock", ".sum", ".DS_Store",
]
# Names, suffixes and folders of files that hold secrets.
SENSITIVE_NAMES = [".dev.vars", ".npmrc", ".pypirc", ".netrc", "credentials.json", "service-account.json", "secrets.json", "secrets.yaml", "secrets.yml", "id_rsa", "id_ed25519"]
SENSITIVE_SUFFIXES = [".pem", ".key", ".p12", ".pfx", ".jks"]
SENSITIVE_FOLDERS = [".ssh/", ".gnupg/", ".aws/"]
# Language by suffix, first match wins.
LANGUAGES = [
    ("zig", [".zig"]), ("c", [".c", ".h"]), ("cpp", [".cpp", ".hpp"]), ("python", [".py"]), ("javascript", [".js", ".jsx"]), ("typescript", [".ts", ".tsx"]), ("rust", [".rs"]),
    ("go_lang", [".go"]), ("php", [".php"]), ("ruby", [".rb", ".rake"]), ("hcl", [".tf", ".tfvars", ".hcl"]), ("r", [".r", ".R"]), ("markdown", [".md"]), ("json", [".json"]),
    ("yaml", [".yaml", ".yml"]), ("dart", [".dart"]),
]
LARGEST, SNIFFED = 512 * 1024, 512
#: The engine's own ignore file, read before ``.gitignore``.
IGNORE_FILE = ".glyphmillignore"


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def in_skipped_dir(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(SKIP_DIRS))


def has_skipped_suffix(path: Column) -> Column:
    return _any([path.endswith(s) for s in SKIP_SUFFIXES])


def is_sensitive(path: Column) -> Column:
    name = basename(path)
    return _any([name.startswith(".env"), name.isin(SENSITIVE_NAMES), *(name.endswith(s) for s in SENSITIVE_SUFFIXES), *((path.contains(d) & (name != "")) for d in SENSITIVE_FOLDERS)])


def language(path: Column) -> Column:
    out = None
    for name, suffixes in LANGUAGES:
        hit = _any([path.endswith(s) for s in suffixes])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def parse_ignore(text: str, negation: bool) -> list[str]:
    """Rules of an ignore file; ``negation`` keeps lines that start with ``!``."""
    rules = (x.strip(" \t\r") for x in text[: 64 * 1024].split("\n"))
    return [r for r in rules if r and not r.startswith("#") and (negation or not r.startswith("!"))]


def ignored(path: Column, rules: list[str]) -> Column:
    """``/x`` at the root (exactly, or as a prefix), ``x/`` a folder, ``*x`` a name's end, ``x`` a name or leading folder."""
    parts, tests = F.split(path, "/"), []
    for r in rules:
        if r.startswith("/"):
            tests.append(path.startswith(r[1:].rstrip("/")))
        elif r.endswith("/"):
            tests.append(F.array_contains(parts, r[:-1]) & (basename(path) != r[:-1]))
        elif r.startswith("*"):
            tests.append(basename(path).endswith(r[1:]))
        else:
            tests.append(F.array_contains(parts, r) | path.startswith(r + "/"))
    return _any(tests)


def indexable_root(path: str) -> bool:
    """Whether a folder may be indexed: not empty, the root, a temporary or a home folder."""
    if not path or path == "/" or any(path == t or path.startswith(t + "/") for t in ("/tmp", "/private/tmp", "/var/tmp")):
        return False
    home = [p for p in path.split("/") if p]
    return path not in (os.environ.get("HOME", ""), "/root") and not (len(home) == 2 and home[0] in ("home", "Users"))


def safe_path(path: str) -> bool:
    return bool(path) and not path.startswith("/") and "\0" not in path and "\\" not in path and ".." not in path.split("/")


def _open(root: str):
    """(file system, folder) of a path or URI, for the driver and executors alike."""
    import pyarrow.fs as pafs

    fs, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), os.path.abspath(root))
    return fs, base.rstrip("/")


def read_bytes(root: str, path: str, most: int) -> bytes | None:
    """The bytes of one file, or None if it is missing, no file, or larger than ``most``."""
    import pyarrow.fs as pafs

    fs, base = _open(root)
    info = fs.get_file_info(f"{base}/{path}")
    if info.type != pafs.FileType.File or info.size > most:
        return None
    with fs.open_input_stream(info.path) as f:
        return f.read()


def read_file(root: str, path: str, most: int = 10 << 20) -> str | None:
    """The text of one file below ``root``; None for unsafe and sensitive paths, missing and too large files."""
    if not safe_path(path) or sensitive_path(path):
        return None
    data = read_bytes(root, path, most)
    return None if data is None else data.decode("utf-8", "replace")


def sensitive_path(path: str) -> bool:
    """:func:`is_sensitive` for one path on the driver."""
    name = path.rsplit("/", 1)[-1]
    return name.startswith(".env") or name in SENSITIVE_NAMES or name.endswith(tuple(SENSITIVE_SUFFIXES)) or (name != "" and any(d in path for d in SENSITIVE_FOLDERS))


def ignore_rules(root: str) -> list[str]:
    """The rules of the ignore files at the root, each read by its own path."""
    rules = []
    for name, negation in ((IGNORE_FILE, True), (".gitignore", False)):
        data = read_bytes(root, name, 1 << 40)
        rules += parse_ignore(data.decode("utf-8", "replace"), negation) if data else []
    return rules


def list_files(spark: SparkSession, root: str, rules: list[str] | None = None) -> DataFrame:
    """(path, size, mtime) of the regular files below ``root`` that no folder rule leaves out.

    Folders are listed on executors, one level a round, and those that are
    skipped or ignored are not entered. Names may start with a dot or an
    underscore. Links are not followed out of a listing.
    """
    rules = ignore_rules(root) if rules is None else rules

    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        fs, base = _open(root)
        for b in batches:
            rows = []
            for folder in b.path:
                for info in fs.get_file_info(pafs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True)):
                    path = info.path[len(base) + 1 :]
                    if info.type == pafs.FileType.Directory and info.base_name not in SKIP_DIRS:
                        rows.append((path, True, 0, None))
                    elif info.type == pafs.FileType.File:
                        rows.append((path, False, info.size, info.mtime))
            yield pd.DataFrame({"path": [r[0] for r in rows], "folder": [r[1] for r in rows], "size": [r[2] for r in rows], "mtime": pd.to_datetime([r[3] for r in rows], utc=True)})

    found, frontier = None, spark.range(1).select(F.lit("").alias("path"))
    while True:
        step = frontier.mapInPandas(listing, "path string, folder boolean, size long, mtime timestamp")
        step = settle(step.where(~F.col("folder") | ~ignored(F.concat("path", F.lit("/_")), rules)))
        files = step.where(~F.col("folder")).select("path", "size", "mtime")
        found = files if found is None else found.unionByName(files)
        frontier = step.where("folder").select("path")
        if frontier.isEmpty():
            return found
        frontier = frontier.repartition(spark.sparkContext.defaultParallelism)


def read_files(spark: SparkSession, root: str, largest: int = LARGEST, policy: bool = True) -> DataFrame:
    """(path, content, size, mtime) of the text files below ``root``, less what the rules leave out.

    With ``policy`` a root that must not be indexed raises an error. Files
    over ``largest`` bytes and those with a zero byte among the first
    ``SNIFFED`` are left out; contents are decoded as UTF-8, with marks in
    place of what isn't. Contents are read on executors, file by file.
    """
    if policy and not indexable_root(root):
        raise ValueError(f"{root} may not be indexed")
    rules, p = ignore_rules(root), F.col("path")
    rows = list_files(spark, root, rules).where((F.col("size") <= largest) & ~in_skipped_dir(p) & ~has_skipped_suffix(p) & ~is_sensitive(p) & ~ignored(p, rules))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _open(root)
        for b in batches:
            for lo in range(0, len(b), 64):
                part, texts = b.iloc[lo : lo + 64], []
                for path in part.path:
                    try:
                        with fs.open_input_stream(f"{base}/{path}") as f:
                            data = f.read()
                        texts.append(None if b"\0" in data[:SNIFFED] else data.decode("utf-8", "replace"))
                    except OSError:  # gone or unreadable since it was listed
                        texts.append(None)
                yield part.assign(content=texts)[["path", "content", "size", "mtime"]]

    return rows.mapInPandas(read, "path string, content string, size long, mtime timestamp").where("content is not null")


def with_trigrams(files: DataFrame, largest: int = 64 * 1024, most: int = 15_000) -> DataFrame:
    """Adds ``eligible``: whether a bounded index would take the file's trigrams, by size and by place in path order.

    The engine itself indexes every file; the flag only reproduces tiers.
    """
    out = numbered(files, ["path"], "_n")
    return out.withColumn("eligible", (F.octet_length("content") <= largest) & (F.col("_n") <= most)).drop("_n")


def documents_as_files(docs: DataFrame) -> DataFrame:
    """The text corpus in the shape of files."""
    return docs.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.col("text").alias("content"))
