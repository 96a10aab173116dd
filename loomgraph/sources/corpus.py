"""Corpus scan, ignore rules, language ownership, tallies, hashes and lines."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomgraph.functions.paths import extension, segments, top_directory
from loomgraph.plans.ranking import top_rows
from loomgraph.session import cut, ship, small_side
from loomgraph.sources import tree

# Directories never read, besides hidden ones.
SKIPPED_DIRECTORIES = ["venv", ".venv", "node_modules", "__pycache__"]
# Each language's extensions and generated directories.
_WEB_BUILDS = [".next", ".nuxt", ".output", "build", "coverage", "dist", "out",
               "storybook-static", "web_dist"]
OWNERS = [
    ("python", [".py"], []),
    ("javascript", [".cjs", ".js", ".jsx", ".mjs"], _WEB_BUILDS),
    ("typescript", [".cts", ".mts", ".ts", ".tsx"], _WEB_BUILDS),
    ("go", [".go"], ["testdata", "vendor"]),
    ("java", [".java"], ["build", "out", "target"]),
    ("rust", [".rs"], ["target"]),
    ("csharp", [".cs"], ["bin", "obj"]),
]
# Extensions of languages with modules and calls; NULL where the
# extension alone does not name one language.
CHARTABLE = {
    ".c": "C", ".cc": "C++", ".cjs": "JavaScript", ".clj": "Clojure", ".cljs": "Clojure", ".cpp": "C++",
    ".cs": "C#", ".cts": "TypeScript", ".cxx": "C++", ".dart": "Dart", ".erl": "Erlang", ".ex": "Elixir",
    ".exs": "Elixir", ".go": "Go", ".groovy": "Groovy", ".hpp": "C++", ".hs": "Haskell", ".java": "Java",
    ".jl": "Julia", ".js": "JavaScript", ".jsx": "JavaScript", ".kt": "Kotlin", ".kts": "Kotlin", ".lua": "Lua",
    ".mjs": "JavaScript", ".mm": "Objective-C++", ".mts": "TypeScript", ".php": "PHP", ".py": "Python",
    ".rb": "Ruby", ".rs": "Rust", ".scala": "Scala", ".swift": "Swift", ".ts": "TypeScript", ".tsx": "TypeScript",
    ".zig": "Zig", ".fs": None, ".h": None, ".m": None, ".ml": None, ".pl": None, ".r": None,
}
SCOPE_ROWS = 6
# Line ends as Python's splitlines sees them.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def scan_roots(roots: DataFrame) -> DataFrame:
    """Read the trees of ``(project, root)`` as ``(project, path, ext, content)``.

    A root is a directory or a single file. Paths are judged by the skipped
    directories and by each root's ``.gitignore`` before anything else is read,
    so contents that will not be kept are never opened. The result is written:
    every later use reads a table and not the trees.
    """

    def keep(listed: DataFrame, contents: Callable[[DataFrame], DataFrame]) -> DataFrame:
        rules = ignore_rules(contents(listed.where(F.col("path") == ".gitignore")))
        return _without_ignored(listed, cut(rules, "rules"))

    return cut(with_extension(tree.read_tree(roots, SKIPPED_DIRECTORIES, keep)), "corpus")


def scan_directory(spark: SparkSession, root: str, project: str) -> DataFrame:
    """One tree, or one file, as a corpus."""
    return scan_roots(spark.createDataFrame([(project, root)], "project string, root string"))


def scan_table(corpus: DataFrame) -> DataFrame:
    """A stored corpus table in the same shape; its text may be string or binary."""
    return with_extension(corpus.select("project", "path", F.col("content").cast("binary").alias("content")))


def with_extension(files: DataFrame) -> DataFrame:
    return files.select("project", "path", extension(F.col("path")).alias("ext"), "content")


# ---- ignore rules --------------------------------------------------------

def _nested_plain(expression: str) -> str:
    """Escape ``[`` inside a character class, which Java would read as a class of its own."""
    out, inside = [], False
    for place, c in enumerate(expression):
        escaped = place > 0 and expression[place - 1] == "\\" and not expression[:place].endswith("\\\\")
        if inside and c == "[" and not escaped:
            out.append("\\")
        elif not escaped:
            inside = c == "[" or (inside and c != "]")
        out.append(c)
    return "".join(out)


@F.pandas_udf(StringType())
def _class_regex(pattern: pd.Series) -> pd.Series:
    """A shell pattern with character classes as a regular expression that Java reads the same way."""
    return pattern.map(lambda p: r"\A" + _nested_plain(fnmatch.translate(p)).replace(r"\Z", r"\z"))


def _plain_regex(pattern: Column) -> Column:
    """A shell pattern of stars, question marks and plain text as a regular expression."""
    quoted = F.replace(F.replace(pattern, F.lit("*"), F.lit(r"\E.*\Q")), F.lit("?"), F.lit(r"\E.\Q"))
    return F.concat(F.lit(r"(?s)\A\Q"), quoted, F.lit(r"\E\z"))


def _rule_key(pattern: Column) -> Column:
    """What an entry must hold for a rule to match it: a whole segment, a last suffix, or nothing in particular.

    Segments without glob characters match themselves, and the longest is the
    key. Else, where the pattern's own suffix has none, the key is that suffix.
    """
    plain = F.filter(segments(pattern), lambda part: ~part.rlike(r"[*?]"))
    longest = F.sort_array(F.transform(plain, lambda part: F.struct(F.length(part).alias("n"), part.alias("part"))), asc=False)
    suffix = F.regexp_extract(pattern, r"\.([^./*?]+)$", 1)
    return F.when(pattern.rlike(r"[\[\\]"), F.lit("")).when(
        F.size(plain) > 0, F.concat(F.lit("/"), F.try_element_at(longest, F.lit(1))["part"])
    ).when(suffix != "", F.concat(F.lit("."), suffix)).otherwise(F.lit(""))


def _entry_keys(entry: Column) -> Column:
    """All keys of rules that can match an entry."""
    parts = segments(entry)
    suffixes = F.filter(F.transform(parts, lambda part: F.regexp_extract(part, r"\.([^.]+)$", 1)), lambda s: s != "")
    return F.array_distinct(F.concat(
        F.array(F.lit("")), F.transform(parts, lambda part: F.concat(F.lit("/"), part)), F.transform(suffixes, lambda s: F.concat(F.lit("."), s))))


def ignore_rules(corpus: DataFrame) -> DataFrame:
    """The rules of every project's root ``.gitignore``, in file order, each with the key that entries fetch it by."""
    ship(corpus.sparkSession)
    text = corpus.where(F.col("path") == ".gitignore").select("project", F.col("content").cast("string").alias("text"))
    lines = text.select("project", F.posexplode(F.split("text", LINE_END)).alias("rule_no", "line")).select(
        "project", "rule_no", F.regexp_replace("line", r"(?U)^\s+|\s+\z", "").alias("line")
    ).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    negated = F.col("line").startswith("!")
    raw = F.when(negated, F.expr("substring(line, 2)")).otherwise(F.col("line"))
    pattern = F.regexp_replace(F.regexp_replace(raw, "/+$", ""), "^/+", "")
    rules = lines.select(
        "project", "rule_no", negated.alias("negated"), raw.endswith("/").alias("directory_only"),
        pattern.alias("pattern"), pattern.contains("/").alias("rooted"), _rule_key(pattern).alias("key"))
    special = F.col("pattern").rlike(r"[\[\\]")
    return rules.where(~special).withColumn("regex", _plain_regex(F.col("pattern"))).unionByName(
        rules.where(special).withColumn("regex", _class_regex("pattern")))


def rule_candidates(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Every ``(project, entry, is_directory)`` with the rules whose key it holds."""
    keyed = paths.withColumn("key", F.explode(_entry_keys(F.col("entry"))))
    return keyed.join(rules, ["project", "key"]).drop("key")


def _rule_hits(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Whether the last matching rule ignores each ``(project, entry, is_directory)``."""
    entry = F.col("entry")
    under = F.startswith(entry, F.concat("pattern", F.lit("/")))
    by_name = F.exists(segments(entry), lambda part: F.regexp(part, F.col("regex")))
    hit = F.when(F.col("rooted"), F.regexp(entry, F.col("regex")) | under).otherwise(by_name)
    applies = ~F.col("directory_only") | F.col("is_directory") | under
    return (
        rule_candidates(paths, rules).where(hit & applies)
        .groupBy("project", "entry", "is_directory")
        .agg(F.max_by("negated", "rule_no").alias("negated"))
        .where(~F.col("negated")).select("project", "entry", "is_directory")
    )


def _plain_paths(files: DataFrame) -> DataFrame:
    """Files that are not under a hidden or skipped directory."""
    everywhere = [set(d) for _, _, d in OWNERS]
    barred = SKIPPED_DIRECTORIES + sorted(set.intersection(*everywhere))
    parts = segments(F.col("path"))
    return files.where(~F.exists(
        F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda d: d.startswith(".") | d.isin(*barred)))


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``(project, path)`` of files that the rules ignore, or that lie under an ignored directory.

    Every directory above a file is judged on its own, since nothing below an
    ignored directory is ever read; a later ``!`` rule cannot bring it back.
    Directories are judged once each, not once per file. Projects without
    rules take no part.
    """
    parts = segments(F.col("path"))
    parents = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = F.when(F.size(parts) > 1, parents).otherwise(F.array().cast("array<string>"))
    ruled = paths.join(rules.select("project").distinct(), "project", "left_semi")
    listed = ruled.select("project", "path", F.explode(F.array_append(
        F.transform(above, lambda d: F.struct(d.alias("entry"), F.lit(True).alias("is_directory"))),
        F.struct(F.col("path").alias("entry"), F.lit(False).alias("is_directory")))).alias("e")
    ).select("project", "path", "e.entry", "e.is_directory")
    judged = _rule_hits(listed.select("project", "entry", "is_directory").distinct(), rules)
    return listed.join(judged, ["project", "entry", "is_directory"], "left_semi").select("project", "path").distinct()


def _without_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files`` whose paths are neither barred nor ignored. Paths alone are judged and shuffled."""
    plain = _plain_paths(files)
    dropped = cut(ignored_paths(plain.select("project", "path"), rules), "ignored")
    return plain.join(small_side(dropped), ["project", "path"], "left_anti")


def keep_readable(corpus: DataFrame) -> DataFrame:
    """Drop files under hidden, skipped or ignored directories, and ignored files.

    Contents stay where they are as long as the table of ignored paths is small
    enough to broadcast, which is measured; a scan of a tree judges paths
    before it reads, and does without even that.
    """
    return _without_ignored(corpus, cut(ignore_rules(corpus), "rules"))


# ---- ownership and tallies -----------------------------------------------

def _owner_table(spark: SparkSession) -> DataFrame:
    rows = [(owner, ext, ignored) for owner, exts, ignored in OWNERS for ext in exts]
    return F.broadcast(spark.createDataFrame(rows, "language string, ext string, ignored array<string>"))


def ownership(files: DataFrame) -> DataFrame:
    """One row per file and owning language, generated directories left out."""
    owners = _owner_table(files.sparkSession)
    return files.join(owners, "ext").where(
        ~F.arrays_overlap(segments(F.col("path")), F.col("ignored"))).drop("ignored")


def unsupported_tally(files: DataFrame) -> DataFrame:
    """Files of chartable languages that no owner knows by extension."""
    spark = files.sparkSession
    charted = F.broadcast(spark.createDataFrame(list(CHARTABLE.items()), "ext string, named string"))
    known = _owner_table(spark).select("ext").distinct()
    return files.join(F.broadcast(known), "ext", "left_anti").join(charted, "ext").groupBy(
        "project", "ext", F.col("named").alias("language")).agg(F.count("*").alias("count"))


def scope_counts(owned: DataFrame) -> DataFrame:
    """Owned files by top-level directory, the six busiest per project."""
    counts = owned.select("project", "path").distinct().groupBy(
        "project", top_directory(F.col("path")).alias("scope")).agg(F.count("*").alias("files"))
    return top_rows(counts, ["project"], [F.desc("files"), F.col("scope")], SCOPE_ROWS)


def file_hash(files: DataFrame) -> DataFrame:
    return files.select("project", "path", F.sha2("content", 256).alias("sha256"))


# ---- lines ---------------------------------------------------------------

@F.pandas_udf(StringType())
def _declared_text(content: pd.Series) -> pd.Series:
    """Python files name their own encoding; unreadable ones are replaced."""
    return content.map(lambda raw: python_text(raw)[0])


def python_text(raw: bytes) -> tuple[str, bool]:
    """Text of a Python file by its declared encoding, and whether that worked."""
    import io
    import tokenize

    try:
        name, _ = tokenize.detect_encoding(io.BytesIO(raw).readline)
        return io.TextIOWrapper(io.BytesIO(raw), name).read(), True
    except (SyntaxError, UnicodeDecodeError, LookupError):
        return raw.decode("utf-8", errors="replace"), False


def decode_text(files: DataFrame) -> DataFrame:
    """Add ``text``. Only Python files that declare an encoding need Python.

    A declaration can stand in the first two lines only, so the JVM tests those
    and decodes everything else itself.
    """
    head = F.substring_index(F.decode("content", "ISO-8859-1"), "\n", 2)
    declared = (F.col("ext") == ".py") & (
        head.rlike("coding[:=]") | (F.hex(F.substring(F.col("content"), 1, 3)) == "EFBBBF"))
    plain = files.where(~declared).withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))
    special = files.where(declared).withColumn("text", _declared_text("content"))
    return plain.unionByName(special).drop("content")


def decode_lines(files: DataFrame) -> DataFrame:
    """``(project, path, lineno, text)``; a closing line end adds no line."""
    pieces = F.split("text", LINE_END, -1)
    whole = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    return decode_text(files).select("project", "path", F.posexplode(whole).alias("n", "line")).select(
        "project", "path", (F.col("n") + 1).alias("lineno"), F.col("line").alias("text"))


def module_loc(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Lines per file, at least one."""
    counts = lines.groupBy("project", "path").agg(F.count("*").alias("n"))
    return files.select("project", "path").join(counts, ["project", "path"], "left").select(
        "project", "path", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("loc"))
