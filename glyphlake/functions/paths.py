"""Path predicates: globs, file types, genus, ignore rules, order.

Globs are compiled to Java expressions on the driver, so a path filter is one `rlike` inside the scan's
stage; rule files with precedence are a join that keeps the last rule that matches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BRACE_TERMS, BRACE_GROUPS = 1024, 64

#: Directories that a walk leaves out unless they are named as roots.
SKIP_DIRS = (
    ".git", ".github", ".hg", ".svn", "node_modules", "target", "dist", "dist-types", "build", ".build", "out", ".next", "coverage", ".venv", "venv", "site-packages",
    "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".zig-cache", "zig-out", "zig-pkg", ".cache", ".local", ".turbo", "vendor", ".swiftpm", "Pods",
    "DerivedData", ".cursor", ".idea", ".vscode", ".parcel-cache", ".pnpm-store", ".gist",
)
#: Places and names that make a file documentation.
DOC_DIRS = ("doc", "docs", "documentation", "man", "manual", "javadoc", "groovydoc")
DOC_STEMS = (
    "acknowledgments", "acknowledgements", "authors", "changelog", "changes", "citation", "code_of_conduct", "contributing", "contributors", "credits", "faq",
    "governance", "hacking", "history", "install", "maintainers", "news", "roadmap", "security", "thanks", "todo",
)
#: Names, suffixes and header words of generated files, and comment openers.
GENERATED_FRAGMENTS = (".generated.", ".gen.", "_gen.", "_generated.", ".min.", ".pb.", "_pb.", "_pb2.", "_pb2_", "_connect.", "_connectquery.")
GENERATED_SUFFIXES = (".sql.go", ".g.dart", ".freezed.dart", ".g.cs", ".designer.cs", ".connect.go", ".connect.swift")
GENERATED_MARKERS = ("code generated", "generated by", "@generated", "do not edit", "auto-generated", "autogenerated", "machine generated")
COMMENT_OPENERS = ("//", "--", "#", "/*", "*", "<!--")
#: Folders that mirror sources.
MIRROR_ROOTS = ("target/semver-checks/", ".git/worktrees/", ".cache/", "node_modules/.cache/")
GENERATED_HEAD_BYTES, GENERATED_HEAD_LINES = 2048, 8

#: Globs of the common file types, and whether they are code, docs or data.  A session can add to or clear
#: them; read_types() takes any larger table as a parameter.
TYPES: dict[str, tuple[str, tuple[str, ...]]] = {
    "awk": ("code", ("*.awk",)),
    "bash": ("code", ("*.sh", "*.bash")),
    "bat": ("code", ("*.bat",)),
    "c": ("code", ("*.c", "*.h", "*.H", "*.cats")),
    "clojure": ("code", ("*.clj", "*.cljc", "*.cljs", "*.cljx")),
    "cmake": ("code", ("*.cmake", "CMakeLists.txt")),
    "coffeescript": ("code", ("*.coffee",)),
    "cpp": ("code", ("*.cpp", "*.cc", "*.cxx", "*.hpp", "*.hh", "*.hxx", "*.inl")),
    "cs": ("code", ("*.cs", "*.csx")),
    "css": ("code", ("*.css", "*.scss")),
    "cython": ("code", ("*.pyx", "*.pxi", "*.pxd")),
    "dart": ("code", ("*.dart",)),
    "docker": ("code", ("*Dockerfile*",)),
    "elisp": ("code", ("*.el",)),
    "elixir": ("code", ("*.ex", "*.eex", "*.exs", "*.heex", "*.leex", "*.livemd")),
    "elm": ("code", ("*.elm",)),
    "erlang": ("code", ("*.erl", "*.hrl")),
    "fish": ("code", ("*.fish",)),
    "fsharp": ("code", ("*.fs", "*.fsx", "*.fsi")),
    "go": ("code", ("*.go",)),
    "graphql": ("code", ("*.graphql", "*.graphqls", "*.gql")),
    "groovy": ("code", ("*.groovy", "*.gradle")),
    "haskell": ("code", ("*.hs", "*.lhs", "*.cpphs", "*.c2hs", "*.hsc")),
    "html": ("code", ("*.htm", "*.html", "*.ejs")),
    "java": ("code", ("*.java", "*.jsp", "*.jspx", "*.properties")),
    "js": ("code", ("*.js", "*.jsx", "*.vue", "*.cjs", "*.mjs")),
    "julia": ("code", ("*.jl",)),
    "kotlin": ("code", ("*.kt", "*.kts")),
    "less": ("code", ("*.less",)),
    "lisp": ("code", ("*.el", "*.jl", "*.lisp", "*.lsp", "*.sc", "*.scm")),
    "lua": ("code", ("*.lua",)),
    "make": ("code", ("[Gg][Nn][Uu]makefile", "[Mm]akefile", "[Gg][Nn][Uu]makefile.am", "[Mm]akefile.am", "[Gg][Nn][Uu]makefile.in", "[Mm]akefile.in", "Makefile.*", "*.mk", "*.mak")),
    "matlab": ("code", ("*.m",)),
    "nix": ("code", ("*.nix",)),
    "ocaml": ("code", ("*.ml", "*.mli", "*.mll", "*.mly")),
    "perl": ("code", ("*.perl", "*.pl", "*.PL", "*.plh", "*.plx", "*.pm", "*.t")),
    "php": ("code", ("*.php", "*.php3", "*.php4", "*.php5", "*.php7", "*.php8", "*.pht", "*.phtml")),
    "prolog": ("code", ("*.pl", "*.pro", "*.prolog", "*.P")),
    "protobuf": ("code", ("*.proto",)),
    "ps": ("code", ("*.cdxml", "*.ps1", "*.ps1xml", "*.psd1", "*.psm1")),
    "py": ("code", ("*.py", "*.pyi")),
    "r": ("code", ("*.R", "*.r", "*.Rmd", "*.rmd", "*.Rnw", "*.rnw")),
    "ruby": ("code", ("config.ru", "Gemfile", ".irbrc", "Rakefile", "*.gemspec", "*.rb", "*.rbw", "*.rake")),
    "rust": ("code", ("*.rs",)),
    "sass": ("code", ("*.sass", "*.scss")),
    "scala": ("code", ("*.scala", "*.sbt", "*.sc")),
    "sh": ("code", (
        ".env", ".login", ".logout", ".profile", "profile", ".bash_login", "bash_login", ".bash_logout", "bash_logout", ".bash_profile", "bash_profile", ".bashrc", "bashrc", "*.bashrc",
        ".cshrc", "*.cshrc", ".kshrc", "*.kshrc", ".tcshrc", ".zshenv", "zshenv", ".zlogin", "zlogin", ".zlogout", "zlogout", ".zprofile", "zprofile", ".zshrc",
        "zshrc", "*.bash", "*.csh", "*.env", "*.ksh", "*.sh", "*.tcsh", "*.zsh", "*.ash", "*.dash",
    )),
    "sml": ("code", ("*.sml", "*.sig")),
    "solidity": ("code", ("*.sol",)),
    "sql": ("code", ("*.sql", "*.psql")),
    "svelte": ("code", ("*.svelte", "*.svelte.ts")),
    "swift": ("code", ("*.swift",)),
    "tcl": ("code", ("*.tcl",)),
    "ts": ("code", ("*.ts", "*.tsx", "*.cts", "*.mts")),
    "verilog": ("code", ("*.v", "*.vh", "*.sv", "*.svh")),
    "vhdl": ("code", ("*.vhd", "*.vhdl")),
    "vim": ("code", ("*.vim", ".vimrc", ".gvimrc", "vimrc", "gvimrc", "_vimrc", "_gvimrc")),
    "vue": ("code", ("*.vue",)),
    "zig": ("code", ("*.zig", "*.zon")),
    "asciidoc": ("docs", ("*.adoc", "*.asc", "*.asciidoc")),
    "license": ("docs", ("LICENSE*", "LICENCE*", "COPYING*", "NOTICE*", "UNLICENSE*")),
    "markdown": ("docs", ("*.markdown", "*.md", "*.mdown", "*.mdwn", "*.mkd", "*.mkdn", "*.mdx")),
    "org": ("docs", ("*.org", "*.org_archive")),
    "readme": ("docs", ("README*", "*README")),
    "rst": ("docs", ("*.rst",)),
    "tex": ("docs", ("*.tex", "*.ltx", "*.cls", "*.sty", "*.bib", "*.dtx", "*.ins")),
    "txt": ("docs", ("*.txt", "*.text")),
    "avro": ("data", ("*.avdl", "*.avpr", "*.avsc")),
    "csv": ("data", ("*.csv", "*.tsv")),
    "json": ("data", ("*.json", "composer.lock", "*.sarif", "*.jsonc", "*.json5", "*.ndjson")),
    "jsonl": ("data", ("*.jsonl",)),
    "log": ("data", ("*.log",)),
    "svg": ("data", ("*.svg",)),
    "toml": ("data", ("*.toml", "Cargo.lock")),
    "xml": ("data", ("*.xml", "*.xml.dist", "*.dtd", "*.xsl", "*.xslt", "*.xsd", "*.xjb", "*.rng", "*.sch", "*.xhtml")),
    "yaml": ("data", ("*.yaml", "*.yml")),
}


def read_types(text: str, base: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> dict[str, tuple[str, tuple[str, ...]]]:
    """Types from lines `name: glob, glob` with an optional genus behind a bar, added to a base (the common types).

    A line `name:include:other,other` takes other types' globs over, one of `-name` removes a type; # begins a comment."""
    out = dict(TYPES if base is None else base)
    for line in (raw.split("#", 1)[0].strip() for raw in text.splitlines()):
        if not line:
            continue
        if line.startswith("-"):
            out.pop(line[1:].strip(), None)
            continue
        name, _, rest = line.partition(":")
        rest, _, kind = rest.partition("|")
        old_kind, old = out.get(name.strip(), ("code", ()))
        if rest.startswith("include:"):
            more = tuple(g for other in rest[8:].split(",") for g in out[other.strip()][1])
        else:
            more = tuple(g.strip() for g in rest.split(",") if g.strip())
        out[name.strip()] = (kind.strip() or old_kind, tuple(dict.fromkeys((*old, *more))))
    return out


def brace_expand(glob: str) -> list[str]:
    """Every glob that a glob's {a,b} groups stand for; an unbalanced brace is itself."""

    def expand(text: str, groups: int) -> list[str]:
        depth, start = 0, -1
        for i, c in enumerate(text):
            if c == "{":
                start = i if not depth else start
                depth += 1
            elif c == "}" and depth:
                depth -= 1
                if not depth:
                    break
        else:
            return [text]
        if groups >= BRACE_GROUPS:
            raise ValueError(f"more than {BRACE_GROUPS} groups")
        parts, level, last = [], 0, start + 1
        for k in range(start + 1, i):
            level += (text[k] == "{") - (text[k] == "}")
            if text[k] == "," and not level:
                parts.append(text[last:k])
                last = k + 1
        parts.append(text[last:i])
        tails = expand(text[i + 1 :], groups + 1)
        out = [text[:start] + head + tail for part in parts for head in expand(part, groups + 1) for tail in tails]
        if len(out) > BRACE_TERMS:
            raise ValueError(f"more than {BRACE_TERMS} globs")
        return out

    return expand(glob, 0)


def glob_body(glob: str) -> str:
    """The expression of one glob without braces: * and ? stay within a folder, ** crosses, [] never matches /."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            edge = i == 0 or glob[i - 1] == "/"
            i += 2
            if i < len(glob) and glob[i] == "/":
                i += 1
                out.append("(?:.*/)?" if edge else ".*")
            else:
                out.append(".*")
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[":
            end = glob.find("]", i + (3 if glob[i + 1 : i + 2] in ("!", "^") else 2))
            if end < 0:
                out.append(r"\[")
                i += 1
                continue
            inner = glob[i + 1 : end]
            negated = inner[:1] in ("!", "^")
            inner = re.sub(r"([\\\[\]&^])", r"\\\1", inner[negated:])
            out.append(f"(?!/)[{'^' if negated else ''}{inner}]")
            i = end + 1
        else:
            out.append(re.escape(c))
            i += 1
    return "".join(out)


def glob_regex(glob: str, ignore_case: bool = False) -> str:
    """The expression that finds in a whole path what the glob applies to.

    Without a slash it is about the file's name; a final slash names a folder and all below it."""
    found = []
    for term in brace_expand(glob):
        if len(term) > 1 and term.endswith("/"):
            core = term[:-1]
            found.append((rf"\A{glob_body(core)}/" if "/" in core else rf"(?:\A|/){glob_body(core)}/"))
        elif "/" in term:
            found.append(rf"\A{glob_body(term)}\z")
        else:
            found.append(rf"(?:\A|/){glob_body(term)}\z")
    flags = "(?is)" if ignore_case else "(?s)"
    return flags + "|".join(f"(?:{x})" for x in found)


def glob_applies(path: Column, glob: str, ignore_case: bool = False) -> Column:
    return F.rlike(path, F.lit(glob_regex(glob, ignore_case)))


def type_table(spark: SparkSession, types: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """(type, glob) of every known type."""
    rows = [(name, glob) for name, (_, globs) in sorted((types or TYPES).items()) for glob in globs]
    return spark.createDataFrame(rows, "type string, glob string")


def of_type(path: Column, *names: str, types: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> Column:
    known = types or TYPES
    return any_glob(path, [g for n in names for g in known[n][1]])


def any_glob(path: Column, globs: list[str], ignore_case: bool = False) -> Column:
    return F.rlike(path, F.lit("|".join(f"(?:{glob_regex(g, ignore_case)})" for g in globs))) if globs else F.lit(False)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Behind the last dot of the name; null if there is none."""
    name = basename(path)
    return F.when(F.contains(name, F.lit(".")) & ~F.endswith(name, F.lit(".")), F.substring_index(name, ".", -1))


def depth(path: Column) -> Column:
    return (F.size(F.split(path, "/")) - 1).cast("long")


def under_root(path: Column, root: str) -> Column:
    clean = root.rstrip("/")
    return F.lit(True) if clean in ("", ".") else (path == clean) | F.startswith(path, F.lit(clean + "/"))


def path_order(path: Column) -> Column:
    """A sort key for component order, where a slash ranks below every other character."""
    return F.translate(path, "/", "\1")


def strip_dot(path: Column) -> Column:
    return F.regexp_replace(path, r"\A(?:\./)+", "")


def join_path(folder: Column, name: Column) -> Column:
    """An absolute name stands for itself, an empty or dot folder adds nothing."""
    clean = F.regexp_replace(folder, r"/+\z", "")
    return F.when(F.startswith(name, F.lit("/")) | clean.isin("", "."), name).otherwise(F.concat(clean, F.lit("/"), name))


def sort_files(files: DataFrame, by: str = "path", reverse: bool = False) -> DataFrame:
    """Files by path (component order) or modified time, ties by path."""
    keys = [path_order(F.col("path"))] if by == "path" else [F.col("mtime"), path_order(F.col("path"))]
    return files.orderBy(*[k.desc() if reverse else k.asc() for k in keys])


def hidden(path: Column) -> Column:
    return F.rlike(path, F.lit(r"(?:\A|/)\.[^/.]"))


def in_skipped_dir(path: Column, names: tuple[str, ...] = SKIP_DIRS) -> Column:
    folders = F.split(path, "/")
    return F.arrays_overlap(F.slice(folders, F.lit(1), F.size(folders) - 1), F.array(*[F.lit(n) for n in names]))


def genus(path: Column) -> Column:
    """code, docs or data: by spelling (narrow globs of code before docs and data, then extensions), by place, else code."""
    bare = re.compile(r"\*\.[^*?\[\].]+\Z")
    globs = {g: [x for kind, many in TYPES.values() if kind == g for x in many] for g in ("code", "docs", "data")}
    extensions = {g: [x[2:] for x in globs[g] if bare.match(x)] for g in globs}
    narrow = {g: [x for x in globs[g] if not bare.match(x)] for g in globs}
    shadows = [x for x in narrow["code"] if x.rpartition(".")[2] in {*extensions["docs"], *extensions["data"]}]
    own = extension(path)
    known_code = any_glob(path, globs["code"])
    place = F.rlike(path, F.lit(rf"(?i)(?:\A|/)(?:{'|'.join(DOC_DIRS)})/")) | F.rlike(path, F.lit(rf"(?i)(?:\A|/)(?:{'|'.join(DOC_STEMS)})(?:\.[^/]*)?\z"))
    return (
        F.when(any_glob(path, shadows), "code").when(any_glob(path, narrow["docs"]), "docs").when(any_glob(path, narrow["data"]), "data")
        .when(own.isin(extensions["docs"]), "docs").when(own.isin(extensions["data"]), "data").when(place & ~known_code, "docs").otherwise("code")
    )


def is_mirror(path: Column) -> Column:
    clean = strip_dot(path)
    roots = "|".join(re.escape(r) for r in MIRROR_ROOTS)
    return F.rlike(clean, F.lit(rf"(?:\A|/)(?:{roots})"))


def is_generated_path(path: Column) -> Column:
    name = basename(path)
    fragments = [F.contains(name, F.lit(x)) for x in GENERATED_FRAGMENTS] + [F.endswith(name, F.lit(x)) for x in GENERATED_SUFFIXES]
    out = fragments[0]
    for x in fragments[1:]:
        out = out | x
    return out


def is_generated(path: Column, text: Column) -> Column:
    """A generated file's name, or a generator's mark in its header: comments and blank lines, eight lines at least."""
    lines = F.split(F.left(text, F.lit(GENERATED_HEAD_BYTES)), "\n", -1)
    trimmed = F.transform(lines, lambda x: F.regexp_replace(x, r"\A[ \t\r]+|[ \t\r]+\z", ""))
    openers = "|".join(re.escape(x) for x in COMMENT_OPENERS)
    body = F.transform(trimmed, lambda x, i: F.when((x != "") & ~F.rlike(x, F.lit(rf"\A(?:{openers})")), i))
    header = F.greatest(F.coalesce(F.array_min(F.filter(body, lambda i: i.isNotNull())) + 1, F.size(lines)), F.lit(GENERATED_HEAD_LINES))
    marks = "|".join(re.escape(x) for x in GENERATED_MARKERS)
    marked = rf"(?i)\A(?:{openers})?[ \t]*(?:{marks})|generated.*do not edit|do not edit.*generated"
    return is_generated_path(path) | F.exists(F.slice(trimmed, F.lit(1), header), lambda x: F.rlike(x, F.lit(marked)))


@dataclass(frozen=True)
class PathFilter:
    """Roots, globs, types and genus: excludes win, an including glob overrides types and genus, which are or-ed."""

    roots: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    not_types: tuple[str, ...] = ()
    genera: tuple[str, ...] = ()
    max_depth: int | None = None
    show_hidden: bool = True

    def admits(self, path: Column) -> Column:
        out = F.lit(True)
        if self.roots:
            inside = F.lit(False)
            for root in self.roots:
                inside = inside | under_root(path, root)
            out = out & inside
        if self.exclude:
            out = out & ~any_glob(path, list(self.exclude))
        kinds = F.lit(False)
        if self.types:
            kinds = kinds | of_type(path, *self.types)
        if self.genera:
            kinds = kinds | genus(path).isin(*self.genera)
        if self.include:
            out = out & any_glob(path, list(self.include))
        elif self.types or self.genera:
            out = out & kinds
        if self.not_types and not self.include:
            out = out & ~of_type(path, *self.not_types)
        if self.max_depth is not None:
            out = out & (depth(path) < self.max_depth)
        return out if self.show_hidden else out & ~hidden(path)


@dataclass(frozen=True)
class IgnoreRule:
    """One line of an ignore file in a folder; rules further down, and files in deeper folders, have the last word."""

    folder: str
    rank: int
    negated: bool
    regex: str


def parse_ignore(text: str, folder: str = "", first_rank: int = 0) -> list[IgnoreRule]:
    """Rules of an ignore file: comments, escapes, ! for negation, anchoring slashes, final slash for folders."""
    rules = []
    for line in text.split("\n"):
        line = re.sub(r"(?<!\\)[ \t]+\Z", "", line.rstrip("\r"))
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:]
        line = line[1:] if line[:2] in ("\\#", "\\!") else line
        only_dir = line.endswith("/")
        core = line.rstrip("/") if only_dir else line
        if not core:
            continue
        anchored = "/" in core.rstrip("/")
        core = core.lstrip("/")
        lead = r"\A" if anchored else r"(?:\A|/)"
        tail = "/" if only_dir else r"(?:/|\z)"
        rules.append(IgnoreRule(folder.strip("/"), first_rank + len(rules), negated, "(?s)" + lead + glob_body(core) + tail))
    return rules


def ignored(paths: DataFrame, rules: list[IgnoreRule], path_col: str = "path") -> Column:
    """Whether the last rule that applies to a path, or to a folder above it, ignores it.  The rules are a constant."""
    path = F.col(path_col)
    out = F.lit(None).cast("boolean")
    for rule in sorted(rules, key=lambda r: (r.folder.count("/") + bool(r.folder), r.rank), reverse=True):
        inside = under_root(path, rule.folder) if rule.folder else F.lit(True)
        rest = F.substring(path, len(rule.folder) + 2, 1 << 30) if rule.folder else path
        # a negated rule about a file can't bring it back from an ignored folder, which is decided before it
        out = F.coalesce(out, F.when(inside & F.rlike(rest, F.lit(rule.regex)), F.lit(not rule.negated)))
    return F.coalesce(out, F.lit(False))


def rules_frame(spark: SparkSession, rules: list[IgnoreRule]) -> DataFrame:
    return spark.createDataFrame([(r.folder, r.rank, r.negated, r.regex) for r in rules], "folder string, rank int, negated boolean, regex string")


def last_rule(paths: DataFrame, rules: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, ignored) by a join with a table of rules, for rule sets too large to be a constant: the last match decides."""
    inside = (F.col("folder") == "") | F.startswith(F.col(path_col), F.concat("folder", F.lit("/")))
    rest = F.when(F.col("folder") == "", F.col(path_col)).otherwise(F.expr(f"substring({path_col}, length(folder) + 2)"))
    hit = paths.select(path_col).join(F.broadcast(rules), inside & F.call_function("rlike", rest, F.col("regex")), "left")
    level = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    return hit.groupBy(path_col).agg(F.coalesce(~F.max_by("negated", F.struct(level, F.col("rank"))), F.lit(False)).alias("ignored"))
