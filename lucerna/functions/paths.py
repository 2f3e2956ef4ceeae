"""Classification of paths, commands and arguments as Column expressions.

All of these stay inside the JVM; text is compared bytewise and case is folded by ``lower``."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

from lucerna.schemas import DYNAMIC

# Fixed values.
SHELL_SUFFIXES = (".sh", ".bash", ".zsh")
LANGUAGE_SUFFIXES = {
    "python": (".py", ".pyw"),
    "javascript": (".js", ".mjs", ".cjs", ".jsx"),
    "typescript": (".ts", ".mts", ".cts", ".tsx"),
    "go": (".go",),
    "ruby": (".rb",),
    "perl": (".pl", ".pm"),
    "lua": (".lua",),
    "php": (".php",),
}
#: Words in a first line that begins with "#!", in order of precedence.
LANGUAGE_SHEBANGS = {"python": "python", "node": "javascript", "ruby": "ruby", "perl": "perl", "lua": "lua", "php": "php"}
TOOLING_SEGMENTS = (".github", "test", "tests", "testdata", "docs", "examples")
TOOLING_NAMES = ("build", "release", "package", "validate", "lint", "test", "check")
DOWNLOADERS = ("curl", "wget")
INTERPRETERS = ("sh", "bash", "zsh", "python", "python3", "node")
NETWORK_COMMANDS = ("curl", "wget", "git", "ssh", "scp", "sftp", "rsync", "nc", "ncat", "socat")
SENSITIVE_MARKERS = (".ssh", ".gnupg", ".aws/credentials", ".config/gcloud", "keyring", "credentials", "id_rsa", "id_ed25519", "mozilla", "chromium", "google-chrome")
PERSISTENCE_MARKERS = (".bashrc", ".zshrc", ".profile", "/autostart/", "/systemd/user/", "/cron.", "/crontab")
ANALYZABLE_SUFFIXES = (".sh", ".bash", ".zsh", ".qml", ".py", ".pyw", ".js", ".mjs", ".cjs", ".jsx", ".desktop", ".service", ".socket", ".timer")
ELF_MAGIC = "7F454C46"


def base_name(path: Column) -> Column:
    """The last part; ``/`` for a path of slashes, ``.`` for an empty one."""
    bare = F.regexp_replace(path, "/+\\z", "")
    return F.when(path == "", ".").when(bare == "", "/").otherwise(F.substring_index(bare, "/", -1))


def extension(path: Column) -> Column:
    """From the last dot of the last part, dot included; empty without one."""
    return F.regexp_extract(path, "(\\.[^./]*)\\z", 1)


def slug(value: Column) -> Column:
    """An identifier part: lower case, ``/ . _`` and space as ``-``, outer ``-`` trimmed. Not unique."""
    return F.btrim(F.translate(F.lower(value), "/._ ", "----"), F.lit("-"))


def clean_path(path: str) -> str:
    """The shortest equal path, with one slash for two leading ones."""
    out = posixpath.normpath(path) if path else "."
    return out[1:] if out.startswith("//") else out


def is_clean(path: Column) -> Column:
    """Whether a relative path is as short as it can be: no empty, ``.`` or inner ``..`` parts."""
    return (path == ".") | (~path.rlike("(\\A|/)\\.(/|\\z)") & ~path.contains("//") & ~path.endswith("/") & (path != "") & ~path.rlike("(?<!\\A|\\.\\.)/\\.\\.(/|\\z)"))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def is_inert_git(path: Column) -> Column:
    return path.startswith(".git/objects/") | path.startswith(".git/logs/") | (path.startswith(".git/hooks/") & path.endswith(".sample"))


def is_git_database(path: Column) -> Column:
    return path.startswith(".git/objects/") | path.startswith(".git/logs/")


def is_git_metadata(path: Column) -> Column:
    return (path == ".git") | path.startswith(".git/")


def is_shell(path: Column, text: Column) -> Column:
    """By suffix, or by a first line ``#!`` with ``sh`` anywhere in it."""
    line = F.lower(first_line(F.coalesce(text, F.lit(""))))
    return F.lower(extension(path)).isin(*SHELL_SUFFIXES) | (line.startswith("#!") & line.contains("sh"))


def is_qml(path: Column) -> Column:
    return F.lower(extension(path)) == ".qml"


def unsupported_language(path: Column, text: Column) -> Column:
    """A language that is recognised but not analysed, by suffix or else by first line; null if none."""
    suffix, line = F.lower(extension(path)), F.lower(first_line(F.coalesce(text, F.lit(""))))
    by_suffix = F.coalesce(*[F.when(suffix.isin(*s), name) for name, s in LANGUAGE_SUFFIXES.items()])
    by_line = F.coalesce(*[F.when(line.contains(word), name) for word, name in LANGUAGE_SHEBANGS.items()])
    return F.coalesce(by_suffix, F.when(line.startswith("#!"), by_line))


def is_tooling(path: Column) -> Column:
    """Repository tooling: in a tooling folder, or a file whose name contains a tooling word."""
    padded = F.concat(F.lit("/"), F.lower(path), F.lit("/"))
    folders = padded.rlike("/(" + "|".join(s.replace(".", "\\.") for s in TOOLING_SEGMENTS) + ")/")
    return folders | F.lower(base_name(path)).rlike("|".join(TOOLING_NAMES))


def is_downloader(command: Column) -> Column:
    return base_name(command).isin(*DOWNLOADERS)


def is_interpreter(command: Column) -> Column:
    return base_name(command).isin(*INTERPRETERS)


def is_network_command(command: Column) -> Column:
    return base_name(command).isin(*NETWORK_COMMANDS)


def literal_host(value: Column) -> Column:
    """The lower-case host of an http(s) URL, without port or IPv6 brackets; null if there is none.

    A host that holds the dynamic marker is not literal."""
    host = F.lower(F.regexp_extract(value, "\\A[hH][tT][tT][pP][sS]?://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/?#:]*)(?::[0-9]*)?(?=[/?#]|\\z)", 1))
    bare = F.btrim(host, F.lit("[]"))
    return F.when((bare != "") & ~bare.contains("<") & ~bare.rlike("[\\s\\x00-\\x1f]"), bare)


def path_operands(arguments: Column) -> Column:
    """Arguments that look like paths: no options, no URLs."""

    def looks(x: Column) -> Column:
        shaped = x.rlike("\\A[/~.]") | x.contains("/") | x.contains(DYNAMIC)
        return (x != "") & ~x.startswith("-") & literal_host(x).isNull() & shaped

    return F.filter(arguments, looks)


def _marked(value: Column, markers: tuple[str, ...]) -> Column:
    return F.lower(value).rlike("|".join(m.replace(".", "\\.") for m in markers))


def is_sensitive(value: Column) -> Column:
    return _marked(value, SENSITIVE_MARKERS)


def is_persistent(value: Column) -> Column:
    return _marked(value, PERSISTENCE_MARKERS)


def removes_recursively(arguments: Column) -> Column:
    """``-r``, ``-R``, ``--recursive``, or any option with an r in it."""
    return F.exists(arguments, lambda x: x.startswith("-") & F.lower(x).contains("r"))


def safe_entry_point(value: Column) -> Column:
    return (value != "") & ~value.startswith("/") & ~value.contains("..") & is_clean(value)


def valid_manifest_id(value: Column, reserved: tuple[str, ...] = ("omarchy.",)) -> Column:
    """``reserved``: fixed value, the platform's own prefix."""
    ok = value.rlike("\\A[A-Za-z0-9][A-Za-z0-9._-]*\\z") & ~value.contains("..")
    for prefix in reserved:
        ok &= ~value.startswith(prefix)
    return ok


def valid_plugin_id(value: Column) -> Column:
    return value.rlike("\\A[A-Za-z0-9][A-Za-z0-9._-]*\\z") & ~value.contains("..")


def valid_display_name(value: Column) -> Column:
    return value.rlike("\\A[A-Za-z0-9][A-Za-z0-9._-]{0,254}\\z") & ~value.contains("..")


def canonical_relative(value: Column) -> Column:
    """A target-relative path in its one allowed form."""
    return (value != "") & (value != ".") & ~value.contains("\\") & ~value.contains("\x00") & ~value.startswith("/") & (value != "..") & ~value.startswith("../") & is_clean(value)


def obviously_analyzable(path: Column) -> Column:
    return (path == "manifest.json") | F.lower(extension(path)).isin(*ANALYZABLE_SUFFIXES)


def special_kind(mode_bits: Column) -> Column:
    """The kind of a special file by the type bits of its mode."""
    bits = mode_bits.bitwiseAND(F.lit(0o170000))
    return F.when(bits == 0o010000, "fifo").when(bits == 0o140000, "socket").when(bits == 0o020000, "character-device").when(bits == 0o060000, "block-device").otherwise("special")


def plain_text(value: Column, limit: int) -> Column:
    """For display: control and direction characters replaced, cut at ``limit`` with an ellipsis."""
    safe = F.regexp_replace(F.coalesce(value, F.lit("")), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\u202A-\\u202E\\u2066-\\u2069]", "\ufffd")
    return F.when(F.length(safe) > limit, F.concat(F.left(safe, F.lit(limit)), F.lit("…"))).otherwise(safe)


def safe_diagnostic(value: Column) -> Column:
    """Control characters other than newline and tab as ``?``."""
    return F.regexp_replace(value, "[\\x00-\\x08\\x0B-\\x1F]", "?")


def cut_bytes(text: str, limit: int) -> str:
    """At most ``limit`` bytes of UTF-8, cut between characters, with an ellipsis if cut."""
    data = text.encode("utf-8", "replace")
    return text if len(data) <= limit else data[:limit].decode("utf-8", "ignore") + "…"
