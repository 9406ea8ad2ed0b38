"""Column functions for paths, identities, cells, dates and source text.

Patterns, prefixes, lengths and separators below are fixed values: results must equal those of the
formats that they describe.
"""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: the algorithm name that a fingerprint carries and hashes.
ALGORITHM = "finding-anchor-v1"


def slug(c: Column) -> Column:
    """Small letters, digits and `._/-`; other runs become `-`, and punctuation at the ends goes."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9._/-]+", "-"), r"^[._/-]+|[._/-]+$", "")


def fingerprint(target: Column, rule: Column, anchor: Column, instance: Column) -> Column:
    """`algorithm:sha256:` and the SHA-256 of the algorithm and the parts joined by NUL; a null instance is an empty part."""
    parts = [F.lit(ALGORITHM), target, rule, anchor, F.coalesce(instance, F.lit(""))]
    return F.concat(F.lit(f"{ALGORITHM}:sha256:"), F.sha2(F.concat_ws("\0", *parts), 256))


def stable_id(prefix: str, digest: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(digest, 1, 24))


def guarded_cell(c: Column) -> Column:
    """A CSV cell that no spreadsheet takes for a formula; full-width signs and Unicode space count too."""
    return F.when(c.rlike(r"(?U)^(?:[\t\r\n]|\s*[=+\-@\uFF1D\uFF0B\uFF0D\uFF20])"), F.concat(F.lit("'"), c)).otherwise(c)


def in_scope(path: Column, scope: str) -> Column:
    """Whether a path is the scope or lies below it; `.` is everything."""
    scope = scope.removeprefix("./").rstrip("/") or "."
    return F.lit(True) if scope == "." else (path == scope) | path.startswith(f"{scope}/")


def glob(path: Column, pattern: str) -> Column:
    """Shell pattern over the whole path, to its last character; `*` crosses folders."""
    inner = fnmatch.translate(pattern).removesuffix(r"\Z").removesuffix(r"\z")
    return path.rlike(rf"^{inner}\z")


def glob_regex(pattern: Column) -> Column:
    """The regular expression of a column of shell patterns: `*`, `?`, `[...]` and `[!...]`; a class of a falling range matches nothing."""
    tokens = F.regexp_extract_all(pattern, F.lit(r"(?s)\[!?+\]?+[^\]]*+\]|."), 0)

    def part(t: Column) -> Column:
        inner = F.regexp_replace(F.substring(t, F.lit(2), F.length(t) - 2), "^!", "")
        body = F.concat(F.when(t.startswith("[!"), "^").otherwise(""), F.regexp_replace(inner, r"([\\\[\]&~|^])", r"\\$1"))
        falling = F.exists(F.regexp_extract_all(inner, F.lit("(?s).-."), 0), lambda r: F.ascii(F.substring(r, 1, 1)) > F.ascii(F.substring(r, 3, 1)))
        one = F.when(falling, F.lit("(?!)")).otherwise(F.concat(F.lit("["), body, F.lit("]")))
        plain = F.regexp_replace(t, r"([^A-Za-z0-9_\s/-])", r"\\$1")
        return F.when(t == "*", "(?s:.*)").when(t == "?", "(?s:.)").when(F.length(t) > 1, one).otherwise(plain)

    return F.concat(F.lit("^"), F.array_join(F.transform(tokens, part), ""), F.lit("\\z"))


def within(path: Column, scope: Column) -> Column:
    """Whether a path is a scope or lies below it; `.` is everything, and `./` before or `/` after a scope says nothing."""
    bare = F.regexp_replace(F.regexp_replace(scope, r"^(?:\./+)+(?=.)", ""), r"(?<=.)/+(?:\./*)?\z", "")
    return bare.isin(".", "", "./") | (path == bare) | path.startswith(F.concat(bare, F.lit("/")))


def matches(path: Column, pattern: Column) -> Column:
    """Whether a path lies within a pattern as a scope, or the shell pattern fits it whole."""
    return within(path, pattern) | F.when(pattern.rlike(r"[*?\[]"), F.rlike(path, glob_regex(pattern))).otherwise(False)


def cwe_ids(text: Column) -> Column:
    """Distinct weakness ids of a text in numeric order, as `CWE-n`; numbers have one to seven digits and are not 0."""
    found = F.regexp_extract_all(F.upper(text), F.lit(r"\bCWE(?:[-_: ]+)?([0-9]{1,7})\b"), 1)
    numbers = F.filter(F.transform(found, lambda x: x.cast("long")), lambda n: n > 0)
    return F.transform(F.array_sort(F.array_distinct(numbers)), lambda n: F.concat(F.lit("CWE-"), n.cast("string")))


def is_slug(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-z0-9][a-z0-9._/-]*\z"), F.lit(False))


def nonblank(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def compact(c: Column) -> Column:
    """Words between runs of any white space, joined by one space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def workspace_id(path: Column) -> Column:
    return F.sha2(F.concat(F.lit("local-workspace\0"), path), 256)


def repository_id(name: Column) -> Column:
    """owner/name with `--`; over 128 characters 111 of them and the first 16 digits of a hash."""
    flat = F.replace(name, F.lit("/"), F.lit("--"))
    return F.when(F.length(flat) > 128, F.concat(F.substring(flat, 1, 111), F.lit("-"), F.substring(F.sha2(name, 256), 1, 16))).otherwise(flat)


def relative_path(c: Column) -> Column:
    """A POSIX path below its root, without `./`; null for one that is empty, absolute, has a drive, a NUL or leaves its root."""
    path = F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"(?:^|(?<=/))(?:\./)+", "")
    bad = (path == "") | path.rlike(r"^/|^[A-Za-z]:|\x00|(?:^|/)\.\.(?:/|\z)")
    return F.when(~bad, F.regexp_replace(path, r"/{2,}", "/"))


def git_origin(remote: Column) -> Column:
    """(host, path) of an https, ssh or scp-like remote; host in small letters with a port that is not the scheme's own."""
    url = remote.contains("://")
    scheme = F.regexp_extract(remote, r"^([a-z]+)://", 1)
    port = F.regexp_extract(remote, r"^[a-z]+://[^/]*:([0-9]+)(?:/|\z)", 1)
    plain = F.regexp_extract(remote, r"^[a-z]+://(?:[^@/]*@)?([^:/?#]+)", 1)
    own = F.when(scheme == "https", "443").otherwise("22")
    host = F.when(url, F.when((port == "") | (port == own), plain).otherwise(F.concat(plain, F.lit(":"), port)))
    host = F.lower(host.otherwise(F.regexp_extract(remote, r"^(?:[^:]*@)?([^:@]+):", 1)))
    path = F.when(url, F.regexp_extract(remote, r"^[a-z]+://[^/]+/(.*)\z", 1)).otherwise(F.regexp_extract(remote, r"^[^:]+:(.*)\z", 1))
    path = F.regexp_replace(F.regexp_replace(path, r"^/+|/+\z", ""), r"\.git\z", "")
    good = ~remote.rlike("[?#]") & (~url | scheme.isin("https", "ssh")) & (host != "") & (path != "")
    return F.when(F.coalesce(good, F.lit(False)), F.struct(host.alias("host"), path.alias("path")))


def decoded_path(uri: Column, root: str = "/") -> Column:
    """The path below root that a URI reference names, percent-decoded; a `+` stays.

    `file:` URIs of this host and absolute paths must lie below root, others must not leave it; null
    for any other scheme or host, a broken escape, a NUL, a drive or a `..`.
    """
    root = root.rstrip("/") + "/"
    file = uri.rlike(r"^(?i:file):")
    bare = F.regexp_replace(uri, r"[?#].*\z", "")
    bare = F.when(file, F.regexp_extract(bare, r"^[A-Za-z]+:(?://(?i:localhost)?)?(/.*)\z", 1)).when(~bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), bare)
    path = F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))
    below = F.when(path.startswith(root) & ~path.startswith("//"), F.substring(path, F.lit(len(root) + 1), F.length(path)))
    return relative_path(F.when(file | path.startswith("/"), below).otherwise(path))


def byte_prefix(text: Column, most: int) -> Column:
    """The longest prefix of at most so many UTF-8 bytes that ends between characters."""
    data = text.cast("binary")
    follows = lambda at: F.hex(F.substring(data, at, 1)).between("80", "BF")
    cut = F.lit(most - 3)
    for back in (2, 1, 0):
        cut = F.when(~follows(most - back + 1), most - back).otherwise(cut)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(data, F.lit(1), cut), "UTF-8"))


def without_control(text: Column) -> Column:
    """Terminal sequences and control characters go; tabs and line ends stay."""
    bare = F.regexp_replace(text, r"\x1B\[[0-?]*[ -/]*[@-~]", "")
    return F.regexp_replace(bare, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def fence(text: Column) -> Column:
    """A backtick fence longer than any run in the text, three at least."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), 1), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def is_rfc3339(c: Column) -> Column:
    """Whether a text is a date and time with an offset that the calendar has."""
    shaped = c.rlike(r"^\d{4}-\d{2}-\d{2}T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?(?:Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)\z")
    return F.coalesce(shaped & F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd").isNotNull(), F.lit(False))


def dollars(nano: Column) -> Column:
    """Nanodollars as dollars with two to nine decimals."""
    part = F.lpad((F.abs(nano) % 1_000_000_000).cast("string"), 9, "0")
    tail = F.regexp_replace(F.substring(part, 3, 7), "0+$", "")
    whole = F.abs(nano).cast("decimal(38,0)").cast("string")
    units = F.when(F.length(whole) > 9, F.substring(whole, F.lit(1), F.length(whole) - 9)).otherwise("0")
    return F.concat(F.when(nano < 0, "-$").otherwise("$"), units, F.lit("."), F.substring(part, 1, 2), tail)


def excerpt(text: Column, first: Column, last: Column, around: int = 1) -> Column:
    """The lines first to last and some around them, each with its number, padded to one width."""
    lines = F.split(text, "\n")
    lo, hi = F.greatest(first - around, F.lit(1)).cast("int"), F.least(last + around, F.size(lines)).cast("int")
    numbers = F.sequence(lo, hi)
    row = lambda i: F.concat(F.lpad(i.cast("string"), F.length(hi.cast("string")), " "), F.lit(": "), F.element_at(lines, i))
    return F.when(lo <= hi, F.array_join(F.transform(numbers, row), "\n")).otherwise("")


def is_excluded(path: Column, folders: list[str], suffixes: list[str], names: list[str] = (), packages: list[str] = (), roots: list[str] = ("src/main/java", "src/test/java")) -> Column:
    """Whether a path has a part that is left out, or such a file name or suffix.

    A part that may be a package name is excused if a source root lies above a folder of that name.
    """
    parts = F.split(path, "/")
    out = F.arrays_overlap(parts, F.array(*[F.lit(f) for f in folders if f not in packages])) if set(folders) - set(packages) else F.lit(False)
    for f in packages:
        below = rf"(?:^|/)(?:{'|'.join(re.escape(r) for r in roots)})/(?:[^/]+/)*{re.escape(f)}/"
        out = out | (F.array_contains(parts, f) & ~path.rlike(below)) if f in folders else out
    if names:
        out = out | F.element_at(parts, -1).isin(*names)
    for s in suffixes:
        out = out | path.endswith(s)
    return out


def line_count(text: Column) -> Column:
    """Line feeds, plus one if text follows the last; an empty text has one line."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 1).otherwise(feeds + F.when(text.endswith("\n"), 0).otherwise(1)).cast("long")


#: Letters whose folding is not the small letter of their capital: dotless i stays, Cherokee folds to capitals.
_ODD = "[\u0131\u13a0-\u13fd\uab70-\uabbf]"


def _folded(c: Column) -> Column:
    # the replacement also keeps the optimizer from taking the inner upper away
    return F.translate(F.lower(F.replace(F.upper(c), F.lit("\u1e9e"), F.lit("SS"))), "\u03c2", "\u03c3")


def casefold(c: Column) -> Column:
    """A text by full Unicode case folding, so that texts that differ by case alone are equal; null for null."""
    each = F.transform(F.split(c, ""), lambda x: F.when(x == "\u0131", x).when(x.rlike(_ODD), F.upper(x)).otherwise(_folded(x)))
    return F.when(c.rlike(_ODD), F.array_join(each, "")).otherwise(_folded(c))
