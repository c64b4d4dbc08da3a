"""URL and path functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a valid URL is. The host's labels are written without nested repetition, so that matching stays linear.
URL = r"(?i)^(https?://)?(([a-z\d](?:[a-z\d-]*[a-z\d])?\.)+[a-z]{2,}|((\d{1,3}\.){3}\d{1,3}))(?::\d{2,5})?(/[-a-z\d%_.~+]*)*(\?[;&a-z\d%_.~+=-]*)?(#[-a-z\d_]*)?$"
CODE_HOST = "https://github.com"
CODE_HOST_API = "https://api.github.com/repos/"
SUFFIXES = (".py", ".php", ".js", ".ts", ".go", ".cpp", ".java", ".rb", ".cs")
DEFAULT_HOST = "api.openai.com"


def is_url(value: Column) -> Column:
    return F.coalesce(value.rlike(URL), F.lit(False))


def is_code_host(value: Column) -> Column:
    return value.startswith(CODE_HOST)


def is_remote(value: Column) -> Column:
    return value.rlike("^https?")


def is_supported(path: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Whether the path ends with one of the suffixes."""
    ok = F.lit(False)
    for s in suffixes:
        ok = ok | path.endswith(s)
    return ok


def encoded(value: Column) -> Column:
    """Percent-encoding of all but ASCII letters, digits and - _ . ! ~ * ' ( )."""
    out = F.url_encode(value)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def decoded(value: Column) -> Column:
    """The reverse of encoded(); a plus sign stays one."""
    return F.url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))


def node_id(parts: Column) -> Column:
    """Encoded parts joined by slashes."""
    return F.array_join(F.transform(parts, encoded), "/")


def node_path(value: Column) -> Column:
    """The decoded first part of a node id."""
    return decoded(F.split_part(value, F.lit("/"), F.lit(1)))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def suffix(path: Column) -> Column:
    """The last dot and what follows, of the name; a name that only starts with a dot has none."""
    return F.regexp_extract(file_name(path), r"(?<=.)\.[^.]*$", 0)


def folder(path: Column) -> Column:
    """All before the last slash; a dot if there is none."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def normal_path(path: Column) -> Column:
    """Without empty and dot segments, and with each dot-dot taking the segment before it along."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != ".."), F.slice(acc, 1, F.size(acc) - 1)).when((x == "..") & path.startswith("/"), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def repository(url: Column) -> Column:
    """struct(author, repository, branch, root_name, res_path, url_prefix, url_postfix) of a code-host URL.

    Segments are cut by place, so a branch whose name also stands earlier in the path does no harm; the postfix is null until
    a branch is known.
    """
    parts = F.split(F.regexp_replace(F.parse_url(url, F.lit("PATH")), r"\.git$", ""), "/")
    at = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    rest = F.when(F.size(parts) > 5, F.array_join(F.slice(parts, F.lit(6), F.greatest(F.size(parts) - 5, F.lit(0))), "/")).otherwise("")
    return F.struct(
        at(1).alias("author"), at(2).alias("repository"), at(4).alias("branch"), F.element_at(parts, -1).alias("root_name"), rest.alias("res_path"),
        F.concat(F.lit(CODE_HOST_API), at(1), F.lit("/"), at(2), F.lit("/contents/")).alias("url_prefix"), F.concat(F.lit("?ref="), at(4)).alias("url_postfix"),
    )


def without_git(url: Column) -> Column:
    return F.regexp_replace(url, r"\.git$", "")


def without_slash(url: Column) -> Column:
    """At most one trailing slash goes."""
    return F.regexp_replace(url, r"/$", "")


def normal_base(url: Column) -> Column:
    """The default host's base URL ends in v1; others stay as they are."""
    cut = without_slash(url)
    return F.when(~url.contains(DEFAULT_HOST), url).when(cut.endswith("v1"), cut).otherwise(F.concat(cut, F.lit("/v1")))


def models_url(base: Column) -> Column:
    return F.concat(without_slash(base), F.lit("/models"))


def rebased(path: Column, res_path: Column) -> Column:
    """A listed path relative to the resource's own."""
    return F.when(F.coalesce(res_path, F.lit("")) == "", path).otherwise(F.substring(path, F.length(res_path) + 2, F.length(path)))
