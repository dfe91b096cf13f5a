"""Repository addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import WS, replace_all, trim_ws

HOSTED_TYPES = ("github", "gitlab", "bitbucket")
CACHE_PREFIX = "wiki_cache"

# scheme, host, port, path of an absolute web address
_ABSOLUTE = rf"(?i)\A(https?)://(?:[^@/?#]*@)?([^:/?#@{WS}]+)(?::(\d*))?([^?#]*)"
_WINDOWS_PATH = r'\A[a-zA-Z]:\\(?:[^\\/:*?"<>|\r\n]+\\)*[^\\/:*?"<>|\r\n]*\z'
_HOSTED_PATH = r"\A(?:https?://)?([^/]+)/(.+?)/([^/]+)(?:\.git)?/?\z"


def _last(parts: Column) -> Column:
    return F.element_at(parts, -1)


def repo_name(url: Column, repo_type: Column) -> Column:
    """H4: `owner_repo` for a hosted address, else the last path part, without `.git`."""
    parts = F.split(F.rtrim(url, F.lit("/")), "/")
    name = replace_all(_last(parts), ".git", "")
    hosted = repo_type.isin(*HOSTED_TYPES) & (F.size(parts) >= 5)
    return F.when(hosted, F.concat_ws("_", F.try_element_at(parts, F.lit(-2)), name)).otherwise(name)


def _address_part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _ABSOLUTE, group)


def _with_scheme(s: Column) -> Column:
    return F.when(F.startswith(s, F.lit("http")), s).otherwise(F.concat(F.lit("https://"), s))


def host_name(url: Column) -> Column:
    """Lower-cased host of an absolute address, or null."""
    return F.nullif(F.lower(_address_part(url, 2)), F.lit(""))


def url_domain(s: Column) -> Column:
    """H6: scheme, host and any non-default port; null for an invalid address."""
    url = _with_scheme(s)
    scheme, port = F.lower(_address_part(url, 1)), _address_part(url, 3)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    suffix = F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port))
    return F.concat(scheme, F.lit("://"), host_name(url), suffix)


def url_path(s: Column) -> Column:
    """H6: path without one leading and one trailing slash; null for an invalid address."""
    url = _with_scheme(s)
    path = F.regexp_replace(_address_part(url, 4), r"\A/|/\z", "")
    return F.when(host_name(url).isNotNull(), path)


def parse_repo_input(s: Column) -> Column:
    """H5: typed owner / repo / path of a local path or a hosted address; null if unsupported."""
    text = trim_ws(s)
    windows, unix, hosted = text.rlike(_WINDOWS_PATH), F.startswith(text, F.lit("/")), text.rlike(_HOSTED_PATH)
    local = windows | unix

    domain = F.coalesce(url_domain(text), F.lit(""))
    kind = (
        F.when(local, F.lit("local"))
        .when(domain.contains("github.com"), F.lit("github"))
        .when(domain.contains("gitlab.com") | domain.contains("gitlab."), F.lit("gitlab"))
        .when(domain.contains("bitbucket.org") | domain.contains("bitbucket."), F.lit("bitbucket"))
        .otherwise(F.lit("web"))
    )
    full_path = F.regexp_replace(url_path(text), r"\.git\z", "")
    parts = F.split(full_path, "/")
    paired = F.size(parts) >= 2
    local_name = F.when(windows, _last(F.split(text, r"\\"))).otherwise(
        F.try_element_at(F.filter(F.split(text, "/"), lambda x: x != ""), F.lit(-1))
    )
    repo = F.when(local, F.coalesce(F.nullif(local_name, F.lit("")), F.lit("local-repo"))).when(
        paired, F.try_element_at(parts, F.lit(-1))
    )
    owner = F.when(local, F.lit("local")).when(paired, F.try_element_at(parts, F.lit(-2)))
    usable = (local | hosted) & (F.coalesce(owner, F.lit("")) != "") & (F.coalesce(repo, F.lit("")) != "")
    return F.when(
        usable,
        F.struct(
            trim_ws(owner).alias("owner"),
            F.regexp_replace(trim_ws(repo), r"\.git\z", "").alias("repo"),
            kind.alias("type"),
            F.when(~local, full_path).alias("full_path"),
            F.when(local, text).alias("local_path"),
        ),
    )


def repo_url(kind: Column, owner: Column, repo: Column, local_path: Column, url: Column) -> Column:
    """H7: local path, then the given address, then one made from owner and repo, else empty."""
    def filled(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) != ""

    return (
        F.when((kind == "local") & filled(local_path), local_path)
        .when(filled(url), url)
        .when(filled(owner) & filled(repo), F.concat(F.lit("http://example/"), owner, F.lit("/"), repo))
        .otherwise(F.lit(""))
    )


def file_url(kind: Column, url: Column, branch: Column, path: Column) -> Column:
    """H8: address of a file on its host; the bare path where there is none."""
    host = F.coalesce(host_name(url), F.lit(""))

    def under(middle: str) -> Column:
        return F.concat(url, F.lit(middle), branch, F.lit("/"), path)

    return (
        F.when((F.coalesce(kind, F.lit("")) == "local") | (F.coalesce(url, F.lit("")) == ""), path)
        .when(host.contains("github"), under("/blob/"))
        .when(host.contains("gitlab"), under("/-/blob/"))
        .when(host.contains("bitbucket"), under("/src/"))
        .otherwise(path)
    )


def cache_key(
    kind: Column, owner: Column, repo: Column, language: Column,
    view: Column | None = None, prefix: str = CACHE_PREFIX,
) -> Column:
    """H9: stored name of a wiki; `view` gives the browser-side form with a view suffix."""
    stem = F.concat_ws("_", F.lit(prefix), kind, owner, repo, language)
    return F.concat(stem, F.lit(".json")) if view is None else F.concat_ws("_", stem, view)


def parse_cache_key(name: Column, prefix: str = CACHE_PREFIX) -> Column:
    """H9: first part is the type, second the owner, last the language, the rest the repo."""
    bare = replace_all(replace_all(name, f"{prefix}_", ""), ".json", "")
    parts = F.split(bare, "_")
    matches = F.startswith(name, F.lit(f"{prefix}_")) & F.endswith(name, F.lit(".json"))
    middle = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 3, F.lit(0))), "_")
    return F.when(
        matches & (F.size(parts) >= 4),
        F.struct(
            F.try_element_at(parts, F.lit(1)).alias("repo_type"),
            F.try_element_at(parts, F.lit(2)).alias("owner"),
            middle.alias("repo"),
            F.try_element_at(parts, F.lit(-1)).alias("language"),
        ),
    )


def repo_short_name(url: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(url, "/", -1)
