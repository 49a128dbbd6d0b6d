"""URL columns: canonical form, policy, origin, names for saved pages."""

from __future__ import annotations

import unicodedata
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from archivolt import fixed
from archivolt.functions.text import _col, has_any, strip

# scheme, user info, host, port, path, query
_URL = (
    r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?//(?:([^/?#]*)@)?"
    r"(\[[^\]/?#]*\]|[^/?#:]*)(?::([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
)


def parts(c) -> Column:
    """Struct of scheme, userinfo, host, port, path and query of a URL."""
    url = strip(c)
    get = lambda i: F.regexp_extract(url, _URL, i)
    return F.struct(
        F.lower(get(1)).alias("scheme"), get(2).alias("userinfo"),
        F.lower(F.translate(get(3), "[]", "")).alias("host"),
        get(4).alias("port"), get(5).alias("path"), get(6).alias("query"),
    )


def canonical(c) -> Column:
    """One spelling per page: lower scheme and host, no default port, no
    fragment, decoded and sorted query.  Null without a host or with a bad port.
    """
    p = parts(c)
    return _assemble(p, _canonical_query(p["query"]))


def _decoded(piece: Column) -> Column:
    """Percent-decoded text; a broken escape leaves it as it is."""
    return F.coalesce(F.try_url_decode(piece), piece)


def _encoded(piece: Column) -> Column:
    # Java spares '*' and escapes '~'; URLs want it the other way round.
    return F.replace(F.replace(F.url_encode(piece), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _canonical_query(query: Column) -> Column:
    """Pairs of a query decoded, sorted and encoded again; blank values are kept."""
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda kv: F.named_struct(
        F.lit("k"), _decoded(F.substring_index(kv, "=", 1)),
        F.lit("v"), _decoded(F.regexp_extract(kv, r"(?s)^[^=]*=(.*)$", 1))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda kv: F.concat(
        _encoded(kv["k"]), F.lit("="), _encoded(kv["v"]))), "&")


def _assemble(p: Column, query: Column) -> Column:
    host = F.rtrim(p["host"], F.lit("."))
    shown = F.when(F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    port = F.when(p["port"] == "", F.lit(-1)).otherwise(p["port"].try_cast("int"))
    default = (port == -1) | ((p["scheme"] == "http") & (port == 80)) | ((p["scheme"] == "https") & (port == 443))
    netloc = F.when(default, shown).otherwise(F.concat(shown, F.lit(":"), port.cast("string")))
    path = F.when(p["path"] == "", F.lit("/")).otherwise(p["path"])
    tail = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))
    return F.when(
        (host != "") & port.isNotNull() & port.between(-1, 65535),
        F.concat(p["scheme"], F.lit("://"), netloc, path, tail),
    )


def rejection(c) -> Column:
    """Why a URL may not be crawled, or null: scheme, credentials, host, port."""
    p = parts(c)
    port = p["port"].try_cast("int")
    return (
        F.when(~p["scheme"].isin("http", "https"), F.lit("scheme"))
        .when(p["userinfo"].rlike("[^:]"), F.lit("credentials"))
        .when(F.rtrim(p["host"], F.lit(".")) == "", F.lit("host"))
        .when((p["port"] != "") & (port.isNull() | ~port.between(0, 65535)), F.lit("port"))
    )


# Networks that are not globally reachable, as dotted prefixes in SQL terms.
_PRIVATE_V4 = (
    r"^(0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\."
    r"|192\.0\.0\.|192\.0\.2\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|24[0-9]\.|25[0-5]\.)"
)
_VALID_V4 = r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$"
_PRIVATE_V6 = r"(?i)^(::1?$|fe[89ab]|f[cd]|2001:db8:|::ffff:|64:ff9b:1:|100::)"


def address_is_public(c) -> Column:
    """True for a globally reachable address; null when it is no address."""
    ip = F.substring_index(_col(c), "%", 1)
    return F.when(ip.rlike(_VALID_V4), ~ip.rlike(_PRIVATE_V4)).when(
        ip.rlike(r"(?i)^[0-9a-f:.]*:[0-9a-f:.]*$"), ~ip.rlike(_PRIVATE_V6))


def origin(c) -> Column:
    """Scheme, host and port that two pages of one site share."""
    p = parts(c)
    port = F.coalesce(
        F.nullif(p["port"].try_cast("int"), F.lit(0)), F.when(p["scheme"] == "https", 443).otherwise(80))
    return F.struct(p["scheme"].alias("scheme"), p["host"].alias("host"), port.alias("port"))


def same_origin(a, b) -> Column:
    return origin(a) == origin(b)


def is_skipped(c) -> Column:
    """True for pages never worth a visit, by path fragment or extension."""
    p = parts(c)
    low = F.lower(F.concat(p["path"], F.when(p["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), p["query"]))))
    suffix = F.lower(F.regexp_extract(F.substring_index(F.rtrim(p["path"], F.lit("/")), "/", -1), r"[^.].*?(\.[^.]+)$", 1))
    return has_any(low, fixed.URL_SKIP_FRAGMENTS) | suffix.isin(fixed.URL_SKIP_EXTENSIONS)


def is_web_url(url, href=None) -> Column:
    """True when the first filled one of two columns is an http(s) address."""
    first = F.coalesce(F.nullif(_col(url), F.lit("")), *([] if href is None else [_col(href)]), F.lit(""))
    return first.startswith("http://") | first.startswith("https://")


def is_trusted(c) -> Column:
    """True when the host part ends with one of the trusted suffixes."""
    host = F.lower(F.regexp_extract(_col(c), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    out = F.lit(False)
    for suffix in fixed.TRUSTED_SUFFIXES:
        out = out | host.endswith(suffix)
    return out


def domain_label(c) -> Column:
    """First label of the host without 'www.', 'desconocido' when missing."""
    host = F.replace(F.regexp_extract(_col(c), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("www."), F.lit(""))
    return F.when(host == "", F.lit("desconocido")).otherwise(F.substring_index(host, ".", 1))


def url_key(c) -> Column:
    return F.lower(strip(c))


# --- names of saved artifacts ------------------------------------------------

@F.pandas_udf(T.StringType())
def to_ascii(value: pd.Series) -> pd.Series:
    """Compatibility decomposition with everything outside ASCII dropped."""
    return value.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode())


def safe_name(c, fallback: str, max_length: int = 60, ascii_only: bool = False) -> Column:
    """A file-system name: ASCII words joined by '_', cut, lower-cased.

    ``ascii_only`` says that the column is ASCII already, which keeps the
    expression out of Python.
    """
    value = _col(c) if ascii_only else to_ascii(_col(c))
    ends = F.lit("._- ")
    value = F.btrim(F.regexp_replace(value, r"[^a-zA-Z0-9_-]+", "_"), ends)
    value = F.rtrim(F.substring(F.regexp_replace(value, r"_+", "_"), 1, max_length), ends)
    bad = (value == "") | F.upper(value).isin(fixed.RESERVED_NAMES)
    return F.when(bad, F.lit(fallback)).otherwise(F.lower(value))


def page_file_name(url, ascii_only: bool = False) -> Column:
    """Name of a crawled page: safe stem of its path and a digest of its URL."""
    name = F.substring_index(F.rtrim(parts(url)["path"], F.lit("/")), "/", -1)
    stem = F.when(name == "", F.lit("index")).otherwise(F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", ""))
    return F.concat(safe_name(stem, "page", 55, ascii_only), F.lit("_"),
                    F.substring(F.sha2(_col(url).cast("binary"), 256), 1, 10), F.lit(".md"))


def ingest_file_name(name, stamp, key=None, prefix: str = "Ingestion", cut: int = 40) -> Column:
    """``{prefix}_{stamp}_{base}_{digest}.md``; the digest is of ``key`` or the name."""
    name = _col(name)
    base = F.when(name == "", F.lit("documento")).otherwise(F.regexp_replace(name, r"(?<=[^./])\.[^./]*$", ""))
    digest = F.substring(F.md5((name if key is None else _col(key)).cast("binary")), 1, 8)
    stamp = stamp if isinstance(stamp, Column) else F.lit(stamp)
    return F.concat(F.lit(prefix + "_"), stamp, F.lit("_"),
                    F.substring(F.replace(base, F.lit(" "), F.lit("_")), 1, cut), F.lit("_"), digest, F.lit(".md"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def join_links(base: pd.Series, hrefs: pd.Series) -> pd.Series:
    """Absolute targets of the links of a page, in order, without repeats."""
    def one(b, hs):
        out = []
        for h in ([] if hs is None else hs):
            try:
                target = urljoin(b, h)
                urlsplit(target)
            except ValueError:
                continue
            out.append(target)
        return list(dict.fromkeys(out))
    return pd.Series([one(b, h) for b, h in zip(base, hrefs)], index=base.index)
