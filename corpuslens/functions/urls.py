"""URL functions as column expressions, all within code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Query keys that are dropped, besides those that begin with utm_ (fixed values).
TRACKING = ["gclid", "fbclid", "mc_eid", "mc_cid", "ref", "_ga", "_gl", "igshid", "yclid"]

#: Paths that a crawl leaves out unless told otherwise (fixed values).
DEFAULT_EXCLUDES = [
    r"/wp-admin/",
    r"/wp-content/uploads/",
    r"/wp-json/",
    r"/feed/?$",
    r"/page/\d+/?$",
    r"/tag/",
    r"/author/",
    r"/cdn-cgi/",
    r"/\.well-known/",
    r"\.(jpg|jpeg|png|gif|svg|webp|ico|css|js|woff2?|ttf|eot|map|pdf|zip|tar|gz|mp4|webm|mp3)(\?|$)",
]
SKIPPED_SCHEMES = ["mailto:", "javascript:", "tel:"]

#: scheme, authority, path, query; the fragment is left out.
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, PARTS, i)


def scheme(url: Column) -> Column:
    return F.lower(_part(F.trim(url), 1))


def authority(url: Column) -> Column:
    """Host with port, as it stands but in lower case."""
    return F.lower(_part(F.trim(url), 2))


def is_absolute(url: Column) -> Column:
    return F.coalesce(F.trim(url).rlike(PARTS), F.lit(False))


def host(url: Column) -> Column:
    """Lower-case host, without the scheme's own port."""
    own = authority(url)
    return F.when(scheme(url) == "http", F.regexp_replace(own, r":80$", "")).when(scheme(url) == "https", F.regexp_replace(own, r":443$", "")).otherwise(own)


def path(url: Column) -> Column:
    return _part(F.trim(url), 3)


def same_host(a: Column, b: Column) -> Column:
    """Equal authority in any case, the port included; false where one isn't absolute."""
    return is_absolute(a) & is_absolute(b) & (authority(a) == authority(b))


def clean_path(p: Column) -> Column:
    """Dot segments resolved and empty segments dropped; a trailing slash stays."""
    step = lambda stack, seg: F.when(seg == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.concat(stack, F.array(seg)))
    segments = F.filter(F.split(p, "/"), lambda s: ~s.isin("", "."))
    # Only a path with a ".." needs the stack.
    stack = F.when(F.exists(segments, lambda s: s == ".."), F.aggregate(segments, F.array().cast("array<string>"), step)).otherwise(segments)
    joined = F.concat(F.lit("/"), F.array_join(stack, "/"))
    return F.when(p == "", F.lit("")).otherwise(F.concat(joined, F.when(p.endswith("/") & (joined != "/"), "/").otherwise("")))


def _escaped(s: Column, plain: str) -> Column:
    """Percent-encoding that leaves letters, digits, "-_.~" and ``plain`` as they are; a space becomes "+" unless that is plain."""
    out = F.replace(F.replace(F.url_encode(s), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    if "+" in plain:
        out = F.replace(out, F.lit("+"), F.lit("%20"))
    for c in plain:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return F.when(s.rlike(f"^[A-Za-z0-9_.~{plain}-]*$"), s).otherwise(out)


def decoded_path(raw: Column) -> Column:
    """A path without percent signs; null where an escape is malformed."""
    return F.when(F.contains(raw, F.lit("%")), F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))).otherwise(raw)


def canonical_path(raw: Column) -> Column:
    """Resolved, without a slash at the end, escaped; a path that is clean as it stands keeps its own escapes.  Null where malformed."""
    stripped = lambda p: F.when(p == "", "/").when(F.length(p) > 1, F.regexp_replace(p, r"/+$", "")).otherwise(p)
    valid = raw.rlike(r"^[A-Za-z0-9_.~!$&'()*+,;=:@/%\[\]-]+$")
    shown = lambda x: F.when(x["plain"].isNull(), None).when((x["clean"] == x["plain"]) & valid, raw).otherwise(_escaped(x["clean"], "$&+,/:;=@"))
    both = lambda plain: F.struct(plain.alias("plain"), stripped(clean_path(plain)).alias("clean"))
    return _let(_let(decoded_path(raw), both), shown)


def clean_query(q: Column) -> Column:
    """Tracking keys dropped, pairs in order of their keys; values of one key keep their order, an empty value loses its "=".

    Pairs with a malformed escape or a semicolon go.
    """
    pair = lambda x, i: F.struct(F.try_url_decode(F.regexp_extract(x, r"^([^=]*)", 1)).alias("k"), i.alias("i"), F.try_url_decode(F.regexp_extract(x, r"^[^=]*=(.*)$", 1)).alias("v"))
    pairs = F.transform(F.filter(F.split(q, "&"), lambda x: (x != "") & ~F.contains(x, F.lit(";"))), pair)
    kept = F.filter(pairs, lambda x: x["k"].isNotNull() & x["v"].isNotNull() & ~F.lower(x["k"]).isin(TRACKING) & ~F.lower(x["k"]).startswith("utm_"))
    shown = F.transform(F.array_sort(kept), lambda x: F.concat(_escaped(x["k"], ""), F.when(x["v"] == "", "").otherwise(F.concat(F.lit("="), _escaped(x["v"], "")))))
    return F.array_join(shown, "&")


def canonicalize(url: Column) -> Column:
    """The canonical form of an absolute URL; null for any other, and where an escape in the path is malformed."""
    query = lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))
    asked = lambda u: F.when(F.trim(u).rlike(r"^[^#?]*\?(?:#|$)"), "?").otherwise(_let(clean_query(_part(F.trim(u), 4)), query))
    out = lambda u: F.when(is_absolute(u), F.concat(scheme(u), F.lit("://"), host(u), canonical_path(path(u)), asked(u)))
    return _let(url, out)


def admitted_path(url: Column, includes: list[str] | None = None, excludes: list[str] | None = None) -> Column:
    """True where the decoded path meets one of ``includes``, if any are given, and none of ``excludes``."""
    excludes = DEFAULT_EXCLUDES if excludes is None else excludes
    p = F.coalesce(decoded_path(path(url)), path(url))
    ok = F.lit(True)
    if includes:
        ok = p.rlike("|".join(f"(?:{x})" for x in includes))
    if excludes:
        ok = ok & ~p.rlike("|".join(f"(?:{x})" for x in excludes))
    return ok


def followed_scheme(href: Column) -> Column:
    ok = F.lit(True)
    for s in SKIPPED_SCHEMES:
        ok = ok & ~href.startswith(s)
    return ok


def resolve(base: Column, href: Column) -> Column:
    """``href`` against an absolute ``base``, without its fragment: absolute, network-path, root-relative,
    query-only, empty and relative references."""
    ref = F.regexp_replace(href, r"#.*$", "")
    origin = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    joined = F.concat(F.when(folder == "", "/").otherwise(folder), F.regexp_extract(ref, r"^([^?]*)", 1))
    tail = F.regexp_extract(ref, r"^[^?]*(\?.*)$", 1)
    query = _part(F.trim(base), 4)
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(origin, clean_path(F.regexp_extract(ref, r"^([^?]*)", 1)), tail))
        .when(ref == "", F.concat(origin, path(base), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))
        .when(ref.startswith("?"), F.concat(origin, path(base), ref))
        .otherwise(F.concat(origin, clean_path(joined), tail))
    )


def sitemap_candidates(origin: Column, declared: Column | None = None) -> Column:
    """Sitemaps that robots.txt declares, then the four well-known places, each once, in that order."""
    base = F.rtrim(origin, F.lit("/"))
    known = F.array(*(F.concat(base, F.lit(p)) for p in ("/sitemap.xml", "/sitemap_index.xml", "/sitemaps.xml", "/sitemap-index.xml")))
    return F.array_distinct(known if declared is None else F.concat(F.coalesce(declared, F.array().cast("array<string>")), known))
