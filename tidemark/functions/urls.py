"""URLs as column expressions: canonical page form, site and host tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.wording import bound

#: Query parameters that only track visits.
TRACKING = r"(?i)^(utm_[a-z]+|gclid|fbclid|msclkid|mc_[a-z]+|_ga|ref)$"
#: Path endings of files that aren't pages.
ASSETS = r"(?i)\.(pdf|zip|gz|tgz|rar|7z|tar|jpe?g|png|gif|webp|avif|svg|ico|bmp|tiff?|mp[34]|m4a|mov|avi|wmv|webm|ogg|wav|flac|css|js|mjs|json|xml|txt|csv|xlsx?|docx?|pptx?|woff2?|ttf|eot|exe|dmg|apk|rss|atom)$"
_PARTS = r"(?is)^(https?)://(?:[^/?#@]*@)?([^/?#:\\]+)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, group)


#: The parameters of Punycode's digits and thresholds.
_BASE, _LEAST, _MOST, _SKEW, _DAMP, _BIAS = 36, 1, 26, 38, 700, 72
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _punycode(label: str) -> str:
    """SQL for the Punycode of a label (SQL as well), as folds over its code points: the smallest not yet told comes next, and the
    steps to each of its places are written as digits of a base that adapts."""
    threshold = f"least({_MOST}L, greatest({_LEAST}L, {_BASE} * i - s.bias))"
    digit = lambda d: f"substr('{_DIGITS}', cast({d} + 1 as int), 1)"
    last, rest, more = f"v.q < {threshold}", f"(v.q - {threshold}) div ({_BASE} - {threshold})", f"{threshold} + (v.q - {threshold}) % ({_BASE} - {threshold})"
    number = f"aggregate(sequence(1, 12), named_struct('q', s.delta, 'out', '', 'more', true), (v, i) -> if(v.more, named_struct('q', if({last}, v.q, {rest}), 'out', concat(v.out, {digit(f'if({last}, v.q, {more})')}), 'more', not ({last})), v), v -> v.out)"
    first = f"if(s.h = s.b, s.delta div {_DAMP}, s.delta div 2)"
    limit = (_BASE - _LEAST) * _MOST // 2
    adapted = f"aggregate(sequence(1, 8), named_struct('d', {first} + {first} div (s.h + 1), 'k', 0L), (a, i) -> if(a.d > {limit}, named_struct('d', a.d div {_BASE - _LEAST}, 'k', a.k + {_BASE}), a), a -> a.k + ({_BASE} * a.d) div (a.d + {_SKEW}))"
    state = lambda out, n, delta, bias, h: f"named_struct('out', {out}, 'n', {n}, 'delta', {delta}, 'bias', {bias}, 'h', {h}, 'b', s.b)"
    step = f"if(c < s.n, {state('s.out', 's.n', 's.delta + 1', 's.bias', 's.h')}, if(c = s.n, {state(f'concat(s.out, {number})', 's.n', '0L', adapted, 's.h + 1')}, s))"
    points = f"transform(regexp_extract_all({label}, '(?s)(.)', 1), x -> cast(ascii(x) as bigint))"
    plain = f"array_join(filter(regexp_extract_all({label}, '(?s)(.)', 1), x -> ascii(x) < 128), '')"
    start = f"named_struct('out', if({plain} = '', '', concat({plain}, '-')), 'n', 128L, 'delta', 0L, 'bias', {_BIAS}L, 'h', cast(length({plain}) as bigint), 'b', cast(length({plain}) as bigint))"
    begun = state("s.out", "m", "s.delta + (m - s.n) * (s.h + 1)", "s.bias", "s.h")
    ended = f"element_at(transform(array(aggregate({points}, {begun}, (s, c) -> {step})), s -> {state('s.out', 's.n + 1', 's.delta + 1', 's.bias', 's.h')}), 1)"
    return f"aggregate(array_sort(array_distinct(filter({points}, x -> x >= 128))), {start}, (s, m) -> {ended}, s -> s.out)"


def ascii_host(name: Column) -> Column:
    """A host name with its international labels in ASCII form (xn--); letters in lower case, as composed as they are given."""
    each = F.expr(f"x -> if(x rlike '[^\\\\x00-\\\\x7F]', concat('xn--', {_punycode('x')}), x)")
    labels = F.call_function("transform", F.split(F.lower(name), r"[.\u3002\uFF0E\uFF61]"), each)
    return F.when(name.rlike(r"[^\x00-\x7F]"), F.array_join(labels, ".")).otherwise(F.lower(name))


def encoded_path(path: Column) -> Column:
    """A path with what may not stand in it percent-encoded as UTF-8, and without segments of one or two dots."""
    code = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    bad = r"[^\x21-\x7E]|[\"<>`{}]"
    clean = lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit("(?s)(.)"), F.lit(1)), lambda c: F.when(c.rlike(bad), code(c)).otherwise(c)), "")
    return bound(bound(path, lambda p: F.when(p.rlike(bad), clean(p)).otherwise(p)), _without_dots)


def _without_dots(path: Column) -> Column:
    up, here = r"(?i)^(?:\.|%2e){2}$", r"(?i)^(?:\.|%2e)$"
    segments = F.split(F.regexp_replace(path, r"(?i)/((?:\.|%2e){1,2})$", "/$1/"), "/")
    left = F.aggregate(segments, F.array().cast("array<string>"), lambda out, x: F.when(x.rlike(here), out).when(x.rlike(up), F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))).otherwise(F.concat(out, F.array(x))))
    return F.when(path.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|$)"), F.array_join(left, "/")).otherwise(path)


def form_encoded(text: Column) -> Column:
    """A parameter's name or value as forms write it, however it was encoded before; what can't be decoded is taken as it is."""
    return F.url_encode(F.coalesce(F.try_url_decode(text), text))


def host(url: Column) -> Column:
    """Lower-case host of an http(s) URL, international labels in ASCII form, or an empty string."""
    return F.coalesce(bound(_part(url, 2), ascii_host), F.lit(""))


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, default port or tracking parameters, parameters sorted by name, single
    slashes, no slash at the end but for the root. Null for anything that is no http(s) URL.

    International labels of the host are in ASCII form (xn--); paths are percent-encoded where they have to be, and parameters
    as forms are; escapes that are there already stay. Each part is computed once, as later ones name it several times over."""
    parts = F.struct(F.lower(_part(url, 1)).alias("scheme"), host(url).alias("host"), _part(url, 3).alias("port"), _path(_part(url, 4)).alias("path"), _part(url, 5).alias("query"))
    return bound(parts, _built)


def _path(path: Column) -> Column:
    clean = lambda p: F.regexp_replace(encoded_path(p), "/{2,}", "/")
    trimmed = lambda p: F.when(p == "", F.lit("/")).when(F.length(p) > 1, F.regexp_replace(p, "/+$", "")).otherwise(p)
    return bound(bound(F.replace(path, F.lit("\\"), F.lit("/")), clean), trimmed)


def _built(of: Column) -> Column:
    scheme, port = of["scheme"], of["port"]
    default = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80")) | (port == "")
    name = lambda p: F.regexp_extract(p, "^([^=]*)", 1)
    kept = F.filter(F.split(of["query"], "&"), lambda p: (p != "") & ~name(p).rlike(TRACKING))
    pair = lambda p: F.concat(form_encoded(name(p)), F.lit("="), form_encoded(F.regexp_replace(p, "^[^=]*=?", "")))
    # sorted by name alone and stable: the place within the URL breaks ties
    keyed = F.array_sort(F.transform(kept, lambda p, i: F.struct(name(p).alias("name"), i.alias("at"), pair(p).alias("pair"))))
    pairs = F.array_join(F.transform(keyed, lambda x: x["pair"]), "&")
    asked = bound(pairs, lambda x: F.when(x != "", F.concat(F.lit("?"), x)).otherwise(F.lit("")))
    built = F.concat(scheme, F.lit("://"), of["host"], F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)), of["path"], F.when(of["query"] != "", asked).otherwise(F.lit("")))
    return F.when(of["host"] != "", built)


def without_www(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"^www\.", "")


def same_site(url: Column, hostname: Column) -> Column:
    return (host(url) != "") & (without_www(host(url)) == without_www(hostname))


def base_url(url: Column) -> Column:
    """scheme://host of an acceptable site address, else null: http(s), no credentials, default port, a public dotted host."""
    name = F.regexp_replace(host(url), r"\.$", "")
    public = name.contains(".") & ~name.rlike(r"^[\d.]+$") & ~name.rlike(r"(^|\.)(localhost|local|internal)$")
    clean = ~F.trim(url).rlike(r"(?i)^https?://[^/?#]*@") & _part(url, 3).isin("", "80", "443")
    return F.when((host(url) != "") & public & clean, F.concat(F.lower(_part(url, 1)), F.lit("://"), name))


def host_suffixes(name: Column) -> Column:
    """A host and all its parent domains, so that coverage by a domain is an equi-join and no nested loop."""
    labels = F.split(F.lower(name), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def crawlable(url: Column, hostname: Column, prefix: Column | None = None) -> Column:
    """http(s), same site, no asset file, and under the path prefix if one is given."""
    path = _part(url, 4)
    ok = same_site(url, hostname) & ~path.rlike(ASSETS)
    if prefix is None:
        return ok
    trimmed = F.regexp_replace(prefix, "/+$", "")
    return ok & (prefix.isNull() | (trimmed == "") | (path == trimmed) | path.startswith(F.concat(trimmed, F.lit("/"))))


def first_seen(found: DataFrame, hostname: Column, prefix: Column | None = None) -> DataFrame:
    """url (canonical) and at, the first place it was met, of found (at, url): crawl candidates of the site only."""
    rows = found.select(canonical(F.col("url")).alias("url"), "at").where(F.col("url").isNotNull() & crawlable(F.col("url"), hostname, prefix))
    return rows.groupBy("url").agg(F.min("at").alias("at"))
