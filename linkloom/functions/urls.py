"""URL parsing, resolution and canonical form as Spark SQL expressions.

Each stage below is a set of named SQL fragments; ``@name`` refers to a value
of an earlier stage. ``canonical_url`` nests the stages as ``aggregate`` calls
over one struct, so every intermediate value is computed once and the whole
rule stays one JVM-side expression: usable on a column, inside a lambda over an
array of hrefs, and as the body of a SQL function. (``transform(..)[0]`` would
read better, but it derives its type anew for each row, at a cost that doubles
with each level of nesting.)
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Unicode White_Space characters.
WHITE_SPACE = (
    "\t\n\u000b\u000c\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Href prefixes that never lead to a page.
NON_NAVIGATIONAL = ("javascript:", "mailto:", "tel:", "data:")
# Punctuation left unescaped when a component is re-encoded.
PATH_SAFE = "$&+,/:;=@~"
USER_SAFE = "$&+,;=~"
HOST_SAFE = "!$&'()*+,;=:[]<>\"~"


def trimmed(text: str) -> str:
    """SQL: ``text`` without surrounding Unicode white space."""
    return f"trim(BOTH '{WHITE_SPACE}' FROM {text})"


def navigational(href: str) -> Column:
    """True when an href may lead to a page: not empty, not a script, mail, phone or data link."""
    return F.expr(_navigational(trimmed(href)))


def _navigational(text: str) -> str:
    return " AND ".join([f"{text} <> ''", *[f"NOT startswith({text}, '{p}')" for p in NON_NAVIGATIONAL]])


def _quote(char: str) -> str:
    return '"\'"' if char == "'" else f"'{char}'"


def _encoded_run(text: str, safe: str) -> str:
    """SQL: percent-encode text that holds no escapes, keeping ``safe`` punctuation."""
    out = f"replace(url_encode({text}), '+', '%20')"
    for char in safe:
        if char != "*":
            out = f"replace({out}, '%{ord(char):02X}', {_quote(char)})"
    return out if "*" in safe else f"replace({out}, '*', '%2A')"


def _reencoded(text: str, safe: str) -> str:
    """SQL: decode and encode again, byte for byte, text whose escapes are all well formed."""
    byte = "char(CAST(conv(substr(t, 2), 16, 10) AS INT))"
    keep = "".join("\\" + c if c in "$+/&" else c for c in safe)
    return (
        f"array_join(transform(regexp_extract_all({text}, r'%[0-9A-Fa-f]{{2}}|[^%]+', 0), t -> "
        f"CASE WHEN NOT startswith(t, '%') THEN {_encoded_run('t', safe)} "
        f"WHEN {byte} RLIKE r'^[A-Za-z0-9\\-_.{keep}]$' THEN {byte} ELSE upper(t) END), '')"
    )


def _encoded_path(path: str) -> str:
    """SQL: a path as it is when all its characters may stand in a path, else re-encoded."""
    return (
        f"IF({path} RLIKE r'[^!$-;=@-\\[\\]_a-z~]', {_reencoded(path, PATH_SAFE)}, {path})"
    )


def _without_dot_segments(path: str) -> str:
    """SQL: RFC 3986 dot-segment removal by folding the segments onto an array."""
    return (
        f"CASE WHEN {path} = '' THEN '' "
        f"WHEN instr(concat('/', {path}), '/.') = 0 THEN IF(startswith({path}, '/'), {path}, concat('/', {path})) "
        f"ELSE regexp_replace(concat('/', array_join(aggregate(split({path}, '/'), CAST(array() AS ARRAY<STRING>), "
        f"(kept, seg) -> CASE WHEN seg = '.' THEN kept "
        f"WHEN seg = '..' THEN slice(kept, 1, greatest(size(kept) - 1, 0)) "
        f"ELSE array_append(kept, seg) END), '/'), IF({path} RLIKE r'(^|/)\\.\\.?$', '/', '')), '^//', '/') END"
    )


def _parse_stages(source: str, p: str) -> list[dict[str, str]]:
    """Stages that split the text ``source`` into URL components named with the prefix ``p``."""
    return [
        {f"{p}main": f"substring_index({source}, '#', 1)"},
        {f"{p}scheme": f"lower(regexp_extract(@{p}main, r'^([A-Za-z][A-Za-z0-9+.\\-]*):', 1))"},
        {f"{p}rest": f"IF(@{p}scheme = '', @{p}main, substr(@{p}main, length(@{p}scheme) + 2))"},
        {
            f"{p}hier": f"substring_index(@{p}rest, '?', 1)",
            f"{p}query": f"IF(instr(@{p}rest, '?') > 0, substr(@{p}rest, instr(@{p}rest, '?') + 1), NULL)",
        },
        {
            f"{p}opaque": f"@{p}scheme <> '' AND NOT startswith(@{p}hier, '/')",
            f"{p}auth": f"IF(startswith(@{p}hier, '//') AND (@{p}scheme <> '' OR NOT startswith(@{p}hier, '///')), "
            f"substring_index(substr(@{p}hier, 3), '/', 1), NULL)",
        },
        {
            f"{p}path": f"CASE WHEN @{p}auth IS NOT NULL THEN substr(@{p}hier, length(@{p}auth) + 3) "
            f"WHEN @{p}opaque THEN '' ELSE @{p}hier END",
            f"{p}user": f"IF(instr(@{p}auth, '@') > 0, regexp_extract(@{p}auth, '^(.*)@', 1), NULL)",
            f"{p}host": f"coalesce(substring_index(@{p}auth, '@', -1), '')",
        },
        {f"{p}ok": _well_formed(source, p)},
    ]


def _well_formed(source: str, p: str) -> str:
    def escapes(text: str) -> str:
        return f"(instr({text}, '%') = 0 OR NOT {text} RLIKE r'%(?![0-9A-Fa-f]{{2}})')"

    plain = r"[^\x00-\x20#%/?@\\^`{|}\x7f]*+"
    host = rf"r'^(?:\[[^\]]*+\](?::[0-9]*+)?|(?!\[){plain}(?:%(?:25|[89A-Fa-f][0-9A-Fa-f]){plain})*+)$'"
    port = r"r':[^:\]]*[^0-9:\]][^:\]]*$'"
    user = r"""r"^(?:[!$&-.0-;=@-Z_a-z~]|%[0-9A-Fa-f]{2})*+$" """
    # Most references pass on sight: a plain host or none, no escapes, no control characters.
    simple = (
        r"r'^(?:https?://[A-Za-z0-9.-]+(?::[0-9]*+)?(?=[/?#]|$)|/(?!/)|[?#]|[^:/?#%\x00-\x1f\x7f]++(?=[/?#]|$))"
        r"[^%\x00-\x1f\x7f]*+$'"
    )
    return (
        f"{source} RLIKE {simple} OR NOT {source} RLIKE r'[\\x00-\\x1f\\x7f]' AND NOT startswith(@{p}main, ':') "
        f"AND NOT (@{p}scheme = '' AND NOT startswith(@{p}hier, '/') "
        f"AND instr(substring_index(@{p}hier, '/', 1), ':') > 0) "
        f"AND {escapes(f'@{p}path')} "
        f"AND (instr({source}, '#') = 0 OR {escapes(f'substr({source}, length(@{p}main) + 2)')}) "
        f"AND (@{p}host = '' OR (@{p}host RLIKE {host} AND (instr(@{p}host, ':') = 0 OR NOT @{p}host RLIKE {port}))) "
        f"AND coalesce(@{p}user RLIKE {user}, true)"
    )


def _resolve_stages() -> list[dict[str, str]]:
    """Stages that resolve the parsed reference ``r_`` against the parsed base ``b_``."""
    return [
        {"own": "@r_scheme <> '' OR @r_host <> '' OR @r_user IS NOT NULL"},
        {
            "scheme": "IF(@r_scheme <> '', @r_scheme, @b_scheme)",
            "user": "IF(@own, @r_user, @b_user)",
            "host": "IF(@own, @r_host, @b_host)",
            "bare": "@r_scheme <> '' AND @r_auth IS NULL",
            "query": "CASE WHEN @own OR @r_path <> '' OR @r_query IS NOT NULL THEN @r_query "
            "ELSE nullif(@b_query, '') END",
            "full": "CASE WHEN @own OR startswith(@r_path, '/') THEN @r_path_enc "
            "WHEN @r_path = '' THEN @b_path_enc "
            "ELSE concat(left(@b_path_enc, length(@b_path_enc) - length(substring_index(@b_path_enc, '/', -1))), "
            "@r_path_enc) END",
        },
        {"path": _without_dot_segments("@full")},
    ]


def _host_form(scheme: str, host: str) -> str:
    """SQL: lower-case host, default port of the scheme dropped, non-ASCII percent-encoded."""
    bare = (
        f"CASE WHEN {scheme} = 'http' AND endswith({host}, ':80') THEN left({host}, length({host}) - 3) "
        f"WHEN {scheme} = 'https' AND endswith({host}, ':443') THEN left({host}, length({host}) - 4) ELSE {host} END"
    )
    decoded = f"lower(coalesce(try_url_decode(replace({bare}, '+', '%2B')), {bare}))"
    return f"IF({host} RLIKE r'[^!-$&-~]', {_encoded_run(decoded, HOST_SAFE)}, lower({bare}))"


def _user_form(user: str) -> str:
    name, secret = f"substring_index({user}, ':', 1)", f"substr({user}, instr({user}, ':') + 1)"
    return (
        f"CASE WHEN {user} IS NULL THEN '' WHEN instr({user}, ':') > 0 "
        f"THEN concat({_reencoded(name, USER_SAFE)}, ':', {_reencoded(secret, USER_SAFE)}, '@') "
        f"ELSE concat({_reencoded(user, USER_SAFE)}, '@') END"
    )


def _rendered() -> str:
    """SQL: the text of the resolved URL."""
    return (
        "concat(@scheme, ':', CASE WHEN @r_opaque THEN @r_hier ELSE concat("
        "CASE WHEN @user IS NOT NULL OR @host <> '' THEN '//' WHEN @path <> '' AND NOT @bare THEN '//' ELSE '' END, "
        f"{_user_form('@user')}, {_host_form('@scheme', '@host')}, @path) END, "
        "coalesce(concat('?', @query), ''))"
    )


def _let(stages: list[dict[str, str]], names: dict[str, str], body: str, tag: str, of: str = "STRING") -> str:
    """Bind the values of the stages around ``body``, SQL text or a callable on the bound names."""

    def bind(text: str) -> str:
        return re.sub(r"@([a-z]\w*)", lambda m: names[m.group(1)], text)

    opened = []
    for i, stage in enumerate(stages):
        var = f"{tag}{i}"
        fields = ", ".join(f"'{name}', {bind(sql)}" for name, sql in stage.items())
        opened.append(f"aggregate(array(named_struct({fields})), CAST(NULL AS {of}), (_{var}, {var}) -> ")
        names.update({name: f"{var}.{name}" for name in stage})
    return "".join(opened) + (body(names) if callable(body) else bind(body)) + ")" * len(stages)


def _base_stages() -> list[dict[str, str]]:
    stages = _parse_stages("@base", "b_")
    stages[-1]["b_path_enc"] = _encoded_path("@b_path")
    stages.append({
        "b_origin": "IF(@b_ok AND @b_scheme IN ('http', 'https') AND @b_host <> '', concat(@b_scheme, '://', "
        f"{_user_form('@b_user')}, {_host_form('@b_scheme', '@b_host')}), NULL)"
    })
    return stages


def _reference_stages() -> list[dict[str, str]]:
    stages = [{"ref": trimmed("@href")}, *_parse_stages("@ref", "r_")]
    stages[-1]["r_path_enc"] = _encoded_path("@r_path")
    return stages + _resolve_stages()


# Hrefs already in canonical form, and root-relative ones that need only the origin of the page:
# no escapes, no dot segments, nothing to encode. Most links of a page are of these two kinds.
_CLEAN_TAIL = r"(?!\.)(?!.*/\.)[!$&-;=@-\[\]_a-z~]*+(?:\?[!-\x22$-~]*+)?$"
_CLEAN_ABSOLUTE = rf"r'^https?://[a-z0-9.-]+/{_CLEAN_TAIL}'"
_CLEAN_ROOTED = rf"r'^/(?!/){_CLEAN_TAIL}'"


def _canonical_body() -> str:
    return (
        f"CASE WHEN @b_ok AND @r_ok AND {_navigational('@ref')} "
        f"AND @scheme IN ('http', 'https') THEN {_rendered()} END"
    )


def _canonical_href(names: dict[str, str], href: str) -> str:
    names = {**names, "href": href}
    general = _let(_reference_stages(), dict(names), _canonical_body(), "r")
    return (
        f"CASE WHEN {names['b_ok']} AND {href} RLIKE {_CLEAN_ABSOLUTE} THEN {href} "
        f"WHEN {names['b_origin']} IS NOT NULL AND {href} RLIKE {_CLEAN_ROOTED} "
        f"THEN concat({names['b_origin']}, {href}) ELSE {general} END"
    )


def canonical_url_sql(href: str, base: str) -> str:
    """SQL expression: canonical absolute URL of ``href`` on page ``base``; NULL when rejected."""
    return _let(_base_stages(), {"base": base}, lambda names: _canonical_href(names, href), "b")


def canonical_urls_sql(hrefs: str, base: str) -> str:
    """SQL expression: array of canonical URLs of an array of hrefs; the base is parsed once per row."""

    def per_href(names: dict[str, str]) -> str:
        return f"array_distinct(array_compact(transform({hrefs}, h -> {_canonical_href(names, 'h')})))"

    return _let(_base_stages(), {"base": base}, per_href, "b", of="ARRAY<STRING>")


def canonical_url(href: str, base: str) -> Column:
    return F.expr(canonical_url_sql(href, base))


def canonical_urls(hrefs: str, base: str) -> Column:
    return F.expr(canonical_urls_sql(hrefs, base))


def canonical_self(url: str) -> Column:
    """Canonical form of an absolute URL."""
    return F.expr(f"IF({url} RLIKE {_CLEAN_ABSOLUTE}, {url}, {canonical_url_sql(url, url)})")


def with_canonical_url(df: DataFrame, href: str, base: str, out: str) -> DataFrame:
    """Add ``out``, the canonical URL of each row's reference; the same values as ``canonical_url``.

    Every stage is a projection, so whole-stage code generation covers the rule.
    For columns of a table this is several times as fast as the expression,
    whose lambdas are interpreted; use that inside arrays and SQL functions.
    """
    rows, names = df, {"base": f"`{base}`", "href": f"`{href}`"}

    def bound(sql: str) -> str:
        return re.sub(r"@([a-z]\w*)", lambda m: names[m.group(1)], sql)

    for stage in [*_base_stages(), *_reference_stages()]:
        rows = rows.withColumns({f"_url_{name}": F.expr(bound(sql)) for name, sql in stage.items()})
        names.update({name: f"`_url_{name}`" for name in stage})
    clean = f"{names['b_ok']} AND {names['href']} RLIKE {_CLEAN_ABSOLUTE}"
    whole = f"CASE WHEN {clean} THEN {names['href']} ELSE {bound(_canonical_body())} END"
    return rows.select(*df.columns, F.expr(whole).alias(out))


def resolved_path(href: str, base: str) -> Column:
    """Path that a reference resolves to on a base URL, dot segments removed; NULL if unparsable."""
    return F.expr(
        _let(_base_stages() + _reference_stages(), {"href": href, "base": base},
             "CASE WHEN @b_ok AND @r_ok THEN @path END", "u")
    )


def normalized_host(url: str) -> Column:
    """Host with port in canonical form: lower case, default port of the scheme dropped."""
    return F.expr(
        _let(_parse_stages("@url", "p_"), {"url": url},
             f"CASE WHEN @p_ok THEN {_host_form('@p_scheme', '@p_host')} END", "u")
    )


def parsable(url: str) -> Column:
    """Whether the text in a column is a well-formed URL."""
    stages, names = _parse_stages(f"`{url}`", "u_"), {}
    return F.expr(_let(stages, names, "@u_ok", "q", "BOOLEAN"))


def url_hostname(url: Column) -> Column:
    """Host of a URL without port, user-info or IPv6 brackets; case kept; '' if there is none."""
    host = F.regexp_extract(
        url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)", 1
    )
    return F.regexp_replace(host, r"^\[|\]$", "")


def url_path(url: Column) -> Column:
    """Path of an absolute URL with its escapes decoded, '' if there is none."""
    raw = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return decoded(raw)


def decoded(text: Column) -> Column:
    """Percent-decoded text; text with malformed escapes stays as it is."""
    plain = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(text, F.lit("%")), F.coalesce(plain, text)).otherwise(text)


def url_domain_text(url: Column) -> Column:
    """Domain cut from URL text: after the first ``://``, before ``/ ? #``, before the last colon."""
    rest = F.regexp_replace(url, r"^(?s:.*?)://", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.regexp_replace(authority, r":[^:]*$", "")


def register_sql_functions(spark: SparkSession) -> None:
    """Make ``canonicalize_url(href, base)`` callable from SQL and through ``F.call_function``."""
    body = canonical_url_sql("href", "base")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION canonicalize_url(href STRING, base STRING) "
        f"RETURNS STRING RETURN {body}"
    )
