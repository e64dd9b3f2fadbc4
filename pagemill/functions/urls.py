"""URL splitting, joining and validation, all in the JVM. Arguments are SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.hosts import is_ipv6_sql
from pagemill.functions.text import bind_sql, literal, pattern, strip_sql
from pagemill.schemas import MAX_URL_LENGTH

# scheme, netloc, path, params (of the last segment), query, fragment. Line breaks are
# removed first, so one can stand between the parts.
_PARTS = pattern(
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?"
    r"((?:[^?#]*/)?[^?#/;]*)(?:;([^?#/]*))?(?:\?([^#]*))?(?:#(.*))?\z"
)
_LEADING = literal("".join(map(chr, range(0x21))))

# Characters that compatibility normalisation turns into one of / ? # @ :
_LOOKALIKES = pattern(
    r"[\u2047\u2048\u2049\u2100\u2101\u2105\u2106\u2a74\ufe13\ufe16\ufe55\ufe56"
    r"\ufe5f\ufe6b\uff03\uff0f\uff1a\uff1f\uff20]"
)

# Absolute or root-relative references that a join leaves as they are: nothing to drop
# (an empty query, fragment or parameter) and nothing to resolve.
_TAIL = r"[^\x00-\x20;?#\x7f]*(?:\?[^\x00-\x20#\x7f]+)?(?:#[^\x00-\x20\x7f]+)?\z"
_PLAIN_ABSOLUTE = pattern(r"\Ahttps?://[A-Za-z0-9._:\-]+(?=[/?#]|\z)" + _TAIL)
_PLAIN_ROOTED = pattern(r"\A/(?!/)" + _TAIL)
_PLAIN_RELATIVE = pattern(
    r"\A[A-Za-z0-9_~%!$&()*+,=@-][^\x00-\x20:;?#\x7f]*(?:\?[^\x00-\x20#\x7f]+)?(?:#[^\x00-\x20\x7f]+)?\z"
)
_PLAIN_FRAGMENT = pattern(r"\A#[^\x00-\x20\x7f]+\z")
_PLAIN_BASE = pattern(r"\Ahttps?://[A-Za-z0-9._:\-]+(?:[/?#]|\z)")
_DOT_SEGMENT = pattern(r"(?:^|/)\.{1,2}(?:/|\z)")
_DOT_LAST = pattern(r"(?:^|/)\.{1,2}\z")


def _clean_sql(url: str) -> str:
    return f"translate(trim(LEADING {_LEADING} FROM {url}), '\\t\\r\\n', '')"


def url_parts_sql(url: str) -> str:
    """``array(scheme, netloc, path, params, query, fragment)``; absent parts are ``''``."""
    return f"split(regexp_replace({_clean_sql(url)}, {_PARTS}, '$1\\n$2\\n$3\\n$4\\n$5\\n$6'), '\\n')"


def _bad_netloc_sql(netloc: str) -> str:
    inner = f"regexp_extract({netloc}, {pattern(r'\[([^\]]*)')}, 1)"
    bad_inner = f"NOT rlike(host_in, {pattern(r'\Av[0-9a-fA-F]+\..+\z')}) AND NOT {is_ipv6_sql('host_in')}"
    return (
        f"CASE WHEN rlike({netloc}, {pattern(r'\A[A-Za-z0-9._:@\-]*\z')}) THEN false "
        f"WHEN contains({netloc}, '[') <> contains({netloc}, ']') THEN true "
        f"WHEN contains({netloc}, '[') AND {bind_sql(inner, 'host_in', bad_inner)} THEN true "
        f"ELSE rlike({netloc}, {_LOOKALIKES}) END"
    )


def _unsplit_sql(scheme: str, netloc: str, path: str, params: str, query: str, fragment: str) -> str:
    lead = (
        f"CASE WHEN j_path = '' OR startswith(j_path, '/') THEN concat('://', {netloc}) "
        f"WHEN {netloc} <> '' THEN concat('://', {netloc}, '/') ELSE ':' END"
    )
    whole = (
        f"concat({scheme}, {lead}, j_path, "
        f"CASE WHEN {query} <> '' THEN concat('?', {query}) ELSE '' END, "
        f"CASE WHEN {fragment} <> '' THEN concat('#', {fragment}) ELSE '' END)"
    )
    with_params = bind_sql(params, "j_params", f"CASE WHEN j_params <> '' THEN concat({path}, ';', j_params) ELSE {path} END")
    return bind_sql(with_params, "j_path", whole)


def _merged_path_sql(base_path: str, path: str) -> str:
    """*path* taken relative to *base_path*, dot segments resolved."""
    folder = f"CASE WHEN {base_path} = '' THEN '/' ELSE regexp_replace({base_path}, {pattern(r'(?s)[^/]+\z')}, '') END"
    joined = (
        f"CASE WHEN startswith({path}, '/') THEN {path} "
        f"ELSE regexp_replace(concat({folder}, {path}), '//+', '/') END"
    )
    kept = (
        "aggregate(split(m_full, '/', -1), cast(array() AS array<string>), (done, seg) -> "
        "CASE WHEN seg = '..' THEN slice(done, 1, greatest(size(done) - 1, 0)) "
        "WHEN seg = '.' THEN done ELSE array_append(done, seg) END)"
    )
    last = f"CASE WHEN rlike(m_full, {_DOT_LAST}) THEN array('') ELSE cast(array() AS array<string>) END"
    resolved = f"CASE WHEN rlike(m_full, {_DOT_SEGMENT}) THEN array_join(concat({kept}, {last}), '/') ELSE m_full END"
    return f"coalesce(nullif({bind_sql(joined, 'm_full', resolved)}, ''), '/')"


def _checked_parts_sql(url: str) -> str:
    """``url_parts``, NULL when the host part is malformed."""
    return bind_sql(url_parts_sql(url), "c_parts", f"CASE WHEN NOT {_bad_netloc_sql('c_parts[1]')} THEN c_parts END")


def _join_parts_sql(base: str, base_parts: str, ref: str, own: str) -> str:
    """The join proper, on both URLs' checked parts."""
    scheme, own_scheme = f"lower({base_parts}[0])", f"lower({own}[0])"
    absolute, same_page = f"{own}[1] <> ''", f"({own}[2] = '' AND {own}[3] = '')"
    kept_query = f"({absolute} OR NOT {same_page} OR {own}[4] <> '')"
    joined = _unsplit_sql(
        scheme,
        f"(CASE WHEN {absolute} THEN {own}[1] ELSE {base_parts}[1] END)",
        f"(CASE WHEN {absolute} THEN {own}[2] WHEN {same_page} THEN {base_parts}[2] "
        f"ELSE {_merged_path_sql(f'{base_parts}[2]', f'{own}[2]')} END)",
        f"CASE WHEN NOT {absolute} AND {same_page} THEN {base_parts}[3] ELSE {own}[3] END",
        f"(CASE WHEN {kept_query} THEN {own}[4] ELSE {base_parts}[4] END)",
        f"{own}[5]",
    )
    return (
        f"CASE WHEN {own} IS NULL OR {base_parts} IS NULL THEN cast(NULL AS string) "
        f"WHEN {ref} = '' THEN {base} WHEN {base} = '' THEN {ref} "
        f"WHEN {own_scheme} <> '' AND {own_scheme} <> {scheme} THEN {ref} ELSE {joined} END"
    )


# Behind a base's parts, for the common forms of references: the address of its folder, of the
# folder above, and of the page without fragment; each '' when it needs more than appending.
_FOLDER, _ABOVE, _PAGE = 6, 7, 8


def base_parts_sql(base: str) -> str:
    """What ``resolve_url_sql`` needs of a base, to be computed once per page."""
    folder = f"coalesce(nullif(regexp_replace(p_base[2], {pattern(r'[^/]+\z')}, ''), ''), '/')"
    above = f"regexp_replace(p_folder, {pattern(r'[^/]+/\z')}, '')"
    usable = f"rlike({base}, {_PLAIN_BASE}) AND NOT contains(p_folder, '//') AND NOT contains(p_folder, '/.')"
    origin = "lower(p_base[0]), '://', p_base[1]"
    page = f"regexp_extract({base}, '^[^#]*', 0)"
    quick = bind_sql(
        folder,
        "p_folder",
        f"CASE WHEN {usable} THEN array(concat({origin}, p_folder), concat({origin}, {above}), "
        f"CASE WHEN contains({base}, ';') OR rlike({base}, {pattern(r'[?](?:#|\z)|[\x00-\x20]')}) THEN '' ELSE {page} END) "
        "ELSE array('', '', '') END",
    )
    return bind_sql(_checked_parts_sql(base), "p_base", f"concat(p_base, {quick})")


def join_url_sql(base: str, ref: str, base_parts: str | None = None) -> str:
    if base_parts is None:
        return bind_sql(base_parts_sql(base), "b_parts", join_url_sql(base, ref, "b_parts"))
    slow = bind_sql(_checked_parts_sql(ref), "r_parts", _join_parts_sql(base, base_parts, ref, "r_parts"))
    undotted = f"NOT contains({ref}, '//') AND NOT contains(substring({ref}, 3), '/.')"
    quick = (
        f"CASE WHEN coalesce({base_parts}[{_FOLDER}], '') = '' THEN cast(NULL AS string) "
        f"WHEN rlike({ref}, {_PLAIN_ABSOLUTE}) THEN {ref} "
        f"WHEN rlike({ref}, {_PLAIN_ROOTED}) AND NOT contains({ref}, '/.') "
        f"THEN concat(lower({base_parts}[0]), '://', {base_parts}[1], {ref}) "
        f"WHEN rlike({ref}, {_PLAIN_FRAGMENT}) AND {base_parts}[{_PAGE}] <> '' THEN concat({base_parts}[{_PAGE}], {ref}) "
        f"WHEN rlike({ref}, {_PLAIN_RELATIVE}) AND {undotted} AND NOT startswith(substring({ref}, 2), '/.') "
        f"THEN concat({base_parts}[{_FOLDER}], {ref}) "
        f"WHEN startswith({ref}, '../') AND rlike(substring({ref}, 4), {_PLAIN_RELATIVE}) AND {undotted} "
        f"THEN concat({base_parts}[{_ABOVE}], substring({ref}, 4)) END"
    )
    return f"coalesce({quick}, {slow})"


def url_scheme_sql(url: str) -> str:
    return f"lower(regexp_extract({_clean_sql(url)}, {pattern(r'^([A-Za-z][A-Za-z0-9+.\-]*):')}, 1))"


def url_netloc_sql(url: str) -> str:
    return f"regexp_extract({_clean_sql(url)}, {pattern(r'^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)')}, 1)"


def resolve_url_sql(href: str, base: str, base_parts: str | None = None) -> str:
    """Pass ``base_parts`` (``base_parts_sql`` of the base, computed before) to split a page's base once."""
    joined = bind_sql(strip_sql(href), "r_ref", join_url_sql(base, "r_ref", base_parts))
    web_only = f"CASE WHEN {url_scheme_sql('r_url')} IN ('http', 'https') THEN r_url END"
    return (
        f"CASE WHEN {href} <> '' AND NOT startswith({href}, 'javascript:') "
        f"AND NOT startswith({href}, 'mailto:') AND NOT startswith({href}, 'tel:') "
        f"THEN {bind_sql(joined, 'r_url', web_only)} END"
    )


def url_parts(url: str) -> Column:
    return F.expr(url_parts_sql(url))


def join_url(base: str, ref: str) -> Column:
    """RFC 3986 join of *ref* onto an http(s) *base*; NULL where either cannot be parsed."""
    return F.expr(join_url_sql(base, ref))


def resolve_url(href: str, base: str) -> Column:
    """*href* made absolute; NULL when empty, not http(s), or not a URL."""
    return F.expr(resolve_url_sql(href, base))


def absolute_redirect(location: str, url: str) -> Column:
    """A ``Location`` value made absolute, whatever its scheme."""
    return join_url(url, location)


def url_scheme(url: str) -> Column:
    """Lower-cased scheme, ``''`` when there is none."""
    return F.expr(url_scheme_sql(url))


def url_netloc(url: str) -> Column:
    """``user:password@host:port`` as written, ``''`` when there is none."""
    return F.expr(url_netloc_sql(url))


def url_host_sql(url: str) -> str:
    after_user = f"regexp_replace({url_netloc_sql(url)}, {pattern(r'(?s)^.*@')}, '')"
    host = pattern(r"^(?:\[([^\]]*)|[^:]*)")
    plain = f"regexp_extract(h_host, {host}, 0)"
    return bind_sql(
        after_user,
        "h_host",
        f"lower(CASE WHEN startswith(h_host, '[') THEN regexp_extract(h_host, {host}, 1) ELSE {plain} END)",
    )


def url_host(url: str) -> Column:
    """Lower-cased host without user, port or brackets; ``''`` when there is none."""
    return F.expr(url_host_sql(url))


def url_site_sql(url: str) -> str:
    return f"concat({url_scheme_sql(url)}, '://', {url_netloc_sql(url)})"


def url_site(url: str) -> Column:
    """``scheme://netloc``, the unit robots rules and request spacing apply to."""
    return F.expr(url_site_sql(url))


def robots_url(url: str) -> Column:
    return F.expr(f"concat({url_site_sql(url)}, '/robots.txt')")


def validate_url(url: str, need_host: bool = True) -> Column:
    """``struct(valid, error_code, error_message)``, rules tested in that order."""
    scheme, netloc = url_scheme_sql(url), url_netloc_sql(url)
    too_long = literal(f"URL exceeds the maximum allowed length of {MAX_URL_LENGTH} characters.")
    missing_host = f"WHEN {netloc} = '' THEN 'URL is missing a host.' " if need_host else ""
    message = (
        f"CASE WHEN length({url}) > {MAX_URL_LENGTH} THEN {too_long} "
        f"WHEN {bind_sql(netloc, 'v_netloc', _bad_netloc_sql('v_netloc'))} THEN 'URL could not be parsed.' "
        f"WHEN {scheme} NOT IN ('http', 'https') THEN concat({literal("URL scheme '")}, "
        f"coalesce(nullif({scheme}, ''), '(none)'), "
        f"{literal("' is not allowed. Only http and https are supported.")}) "
        f"{missing_host}ELSE '' END"
    )
    result = (
        "named_struct('valid', v_message = '', "
        "'error_code', CASE WHEN v_message = '' THEN '' ELSE 'INVALID_URL' END, 'error_message', v_message)"
    )
    return F.expr(bind_sql(message, "v_message", result))


def validate_batch_url(url: str) -> Column:
    """Why a URL of a batch is refused, NULL when it is fine (the host is not looked at)."""
    return F.expr(
        f"CASE WHEN length({url}) > {MAX_URL_LENGTH} THEN concat('URL exceeds maximum length: ', substring({url}, 1, 80)) "
        f"WHEN {url_scheme_sql(url)} NOT IN ('http', 'https') "
        f"THEN concat('Invalid URL scheme in: ', substring({url}, 1, 80)) END"
    )


def looks_like_url(url: str) -> Column:
    """The quick form check: lower-case http(s) prefix, something after it, not too long."""
    form = pattern(r"^https?://[^\n\r\u2028\u2029]")
    return F.expr(f"rlike({url}, {form}) AND length({url}) <= {MAX_URL_LENGTH}")


def is_safe_scheme(url: str) -> Column:
    """http(s) prefix in any case."""
    return F.expr(f"rlike({url}, '(?i)^https?://')")
