"""URL parts, link resolution and file names.

URLs are split by regular expression: ``parse_url`` rejects what real pages contain (a blank in a
path, for example). The groups are those of RFC 3986, appendix B, with a scheme that has to start
with a letter. In the SQL text below, ``p`` and the like are structs made by ``_parts``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ribeira.fixed import BLOCKED_HOSTS, DATA_EXTENSIONS, OUTPUT_FORMATS
from ribeira.functions.sql import evaluate, let, text, texts

URL_PATTERN = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# Links that resolve without being taken apart: nothing empty in them that would be dropped, no
# control characters, and (with a separate test for "/.") no dot segments.
ABSOLUTE_LINK = r"^https?://[^\x00-\x1f?#;]+(?:\?[^\x00-\x1f#]+)?\z"
ROOTED_LINK = r"^/[^\x00-\x1f/.?#;][^\x00-\x1f?#;]*(?:\?[^\x00-\x1f#]+)?\z"
HREF_PATTERN = r"""(?i)href=["']([^"']+)["']"""

# Schemes in which a relative reference or a host can occur (RFC 3986 usage of
# Python's urllib.parse), and those whose last path segment can end in ";parameters".
RELATIVE_SCHEMES = [
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
]
PARAMETER_SCHEMES = [
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip", "sips",
    "mms", "sftp", "tel",
]


def _parts(url: str, outer_scheme: str = "''") -> str:
    """STRUCT<scheme, authority, path, params, query, fragment>; a missing part is ''.

    ``params`` is the ``;…`` tail of the last path segment, with its semicolon, for schemes that have
    one; a URL without a scheme takes ``outer_scheme`` in that. Leading blanks and
    control characters, tabs and line ends anywhere are not part of a URL, so that a line end can
    separate the groups: one regular-expression pass yields all of them.
    """
    junk = text(r"^[\x00-\x20]+|[\t\r\n]")
    clean = f"if(rlike({url}, {text(r'[\x00-\x20]')}), regexp_replace({url}, {junk}, ''), {url})"
    groups = f"split(regexp_replace({clean}, {text(URL_PATTERN)}, {text('$1\n$2\n$3\n$4\n$5')}), '\\n')"
    scheme = f"coalesce(nullif(lower(get(g, 0)), ''), {outer_scheme})"
    tailed = f"contains(get(g, 2), ';') AND {scheme} IN ({texts(PARAMETER_SCHEMES)})"
    return let(
        "g",
        groups,
        "named_struct('scheme', lower(get(g, 0)), 'authority', get(g, 1), "
        f"'path', if({tailed}, regexp_replace(get(g, 2), ';[^/]*$', ''), get(g, 2)), "
        f"'params', if({tailed}, nullif(regexp_extract(get(g, 2), ';[^/]*$', 0), ';'), ''), "
        "'query', get(g, 3), 'fragment', get(g, 4))",
    )


def _host(p: str) -> str:
    bracketed = f"regexp_extract(place, {text(r'^\[([^\]]*)')}, 1)"
    return let(
        "place",
        f"regexp_replace({p}.authority, '^.*@', '')",
        f"lower(if(startswith(place, '['), {bracketed}, substring_index(place, ':', 1)))",
    )


def ends_in_data_extension(lowered: str) -> str:
    """SQL test whether a lower-case text ends in one of the accepted data-file extensions."""
    return "(" + " OR ".join(f"endswith({lowered}, {text(extension)})" for extension in DATA_EXTENSIONS) + ")"


def _output_format(query: str) -> str:
    """What ``url_output_format`` says, from the query string.

    A ``%`` that starts no escape stays as it is. Few queries have the parameter, and the others stop
    at the first test; only pairs that can be the parameter are decoded.
    """

    def decoded(group: int) -> str:
        part = f"regexp_extract(pair, '(?s)^([^=]*)=(.+)$', {group})"
        return f"try_url_decode(regexp_replace({part}, '%(?![0-9A-Fa-f]{{2}})', '%25'))"

    possible = f"filter(split({query}, '&'), pair -> rlike(pair, '(?i)^(?:outputformat|[^=]*%[^=]*)=.'))"
    pairs = (
        f"filter(transform({possible}, pair -> named_struct('name', {decoded(1)}, 'value', {decoded(2)})), "
        "pair -> lower(pair.name) = 'outputformat' AND pair.value <> '')"
    )
    last_spelling = "element_at(array_distinct(transform(found, pair -> pair.name)), -1)"
    value = f"get(filter(found, pair -> pair.name = {last_spelling}), 0).value"
    formats = " ".join(f"WHEN contains(asked, {text(needle)}) THEN {text(ext)}" for needle, ext in OUTPUT_FORMATS)
    chosen = let("found", pairs, f"if(size(found) > 0, {let('asked', f'lower({value})', f'CASE {formats} END')}, NULL)")
    return f"if(rlike({query}, '(?i)outputformat|%'), {chosen}, NULL)"


def _promises_data(p: str) -> str:
    ends = let("ending", f"lower({p}.path)", ends_in_data_extension("ending"))
    return f"({ends} OR {_output_format(p + '.query')} IS NOT NULL)"


def _name(path: str) -> str:
    segments = f"filter(split({path}, '/'), part -> part NOT IN ('', '.'))"
    return let("s", segments, "coalesce(get(s, size(s) - 1), '')")


def url_path(url: Column) -> Column:
    """The path without the ``;parameters`` of its last segment."""
    return evaluate(let("p", _parts("arg.url"), "p.path"), url=url)


def url_host(url: Column) -> Column:
    """Lower-case host without user and port."""
    return evaluate(let("p", _parts("arg.url"), _host("p")), url=url)


def url_output_format(url: Column) -> Column:
    """File extension promised by the ``outputFormat`` parameter, or null.

    Names are compared without case and blank values do not count. Where one query spells the name
    in several ways, the spelling that appears last is taken, and of that its first value.
    """
    return evaluate(let("p", _parts("arg.url"), _output_format("p.query")), url=url)


def url_promises_data(url: Column) -> Column:
    """The path ends in an accepted extension, or the query asks for a known format."""
    return evaluate(let("p", _parts("arg.url"), _promises_data("p")), url=url)


def url_candidate(url: Column) -> Column:
    """Whether a link is worth fetching: no fragment, no blocked host, and it promises data."""
    wanted = f"p.fragment = '' AND {_host('p')} NOT IN ({texts(BLOCKED_HOSTS)}) AND {_promises_data('p')}"
    return evaluate(f"coalesce({let('p', _parts('arg.url'), wanted)}, false)", url=url)


def path_name(path: Column) -> Column:
    """Last segment of a path; empty and ``.`` segments do not count."""
    return evaluate(_name("arg.path"), path=path)


def link_names(urls: Column) -> Column:
    """File names of an array of URLs; no array, no names."""
    each = let("p", _parts("u"), _name("p.path"))
    return evaluate(f"transform(coalesce(arg.urls, array()), u -> {each})", urls=urls)


def file_suffix(path: Column) -> Column:
    """Lower-case extension of a path's last segment, with its dot; '' if there is none."""
    suffix = text(r"(?s)^.+(\.[^.]+)$")
    return evaluate(f"lower(regexp_extract({_name('arg.path')}, {suffix}, 1))", path=path)


def safe_filename(url: Column, fallback: Column, limit: int | None = None) -> Column:
    """A portable file name for what a URL delivers.

    Names over ``limit`` characters, if one is set, lose the end of their stem to a digest of the URL; the extension stays.
    """
    choices = f"named_struct('name', {_name('p.path')}, 'promised', {_output_format('p.query')})"
    promised = f"c.promised IS NOT NULL AND NOT {ends_in_data_extension('lower(c.name)')}"
    chosen = (
        f"CASE WHEN {promised} THEN concat(arg.fallback, c.promised) WHEN c.name = '' THEN arg.fallback ELSE c.name END"
    )
    cleaned = f"regexp_replace({chosen}, '[^A-Za-z0-9._-]+', '_')"
    name = evaluate(let("p", _parts("arg.url"), let("c", choices, cleaned)), url=url, fallback=fallback)
    if limit is None:
        return name
    ending = F.concat(F.lit("-"), F.substring(F.sha2(url, 256), 1, 8), F.regexp_extract(name, r"(\.[A-Za-z0-9]{1,10})?$", 0))
    return F.when(F.length(name) > limit, F.concat(F.substring(name, F.lit(1), F.lit(limit) - F.length(ending)), ending)).otherwise(name)


def _merged_path(base_path: str, path: str) -> str:
    """A reference's path on top of the base's folder, dots resolved; '/' if nothing is left.

    Empty segments vanish when two paths are merged, but stay in a rooted path.
    """
    folder = f"regexp_replace({base_path}, '[^/]*$', '')"
    merged = f"if(startswith({path}, '/'), {path}, regexp_replace(concat({folder}, {path}), '/{{2,}}', '/'))"
    step = "CASE part WHEN '.' THEN done WHEN '..' THEN slice(done, 1, greatest(size(done) - 1, 0)) ELSE array_append(done, part) END"
    kept = f"aggregate(split(m, '/'), CAST(array() AS ARRAY<STRING>), (done, part) -> {step})"
    closing = f"if(rlike(m, {text(r'(?:^|/)\.\.?$')}) AND size(kept) > 0, '/', '')"
    undotted = let("kept", kept, f"concat(array_join(kept, '/'), {closing})")
    final = f"if(rlike(m, {text(r'(?:^|/)\.\.?(?:/|$)')}), {undotted}, m)"
    return let("m", merged, f"coalesce(nullif({final}, ''), '/')")


def _resolve(b: str, href: str) -> str:
    """The link ``href`` on a page whose URL has the parts ``b``; neither text is empty.

    The two common kinds of links are told by one test each: absolute ones stay as they are, and
    plain rooted paths only need the site in front. The rest is taken apart.
    """

    def choice(authority: str, path: str, params: str, query: str) -> str:
        return f"named_struct('authority', {authority}, 'path', {path}, 'params', {params}, 'query', {query})"

    same_page = choice(f"{b}.authority", f"{b}.path", f"{b}.params", f"if(h.query = '', {b}.query, h.query)")
    target = (
        f"CASE WHEN h.authority <> '' THEN {choice('h.authority', 'h.path', 'h.params', 'h.query')} "
        f"WHEN h.path = '' AND coalesce(h.params, '') = '' THEN {same_page} "
        f"ELSE {choice(f'{b}.authority', _merged_path(f'{b}.path', 'h.path'), 'h.params', 'h.query')} END"
    )
    rooted = "(t.path = '' OR startswith(t.path, '/'))"
    built = (
        f"concat(if({b}.scheme = '', '', concat({b}.scheme, ':')), "
        f"CASE WHEN t.authority <> '' THEN concat('//', t.authority, if({rooted}, '', '/')) "
        f"WHEN {b}.scheme <> '' AND {rooted} THEN '//' ELSE '' END, t.path, coalesce(t.params, ''), "
        "if(t.query = '', '', concat('?', t.query)), if(h.fragment = '', '', concat('#', h.fragment)))"
    )
    foreign = f"(h.scheme <> '' AND h.scheme <> {b}.scheme) OR {b}.scheme NOT IN ({texts(RELATIVE_SCHEMES)})"
    taken_apart = let("h", _parts(href, f"{b}.scheme"), f"if({foreign}, {href}, {let('t', target, built)})")
    on_site = f"{b}.scheme IN ('http', 'https') AND {b}.authority <> '' AND rlike({href}, {text(ROOTED_LINK)})"
    return (
        f"CASE WHEN rlike({href}, {text(ABSOLUTE_LINK)}) THEN {href} "
        f"WHEN {on_site} AND NOT contains({href}, '/.') THEN concat({b}.scheme, '://', {b}.authority, {href}) "
        f"ELSE {taken_apart} END"
    )


def resolve_link(base: Column, href: Column) -> Column:
    """The absolute URL of a link on a page, as a browser or ``urljoin`` would build it."""
    joined = let("b", _parts("arg.base"), _resolve("b", "arg.href"))
    return evaluate(
        f"CASE WHEN coalesce(arg.base, '') = '' THEN arg.href WHEN coalesce(arg.href, '') = '' THEN arg.base ELSE {joined} END",
        base=base,
        href=href,
    )


def page_links(html: Column, base: Column) -> Column:
    """Distinct absolute links of one page, sorted, as an array. The base is split once per page."""
    hrefs = f"array_distinct(regexp_extract_all(arg.html, {text(HREF_PATTERN)}, 1))"
    links = let("b", _parts("arg.base"), f"transform({hrefs}, href -> {_resolve('b', 'href')})")
    return evaluate(
        f"array_sort(array_distinct(if(coalesce(arg.base, '') = '', {hrefs}, {links})))", html=html, base=base
    )
