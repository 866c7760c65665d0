"""The same results in SQL, worked out from keys and not from the HTML.

For the shop pages the expected links are arithmetic on the part key. For the
pages table a plain pattern finds the anchors it consists of.
"""

from __future__ import annotations

from linkloom import fixed
from linkloom.operators.rules import PAGE_TEXT
from linkloom.plans import catalog
from linkloom.plans import corpora as P

# The labels in front as the group they are, which DuckDB's engine repeats without recursion.
_ORIGIN_PATTERN = fixed.ORIGIN_PATTERN.replace(
    r"(?:(?=[0-9a-z_-])(?:(?!\.\.)[0-9a-z_.-])*(?<=\.))?", r"(?:xn--[0-9a-z]+|[0-9a-z_-]+\.)*"
)


def pick(key: str, *choices: str) -> str:
    n = len(choices)
    whens = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices))
    return f"CASE (({key}) % {n} + {n}) % {n} {whens} END"


def quoted(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else "'" + value.replace("'", "''") + "'"


def shop_origin(key: str) -> str:
    return f"('https://' || {pick(key, *[quoted(h) for h in P.SHOP_HOSTS])})"


def shop_url(key: str) -> str:
    return f"({shop_origin(key)} || '/p/' || ({key}))"


SHOP = f"shop AS (SELECT p_partkey AS k, {shop_origin('p_partkey')} AS o, {shop_url('p_partkey')} AS w FROM part)"

NEXT, BACK, CROSS = shop_url("k + 4"), shop_url("k - 4"), shop_url("k * 2")
API = "('https://api.example.com/v/' || k || '?a=1&b=2')"
FTP = "('ftp://files.example.org/' || k)"
# a URL in nested elements: as the innermost has it, the one around that, and the outer ones
NESTED = ["('http://n.example.com/' || k)", "('http://n.example.com/' || k || '-2')", "('http://n.example.com/' || k || '-2-3')"]


def _root(before: str, after: str = "") -> tuple[str, str]:
    """(raw, absolute) of a link that begins with a slash."""
    raw = f"('{before}' || k || '{after}')"
    return raw, f"(o || {raw})"


def _whole(expr: str) -> tuple[str, str]:
    return expr, expr


_LIB = _whole("('https://lib.example.com/' || k || '.js')")
_BUTTON = _whole("('https://b.example.com/' || k)")
_SOCKET = _whole("('wss://ws.example.com/' || k)")
_DATA_URI = _whole("('data:image/gif;base64,AA' || k)")
_IFRAME = ("('//frames.example.net/' || k)", "('https://frames.example.net/' || k)")
_SITEMAP = ("('sub/' || k || '.xml')", "(o || '/p/sub/' || k || '.xml')")
_SELF = ("''", "w")
_CSS, _JS, _FORM = _root("/s/", ".css"), _root("/js/", ".js"), _root("/post/")
_WEBP, _VIDEO, _AUDIO, _TRACK = _root("/i/", ".webp"), _root("/v/", ".mp4"), _root("/a/", ".mp3"), _root("/t/", ".vtt")
_EMBED, _BGSOUND, _FRAME, _FRAMESET = _root("/e/"), _root("/bgs/", ), _root("/fr/"), _root("/fs/")
_MANIFEST, _FEED, _AREA = _root("/m/", ".json"), _root("/f/", ".rss"), _root("/ar/")
_OG, _TW = _root("/og/", ".png"), _root("/tw/", ".png")

_ANCHORS = [
    _whole(NEXT), _whole(BACK), _whole(CROSS), _SITEMAP,
    ("('../up/' || k)", "(o || '/up/' || k)"), _root("/bare/"), _root("/q?x=1&y="),
]
_SCRIPTS = [_JS, _SOCKET, _LIB]
_OTHER_SRC = [_WEBP, _DATA_URI, _IFRAME, _VIDEO, _AUDIO, _EMBED, _TRACK, _BGSOUND, _FRAME, _FRAMESET]
_BASE = _whole("CASE WHEN k % 10 = 0 THEN w END")
_ALL_HREF = _ANCHORS + [_CSS, _MANIFEST, _FEED, _BUTTON, _AREA, _BASE]

# label -> links of one shop page, as (raw, absolute)
CORE = {
    "href": _ANCHORS + [_SELF],
    "script": _SCRIPTS,
    "form": [_FORM],
    "jscode": [_whole(API)],
    "css": [_CSS],
    "embedded": _SCRIPTS + _OTHER_SRC,
    "interactive": [_whole(NEXT), _whole(BACK), _whole(CROSS), _BUTTON],
    PAGE_TEXT: [_whole(API), _whole(FTP), _whole(NESTED[0]), _whole(NESTED[2])],
}
FULL = {
    **CORE,
    "href": _ALL_HREF + [_SELF],
    "src": _SCRIPTS + _OTHER_SRC,
    "meta": [("('w' || k)", "(o || '/p/w' || k)"), _OG, _TW],
    "video": [_VIDEO], "audio": [_AUDIO], "embed": [_EMBED], "track": [_TRACK], "area": [_AREA],
    "applet": [_root("/ap/", ".jar")], "base": [_BASE], "bgsound": [_BGSOUND],
    "body-background": [_root("/bg/", ".gif")], "feed": [_FEED], "webp-image": [_WEBP],
    "manifest": [_MANIFEST], "social-media-og:image": [_OG], "social-media-twitter:image": [_TW],
    "sitemap": [_SITEMAP], "data-uri": [_DATA_URI], "websocket": [_SOCKET], "frame": [_FRAME, _FRAMESET],
}
OPTIONAL = {
    "data": [_root("/d/"), _root("/dc/"), _root("/dn/"), _root("/dcn/")], "custom-data": [_root("/dc/"), _root("/dcn/")]
}
EXCLUSIVE = {
    "href": _ANCHORS, "script": _SCRIPTS, "form": [_FORM], "css": [_CSS], "webp-image": [_WEBP],
    "manifest": [_MANIFEST], "social-media-og:image": [_OG], "social-media-twitter:image": [_TW],
    "frame": [_FRAME], "embedded": [s for s in _OTHER_SRC if s not in (_WEBP, _FRAME)],
    "jscode": [_whole(API)], PAGE_TEXT: CORE[PAGE_TEXT],
}
GROUPED = {
    **{label: links for label, links in FULL.items() if label != "manifest"},
    "script": _SCRIPTS + _OTHER_SRC + [_SELF],
    "form": [_FORM, _SELF],
    "css": _ANCHORS + [_CSS, _BUTTON, _SELF],
}

# Anchors of the pages table, all root-relative.
PAGE_ANCHORS = (
    "SELECT 'href' AS source, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || replace(h, '&amp;', '&') AS url, "
    "replace(h, '&amp;', '&') AS raw, url AS where_url FROM (SELECT url, "
    "unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS h FROM pages)"
)

def links(labels: dict[str, list[tuple[str, str]]], page_labels: tuple[str, ...] = ("href",)) -> str:
    """CTEs that end in ``found(source, url, raw, where_url)``, repeats included."""
    parts = [
        f"SELECT '{label}' AS source, {url} AS url, {raw} AS raw, w AS where_url FROM shop"
        for label, pairs in labels.items()
        for raw, url in pairs
    ]
    for label in page_labels:
        if label in labels:
            parts.append(PAGE_ANCHORS.replace("'href' AS source", f"'{label}' AS source"))
    body = " UNION ALL ".join(parts)
    return f"WITH {SHOP}, found AS (SELECT * FROM ({body}) WHERE url IS NOT NULL)"


def distinct_links(labels, page_labels=("href",), where: str = "true") -> str:
    return f"{links(labels, page_labels)} SELECT DISTINCT source, url, where_url FROM found WHERE {where}"


LINE = "('[' || where_url || '] [' || source || '] ' || url)"
JSON = (
    "('{\"Source\":\"' || source || '\",\"URL\":\"' || replace(replace(replace(url, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e')"
    " || '\",\"Where\":\"' || replace(where_url, '&', '\\u0026') || '\"}')"
)


def _contains_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


SEED = pick(
    "o_orderkey",
    "'https://c' || o_custkey || '.example.com/'", "'c' || o_custkey || '.example.com'", "'mailto:c' || o_custkey",
    "''", "'http://u:p@h' || o_custkey || '.example.com:8080/a'", "'//x/' || o_custkey",
    "'https://[2001:db8::' || o_custkey || ']:8443/'",
)
SEEDS = f"seeds AS (SELECT {SEED} AS seed FROM orders)"
ABSOLUTE = "regexp_matches(seed, '^[A-Za-z][A-Za-z0-9+.-]*:')"


def host(url: str) -> str:
    return (
        f"CASE WHEN regexp_matches({url}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN "
        f"trim(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^:/?#]*)', 1), '[]') END"
    )


URLS = f"{SEEDS}, urls AS (SELECT url FROM pages UNION ALL SELECT seed FROM seeds)"
HOST = (
    "CASE c_custkey % 5 WHEN 0 THEN 'a' || c_custkey || '.b.example.com' WHEN 1 THEN 'x_y' || c_custkey || '.example.org' "
    "WHEN 2 THEN 'single' || c_custkey WHEN 3 THEN 'h' || c_custkey || '.example.coma' || (c_custkey - 3) || '.b.example.com' "
    "ELSE 'www.h' || c_custkey || '.co.uk' END"
)


def domain(host_sql: str) -> str:
    return (
        f"CASE WHEN len(string_split({host_sql}, '.')) >= 2 THEN string_split({host_sql}, '.')[-2] || '_' || "
        f"string_split({host_sql}, '.')[-1] END"
    )


DOCS = (
    "docs AS (SELECT doc_id, text || replace(' see https://u:p@d{d}.example.com:8080/p?x=1#f, ftp://f{d}.example.org "
    "''ws://[::1]:9/s'' HTTP://D{d}.EXAMPLE.COM' || chr(10) || 'url(\"/c/{d}.png\") url(''c{d}.gif'') url(bare) "
    "https://d{d}.example.com/p end', '{d}', doc_id::VARCHAR) AS text FROM documents)"
)


def text_urls(pattern: str, group: int = 0, distinct: str = "DISTINCT") -> str:
    return (
        f"WITH {DOCS} SELECT {distinct} doc_id, url FROM (SELECT doc_id, "
        f"unnest(regexp_extract_all(text, {quoted(pattern)}, {group})) AS url FROM docs)"
    )


HIST = (
    f"hist AS (SELECT 'crawler-' || (o_orderkey % 5) AS db_name, 'https://c' || o_custkey || '.example.com/' AS url, "
    f"min(o_orderdate::TIMESTAMP) AS ts FROM orders GROUP BY 1, 2), main AS (SELECT * FROM hist WHERE db_name = '{P.MAIN_HISTORY}')"
)
STATUS = (
    "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 100 WHEN event_type = 'view' THEN 200 "
    "WHEN event_type = 'purchase' THEN 302 WHEN event_type = 'signup' THEN 404 WHEN event_type = 'click' THEN 429 ELSE 503 END"
)
LOG = (
    "log AS (SELECT 'https://u' || (event_id // 8) || '.example.com/' AS url, event_id % 8 + 1 AS attempt, "
    f"{STATUS} AS status FROM events)"
)
TERMINAL = "coalesce(status BETWEEN 200 AND 399 OR status IN (400, 401, 403, 404), false)"
DECIDED = (
    f"decided AS (SELECT url, min(attempt) AS at FROM log WHERE attempt <= {fixed.DEFAULT_ATTEMPTS} AND {TERMINAL} GROUP BY url), "
    "tolerant AS (SELECT u.url, coalesce(l.status BETWEEN 200 AND 399, false) AS alive FROM (SELECT DISTINCT url FROM log) u "
    "LEFT JOIN decided d ON d.url = u.url LEFT JOIN log l ON l.url = d.url AND l.attempt = d.at)"
)

_SPEC = catalog.BLOOM
_M = catalog.D.BLOCK_BITS
_SLICES = 12


def _slices() -> str:
    """Capacity, hashes and blocks of each slice of the growing filter."""
    rows = []
    for n in range(_SLICES):
        own = _SPEC.slice(n)
        rows.append(f"({n}, {own.capacity}, {own.hashes}, {own.blocks})")
    return f"slices(slice, capacity, hashes, blocks) AS (VALUES {', '.join(rows)})"


def _part(at: int) -> str:
    return f"('0x' || substr(md5(line), {at}, 12))::BIGINT"


def _filled(name: str, lines: str, held: str) -> str:
    """CTEs for a run that adds ``lines``: name_placed(line, slice), by the room that ``held(slice, n)`` leaves."""
    return (
        f"{name}_new AS ({lines}), {name}_count AS (SELECT count(*) AS m FROM {name}_new), "
        f"{name}_room AS (SELECT s.slice, greatest(0, capacity - coalesce(h.n, 0)) AS room FROM slices s LEFT JOIN ({held}) h ON h.slice = s.slice), "
        f"{name}_below AS (SELECT slice, sum(room) OVER (ORDER BY slice) - room AS low, sum(room) OVER (ORDER BY slice) AS high FROM {name}_room), "
        f"{name}_placed AS (SELECT line, slice FROM {name}_new, {name}_count, {name}_below "
        f"WHERE {_part(7)} % m >= low AND {_part(7)} % m < high)"
    )


def _bits(source: str, every_slice: bool) -> str:
    """One row per line, slice and bit of ``source``; of its own slice, or of all."""
    join = "slices" if every_slice else "slices USING (slice)"
    return (
        f"SELECT line, slice, {_part(1)} % blocks AS block, "
        f"({_part(13)} % {_M} + i * (({_part(21)} % {_M}) | 1)) % {_M} AS bit "
        f"FROM {source} {', ' if every_slice else 'JOIN '}{join}, (SELECT unnest(range(40)) AS i) WHERE i < hashes"
    )


def _seen(name: str, source: str, filled: str) -> str:
    """CTE name(line, seen): whether some slice has all bits of a line of ``source``."""
    return (
        f"{name} AS (SELECT line, bool_or(hit) AS seen FROM (SELECT q.line, q.slice, bool_and(f.bit IS NOT NULL) AS hit FROM "
        f"({_bits(source, True)}) q LEFT JOIN (SELECT DISTINCT slice, block, bit FROM ({filled})) f "
        "ON f.slice = q.slice AND f.block = q.block AND f.bit = q.bit GROUP BY q.line, q.slice) GROUP BY line)"
    )


def _history(name: str) -> str:
    return f"SELECT DISTINCT url AS line FROM hist WHERE db_name = {quoted(name)}"


_NOTHING = "SELECT 0 AS slice, 0 AS n WHERE false"


def bloom_seen() -> str:
    return (
        f"WITH {HIST}, {_slices()}, lines AS (SELECT DISTINCT url AS line FROM hist), "
        f"{_filled('a', _history('crawler-0'), _NOTHING)}, {_seen('seen', 'lines', _bits('a_placed', False))} SELECT line, seen FROM seen"
    )


def bloom_persist() -> str:
    second = f"SELECT line FROM asked WHERE NOT seen AND line IN ({_history('crawler-2')})"
    both = f"{_bits('a_placed', False)} UNION ALL {_bits('b_placed', False)}"
    return (
        f"WITH {HIST}, {_slices()}, lines AS (SELECT DISTINCT url AS line FROM hist), {_filled('a', _history('crawler-1'), _NOTHING)}, "
        f"{_seen('asked', 'lines', _bits('a_placed', False))}, "
        f"{_filled('b', second, 'SELECT slice, count(*) AS n FROM a_placed GROUP BY slice')}, "
        f"{_seen('seen', 'lines', both)} SELECT line FROM seen WHERE NOT seen"
    )


def crawl(depth: int, same_host: bool = True, seeds: str = "true") -> str:
    """CTEs that end in ``walk(seed, url, depth, k)``."""
    edge = " UNION ALL ".join(f"SELECT p_partkey AS src, {dst} AS dst FROM part" for dst in
                              ("p_partkey + 4", "p_partkey - 4", "p_partkey * 2"))
    scope = f"{shop_origin('src')} = {shop_origin('dst')}" if same_host else "true"
    # with subdomains in scope, a seed's host may be a suffix of the target's
    host_of_seed = f"substr({shop_origin('r.seed')}, 9)"
    reach = (
        "true" if same_host
        else f"(contains({shop_url('e.dst')}, '.' || {host_of_seed}) OR contains({shop_url('e.dst')}, '//' || {host_of_seed}))"
    )
    return (
        f"WITH RECURSIVE edges AS (SELECT DISTINCT src, dst FROM ({edge}) WHERE dst IN (SELECT p_partkey FROM part) AND {scope}), "
        f"r AS (SELECT p_partkey AS seed, p_partkey AS k, 1 AS depth FROM part WHERE {seeds} UNION "
        f"SELECT r.seed, e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.k WHERE r.depth < {depth} AND {reach}), "
        f"walk AS (SELECT {shop_url('seed')} AS seed, {shop_url('k')} AS url, min(depth) AS depth, k FROM r GROUP BY seed, k)"
    )


def _crawl_links(depth: int, same_host: bool = True) -> str:
    found = links(CORE).removeprefix("WITH ")
    return (
        f"{crawl(depth, same_host)}, {found}, walked AS (SELECT seed, url AS where_url, depth FROM walk UNION ALL "
        "SELECT url, url, 1 FROM pages), linked AS (SELECT DISTINCT walked.seed, source, found.url, where_url, depth "
        "FROM walked JOIN found USING (where_url))"
    )


def _plain() -> tuple[dict, list[str]]:
    own = ("''", "w")
    hrefs = _ANCHORS + [own, ("'#top'", "(w || '#top')"), _CSS, _MANIFEST, _FEED]
    resolved = {"py_href": hrefs, "py_script": [_JS, _LIB], "py_style": [_CSS], "py_third_party": [_LIB]}
    runs = [_BASE, _whole(NEXT), _whole(BACK), _whole(CROSS), _LIB, _whole(API), _BUTTON]
    in_text = {
        "css_url": [_root("/css/", ".png")],
        "http_run": runs + [_whole("('http://n.example.com/' || k || '</b>-2</span>-3')")],
        "origin": [
            (f"regexp_extract({u}, '^[a-z]+://[^/]+')",) * 2 for _, u in runs + [_whole(FTP), _whole(NESTED[0])]
        ],
    }
    return {**resolved, **in_text}, ["py_href"]


PLAIN, PLAIN_PAGE_LABELS = _plain()


def plain(labels: tuple[str, ...] = tuple(PLAIN)) -> str:
    return links({k: PLAIN[k] for k in labels}, tuple(PLAIN_PAGE_LABELS))


# Start tags of a shop page in order, with href; a comment counts in the order.
SHOP_TAGS: list[tuple[str, str | None]] = [
    ("html", None), ("head", None), ("link", _CSS[0]), ("link", _MANIFEST[0]), ("link", _FEED[0]),
    ("meta", None), ("meta", None), ("meta", None), ("script", None), ("script", None), ("script", None),
    ("script", None), ("body", None), ("", None), ("a", NEXT), ("a", BACK), ("a", CROSS), ("a", "'#top'"), ("a", "''"),
    ("a", _SITEMAP[0]), ("a", "('../up/' || k)"), ("a", "('/bare/' || k)"), ("a", "('/q?x=1&y=' || k)"),
    ("button", _BUTTON[0]), ("form", None), ("img", None), ("img", None), ("iframe", None), ("video", None),
    ("audio", None), ("embed", None), ("track", None), ("area", _AREA[0]), ("applet", None), ("bgsound", None),
    ("frame", None), ("frameset", None), ("div", None), ("div", None), ("div", None), ("b", None), ("div", None), ("i", None),
    ("p", None), ("span", None), ("b", None), ("p", None),
]
_PAGE_TOKEN = (
    "(?s)<!--.*?-->|<![^>]*>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<title[^>]*>.*?</title>|<[a-zA-Z][^>]*>"
)


def elements() -> str:
    shifted = [
        f"SELECT w AS url, {i} + CASE WHEN k % 10 = 0 AND {i} > 2 THEN 1 ELSE 0 END AS ord, '{tag}' AS tag, "
        f"{href or 'CAST(NULL AS VARCHAR)'} AS href FROM shop"
        for i, (tag, href) in enumerate(SHOP_TAGS, 1)
        if tag
    ]
    shifted.append("SELECT w AS url, 3 AS ord, 'base' AS tag, w AS href FROM shop WHERE k % 10 = 0")
    return (
        f"WITH {SHOP}, toks AS (SELECT url, regexp_extract_all(html, '{_PAGE_TOKEN}') AS t FROM pages), "
        "each AS (SELECT url, unnest(t) AS tok, unnest(range(1, len(t) + 1)) AS ord FROM toks) "
        "SELECT url, ord, lower(regexp_extract(tok, '^<([a-zA-Z0-9]+)', 1)) AS tag, "
        "CASE WHEN contains(tok, ' href=\"') THEN replace(regexp_extract(tok, ' href=\"([^\"]*)\"', 1), '&amp;', '&') END AS href "
        "FROM each WHERE regexp_matches(tok, '^<[a-zA-Z]') UNION ALL " + " UNION ALL ".join(shifted)
    )


def sql() -> dict[str, str]:
    everything = {**FULL, **OPTIONAL}
    labels = {}
    for label, name in catalog.LABELS.items():
        wanted = {k: v for k, v in everything.items() if k == label or (label == "social-media" and k.startswith(label))}
        labels[f"link_{name}"] = distinct_links(wanted)
    rfc = pick(
        "p_partkey",
        *[
            quoted(None) if out is None
            else quoted(out) if out in ("g:h", "http://g")
            else f"'http://h' || p_partkey || {quoted(out)}"
            for _, out in P.RFC_EXAMPLES
        ],
    )
    based = "SELECT 'http://h' || p_partkey || '.example.com' AS o, p_partkey AS k FROM part"
    status_case = "CASE event_id % 4 WHEN 1 THEN 404 WHEN 3 THEN 500 ELSE 200 END"
    type_case = (
        "CASE event_type WHEN 'view' THEN 'text/html' WHEN 'click' THEN 'application/javascript' WHEN 'purchase' THEN "
        "'application/javascript; charset=utf-8' WHEN 'signup' THEN 'image/png' ELSE 'text/css' END"
    )
    types = f"types AS (SELECT event_id, {status_case} AS status, {type_case} AS content_type FROM events)"
    textual = "(starts_with(content_type, 'text/') OR content_type = 'application/javascript')"
    headers = (
        "SELECT o_orderkey, 'A' AS name, 'b' || o_orderkey AS value FROM orders WHERE o_orderkey % 5 = 0 UNION ALL "
        "SELECT o_orderkey, 'C', 'd' FROM orders WHERE o_orderkey % 5 = 0 UNION ALL "
        "SELECT o_orderkey, 'A', 'b:' || o_orderkey FROM orders WHERE o_orderkey % 5 = 1 UNION ALL "
        "SELECT o_orderkey, 'A', 'b: ' || o_orderkey FROM orders WHERE o_orderkey % 5 = 2 UNION ALL "
        "SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 5 = 3 UNION ALL "
        "SELECT o_orderkey, 'A', o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 5 = 4"
    )
    octets = "hex(encode(text))"
    cut = (
        f"CASE WHEN length({octets}) <= 2048 THEN text ELSE decode(unhex(regexp_replace(substr({octets}, 1, 2048), "
        "'([C-F][0-9A-F]|[EF][0-9A-F][89AB][0-9A-F]|F[0-9A-F][89AB][0-9A-F][89AB][0-9A-F])$', ''))) END"
    )
    customer_url = pick(
        "o_orderkey", "'https://c' || o_custkey || '.example.com/a'", "'https://www.c' || o_custkey || '.example.com'",
        "'https://xc' || o_custkey || '.example.com/'", "'https://z.example.net/?u=//c' || o_custkey || '.example.com.evil'",
    )
    keyword_line = pick("s_suppkey", "' k' || s_suppkey || ' '", "''", "'/K' || s_suppkey")
    keywords = "kw AS (SELECT DISTINCT " + pick(
        "s_suppkey", "s_suppkey || '.'", "'/' || s_suppkey || '?'", "'api.example.com/v/' || s_suppkey"
    ) + " AS keyword FROM supplier)"
    # a link of a page in the pages table has root-relative raw form
    kw = _contains_any("raw", catalog.KEYWORDS)
    kw_line = _contains_any("line", catalog.LINE_KEYWORDS)
    seed_status = (
        "CASE WHEN NOT starts_with(seed, 'https://') THEN 'INVALID URL' WHEN coalesce(alive, false) THEN 'CRAWLED' "
        "ELSE 'URL UNREACHABLE' END"
    )
    status_seeds = (
        "seeds AS (SELECT DISTINCT CASE WHEN event_type = 'error' THEN 'u' || (event_id // 8) || '.example.com' "
        "ELSE 'https://u' || (event_id // 8) || '.example.com/' END AS seed FROM events)"
    )
    wait = "CASE WHEN status IS NULL THEN 15 WHEN status = 429 THEN 20 WHEN status >= 500 THEN 10 ELSE 5 END"
    core_lines = f"{links(CORE)}, lines AS (SELECT DISTINCT url, {LINE} AS line FROM found)"
    core_json = f"{links(CORE)}, lines AS (SELECT DISTINCT source, where_url, url, {JSON} AS line FROM found)"
    seed_of = "('https://' || regexp_extract(where_url, '^https?://([^/?#:]+)', 1) || '/p/')"
    host_of_url, host_of_where = host("url"), host("where_url")
    return {
        "html_elements": elements(),
        **labels,
        "link_custom_REGEX_element": distinct_links({PAGE_TEXT: [_whole(u) for u in (API, FTP, *NESTED)]}),
        "extract_core": distinct_links(CORE),
        "extract_full": distinct_links(FULL),
        "classify_exclusive": distinct_links(EXCLUSIVE),
        "classify_grouped": distinct_links(GROUPED, ("href", "css"))
        + " UNION SELECT DISTINCT label, url, url FROM pages, (SELECT unnest(['href', 'script', 'form', 'css']) AS label)"
        + " WHERE contains(html, '<script')"
        + " UNION SELECT DISTINCT label, url, url FROM pages, (SELECT unnest(['script', 'form']) AS label) WHERE contains(html, '<a href=')",
        "py_hrefs": f"{plain(('py_href',))} SELECT source, url, where_url FROM found",
        "py_scripts": f"{plain(('py_script',))} SELECT source, url, where_url FROM found",
        "py_styles": f"{plain(('py_style',))} SELECT source, url, where_url FROM found",
        "py_third_party": f"{plain(('py_third_party',))} SELECT source, url, where_url FROM found",
        "py_links": f"{plain()} SELECT source, url, where_url FROM found",
        "py_depths": f"{plain()} SELECT source, url, where_url, depth FROM found, (SELECT unnest(range(3)) AS depth)",
        "urls_in_text": text_urls(fixed.URL_PATTERN),
        "http_urls_in_text": text_urls(fixed.HTTP_RUN_PATTERN, distinct="ALL"),
        "origins_in_text": text_urls(_ORIGIN_PATTERN, distinct="ALL"),
        "css_urls": text_urls(fixed.CSS_URL_PATTERN, 1, distinct="ALL"),
        "seeds_valid": f"WITH {SEEDS} SELECT seed, {host('seed')} AS host FROM seeds WHERE {ABSOLUTE}",
        "seeds_rejected": f"WITH {SEEDS} SELECT seed FROM seeds WHERE NOT {ABSOLUTE}",
        "hosts_parsed": f"SELECT {HOST} AS host, {domain(HOST)} AS domain2, c_custkey % 5 NOT IN (2, 3) AS well_formed FROM customer",
        "sink_lines": f"{core_lines} SELECT line FROM lines",
        "sink_json": f"{core_json} SELECT line FROM lines",
        "sink_filtered": f"{core_lines} SELECT line FROM lines WHERE {kw_line}",
        "sink_both": f"{core_lines} SELECT line, 'filtered' AS kind FROM lines WHERE {kw_line} UNION ALL SELECT line, 'full' FROM lines",
        "keywords_read": f"SELECT {keyword_line} AS keyword FROM supplier",
        "pages_read": "SELECT page_id, url, strlen(html)::BIGINT AS octets FROM pages",
        "link_anchor": distinct_links({"href": CORE["href"]}),
        # only anchors have an empty address
        "inside_path_full": f"SELECT DISTINCT source, url, where_url, false AS inside FROM ({links(FULL)} SELECT * FROM found) "
        "WHERE NOT (source = 'href' AND raw = '') UNION SELECT DISTINCT source, url, where_url, true "
        f"FROM ({links({'href': CORE['href']})} SELECT * FROM found) WHERE contains(url, {seed_of})",
        "scope_host_extra": distinct_links(
            {"href": FULL["href"]}, where=f"coalesce({host_of_url} = {host_of_where}, false) OR coalesce({host_of_url} = 'example.org', false)"
        ),
        "absolute_url_encoded": f"SELECT p_partkey, replace(replace({rfc}, 'é', '%C3%A9'), 'ü', '%C3%BC') AS url FROM part",
        "alive_two_attempts": f"WITH {LOG}, {DECIDED.replace(f'attempt <= {fixed.DEFAULT_ATTEMPTS}', 'attempt <= 2')} SELECT url, alive FROM tolerant",
        "extract_py": f"{plain()} SELECT DISTINCT source, url, where_url FROM found",
        "sink_by_depth": f"{plain()} SELECT url AS line, replace(regexp_extract(where_url, '//([^/]*)', 1), ':', '_') AS domain, depth "
        "FROM found, (SELECT unnest(range(2)) AS depth)",
        "host_of": f"WITH {URLS} SELECT url, {host_of_url} AS host FROM urls",
        "main_domain": f"WITH {URLS}, hosts AS (SELECT url, {host_of_url} AS host FROM urls) "
        f"SELECT url, {domain('host')} AS domain FROM hosts",
        "seed_domain": f"WITH {URLS} SELECT url, string_split(string_split(url, '//')[-1], '/')[1] AS domain FROM urls",
        "absolute_url": f"SELECT p_partkey, {rfc} AS url FROM part",
        "absolute_url_base": f"WITH b AS ({based}) "
        "SELECT 'href' AS source, o || '/base' || k || '/y' AS url, o || '/a/b' AS where_url FROM b UNION ALL "
        "SELECT 'href', o || '/base' || k || '/x?q=' || k, o || '/a/b' FROM b UNION ALL "
        "SELECT 'embedded', o || '/i.png', o || '/a/b' FROM b",
        "parse_headers": headers,
        "truncate_body": f"SELECT doc_id, {cut} AS body FROM documents",
        "render_line": f"{core_lines} SELECT url, line FROM lines",
        "render_json": f"{core_json.replace(JSON, JSON.replace('replace(where_url, ' + quoted('&') + ', ' + quoted(chr(92) + 'u0026') + ')', quoted('')))} "
        "SELECT url, line FROM lines",
        "is_textual": f"WITH {types} SELECT event_id, content_type, {textual} AS textual FROM types",
        "gate_textual": f"WITH {types} SELECT event_id, status, content_type FROM types WHERE status = 200 AND {textual}",
        "kw_filter": distinct_links(FULL, where=kw),
        "kw_filter_line": f"{core_lines} SELECT line FROM lines WHERE {kw_line}",
        "inside_path": distinct_links(CORE, where=f"source <> 'href' OR contains(url, {seed_of})"),
        "scope_host": distinct_links({"href": FULL["href"]}, where=f"coalesce({host_of_url} = {host_of_where}, false)"),
        "scope_subs": distinct_links({"href": FULL["href"]}, where=_contains_any("url", [".example.com", "//example.com"])),
        "scope_host_list": f"WITH l AS (SELECT o_orderkey, {customer_url} AS url FROM orders), "
        "h AS (SELECT 'c' || s_suppkey || '.example.com' AS host FROM supplier) SELECT o_orderkey, url FROM l WHERE EXISTS "
        "(SELECT 1 FROM h WHERE contains(l.url, '.' || h.host) OR contains(l.url, '//' || h.host))",
        "kw_matches": f"{links(CORE)}, {keywords}, urls AS (SELECT DISTINCT url FROM found) "
        "SELECT url, keyword FROM urls JOIN kw ON contains(url, keyword)",
        "kw_filter_table": f"{links(CORE)}, {keywords}, urls AS (SELECT DISTINCT url FROM found), "
        "hit AS (SELECT DISTINCT url FROM urls JOIN kw ON contains(url, keyword)) "
        "SELECT DISTINCT source, url, where_url FROM found WHERE url IN (SELECT url FROM hit)",
        "seeds_unprocessed": f"WITH {HIST} SELECT DISTINCT url AS seed FROM hist WHERE url NOT IN (SELECT url FROM main)",
        "history_append": f"WITH {HIST} SELECT url, ts FROM main UNION ALL SELECT url, min(ts) AS ts FROM hist "
        "WHERE url NOT IN (SELECT url FROM main) GROUP BY url",
        "history_append_files": f"WITH {HIST} SELECT url, ts FROM main UNION ALL SELECT url, min(ts) AS ts FROM hist "
        "WHERE url NOT IN (SELECT url FROM main) GROUP BY url",
        "history_merge": f"WITH {HIST}, ranked AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY db_name) AS n FROM hist) "
        "SELECT db_name, url, ts FROM ranked WHERE n = 1",
        "history_domains": f"WITH {HIST} SELECT DISTINCT url, 'example_com' AS db_name FROM hist",
        "unique_lines": f"{links(FULL)} SELECT DISTINCT url AS line FROM found",
        "bloom_seen": bloom_seen(),
        "bloom_persist": bloom_persist(),
        "crawl_visited": f"{crawl(4)} SELECT seed, url, depth FROM walk UNION ALL SELECT url, url, 1 FROM pages",
        "crawl_depth": f"{_crawl_links(2)} SELECT seed, source, url, where_url, depth FROM linked",
        "crawl_multi": f"{_crawl_links(3, same_host=False)} SELECT DISTINCT '[' || source || '] ' || url AS line FROM linked",
        "crawl_resume": f"{crawl(2, seeds='p_size > 10')} SELECT 'visited' AS kind, seed, url, depth FROM walk UNION ALL "
        "SELECT 'visited', url, url, 1 FROM pages UNION ALL SELECT 'history', url, url, 0 FROM pages UNION ALL "
        f"SELECT 'history', {shop_url('p_partkey')}, {shop_url('p_partkey')}, 0 FROM part",
        "alive_strict": f"WITH {LOG} SELECT url, coalesce(arg_min(coalesce(status, 0), attempt) = 200, false) AS alive FROM log GROUP BY url",
        "alive_tolerant": f"WITH {LOG}, {DECIDED} SELECT url, alive FROM tolerant",
        "retry_backoff": f"WITH {LOG}, {DECIDED} SELECT l.url, coalesce(sum({wait}) FILTER (l.attempt <= {fixed.DEFAULT_ATTEMPTS} "
        "AND l.attempt < coalesce(d.at, 99)), 0)::BIGINT AS waited FROM log l LEFT JOIN decided d ON d.url = l.url GROUP BY l.url",
        "seed_status": f"WITH {LOG}, {DECIDED}, {status_seeds} SELECT seed, {seed_status} AS status FROM seeds "
        "LEFT JOIN tolerant ON tolerant.url = seeds.seed",
        "within_budget": "WITH s AS (SELECT 'https://u' || user_id || '.example.com/' AS seed, event_id, ts, "
        f"min(ts) OVER (PARTITION BY user_id) AS start FROM events) SELECT seed, event_id FROM s WHERE ts <= start + INTERVAL {catalog.BUDGET_SECONDS} SECOND",
        "stream_extract": distinct_links(CORE),
        "stream_unique": f"{links(CORE)} SELECT DISTINCT url AS line FROM found",
        "stream_bloom_unique": "SELECT DISTINCT 'https://c' || o_custkey || '.example.com/' AS line FROM orders",
        "stream_unique_delay": "SELECT DISTINCT user_id, event_type FROM events",
        "stream_history": f"WITH {HIST} SELECT DISTINCT url AS seed FROM hist",
    }
