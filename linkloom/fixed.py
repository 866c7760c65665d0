"""Fixed values.

Everything here has to be exactly what it is for results to be right, so it is
written out plainly and in one place: URL schemes, URL patterns, link labels,
HTTP status classes, wait times and default parameters.
"""

# The URL pattern used on script bodies and on page text.
URL_PATTERN = (
    r"(?i)(?:https?|ftp|smtp|unknown|sftp|file|data|telnet|ssh|ws|wss|git|svn|gopher)://"
    r"(?:[^\t\n\f\r :@'\"]+(?::[^\t\n\f\r :@'\"]*)?@)?"
    r"(?:[_A-Z0-9.-]+|\[[_A-F0-9]*:[_A-F0-9:]+\])"
    r"(?::[0-9]{1,5})?"
    r"(?:/[^\t\n\f\r '\"]*)?"
    r"(?:\?[^\t\n\f\r '\"]*)?"
    r"(?:#[^\t\n\f\r '\"]*)?"
)

# The loose http(s) run. One character class on purpose: a
# repeated group of alternatives recurses in java.util.regex.
HTTP_RUN_PATTERN = r"https?://[a-zA-Z$-_! ]+"

# Scheme, user info, host and port. The labels before the last two
# are one run of characters without two dots in a row, up to a dot: any number of
# labels, and no group for java.util.regex to recurse on.
ORIGIN_PATTERN = (
    r"(?i)(?:https?|ftp|smtp)://"
    r"(?:[!-9;-?A-~]+(?::[!-9;-?A-~]+)?@)?"
    r"(?:(?=[0-9a-z_-])(?:(?!\.\.)[0-9a-z_.-])*(?<=\.))?"
    r"(?:xn--[0-9a-z]+|[0-9a-z-]+)\.(?:xn--[0-9a-z]+|[0-9a-z]{2,10})"
    r"(?::(?:6553[0-5]|655[0-2][0-9]|65[0-4][0-9]{2}|6[0-4][0-9]{3}"
    r"|[1-5][0-9]{4}|[1-9][0-9]{1,3}|[0-9]))?"
)

# Arguments of CSS url("...") / url('...').
CSS_URL_PATTERN = r"url\([\"']([^\n]*?)[\"']\)"

# Elements whose content is text, not markup. A scripting browser
# reads the first set that way; a plain parser only the second.
RAW_TEXT_TAGS = (
    "script", "style", "title", "textarea", "xmp",
    "iframe", "noembed", "noframes", "noscript",
)
RAW_TEXT_TAGS_PLAIN = ("script", "style")
# Raw-text elements in which character references are still decoded.
DECODED_RAW_TAGS = ("title", "textarea")

# Elements without content, which no end tag closes.
VOID_TAGS = (
    "area", "base", "basefont", "bgsound", "br", "col", "embed", "frame", "hr", "img",
    "input", "keygen", "link", "meta", "param", "source", "track", "wbr",
)
# Start tags that end an open element, the elements they end, and
# those inside which they do not look further out.
IMPLIED_ENDS = (
    (("li",), ("li",), ("ul", "ol")),
    (("dt", "dd"), ("dt", "dd"), ("dl",)),
    (("tr",), ("tr",), ("table",)),
    (("td", "th"), ("td", "th"), ("tr", "table")),
    (("tbody", "thead", "tfoot"), ("tbody", "thead", "tfoot"), ("table",)),
    (("option",), ("option",), ("select",)),
    (("optgroup",), ("option", "optgroup"), ("select",)),
    (
        (
            "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset",
            "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr",
            "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul",
        ),
        ("p",),
        ("button", "table", "td", "th", "caption", "object", "applet", "marquee", "template"),
    ),
)

# Content types of <link> that announce a feed.
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/xml")

# Fetch verdicts and wait times in seconds.
DEAD_STATUSES = (400, 401, 403, 404)
WAIT_NETWORK_ERROR = 15
WAIT_RATE_LIMITED = 20
WAIT_SERVER_ERROR = 10
WAIT_OTHER_STATUS = 5

# Defaults of the job options.
DEFAULT_DEPTH = 2
DEFAULT_ATTEMPTS = 4
BLOOM_CAPACITY = 1_000_000
BLOOM_ERROR_RATE = 0.01
