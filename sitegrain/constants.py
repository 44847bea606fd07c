"""Fixed values of the audit, stated as plain text.

They must equal the published behaviour of the rules for results to match.
"""

# --- severities -------------------------------------------------------------
SEVERITIES = ["critical", "high", "medium", "low", "info"]
SEVERITY_WEIGHT = {"critical": 25.0, "high": 12.0, "medium": 6.0, "low": 2.0, "info": 0.0}

# --- SEO thresholds ---------------------------------------------------------
TITLE_MIN = 15
TITLE_MAX = 60
DESCRIPTION_MIN = 50
DESCRIPTION_MAX = 160
THIN_CONTENT_CHARS = 300
VAGUE_LINK_TEXT = [
    "click here", "details", "here", "learn more", "link", "more", "read more", "this",
]
REQUIRED_OPEN_GRAPH = ["og:title", "og:description", "og:image"]

# --- image thresholds -------------------------------------------------------
GENERIC_ALT = [
    "banner", "graphic", "icon", "image", "img", "logo", "photo", "picture",
    "placeholder", "thumbnail", "untitled",
]
ALT_MAX_LENGTH = 125
MODERN_EXTENSIONS = [".avif", ".webp"]
LEGACY_EXTENSIONS = [".jpeg", ".jpg", ".png"]
ABOVE_FOLD_IMAGES = 2
SHORT_NAME_LIMIT = 80
FILES_SHOWN = 8

# --- link and asset limits (features of the report, remainders are counted) --
MAX_LINKS = 40
MAX_IMAGES = 60
ASSET_LIMIT_BYTES = 2621440
EXAMPLES_SHOWN = 5

# --- outline ----------------------------------------------------------------
OUTLINE_MAX_NODES = 400
OUTLINE_MAX_DEPTH = 8

# --- tag sets ---------------------------------------------------------------
QUIET_TAGS = ["noscript", "script", "style", "template"]
HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "param", "source", "track", "wbr",
]
STRUCTURAL_TAGS = [
    "article", "aside", "audio", "blockquote", "body", "button", "canvas", "dd",
    "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1",
    "h2", "h3", "h4", "h5", "h6", "header", "html", "iframe", "img", "input",
    "label", "li", "main", "nav", "ol", "p", "picture", "pre", "section", "select",
    "svg", "table", "tbody", "td", "textarea", "th", "thead", "tr", "ul", "video",
]
CLOSES_PARAGRAPH = [
    "article", "aside", "blockquote", "div", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre",
    "section", "table", "ul",
]
SKIPPED_HREF_PREFIXES = ["#", "javascript:", "mailto:", "tel:"]

# --- URL validation ---------------------------------------------------------
MAX_URL_LENGTH = 2048
BLOCKED_SCHEMES = [
    "about", "blob", "chrome", "data", "file", "ftp", "ftps", "gopher", "javascript",
    "mailto", "sftp", "tel", "vbscript", "view-source",
]

# --- text generator ---------------------------------------------------------
ADDRESS_FIELDS = [
    ("street", "streetAddress"),
    ("streetaddress", "streetAddress"),
    ("address", "streetAddress"),
    ("city", "addressLocality"),
    ("locality", "addressLocality"),
    ("region", "addressRegion"),
    ("county", "addressRegion"),
    ("state", "addressRegion"),
    ("postcode", "postalCode"),
    ("postalcode", "postalCode"),
    ("zip", "postalCode"),
    ("country", "addressCountry"),
]
SCHEMA_TYPES = [
    "auto", "Article", "FAQPage", "HowTo", "Organization", "LocalBusiness", "Product",
    "Event", "BreadcrumbList", "WebPage",
]

# --- modules ----------------------------------------------------------------
PACK_LABELS = {
    "http": "HTTP", "seo": "SEO", "images": "Images", "links": "Links",
    "assets": "Image weight",
}
AXE_SEVERITY = {"critical": "critical", "serious": "high", "moderate": "medium", "minor": "low"}
CHECKLIST_ITEMS = [
    "meta_title", "meta_description", "canonical", "h1", "h2", "sitemap", "robots",
    "responsive", "accessibility", "images_optimized", "image_alt", "no_broken_links",
]

# White space as the audit's text rules see it: ASCII blanks, the four ASCII
# separators, NEL, and every Unicode space, line and paragraph separator.
SPACES = (
    "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680]))
    + "".join(map(chr, [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
)
SPACE_CLASS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
