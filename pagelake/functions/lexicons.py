"""Fixed word lists, indicator lists and lookup tables.

These are fixed values: they must equal the published behaviour for results
to match, so they are stated plainly, in their natural order. Keep them as
data; the operators turn them into column expressions or small broadcast
DataFrames.
"""

# ---- Fixed values: content-category lexicons (C1-C3) ----
EDUCATIONAL_CONTENT = [
    "lernen", "learning", "lektion", "lesson", "kursinhalt", "curriculum", "übungen",
    "exercise", "aufgaben", "worksheet", "vorlesung", "lecture", "seminar", "tutorial",
    "kapitel", "module", "kompetenz", "kompetenzen", "kompetenzziel", "ziel", "ziele",
    "learning outcome", "skill", "kompetenzziele", "unterricht", "training",
    "übungsaufgaben", "präsentation",
]
EDUCATIONAL_METADATA = [
    "ects", "credit", "credits", "semester", "term", "vorraussetzung", "voraussetzung",
    "prerequisite", "zulassung", "abschluss", "anmeldung", "registration", "dauer",
    "duration", "kontakt", "contact", "kursnummer", "module code", "modulnummer",
    "beschreibung", "description", "veranstalter", "provider", "zielgruppe",
    "target group", "dozent", "lecturer", "lehrende", "preis", "kosten", "fee",
    "location", "ort", "zeit", "schedule", "zeiten", "termin", "termine",
]
ERROR_PAGE = [
    "404", "403", "500", "fehler", "error", "not found", "forbidden", "zugriff verweigert",
    "access denied", "seite nicht gefunden", "wartung", "maintenance", "unavailable",
    "temporarily unavailable", "problem", "oops", "kaputt", "blocked", "captcha",
    "try again",
]
# Tie order of the arg-max: earlier wins.
CATEGORY_ORDER = ["educational_content", "educational_metadata", "error_page"]
LEXICONS = {
    "error_page": ERROR_PAGE,
    "educational_content": EDUCATIONAL_CONTENT,
    "educational_metadata": EDUCATIONAL_METADATA,
}
ERROR_PAGE_MAX_CHARS = 800

# ---- Fixed values: error-page indicators (C4), first match wins ----
ERROR_TITLES = ["404", "403", "500", "502", "503", "not found", "access denied",
                "forbidden", "error", "blocked", "captcha", "challenge"]
HTTP_ERRORS = ["page not found", "404 error", "not found", "access denied", "403 forbidden",
               "forbidden", "internal server error", "500 error", "server error",
               "bad gateway", "502 error", "503 error"]
SECURITY_INDICATORS = ["cloudflare", "checking your browser", "ddos protection",
                       "security check", "captcha", "verify you are human", "ray id",
                       "blocked by", "access restricted"]
SHORT_CONTENT_ERRORS = ["error", "not found", "forbidden", "denied", "blocked"]
SHORT_CONTENT_MAX = 100
ERROR_SELECTORS = [".error", "#error", ".not-found", ".forbidden", ".blocked", ".captcha",
                   ".challenge"]

# ---- Fixed values: SPA indicators in raw HTML (C5) ----
SPA_FRAMEWORKS = [
    ("React", ["data-reactroot", "react.js", "reactdom", "__react", "_reactinternalinstance"]),
    ("Vue", ["vue.js", "data-v-", "__vue__", "v-if", "v-for", "v-model"]),
    ("Angular", ["ng-app", "ng-controller", "angular.js", "app-root", "[ng-"]),
    ("Ember", ["ember.js", "ember-application", "data-ember-"]),
    ("Svelte", ["svelte", "__svelte__"]),
]
SPA_STRUCTURE = ["single-page", "spa-", "#app", "#root", "data-testid", "data-cy"]
SPA_LOADING = ["loading", "spinner", "skeleton", "lazy-load"]

# ---- Fixed values: ultra-complex SPA (C7) ----
PLACEHOLDER_TEXTS = ["JavaScript wird benötigt", "JavaScript is required",
                     "Please enable JavaScript", "This app requires JavaScript",
                     "Loading...", "Wird geladen..."]
COMPLEX_DOMAINS = ["kmap.eu", "app.", "dashboard.", "admin."]

# ---- Fixed values: targeted main content (B10) ----
TARGET_SELECTORS = [
    "main", '[role="main"]', ".main-content", ".content-area", ".main-container", ".page-content", ".article-content",
    ".content-wrapper", ".primary-content", ".main-section", ".content-body", ".page-body", ".article-body",
    ".lesson-content", ".course-content", ".educational-content", ".learning-content", ".tutorial-content",
    ".chapter-content", ".knowledge-map", ".concept-content", ".topic-content", "[data-content]", "[data-main]", ".app-content",
]
TARGET_CONTAINERS = ['div[class*="content"]', 'div[id*="content"]', 'section[class*="content"]', "article", 'div[class*="main"]', 'div[id*="main"]']
TARGET_SKIP = ["nav", "header", ".nav", ".navigation", ".menu"]

# ---- Fixed values: educational blocks (B11) ----
EDU_SELECTORS = [
    "p", 'div[class*="text"]', 'div[class*="description"]', 'div[class*="explanation"]', 'div[class*="definition"]',
    "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "canvas", "svg", "[data-interactive]", "textarea", 'input[type="text"]',
]
EDU_SKIP = ["nav", ".nav", ".navigation", ".menu", "header", "footer", ".sidebar"]
EDU_MENU_WORD = "(?i)^(Home|Menu|Navigation|Login|Register|Search)$"
EDU_DATA_ATTRIBUTES = ["data-content", "data-text", "data-description"]

# ---- Fixed values: containers beside SVG text (B12) ----
SVG_CONTAINERS = [
    '[class*="content"]', '[class*="lesson"]', '[class*="concept"]', '[class*="definition"]', '[class*="explanation"]',
    '[class*="description"]', '[id*="content"]', '[id*="main"]', '[id*="lesson"]',
]

# ---- Fixed values: educational content present (C8), SVG containers (B12) ----
EDU_KEYWORDS = ["koordinaten", "achse", "punkt", "raum", "dimension"]

# ---- Fixed values: best-snapshot placeholders (B17) ----
SNAPSHOT_PLACEHOLDERS = ["JavaScript wird benötigt", "Loading..."]

# ---- Fixed values: link classification (D4) ----
DOWNLOAD_EXTENSIONS = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip",
                       ".rar", ".tar", ".gz", ".mp3", ".mp4", ".avi"]
MEDIA_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".mp4", ".avi", ".mov"]
SOCIAL_DOMAINS = ["facebook.com", "twitter.com", "linkedin.com", "instagram.com",
                  "youtube.com", "github.com", "reddit.com"]
NAV_INDICATORS = ["menu", "nav", "home", "about", "contact", "services", "products", "blog",
                  "news", "help", "support"]
CONTENT_INDICATORS = ["read more", "continue reading", "full article", "details",
                      "learn more", "view", "see"]
LINK_TYPE_PRIORITY = {"content": 1, "navigation": 2, "download": 3, "button": 4,
                      "social": 5, "media": 6, "email": 7, "phone": 8, "unknown": 9}
LINK_TEXT_MAX = 200
MAX_LINKS = 100

# ---- Fixed values: selector cascade (B3) and readable-text skips (B4) ----
MAIN_SELECTORS = ["main", "article", ".content", "#content", ".main", "#main", ".post",
                  ".entry"]
READABLE_SKIP = ["nav", "header", "footer", "aside", ".sidebar", ".navigation", ".menu",
                 ".ads", ".advertisement", ".social", ".share", ".comments", ".comment"]
READABLE_MIN = 10

# ---- Fixed values: YouTube hosts (C11) and URL patterns (C12) ----
YOUTUBE_DOMAINS = [
    "youtube.com", "www.youtube.com", "m.youtube.com", "gaming.youtube.com",
    "studio.youtube.com", "youtube-nocookie.com", "youtu.be", "www.youtu.be",
    "youtube.at", "youtube.be", "youtube.bg", "youtube.hr", "youtube.cy", "youtube.cz",
    "youtube.dk", "youtube.ee", "youtube.es", "youtube.fi", "youtube.fr", "youtube.gr",
    "youtube.hu", "youtube.ie", "youtube.it", "youtube.lt", "youtube.lu", "youtube.lv",
    "youtube.mt", "youtube.nl", "youtube.pl", "youtube.pt", "youtube.ro", "youtube.se",
    "youtube.sk", "youtube.si", "youtube.de",
]
YOUTUBE_PATTERNS = [
    r"(?:https?://)?(?:www\.)?youtube\.com/watch\?v=([^&\n?#]+)",
    r"(?:https?://)?(?:www\.)?youtu\.be/([^&\n?#]+)",
    r"(?:https?://)?(?:www\.)?youtube\.com/embed/([^&\n?#]+)",
    r"(?:https?://)?(?:m\.)?youtube\.com/watch\?v=([^&\n?#]+)",
]

# ---- Fixed values: file formats (C13-C18) ----
# URL substring -> format, tested in this order.
URL_FORMATS = [(".pdf", "pdf"), (".doc", "doc"), (".docx", "docx"), (".xls", "xls"),
               (".xlsx", "xlsx"), (".ppt", "ppt"), (".pptx", "pptx"), (".odt", "odt"),
               (".ods", "ods"), (".odp", "odp"), (".rtf", "rtf"), (".txt", "txt"),
               (".csv", "csv"), (".html", "html"), (".htm", "html"), (".xml", "xml")]
MIME_FORMATS = {
    "application/pdf": "pdf", "application/x-pdf": "pdf", "application/acrobat": "pdf",
    "application/msword": "doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.ms-excel": "xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.ms-powerpoint": "ppt",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "text/plain": "txt", "text/csv": "csv", "text/html": "html",
}
OFFICE_MIME_TYPES = [
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/msword",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/vnd.ms-excel",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/vnd.ms-powerpoint",
    "application/vnd.oasis.opendocument.text",
    "application/vnd.oasis.opendocument.presentation",
    "application/vnd.oasis.opendocument.spreadsheet",
    "application/rtf", "text/rtf",
    "pdf", "docx", "xlsx", "pptx", "doc", "xls", "ppt",
]
CONVERTIBLE_FORMATS = {
    "pdf": "PDF Document", "docx": "Microsoft Word Document",
    "doc": "Microsoft Word Document (Legacy)", "pptx": "Microsoft PowerPoint Presentation",
    "ppt": "Microsoft PowerPoint Presentation (Legacy)",
    "xlsx": "Microsoft Excel Spreadsheet", "xls": "Microsoft Excel Spreadsheet (Legacy)",
    "odt": "OpenDocument Text", "ods": "OpenDocument Spreadsheet",
    "odp": "OpenDocument Presentation", "rtf": "Rich Text Format", "txt": "Plain Text",
    "jpg": "JPEG Image", "jpeg": "JPEG Image", "png": "PNG Image", "gif": "GIF Image",
    "bmp": "Bitmap Image", "tiff": "TIFF Image", "tif": "TIFF Image",
    "svg": "SVG Vector Image", "webp": "WebP Image",
    "mp3": "MP3 Audio", "wav": "WAV Audio", "mp4": "MP4 Video", "avi": "AVI Video",
    "mov": "QuickTime Video", "mkv": "Matroska Video", "wmv": "Windows Media Video",
    "flv": "Flash Video", "webm": "WebM Video", "m4a": "M4A Audio", "aac": "AAC Audio",
    "ogg": "OGG Audio", "flac": "FLAC Audio",
    "html": "HTML Document", "htm": "HTML Document", "xml": "XML Document",
    "md": "Markdown Document", "markdown": "Markdown Document",
    "eml": "Email Message", "msg": "Outlook Message", "zip": "ZIP Archive",
}
CONVERTIBLE_URL_SUFFIXES = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
                            ".odt", ".ods", ".odp", ".rtf", ".txt", ".csv", ".html", ".htm"]
BASIC_SUPPORTED_FORMATS = ["PDF", "DOC", "DOCX", "XLS", "XLSX", "PPT", "PPTX", "ODT", "ODS",
                           "ODP", "RTF", "TXT", "CSV", "HTML", "HTM"]
MAX_FILE_MB = (1, 100)
CONVERSION_TIMEOUT_S = (10, 300)
REQUEST_TIMEOUT_S = (5, 120)

# ---- Fixed values: retryable errors (C20) and backoff (W10) ----
RETRYABLE_STATUS = [500, 502, 503, 504, 408, 429]
RETRYABLE_PATTERNS = ["timeout", "connection", "network", "dns", "resolve",
                      "temporary failure", "service unavailable", "bad gateway",
                      "gateway timeout", "too many requests"]
BACKOFF = {"max_retries": 3, "base_delay": 1.0, "max_delay": 60.0, "factor": 2.0}

# ---- Fixed values: request normalisation (A3) ----
NO_PROXY_VALUES = ["", "string", "none", "null", "false", "0"]

# ---- Fixed values: stability and quiet periods (W6-W9) ----
HASH_STABLE_REPEATS = 3
HASH_MAX_POLLS = 8
HASH_MAX_POLLS_ULTRA = 15
LENGTH_STABLE_REPEATS = 2
LENGTH_MAX_POLLS = 5
QUIET_MS = 500
QUIET_CAP_MS = 35000

# ---- Fixed values: rate limits (W2, W3) ----
LEGACY_RATE_PER_SECOND = 5
DEFAULT_RATE_PER_SECOND = 100
DEFAULT_BASE_WEIGHT = 20
