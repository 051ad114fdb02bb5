"""Word lists, names and patterns that results depend on, as they are."""

# Language markers; two or more of them in a lower-cased text make it Turkish.
TURKISH_MARKERS = ["ç", "ğ", "ı", "ö", "ş", "ü", "veya", "için", "bir", "olarak", "hakkında", "bu"]

# English stopwords of the keyword pass.
ENGLISH_STOPWORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between both
but by can cannot could did do does doing down during each few for from further had has have having he her here hers
herself him himself his how i if in into is it its itself more most no nor not of off on once only or other ought our
ours ourselves out over own same she should so some such than that the their theirs them themselves then there these
they this those through to too under until up very was we were what when where which while who whom why with would you
your yours yourself yourselves
""".split()

# Turkish stopwords of the keyword pass.
TURKISH_STOPWORDS = """
acaba ama aslında az bazı belki biri birkaç birşey biz bu buna bunda bundan burada böyle da daha dahi de defa değil
diğer diye en gibi hem hep hepsi her hiç için ile ise katrilyon kendi kendine kendini ki kim mı mu mü nasıl ne neden
nerde nerede nereye niçin niye o onlar onlara onlardan onları onların orada oysa pek sadece sanki sen siz sonra tüm ve
veya ya yani yine yok
""".split()

# Words that name no entity in a question.
QUESTION_STOPWORDS = "what does the book say about how is are do a an of in on with and to for".split()

# Words that the structure reranker leaves out, beside those of questions.
STRUCTURE_STOPWORDS = [*QUESTION_STOPWORDS, *"me mean by it its according".split()]

# Endings of organisation names.
ORGANISATION_SUFFIXES = ["Inc", "Corp", "Corporation", "Ltd", "Limited", "LLC", "Recordings", "Records", "Group", "Bank", "University", "Agency", "Cumhuriyeti", "Holding"]

# Names that are recognised wherever their trigger occurs: trigger, name, type, confidence.
KNOWN_NAMES = [
    ("rick rubin", "Rick Rubin", "person", 0.90),
    ("atatürk", "Mustafa Kemal Atatürk", "person", 0.95),
    ("new york", "New York", "location", 0.88),
    ("ankara", "Ankara", "location", 0.88),
]

# Headings that make no title.
GENERIC_HEADINGS = [
    "extracted pdf document", "chapter 1", "introduction", "contents", "table of contents", "untitled document",
    "whats next on your reading list", "whats next on your reading list u discover",
    "whats next on your reading list u discover your", "discover your next great read", "about the author", "copyright",
    "all rights reserved", "firecrawl inspector", "sample extracted document",
]

# Legal moves of an indexing job.
JOB_MOVES = [
    ("pending", "running"), ("pending", "cancelled"), ("running", "completed"), ("running", "failed"),
    ("running", "retrying"), ("running", "cancelled"), ("retrying", "running"), ("retrying", "failed"), ("retrying", "cancelled"),
]

# Comparison questions, tried in this order.
COMPARISONS = [
    r"(?i)^compare\s+(.+?)\s+(?:with|and)\s+(.+)$",
    r"(?i)^(.+?)\s+vs\.?\s+(.+)$",
    r"(?i)^.*?\bdifference\s+between\s+(.+?)\s+and\s+(.+)$",
    r"(?i)^how\s+do\s+(.+?)\s+and\s+(.+?)\s+differ",
    r"(?i)^contrast\s+(?:the\s+approaches\s+of\s+)?(.+?)\s+and\s+(.+)$",
    r"(?i)^what\s+distinguishes\s+(.+?)\s+from\s+(.+)$",
]

# Patterns of the document formats.
ENTITY_QUESTION = r"(?i)^what does the (?:book|it) say about .+\??$"
INLINE_CITATION = r"\[(\d+|[A-Za-z]+\s+et\s+al\.,?\s*\d{4})\]"
CATALOG = r"(?i)(ISBN(?:-13|-10)?:\s*[\d\-X]+|LCCN\s*[\d]+|Copyright\s*©\s*[\d]{4}[^\n]*)"
ATTRIBUTION = r"(?i)(Excerpt\s+from\s+[^\n]+|As\s+told\s+to\s+[^\n]+)"

# Patterns of assets.
HTML_TABLE = r"(?is)<table>.*?</table>"
MARKDOWN_IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"
HTML_IMAGE = r"""(?i)<img\s+[^>]*src=["']([^"']+)["'][^>]*>"""
ALT_TEXT = r"""(?i)alt=["']([^"']+)["']"""
DISPLAY_MATH = r"(?s)\$\$(.*?)\$\$|\\\[(.*?)\\\]"
BIBLIOGRAPHY_HEADING = r"(?i)^#{1,6}\s+(references|bibliography)"
BIBLIOGRAPHY_ITEM = r"^(?:\d+\.|\*|\[\d+\]|\[[^\]]+\])\s+.+"
FOOTNOTE_TEXT = r"\[\^([^\]]+)\]:\s*(.+)"
FOOTNOTE_MARK = r"\[\^([^\]]+)\]"

# Prefixes of asset ids.
ASSET_PREFIX = {"table": "tbl", "figure": "fig", "code": "code", "equation": "eq", "citation": "cit"}

# Legal moves of a question's job.
QUESTION_MOVES = [
    ("pending", "planning"), ("pending", "cancelled"), ("planning", "retrieving"), ("planning", "failed"), ("planning", "cancelled"),
    ("retrieving", "generating"), ("retrieving", "failed"), ("retrieving", "cancelled"), ("generating", "verifying"),
    ("generating", "failed"), ("generating", "cancelled"), ("verifying", "completed"), ("verifying", "failed"), ("verifying", "cancelled"),
]

# Kinds of content that a filter may name.
CONTENT_TYPES = ["paragraph", "table", "code", "list", "equation", "figure"]

# Texts of warnings and of an empty context.
EMPTY_HEADING = 'empty heading text encountered at page %d'
LEVEL_SKIPPED = "heading level skipped: expected level %d before level %d for heading '%s'"
AMBIGUOUS_PAGE = 'ambiguous page reference %d in JSON layout node'
UNMAPPED_NODE = "unmapped custom layout node type: '%s' on page %d"
OVERSIZED_CHUNK = 'oversized chunk encountered in section "%s": token estimate %d exceeds absolute max limit %d'
PREAMBLE = 'preamble text detected before first heading node at page %d'
BROKEN_TABLE = 'malformed HTML table block encountered'
BROKEN_IMAGE = 'malformed HTML image tag encountered: %s'
NO_CONTEXT = 'No source context available.'
PAGE_UNKNOWN = 'semantic page resolution unavailable for heading "%s"'
