"""Patterns and word lists that decide results, and the defaults of settings."""

# Folios
ARABIC = r"^\s*([0-9]{1,4})\s*$"
ANY_ARABIC = r"^\s*([0-9]+)\s*$"
ROMAN = r"(?i)^\s*([ivxlcdm]{1,8})\s*$"
LEADING_FOLIO = r"^([0-9]{1,4})\b"
TRAILING_FOLIO = r"\b([0-9]{1,4})$"
INDEX_ENTRY = r"^.{2,70}?,\s*[0-9]{1,4}(\s*[-–]\s*[0-9]{1,4})?(\s*,\s*[0-9]{1,4})*\s*$"
CHAPTER_HEADING = r"(?i)^\s*(chapter|part|section)\s+([0-9]+|[ivxlcdm]{1,8})\b"

# Questions
_PAGE = r"(?:pages?|pgs?\.?|pp?\.)\s*(?:numbers?|nos?\.?|num|#)?\s*"
_LINE = r"(?:line|ln\.?|l\.)\s*"
_NUM = r"([0-9]{1,4})"
PAGE_LINE = r"(?i)" + _PAGE + _NUM + r"\s*,?\s*(?:and\s+)?" + _LINE + _NUM
LINE_PAGE = r"(?i)" + _LINE + _NUM + r"\s*(?:of|on|from)\s*" + _PAGE + _NUM
PAGE_RANGE = r"(?i)" + _PAGE + _NUM + r"\s*(?:to|through|until|-|–|—)\s*(?:page\s*)?" + _NUM
PAGE_LIST = r"(?i)" + _PAGE + r"([0-9]{1,4}(?:\s*(?:,|and|&)\s*[0-9]{1,4})+)"
PAGE = r"(?i)" + _PAGE + _NUM
MAX_PAGE_SPAN = 30
MEMORY = r"(?i)\b(what did i (just )?(ask|say)|my (last|previous) (question|message)|repeat (that|my question)|what was my)\b"
GLOBAL = (
    r"\bentire book\b",
    r"\bwhole book\b",
    r"\bthe book\b.*\bsummar",
    r"\bsummar(?:y|ise|ize)\b.*\b(book|novel|volume|textbook|everything)\b",
    r"\boverall\b",
    r"\bin general\b",
    r"\bmain (?:themes|ideas|points|arguments)\b",
    r"\bkey takeaways\b",
    r"\bbest (?:problem|chapter|exercise|part)\b",
    r"\bacross the (?:book|novel|story)\b",
    r"\bevery chapter\b",
    r"\ball chapters\b",
    r"\bfrom start to finish\b",
    r"\bplot summary\b",
)
CHAPTER = r"(?i)\bchapter\s+([0-9]{1,3}|[ivxlcdm]{1,8})\b"

# Follow-ups
PRONOUNS = (
    r"(?i)\b(it|its|he|him|his|she|her|hers|they|them|their|this|that|these|those|"
    r"the (?:former|latter|first|second|third|last|next|previous|same)|"
    r"there|then|else|another|other one|one)\b"
)
CONTINUATION = (
    r"(?i)^\s*(and|but|so|also|what about|how about|why|why not|and then|then|ok|okay|"
    r"more|tell me more|go on|continue|explain more|elaborate)\b"
)
HISTORY_TURNS, HISTORY_CLIP, CLIENT_TURNS, REWRITE_CLIP = 6, 600, 12, 400

# Margins, chunks, retrieval, summaries, limiter
HEADER_ZONE, FOOTER_ZONE, MIN_FOLIO_AGREEMENT = 0.08, 0.92, 0.30
INDEX_SHARE, INDEX_LEAST_LINES = 0.40, 8
CHUNK_CHARS, CHUNK_OVERLAP_LINES = 900, 2
TOKEN = r"[a-z0-9']+"
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
RRF_CONSTANT, RETRIEVAL_K, CANDIDATE_K, GLOBAL_K = 60, 12, 40, 120
SUMMARY_MAX_CHARS = 60_000
LLM_RPM, RATE_SAFETY = 15, 0.7
QUOTA_MARKS = ("RESOURCE_EXHAUSTED", "429")
RETRY_DELAYS = (r"retry in ([0-9.]+)s", r"'retryDelay': '([0-9]+)s'")
ITEM_TYPES = ("speech", "thought", "caption", "sfx")
