"""The word lists, selectors, weights and limits that decide results."""

# page type -> words, in tie-breaking order (a tie goes to the later type)
PAGE_TYPE_WORDS = {
    "ecommerce": ["price", "buy", "cart", "shop", "product", "order", "payment"],
    "news": ["article", "news", "story", "report", "headline", "author", "date"],
    "blog": ["post", "blog", "comment", "tag", "category", "archive"],
    "social": ["like", "share", "follow", "friend", "profile", "feed"],
    "forum": ["thread", "post", "reply", "user", "topic", "discussion"],
}
TITLE_WEIGHT, DESCRIPTION_WEIGHT, KEYWORDS_WEIGHT, ELEMENT_WEIGHT = 3, 2, 1, 1
TYPE_BONUS = 5
TYPE_BONUS_SELECTORS = {
    "ecommerce": '.price, [class*="price"], [class*="cost"]',
    "news": 'article, .article, [class*="article"]',
    "blog": '.post, [class*="post"], .blog',
}
TYPE_THRESHOLD = 5
GENERAL = "general"

STRUCTURE_FLAGS = {
    "has_header": "header, .header",
    "has_navigation": "nav, .nav, .menu",
    "has_footer": "footer, .footer",
    "has_sidebar": "aside, .sidebar, .aside",
}
MAIN_CONTENT = [
    "main", '[role="main"]', ".main", ".content", ".container", "#content", "#main", "article", ".article",
]
MEDIA = {"images": "img", "videos": "video", "iframes": "iframe"}

REPEATING_MINIMUM = 3
SAMPLE_COUNT = 3
GROUP_SAMPLE_LENGTH, SELECTOR_SAMPLE_LENGTH = 100, 50
BEST_SELECTOR_BELOW = 1000

# page type -> suggestion -> selectors, earlier ones win ties
SUGGESTIONS = {
    "ecommerce": {
        "products": [".product", ".item", ".product-item", '[class*="product"]'],
        "prices": [".price", ".cost", '[class*="price"]', '[class*="cost"]'],
        "titles": [".product-title", ".title", "h1", "h2", '[class*="title"]'],
    },
    "news": {
        "articles": ["article", ".article", ".news-item", '[class*="article"]'],
        "headlines": ["h1", "h2", ".headline", ".title", '[class*="headline"]'],
        "content": [".content", ".text", "p", '[class*="content"]'],
    },
    "blog": {
        "posts": [".post", "article", ".entry", '[class*="post"]'],
        "titles": [".post-title", "h1", "h2", '[class*="title"]'],
    },
    "default": {
        "content": [".content", "p", ".text", "article"],
        "links": ["a"],
        "headings": ["h1", "h2", "h3"],
    },
}
CARD_SELECTORS = [".card", ".item", ".product", ".post", '[class*="card"]']
# pattern -> (more than this many members, confidence)
PATTERNS = {"table": (2, 0.9), "list": (3, 0.8), "cards": (2, 0.85)}

BASE_CONFIDENCE, TYPE_CONFIDENCE, MAIN_CONFIDENCE, REPEATING_CONFIDENCE = 0.5, 0.2, 0.1, 0.15
PATTERN_CONFIDENCE, PATTERN_CONFIDENCE_LIMIT = 0.05, 0.15
LOW_CONFIDENCE = 0.7
CONFIDENCE_BUCKETS = [(0.7, "high"), (0.4, "medium")]
APPLY_ORDER = ["products", "articles", "content", "posts"]
APPLY_STRATEGY = {"ecommerce": "smart-puppeteer", "social": "smart-puppeteer", "news": "cheerio", "blog": "cheerio"}

# element category -> selectors
ELEMENT_CATEGORIES = {
    "title": ["h1", "h2", "h3", ".title", ".heading", '[class*="title"]', '[class*="heading"]'],
    "content": ["p", ".content", ".text", ".description", '[class*="content"]', '[class*="text"]'],
    "list": ["ul", "ol", ".list", ".items", '[class*="list"]', '[class*="item"]'],
    "navigation": ["nav", ".nav", ".menu", ".navbar", '[class*="nav"]', '[class*="menu"]'],
    "article": ["article", ".article", ".post", ".entry", '[class*="article"]', '[class*="post"]'],
    "product": [".product", ".item", ".card", '[class*="product"]', '[class*="item"]', '[class*="card"]'],
    "image": ["img", ".image", ".photo", '[class*="image"]', '[class*="photo"]'],
    "link": ["a", ".link", '[class*="link"]'],
    "button": ["button", ".btn", ".button", '[class*="btn"]', '[class*="button"]'],
    "form": ["form", ".form", '[class*="form"]'],
    "table": ["table", ".table", '[class*="table"]'],
    "footer": ["footer", ".footer", '[class*="footer"]'],
    "header": ["header", ".header", '[class*="header"]'],
    "sidebar": [".sidebar", ".aside", "aside", '[class*="sidebar"]', '[class*="aside"]'],
}

# similarity of two elements
SAME_TAG, COMMON_CLASSES, SAME_CHILD_COUNT, SAME_PARENT_TAG = 0.3, 0.4, 0.2, 0.1
SIMILARITY_THRESHOLD = 0.8
LOCATOR_ATTRIBUTES = ["data-id", "data-testid", "data-qa", "name"]
LOCATOR_DEPTH = 5

# extractor -> extractors to try instead, in order
FALLBACKS = {
    "cheerio": ["xpath"],
    "puppeteer": ["cheerio", "xpath"],
    "xpath": ["cheerio"],
    "smart-puppeteer": ["puppeteer", "cheerio"],
}
STRATEGIES = {
    "cheerio": ("Cheerio (Быстрый)", ["Быстрый", "Статический HTML", "CSS селекторы"]),
    "puppeteer": (
        "Puppeteer (JavaScript поддержка)",
        ["JavaScript", "Динамический контент", "Автоскроллинг"],
    ),
    "xpath": (
        "XPath (Продвинутые селекторы)",
        ["XPath селекторы", "Продвинутые запросы", "Конвертация CSS в XPath"],
    ),
    "smart-puppeteer": (
        "Smart Puppeteer (ИИ + SPA поддержка)",
        ["ИИ анализ", "SPA поддержка", "Infinite scrolling", "Fallback стратегии"],
    ),
}
MS_PER_PAGE = {"smart-puppeteer": 8000, "puppeteer": 5000, "xpath": 3000, "cheerio": 2000}
HOURS, MINUTES, SECONDS = "ч", "м", "с"
LOW_QUALITY = 0.3

DEFAULT_SELECTOR, DEFAULT_PAGING, DEFAULT_FORMAT, DEFAULT_WAIT = "body", "query", "json", "networkidle2"
DEFAULT_MAX_PAGES, DEFAULT_DELAY = 1, 1000
MAX_URL_LENGTH, MAX_SELECTORS, MAX_PAGES = 2048, 50, 1000
ALLOWED_FORMATS = ["json", "csv", "xml"]
ALLOWED_PAGING = ["query", "path", "button", "infinite", "none"]
ALLOWED_WAITS = ["networkidle0", "networkidle2", "domcontentloaded", "load"]
ALLOWED_SELECTOR_TYPES = ["text", "html", "attribute"]

RETRYABLE_CODES = ["ECONNRESET", "ETIMEDOUT", "ENOTFOUND", "EAI_AGAIN", "ECONNREFUSED"]
RETRYABLE_STATUSES = [408, 429, 500, 502, 503, 504]
RETRYABLE_WORDS = ["timeout", "network"]
RETRY_ATTEMPTS, RETRY_BASE_MS, RETRY_MAX_MS, RETRY_FACTOR = 3, 1000, 10000, 2

PREVIEW_ITEMS = 5
NO_LINKS, NO_IMAGES, IMAGE_WORD, ARROW = "Нет ссылок", "Нет изображений", "Изображение", " → "
FEW_ITEMS, MANY_ITEMS = 5, 100
