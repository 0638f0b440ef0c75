"""Rule tables: the built-in fixed values and a loader for rule DataFrames.

A ``RuleSet`` is configuration. It is turned into literal column expressions when a
query is planned, so no join with the article table is needed at run time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Category keywords, in declaration order (ties go to the first declared).
CATEGORY_KEYWORDS = {
    "Tech News": [
        "tech", "technology", "apple", "google", "microsoft", "amazon", "facebook", "meta",
        "social media", "iphone", "android", "device", "hardware", "software", "app",
        "smartphone", "gadget", "internet", "online", "website", "mobile",
    ],
    "AI": [
        "ai", "artificial intelligence", "machine learning", "ml", "deep learning", "neural network",
        "gpt", "chatgpt", "openai", "llm", "large language model", "generative ai", "transformer",
        "computer vision", "natural language processing", "nlp", "claude", "anthropic",
    ],
    "Industry Analysis": [
        "industry", "market", "trend", "analysis", "forecast", "report", "growth",
        "decline", "strategy", "competition", "competitive", "sector", "economy",
        "economic", "business model", "disruption", "transformation",
    ],
    "Venture Capital": [
        "vc", "venture capital", "investor", "investment", "funding", "series a",
        "series b", "series c", "startup funding", "valuation", "exit", "acquisition",
        "ipo", "portfolio", "angel investor", "seed funding", "venture",
    ],
    "Programming": [
        "code", "coding", "programming", "developer", "software development", "engineer",
        "github", "git", "python", "javascript", "java", "c++", "rust", "go", "golang",
        "framework", "library", "api", "sdk", "algorithm", "database", "sql",
    ],
    "Science": [
        "science", "scientific", "research", "discovery", "physics", "chemistry", "biology",
        "astronomy", "climate", "environment", "medicine", "medical", "health", "disease",
        "vaccine", "experiment", "laboratory", "study",
    ],
    "Startups": [
        "startup", "founder", "entrepreneurship", "entrepreneur", "launch", "early stage",
        "seed", "incubator", "accelerator", "y combinator", "techstars", "product market fit",
        "pivot", "scale", "scaling", "growth hacking",
    ],
    "Essays": [
        "essay", "opinion", "perspective", "thought", "view", "analysis", "reflection",
        "philosophy", "argument", "critique", "review", "editorial", "column", "think piece",
    ],
}

# Subcategory keywords by category, in declaration order.
SUBCATEGORY_KEYWORDS = {
    "Tech News": {
        "Mobile": ["mobile", "iphone", "android", "smartphone", "ios", "app", "tablet", "ipad"],
        "Cloud Computing": ["cloud", "aws", "azure", "google cloud", "saas", "paas", "iaas"],
        "Social Media": ["social media", "facebook", "twitter", "instagram", "tiktok", "linkedin"],
        "Hardware": ["hardware", "device", "chip", "processor", "gpu", "cpu", "semiconductor"],
        "Software": ["software", "app", "application", "platform", "operating system", "windows", "macos"],
    },
    "AI": {
        "LLMs": ["llm", "large language model", "gpt", "chatgpt", "claude", "generative ai", "text generation"],
        "Computer Vision": ["computer vision", "image recognition", "object detection", "facial recognition"],
        "NLP": ["nlp", "natural language processing", "text analysis", "sentiment analysis"],
        "AI Ethics": ["ethics", "bias", "fairness", "responsible ai", "ai safety", "alignment"],
        "AI Applications": ["application", "use case", "implementation", "adoption", "ai solution"],
    },
    "Programming": {
        "Web Development": ["web", "javascript", "html", "css", "frontend", "backend", "fullstack"],
        "Data Science": ["data science", "data analysis", "pandas", "numpy", "jupyter", "visualization"],
        "DevOps": ["devops", "ci/cd", "pipeline", "docker", "kubernetes", "container", "deployment"],
        "Security": ["security", "cybersecurity", "encryption", "vulnerability", "authentication"],
        "Languages": ["language", "python", "javascript", "java", "c++", "rust", "go", "typescript"],
    },
}

# Fixed values: (category, source terms, weight); the weight is added once per category.
SOURCE_BOOSTS = [
    ("Tech News", ["techcrunch", "wired", "verge", "engadget", "cnet"], 3),
    ("AI", ["ai", "artificial intelligence", "openai", "deepmind"], 3),
    ("Programming", ["github", "stackoverflow", "dev.to", "hackernews"], 3),
    ("Venture Capital", ["techcrunch", "venture", "vc", "funded", "crunchbase"], 3),
]

# Phrases that mark a paywalled text.
PAYWALL_TERMS = [
    "subscribe to read", "subscribe to continue", "subscription required",
    "to continue reading", "create an account", "sign up to read",
    "premium content", "premium article", "members only", "paid subscribers only",
    "subscribe to unlock", "subscribe for full access", "subscribe now",
    "for subscribers only", "for full access", "unlock this article",
    "login to read", "sign in to read", "register to read", "register to continue",
    "subscribe to", "subscription", "paywall", "premium", "subscribe for",
    "already subscribed", "subscriber-only", "subscribers only",
]

# Sites known to be paywalled.
PAYWALL_DOMAINS = [
    "ft.com", "wsj.com", "nytimes.com", "economist.com", "bloomberg.com",
    "washingtonpost.com", "newyorker.com", "wired.com", "thetimes.co.uk",
    "theinformation.com", "stratechery.com", "theatlantic.com", "medium.com",
    "forbes.com", "businessinsider.com", "seekingalpha.com", "barrons.com",
]

# Words left out of keyword extraction.
STOP_WORDS = [
    "the", "and", "is", "in", "to", "a", "of", "for", "with", "on", "that",
    "this", "it", "as", "by", "from", "was", "were", "are", "be", "have", "has",
]

# Terms counted by the technical_terms feature.
TECHNICAL_TERMS = [
    "algorithm", "database", "framework", "api", "cloud",
    "infrastructure", "protocol", "architecture",
]

# Newsletter sections with keyword lists and feature thresholds.
SECTION_RULES = {
    "Essays of the Week": {
        "keywords": [
            "analysis", "perspective", "opinion", "research", "deep dive",
            "exploring", "understand", "think", "believe", "argument",
            "implications", "future", "impact", "trends", "philosophical",
            "review", "critique", "examine", "investigate", "study",
        ],
        "min_length": 1000, "min_quotes": 1, "min_reading_time": 5,
    },
    "News of the Week": {
        "keywords": [
            "announces", "releases", "updates", "reports", "says",
            "launches", "introduces", "unveils", "confirms", "plans",
            "new", "latest", "product", "feature", "event",
        ],
        "max_reading_time": 5,
    },
    "Startup of the Week": {
        "keywords": [
            "funding", "valuation", "acquisition", "ipo", "investment",
            "venture", "capital", "startup", "series", "round",
        ],
        "min_length": 500, "min_quotes": 1, "min_reading_time": 3,
    },
}


@dataclass(frozen=True)
class RuleSet:
    """Category and subcategory keywords (in declared order) and source boosts."""

    categories: tuple[tuple[str, tuple[str, ...]], ...]
    subcategories: tuple[tuple[str, tuple[tuple[str, tuple[str, ...]], ...]], ...] = ()
    boosts: tuple[tuple[str, tuple[str, ...], int], ...] = ()


def _frozen(keywords: dict[str, list[str]]) -> tuple[tuple[str, tuple[str, ...]], ...]:
    return tuple((name, tuple(k.lower() for k in words)) for name, words in keywords.items())


DEFAULT_RULES = RuleSet(
    categories=_frozen(CATEGORY_KEYWORDS),
    subcategories=tuple((cat, _frozen(subs)) for cat, subs in SUBCATEGORY_KEYWORDS.items()),
    boosts=tuple((cat, tuple(terms), weight) for cat, terms, weight in SOURCE_BOOSTS),
)


def rule_rows(spark: SparkSession, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """The category keywords as a table ``(category, rule_ord, keyword)``."""
    rows = [(cat, i, k) for i, (cat, words) in enumerate(rules.categories) for k in words]
    return spark.createDataFrame(rows, "category string, rule_ord int, keyword string")


def subrule_rows(spark: SparkSession, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """The subcategory keywords as a table ``(category, subcategory, sub_ord, keyword)``."""
    rows = [
        (cat, sub, j, k)
        for cat, subs in rules.subcategories
        for j, (sub, words) in enumerate(subs)
        for k in words
    ]
    return spark.createDataFrame(rows, "category string, subcategory string, sub_ord int, keyword string")


def boost_rows(spark: SparkSession, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """The source boosts as a table ``(category, source_term, weight)``."""
    rows = [(cat, t, w) for cat, terms, w in rules.boosts for t in terms]
    return spark.createDataFrame(rows, "category string, source_term string, weight int")


def rules_from_tables(
    rules: DataFrame, subrules: DataFrame | None = None, boosts: DataFrame | None = None
) -> RuleSet:
    """Build a ``RuleSet`` from rule tables of the shapes above (for example read from YAML or JSON).

    A rule set is configuration: the tables are read to the driver and become literals of the plan.
    """

    def ordered(rows, name, order):
        groups: dict[str, list[str]] = {}
        for r in sorted(rows, key=lambda r: r[order]):
            groups.setdefault(r[name], []).append(r["keyword"])
        return _frozen(groups)

    cats = ordered(rules.collect(), "category", "rule_ord")
    subs: tuple = ()
    if subrules is not None:
        by_cat: dict[str, list] = {}
        for r in subrules.collect():
            by_cat.setdefault(r["category"], []).append(r)
        subs = tuple((cat, ordered(rows, "subcategory", "sub_ord")) for cat, rows in by_cat.items())
    boosted: dict[tuple[str, int], list[str]] = {}
    if boosts is not None:
        for r in boosts.collect():
            boosted.setdefault((r["category"], r["weight"]), []).append(r["source_term"].lower())
    return RuleSet(cats, subs, tuple((cat, tuple(t), w) for (cat, w), t in boosted.items()))
